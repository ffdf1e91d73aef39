"""Phrases found through an index, plans certified by replay, and assertions over a release's tables."""

from pyspark.sql import functions as F

from ..functions.texts import ascii_normal
from ..operators import phrases, release
from .registry import query, rounded, t


@query(r"""
    WITH b AS (SELECT item_id, unnest(string_split_regex(text, '[.!?\n]')) AS x, unnest(range(len(string_split_regex(text, '[.!?\n]')))) AS place FROM benchmark),
    p AS (SELECT item_id, place, string_split(s, ' ') AS pw, s FROM (SELECT item_id, place, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS s FROM b) WHERE s <> ''),
    d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS txt, string_split(txt, ' ') AS tw FROM documents),
    j AS (SELECT doc_id, item_id, place, txt, s, pw, len(list_intersect(list_distinct(pw), tw)) / len(list_distinct(pw)) AS cov FROM d, p),
    m AS (SELECT *, CASE WHEN txt = s THEN 'EXACT' WHEN len(pw) >= 4 AND contains(' ' || txt || ' ', ' ' || s || ' ') THEN 'CONTAINED' WHEN len(pw) >= 4 AND cov >= 0.8 THEN 'HIGH_OVERLAP' END AS t FROM j)
    SELECT doc_id, item_id, place, t AS match_type, round(cov, 6) AS coverage FROM m WHERE t IS NOT NULL""")
def indexed_phrases(spark, sf_dir):
    """Every sentence of the benchmark's items in every document that holds it or most of its words."""
    b = t(spark, sf_dir, "benchmark").select("item_id", F.transform(F.split("text", r"[.!?\n]", -1), lambda x: F.struct(x.alias("said"))).alias("evidence"))
    p = phrases.from_packages(b, "item_id", "evidence", "said")
    d = t(spark, sf_dir, "documents").select("doc_id", ascii_normal("text").alias("text"))
    return rounded(phrases.matches(d, "doc_id", p, ["item_id", "place"]), {"coverage": 6})


_RESPONSES = """
    plan AS (SELECT c_custkey, level, repeat, sha256('v1|' || c_custkey || '|' || level || '|' || repeat) AS cell_id FROM customer, (VALUES ('S0'), ('S1')) o(level), range(1, 3) r(repeat)),
    r0 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'S0' ELSE 'S1' END AS level, 1 + o_orderkey // 2 % 2 AS repeat, o_totalprice::DECIMAL(15,2)::VARCHAR AS payload FROM orders),
    r AS (SELECT sha256('v1|' || (o_custkey + CASE WHEN o_orderkey % 97 = 5 THEN 100000000 ELSE 0 END) || '|' || level || '|' || repeat) AS cell_id, payload, sha256(payload || CASE WHEN o_orderkey % 13 = 1 THEN 'x' ELSE '' END) AS sha,
                 1 + o_orderkey // 4 % 2 AS part, CASE WHEN o_orderkey % 19 = 2 THEN 3 WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END AS of FROM r0),
    g AS (SELECT cell_id, count(*) AS parts, count(*) FILTER (sha256(payload) <> sha) AS bad, count(DISTINCT part) AS n, min(of) AS o, max(of) AS most, list(part) AS ps,
                 sha256(string_agg(sha, '|' ORDER BY part, sha)) AS response_digest FROM r GROUP BY cell_id),
    s AS (SELECT *, CASE WHEN bad > 0 THEN 'ALTERED' WHEN n < parts THEN 'DUPLICATED' WHEN o <> most THEN 'INCONSISTENT' WHEN len(list_filter(ps, lambda p: p <= o)) < o OR len(list_filter(ps, lambda p: p <= o)) < parts THEN 'INCOMPLETE' ELSE 'CERTIFIED' END AS status FROM g)
"""


def _replayed(spark, sf_dir):
    """Customers by evidence level and repeat as a plan, orders as the stored parts of its responses: some altered, some of no cell."""
    cases = t(spark, sf_dir, "customer").select("c_custkey")
    plan = release.planned(cases, spark.createDataFrame([("S0",), ("S1",)], "level string"), 2, "v1")
    o, k = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    level, repeat = F.when(k % 2 == 0, "S0").otherwise("S1"), (1 + F.floor(k / 2) % 2).cast("int")
    who = F.col("o_custkey") + F.when(k % 97 == 5, 100_000_000).otherwise(0)
    payload = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    r = o.select(
        release.digest(F.lit("v1"), who, level, repeat).alias("cell_id"), (1 + F.floor(k / 4) % 2).cast("int").alias("part"), F.when(k % 19 == 2, 3).when(F.col("o_custkey") % 3 == 0, 1).otherwise(2).alias("of"),
        payload.alias("payload"), F.sha2(F.concat(payload, F.when(k % 13 == 1, "x").otherwise("")), 256).alias("payload_sha256"),
    )
    return release.replayed(plan, r)


@query("WITH " + _RESPONSES + """
    SELECT cell_id, c_custkey, level, repeat, CASE WHEN c_custkey IS NULL THEN 'UNPLANNED' ELSE coalesce(status, 'MISSING') END AS status, coalesce(parts, 0) AS parts,
           CASE WHEN c_custkey IS NOT NULL AND status = 'CERTIFIED' THEN response_digest END AS response_digest FROM plan FULL JOIN s USING (cell_id)""")
def replayed_cells(spark, sf_dir):
    """Every planned cell with what is stored for it: certified only if each part is there once and unaltered."""
    return _replayed(spark, sf_dir).select("cell_id", "c_custkey", "level", "repeat", "status", "parts", "response_digest")


@query("WITH " + _RESPONSES + """
    SELECT level, count(*) AS cells, count(*) FILTER (status = 'CERTIFIED') AS certified, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status = 'CERTIFIED') = count(*) AS complete FROM plan LEFT JOIN s USING (cell_id) GROUP BY level""")
def replay_certification(spark, sf_dir):
    """By evidence level how many cells are certified; a level is complete if all are."""
    c = _replayed(spark, sf_dir).where("status <> 'UNPLANNED'")
    return c.groupBy("level").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "CERTIFIED").alias("certified"), F.count_if(F.col("status") == "MISSING").alias("missing"), (F.count_if(F.col("status") == "CERTIFIED") == F.count("*")).alias("complete"))


_ASSERTIONS = (
    release.Assertion("quantity_positive", "lineitem", never="l_quantity <= 0"),
    release.Assertion("discount_within_tenth", "lineitem", never="l_discount > 0.09", blocking=False),
    release.Assertion("line_is_unique", "lineitem", key=("l_orderkey", "l_linenumber")),
    release.Assertion("line_has_order", "lineitem", refers=(("l_orderkey",), "orders", ("o_orderkey",))),
    release.Assertion("order_is_unique", "orders", key=("o_orderkey",)),
    release.Assertion("order_has_customer", "orders", refers=(("o_custkey",), "customer", ("c_custkey",))),
    release.Assertion("price_known", "orders", never="o_totalprice IS NULL"),
    release.Assertion("balance_not_negative", "customer", never="c_acctbal < 0", blocking=False),
)


@query("""
    WITH x(assertion, "table", rows, violations, blocking) AS (
        SELECT 'quantity_positive', 'lineitem', count(*), count(*) FILTER (l_quantity <= 0), true FROM lineitem
        UNION ALL SELECT 'discount_within_tenth', 'lineitem', count(*), count(*) FILTER (l_discount > 0.09), false FROM lineitem
        UNION ALL SELECT 'line_is_unique', 'lineitem', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), true FROM lineitem
        UNION ALL SELECT 'line_has_order', 'lineitem', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)), true FROM lineitem
        UNION ALL SELECT 'order_is_unique', 'orders', count(*), count(*) - count(DISTINCT o_orderkey), true FROM orders
        UNION ALL SELECT 'order_has_customer', 'orders', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)), true FROM orders
        UNION ALL SELECT 'price_known', 'orders', count(*), count(*) FILTER (o_totalprice IS NULL), true FROM orders
        UNION ALL SELECT 'balance_not_negative', 'customer', count(*), count(*) FILTER (c_acctbal < 0), false FROM customer)
    SELECT *, CASE WHEN violations = 0 THEN 'PASS' WHEN blocking THEN 'FAIL' ELSE 'WARN' END AS status FROM x""")
def release_assertions(spark, sf_dir):
    """Assertions over three tables: rows that must not be, keys, references."""
    return release.verified({n: t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")}, _ASSERTIONS)


@query("""
    WITH l AS (SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') AS k FROM orders)
    SELECT o_orderkey, k AS name FROM l WHERE k IN ('high', 'urgent') UNION ALL SELECT o_orderkey, 'secret' FROM orders WHERE o_orderkey % 7 = 0""")
def forbidden_payload_keys(spark, sf_dir):
    """Orders as nested JSON whose keys depend on the data, and those that must not be among them, at any depth."""
    k = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "")
    inner = F.concat(F.lit('{"list": [{"'), k, F.lit('": 1, "text": "a \\"urgent\\": no"'), F.when(F.col("o_orderkey") % 7 == 0, F.lit(', "Secret" : null')).otherwise(F.lit("")), F.lit('}], "high ": "high"}'))
    return release.forbidden_keys(t(spark, sf_dir, "orders").select("o_orderkey", inner.alias("payload")), "o_orderkey", "payload", ["high", "urgent", "SECRET"])
