"""Grouped summaries, metrics, rankings and set operations."""

from pyspark.sql import functions as F

from ..functions.numeric import band, count_where
from ..functions.numeric import reasons as reasons_of
from ..operators import metrics, ranking, summaries
from .registry import query, rounded, t


@query("""
    WITH e AS (SELECT event_type, user_id % 4 AS bucket, CASE WHEN value > 20 THEN value END AS v FROM events)
    SELECT event_type, bucket, CASE WHEN GROUPING(event_type) = 1 AND GROUPING(bucket) = 1 THEN 'overall' WHEN GROUPING(bucket) = 1 THEN 'event_type' WHEN GROUPING(event_type) = 1 THEN 'bucket' ELSE 'event_type_bucket' END AS group_type,
           count(*) AS planned, count(v) AS observed, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS minimum, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, max(v) AS maximum
    FROM e GROUP BY GROUPING SETS ((), (event_type), (bucket), (event_type, bucket))""")
def grouping_set_summary(spark, sf_dir):
    d = t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("bucket"), F.when(F.col("value") > 20, F.col("value")).alias("v"))
    sets = {"overall": [], "event_type": ["event_type"], "bucket": ["bucket"], "event_type_bucket": ["event_type", "bucket"]}
    return rounded(summaries.grouping_sets(d, sets, summaries.numeric_summary("v"), "v"), {"mean": 6, "sd": 6, "q1": 4, "median": 4, "q3": 4})


@query("""
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS status_F, count(*) FILTER (o_orderstatus = 'O') AS status_O, count(*) FILTER (o_orderstatus = 'P') AS status_P FROM orders GROUP BY 1""")
def status_pivot(spark, sf_dir):
    return summaries.pivot_counts(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "status_")


@query("""
    WITH n AS (SELECT l_suppkey, l_partkey % 7 AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS rn FROM n)
    SELECT l_suppkey, v AS dominant, n AS count FROM r WHERE rn = 1""")
def dominant_value(spark, sf_dir):
    return summaries.mode(t(spark, sf_dir, "lineitem").withColumn("v", F.col("l_partkey") % 7), ["l_suppkey"], "v")


@query("""
    SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return rounded(summaries.latency_summary(t(spark, sf_dir, "events"), ["event_type"], "value"), {"mean": 6})


@query("""
    WITH r AS (SELECT n_name, l_orderkey, sum(l_quantity * (l_returnflag = 'R')::INT) AS top, sum(l_quantity) AS bottom FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT n_name, round(avg(top / bottom), 6) AS macro, round(sum(top) / sum(bottom), 6) AS micro, round(quantile_cont(top / bottom, 0.1), 6) AS p10, count(*) AS rows FROM r GROUP BY 1""")
def macro_micro_ratio(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = j.groupBy("n_name", "l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("top"), F.sum("l_quantity").alias("bottom"))
    return rounded(summaries.macro_micro(g, ["n_name"], "top", "bottom"), {"macro": 6, "micro": 6, "p10": 6})


def _generations(spark, sf_dir):
    """Each user's day of events as one generation: types are statuses of claims."""
    is_ = lambda e: count_where(F.col("event_type") == e)
    g = t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        is_("view").alias("supported_count"), is_("click").alias("unsupported_count"), is_("error").alias("contradicted_count"), is_("signup").alias("not_verifiable_count"),
        (is_("purchase") < 2).alias("usable"), F.sum("value").alias("latency_ms"), F.count("*").alias("claim_count"),
    )
    return g.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_GENERATIONS = """
    WITH g AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS u, count(*) FILTER (event_type = 'error') AS c,
                      count(*) FILTER (event_type = 'signup') AS v, count(*) FILTER (event_type = 'purchase') < 2 AS usable, sum(value) AS ms FROM events GROUP BY 1, 2) """


@query(_GENERATIONS + """
    SELECT user_id, day, s + u + c AS resolved, s + u + c + v AS applicable, round(CASE WHEN s + u + c > 0 THEN s / (s + u + c) END, 6) AS resolved_faithfulness,
           round(CASE WHEN s + u + c + v > 0 THEN (s + u + c) / (s + u + c + v) END, 6) AS verifiability, round(CASE WHEN s + u + c + v > 0 THEN s / (s + u + c + v) END, 6) AS conservative_faithfulness,
           round(CASE WHEN NOT usable THEN 0.0 WHEN s + u + c + v > 0 THEN s / (s + u + c + v) END, 6) AS end_to_end_yield, (usable AND s + u + c + v > 0 AND s = s + u + c + v)::INT AS strictly_faithful FROM g""")
def quality_metrics(spark, sf_dir):
    d = metrics.quality(_generations(spark, sf_dir)).select("user_id", "day", "resolved", "applicable", "resolved_faithfulness", "verifiability", "conservative_faithfulness", "end_to_end_yield", "strictly_faithful")
    return rounded(d, {c: 6 for c in ("resolved_faithfulness", "verifiability", "conservative_faithfulness", "end_to_end_yield")})


@query(_GENERATIONS + """
    , x AS (SELECT *, s + u + c + v AS a, usable AND s + u + c + v > 0 AS ok FROM g)
    SELECT user_id, day, round(CASE WHEN ok THEN s / a ELSE 0.0 END, 6) AS yield_share, CASE WHEN ok THEN 0.0 ELSE 1.0 END::DOUBLE AS pipeline_loss, round(CASE WHEN ok THEN v / a ELSE 0.0 END, 6) AS not_verifiable_loss,
           round(CASE WHEN ok THEN u / a ELSE 0.0 END, 6) AS unsupported_loss, round(CASE WHEN ok THEN c / a ELSE 0.0 END, 6) AS contradiction_loss, true AS identity_holds FROM x""")
def loss_decomposition(spark, sf_dir):
    cols = ["yield_share", "pipeline_loss", "not_verifiable_loss", "unsupported_loss", "contradiction_loss"]
    return rounded(metrics.losses(_generations(spark, sf_dir)).select("user_id", "day", *cols, "identity_holds"), {c: 6 for c in cols})


@query(_GENERATIONS + """
    SELECT user_id, day, round(CASE WHEN ms / 1000 > 0 THEN (s + u + c + v) / (ms / 1000) END, 4) AS claims_per_second, round(CASE WHEN s > 0 THEN ms / s END, 4) AS latency_per_supported_claim_ms FROM g""")
def efficiency_metrics(spark, sf_dir):
    g = _generations(spark, sf_dir).withColumns({"claim_count": F.col("supported_count") + F.col("unsupported_count") + F.col("contradicted_count") + F.col("not_verifiable_count"), "output_token_count": F.lit(None).cast("long"), "total_token_count": F.lit(None).cast("long")})
    return rounded(metrics.efficiency(g).select("user_id", "day", "claims_per_second", "latency_per_supported_claim_ms"), {"claims_per_second": 4, "latency_per_supported_claim_ms": 4})


@query("""
    WITH f AS (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'TRUNCATED' WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'PARSE' WHEN o_orderpriority = '5-LOW' THEN 'SCHEMA' WHEN o_totalprice < 10000 THEN 'RUNTIME' ELSE 'NONE' END AS failure,
               array_to_string([x FOR x IN [CASE WHEN o_totalprice > 450000 THEN 'TRUNCATED' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'PARSE' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'SCHEMA' END] IF x IS NOT NULL], '|') AS reasons FROM orders)
    SELECT failure, reasons, count(*) AS orders FROM f GROUP BY ALL""")
def failure_precedence(spark, sf_dir):
    """The first failure in order of precedence, and all of them."""
    from ..functions.numeric import first_failure

    p = F.col("o_totalprice")
    flags = [("TRUNCATED", p > 450000), ("PARSE", (F.col("o_orderstatus") == "F") & (p < 50000)), ("SCHEMA", F.col("o_orderpriority") == "5-LOW")]
    d = t(spark, sf_dir, "orders").select(first_failure([*flags, ("RUNTIME", p < 10000)]).alias("failure"), F.array_join(reasons_of(flags), "|").alias("reasons"))
    return d.groupBy("failure", "reasons").agg(F.count("*").alias("orders"))


@query("""
    SELECT CASE WHEN l_discount <= 0.01 THEN 'tiny' WHEN l_discount <= 0.05 THEN 'small' WHEN l_discount <= 0.08 THEN 'middle' ELSE 'large' END AS size, l_returnflag, count(*) AS items FROM lineitem GROUP BY ALL""")
def banded_counts(spark, sf_dir):
    b = band(F.col("l_discount"), (0.01, 0.05, 0.08), ("tiny", "small", "middle", "large"))
    return t(spark, sf_dir, "lineitem").groupBy(b.alias("size"), "l_returnflag").agg(F.count("*").alias("items"))


@query("""
    SELECT coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'none') AS value, count(*) AS count FROM documents GROUP BY 1""")
def counts_with_missing(spark, sf_dir):
    return summaries.counts_by(t(spark, sf_dir, "documents").withColumn("v", F.when(F.col("lang") != "en", F.col("lang"))), "v")


@query("""
    SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC) AS competition, rank() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000)) + (count(*) OVER (PARTITION BY o_custkey, floor(o_totalprice / 50000)) - 1) / 2 AS average,
           count(*) OVER (PARTITION BY o_custkey, floor(o_totalprice / 50000)) > 1 AS tied FROM orders""")
def rank_kinds(spark, sf_dir):
    d = t(spark, sf_dir, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 50000))
    d = d.withColumn("competition", ranking.competition_rank(["o_custkey"], F.col("v"))).withColumn("average", ranking.average_rank(["o_custkey"], F.col("v")))
    return ranking.ties(d, ["o_custkey"], "v").select("o_orderkey", "o_custkey", "competition", "average", "tied")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def dedupe_preference(spark, sf_dir):
    """One order a customer: a finished one first, then the latest."""
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return ranking.preferred(t(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
    WITH k AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n, doc_id, source FROM documents)
    SELECT md5(n) AS h, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM k GROUP BY n""")
def first_text_wins(spark, sf_dir):
    from ..functions.texts import ascii_normal

    d = t(spark, sf_dir, "documents").select(F.md5(ascii_normal(F.col("text"))).alias("h"), "doc_id", "source")
    return ranking.least_row(d, ["h"], ["doc_id"])


@query("""
    WITH s AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
    a AS (SELECT * FROM s ORDER BY o_totalprice DESC, o_orderkey LIMIT 10), b AS (SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_totalprice, o_orderkey LIMIT 10),
    c AS (SELECT * FROM s WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM b) ORDER BY abs(o_totalprice - 250000), o_orderkey LIMIT 10),
    d AS (SELECT * FROM s WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM c) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
    SELECT 'top' AS "group", row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS group_rank, o_orderkey FROM a UNION ALL SELECT 'low', row_number() OVER (ORDER BY o_totalprice, o_orderkey), o_orderkey FROM b
    UNION ALL SELECT 'near', row_number() OVER (ORDER BY abs(o_totalprice - 250000), o_orderkey), o_orderkey FROM c UNION ALL SELECT 'urgent', row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey), o_orderkey FROM d""")
def case_selection(spark, sf_dir):
    """Groups of ten that take what earlier groups left."""
    p, k, yes = F.col("o_totalprice"), F.asc("o_orderkey"), F.lit(True)
    groups = [("top", yes, [p.desc(), k], 10), ("low", yes, [p.asc(), k], 10), ("near", F.col("o_orderstatus") == "F", [F.abs(p - 250000).asc(), k], 10), ("urgent", F.col("o_orderpriority") == "1-URGENT", [p.desc(), k], 10)]
    d = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return ranking.exclusive_groups(d, "o_orderkey", groups).select("group", "group_rank", "o_orderkey")


@query("""
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, c_mktsegment, CASE WHEN rn <= 2 THEN 'easy' WHEN rn > n - 2 THEN 'hard' ELSE 'medium' END AS level FROM r WHERE rn <= 2 OR rn > n - 2 OR (rn > floor((n - 2) / 2) AND rn <= floor((n - 2) / 2) + 2)""")
def difficulty_slices(spark, sf_dir):
    return ranking.slices(t(spark, sf_dir, "customer"), "c_mktsegment", [F.asc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_mktsegment", "level")


@query("""
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('rr:' || c_custkey), c_custkey) AS d FROM customer)
    SELECT c_custkey, c_mktsegment FROM r ORDER BY d, c_mktsegment LIMIT 17""")
def round_robin_sample(spark, sf_dir):
    from ..functions.identity import hash_order

    return ranking.round_robin(t(spark, sf_dir, "customer"), "c_mktsegment", [hash_order("rr", F.col("c_custkey")), F.asc("c_custkey")], 17).select("c_custkey", "c_mktsegment")


@query("""
    WITH p AS (SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 26), n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM p)
    SELECT event_id, event_type, (SELECT count(*) FROM p) > 25 AS has_more FROM n WHERE rn <= 25""")
def keyset_page(spark, sf_dir):
    """A page of the log, newest first, after a given row."""
    import datetime

    after = (datetime.datetime(2024, 1, 20), 5000)
    return ranking.page(t(spark, sf_dir, "events").select("event_id", "ts", "event_type"), [("ts", True), ("event_id", True)], 25, after).select("event_id", "event_type", "has_more")


@query("""
    SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_align(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""
    SELECT DISTINCT o_orderpriority, split_part(o_orderpriority, '-', 1)::INT AS place FROM orders""")
def ordered_levels(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderpriority", F.split("o_orderpriority", "-")[0].cast("int").alias("place")).distinct().orderBy("place")


@query("""
    SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 480000""")
def set_algebra(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    k = lambda c: o.where(c).select("o_custkey")
    return k("o_orderstatus = 'F'").intersect(k("o_orderpriority = '1-URGENT'")).subtract(k("o_totalprice > 480000"))


@query("""
    WITH s AS (SELECT 'errors' AS search, * FROM events WHERE event_type = 'error'
               UNION ALL SELECT 'january', * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' AND value >= 10
               UNION ALL SELECT 'of_one', * FROM events WHERE user_id = 8 AND (ts < TIMESTAMP '2024-01-20' OR ts = TIMESTAMP '2024-01-20' AND event_id < 5000)
               UNION ALL SELECT 'all', * FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY ts DESC, event_id DESC)::INT AS place, count(*) OVER (PARTITION BY search) > 20 AS has_more FROM s)
    SELECT search, event_id, event_type, place, has_more FROM r WHERE place <= 20""")
def log_searches(spark, sf_dir):
    """Four searches of the log at once: by type, by time and value, a further page of one user's, and everything."""
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    e = t(spark, sf_dir, "events")
    found = ranking.searched(e, {
        "errors": ({"event_type": "error", "user_id": None}, {}, None),
        "january": ({}, {"ts": (day(5), day(9)), "value": (10.0, None)}, None),
        "of_one": ({"user_id": 8}, {}, (day(20), 5000)),
        "all": ({}, {}, None),
    }, ["ts", "event_id"], 20)
    return found.select("search", "event_id", "event_type", "place", "has_more")


@query("""
    WITH s AS (SELECT 'urgent' AS search, * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
               UNION ALL SELECT 'cheap', * FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT 'of_customer', * FROM orders WHERE o_custkey = 17),
    r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place, count(*) OVER (PARTITION BY search) > 10 AS has_more FROM s)
    SELECT search, o_orderkey, place, has_more FROM r WHERE place <= 10""")
def order_searches(spark, sf_dir):
    """Three searches of the orders, newest first."""
    found = ranking.searched(t(spark, sf_dir, "orders"), {
        "urgent": ({"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}, {}, None), "cheap": ({"o_orderstatus": None}, {"o_totalprice": (None, 5000.0)}, None), "of_customer": ({"o_custkey": 17}, {}, None),
    }, ["o_orderdate", "o_orderkey"], 10)
    return found.select("search", "o_orderkey", "place", "has_more")
