"""Answers and their contracts, summaries of generations and of evidence designs, choices by several criteria, kinds of columns."""

from pyspark.sql import functions as F

from ..operators import audits, decisions, generations, preparation, ranking, summaries
from ..operators.evaluation import best_model
from .registry import query, rounded, t


@query("""
    WITH f AS (SELECT l_orderkey, list((l_partkey % 10)::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS summary, CASE WHEN o_orderkey % 7 = 0 THEN '  ' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'x' END AS note, coalesce(ids, []) AS ids,
                 CASE WHEN o_orderkey % 3 = 0 THEN list_sort(ids) WHEN o_orderkey % 3 = 1 THEN ['0', '1', '2'] END AS required, o_orderkey % 11 <> 0 AS ok FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN trim(summary) = '' THEN 'MISSING_SUMMARY' END, CASE WHEN trim(coalesce(note, '')) = '' THEN 'MISSING_NOTE' END, CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'DUPLICATE_FACTOR' END,
        CASE WHEN list_contains(ids, '9') THEN 'FACTOR_NOT_ALLOWED' END, CASE WHEN len(required) <> len(ids) THEN 'FACTOR_COUNT' END, CASE WHEN len(required) = len(ids) AND required <> ids THEN 'FACTOR_ORDER' END, CASE WHEN NOT ok THEN 'LANGUAGE' END], lambda x: x IS NOT NULL), '|') AS issues FROM r""")
def contract_issues(spark, sf_dir):
    """Orders as answers, their lines as the factors that they name: everything that breaks the contract."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    f = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: (x["l_partkey"] % 10).cast("string")).alias("factor_ids"))
    o, k = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = o.join(f, k == F.col("l_orderkey"), "left").select(
        k, F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("summary"), F.when(k % 7 == 0, "  ").when(k % 7 != 1, "x").alias("note"), "factor_ids", F.array(*[F.lit(str(i)) for i in range(9)]).alias("allowed_ids"),
        F.when(k % 3 == 0, F.array_sort("factor_ids")).when(k % 3 == 1, F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("required_ids"), (k % 11 != 0).alias("language_ok"),
    )
    return generations.contract_issues(d, ["summary", "note"]).select("o_orderkey", F.array_join("issues", "|").alias("issues"))


@query("""
    SELECT user_id AS case_id, event_type AS evidence_level, count(DISTINCT CASE WHEN event_id % 10 = 0 THEN md5(event_type || 'x') ELSE md5(event_type) END) AS prompts, count(*) AS generations FROM events GROUP BY 1, 2 HAVING prompts <> 1""")
def unfair_prompts(spark, sf_dir):
    """Cohorts of users and event types whose prompts are not one."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("evidence_level"), F.when(F.col("event_id") % 10 == 0, F.md5(F.concat("event_type", F.lit("x")))).otherwise(F.md5("event_type")).alias("prompt_hash"))
    return generations.unfair_prompts(e)


@query("""
    WITH r AS (SELECT l_orderkey AS g, CASE l_returnflag WHEN 'A' THEN 'SUPPORTED' WHEN 'R' THEN 'CONTRADICTED' ELSE CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NOT_VERIFIABLE' WHEN l_linenumber = 3 THEN 'NOT_APPLICABLE' ELSE 'UNSUPPORTED' END END AS s,
                      CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 'ERROR' ELSE 'SUCCESS' END AS x, CASE WHEN l_linenumber % 4 > 0 THEN 'F' || l_linenumber % 4 END AS f, l_tax > 0.07 AS hard FROM lineitem),
    a AS (SELECT g, count(*) AS n, count(*) FILTER (s = 'SUPPORTED') AS su, count(*) FILTER (s = 'UNSUPPORTED') AS un, count(*) FILTER (s = 'CONTRADICTED') AS co, count(*) FILTER (s = 'NOT_VERIFIABLE') AS nv, count(*) FILTER (s = 'NOT_APPLICABLE') AS na, count(*) FILTER (x = 'ERROR') AS er, count(*) FILTER (hard) AS hs FROM r GROUP BY g),
    f AS (SELECT g, string_agg(f || '=' || n, ',' ORDER BY f) AS families FROM (SELECT g, coalesce(f, 'NONE') AS f, count(*) AS n FROM r GROUP BY ALL) GROUP BY g),
    o AS (SELECT o_orderkey AS generation_id, o_orderstatus <> 'P' AS usable, CASE WHEN o_custkey % 2 = 0 THEN 'TRUNCATED' ELSE 'TRUNCATED|PARSE_FAILED' END AS why FROM orders)
    SELECT generation_id, usable, CASE WHEN usable THEN coalesce(n, 0) ELSE 0 END AS total_claims, CASE WHEN usable THEN coalesce(su, 0) ELSE 0 END AS supported_count, CASE WHEN usable THEN coalesce(un, 0) ELSE 0 END AS unsupported_count, CASE WHEN usable THEN coalesce(co, 0) ELSE 0 END AS contradicted_count,
           CASE WHEN usable THEN coalesce(nv, 0) ELSE 0 END AS not_verifiable_count, CASE WHEN usable THEN coalesce(na, 0) ELSE 0 END AS not_applicable_count, CASE WHEN usable THEN coalesce(er, 0) ELSE 0 END AS execution_error_count, CASE WHEN usable THEN coalesce(hs, 0) ELSE 0 END AS hard_safety_count,
           CASE WHEN usable THEN coalesce(families, '') END AS families, CASE WHEN NOT usable THEN why END AS failure_reason FROM o LEFT JOIN a ON a.g = generation_id LEFT JOIN f ON f.g = generation_id""")
def generation_validation(spark, sf_dir):
    """Orders as generations, lines as their claims' results: counts by generation, unusable ones kept with their reasons."""
    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    status = F.when(f == "A", "SUPPORTED").when(f == "R", "CONTRADICTED").when(n == 2, "NOT_VERIFIABLE").when(n == 3, "NOT_APPLICABLE").when(n != 1, "UNSUPPORTED")
    r = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("generation_id"), status.alias("validation_status"), F.when((n == 1) & (f == "N"), "ERROR").otherwise("SUCCESS").alias("execution_status"),
        F.when(n % 4 > 0, F.concat(F.lit("F"), (n % 4).cast("string"))).alias("reason_family"), (F.col("l_tax") > 0.07).alias("hard_safety"),
    )
    why = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("TRUNCATED"))).otherwise(F.array(F.lit("TRUNCATED"), F.lit("PARSE_FAILED")))
    g = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation_id"), (F.col("o_orderstatus") != "P").alias("usable"), why.alias("unusable_reasons"))
    out = summaries.validation_summary(g, r)
    said = F.array_join(F.transform(F.map_entries("families"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.withColumn("families", said)


@query("""
    WITH i AS (SELECT l_orderkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN 'concept' ELSE 'feature' END AS k, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 20 END AS f, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 5 END AS c, l_returnflag <> 'R' AS a, l_tax > 0.06 AS x, l_discount::DOUBLE AS v FROM lineitem),
    g AS (SELECT p, count(*) AS n, count(*) FILTER (k = 'feature') AS fi, count(*) FILTER (k = 'concept') AS ci, count(*) FILTER (a) AS al, count(*) FILTER (x) AS oc, count(DISTINCT f) AS df, count(DISTINCT c) AS dc, sum(v) AS s, max(v) AS m FROM i GROUP BY p)
    SELECT o_orderpriority, count(*) AS packages, round(avg(coalesce(n, 0)), 6) AS mean_items, round(avg(coalesce(fi, 0)), 6) AS mean_feature_items, round(avg(coalesce(ci, 0)), 6) AS mean_concept_items, round(avg(coalesce(al, 0)), 6) AS mean_allowed_items,
           round(avg(coalesce(oc, 0)), 6) AS mean_out_of_contract_items, round(avg(coalesce(df, 0)), 6) AS mean_distinct_features, round(avg(coalesce(dc, 0)), 6) AS mean_distinct_concepts, round(avg(s), 6) AS mean_shap_sum, max(m) AS max_shap FROM orders LEFT JOIN g ON p = o_orderkey GROUP BY 1""")
def evidence_design(spark, sf_dir):
    """Orders as evidence packages, lines as their items: how the packages of each priority are made up."""
    n = F.col("l_linenumber")
    i = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("package_id"), F.when(n % 2 == 0, "concept").otherwise("feature").alias("item_type"), F.when(n % 2 == 1, F.col("l_partkey") % 20).alias("feature_id"), F.when(n % 3 > 0, F.col("l_suppkey") % 5).alias("concept_id"),
        (F.col("l_returnflag") != "R").alias("allowed"), (F.col("l_tax") > 0.06).alias("out_of_contract"), F.col("l_discount").cast("double").alias("abs_shap_value"),
    )
    out = summaries.design_summary(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"), "o_orderpriority"), i, ["o_orderpriority"])
    return rounded(out, {c: 6 for c in out.columns if c.startswith("mean_")})


@query("""
    WITH g AS (SELECT s_nationkey AS model, avg(CASE WHEN s_acctbal > 5000 THEN 1.0 ELSE 0.0 END) AS ap, avg(s_acctbal::DOUBLE) / 10000 AS auc, stddev_samp(s_acctbal::DOUBLE) / 10000 AS brier FROM supplier GROUP BY 1)
    SELECT model, round(ap, 9) AS average_precision, round(auc, 9) AS roc_auc, round(brier, 9) AS brier FROM g ORDER BY round(ap, 9) DESC, round(auc, 9) DESC, round(brier, 9) NULLS LAST, model LIMIT 1""")
def model_choice(spark, sf_dir):
    """Nations as models with three figures from their suppliers: the best by precision, then area, then error."""
    b = F.col("s_acctbal").cast("double")
    m = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.avg(F.when(b > 5000, 1.0).otherwise(0.0)).alias("average_precision"), (F.avg(b) / 10000).alias("roc_auc"), (F.stddev_samp(b) / 10000).alias("brier"))
    return best_model(rounded(m, {"average_precision": 9, "roc_auc": 9, "brier": 9}))


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC NULLS LAST, p_retailprice NULLS LAST, p_partkey LIMIT 3")
def first_three_parts(spark, sf_dir):
    """The three parts that come first by size, then price, then key: a choice by criteria in order."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return ranking.choose(p, [F.desc_nulls_last("p_size"), F.asc_nulls_last("p_retailprice"), F.asc("p_partkey")], 3)


@query("""
    WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT a.p AS first, b.p AS second, a.m - b.m AS effect, ((a.n * b.n) % 20) / 100 AS p_holm FROM g a JOIN g b ON a.p < b.p)
    SELECT first, second, round(CASE WHEN first = '2-HIGH' THEN effect ELSE -effect END, 4) + 0.0 AS oriented, round(p_holm, 6) AS p_holm, CASE WHEN p_holm >= 0.05 OR effect = 0 THEN 'no_difference' WHEN (effect > 0) = (first = '2-HIGH') THEN 'favours' ELSE 'against' END AS verdict
    FROM c WHERE '2-HIGH' IN (first, second)""")
def recommendation_tests(spark, sf_dir):
    """The contrasts in which one priority takes part, turned so that positive favours it."""
    g = t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    a, b = (g.select(F.col("o_orderpriority").alias(k), F.col("m").alias(f"m_{k}"), F.col("n").alias(f"n_{k}")) for k in ("first", "second"))
    c = a.join(b, F.col("first") < F.col("second"))  # five priorities
    c = c.select("first", "second", (F.col("m_first") - F.col("m_second")).alias("effect"), ((F.col("n_first") * F.col("n_second")) % 20 / 100).alias("p_holm"))
    out = decisions.oriented(c, F.lit("2-HIGH"), "first", "second", "effect")
    return rounded(out.select("first", "second", "oriented", "p_holm", "verdict"), {"oriented": 4, "p_holm": 6})


@query("""
    SELECT 'doc_id' AS column_name, false AS binary, 'numeric' AS kind UNION ALL SELECT 'quality', bool_and(coalesce(quality IN (0, 1), false)), 'numeric' FROM labels UNION ALL SELECT 'toxic', bool_and(coalesce(toxic IN (0, 1), false)), 'numeric' FROM labels""")
def column_kinds(spark, sf_dir):
    """Which columns of the labels are numbers, and which of these have no other values than 0 and 1."""
    d = t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    kinds = preparation.kinds(d)
    named = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    return preparation.binary_columns(d, [c for c, k in kinds.items() if k == "numeric"]).withColumn("kind", named[F.col("column_name")])


@query("""
    SELECT c.i AS place, c.n AS column_name, c.k AS data_type, count(*) AS "rows", count(CASE c.i WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN text WHEN 2 THEN lang WHEN 3 THEN source ELSE n_chars::VARCHAR END) AS present
    FROM documents, (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) c(i, n, k) GROUP BY ALL""")
def data_dictionary(spark, sf_dir):
    """The columns of the documents: place, type, and how many rows have a value."""
    return audits.dictionary(t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))
