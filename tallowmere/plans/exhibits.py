"""What texts mention, how stable repeats are, designs of contrasts, and the tables of a release."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.texts import ascii_normal, heavy_prose, technical_terms
from ..operators import matching, reports, statistics
from .registry import query, rounded, t

#: Words of prose that the language check counts.
_PROSE = ("the", "and", "because", "therefore", "with", "from", "this", "that", "shows", "means", "likely")
_PROSE_SQL = ", ".join(f"'{w}'" for w in _PROSE)


@query(f"""
    SELECT doc_id, len([w FOR w IN string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+') IF contains(w, '_') OR regexp_matches(w, '[A-Z]{{2,}}') OR contains(lower(w), 'licen')]) AS technical_terms,
           len([w FOR w IN regexp_extract_all(lower(text), '[a-z]+') IF w IN ({_PROSE_SQL})]) >= 5 AS heavy FROM documents""")
def prose_signals(spark, sf_dir):
    """Technical words of each document, and whether it is mostly English prose."""
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", technical_terms(x, ["licen"]).alias("technical_terms"), heavy_prose(x, _PROSE).alias("heavy"))


@query("""
    WITH d AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents),
    w AS (SELECT doc_id, lang, string_split(n, ' ') AS ws FROM d),
    k AS (SELECT lang, x, count(*) AS k FROM (SELECT lang, unnest(ws) AS x FROM w) WHERE len(x) >= 5 AND lang IS NOT NULL GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, x) AS r FROM k QUALIFY r <= 12),
    o AS (SELECT doc_id, lang, n, [y FOR y IN list_distinct(ws[1:3]) IF y <> ''] AS df, [y FOR y IN list_distinct([left(z, 1) FOR z IN ws[4:5]]) IF y <> ''] AS dc FROM d JOIN w USING (doc_id, lang)),
    f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (m) AS m, count(*) FILTER (m AND r <= 1) AS m1, count(*) FILTER (m AND r <= 3) AS m3, count(*) FILTER (m AND r <= 5) AS m5, list(x) AS xs
          FROM (SELECT doc_id, r, x, list_contains(df, x) OR contains(n, x) AS m FROM o JOIN i USING (lang)) GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (m) AS m, list(q) AS qs FROM (SELECT doc_id, left(x, 1) AS q, bool_or(list_contains(dc, left(x, 1)) OR contains(n, x)) AS m FROM o JOIN i USING (lang) GROUP BY 1, 2) GROUP BY 1)
    SELECT doc_id AS output_id, lang AS package_id, f.n::INT AS selected_features, f.m::INT AS mentioned_features, round(f.m / f.n, 6) AS feature_mention_rate, round(m1 / 1, 6) AS top1_mention_rate, round(m3 / least(f.n, 3), 6) AS top3_mention_rate, round(m5 / least(f.n, 5), 6) AS top5_mention_rate,
           c.n::INT AS exposed_concepts, c.m::INT AS mentioned_concepts, round(c.m / c.n, 6) AS concept_mention_rate, len(df)::INT AS n_declared_features, len(list_intersect(df, xs))::INT AS valid_features, (len(df) - len(list_intersect(df, xs)))::INT AS invalid_features,
           len(dc)::INT AS n_declared_concepts, len(list_intersect(dc, qs))::INT AS valid_concepts, (len(dc) - len(list_intersect(dc, qs)))::INT AS invalid_concepts
    FROM o JOIN f USING (doc_id) JOIN c USING (doc_id)""")
def evidence_mentions(spark, sf_dir):
    """Which of the twelve most frequent long words of its language each document mentions, whole texts; their first letters are the concepts."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", ascii_normal("text").alias("text")).withColumn("ws", F.split("text", " "))
    words = d.where("lang is not null").select("lang", F.explode("ws").alias("x")).where("length(x) >= 5").groupBy("lang", "x").agg(F.count("*").alias("k"))
    top = words.withColumn("item_order", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("k"), "x"))).where("item_order <= 12")
    letter = F.substring("x", 1, 1)
    items = top.select(F.col("lang").alias("package_id"), "item_order", F.col("x").alias("feature_id"), F.array("x").alias("aliases"), letter.alias("concept_id"), F.array("x").alias("concept_aliases"))
    o = d.select(F.col("doc_id").alias("output_id"), F.col("lang").alias("package_id"), "text", F.slice("ws", 1, 3).alias("declared_features"), F.transform(F.slice("ws", 4, 2), lambda z: F.substring(z, 1, 1)).alias("declared_concepts"))
    out = matching.evidence_mentions(o.where("package_id is not null"), items)
    return rounded(out, {c: 6 for c in out.columns if c.endswith("_rate")})


@query("""
    WITH s AS (SELECT conv_id, turn, role = 'assistant' OR role = 'user' AS usable, len(text) > 40 AS valid, list_distinct([w FOR w IN string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') IF w <> '']) AS w FROM conversations),
    x AS (SELECT *, list_distinct([left(y, 1) FOR y IN w]) AS k FROM s),
    j AS (SELECT a.conv_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS f,
                 CASE WHEN len(list_distinct(list_concat(a.k, b.k))) = 0 THEN 1.0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END AS c FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.usable AND b.usable),
    p AS (SELECT conv_id, round(avg(f), 6) AS features_jaccard, round(avg(c), 6) AS concepts_jaccard FROM j GROUP BY 1)
    SELECT conv_id, count(*) AS repeats, count(*) FILTER (usable) AS usable_repeats, round(count(*) FILTER (valid) / count(*), 6) AS schema_stability_rate, round(stddev_pop(len(w)) FILTER (usable), 6) AS length_sd, round(stddev_pop(len(k)) FILTER (usable), 6) AS factors_sd,
           features_jaccard, concepts_jaccard FROM x LEFT JOIN p USING (conv_id) GROUP BY conv_id, features_jaccard, concepts_jaccard""")
def repeat_stability(spark, sf_dir):
    """Turns as repeats of a conversation: their words as features, the words' first letters as concepts."""
    words = F.array_distinct(F.filter(F.split(ascii_normal("text"), " "), lambda w: w != ""))
    c = t(spark, sf_dir, "conversations").withColumn("features", words).withColumn("concepts", F.array_distinct(F.transform("features", lambda w: F.substring(w, 1, 1))))
    c = c.withColumns({"usable": F.col("role").isin("assistant", "user"), "schema_valid": F.length("text") > 40, "length": F.size("features"), "factors": F.size("concepts")})
    return rounded(matching.repeat_stability(c, ["conv_id"], "turn"), dict.fromkeys(["schema_stability_rate", "length_sd", "factors_sd", "features_jaccard", "concepts_jaccard"], 6))


@query("""
    WITH r AS (SELECT * FROM labels), k AS (SELECT unnest(['0', '1']) AS label), m AS (SELECT label, count(*) FILTER (quality::VARCHAR = label AND toxic::VARCHAR = label) AS tp, count(*) FILTER (quality::VARCHAR = label) AS s, count(*) FILTER (toxic::VARCHAR = label) AS p FROM r, k GROUP BY 1),
    f AS (SELECT CASE WHEN s + p > 0 AND tp > 0 THEN 2 * tp / (s + p) ELSE 0 END AS f1 FROM m)
    SELECT round((SELECT avg(f1) FROM f), 6) AS macro_f1, round(count(*) FILTER (quality <> 1 AND toxic = 1) / count(*) FILTER (quality <> 1), 6) AS false_accept_rate, round(count(*) FILTER (quality = 1 AND toxic <> 1) / count(*) FILTER (quality = 1), 6) AS false_reject_rate FROM r""")
def classification_summary(spark, sf_dir):
    """How far one label agrees with the other, as if it judged it."""
    return rounded(statistics.class_summary(t(spark, sf_dir, "labels"), "quality", "toxic", ["0", "1"], "1"), {"macro_f1": 6, "false_accept_rate": 6, "false_reject_rate": 6})


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""
    WITH f AS (SELECT c_nationkey AS c, c_mktsegment AS m, o_orderpriority AS e, floor(avg(o_totalprice) / 100)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    m AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY']) AS m), e AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS e),
    k AS (SELECT 'model_within_level' AS family, a.m AS m1, e AS e1, b.m AS m2, e AS e2 FROM m a JOIN m b ON a.m < b.m, e UNION ALL SELECT 'level_against_baseline', m, e, m, '5-LOW' FROM m, e WHERE e <> '5-LOW'),
    d AS (SELECT k.*, a.y - b.y AS d FROM k LEFT JOIN f a ON a.m = m1 AND a.e = e1 LEFT JOIN f b ON b.m = m2 AND b.e = e2 AND a.c = b.c)
    SELECT m1 || '|' || e1 || ' - ' || m2 || '|' || e2 AS contrast_id, family, (SELECT count(DISTINCT c) FROM f) AS planned_pairs, count(d) AS pairs, round(avg(d), 6) + 0.0 AS mean_difference, round(quantile_cont(d, 0.5), 4) + 0.0 AS median_difference,
           round(stddev_samp(d), 6) AS sd_difference, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero FROM d GROUP BY m1, e1, m2, e2, family""")
def planned_contrasts(spark, sf_dir):
    """A design of three segments and five priorities over the nations: segments within a priority, priorities against the lowest."""
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = j.groupBy("c_nationkey", "c_mktsegment", "o_orderpriority").agg(F.floor(F.avg("o_totalprice") / 100).cast("double").alias("y"))
    s = statistics.planned_summary(f, "c_nationkey", "c_mktsegment", "o_orderpriority", "y", statistics.planned_contrasts(spark, _SEGMENTS, _PRIORITIES, "5-LOW"))
    return rounded(s.drop("first", "second"), {"mean_difference": 6, "median_difference": 4, "sd_difference": 6})


@query("""
    WITH o AS (SELECT c_mktsegment AS model, o_orderpriority AS level, count(*) AS planned, count(*) FILTER (o_orderstatus <> 'P') AS usable, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT model, level, planned, usable, round(usable / planned, 6) AS usability_rate, mean_price, 'option::' || model || '::' || level || '::mean' AS report_number_id FROM o""")
def option_exhibit(spark, sf_dir):
    """Each option's row of a release, its mean held against the number that is certified for it; another number would fail the query."""
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = lambda m, e: F.concat(F.lit("option::"), m, F.lit("::"), e, F.lit("::mean"))
    o = j.groupBy(F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("planned"), F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("usable"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    again = j.groupBy(number(F.col("c_mktsegment"), F.col("o_orderpriority")).alias("report_number_id")).agg((F.sum("o_totalprice") / F.count("*")).alias("value"))
    out = reports.reconciled(o.withColumn("usability_rate", ratio(F.col("usable"), F.col("planned"))), again, number(F.col("model"), F.col("level")), "mean_price", 1e-4)
    return rounded(out, {"usability_rate": 6})


@query("""
    WITH f AS (SELECT year(o_orderdate) AS y, o_orderpriority AS effect, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1, 2),
    z AS (SELECT y, effect, round((m - 250000) / (s / sqrt(n)), 6) AS statistic, abs(round((m - 250000) / (s / sqrt(n)), 6)) > 1.96 AS significant FROM f WHERE n > 1)
    SELECT effect, a.statistic AS earlier_statistic, a.significant AS earlier_significant, b.statistic AS later_statistic, b.significant AS later_significant, a.significant AND b.significant AS both_significant FROM z a JOIN z b USING (effect) WHERE a.y = 1996 AND b.y = 1997""")
def cross_effects(spark, sf_dir):
    """The effects that two years of orders have in common, side by side."""
    f = t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("effect")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    z = f.where("n > 1").withColumn("statistic", F.round((F.col("m") - 250000) / (F.col("s") / F.sqrt("n")), 6)).withColumn("significant", F.abs("statistic") > 1.96)
    return reports.across(z.where("y = 1996"), z.where("y = 1997"), "effect", ["statistic", "significant"], ("earlier", "later"), "significant")


@query("""
    SELECT l_orderkey, count(*) AS generations, count(*) FILTER (l_returnflag <> 'R') AS usable_generations, coalesce(sum(CASE WHEN l_discount > 0 THEN l_linenumber END), 0)::BIGINT AS claims, count(*) = count(*) FILTER (l_returnflag <> 'R') AS complete_case FROM lineitem GROUP BY 1""")
def case_index(spark, sf_dir):
    """Orders as cases, their items as generations."""
    return reports.case_index(t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") != "R", F.when(F.col("l_discount") > 0, F.col("l_linenumber")))
