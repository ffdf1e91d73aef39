"""Claims made final, their meanings by rules, and payloads of unknown quality."""

from pyspark.sql import functions as F

from ..operators import finalization as fin
from ..operators import payloads
from .registry import query, t

_TYPES = "prediction feature_presence feature_direction concept_presence concept_direction numeric ranking magnitude uncertainty distributed_evidence recommendation causal limitation".split()
_SECTIONS = "prediction_summary factor_name factor_explanation uncertainty_note distributed_evidence_note safe_summary".split()
_SUBJECTS = "prediction feature feature concept concept evidence narrative none".split()
#: What claims say besides their numbers: wordings of the rules, and others.
_PHRASES = (
    "Nguy cơ cao, trên ngưỡng", "Xác suất là", "Rủi ro thấp", "so với các yếu tố khác", "mức độ tổng thể cân bằng", "không phải quan hệ nhân quả", "Không chắc chắn về kết quả", "no guarantee",
    "model prediction", "thông tin hiện có", "độ tin cậy", "có thể xảy ra", "hai chiều", "phân bố SHAP", "nhóm khái niệm", "các yếu tố", "tổng hợp lại", "human review", "xác minh thêm", "cần cân nhắc",
    "phê duyệt khoản vay", "not financial advice", "không phải cơ sở duy nhất", "chưa đầy đủ", "nothing of note", "mạnh hơn",
)

#: The rules by which a claim's type and wording give its subtype, in their order.
PROBABILITY = r"\d+([.,]\d+)?\s*%|(\bxac suat\b|\bprobabilit)[^\d]{0,20}\d"
LABELS = ("rui ro cao", "rui ro thap", "nguy co cao", "nguy co thap", "vo no", "khong gap kho khan")
NON_CAUSAL = ("khong phai quan he nhan qua", "khong phan anh quan he nhan qua", "khong chung minh quan he nhan qua", "khong dong nghia voi nguyen nhan", "khong phai nguyen nhan thuc te", "not causal")
NOT_CERTAIN = ("khong chac chan", "khong the chac chan", "mo hinh co the sai", "mo hinh khong the dam bao")
RULES = (
    ("prediction", None, ("nguong", "threshold", "cutoff"), "prediction", "THRESHOLD_COMPARISON"),
    ("prediction", "says_label", PROBABILITY, "prediction", "OVERALL_PREDICTION_SUMMARY"),
    ("prediction", None, PROBABILITY, "prediction", "OVERALL_PROBABILITY"),
    ("prediction", None, LABELS, "prediction", "OVERALL_LABEL"),
    ("prediction", None, None, "prediction", "UNRESOLVED_PREDICTION"),
    ("feature_presence", None, None, "feature_presence", "FEATURE_MENTION"),
    ("feature_direction", None, None, "feature_direction", "FEATURE_RISK_DIRECTION"),
    ("concept_presence", None, None, "concept_presence", "CONCEPT_MENTION"),
    ("concept_direction", None, None, "concept_direction", "CONCEPT_RISK_DIRECTION"),
    ("magnitude", "feature", None, "magnitude", "FEATURE_STRENGTH"),
    ("magnitude", "concept", None, "magnitude", "CONCEPT_STRENGTH"),
    ("magnitude", None, ("so voi", "manh hon", "yeu hon", "manh nhat", "yeu nhat"), "magnitude", "COMPARATIVE_STRENGTH"),
    ("magnitude", None, ("can bang", "tong the", "khong yeu to nao noi troi", "muc do dong gop tuong doi"), "magnitude", "OVERALL_BALANCE"),
    ("magnitude", None, None, "magnitude", "UNRESOLVED_MAGNITUDE"),
    ("ranking", "concept", None, "ranking", "CONCEPT_RANK"),
    ("ranking", None, None, "ranking", "FEATURE_RANK"),
    ("numeric", "role_score", None, "numeric", "PREDICTION_SCORE"),
    ("numeric", "role_threshold", None, "numeric", "DECISION_THRESHOLD"),
    ("numeric", "role_value_of_concept", None, "numeric", "CONCEPT_VALUE"),
    ("numeric", "role_value", None, "numeric", "FEATURE_VALUE"),
    ("numeric", "role_rank", None, "numeric", "RANK_VALUE"),
    ("numeric", "role_count", None, "numeric", "EVIDENCE_COUNT"),
    ("numeric", None, None, "numeric", "OTHER_NUMERIC"),
    ("causal", None, None, "causal", "CAUSAL_ATTRIBUTION"),
    ("uncertainty", None, NON_CAUSAL, "limitation", "NON_CAUSAL"),
    ("uncertainty", None, NOT_CERTAIN, "limitation", "MODEL_NOT_CERTAIN"),
    ("uncertainty", None, ("khong dam bao", "khong bao dam", "no guarantee"), "uncertainty", "NO_GUARANTEE"),
    ("uncertainty", None, ("khong phai ket qua thuc te", "khong phan anh ket qua thuc te", "du doan cua mo hinh", "model prediction"), "uncertainty", "MODEL_PREDICTION_NOT_OUTCOME"),
    ("uncertainty", None, ("bang chung", "du lieu duoc cung cap", "thong tin hien co", "cac yeu to duoc chon", "chi phan anh mot phan"), "uncertainty", "EVIDENCE_SCOPE_UNCERTAINTY"),
    ("uncertainty", None, ("do tin cay", "muc do chac chan", "confidence"), "uncertainty", "CONFIDENCE_STRENGTH"),
    ("uncertainty", None, ("co the", "kha nang", "xac suat", "du kien", "khong nhat thiet"), "uncertainty", "PROBABILITY_HEDGE"),
    ("uncertainty", None, None, "uncertainty", "UNRESOLVED_UNCERTAINTY"),
    ("distributed_evidence", "mixed", None, "distributed_evidence", "MIXED_DIRECTIONS"),
    ("distributed_evidence", None, ("hai chieu", "trai chieu", "tang va giam"), "distributed_evidence", "MIXED_DIRECTIONS"),
    ("distributed_evidence", None, ("shap", "phan bo", "tong do lon"), "distributed_evidence", "DISTRIBUTED_SHAP_MASS"),
    ("distributed_evidence", None, ("nhom khai niem", "khai niem", "concept"), "distributed_evidence", "MULTIPLE_CONCEPTS"),
    ("distributed_evidence", None, ("dac trung", "tin hieu", "yeu to", "features"), "distributed_evidence", "MULTIPLE_FEATURES"),
    ("distributed_evidence", None, ("tong hop", "ket hop cac phan", "xuyen suot cac phan"), "distributed_evidence", "CROSS_SECTION_SYNTHESIS"),
    ("distributed_evidence", None, None, "distributed_evidence", "UNRESOLVED_DISTRIBUTED_EVIDENCE"),
    ("recommendation", None, ("xem xet boi con nguoi", "chuyen gia", "human review", "tham dinh them", "kiem tra thu cong"), "recommendation", "HUMAN_REVIEW"),
    ("recommendation", None, ("them thong tin", "bo sung thong tin", "xac minh them", "thu thap them", "doi chieu them"), "recommendation", "REQUEST_MORE_INFORMATION"),
    ("recommendation", None, ("than trong", "khong nen chi", "khong nen su dung", "khong nen dung", "khong su dung don le", "can ket hop", "chi nen tham khao", "can can nhac"), "recommendation", "CAUTION_IN_DECISION_USE"),
    ("recommendation", None, ("phe duyet khoan vay", "tu choi khoan vay", "cap tin dung", "khong cap tin dung", "giai ngan", "tang han muc", "giam han muc"), "recommendation", "PRESCRIPTIVE_FINANCIAL_ACTION"),
    ("recommendation", None, None, "recommendation", "UNRESOLVED_RECOMMENDATION"),
    ("limitation", None, NON_CAUSAL, "limitation", "NON_CAUSAL"),
    ("limitation", None, ("khong phai tu van tai chinh", "khong phai loi khuyen tai chinh", "khong phai khuyen nghi tai chinh", "not financial advice"), "limitation", "NOT_FINANCIAL_ADVICE"),
    ("limitation", None, ("khong nen la co so duy nhat", "khong nen la can cu duy nhat", "khong duoc dung lam can cu duy nhat", "khong phai co so duy nhat", "khong phai can cu duy nhat", "quyet dinh duy nhat", "khong the thay the tham dinh"), "limitation", "NOT_SOLE_DECISION_BASIS"),
    ("limitation", None, ("khong day du", "chua day du", "han che bang chung", "chi dua tren", "chi phan anh mot phan", "khong bao gom tat ca", "cac yeu to duoc chon"), "limitation", "INCOMPLETE_EVIDENCE"),
    ("limitation", None, NOT_CERTAIN, "limitation", "MODEL_NOT_CERTAIN"),
    ("limitation", None, None, "limitation", "UNRESOLVED_LIMITATION"),
)
#: Type, subtype, sections, required fields, forbidden fields, subjects.
ALLOWED = (
    ("prediction", "OVERALL_LABEL", "prediction_summary safe_summary", "claim_subtype direction", "feature_id concept_id", "prediction"),
    ("prediction", "OVERALL_PROBABILITY", "prediction_summary uncertainty_note safe_summary", "claim_subtype numeric_value", "feature_id concept_id", "prediction"),
    ("prediction", "THRESHOLD_COMPARISON", "prediction_summary safe_summary", "claim_subtype direction", "feature_id concept_id", "prediction"),
    ("prediction", "OVERALL_PREDICTION_SUMMARY", "prediction_summary uncertainty_note safe_summary", "claim_subtype direction", "feature_id concept_id", "prediction"),
    ("prediction", "UNRESOLVED_PREDICTION", "prediction_summary uncertainty_note safe_summary", "claim_subtype", "feature_id concept_id", "prediction narrative none"),
    ("feature_presence", "FEATURE_MENTION", "factor_name factor_explanation safe_summary", "claim_subtype feature_id", "concept_id numeric_value", "feature"),
    ("feature_direction", "FEATURE_RISK_DIRECTION", "factor_name factor_explanation safe_summary", "claim_subtype feature_id direction", "concept_id numeric_value", "feature"),
    ("concept_presence", "CONCEPT_MENTION", "factor_name factor_explanation safe_summary", "claim_subtype concept_id", "feature_id numeric_value", "concept"),
    ("concept_direction", "CONCEPT_RISK_DIRECTION", "factor_name factor_explanation safe_summary", "claim_subtype concept_id direction", "feature_id numeric_value", "concept"),
    ("magnitude", "FEATURE_STRENGTH", "factor_explanation safe_summary", "claim_subtype feature_id magnitude", "concept_id numeric_value", "feature"),
    ("magnitude", "CONCEPT_STRENGTH", "factor_explanation distributed_evidence_note safe_summary", "claim_subtype concept_id magnitude", "feature_id numeric_value", "concept"),
    ("magnitude", "COMPARATIVE_STRENGTH", "factor_explanation distributed_evidence_note safe_summary", "claim_subtype magnitude", "numeric_value", "feature concept evidence narrative"),
    ("magnitude", "OVERALL_BALANCE", "factor_explanation distributed_evidence_note safe_summary", "claim_subtype magnitude", "feature_id concept_id numeric_value", "evidence narrative"),
    ("ranking", "FEATURE_RANK", "factor_name factor_explanation safe_summary", "claim_subtype", "concept_id", "feature"),
    ("ranking", "CONCEPT_RANK", "prediction_summary factor_name factor_explanation safe_summary", "claim_subtype concept_id", "feature_id", "concept"),
    ("numeric", "PREDICTION_SCORE", "prediction_summary uncertainty_note safe_summary", "claim_subtype numeric_value", "feature_id concept_id", "prediction"),
    ("numeric", "FEATURE_VALUE", "factor_name factor_explanation safe_summary", "claim_subtype numeric_value feature_id", "concept_id", "feature"),
    ("numeric", "RANK_VALUE", "factor_name factor_explanation safe_summary", "claim_subtype numeric_value", "concept_id", "feature evidence"),
    ("numeric", "EVIDENCE_COUNT", "prediction_summary factor_name factor_explanation uncertainty_note distributed_evidence_note safe_summary", "claim_subtype numeric_value", "", "evidence narrative"),
    ("causal", "CAUSAL_ATTRIBUTION", "factor_explanation safe_summary", "claim_subtype causal_strength", "numeric_value", "feature concept evidence narrative"),
    ("uncertainty", "NO_GUARANTEE", "uncertainty_note safe_summary", "claim_subtype", "feature_id concept_id numeric_value", "prediction evidence narrative none"),
    ("distributed_evidence", "MULTIPLE_FEATURES", "prediction_summary factor_explanation distributed_evidence_note safe_summary", "claim_subtype", "numeric_value", "evidence narrative"),
    ("distributed_evidence", "MIXED_DIRECTIONS", "factor_explanation distributed_evidence_note safe_summary", "claim_subtype direction", "numeric_value", "evidence narrative"),
    ("recommendation", "HUMAN_REVIEW", "uncertainty_note safe_summary", "claim_subtype", "feature_id concept_id numeric_value", "narrative none"),
    ("limitation", "NON_CAUSAL", "prediction_summary factor_explanation uncertainty_note safe_summary", "claim_subtype", "numeric_value", "feature concept evidence narrative none"),
    ("limitation", "NOT_FINANCIAL_ADVICE", "uncertainty_note safe_summary", "claim_subtype", "feature_id concept_id numeric_value", "narrative none"),
)
_FIELDS = ("claim_subtype", "direction", "magnitude", "causal_strength", "feature_id", "concept_id", "numeric_value")


def needs():
    """The conditions that rules name."""
    role = F.col("numeric_role")
    return {
        "says_label": fin.plain(F.col("source_text")).rlike("|".join(LABELS)), "feature": F.coalesce("feature_id", F.lit("")) != "", "concept": F.coalesce("concept_id", F.lit("")) != "",
        "mixed": F.col("direction") == "mixed", "role_score": role == "prediction_score", "role_threshold": role == "decision_threshold", "role_rank": role == "rank",
        "role_value": role == "feature_value", "role_value_of_concept": (role == "feature_value") & (F.coalesce("concept_id", F.lit("")) != ""), "role_count": (role == "other") & (F.col("numeric_unit") == "count"),
    }


def _pick(items, at):
    return F.get(F.array(*map(F.lit, items)), at.cast("int"))


#: Of how many lines a task makes final claims.
_LINES = 250_000


def _claims(spark, sf_dir, dealt=False):
    """Lines as claims of an order's text, which has a section for each line.

    ``dealt``: lines are dealt by order as they are, before they become claims, which are several times as long.
    """
    lines = t(spark, sf_dir, "lineitem").withColumn("generation_id", F.col("l_orderkey").cast("string"))
    if dealt:
        # Spark sizes tasks by the short lines, but what is made of them is sorted: it must fit a task's memory
        lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // _LINES)), "generation_id")
    n, k, s, q = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    whole = F.floor(price).cast("long")
    grouped = F.when(whole >= 1000, F.concat((whole / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    share = (F.col("l_discount").cast("decimal(15,2)") * 100).cast("int")
    tail = (
        F.when(s % 4 == 0, F.concat(F.lit(" "), q.cast("string"), F.lit(" features and "), n.cast("string"), F.lit(" concept groups.")))
        .when(s % 4 == 1, F.concat(F.lit(" worth "), grouped))
        .when(s % 4 == 2, F.concat(F.lit(" "), share.cast("string"), F.lit(" %")))
        .otherwise(F.concat(F.lit(" "), q.cast("string"), F.lit(" features")))
    )
    value = F.when(k % 3 == 0, F.when(s % 4 == 1, whole).when(s % 4 == 2, share).otherwise(q)).cast("double")
    section = _pick(_SECTIONS, (k + s) % 6)
    c = lines.select(
        "generation_id", F.concat_ws("-", "generation_id", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), n.cast("long").alias("local_claim_index"),
        section.alias("source_section"), F.when(F.startswith(section, F.lit("factor")), F.concat(F.lit("f"), (k % 7).cast("string"))).alias("source_factor_id"), F.concat(_pick(_PHRASES, (k + n) % len(_PHRASES)), tail).alias("source_text"),
        ((((n.cast("long") * 100_000 + k) * 10_000 + s) * 100 + q) * 100).cast("long").alias("source_span_start"), _pick(_TYPES, k % 13).alias("claim_type"), _pick(_SUBJECTS, (k + n) % 8).alias("subject_type"),
        F.when(k % 4 < 2, F.concat(F.lit("p"), (k % 50).cast("string"))).alias("feature_id"), F.when(k % 4 == 2, F.concat(F.lit("b"), (k % 25).cast("string"))).alias("concept_id"),
        F.when(n % 3 == 0, "mixed").when(F.col("l_linestatus") == "O", "increase_risk").otherwise("decrease_risk").alias("direction"), F.when(n % 2 == 0, "strong").alias("magnitude"),
        F.when(n % 2 == 0, "causal").otherwise("associational").alias("causal_strength"), value.alias("numeric_value"), F.when(value.isNotNull(), _pick(["count", "currency", "percent", "count"], s % 4)).alias("numeric_unit"),
        F.when(value.isNotNull() & (n % 2 == 1), _pick(["other", "feature_value", "prediction_score", "rank"], s % 4)).alias("numeric_role"), F.lit("model").alias("claim_origin"), F.lit(None).cast("string").alias("target"),
    )
    c = c.withColumn("source_span_end", F.col("source_span_start") + F.length("source_text"))
    return c.select(*fin.CLAIM)


def _list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_SOURCE = f"""
    b AS (SELECT *, row_number() OVER () AS r, floor(l_extendedprice::DECIMAL(15,2))::BIGINT AS whole, (l_discount::DECIMAL(15,2) * 100)::INT AS share, l_quantity::INT AS q, {_list(_SECTIONS)}[(l_partkey + l_suppkey) % 6 + 1] AS section FROM lineitem),
    c0 AS (SELECT r, l_orderkey::VARCHAR AS generation_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, l_linenumber::BIGINT AS local_claim_index, section AS source_section,
        CASE WHEN starts_with(section, 'factor') THEN 'f' || l_partkey % 7 END AS source_factor_id,
        {_list(_PHRASES)}[(l_partkey + l_linenumber) % {len(_PHRASES)} + 1] || CASE l_suppkey % 4 WHEN 0 THEN ' ' || q || ' features and ' || l_linenumber || ' concept groups.'
            WHEN 1 THEN ' worth ' || CASE WHEN whole >= 1000 THEN (whole // 1000)::VARCHAR || ',' || lpad((whole % 1000)::VARCHAR, 3, '0') ELSE whole::VARCHAR END WHEN 2 THEN ' ' || share || ' %' ELSE ' ' || q || ' features' END AS source_text,
        (((l_linenumber::BIGINT * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + q) * 100 AS source_span_start, {_list(_TYPES)}[l_partkey % 13 + 1] AS claim_type, {_list(_SUBJECTS)}[(l_partkey + l_linenumber) % 8 + 1] AS subject_type,
        CASE WHEN l_partkey % 4 < 2 THEN 'p' || l_partkey % 50 END AS feature_id, CASE WHEN l_partkey % 4 = 2 THEN 'b' || l_partkey % 25 END AS concept_id,
        CASE WHEN l_linenumber % 3 = 0 THEN 'mixed' WHEN l_linestatus = 'O' THEN 'increase_risk' ELSE 'decrease_risk' END AS direction, CASE WHEN l_linenumber % 2 = 0 THEN 'strong' END AS magnitude,
        CASE WHEN l_linenumber % 2 = 0 THEN 'causal' ELSE 'associational' END AS causal_strength, (CASE WHEN l_partkey % 3 = 0 THEN CASE l_suppkey % 4 WHEN 1 THEN whole WHEN 2 THEN share ELSE q END END)::DOUBLE AS numeric_value,
        CASE WHEN numeric_value IS NOT NULL THEN ['count', 'currency', 'percent', 'count'][l_suppkey % 4 + 1] END AS numeric_unit,
        CASE WHEN numeric_value IS NOT NULL AND l_linenumber % 2 = 1 THEN ['other', 'feature_value', 'prediction_score', 'rank'][l_suppkey % 4 + 1] END AS numeric_role, 'model' AS claim_origin, NULL::VARCHAR AS target,
        source_span_start + length(source_text) AS source_span_end FROM b),
"""
_PLAIN = f"regexp_replace(translate(lower({{}}), '{fin._FROM}', '{fin._TO}'), '\\s+', ' ', 'g')"
_NEEDS = {
    None: "true", "says_label": "len(list_filter(" + _list(LABELS) + ", lambda w: contains(text, w))) > 0", "feature": "feature_id IS NOT NULL", "concept": "concept_id IS NOT NULL", "mixed": "direction = 'mixed'",
    "role_score": "numeric_role = 'prediction_score'", "role_threshold": "numeric_role = 'decision_threshold'", "role_rank": "numeric_role = 'rank'", "role_value": "numeric_role = 'feature_value'",
    "role_value_of_concept": "numeric_role = 'feature_value' AND concept_id IS NOT NULL", "role_count": "numeric_role = 'other' AND numeric_unit = 'count'",
}


def _rules_sql():
    rows = []
    for i, (kind, need, words, final, sub) in enumerate(RULES, 1):
        pattern = "" if words is None else words if isinstance(words, str) else "|".join(words)
        rows.append(f"({i}, '{kind}', '{need or ''}', '{pattern}', '{final}', '{sub}')")
    met = " ".join(f"WHEN '{k or ''}' THEN {v}" for k, v in _NEEDS.items())
    return ", ".join(rows), met


_ROWS, _MET = _rules_sql()
_CLASSED = "WITH " + _SOURCE + f"""
    rules(rule_id, kind, need, pattern, final_type, claim_subtype) AS (VALUES {_ROWS}),
    x AS (SELECT *, {_PLAIN.format("source_text")} AS text FROM c0),
    k AS (SELECT x.*, rule_id, final_type, claim_subtype FROM x JOIN rules ON kind = claim_type AND (pattern = '' OR regexp_matches(text, pattern)) AND coalesce(CASE need {_MET} END, false)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY rule_id) = 1)"""


@query(_CLASSED + " SELECT claim_id, rule_id, final_type, claim_subtype FROM k")
def claim_subtypes(spark, sf_dir):
    """Every line as a claim, and the first of fifty rules that tells what it means."""
    return fin.classified(_claims(spark, sf_dir), RULES, needs()).select("claim_id", "rule_id", "final_type", "claim_subtype")


@query(_CLASSED + f""",
    allowed(final_type, claim_subtype, sections, required, forbidden, subjects) AS (VALUES {", ".join(str(r) for r in ALLOWED)}),
    j AS (SELECT k.*, sections, required, forbidden, subjects FROM k LEFT JOIN allowed USING (final_type, claim_subtype)),
    f AS (SELECT claim_id, required, forbidden, unnest([{", ".join(f"{{'field': '{x}', 'there': {x} IS NOT NULL}}" for x in _FIELDS)}], recursive := true) FROM j WHERE sections IS NOT NULL)
    SELECT claim_id, 'NO_RULE' AS code, 'claim_subtype' AS field FROM j WHERE sections IS NULL
    UNION ALL SELECT claim_id, 'SECTION', 'source_section' FROM j WHERE NOT list_contains(string_split(sections, ' '), source_section)
    UNION ALL SELECT claim_id, 'SUBJECT', 'subject_type' FROM j WHERE NOT list_contains(string_split(subjects, ' '), subject_type)
    UNION ALL SELECT claim_id, 'REQUIRED', field FROM f WHERE NOT there AND list_contains(string_split(required, ' '), field)
    UNION ALL SELECT claim_id, 'FORBIDDEN', field FROM f WHERE there AND list_contains(string_split(forbidden, ' '), field)""")
def incompatible_claims(spark, sf_dir):
    """What the meanings of the claims don't allow: sections, subjects, missing and forbidden fields."""
    return fin.incompatible(fin.classified(_claims(spark, sf_dir), RULES, needs()), ALLOWED, _FIELDS)


_N = r"[+-]?\d+(?:[.,]\d+)*(?:\s*%)?"
_FACT = r"(?i)(\d+)\s+(features?|concept\s+groups?)(?:\s|[.,;:)]|$)"
_NUM = r"""CASE WHEN regexp_matches({0}, '^[+-]?[1-9]\d{{0,2}}(,\d{{3}})+(\.\d+)?$') THEN replace({0}, ',', '')
    WHEN regexp_matches({0}, '^[+-]?[1-9]\d{{0,2}}(\.\d{{3}})+(,\d+)?$') THEN replace(replace({0}, '.', ''), ',', '.')
    WHEN regexp_matches({0}, '^[+-]?\d+,\d+$') THEN replace({0}, ',', '.') WHEN regexp_matches({0}, '^[+-]?\d+(\.\d+)?$') THEN {0} END"""
_ORDER = "generation_id, local_claim_index, source_section, source_factor_id, source_text, source_span_start, source_span_end, claim_type, subject_type, feature_id, concept_id, direction, magnitude, causal_strength, numeric_value, numeric_unit, numeric_role, claim_origin, target"


@query("WITH " + _SOURCE + f"""
    c1 AS (SELECT *, regexp_extract_all(source_text, '{_N}') AS found, regexp_split_to_array(source_text, '{_N}') AS parts FROM c0),
    c2 AS (SELECT *, CASE WHEN numeric_value IS NOT NULL THEN list_position(list_transform(list_transform(found, lambda x: regexp_replace(x, '[%\\s]', '', 'g')), lambda z: abs(try_cast({_NUM.format("z")} AS DOUBLE) - numeric_value) <= 1e-9), true) END AS hit FROM c1),
    c3 AS (SELECT *, found[hit] AS at_text, (list_sum(list_transform(parts[:hit], lambda p: length(p))) + coalesce(list_sum(list_transform(found[:hit - 1], lambda p: length(p))), 0))::BIGINT AS ahead FROM c2),
    s AS (
        SELECT generation_id, local_claim_index, source_section, source_factor_id, source_text, source_span_start, source_span_end, claim_type, subject_type, feature_id, concept_id, direction, magnitude, causal_strength,
               NULL::DOUBLE AS numeric_value, NULL AS numeric_unit, NULL AS numeric_role, claim_origin, target, CASE WHEN numeric_value IS NOT NULL THEN ['NUMBER_SPLIT_OFF'] ELSE []::VARCHAR[] END AS rules FROM c3 WHERE claim_type <> 'numeric'
        UNION ALL
        SELECT generation_id, CASE claim_type WHEN 'numeric' THEN local_claim_index ELSE 0 END, source_section, source_factor_id, coalesce(at_text, source_text), source_span_start + coalesce(ahead, 0), CASE WHEN hit > 0 THEN source_span_start + ahead + length(at_text) ELSE source_span_end END,
               'numeric', subject_type, feature_id, concept_id, CASE claim_type WHEN 'numeric' THEN direction ELSE 'unknown' END, CASE claim_type WHEN 'numeric' THEN magnitude END, CASE claim_type WHEN 'numeric' THEN causal_strength ELSE 'none' END,
               numeric_value, numeric_unit, CASE WHEN claim_type = 'numeric' THEN numeric_role ELSE coalesce(numeric_role, CASE WHEN claim_type = 'ranking' THEN 'rank' WHEN subject_type = 'prediction' THEN 'prediction_score' WHEN subject_type = 'feature' THEN 'feature_value' ELSE 'other' END) END,
               CASE claim_type WHEN 'numeric' THEN claim_origin ELSE 'derived_numeric' END, target,
               CASE WHEN claim_type <> 'numeric' THEN ['DERIVED_NUMERIC'] WHEN hit > 0 AND (at_text <> source_text OR ahead <> 0) THEN ['MINIMIZE_NUMERIC_SOURCE'] ELSE []::VARCHAR[] END FROM c3 WHERE claim_type = 'numeric' OR numeric_value IS NOT NULL),
    f0 AS (SELECT generation_id, source_section, source_factor_id, source_span_start AS start, regexp_split_to_array(source_text, '{_FACT}') AS parts, regexp_extract_all(source_text, '{_FACT}', 0) AS whole, regexp_extract_all(source_text, '{_FACT}', 1) AS digits, regexp_extract_all(source_text, '{_FACT}', 2) AS noun FROM c0),
    f1 AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f0 WHERE len(whole) > 0),
    facts AS (SELECT generation_id, source_section AS f_section, source_factor_id AS f_factor, digits[i] AS f_text, digits[i]::DOUBLE AS value,
                     CASE WHEN starts_with(noun[i], 'concept') THEN 'concept_group_count' WHEN source_section = 'factor_explanation' AND source_factor_id IS NOT NULL THEN 'factor_member_count:' || source_factor_id ELSE 'selected_evidence_count' END AS f_target,
                     (start + list_sum(list_transform(parts[:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda p: length(p))), 0))::BIGINT AS f_start, f_start + length(digits[i]) AS f_end
              FROM f1 QUALIFY row_number() OVER (PARTITION BY generation_id, f_target, value ORDER BY f_start, f_section) = 1),
    stated AS (SELECT s.*, f_section, f_factor, f_text, f_target, f_start, f_end, value FROM s LEFT JOIN facts f ON s.claim_type = 'numeric' AND f.generation_id = s.generation_id AND f.value = s.numeric_value AND f_start = source_span_start AND f_end = source_span_end),
    missing AS (SELECT f.* FROM facts f ANTI JOIN stated USING (generation_id, f_target, value)),
    model AS (SELECT m.*, s.rules, s.source_span_start AS place, s.local_claim_index AS n FROM missing m JOIN s ON s.generation_id = m.generation_id
              QUALIFY row_number() OVER (PARTITION BY m.generation_id, f_target, value ORDER BY CASE WHEN NOT (s.source_section = f_section AND s.source_factor_id IS NOT DISTINCT FROM f_factor) THEN 2 WHEN s.source_span_start <= f_start AND s.source_span_end >= f_end THEN 0 ELSE 1 END, place, n) = 1),
    a AS (
        SELECT {_ORDER}, rules FROM stated WHERE f_start IS NULL
        UNION ALL SELECT generation_id, 0, f_section, f_factor, f_text, f_start, f_end, 'numeric', 'evidence', NULL, NULL, 'unknown', NULL, 'none', value, 'count', 'other', 'derived_numeric', f_target, list_distinct(rules || ['COUNT_FACT_CANONICALIZATION']) FROM stated WHERE f_start IS NOT NULL
        UNION ALL SELECT generation_id, 0, f_section, f_factor, f_text, f_start, f_end, 'numeric', 'evidence', NULL, NULL, 'unknown', NULL, 'none', value, 'count', 'other', 'derived_numeric', f_target, list_distinct(rules || ['COUNT_FACT_ADDED']) FROM model),
    g AS (SELECT *, claim_type || '|feature:' || coalesce(lower(feature_id), 'none') || '|concept:' || coalesce(lower(concept_id), 'none') || '|' || CASE
            WHEN claim_type = 'numeric' THEN 'role:' || coalesce(numeric_role, 'none') || '|value:' || coalesce(numeric_value::DECIMAL(30,6)::VARCHAR, 'none') || '|unit:' || coalesce(numeric_unit, 'none') || '|target:' || coalesce(target, 'none')
            WHEN claim_type IN ('feature_direction', 'concept_direction', 'prediction') THEN 'direction:' || direction WHEN claim_type = 'magnitude' THEN 'magnitude:' || coalesce(magnitude, 'none')
            WHEN claim_type = 'causal' THEN 'causal:' || causal_strength WHEN claim_type IN ('feature_presence', 'concept_presence', 'ranking') THEN '-' ELSE 'text:' || {_PLAIN.format("source_text")} END AS semantic_signature FROM a),
    u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY generation_id, semantic_signature ORDER BY source_span_start, source_span_end, local_claim_index) = 1)
    SELECT generation_id, sha256(generation_id || '|' || replace(replace(semantic_signature, '\\', '\\\\'), '|', '\\|')) AS claim_id,
           row_number() OVER (PARTITION BY generation_id ORDER BY source_span_start, source_span_end, semantic_signature) AS local_claim_index, source_section, source_factor_id, source_text, source_span_start, source_span_end, claim_type, subject_type,
           feature_id, concept_id, direction, magnitude, causal_strength, numeric_value, numeric_unit, numeric_role, claim_origin, target, semantic_signature, array_to_string(list_sort(rules), ',') AS rules FROM u""")
def claims_finalized(spark, sf_dir):
    """The final claims of all orders: numbers in rows of their own, each stated count once, ids from content."""
    c = _claims(spark, sf_dir, dealt=True)
    sections = c.select("generation_id", "source_section", "source_factor_id", F.col("source_span_start").alias("start"), F.col("source_text").alias("text"))
    return fin.finalized(c, sections, dealt=True).withColumn("rules", F.array_join("rules", ","))


#: The fields of an event's payload: name, kinds that it may have, values that it may take, least and greatest number.
_PAYLOAD = (
    payloads.Field("kind", ("string",), values=("click", "view", "purchase", "signup")),
    payloads.Field("value", ("number",), least=0.0),
    payloads.Field("user", ("integer",), least=1.0),
    payloads.Field("k", ("integer", "null"), most=79.0),
    payloads.Field("note", ("string",), required=False),
)


def _payload(spark, sf_dir):
    """Events as the JSON that a client might have sent: some cut off, some with fields missing, misspelt or of another kind."""
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    user = F.when(i % 7 == 3, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    k = F.when(i % 5 == 1, F.lit("null")).otherwise(F.regexp_extract("props", r"(\d+)", 1))
    value = F.when(i % 11 == 2, F.lit("true")).when(i % 13 == 5, F.lit("-1.5")).otherwise((F.col("user_id") / 4).cast("decimal(12,2)").cast("string"))
    item = F.concat(
        F.lit('{"kind": "'), F.col("event_type"), F.lit('", "value": '), value, F.when(i % 17 == 4, F.lit("")).otherwise(F.concat(F.lit(', "user": '), user)), F.lit(', "k": '), k,
        F.when(i % 19 == 6, F.lit(', "extra": [1]')).when(i % 3 == 0, F.lit(', "note": "x"')).otherwise(F.lit("")), F.lit("}"),
    )
    text = F.when(i % 23 == 7, F.concat(F.lit('{"items": ['), item)).when(i % 29 == 8, F.concat(F.lit('{"items": '), item, F.lit("}"))).when(i % 31 == 9, F.lit("[]")).otherwise(F.concat(F.lit('{"items": ['), item, F.lit(", "), F.when(i % 37 == 10, F.lit("7")).otherwise(item), F.lit("]}")))
    return e.select("event_id", text.alias("payload"))


_PAYLOAD_SQL = r"""
    WITH e AS (SELECT event_id, '{"kind": "' || event_type || '", "value": ' || CASE WHEN event_id % 11 = 2 THEN 'true' WHEN event_id % 13 = 5 THEN '-1.5' ELSE (user_id / 4)::DECIMAL(12,2)::VARCHAR END
                 || CASE WHEN event_id % 17 = 4 THEN '' ELSE ', "user": ' || CASE WHEN event_id % 7 = 3 THEN '"' || user_id || '"' ELSE user_id::VARCHAR END END
                 || ', "k": ' || CASE WHEN event_id % 5 = 1 THEN 'null' ELSE regexp_extract(props, '(\d+)', 1) END
                 || CASE WHEN event_id % 19 = 6 THEN ', "extra": [1]' WHEN event_id % 3 = 0 THEN ', "note": "x"' ELSE '' END || '}' AS item FROM events),
    p AS (SELECT event_id, CASE WHEN event_id % 23 = 7 THEN '{"items": [' || item WHEN event_id % 29 = 8 THEN '{"items": ' || item || '}' WHEN event_id % 31 = 9 THEN '[]'
                 ELSE '{"items": [' || item || ', ' || CASE WHEN event_id % 37 = 10 THEN '7' ELSE item END || ']}' END AS payload FROM e),
    v AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM p),
    i AS (SELECT event_id, unnest(json_extract(j, '$.items[*]')) AS item, unnest(range(json_array_length(j, '$.items')::BIGINT)) AS n FROM v WHERE json_type(j, '$.items') = 'ARRAY'),
    o AS (SELECT event_id, n, item, CASE json_type(item) WHEN 'OBJECT' THEN json_keys(item) END AS keys FROM i),
    f AS (SELECT event_id, n, unnest(['kind', 'value', 'user', 'k', 'note']) AS field, item, keys FROM o WHERE keys IS NOT NULL),
    y AS (SELECT *, list_contains(keys, field) AS there, CASE json_type(item, '$.' || field) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind,
                 try_cast(json_extract_string(item, '$.' || field) AS DOUBLE) AS num, json_extract_string(item, '$.' || field) AS word FROM f),
    w AS (
        SELECT event_id, '$' AS path, 'NOT_JSON' AS code FROM v WHERE j IS NULL
        UNION ALL SELECT event_id, '$', 'NOT_AN_OBJECT' FROM v WHERE json_type(j) <> 'OBJECT'
        UNION ALL SELECT event_id, '$.items', 'NOT_A_LIST' FROM v WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.items'), '') <> 'ARRAY'
        UNION ALL SELECT event_id, '$.items[' || n || ']', 'NOT_AN_OBJECT' FROM o WHERE keys IS NULL
        UNION ALL SELECT event_id, '$.items[' || n || '].' || u, 'UNEXPECTED_FIELD' FROM (SELECT event_id, n, unnest(keys) AS u FROM o) WHERE u NOT IN ('kind', 'value', 'user', 'k', 'note')
        UNION ALL SELECT event_id, '$.items[' || n || '].' || field, 'MISSING' FROM y WHERE NOT there AND field <> 'note'
        UNION ALL SELECT event_id, '$.items[' || n || '].' || field, CASE
            WHEN NOT list_contains(CASE field WHEN 'kind' THEN ['string'] WHEN 'value' THEN ['number', 'integer'] WHEN 'user' THEN ['integer'] WHEN 'k' THEN ['integer', 'null'] ELSE ['string'] END, kind) THEN 'WRONG_KIND'
            WHEN field = 'kind' AND word NOT IN ('click', 'view', 'purchase', 'signup') THEN 'UNKNOWN_VALUE'
            WHEN (field = 'value' AND num < 0) OR (field = 'user' AND num < 1) OR (field = 'k' AND num > 79) THEN 'OUT_OF_RANGE' END FROM y WHERE there)
    """


@query(_PAYLOAD_SQL + "SELECT event_id, path, code FROM w WHERE code IS NOT NULL")
def payload_violations(spark, sf_dir):
    """Every fault of every payload, by its place."""
    return payloads.violations(_payload(spark, sf_dir), "event_id", "payload", "items", _PAYLOAD)


@query(_PAYLOAD_SQL + """, bad AS (SELECT event_id, TRY_CAST(regexp_extract(path, '\\[(\\d+)\\]', 1) AS BIGINT) AS n, count(*) AS faults FROM w WHERE code IS NOT NULL GROUP BY ALL)
    SELECT o.event_id, o.n AS place, coalesce(faults, 0) AS faults, coalesce(faults, 0) = 0 AS accepted,
           CASE WHEN coalesce(faults, 0) = 0 THEN round(json_extract_string(item, '$.value')::DOUBLE, 6) END AS value, CASE WHEN coalesce(faults, 0) = 0 THEN json_extract_string(item, '$.user')::BIGINT END AS "user"
    FROM o LEFT JOIN bad ON bad.event_id = o.event_id AND bad.n = o.n""")
def payload_items(spark, sf_dir):
    """The items of all payloads: how many faults each has, and what the faultless ones hold."""
    items = payloads.judged(_payload(spark, sf_dir), "event_id", "payload", "items", _PAYLOAD)
    field = lambda name, kind: F.when(F.col("accepted"), F.try_variant_get("item", f"$.{name}", kind))
    return items.select("event_id", "place", "faults", "accepted", F.round(field("value", "double"), 6).alias("value"), field("user", "bigint").alias("user"))
