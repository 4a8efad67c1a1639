"""Filters, scenario lists, paths and model rosters on the driver tables.

Recipes stand in each query; the SQL states them again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caliper.functions import rules
from caliper.functions.labels import canon_truth_melanoma
from caliper.functions.text import extract_id, resolve_path
from caliper.operators import filters, metrics, scoring
from caliper.operators import linkage as J
from caliper.plans.labelling import PART_DX_SQL, part_dx
from caliper.plans.linkage_plans import file_catalog
from caliper.plans.registry import plan, rounded
from caliper.plans.reports import _sql_melanoma
from caliper.plans.tables import table
from caliper.sources import readers as S

_SCORE = StructType([StructField("score", DoubleType(), True)])


@plan("case_paths", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/abs/isic_' || CAST(c_custkey AS VARCHAR) || '.jpg'
                  WHEN 1 THEN '/data/img/x/ISIC_' || CAST(c_custkey AS VARCHAR) || '.png' ELSE '/data/img/none.jpg' END AS path,
       CASE WHEN c_custkey % 3 < 2 THEN 'ISIC_' || CAST(c_custkey AS VARCHAR) END AS id
FROM customer""")
def case_paths(spark, d):
    """P1 + P9 + F18 + T4: required columns, paths made absolute, ids in them, by path."""
    c = S.require_columns(table(spark, d, "customer"), ["c_custkey"], "customer")
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    value = F.when(k == 0, F.concat(F.lit(" /abs/isic_"), n, F.lit(".jpg"))) \
        .when(k == 1, F.concat(F.lit("x/ISIC_"), n, F.lit(".png\t"))).otherwise(F.lit("none.jpg"))
    rows = c.select("c_custkey", resolve_path("/data/img/", value).alias("path"))
    return filters.sorted_listing(rows.withColumn("id", extract_id("path")))


@plan("first_cases", """
SELECT conv_id, turn, role FROM conversations
WHERE contains(lower(role), 'user') AND coalesce(trim(text), '') <> '' AND turn % 4 <> 2
ORDER BY conv_id, turn LIMIT 200""")
def first_cases(spark, d):
    """P3 + P4 + P7: one image type, evaluable rows, the first 200 cases (the limit is
    the operator)."""
    c = table(spark, d, "conversations").withColumn("error", F.when(F.col("turn") % 4 == 2, "timeout"))
    rows = filters.evaluable(filters.image_type_filter(c, "role", "user"), "text", "role", "error")
    return filters.limit_cases(rows, 200, ["conv_id", "turn"]).select("conv_id", "turn", "role")


@plan("loose_blanks", """
SELECT count(*) FILTER (WHERE q <> '') AS n_strict, count(*) FILTER (WHERE q IS NULL OR q <> '') AS n_loose
FROM (SELECT CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN ' ' END AS q0, trim(q0) AS q
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def loose_blanks(spark, d):
    """P3 in both readings of a missing value (quirk Q4), counted."""
    m = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left") \
        .select(F.lit("t").alias("t"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, " ").alias("q"))
    strict, loose = (filters.evaluable(m, "t", "q", strict_blank=s).agg(F.count(F.lit(1)).alias(n))
                     for s, n in ((True, "n_strict"), (False, "n_loose")))
    return metrics.attach_single_row(strict, loose)


@plan("missing_as_negative", f"""
WITH {PART_DX_SQL},
r AS (SELECT {_sql_melanoma("dx_truth")} AS truth,
             CASE WHEN contains(lower(dx), 'melanoma') THEN 'melanoma' WHEN dx IS NOT NULL THEN 'non-melanoma' END AS pred FROM px),
e AS (SELECT CAST(truth = 'melanoma' AS INTEGER) AS y, CAST(coalesce(pred, '') = 'melanoma' AS INTEGER) AS p FROM r WHERE truth <> '')
SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
       count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn
FROM e""")
def missing_as_negative(spark, d):
    """A4 with a missing prediction counted as negative (quirk Q3)."""
    r = part_dx(spark, d).select(canon_truth_melanoma("dx_truth").alias("truth"),
                                 F.when(F.lower("dx").contains("melanoma"), "melanoma")
                                 .when(F.col("dx").isNotNull(), "non-melanoma").alias("pred"))
    m = metrics.binary_metrics_label(r.where("truth <> ''"), "truth", "pred", positive="melanoma",
                                     labels=rules.MELANOMA_LABELS, missing_pred="negative")
    return m.select("n", "tp", "fp", "tn", "fn")


@plan("scenario_cases", """
SELECT s_suppkey, scenario, CASE scenario WHEN 'derm_only' THEN 'a' || CAST(s_suppkey AS VARCHAR)
       ELSE 'a' || CAST(s_suppkey AS VARCHAR) || ',b' || CAST(s_nationkey AS VARCHAR) END AS images
FROM supplier, (SELECT unnest(['derm_only', 'derm_plus_clin']) AS scenario)
UNION ALL SELECT s_suppkey, 'plain', '' FROM supplier""")
def scenario_cases(spark, d):
    """B3 + U2: every case under each scenario's image list, stacked with a plain table."""
    s = table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("derm"),
        F.concat(F.lit("b"), F.col("s_nationkey").cast("string")).alias("clin"))
    cases = scoring.with_scenarios(s, {"derm_only": ["derm"], "derm_plus_clin": ["derm", "clin"]})
    listed = cases.select("s_suppkey", "scenario", F.array_join("images", ",").alias("images"))
    parts = {n: listed.where(F.col("scenario") == n).drop("scenario") for n in ("derm_only", "derm_plus_clin")}
    return J.stack_scenarios({**parts, "plain": s.select("s_suppkey", F.lit("").alias("images"))})


@plan("skipped_cases", """
WITH img AS (SELECT 'img/' || c_name || '.png' AS path FROM customer UNION SELECT DISTINCT 'img/' || p_brand || '.jpg' FROM part),
c AS (SELECT o_orderkey, 'img/Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.png' AS img_a,
             CASE WHEN o_orderkey % 4 > 0 THEN 'img/Brand#' || CAST(o_orderkey % 30 AS VARCHAR) || '.jpg' END AS img_b,
             CASE WHEN o_orderkey % 3 > 0 THEN 'n' END AS note FROM orders)
SELECT o_orderkey, img_b, note FROM c
WHERE img_b IS NULL OR img_a NOT IN (SELECT path FROM img) OR img_b NOT IN (SELECT path FROM img)""")
def skipped_cases(spark, d):
    """P5, the skipped side: cases of which an image is missing or NULL."""
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("img/Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(".png")).alias("img_a"),
        F.when(k % 4 > 0, F.concat(F.lit("img/Brand#"), (k % 30).cast("string"), F.lit(".jpg"))).alias("img_b"),
        F.when(k % 3 > 0, "n").alias("note"))
    _, skipped = J.present_only(cases, J.image_files(file_catalog(spark, d)), ["img_a", "img_b"])
    return skipped.select("o_orderkey", "img_b", "note")


@plan("resolve_by_path", """
SELECT c_custkey, key, CASE WHEN c_custkey % 4 < 3 THEN 'img/' || c_name || '.png' END AS path,
       CASE c_custkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN '2' END AS path_by
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'img/' || c_name || '.png' WHEN 1 THEN c_name || '.png'
                WHEN 2 THEN c_name ELSE 'no ' || c_name END AS key FROM customer)""")
def resolve_by_path(spark, d):
    """J1 by path, file name and stem, without the substring fallback."""
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    key = F.when(k == 0, F.concat(F.lit("img/"), n, F.lit(".png"))).when(k == 1, F.concat(n, F.lit(".png"))) \
        .when(k == 2, n).otherwise(F.concat(F.lit("no "), n))
    wanted = table(spark, d, "customer").select("c_custkey", key.alias("key"))
    return J.find_files(wanted, "key", J.image_files(file_catalog(spark, d)), alias_rule=J.aliases_path,
                        candidate_rule=J.candidates_path("img"), substring_fallback=False)


@plan("resolve_by_prefix", f"""
SELECT s_suppkey, key, CASE WHEN s_suppkey % 5 > 0 THEN 'z/{rules.ID_PREFIX}' || CAST(s_suppkey AS VARCHAR) || '.jpg' END AS path,
       CASE WHEN s_suppkey % 5 > 0 THEN '0' END AS path_by
FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'x' || CAST(s_suppkey AS VARCHAR)
                     WHEN s_suppkey % 2 = 0 THEN '{rules.ID_PREFIX}' || CAST(s_suppkey AS VARCHAR)
                     ELSE CAST(s_suppkey AS VARCHAR) END AS key FROM supplier)""")
def resolve_by_prefix(spark, d):
    """J1 by stem with or without the id prefix; keys of both spellings and none."""
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    s = table(spark, d, "supplier")
    files = s.select(F.concat(F.lit(f"z/{rules.ID_PREFIX}"), n, F.lit(".jpg")).alias("path"))
    key = F.when(k % 5 == 0, F.concat(F.lit("x"), n)).when(k % 2 == 0, F.concat(F.lit(rules.ID_PREFIX), n)).otherwise(n)
    return J.find_files(s.select("s_suppkey", key.alias("key")), "key", files, alias_rule=J.aliases_stem_prefix,
                        candidate_rule=J.candidates_prefix, substring_fallback=False)


@plan("score_models", """
SELECT doc_id, m AS checkpoint, round(CAST((length(text) * m_n) % 97 AS DOUBLE) / 97.0, 6) AS score, CAST(NULL AS VARCHAR) AS error
FROM documents, (SELECT 'm' || CAST(i AS VARCHAR) AS m, i AS m_n FROM range(1, 4) t(i))""")
def score_models(spark, d):
    """B2: three models score every document, each loaded once per (model, salt)."""
    def scorer(model: str, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": pdf["text"].fillna("").str.len() * int(model[1:]) % 97 / 97.0})

    docs = table(spark, d, "documents").select("doc_id", "text")
    out = scoring.score_once_per_model(docs, ["m1", "m2", "m3"], scorer, _SCORE)
    return rounded(out.select("doc_id", "checkpoint", "score", F.col("_error").alias("error")))


@plan("score_with_fallback", """
SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN NULL WHEN doc_id % 5 = 0 THEN -1.0
               ELSE round(CAST(length(text) % 97 AS DOUBLE) / 97.0, 6) END AS score,
       CASE WHEN doc_id % 10 = 5 THEN 'refused' END AS error
FROM documents""")
def score_with_fallback(spark, d):
    """B1 + R6: rows that the scorer fails on go, alone, to a fallback; those that fail
    there too become error rows."""
    def scorer(pdf):
        return pd.DataFrame({"score": pdf["text"].fillna("").str.len() % 97 / 97.0,
                             "_error": [("busy" if i % 5 == 0 else None) for i in pdf["doc_id"]]})

    def fallback(pdf):
        return pd.DataFrame({"score": [-1.0] * len(pdf), "_error": [("refused" if i % 10 == 5 else None) for i in pdf["doc_id"]]})

    docs = table(spark, d, "documents").select("doc_id", "text")
    out = scoring.score_table(docs, scorer, _SCORE, attempts=2, fallback=fallback)
    return rounded(out.select("doc_id", "score", F.col("_error").alias("error")))
