"""Prediction-store reports on the driver tables.

Recipe: a lesion store built from ``part`` (see ``labelling``): every part is a
case under two scenarios; truth is the diagnosis text ``dx_truth``; the top-3
predictions are the part's diagnosis texts, rotated for the second scenario; one
part in 13 is an error row; the group is a skin-tone class ``p_size % 5`` (NULL
when ``p_size % 7 = 0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions import rules
from caliper.functions.text import norm_dx2
from caliper.operators import metrics, reports
from caliper.operators.filters import evaluable
from caliper.operators.replies import pad_topk
from caliper.plans.labelling import (PART_DX_SQL, _sql_group, _sql_melanoma, _sql_norm,
                                     _sql_two_class, part_dx)
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table

SCENARIOS = ["derm_only", "derm_plus_clin"]


def lesion_store(spark: SparkSession, d: str) -> DataFrame:
    p = dealt(part_dx(spark, d))
    sc = F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario")
    base = p.select("p_partkey", "p_size", "p_retailprice", "dx", "dx_next1", "dx_next2",
                    "dx_truth", sc)
    first = F.col("scenario") == SCENARIOS[0]
    x = base.select(
        F.col("p_partkey").alias("lesion_id"), "scenario", F.col("dx_truth").alias("truth"),
        F.when(first, F.col("dx")).otherwise(F.col("dx_next1")).alias("p1"),
        F.when(first, F.col("dx_next1")).otherwise(F.col("dx_next2")).alias("p2"),
        F.when(first, F.col("dx_next2")).otherwise(F.col("dx")).alias("p3"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None))
        .otherwise((F.col("p_size") % 5).cast("string")).alias("skin_tone_class"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit("timeout")).otherwise(F.lit("")).alias("_error"),
        (F.col("p_retailprice") / 2000.0).alias("score"))
    return reports.prediction_rows(x, "truth", ["p1", "p2", "p3"], error="_error")


def _n(e):
    return _sql_norm(e)


STORE_SQL = f"""
{PART_DX_SQL},
st0 AS (
  SELECT p_partkey AS lesion_id, s.scenario, dx_truth AS truth,
         CASE WHEN s.scenario = 'derm_only' THEN dx ELSE dx_next1 END AS p1,
         CASE WHEN s.scenario = 'derm_only' THEN dx_next1 ELSE dx_next2 END AS p2,
         CASE WHEN s.scenario = 'derm_only' THEN dx_next2 ELSE dx END AS p3,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 5 AS VARCHAR) END AS skin_tone_class,
         CASE WHEN p_partkey % 13 = 0 THEN 'timeout' ELSE '' END AS _error,
         CAST(p_retailprice AS DOUBLE) / 2000.0 AS score
  FROM px, (SELECT 'derm_only' AS scenario UNION ALL SELECT 'derm_plus_clin') s),
st1 AS (
  SELECT *, {_n("truth")} AS truth_dx2_norm,
         {_sql_group("p1")} AS g1, {_sql_group("p2")} AS g2, {_sql_group("p3")} AS g3
  FROM st0),
store AS (
  SELECT lesion_id, scenario, truth, skin_tone_class, _error, score, truth_dx2_norm,
         CASE WHEN _error = '' THEN coalesce(p1, '') ELSE '' END AS top1,
         CASE WHEN _error = '' THEN g1 END AS pred_dx2_g1,
         CASE WHEN _error = '' THEN truth_dx2_norm <> '' AND truth_dx2_norm = {_n("g1")} END
           AS top1_correct_dx2,
         CASE WHEN _error = '' THEN truth_dx2_norm <> '' AND truth_dx2_norm IN
              ({_n("g1")}, {_n("g2")}, {_n("g3")}) END AS hit_at3_dx2
  FROM st1)"""

_MAL = ", ".join(f"'{g}'" for g in rules.MALIGNANT_DX_GROUPS)


@plan("scenario_report", f"""
WITH {STORE_SQL},
s AS (
  SELECT scenario, skin_tone_class,
         (_error = '' AND coalesce(trim(truth), '') <> '' AND coalesce(trim(top1), '') <> '') AS ev,
         coalesce({_n("truth_dx2_norm")} IN ({_MAL}), false) AS tb,
         coalesce({_n("coalesce(pred_dx2_g1, '')")} IN ({_MAL}), false) AS pb,
         CAST(top1_correct_dx2 AS DOUBLE) AS h1, CAST(hit_at3_dx2 AS DOUBLE) AS h3,
         CAST(pred_dx2_g1 IS NOT NULL AS DOUBLE) AS mc
  FROM store),
a AS (
  SELECT scenario, skin_tone_class, GROUPING(skin_tone_class) AS gid,
         count(*) AS n_total, count(*) FILTER (WHERE ev) AS n_eval,
         avg(CASE WHEN ev THEN coalesce(h1, 0) END) AS top1_accuracy,
         avg(CASE WHEN ev THEN coalesce(h3, 0) END) AS hit_at3,
         avg(CASE WHEN ev THEN coalesce(mc, 0) END) AS mapping_coverage,
         count(*) FILTER (WHERE ev AND tb AND pb) AS tp,
         count(*) FILTER (WHERE ev AND NOT tb AND NOT pb) AS tn,
         count(*) FILTER (WHERE ev AND NOT tb AND pb) AS fp,
         count(*) FILTER (WHERE ev AND tb AND NOT pb) AS fn
  FROM s GROUP BY GROUPING SETS ((scenario), (scenario, skin_tone_class))),
b AS (SELECT *, CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS sens,
             CAST(tp AS DOUBLE) / greatest(tp + fp, 1) AS prec
      FROM a WHERE gid = 1 OR skin_tone_class IS NOT NULL)
SELECT scenario, CASE WHEN gid = 1 THEN 'overall' ELSE 'skin_tone_class' END AS level,
       skin_tone_class, n_total, n_eval, round(top1_accuracy, 6) AS top1_accuracy,
       round(hit_at3, 6) AS hit_at3, round(mapping_coverage, 6) AS mapping_coverage,
       tp, tn, fp, fn,
       round(CAST(tp + tn AS DOUBLE) / greatest(tp + tn + fp + fn, 1), 6) AS accuracy,
       round(sens, 6) AS recall, round(CAST(tn AS DOUBLE) / greatest(tn + fp, 1), 6) AS specificity,
       round(prec, 6) AS "precision",
       round(2 * prec * sens / greatest(prec + sens, 1e-12), 6) AS f1
FROM b""")
def scenario_report(spark, d):
    """A26 + A3 + A7 + A14 + A16: grouping sets (scenario), (scenario, skin tone)."""
    return rounded(reports.scenario_report(lesion_store(spark, d)))


@plan("truth_vocabulary", f"""
WITH {STORE_SQL},
v AS (SELECT DISTINCT {_n("truth")} AS value FROM store WHERE truth IS NOT NULL),
c AS (SELECT count(*) AS n_distinct FROM v)
SELECT value, n_distinct, greatest(n_distinct - 50, 0) AS n_more
FROM (SELECT value FROM v ORDER BY value LIMIT 50), c""")
def truth_vocabulary(spark, d):
    """Sorted distinct normalised truth values, first 50, and how many more."""
    store = lesion_store(spark, d).where(F.col("truth").isNotNull())
    return metrics.truth_vocabulary(store, norm_dx2("truth"), 50)


@plan("two_class_accuracy", f"""
WITH {PART_DX_SQL},
r AS (SELECT p_partkey, {_sql_two_class("dx_truth")} AS truth,
             CASE WHEN contains(lower(coalesce(dx, '')), 'melanoma') THEN 'melanoma'
                  ELSE 'melanocytic nevus' END AS top1,
             CASE WHEN contains(lower(coalesce(dx_next1, '')), 'melanoma') THEN 'melanoma'
                  ELSE 'melanocytic nevus' END AS top2
      FROM px WHERE dx IS NOT NULL),
e AS (SELECT *, truth <> '' AND top1 = truth AS top1_correct,
             truth <> '' AND truth IN (top1, top2, 'melanocytic nevus') AS hit_at3
      FROM r WHERE truth <> '' AND top1 <> '')
SELECT count(*) AS n, round(avg(CAST(top1_correct AS DOUBLE)), 6) AS top1_accuracy,
       round(avg(CAST(hit_at3 AS DOUBLE)), 6) AS hit_at_3,
       round(avg(CAST(truth = top1 AS DOUBLE)), 6) AS accuracy_check
FROM e""")
def two_class_accuracy(spark, d):
    """F5 + F11 + F12 (padding with the nevus filler) + A14 + A15 on the two-class
    archive evaluation: two predictions per case, padded to three."""
    p = part_dx(spark, d).where(F.col("dx").isNotNull())
    two = F.array(L.collapse_two_class("dx"), L.collapse_two_class("dx_next1"))
    r = p.select("p_partkey", L.canon_truth_two_class("dx_truth").alias("truth"),
                 pad_topk(two, 3, F.lit(rules.TOPK_FILLER_TWO_CLASS["diagnosis"])).alias("top"))
    e = r.select("truth", F.get("top", 0).alias("top1"), "top").where(
        (F.col("truth") != "") & (F.col("top1") != ""))
    flags = e.select("truth", "top1",
                     (F.col("top1") == F.col("truth")).alias("top1_correct"),
                     F.array_contains("top", F.col("truth")).alias("hit_at3"))
    hr = metrics.hit_rates(flags, {"top1_accuracy": "top1_correct", "hit_at_3": "hit_at3"})
    acc = metrics.accuracy_check(flags, "truth", "top1")
    return rounded(metrics.attach_single_row(hr, acc))


@plan("melanoma_label_metrics", f"""
WITH {PART_DX_SQL},
r AS (SELECT {_sql_melanoma("dx_truth")} AS truth,
             CASE WHEN dx IS NULL THEN '' WHEN contains(lower(dx), 'melanoma') THEN 'melanoma'
                  ELSE 'non-melanoma' END AS pred FROM px),
e AS (SELECT CAST(truth = 'melanoma' AS INTEGER) AS y, CAST(pred = 'melanoma' AS INTEGER) AS p
      FROM r WHERE truth <> '' AND pred <> ''),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND p = 0) AS tn,
             count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) AS n FROM e)
SELECT n, tp, fp, tn, fn, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       'non-melanoma,melanoma' AS labels
FROM c""")
def melanoma_label_metrics(spark, d):
    """F6 + A4 + A7 filter: named-label metrics over evaluable rows."""
    p = part_dx(spark, d)
    r = p.select(L.canon_truth_melanoma("dx_truth").alias("truth"),
                 F.when(F.col("dx").isNull(), F.lit(""))
                 .when(F.lower("dx").contains("melanoma"), F.lit("melanoma"))
                 .otherwise(F.lit("non-melanoma")).alias("pred"))
    e = evaluable(r, "truth", "pred")
    m = metrics.binary_metrics_label(e, "truth", "pred", positive="melanoma",
                                     labels=rules.MELANOMA_LABELS)
    return rounded(m.select("n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1",
                            F.array_join("labels", ",").alias("labels")))


def _malignancy_inputs_sql() -> str:
    return f"""
r AS (SELECT skin_tone_class, CAST({_sql_group('truth')} IN ({_MAL}) AS INTEGER) AS y,
             CASE WHEN lesion_id % 2 = 0 THEN 'Malignant' ELSE 'Benign' END AS pred_label,
             score AS conf
      FROM store WHERE scenario = 'derm_only' AND {_sql_group('truth')} IS NOT NULL
        AND skin_tone_class IS NOT NULL),
s AS (SELECT skin_tone_class, y, CAST(pred_label = 'Malignant' AS INTEGER) AS p,
             CASE WHEN pred_label = 'Malignant' THEN conf ELSE 1.0 - conf END AS score FROM r)"""


@plan("malignancy_label_report", f"""
WITH {STORE_SQL},
{_malignancy_inputs_sql()},
pts AS (SELECT skin_tone_class, score, count(*) FILTER (WHERE y = 1) AS pos,
               count(*) FILTER (WHERE y <> 1) AS neg FROM s GROUP BY skin_tone_class, score),
cum AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY skin_tone_class ORDER BY score DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS tp,
               CAST(sum(pos) OVER (PARTITION BY skin_tone_class) AS DOUBLE) AS np,
               CAST(sum(neg) OVER (PARTITION BY skin_tone_class) AS DOUBLE) AS nn FROM pts),
auc AS (SELECT skin_tone_class, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN
               sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)) END AS roc_auc
        FROM cum GROUP BY skin_tone_class),
c AS (SELECT skin_tone_class, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
             count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn,
             count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) AS n
      FROM s GROUP BY skin_tone_class)
SELECT c.skin_tone_class, n, tp, fp, tn, fn,
       round(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 6) AS accuracy,
       round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity,
       round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
       round(auc.roc_auc, 6) AS roc_auc
FROM c LEFT JOIN auc ON c.skin_tone_class = auc.skin_tone_class""")
def malignancy_label_report(spark, d):
    """F16 + A5 + A6: binary label report per skin tone (NULL tone dropped), with
    P(malignant) from the predicted label and its confidence as the AUROC score."""
    st = lesion_store(spark, d).where(F.col("scenario") == SCENARIOS[0])
    g = L.dx_to_group("truth")
    r = st.where(g.isNotNull() & F.col("skin_tone_class").isNotNull()).select(
        "skin_tone_class", L.is_malignant_group(g).cast("int").alias("y"),
        F.when(F.col("lesion_id") % 2 == 0, "Malignant").otherwise("Benign").alias("pred_label"),
        F.col("score").alias("conf"))
    s = r.select("skin_tone_class", "y",
                 (F.col("pred_label") == "Malignant").cast("int").alias("p"),
                 L.prob_from_label("pred_label", "conf").alias("score"))
    rep = metrics.metrics_by_group(s, "y", "p", "score", "skin_tone_class")
    return rounded(rep.drop("matrix"))


@plan("eval_counts_docs", """
WITH m AS (
  SELECT d.doc_id,
         CASE WHEN d.lang = 'en' THEN 'melanoma' WHEN d.lang = 'fr' THEN 'non-melanoma'
              ELSE '' END AS truth_label,
         CASE l.quality WHEN 1 THEN 'melanoma' WHEN 0 THEN 'non-melanoma' END AS pred_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) AS n_total,
       count(*) FILTER (WHERE coalesce(trim(truth_label), '') <> '') AS n_with_truth,
       count(*) FILTER (WHERE coalesce(trim(pred_label), '') <> '') AS n_with_pred,
       count(*) FILTER (WHERE coalesce(trim(truth_label), '') <> ''
                        AND coalesce(trim(pred_label), '') <> '') AS n_evaluated
FROM m""")
def eval_counts_docs(spark, d):
    """J4 + A7: metadata left-joined to predictions; cases without a prediction are
    excluded from n_with_pred / n_evaluated (the sane reading of quirk Q3)."""
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    m = docs.join(lab, "doc_id", "left").select(
        F.when(F.col("lang") == "en", "melanoma").when(F.col("lang") == "fr", "non-melanoma")
        .otherwise("").alias("truth_label"),
        F.when(F.col("quality") == 1, "melanoma").when(F.col("quality") == 0, "non-melanoma")
        .alias("pred_label"))
    return metrics.eval_counts(m, "truth_label", "pred_label")
