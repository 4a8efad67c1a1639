"""Paired-image assessment, end to end, on the driver tables.

Recipe: every part is a case with the diagnosis text ``dx_truth`` (see ``labelling``) and
a model reply assembled from its columns: a family and two further list items, two
probabilities (one part in 11 says "unknown" instead, one in 17 leaves the field out)
and two predictions; every fourth reply is fenced, one in 19 is no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions import rules
from caliper.operators import curves, metrics
from caliper.operators import linkage as J
from caliper.operators import replies as R
from caliper.operators.prefix import materialize
from caliper.plans.labelling import PART_DX_SQL, _sql_any, _sql_family, _sql_lower_strip, part_dx
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table

FAMILIES = rules.FAMILIES


def assessment_replies(spark: SparkSession, d: str) -> DataFrame:
    p = dealt(part_dx(spark, d).select("p_partkey", "p_size", "dx_truth"))
    k, z = F.col("p_partkey"), F.col("p_size")
    fams = F.array(*[F.lit(f) for f in FAMILIES])

    def fam(off):
        return F.element_at(fams, ((k + z + off) % len(FAMILIES) + 1).cast("int"))

    def num(mult):
        return F.concat(F.lit("0."), F.lpad(((k * mult + z) % 100).cast("string"), 2, "0"))

    items = F.concat(*[x for i in range(3) for x in (
        F.lit(', {"diagnosis": "d", "family": "' if i else '{"diagnosis": "d", "family": "'), fam(i),
        F.lit('", "probability": 0.1}'))])
    body = F.concat(
        F.lit('{"primary_diagnosis": "d", "primary_family": "'), fam(0), F.lit('", "top3_differential": ['), items,
        F.lit('], "melanoma_probability": '), F.when(k % 11 == 5, F.lit('"unknown"')).otherwise(num(7)),
        F.when(k % 17 == 3, F.lit("")).otherwise(F.concat(F.lit(', "malignancy_probability": '), num(13))),
        F.lit(', "melanoma_prediction": '), (z % 2).cast("string"),
        F.lit(', "malignancy_prediction": '), (k % 3 % 2).cast("string"), F.lit(', "brief_rationale": "x"}'))
    text = F.when(k % 19 == 0, F.lit("sorry")).when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return p.select(F.col("p_partkey").alias("row_id"), "dx_truth", text.alias("text"))


def _two(m):
    return f"(CAST((p_partkey * {m} + p_size) % 100 AS DOUBLE) / 100.0)"


def _fam(off):
    return f"[{', '.join(repr(f) for f in FAMILIES)}][(p_partkey + p_size + {off}) % {len(FAMILIES)} + 1]"


_T = _sql_lower_strip("dx_truth")


def _target_sql(name: str, y: str, pred: str, prob: str) -> str:
    return f"""
{name}_pts AS (SELECT {prob} AS score, CAST(count(*) FILTER (WHERE {y} = 1) AS DOUBLE) AS pos,
                      CAST(count(*) FILTER (WHERE {y} <> 1) AS DOUBLE) AS neg FROM ev GROUP BY 1),
{name}_cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
                      sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM {name}_pts),
{name}_auc AS (SELECT sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)) AS roc_auc,
                      sum(pos * (tp / (tp + fp))) / max(np) AS pr_auc FROM {name}_cum),
{name}_c AS (SELECT count(*) FILTER (WHERE {y} = 1 AND {pred} = 1) AS tp, count(*) FILTER (WHERE {y} <> 1 AND {pred} = 1) AS fp,
                    count(*) FILTER (WHERE {y} <> 1 AND {pred} <> 1) AS tn, count(*) FILTER (WHERE {y} = 1 AND {pred} <> 1) AS fn,
                    count(*) AS n, avg(CAST(f1 = gt AS INTEGER)) AS top1_family_accuracy,
                    avg(CAST(gt IN (f1, f2, f3) AS INTEGER)) AS top3_family_accuracy FROM ev),
{name}_m AS (SELECT '{name}' AS target, tp, fp, tn, fn, n, round(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 6) AS accuracy,
                    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
                    round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
                    round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
                    round(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 6) AS npv,
                    round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
                    round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
                    round(top1_family_accuracy, 6) AS top1_family_accuracy,
                    round(top3_family_accuracy, 6) AS top3_family_accuracy FROM {name}_c, {name}_auc)"""


@plan("paired_assessment", f"""
WITH {PART_DX_SQL},
ev AS (
  SELECT CAST({_sql_any(_T, rules.MALIGNANT_TERMS)} AS INTEGER) AS y_mal,
         CAST({_sql_any(_T, rules.MELANOMA_TERMS)} AS INTEGER) AS y_mel, {_sql_family(_T)} AS gt,
         {_fam(0)} AS f1, {_fam(1)} AS f2, {_fam(2)} AS f3, {_two(7)} AS mel_p, {_two(13)} AS mal_p,
         p_size % 2 AS mel, p_partkey % 3 % 2 AS mal
  FROM px WHERE p_partkey % 19 <> 0 AND p_partkey % 11 <> 5 AND p_partkey % 17 <> 3),
{_target_sql("malignancy", "y_mal", "mal", "mal_p")},
{_target_sql("melanoma", "y_mel", "mel", "mel_p")}
SELECT * FROM malignancy_m UNION ALL SELECT * FROM melanoma_m""")
def paired_assessment(spark, d):
    """F1 + F2 + R1 + F19 + F22 + P2 + F13 + A14 + A1 + A2 + A9 + A10: labels, parsed replies,
    rows without both probabilities dropped, hit rates and the metrics of both targets."""
    found = R.parse_replies(assessment_replies(spark, d), "text", mode="fenced", on_error="drop")
    # Written once: a filter on the fields would otherwise pull the whole parse into its
    # condition, and the three reports below would each parse again.
    found = materialize(R.family_top3(R.target_fields(found)).drop("text", "_reply", "_error"))
    found = J.drop_incomplete(found, ["melanoma_probability", "malignancy_probability",
                                      "melanoma_prediction", "malignancy_prediction"])
    y = L.label_binary("dx_truth")
    ev = found.select(
        y["y_malignant"].alias("y_malignancy"), y["y_melanoma"].alias("y_melanoma"), L.label_family("dx_truth").alias("gt"),
        "top1_family", "top2_family", "top3_family",
        *[f"{t}_{what}" for t in ("melanoma", "malignancy") for what in ("probability", "prediction")])
    ev = ev.withColumns({"top1_correct": L.flag_equal("top1_family", "gt"),
                         "top3_correct": L.flag_in("gt", ["top1_family", "top2_family", "top3_family"])})
    # One row per case and target, so that both targets come out of the same jobs.
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"y_{t}").alias("y"), F.col(f"{t}_prediction").alias("pred"),
                               F.col(f"{t}_probability").alias("prob")) for t in ("malignancy", "melanoma")])
    long = ev.select("top1_correct", "top3_correct", F.explode(cells).alias("c")).select("top1_correct", "top3_correct", "c.*")
    counts = metrics.binary_metrics(metrics.confusion_counts(long, "y", "pred", ["target"]))
    areas = curves.curve_summary(long, "y", "prob", by=["target"], thresholds=()).select("target", "roc_auc", "pr_auc")
    hits = long.groupBy("target").agg(F.avg("top1_correct").alias("top1_family_accuracy"),
                                      F.avg("top3_correct").alias("top3_family_accuracy"))
    return rounded(counts.drop("confusion_matrix").join(areas, "target").join(hits, "target"))


@plan("parse_binary_replies", f"""
WITH {PART_DX_SQL}
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 6 <> 5 THEN p_partkey % 6 IN (0, 3) END AS pred_is_positive,
       CASE WHEN p_partkey % 6 = 5 THEN '' WHEN p_partkey % 6 IN (0, 3) THEN 'melanoma' ELSE 'non-melanoma' END AS pred_label,
       CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 6 = 2 THEN 0.0
            ELSE CAST(p_size AS DOUBLE) / 100.0 END AS pred_likelihood,
       CASE WHEN p_partkey % 6 <> 5 THEN CASE WHEN p_partkey % 6 = 4 THEN '' ELSE 'because' END END AS pred_rationale,
       CASE WHEN p_partkey % 6 = 5 THEN '{R.ERR_PARSE}' END AS error
FROM px""")
def parse_binary_replies(spark, d):
    """R4 (strict, error rows kept) + F20 + F22: yes/no replies; fields may be missing."""
    k = F.col("p_partkey") % 6
    like = F.concat(F.lit(', "likelihood": 0.'), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    yes = F.when(k == 0, F.lit("true")).when(k == 3, F.lit('"yes"')).when(k == 1, F.lit("0")).otherwise(F.lit("false"))
    text = F.when(k == 5, F.lit("{broken")).otherwise(F.concat(
        F.lit('{"is_melanoma": '), yes, F.when(k == 2, F.lit("")).otherwise(like),
        F.when(k == 4, F.lit("")).otherwise(F.lit(', "rationale": "because"')), F.lit("}")))
    rows = dealt(part_dx(spark, d).select("p_partkey", "p_size")).select(F.col("p_partkey").alias("row_id"), text.alias("text"))
    found = R.binary_fields(R.parse_replies(rows, "text", mode="strict", on_error="keep"))
    return rounded(found.select("row_id", "pred_is_positive", "pred_label", "pred_likelihood", "pred_rationale",
                                F.col("_error").alias("error")))


@plan("label_replies", f"""
WITH {PART_DX_SQL}
SELECT p_partkey AS row_id, CASE WHEN p_size % 4 = 3 THEN '' WHEN p_size % 2 = 0 THEN 'Malignant' ELSE 'Benign' END AS pred_label,
       CASE WHEN p_size % 5 <> 1 THEN CAST(p_size AS DOUBLE) / 100.0 END AS confidence
FROM px""")
def label_replies(spark, d):
    """Replies of a label and its confidence (absent label '', absent number NULL)."""
    z = F.col("p_size")
    text = F.concat(F.lit('{"x": 1'), F.when(z % 4 == 3, F.lit("")).otherwise(F.concat(
        F.lit(', "pred": "'), F.when(z % 2 == 0, "Malignant").otherwise("Benign"), F.lit('"'))),
        F.when(z % 5 == 1, F.lit("")).otherwise(F.concat(F.lit(', "confidence": 0.'), F.lpad(z.cast("string"), 2, "0"))), F.lit("}"))
    rows = dealt(part_dx(spark, d).select("p_partkey", "p_size")).select(F.col("p_partkey").alias("row_id"), text.alias("text"))
    found = R.label_confidence(R.parse_replies(rows, "text", mode="strict"))
    return rounded(found.select("row_id", "pred_label", "confidence"))


@plan("exact_lists", f"""
WITH px AS (SELECT event_id, event_id % 5 AS k FROM events)
SELECT event_id, CASE WHEN k <> 3 THEN '{R.ERR_SHAPE.format(k=3)}' END AS error,
       CASE WHEN k <> 3 THEN '[{{"diagnosis":"","confidence":0.0}},{{"diagnosis":"","confidence":0.0}},{{"diagnosis":"","confidence":0.0}}]'
            ELSE '[{{"diagnosis":"d0","confidence":0.5}},{{"diagnosis":"d1","confidence":0.5}},{{"diagnosis":"d2","confidence":0.5}}]' END AS padded,
       k IN (1, 2, 4) AS truth
FROM px""")
def exact_lists(spark, d):
    """R5 + F12 + F13d + F20: exactly three list items, padded and kept as JSON text; the
    truth value of a field of every JSON kind."""
    e = dealt(table(spark, d, "events").select("event_id"))
    k = F.col("event_id") % 5
    item = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(
        F.lit('{"diagnosis": "d'), i.cast("string"), F.lit('", "confidence": 0.5}')))
    listed = F.when(k == 0, F.lit("7")).otherwise(F.concat(F.lit("["), F.array_join(F.slice(item, 1, k.cast("int")), ", "), F.lit("]")))
    flag = F.when(k == 0, F.lit("[]")).when(k == 1, F.lit('{"a": 0}')).when(k == 2, F.lit('"x"')).when(k == 3, F.lit("null")).otherwise(F.lit("0.5"))
    rows = e.select("event_id", F.concat(F.lit('{"differential": '), listed, F.lit(', "flag": '), flag, F.lit("}")).alias("text"))
    found = R.parse_replies(rows, "text", mode="embedded", list_key="differential", exact_items=3)
    filler = F.struct(F.lit("").alias("diagnosis"), F.lit(0.0).alias("confidence"))
    return found.select("event_id", F.col("_error").alias("error"),
                        R.list_to_json(R.pad_topk(R.differential("_reply"), 3, filler)).alias("padded"),
                        R.truthy(R.field(R.parse_json_strict("text"), "flag")).alias("truth"))
