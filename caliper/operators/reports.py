"""Prediction stores and the per-scenario report.

``prediction_rows`` turns (case, scenario, truth, top-k prediction texts, error)
into the stored row layout (normalised truth, mapped groups, hit flags).
``scenario_report`` computes, per scenario, counts, hit rates, mapping coverage
and max(den, 1) binary metrics, overall and per group, in ONE aggregate with
``GROUPING SETS`` instead of a loop over scenarios and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions.text import norm_dx2, strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prediction_rows(df: DataFrame, truth: str, preds, error: str | None = None,
                    k: int = 3) -> DataFrame:
    """Stored layout of a top-k prediction: truth_dx2_norm, top{i}, pred_dx2_g{i},
    top1_correct_dx2 and hit_at3_dx2 (F7, F8, F10).  Rows with an error keep the
    truth but get blank predictions and NULL flags."""
    arr = F.array(*[_c(p) for p in preds])
    ok = F.lit(True) if error is None else (F.coalesce(strip(_c(error)), F.lit("")) == "")
    cols = [norm_dx2(truth).alias("truth_dx2_norm")]
    for i, p in enumerate(preds, start=1):
        cols.append(F.when(ok, F.coalesce(_c(p), F.lit(""))).otherwise(F.lit("")).alias(f"top{i}"))
        cols.append(F.when(ok, L.dx_to_group(p)).alias(f"pred_dx2_g{i}"))
    cols.append(F.when(ok, L.hit_at_k(truth, arr, 1)).alias("top1_correct_dx2"))
    cols.append(F.when(ok, L.hit_at_k(truth, arr, k)).alias(f"hit_at{k}_dx2"))
    return df.select("*", *cols)


def scenario_report(store: DataFrame, by: str = "skin_tone_class", scenario: str = "scenario",
                    truth: str = "truth", top1: str = "top1", error: str = "_error",
                    strict_blank: bool = True) -> DataFrame:
    """A26 (+A7, A14, A16, A3): rows at level 'overall' (per scenario) and level
    ``by`` (per scenario and group value; the NULL group is dropped at that level but
    its rows count in the overall level).  Evaluated rows: no error, non-blank truth
    and top-1.  ``strict_blank=False`` counts a NULL truth / top-1 as present, as the
    original store read back from CSV did (NaN is not blank; quirk Q4)."""
    def present(c):
        c = F.col(c).cast("string")
        if strict_blank:
            return F.coalesce(strip(c), F.lit("")) != ""
        return c.isNull() | (strip(c) != "")

    ev = ((F.coalesce(strip(F.col(error)), F.lit("")) == "") & present(truth) & present(top1))
    tb = L.is_malignant_group(F.col("truth_dx2_norm"))
    pb = L.is_malignant_group(F.coalesce(F.col("pred_dx2_g1"), F.lit("")))
    s = store.select(scenario, by, ev.alias("__ev"), tb.alias("__tb"), pb.alias("__pb"),
                     F.col("top1_correct_dx2").cast("double").alias("__h1"),
                     F.col("hit_at3_dx2").cast("double").alias("__h3"),
                     F.col("pred_dx2_g1").isNotNull().cast("double").alias("__mc"))
    e = F.col("__ev")

    def mean_ev(c):
        return F.avg(F.when(e, F.coalesce(F.col(c), F.lit(0.0))))

    agg = s.groupingSets([[scenario], [scenario, by]], scenario, by).agg(
        F.grouping_id().alias("__gid"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(e).alias("n_eval"),
        mean_ev("__h1").alias("top1_accuracy"),
        mean_ev("__h3").alias("hit_at3"),
        mean_ev("__mc").alias("mapping_coverage"),
        F.count_if(e & F.col("__tb") & F.col("__pb")).alias("tp"),
        F.count_if(e & ~F.col("__tb") & ~F.col("__pb")).alias("tn"),
        F.count_if(e & ~F.col("__tb") & F.col("__pb")).alias("fp"),
        F.count_if(e & F.col("__tb") & ~F.col("__pb")).alias("fn"),
    )
    agg = agg.where((F.col("__gid") == 1) | F.col(by).isNotNull())
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    sens = tp.cast("double") / F.greatest(tp + fn, F.lit(1))
    prec = tp.cast("double") / F.greatest(tp + fp, F.lit(1))
    return agg.select(
        scenario, F.when(F.col("__gid") == 1, F.lit("overall")).otherwise(F.lit(by)).alias("level"),
        by, "n_total", "n_eval", "top1_accuracy", "hit_at3", "mapping_coverage",
        "tp", "tn", "fp", "fn",
        ((tp + tn).cast("double") / F.greatest(tp + tn + fp + fn, F.lit(1))).alias("accuracy"),
        sens.alias("recall"),
        (tn.cast("double") / F.greatest(tn + fp, F.lit(1))).alias("specificity"),
        prec.alias("precision"),
        ((2 * prec * sens) / F.greatest(prec + sens, F.lit(1e-12))).alias("f1"))
