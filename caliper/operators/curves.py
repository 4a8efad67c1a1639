"""ROC / precision-recall curves, their areas and Youden's operating point.

One distinct-score "points" table per group serves every curve metric:

    points(by.., score, pos, neg, tp, fp, n_pos, n_neg)

``tp``/``fp`` count the rows with score >= this score (the curve vertex when the
threshold equals the score).  Built as: partial+final aggregation to distinct
``(group, score)`` (a hot score collapses to one row before the shuffle) and a
bucketed running sum (``caliper.operators.prefix``) so no group and no table ever
lands in a single task.

From the points table, per group, in one aggregate:
  * AUC  = sum(neg * (tp - pos/2)) / (P * N)    (ties count one half)
  * AP   = sum(pos * tp / (tp + fp)) / P         (step-wise average precision)
  * Youden threshold = score of max (tp/P - fp/N), ties -> the larger threshold,
    with the (+inf, 0, 0) start point so that "nothing beats 0" gives +inf.
Confusion counts at the Youden threshold are read off the same points row, and
counts at a fixed threshold are sums over points with score >= thr: no join of a
threshold back onto the row-level data is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions.text import nan_to_null
from caliper.operators import prefix
from caliper.operators.metrics import binary_metrics

INF = float("inf")


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def roc_points(df: DataFrame, y, score, by=(), **bucket_opts) -> DataFrame:
    """Distinct-score points per group with cumulative counts (see module doc)."""
    by = list(by)
    base = (df.select(*[F.col(b) for b in by],
                      _c(y).cast("int").alias("__y"),
                      nan_to_null(_c(score).cast("double")).alias("score"))
            .where(F.col("__y").isNotNull() & F.col("score").isNotNull()))
    pts = base.groupBy(*by, "score").agg(
        F.count_if(F.col("__y") == 1).alias("pos"),
        F.count_if(F.col("__y") != 1).alias("neg"),
    )
    cum = prefix.running_sums(pts, by, "score", ["pos", "neg"], descending=True,
                              inclusive=True, **bucket_opts)
    return cum.select(
        *by, "score", "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("tot_pos").alias("n_pos"), F.col("tot_neg").alias("n_neg"),
    )


def roc_curve(df: DataFrame, y, score, by=(), points: DataFrame | None = None,
              **bucket_opts) -> DataFrame:
    """One row per distinct score plus the (+inf, 0, 0) start point per group:
    threshold, tp, fp, tpr, fpr (tpr/fpr null when a class is absent)."""
    by = list(by)
    pts = points if points is not None else roc_points(df, y, score, by, **bucket_opts)
    body = pts.select(*by, F.col("score").alias("threshold"), "tp", "fp", "n_pos", "n_neg")
    start = (pts.groupBy(*by).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
             .select(*by, F.lit(INF).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                     F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg"))
    allp = body.unionByName(start)
    return allp.select(
        *by, "threshold", "tp", "fp",
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
    )


def _two_class(n_pos: Column, n_neg: Column) -> Column:
    return (n_pos > 0) & (n_neg > 0)


def curve_summary(df: DataFrame, y, score, by=(), thresholds=(0.5,),
                  points: DataFrame | None = None, **bucket_opts) -> DataFrame:
    """A9 + A10 + A11 (+ counts at Youden and at fixed thresholds) in one aggregate.

    Output per group: n, n_pos, n_neg, roc_auc, pr_auc, youden_threshold, youden_j,
    tp/fp at Youden, and ``tp_at_<i>``/``fp_at_<i>`` for each fixed threshold.
    AUC, AP and Youden are null when only one class occurs."""
    by = list(by)
    pts = points if points is not None else roc_points(df, y, score, by, **bucket_opts)
    P, N = F.col("n_pos"), F.col("n_neg")
    j = F.try_divide(F.col("tp"), P) - F.try_divide(F.col("fp"), N)
    fixed = []
    for i, t in enumerate(thresholds):
        ge = F.col("score") >= F.lit(float(t))
        fixed += [F.sum(F.when(ge, F.col("pos")).otherwise(0)).alias(f"tp_at_{i}"),
                  F.sum(F.when(ge, F.col("neg")).otherwise(0)).alias(f"fp_at_{i}")]
    agg = pts.groupBy(*by).agg(
        F.first("n_pos").alias("n_pos"),
        F.first("n_neg").alias("n_neg"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("__auc_num"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("__ap_num"),
        F.max(F.when(_two_class(P, N), F.struct(j.alias("j"), F.col("score").alias("thr"),
                                                 F.col("tp").alias("tp"),
                                                 F.col("fp").alias("fp")))).alias("__best"),
        *fixed,
    )
    ok = _two_class(P, N)
    # The +inf start point has J = 0 and tp = fp = 0: it wins unless some point beats 0.
    beats = F.col("__best.j") > 0
    return agg.select(
        *by,
        (P + N).alias("n"), "n_pos", "n_neg",
        F.when(ok, F.try_divide(F.col("__auc_num"), P.cast("double") * N)).alias("roc_auc"),
        F.when(ok, F.try_divide(F.col("__ap_num"), P)).alias("pr_auc"),
        F.when(ok, F.when(beats, F.col("__best.thr")).otherwise(F.lit(INF))).alias("youden_threshold"),
        F.when(ok, F.when(beats, F.col("__best.j")).otherwise(F.lit(0.0))).alias("youden_j"),
        F.when(ok, F.when(beats, F.col("__best.tp")).otherwise(F.lit(0))).cast("long").alias("youden_tp"),
        F.when(ok, F.when(beats, F.col("__best.fp")).otherwise(F.lit(0))).cast("long").alias("youden_fp"),
        *[F.col(f"tp_at_{i}").cast("long") for i in range(len(thresholds))],
        *[F.col(f"fp_at_{i}").cast("long") for i in range(len(thresholds))],
    )


def roc_auc(df, y, score, by=(), **kw) -> DataFrame:
    """A9 alone."""
    return curve_summary(df, y, score, by, thresholds=(), **kw).select(*by, "roc_auc")


def pr_auc(df, y, score, by=(), **kw) -> DataFrame:
    """A10 alone."""
    return curve_summary(df, y, score, by, thresholds=(), **kw).select(*by, "pr_auc")


def youden_threshold(df, y, score, by=(), **kw) -> DataFrame:
    """A11 alone: threshold and J."""
    return curve_summary(df, y, score, by, thresholds=(), **kw).select(
        *by, "youden_threshold", "youden_j")


def metrics_at_threshold(df: DataFrame, y, score, by=(), threshold: float = 0.5,
                         modes=("fixed_threshold", "optimal_youden_threshold"),
                         none_if_one_class: bool = True, **bucket_opts) -> DataFrame:
    """predict = score >= threshold (inclusive) -> counts, binary metrics, AUC, AP.

    ``modes`` picks the fixed threshold and/or the Youden threshold; one output row
    per (group, mode).  With ``none_if_one_class`` (the stricter variant) every
    metric of a one-class group is null, counts included."""
    by = list(by)
    s = curve_summary(df, y, score, by, thresholds=(threshold,), **bucket_opts)
    # One row per (group, mode) by exploding an array of per-mode structs: a single
    # pass over the summary, no union of two copies of the plan.
    per_mode = []
    for mode in modes:
        if mode == "fixed_threshold":
            thr, tp, fp = F.lit(float(threshold)), F.col("tp_at_0"), F.col("fp_at_0")
        else:
            thr, tp, fp = F.col("youden_threshold"), F.col("youden_tp"), F.col("youden_fp")
        per_mode.append(F.struct(F.lit(mode).alias("mode"), thr.cast("double").alias("threshold"),
                                 tp.cast("long").alias("tp"), fp.cast("long").alias("fp")))
    out = (s.select(*by, "n", "n_pos", "n_neg", "roc_auc", "pr_auc",
                    F.explode(F.array(*per_mode)).alias("__m"))
           .select(*by, "__m.mode", "__m.threshold", "n", "__m.tp", "__m.fp",
                   (F.col("n_neg") - F.col("__m.fp")).alias("tn"),
                   (F.col("n_pos") - F.col("__m.tp")).alias("fn"),
                   "roc_auc", "pr_auc", "n_pos", "n_neg"))
    out = binary_metrics(out)
    if none_if_one_class:
        keep = set(by) | {"mode", "n_pos", "n_neg"}
        out = out.select(*[F.col(c) if c in keep else
                           F.when(_two_class(F.col("n_pos"), F.col("n_neg")), F.col(c)).alias(c)
                           for c in out.columns])
    return out


def metrics_grid(df: DataFrame, targets: dict, scores: dict, by=(), threshold: float = 0.5,
                 modes=("fixed_threshold", "optimal_youden_threshold"), **bucket_opts) -> DataFrame:
    """Every (target, score) cell x mode in ONE pass.

    ``targets``/``scores`` map output names to Columns.  The row-level data is
    unpivoted once to (target, score_name, y, score) and the curve job runs with
    ``by=[..., target, score_name]``: one shuffle for all cells instead of a job
    per cell."""
    by = list(by)
    cells = [F.struct(F.lit(tn).alias("target"), F.lit(sn).alias("score_name"),
                      _c(tc).cast("int").alias("y"), _c(sc).cast("double").alias("s"))
             for tn, tc in targets.items() for sn, sc in scores.items()]
    long = (df.select(*by, F.explode(F.array(*cells)).alias("__cell"))
            .select(*by, "__cell.target", "__cell.score_name",
                    F.col("__cell.y").alias("y"), F.col("__cell.s").alias("s")))
    return metrics_at_threshold(long, "y", "s", by=[*by, "target", "score_name"],
                                threshold=threshold, modes=modes, **bucket_opts)
