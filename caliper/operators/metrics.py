"""Confusion counts, binary metrics and report aggregates.

All are single hash aggregates (partial aggregation map-side, one shuffle on the
group keys, a handful of counters per group), so they scale with the data and
are insensitive to skew: a hot group only adds to its counters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions.text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attach_single_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (a global ``agg``) to every row of
    ``df`` as one scalar subquery (evaluated once, no join of any kind)."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in one_row.columns])


def confusion_counts(df: DataFrame, y, pred, by=()) -> DataFrame:
    """A1: tp, fp, tn, fn, n per group (rows with a null label or prediction are
    not counted).  Always four counts, even with one class (quirk Q1)."""
    yy, pp = _c(y).cast("int"), _c(pred).cast("int")
    valid = yy.isNotNull() & pp.isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(valid & (yy == 1) & (pp == 1)).alias("tp"),
        F.count_if(valid & (yy != 1) & (pp == 1)).alias("fp"),
        F.count_if(valid & (yy != 1) & (pp != 1)).alias("tn"),
        F.count_if(valid & (yy == 1) & (pp != 1)).alias("fn"),
        F.count_if(valid).alias("n"),
    )


def binary_metrics(counts: DataFrame, style: str = "zero_division") -> DataFrame:
    """A2 (``zero_division``): recall, precision, f1 -> 0 when undefined; specificity
    and npv -> null when undefined; accuracy null for n = 0.

    A3 (``eps``): every denominator max(x, 1), f1 denominator max(p + r, 1e-12); all
    defined; also the matrix [[tn, fp], [fn, tp]]."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    if style == "zero_division":
        return counts.withColumns({
            "accuracy": F.try_divide((tp + tn).cast("double"), n),
            "recall": F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)),
            "specificity": F.try_divide(tn.cast("double"), tn + fp),
            "precision": F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)),
            "npv": F.try_divide(tn.cast("double"), tn + fn),
            "f1": F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0)),
        })
    if style == "eps":
        sens = tp.cast("double") / F.greatest(tp + fn, F.lit(1))
        prec = tp.cast("double") / F.greatest(tp + fp, F.lit(1))
        return counts.withColumns({
            "accuracy": (tp + tn).cast("double") / F.greatest(n, F.lit(1)),
            "recall": sens,
            "specificity": tn.cast("double") / F.greatest(tn + fp, F.lit(1)),
            "precision": prec,
            "f1": (2 * prec * sens) / F.greatest(prec + sens, F.lit(1e-12)),
            "confusion_matrix": F.array(F.array(tn, fp), F.array(fn, tp)),
        })
    raise ValueError(f"unknown style {style!r}")


def binary_metrics_label(df: DataFrame, truth, pred, positive: str = "melanoma",
                         labels=("non-melanoma", "melanoma"), by=(),
                         missing_pred: str = "exclude") -> DataFrame:
    """A4: accuracy, precision, recall, f1 and the matrix with named labels, rows =
    truth in ``labels`` order (negative first).  A NULL prediction (a case the
    scorer never answered, after a left join) is excluded by default;
    ``missing_pred="negative"`` scores it as the negative label, as the original
    evaluation did (quirk Q3)."""
    y = (_c(truth) == positive).cast("int")
    p = (_c(pred) == positive)
    if missing_pred == "negative":
        p = F.coalesce(p, F.lit(False))
    elif missing_pred != "exclude":
        raise ValueError("missing_pred must be 'exclude' or 'negative'")
    p = p.cast("int")
    c = binary_metrics(confusion_counts(df, y, p, by))
    return c.select(
        *by, "n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1",
        F.array(*[F.lit(x) for x in labels]).alias("labels"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))


def label_report(df: DataFrame, y, pred, score, by=(), **bucket_opts) -> DataFrame:
    """A5: accuracy, sensitivity, specificity (null when undefined), AUROC (null for
    one class) and the matrix ordered [positive, negative]: [[tp, fn], [fp, tn]]."""
    from caliper.operators.curves import curve_summary

    by = list(by)
    c = confusion_counts(df, y, pred, by)
    auc = curve_summary(df, y, score, by, thresholds=(), **bucket_opts).select(*by, "roc_auc")
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.select(
        *by, "n", "tp", "fp", "tn", "fn",
        F.try_divide((tp + tn).cast("double"), tp + fp + tn + fn).alias("accuracy"),
        F.try_divide(tp.cast("double"), tp + fn).alias("sensitivity"),
        F.try_divide(tn.cast("double"), tn + fp).alias("specificity"),
        F.array(F.array(tp, fn), F.array(fp, tn)).alias("matrix"))
    if by:
        right = auc.select(*[F.col(b).alias(f"__of_{b}") for b in by], "roc_auc")
        same = reduce(lambda x, z: x & z, [F.col(b).eqNullSafe(F.col(f"__of_{b}")) for b in by])
        return out.join(right, same, "left").drop(*[f"__of_{b}" for b in by])
    return attach_single_row(out, auc)


def eval_counts(df: DataFrame, truth, pred, error=None, by=(),
                missing_pred: str = "exclude") -> DataFrame:
    """n_total, n_with_truth, n_with_pred, n_evaluated (truth and prediction
    non-blank, no error).  ``missing_pred="negative"`` counts a NULL prediction as
    present (the original evaluation's NaN != "" behaviour, quirk Q3)."""
    t = F.coalesce(strip(_c(truth).cast("string")), F.lit("")) != ""
    if missing_pred == "negative":
        p = _c(pred).isNull() | (strip(_c(pred).cast("string")) != "")
    else:
        p = F.coalesce(strip(_c(pred).cast("string")), F.lit("")) != ""
    ok = t & p
    if error is not None:
        ok = ok & (F.coalesce(strip(_c(error)), F.lit("")) == "")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(t).alias("n_with_truth"),
        F.count_if(p).alias("n_with_pred"),
        F.count_if(ok).alias("n_evaluated"),
    )


def hit_rates(df: DataFrame, flags: dict, by=()) -> DataFrame:
    """Mean of 0/1 (or boolean) flags plus n.  ``flags`` maps output name to column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.coalesce(_c(c).cast("double"), F.lit(0.0))).alias(name)
          for name, c in flags.items()])


def accuracy_check(df: DataFrame, truth, pred, by=()) -> DataFrame:
    """Exact label equality rate, recomputed from the labels themselves."""
    return df.groupBy(*by).agg(
        F.avg(F.coalesce(_c(truth) == _c(pred), F.lit(False)).cast("double"))
        .alias("accuracy_check"))


def mapping_coverage(df: DataFrame, mapped, by=()) -> DataFrame:
    """Share of rows whose prediction mapped to a known group."""
    return df.groupBy(*by).agg(F.avg(_c(mapped).isNotNull().cast("double"))
                               .alias("mapping_coverage"))


def class_balance(df: DataFrame, targets, by=()) -> DataFrame:
    """N and number of positives per target column (long output)."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), _c(t).cast("long").alias("v"))
                      for t in targets])
    return (df.select(*by, F.explode(cells).alias("__t"))
            .groupBy(*by, F.col("__t.target").alias("target"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum("__t.v"), F.lit(0)).cast("long").alias("n_positive")))


def truth_vocabulary(df: DataFrame, col, n: int = 50) -> DataFrame:
    """Sorted distinct non-null values (first ``n``) with the total distinct count
    on every row.  ``distinct`` is a hash aggregate; the head is a top-n sort."""
    d = df.select(_c(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    total = d.agg(F.count(F.lit(1)).alias("n_distinct"))
    head = d.orderBy("value").limit(n)
    return attach_single_row(head, total).select(
        "value", "n_distinct", F.greatest(F.col("n_distinct") - F.lit(n), F.lit(0)).alias("n_more"))


def fold_mean_sd(df: DataFrame, keys, value) -> DataFrame:
    """Mean and sample sd of a value across folds (one row per key)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("sd"))


def metrics_by_group(df: DataFrame, y, pred, score, by: str, **bucket_opts) -> DataFrame:
    """The label report per group value; the NULL group is dropped (its rows
    still count in an overall report), groups come out in key order, and a group
    with one class has a NULL AUROC."""
    return label_report(df.where(F.col(by).isNotNull()), y, pred, score, by=[by],
                        **bucket_opts).orderBy(by)
