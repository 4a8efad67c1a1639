"""Ensembling of model scores: fold means, family roll-ups, top-k families,
checkpoint -> architecture -> ensemble means and average-tie percentile ranks.

Layout: scores are *long* tables, ``(row, fold, logits array)`` or
``(row, checkpoint, arch, prob)``.  Work that is per row (softmax, family sums,
top-k) runs after a single hash partitioning on the row key, which every later
per-row aggregate reuses (``HashPartitioning(row)`` satisfies clustering on
``(row, anything)``), so the chain costs one shuffle.  The percentile rank is a
per-architecture ordering over *all* rows; it uses the bucketed running sum, not
a one-partition window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.functions import rules
from caliper.operators import prefix


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(arr) -> Column:
    """exp-normalise one vector (max-subtracted), as an array expression.

    The per-vector max and sum are passed into the element lambdas through
    ``zip_with`` with ``array_repeat`` instead of being referenced inside the lambda:
    a lambda that references an outer aggregate re-evaluates it for every element
    (quadratic, cubic when nested)."""
    a = _c(arr).cast("array<double>")
    n = F.size(a)
    e = F.zip_with(a, F.array_repeat(F.array_max(a), n), lambda x, m: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(e, F.array_repeat(total, n), lambda x, t: x / t)


def class_probabilities(df: DataFrame, row: str, fold: str, logits: str) -> DataFrame:
    """A20 (+F21): per (row, class_idx) mean and sample sd over folds of the softmax
    of each fold's logits.  Repartitioned on ``row`` once; the aggregate and the
    per-row operators downstream reuse that partitioning."""
    probs = (df.select(row, fold, softmax(logits).alias("__p"))
             .repartition(row)
             .select(row, fold, F.posexplode("__p").alias("class_idx", "p")))
    return probs.groupBy(row, "class_idx").agg(
        F.avg("p").alias("mean"), F.stddev_samp("p").alias("sd"))


def class_dim(spark, n_classes: int, class_name, family) -> DataFrame:
    """Class dimension (class_idx, class, family) from Column rules over the index."""
    return (spark.range(n_classes).select(F.col("id").cast("int").alias("class_idx"))
            .select("class_idx", class_name(F.col("class_idx")).alias("class"),
                    family(F.col("class_idx")).alias("family")))


def map_class_to_family(scores: DataFrame, dim: DataFrame,
                        unmapped: str = rules.UNMAPPED_FAMILY) -> DataFrame:
    """Attach class name and family (unmapped -> 'NA').  The dim has one row per
    class of the model (48 in the study); it is broadcast after a row-count check."""
    d = prefix.broadcast_if_small(dim.select("class_idx", "class", "family"))
    return (scores.join(d, "class_idx", "left")
            .withColumn("family", F.coalesce(F.col("family"), F.lit(unmapped))))


def family_probability(scores: DataFrame, row: str, prob: str = "mean") -> DataFrame:
    """Sum of class probabilities per (row, family)."""
    return scores.groupBy(row, "family").agg(F.sum(prob).alias("prob"))


def composite_probability(fam: DataFrame, row: str, prob: str = "prob",
                          malignant=rules.MALIGNANT_FAMILIES,
                          premalignant=rules.PREMALIGNANT_FAMILIES,
                          benign=rules.BENIGN_FAMILIES) -> DataFrame:
    """Invasive, premalignant, concerning (= both) and benign sums per row;
    a family absent from the row contributes 0."""
    def s(fams):
        return F.sum(F.when(F.col("family").isin(list(fams)), F.col(prob)).otherwise(0.0))
    return fam.groupBy(row).agg(
        s(malignant).alias("invasive"), s(premalignant).alias("premalignant"),
        s(list(malignant) + list(premalignant)).alias("concerning"), s(benign).alias("benign"))


def family_wide(fam: DataFrame, row: str, families=rules.MODEL_FAMILIES, prob: str = "prob",
                prefix_name: str = "family_prob_") -> DataFrame:
    """A21 wide output: one column per known family (fixed list, so no key job)."""
    return (fam.groupBy(row).pivot("family", list(families)).agg(F.first(prob))
            .select(row, *[F.coalesce(F.col(f), F.lit(0.0)).alias(prefix_name + f)
                           for f in families]))


def top_families(scores: DataFrame, row: str, k: int = 3, prob: str = "mean") -> DataFrame:
    """Rank classes by probability (ties: lower class index first), keep the
    first class of each family, stop at k families.  One row per input row with
    ``top`` = array<struct(diagnosis, family, probability)> of length <= k.

    Per row the candidate list is one entry per family (bounded by the number of
    families), built with a ``max_by`` aggregate, then sorted as a small array."""
    best = scores.groupBy(row, "family").agg(
        F.max_by(F.struct(F.col("class").alias("diagnosis"), F.col(prob).alias("probability"),
                          F.col("class_idx")),
                 F.struct(F.col(prob), -F.col("class_idx"))).alias("b"))
    ranked = best.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("b.probability")).alias("neg_p"), F.col("b.class_idx").alias("idx"),
        F.col("b.diagnosis").alias("diagnosis"), F.col("family"),
        F.col("b.probability").alias("probability")))).alias("cands"))
    return ranked.select(row, F.transform(F.slice("cands", 1, k), lambda c: F.struct(
        c["diagnosis"].alias("diagnosis"), c["family"].alias("family"),
        c["probability"].alias("probability"))).alias("top"))


def class_outputs(scores: DataFrame, row: str, k: int = 3, families=rules.MODEL_FAMILIES,
                  concerning=(*rules.MALIGNANT_FAMILIES, *rules.PREMALIGNANT_FAMILIES)) -> DataFrame:
    """A21 + A22 + T1 of a row at once: ``top``, ``family_prob_<F>`` and ``concerning``.

    One aggregate per (row, family) and one per row, on the partitioning of the row key,
    so the class scores are computed once and nothing is joined back."""
    best = scores.groupBy(row, "family").agg(
        F.sum("mean").alias("prob"),
        F.max_by(F.struct(F.col("class").alias("diagnosis"), F.col("mean").alias("probability"), F.col("class_idx")),
                 F.struct(F.col("mean"), -F.col("class_idx"))).alias("b"))
    per_row = best.groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("b.probability")).alias("neg_p"), F.col("b.class_idx").alias("idx"),
            F.col("b.diagnosis").alias("diagnosis"), F.col("family"),
            F.col("b.probability").alias("probability")))).alias("cands"),
        F.sum(F.when(F.col("family").isin(list(concerning)), F.col("prob")).otherwise(0.0)).alias("concerning"),
        *[F.coalesce(F.max(F.when(F.col("family") == f, F.col("prob"))), F.lit(0.0)).alias(f"family_prob_{f}")
          for f in families])
    return per_row.select(row, F.transform(F.slice("cands", 1, k), lambda c: F.struct(
        c["diagnosis"].alias("diagnosis"), c["family"].alias("family"),
        c["probability"].alias("probability"))).alias("top"), "concerning", *[f"family_prob_{f}" for f in families])


def topk_columns(col: str = "top", k: int = 3) -> list:
    """T2 columns: top{r}_diagnosis / _family / _probability for r = 1..k."""
    cols = []
    for r in range(1, k + 1):
        e = F.get(F.col(col), r - 1)
        cols += [e["diagnosis"].alias(f"top{r}_diagnosis"), e["family"].alias(f"top{r}_family"),
                 e["probability"].alias(f"top{r}_probability")]
    return cols


def topk_wide(top: DataFrame, row: str, k: int = 3, col: str = "top") -> DataFrame:
    """The wide top-k layout."""
    return top.select(row, *topk_columns(col, k))


def topk_hit(top_col, truth, k: int | None = None) -> Column:
    """Truth family among the first k families of the top list."""
    arr = _c(top_col) if k is None else F.slice(_c(top_col), 1, k)
    return F.coalesce(F.array_contains(F.transform(arr, lambda c: c["family"]), _c(truth)),
                      F.lit(False))


def ensemble_mean(long: DataFrame, row: str = "row_id", arch: str = "arch",
                  prob: str = "prob") -> DataFrame:
    """Checkpoint -> architecture mean -> ensemble mean (architectures weigh
    equally); nulls skipped.  This is the first level, (row, arch, arch_mean); the
    second level is the mean over architectures in ``ensemble_scores``."""
    return long.groupBy(row, arch).agg(F.avg(prob).alias("arch_mean"))


def pct_rank_avg(df: DataFrame, by, col: str, out: str = "pct_rank", **bucket_opts) -> DataFrame:
    """Ascending rank with ties averaged, divided by the number of non-null
    values in the group; null stays null (pandas ``rank(pct=True)``).

    Distinct (group, value) counts -> bucketed running count -> join back on
    (group, value).  The input is written once, so that both sides of the join read
    the same doubles.  Rows without a value need no rank and stay out of the join; a
    hot value is one row of its right side and AQE splits its left side."""
    by = list(by)
    df = prefix.materialize(df)
    there = F.col(col).isNotNull() & ~F.isnan(F.col(col))
    vals = df.where(there).groupBy(*by, col).agg(F.count(F.lit(1)).alias("c"))
    rs = prefix.running_sums(vals, by, col, ["c"], descending=False, inclusive=True,
                             **bucket_opts)
    ranks = rs.select(*[F.col(b).alias(f"__r_{b}") for b in by], F.col(col).alias("__r_value"),
                      ((F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2.0)
                       / F.col("tot_c")).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__r_{b}")) for b in by],
                  F.col(col) == F.col("__r_value"))
    ranked = df.where(there).join(ranks, same).select(*df.columns, out)
    return ranked.unionByName(df.where(~F.coalesce(there, F.lit(False))).withColumn(out, F.lit(None).cast("double")))


def ensemble_scores(long: DataFrame, row: str = "row_id", arch: str = "arch",
                    prob: str = "prob", **bucket_opts) -> DataFrame:
    """A23 + A24: per row ``prob_ensemble`` (mean over architecture means) and
    ``rank_ensemble`` (mean over architectures of the per-architecture percentile
    rank of the architecture mean, over all rows)."""
    by_arch = ensemble_mean(long, row, arch, prob)
    ranked = pct_rank_avg(by_arch, [arch], "arch_mean", out="arch_rank", **bucket_opts)
    return ranked.groupBy(row).agg(F.avg("arch_mean").alias("prob_ensemble"),
                                   F.avg("arch_rank").alias("rank_ensemble"))


def wide_checkpoint_matrix(long: DataFrame, checkpoints, row: str = "row_id",
                           checkpoint: str = "checkpoint", prob: str = "prob") -> DataFrame:
    """One column per checkpoint keyed by row (the checkpoint list is passed: a
    model roster, fixed and small)."""
    return long.groupBy(row).pivot(checkpoint, list(checkpoints)).agg(F.first(prob))
