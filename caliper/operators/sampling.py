"""Reproducible sampling.

The random order is a pure function of (seed, id): ``md5(seed || id)``, the same
in any engine, so a sample is reproducible across runs, retries and engines
(unlike ``sampleBy``, whose sizes are approximate and depend on partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliper.operators.prefix import broadcast_if_small, materialize

#: The key's first hex digits, as a number, are its cell: COARSE digits in the first count, FINE in the second.
COARSE, FINE = 3, 7


def sample_key(id_col, seed) -> Column:
    """md5 of seed || id (hex text, ordered as text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), c.cast("string")))


def _cells(key: str, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def _cell_of_nth(counts: DataFrame, cls: str, n) -> DataFrame:
    """Of rows (cls, cell, rows): per class the cell in which its n-th row lies, and how many rows
    stand before it; a class with fewer rows is absent."""
    before = F.sum("rows").over(Window.partitionBy(cls).orderBy("cell")) - F.col("rows")
    return counts.withColumn("before", before).where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n))


def sample_per_class(df: DataFrame, cls: str, n: int, seed, id_col: str,
                     salt_buckets: int | None = None) -> DataFrame:
    """Exactly min(n, class size) rows per class, without replacement: those of the n least
    sample keys (ties by id).

    Two counting passes find each class's cut-off: a histogram over the first digits of the key tells
    the cell of the n-th row, a second one over further digits, inside that cell alone, a cell of
    16 ** (FINE - COARSE) times fewer rows.  Rows before it are in, with no sort; only the rows of the
    cut-off cell are ordered.  A histogram has at most 16 ** COARSE (then 16 ** (FINE - COARSE)) rows a
    class, added up on the map side, whatever the class's size."""
    key, same = sample_key(id_col, seed), F.col(f"`{cls}`").eqNullSafe(F.col("__of"))
    keyed = df.select(F.col(f"`{cls}`").alias("__class"), key.alias("__k"))
    rough = keyed.groupBy("__class", _cells("__k", COARSE).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    first = materialize(_cell_of_nth(rough, "__class", n).select(
        F.col("__class").alias("__of"), F.col("cell").alias("__cell"), F.col("before").alias("__before")))
    inside = keyed.join(broadcast_if_small(first), F.col("__class").eqNullSafe(F.col("__of")) & (_cells("__k", COARSE) == F.col("__cell")))
    fine = inside.groupBy("__of", "__before", _cells("__k", FINE).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    cut = materialize(_cell_of_nth(fine, "__of", F.lit(n) - F.col("__before")).select(
        "__of", F.col("cell").alias("__cut"), (F.lit(n) - F.col("__before") - F.col("before")).alias("__left"), F.lit(True).alias("__big")))
    rows = df.withColumn("__k", key).join(broadcast_if_small(cut), same, "left")
    rows = rows.withColumn("__cell", _cells("__k", FINE))
    sure = rows.where(F.col("__big").isNull() | (F.col("__cell") < F.col("__cut")))
    order = Window.partitionBy("__of").orderBy("__k", F.col(f"`{id_col}`"))
    edge = rows.where(F.col("__cell") == F.col("__cut")).withColumn("__r", F.row_number().over(order)) \
        .where(F.col("__r") <= F.col("__left"))
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def sample_n(df: DataFrame, n: int, seed, id_col: str) -> DataFrame:
    """N rows in md5(seed || id) order (a top-n: each task keeps its n smallest)."""
    return (df.withColumn("__k", sample_key(id_col, seed)).orderBy("__k", id_col).limit(n)
            .drop("__k"))
