"""Distributed running sums over an ordered key, per group.

Spark has no scan primitive, and ``Window.partitionBy(group).orderBy(key)`` puts
a whole group in one task (a hot group holding a third of the rows would be a
third of the job in one task; without a group it is the whole table).  The
classic two-level scan fixes that, with one plan for every size:

1. range-partition by ``(group, key)``; the partition a row lies in is its bucket,
   frozen by writing the rows once to the shared folder,
2. totals per ``(group, bucket)``: a small table, scanned per group,
3. running sums inside each ``(group, bucket)`` window partition plus the
   offset of all earlier buckets of the group.

Range partitions are even whatever the skew between groups, and the number of
buckets follows the shuffle partitions that the cluster sets (AQE merges small
ones), so no literal list of split points bounds it.  Input is expected to be
already reduced to one row per distinct ``(group, key)`` (callers aggregate first
with map-side partial aggregation, so a hot *key value* collapses to a single row
before any shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _GROUP = "__bucket", "__group"
MAX_BROADCAST_DIM_ROWS = 100_000


def broadcast_if_small(dim: DataFrame, max_rows: int = MAX_BROADCAST_DIM_ROWS) -> DataFrame:
    """Broadcast hint for a dimension only after counting it (one small job):
    above ``max_rows`` the join is left to the planner (shuffle join)."""
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once as Parquet under the session's checkpoint
    folder (the shared folder a cluster names in ``spark.checkpoint.dir``, see
    ``caliper.session``) and read it back: later passes read the compact result
    instead of recomputing scan + shuffle, lineage is cut so a lost executor does
    not replay the upstream plan, and the read-back keeps real size statistics and
    column pruning (an RDD checkpoint keeps neither)."""
    import uuid

    from caliper.session import working_dir

    path = f"{working_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table that ``materialize`` wrote for ``df``, once nothing reads it any more, and let
    Spark's cleaner drop the shuffle files of finished jobs: it does so when the driver's garbage is
    collected, which long loops of small jobs otherwise rarely bring about."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._jvm.System.gc()


def bucketed(df: DataFrame, by, key: str, buckets: int | None = None) -> DataFrame:
    """``df``, written once, with ``__bucket``: the range partition of ``(by, key)``, so
    that buckets are non-decreasing in the key inside a group."""
    cols = [F.col(c).asc_nulls_first() for c in [*by, key]]
    ranged = df.repartitionByRange(*([buckets] if buckets else []), *cols)
    return materialize(ranged.withColumn(_BUCKET, F.spark_partition_id()))


def running_sums(df: DataFrame, by, key: str, value_cols, descending: bool = False,
                 inclusive: bool = True, buckets: int | None = None,
                 most_broadcast: int = MAX_BROADCAST_DIM_ROWS) -> DataFrame:
    """For each row add ``cum_<v>`` = sum of ``v`` over rows of the same group whose
    key comes before (and, if inclusive, equals) this row's key in the given order,
    and ``tot_<v>`` = group total.  Keys must be unique within a group; a NULL group
    is a group like any other.  ``buckets`` fixes the number of range partitions."""
    by = list(by)
    rows = bucketed(df, by, key, buckets)
    key_order = F.col(key).desc() if descending else F.col(key).asc()
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    frame_end = Window.currentRow if inclusive else -1

    # The group as one value: structs with equal fields, NULLs included, are equal and hash alike,
    # so the join with the offsets and the window over the rows need one and the same partitioning.
    group = F.struct(*[F.col(f"`{b}`") for b in by]) if by else F.lit(0)
    rows = rows.withColumn(_GROUP, group)

    # (2) per-bucket totals: at most groups + buckets rows, as buckets cut the groups in a row.
    totals = rows.groupBy(_GROUP, _BUCKET).agg(*[F.sum(v).alias(f"__bt_{v}") for v in value_cols])
    w_before = (Window.partitionBy(_GROUP).orderBy(bucket_order)
                .rowsBetween(Window.unboundedPreceding, -1))
    w_group = Window.partitionBy(_GROUP)
    offsets = materialize(totals.select(
        _GROUP, _BUCKET,
        *[F.coalesce(F.sum(f"__bt_{v}").over(w_before), F.lit(0)).alias(f"__off_{v}")
          for v in value_cols],
        *[F.sum(f"__bt_{v}").over(w_group).alias(f"tot_{v}") for v in value_cols],
    ))
    # (3) running sums inside each (group, bucket) partition, plus the offset.  Offsets are broadcast up
    # to a counted bound; above it they are dealt as the window deals the rows: one move of the rows.
    w_in = (Window.partitionBy(_GROUP, _BUCKET).orderBy(key_order)
            .rowsBetween(Window.unboundedPreceding, frame_end))
    inside = rows.withColumns({f"__in_{v}": F.coalesce(F.sum(v).over(w_in), F.lit(0)) for v in value_cols})
    return inside.join(broadcast_if_small(offsets, most_broadcast), [_GROUP, _BUCKET]).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__off_{v}") + F.col(f"__in_{v}")).alias(f"cum_{v}") for v in value_cols],
        *[F.col(f"tot_{v}") for v in value_cols],
    )
