"""Incremental evaluation: score only what is new, report on the whole store.

Batch form: anti-join the cases against the store's done keys, score the
remainder, append, then report over the whole store.  Streaming form: the same
per micro-batch with ``foreachBatch``.  Both may share a store: every row carries the
number of its run, and a manifest beside the store has one row for each finished run
(number, kind, stream and batch id), written after the run's rows.  A micro-batch that is
replayed is known by its stream and batch id and does nothing; one that failed between its
rows and its manifest row is checked against the store's keys, so no key is appended twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.functions.text import strip
from caliper.operators.linkage import not_yet_done
from caliper.sources.sinks import append_predictions


RUN = "_run"
MANIFEST = "run long, kind string, stream string, batch_id long, finished timestamp"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder, or None if nothing was ever written there.  Any other failure to
    read it is raised: it must not look like an empty store."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_store(spark: SparkSession, store_path: str) -> DataFrame | None:
    """The store, or None if there is none.  Rows that carry no run are of run 0."""
    store = _read(spark, store_path)
    if store is None:
        return None
    run = F.coalesce(F.col(RUN), F.lit(0).cast("long")) if RUN in store.columns else F.lit(0).cast("long")
    return store.withColumn(RUN, run)


def read_manifest(spark: SparkSession, store_path: str) -> DataFrame:
    """The finished runs of a store: run, kind (batch or stream), stream, batch_id, finished."""
    runs = _read(spark, _manifest_path(store_path))
    return _manifest_rows(spark.range(0)) if runs is None else runs


def _manifest_rows(like: DataFrame, *values) -> DataFrame:
    """One row of the manifest for each row of ``like``; made in the JVM, so that no executor
    starts Python workers (of another kind than the scorer's) for it."""
    fields = [f.split() for f in MANIFEST.split(", ")]
    values += (None,) * (len(fields) - len(values))
    return like.select(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, fields, strict=True)])


def _manifest_path(store_path: str) -> str:
    return store_path.rstrip("/") + "-runs"


def _next_run(spark: SparkSession, store_path: str, store: DataFrame | None) -> int:
    """One more than any run of the manifest, or of rows whose run did not reach it."""
    found = [read_manifest(spark, store_path).agg(F.max("run")).first()[0]]
    if store is not None:
        found.append(store.agg(F.max(RUN)).first()[0])
    return max((x for x in found if x is not None), default=-1) + 1


def _finish(spark: SparkSession, store_path: str, run: int, kind: str, stream: str | None = None,
            batch_id: int | None = None) -> None:
    row = _manifest_rows(spark.range(1, numPartitions=1), run, kind, stream, batch_id)
    row.withColumn("finished", F.current_timestamp()).write.mode("append").parquet(_manifest_path(store_path))


def _fine(error_col: str):
    return F.coalesce(strip(F.col(error_col)), F.lit("")) == ""


def done_keys(spark: SparkSession, store_path: str, key: str, retry_errors: bool = False,
              error_col: str = "_error") -> DataFrame | None:
    """Keys already in the store; no store -> None (nothing done).  Error rows count as
    done unless ``retry_errors`` (quirk Q6)."""
    store = read_store(spark, store_path)
    if store is None:
        return None
    if retry_errors and error_col in store.columns:
        store = store.where(_fine(error_col))
    return store.select(key)


def latest_rows(store: DataFrame, key: str, error_col: str = "_error") -> DataFrame:
    """One row per key: of a key that was tried again, the row of its latest run.  A key
    is only tried again after an error, so only error rows are grouped and joined."""
    if error_col not in store.columns:
        return store
    fine, bad = store.where(_fine(error_col)), store.where(~_fine(error_col))
    cols = F.struct(*[F.col(f"`{c}`") for c in store.columns])
    last = (bad.join(fine.select(key), key, "left_anti").groupBy(key)
            .agg(F.max_by(cols, F.col(RUN)).alias("__r")).select("__r.*"))
    return fine.unionByName(last)


def _score_new(spark, cases, key, store_path, score, run, retry_errors, error_col) -> None:
    todo = not_yet_done(cases, done_keys(spark, store_path, key, retry_errors, error_col), key)
    if todo.limit(1).count():
        append_predictions(score(todo).withColumn(RUN, F.lit(run).cast("long")), store_path)


def incremental_eval(spark: SparkSession, cases: DataFrame, key: str, store_path: str,
                     score, report=None, retry_errors: bool = False,
                     error_col: str = "_error") -> DataFrame | None:
    """Score ``not_yet_done(cases)`` with ``score(df) -> df``, append the rows with
    the number of this run, and return ``report`` over the latest row of every key."""
    run = _next_run(spark, store_path, read_store(spark, store_path))
    _score_new(spark, cases, key, store_path, score, run, retry_errors, error_col)
    _finish(spark, store_path, run, "batch")
    store = read_store(spark, store_path)
    if store is None:
        return None
    whole = latest_rows(store, key, error_col)
    return report(whole) if report else whole


def stream_into_store(stream: DataFrame, key: str, store_path: str, score, checkpoint: str,
                      trigger_once: bool = True, retry_errors: bool = False, error_col: str = "_error"):
    """X3 over Structured Streaming: each micro-batch is a run of the store; it is
    anti-joined against the store, scored and appended (``foreachBatch``).  The checkpoint
    names the stream in the manifest.  Returns the started query."""
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int):
        runs = read_manifest(spark, store_path)
        if runs.where((F.col("stream") == checkpoint) & (F.col("batch_id") == batch_id)).limit(1).count():
            return
        run = _next_run(spark, store_path, read_store(spark, store_path))
        _score_new(spark, batch.dropDuplicates([key]), key, store_path, score, run, retry_errors, error_col)
        _finish(spark, store_path, run, "stream", checkpoint, batch_id)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
