"""Shared helpers: shared-folder tables, row keys, batched Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caliper.operators.prefix import materialize
from caliper.session import bounded_batches

#: Text bytes handled at once inside a task; longer texts are handled alone.
CHUNK_BYTES = 1 << 20


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage)."""
    return materialize(df)


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """``k1, k2``: a key that every row has, null ids and repeated ids included.

    Rows that agree in both id and text get one key; all that is derived per key
    depends on the text alone, so they may share it."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k1"),
            F.xxhash64(F.lit(1), F.col(text)).alias("k2")]


#: Up to so many row keys (16 bytes each) are broadcast to take rows out, else joined.
MOST_BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row key is not among ``keys`` (k1, k2)."""
    few = keys.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    return rows.join(F.broadcast(keys) if few else keys, ["k1", "k2"], "leftanti").select("row.*")


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``most`` text bytes (or one row)."""
    if not batch.num_rows:
        return
    arr = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(arr), 0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
             schema: str | StructType, column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size; ``fn`` yields record batches."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                yield from fn(part)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
