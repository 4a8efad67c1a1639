"""Sinks: predictions, metrics, appends and failure logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """Predictions table (CSV with header, or Parquet); parent folders are created
    by the writer."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append new rows to the store (the header concern of CSV does not apply
    to Parquet; the schema is kept by the files)."""
    df.write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str, notes: dict | None = None) -> None:
    """A folder of text files with one JSON document per metrics row plus an optional
    notes block, each written by the task that has the row."""
    out = metrics.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in metrics.columns]))
                         .alias("value"))
    if notes:
        note = metrics.sparkSession.createDataFrame([(json.dumps({"notes": notes}),)], "value string")
        out = out.unionByName(note)
    out.write.mode("overwrite").text(path)


def write_failures(df: DataFrame, id_col: str, status_col: str, path: str) -> None:
    """Rows whose status does not start with OK, as ``id <TAB> message``."""
    bad = df.where(~F.coalesce(F.col(status_col), F.lit("")).startswith("OK"))
    bad.select(F.concat_ws("\t", F.col(id_col).cast("string"), F.col(status_col)).alias("value")) \
        .write.mode("overwrite").text(path)


def nested_metrics(metrics: DataFrame, levels) -> DataFrame:
    """(key, v): one row for each value of the outermost level, with the levels below as nested
    maps, e.g. levels [target, score_name, mode] -> target, {score_name: {mode: {metric: value}}}.
    Built by successive ``map_from_entries`` aggregates, innermost level first; the outermost
    level is never gathered.  A NULL key reads ``null``."""
    levels = list(levels)
    values = [c for c in metrics.columns if c not in levels]
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")).alias(c) for c in levels]
    cur = metrics.select(*text, F.struct(*[F.col(f"`{c}`") for c in values]).alias("v"))
    for i in range(len(levels) - 1, 0, -1):
        cur = cur.groupBy(*levels[:i]).agg(F.map_from_entries(F.collect_list(F.struct(levels[i], "v"))).alias("v"))
    return cur.select(F.col(levels[0]).alias("key"), "v")


_HEAD, _TAIL = '{"metrics": {', "}"


def write_metrics_nested(metrics: DataFrame, path: str, levels, notes: dict | None = None,
                         csv_path: str | None = None) -> None:
    """S10 as nested JSON (one document, plus a ``notes`` block) and, optionally, the
    flat metrics rows as CSV with a header.

    The document is a folder of text files whose lines, files by name, are the JSON text: an
    opening line, a line for each outermost key in order, and a closing line with the notes.
    So each line is written by the task that has its key, and no row holds the document."""
    rows = nested_metrics(metrics, levels)
    first = rows.agg(F.min("key")).first()[0]
    entry = F.concat(F.when(F.col("key") == F.lit(first), F.lit("")).otherwise(F.lit(",")),
                     F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(": "), F.to_json("v"))
    close = _TAIL + (f', "notes": {json.dumps(notes)}' if notes else "") + "}"
    ends = metrics.sparkSession.createDataFrame([(0, "", _HEAD), (2, "", close)], "part int, key string, value string")
    lines = rows.select(F.lit(1).alias("part"), "key", entry.alias("value")).unionByName(ends)
    lines.orderBy("part", "key").select("value").write.mode("overwrite").text(path)
    if csv_path:
        metrics.orderBy(*levels).write.mode("overwrite").option("header", True).csv(csv_path)


def read_metrics_nested(spark: SparkSession, path: str, levels, values: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_metrics_nested`` wrote: the flat rows (levels and the columns of the schema
    ``values``), read line by line, and the notes (note, value)."""
    levels = list(levels)
    lines = spark.read.text(path)
    entry = lines.where(F.col("value").startswith('"') | F.col("value").startswith(',"'))
    inner = f"struct<{values}>"
    for _ in levels[1:]:
        inner = f"map<string,{inner}>"
    body = F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}"))
    rows = entry.select(F.explode(F.from_json(body, f"map<string,{inner}>")).alias(levels[0], "v"))
    for i, level in enumerate(levels[1:], 1):
        rows = rows.select(*levels[:i], F.explode("v").alias(level, "v"))
    close = lines.where(F.col("value").startswith(_TAIL + ", "))
    notes = close.select(F.explode(F.from_json(F.concat(F.lit("{"), F.substring("value", len(_TAIL) + 3, 1 << 30)),
                                               "notes map<string,string>")["notes"]).alias("note", "value"))
    return rows.select(*levels, "v.*"), notes
