"""File sources and sinks on the driver tables: written to the shared folder, read back.

Each query writes a driver table through a sink (or as the files that a source reads) to
a folder of its own under the working folder, and returns what the source reads there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from caliper.operators import metrics
from caliper.plans.evaluation import doc_eval
from caliper.plans.registry import ORACLES, PLANS, plan, rounded
from caliper.plans.sources_plans import fetch_attempts
from caliper.plans.tables import table
from caliper.session import working_dir
from caliper.sources import readers as S
from caliper.sources import sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"


@plan("read_ids_orders", """
SELECT 'C' || CAST(o_custkey AS VARCHAR) AS id, min(2 * n) AS pos
FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY o_custkey""")
def read_ids_orders(spark, d):
    """An id list in a folder of several files, with repeats, blank lines and padding: each
    id once, at its first line in the order of paths and lines."""
    path = _folder(spark, "ids")
    n = F.col("o_custkey").cast("string")
    lines = F.posexplode(F.array(F.concat(F.lit("  C"), n, F.lit(" ")), F.lit(" "))).alias("i", "value")
    table(spark, d, "orders").select("o_orderkey", lines).orderBy("o_orderkey", "i").select("value") \
        .write.option("maxRecordsPerFile", 10_000).text(path)
    return S.read_ids(spark, path)


@plan("predictions_csv", """
SELECT o_orderkey AS id, o_totalprice AS score, nullif(o_orderstatus, 'P') AS label FROM orders""")
def predictions_csv(spark, d):
    """S9 + S2: predictions as CSV, read with types; a pandas spelling of missing is NULL."""
    path = _folder(spark, "predictions")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"),
        F.when(F.col("o_orderstatus") == "P", "NaN").otherwise(F.col("o_orderstatus")).alias("label"))
    sinks.write_predictions(o, path, fmt="csv")
    return S.read_table_csv(spark, path, StructType([
        StructField("id", LongType()), StructField("score", DoubleType()), StructField("label", StringType())]))


@plan("strings_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def strings_csv(spark, d):
    """S9 + S3: every column read back as text, missing as ''."""
    path = _folder(spark, "strings")
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    sinks.write_predictions(c, path, fmt="csv")
    return S.read_table_strings(spark, path)


@plan("file_payloads", """
SELECT p_size AS size, 'data:image/jpeg;base64,' || to_base64(encode('size ' || CAST(p_size AS VARCHAR) || chr(10))) AS data_url
FROM (SELECT DISTINCT p_size FROM part)""")
def file_payloads(spark, d):
    """S4 + S5: files listed under a folder tree by extension, and their content as URLs."""
    root = _folder(spark, "files")
    table(spark, d, "part").select("p_size").distinct() \
        .select("p_size", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("value")) \
        .write.partitionBy("p_size").text(root)
    files = S.read_file_catalog(spark, root, extensions=[".txt"], name_regex=r"^part-", with_content=True)
    return S.image_payloads(files).select(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("size"), "data_url")


@plan("class_map", """
SELECT n_nationkey AS class_idx, n_name AS class, CASE WHEN n_regionkey < 3 THEN r_name ELSE 'NA' END AS family
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def class_map(spark, d):
    """Index -> class and class -> family as JSON objects; a class without one is NA."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = []
    for name, key, value, rows in (("idx", "n_nationkey", "n_name", n), ("fam", "n_name", "r_name", n.where("n_regionkey < 3"))):
        paths.append(_folder(spark, name))
        pairs = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
        rows.agg(F.to_json(pairs).alias("value")).write.text(paths[-1])     # a model's class list: a few rows
    return S.read_class_map(spark, *paths)


@plan("metrics_json", ORACLES["binary_metrics_by_lang"])
def metrics_json(spark, d):
    """Metrics rows as JSON documents beside a block of notes, read back."""
    path = _folder(spark, "metrics")
    e = doc_eval(spark, d)
    m = rounded(metrics.binary_metrics(metrics.confusion_counts(
        e, "y_quality", (F.col("score") >= 0.5).cast("int"), ["lang"])))
    sinks.write_metrics(m, path, notes={"dataset": "documents"})
    back = spark.read.text(path).select(F.from_json("value", m.schema).alias("m")).select("m.*")
    return back.where(F.col("n").isNotNull())


@plan("metrics_nested", f"""
SELECT *, 'lineitem' AS dataset FROM ({ORACLES["metrics_grid"]})""")
def metrics_nested(spark, d):
    """S10 as one nested document (target, score, mode) with its notes, read back."""
    path, levels = _folder(spark, "nested"), ["target", "score_name", "mode"]
    m = PLANS["metrics_grid"](spark, d)
    sinks.write_metrics_nested(m, path, levels, notes={"dataset": "lineitem"})
    values = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in m.schema.fields if f.name not in levels)
    rows, notes = sinks.read_metrics_nested(spark, path, levels, values)
    note = notes.agg(F.max(F.when(F.col("note") == "dataset", F.col("value"))).alias("dataset"))
    return metrics.attach_single_row(rows.select(*m.columns), note)


@plan("failure_log", f"""
SELECT id, _status AS message FROM ({ORACLES["fetch_status"]}) WHERE NOT starts_with(_status, 'OK')""")
def failure_log(spark, d):
    """The log of failed fetches as text lines, read back."""
    path = _folder(spark, "failures")
    sinks.write_failures(S.fetch_status(fetch_attempts(spark, d)), "id", "_status", path)
    part = F.split("value", "\t", 2)
    return spark.read.text(path).select(part[0].alias("id"), part[1].alias("message"))
