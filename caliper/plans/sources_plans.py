"""Sources, row ids, sampling, scoring and incremental runs on the driver tables.

Recipes (shared with the SQL oracles):
  * nested records: every event becomes ``{"event_type": .., "props": <props>,
    "tags": [user_id, "x"], "empty": {}, "none": null}`` (flattened, then widened).
  * row ids: orders in ``o_orderkey`` order; first occurrence of each customer id.
  * samples: customers by market segment, key md5('42' || c_custkey).
  * fetch attempts: per order, metadata outcome by status (F ok, O HTTP 404, P an
    error) and image attempts over the four sources, successes by key residues.
  * scoring: a deterministic stub scorer over document texts (the user's model in
    real use): score = (number of characters % 97) / 97.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caliper.functions import rules
from caliper.operators import linkage as J
from caliper.operators import sampling, scoring
from caliper.plans.registry import plan, rounded
from caliper.plans.tables import dealt, table
from caliper.session import working_dir
from caliper.sources import readers as S
from caliper.streaming import incremental


def nested_events(spark: SparkSession, d: str) -> DataFrame:
    e = dealt(table(spark, d, "events").select("event_id", "event_type", "props", "user_id"))
    return e.select("event_id", F.concat(
        F.lit('{"event_type": "'), "event_type", F.lit('", "props": '), "props",
        F.lit(', "tags": ['), F.col("user_id").cast("string"),
        F.lit(', "x"], "empty": {}, "none": null}')).alias("record"))


FLAT_SQL = """
ne AS (SELECT event_id, '{"event_type": "' || event_type || '", "props": ' || props ||
              ', "tags": [' || CAST(user_id AS VARCHAR) || ', "x"], "empty": {}, "none": null}' AS j
       FROM events),
flat AS (
  SELECT event_id, 'event_type' AS key, json_extract_string(j, '$.event_type') AS value FROM ne
  UNION ALL SELECT event_id, 'props.k', json_extract_string(j, '$.props.k') FROM ne
  UNION ALL SELECT event_id, 'tags[0]', json_extract_string(j, '$.tags[0]') FROM ne
  UNION ALL SELECT event_id, 'tags[1]', json_extract_string(j, '$.tags[1]') FROM ne
  UNION ALL SELECT event_id, 'none', json_extract_string(j, '$.none') FROM ne)"""


@plan("flatten_records", f"""
WITH {FLAT_SQL}
SELECT event_id, key, value FROM flat""")
def flatten_records(spark, d):
    """Nested JSON -> (id, key, value); empty objects emit nothing, null is kept."""
    return S.flatten_json(nested_events(spark, d), "event_id", "record")


@plan("widen_records", f"""
WITH {FLAT_SQL}
SELECT event_id,
       coalesce(max(value) FILTER (WHERE key = 'event_type'), '') AS event_type,
       coalesce(max(value) FILTER (WHERE key = 'props.k'), '') AS "props.k",
       coalesce(max(value) FILTER (WHERE key = 'tags[0]'), '') AS "tags[0]",
       coalesce(max(value) FILTER (WHERE key = 'tags[1]'), '') AS "tags[1]",
       coalesce(max(value) FILTER (WHERE key = 'none'), '') AS "none"
FROM flat GROUP BY event_id""")
def widen_records(spark, d):
    """Flat keys pivoted to columns of a given roster, missing -> ''."""
    flat = S.flatten_json(nested_events(spark, d), "event_id", "record")
    return S.widen_metadata(flat, "event_id", ["event_type", "props.k", "tags[0]", "tags[1]", "none"])


@plan("order_row_ids", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders""")
def order_row_ids(spark, d):
    """Consecutive 0-based ids in key order, without a one-partition window."""
    o = table(spark, d, "orders").select("o_orderkey")
    return S.with_row_id(o, ["o_orderkey"])


@plan("first_customer_orders", """
WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_custkey, min(pos) AS pos FROM r GROUP BY o_custkey""")
def first_customer_orders(spark, d):
    """S1 / W2 first-wins: first position of every id in a positioned id list."""
    o = S.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"),
                      ["o_orderkey"], col="pos")
    return J.dedupe_first(o, "o_custkey", "pos")


@plan("sample_per_segment", """
SELECT c_custkey, c_mktsegment FROM (
  SELECT c_custkey, c_mktsegment,
         row_number() OVER (PARTITION BY c_mktsegment
                            ORDER BY md5('42' || CAST(c_custkey AS VARCHAR)), c_custkey) AS r
  FROM customer) WHERE r <= 50""")
def sample_per_segment(spark, d):
    """50 customers per segment, reproducible (md5 of seed and id)."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sampling.sample_per_class(c, "c_mktsegment", 50, 42, "c_custkey")


@plan("sample_customers", """
SELECT c_custkey, c_name FROM customer
ORDER BY md5('42' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100""")
def sample_customers(spark, d):
    """100 customers in md5(seed || id) order (a top-n, the sample is the feature)."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return sampling.sample_n(c, 100, 42, "c_custkey")


def fetch_attempts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    meta = o.select(
        F.concat(F.lit("ID_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("meta").alias("kind"), F.lit(None).cast("string").alias("source"),
        (F.col("o_orderstatus") == "F").alias("ok"),
        F.when(F.col("o_orderstatus") == "O", F.lit(404)).alias("http_code"),
        F.when(F.col("o_orderstatus") == "P", F.lit("timeout")).alias("message"),
        F.lit(0).alias("seq"))
    srcs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"))
                     for i, s in enumerate(rules.FETCH_SOURCES)])
    img = o.select("o_orderkey", F.explode(srcs).alias("a")).select(
        F.concat(F.lit("ID_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("image").alias("kind"), F.col("a.s").alias("source"),
        ((F.col("o_orderkey") + F.col("a.i")) % 5 == 0).alias("ok"),
        F.lit(None).cast("int").alias("http_code"),
        F.concat(F.lit("no "), F.col("a.s")).alias("message"),
        (F.col("a.i") + 1).alias("seq"))
    return meta.unionByName(img)


@plan("fetch_status", f"""
WITH o AS (SELECT 'ID_' || CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_orderstatus FROM orders),
src AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(rules.FETCH_SOURCES))}) t(i, s)),
img AS (SELECT o.id, src.i, src.s, (o.o_orderkey + src.i) % 5 = 0 AS ok FROM o, src),
best AS (SELECT id, min(i) FILTER (WHERE ok) AS bi FROM img GROUP BY id),
st AS (SELECT o.id,
         CASE o.o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'HTTPError 404'
              ELSE 'Error: timeout' END AS base, b.bi FROM o JOIN best b ON o.id = b.id)
SELECT st.id,
       CASE WHEN bi IS NULL THEN base || ' (image error: no {rules.FETCH_SOURCES[-1]})' ELSE base END
         AS _status,
       CASE WHEN bi IS NULL THEN '' ELSE src.s END AS _image_src
FROM st LEFT JOIN src ON st.bi = src.i""")
def fetch_status(spark, d):
    """First successful image source in preference order, and the status text."""
    return S.fetch_status(fetch_attempts(spark, d))


def _stub_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"score": pdf["text"].fillna("").str.len() % 97 / 97.0})


_SCORE_OUT = StructType([StructField("score", DoubleType(), True)])


@plan("score_documents", """
SELECT doc_id, round(CAST(length(text) % 97 AS DOUBLE) / 97.0, 6) AS score, CAST(NULL AS VARCHAR) AS _error
FROM documents""")
def score_documents(spark, d):
    """B1: a batch scorer over Arrow batches with attempts and error rows; the result
    is materialised once so metrics downstream never re-run the scorer."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = scoring.score_table(docs, _stub_scorer, _SCORE_OUT)
    return rounded(out.select("doc_id", "score", F.col("_error")))


@plan("incremental_store", """
SELECT doc_id, round(CAST(length(text) % 97 AS DOUBLE) / 97.0, 6) AS score FROM documents""")
def incremental_store(spark, d):
    """X3 + J8 + S11: score half of the documents into a fresh store, then run the
    incremental job over all of them: only the other half is scored, and the report
    reads the whole store."""
    store = f"{working_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")

    def score(df):      # written once, by the append
        return scoring.score_table(df, _stub_scorer, _SCORE_OUT, materialize=False).select("doc_id", "score", "_error")

    incremental.incremental_eval(spark, docs.where(F.col("doc_id") % 2 == 0), "doc_id", store, score)
    whole = incremental.incremental_eval(spark, docs, "doc_id", store, score)
    return rounded(whole.select("doc_id", "score"))


@plan("incremental_retry", """
SELECT doc_id, round(CAST(length(text) % 97 AS DOUBLE) / 97.0, 6) AS score,
       CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS run, CAST(NULL AS VARCHAR) AS error
FROM documents""")
def incremental_retry(spark, d):
    """X3 with retry_errors (Q6): a third of the cases fail in the first run and are tried
    again in the second; the report has one row per case."""
    store = f"{working_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")

    def score(bad):
        def run(df):
            out = scoring.score_table(df, _stub_scorer, _SCORE_OUT, materialize=False)
            return out.select("doc_id", F.when(~bad, F.col("score")).alias("score"), F.when(bad, "timeout").alias("_error"))
        return run

    incremental.incremental_eval(spark, docs, "doc_id", store, score(F.col("doc_id") % 3 == 0), retry_errors=True)
    whole = incremental.incremental_eval(spark, docs, "doc_id", store, score(F.lit(False)), retry_errors=True)
    return rounded(whole.select("doc_id", "score", F.col("_run").cast("int").alias("run"), F.col("_error").alias("error")))


@plan("incremental_mixed", """
SELECT doc_id, round(CAST(length(text) % 97 AS DOUBLE) / 97.0, 6) AS score,
       CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END
            WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS run,
       CAST(NULL AS VARCHAR) AS error FROM documents""")
def incremental_mixed(spark, d):
    """X3 over one store: a batch run over a third of the cases, a stream over all of them
    (``foreachBatch``; it scores the rest), then a batch run that tries the errors of both again.
    The report has one row per case, with the run that it comes from."""
    folder = f"{working_dir(spark)}/mixed-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")

    def score(bad):
        def run(df):
            out = scoring.score_table(df, _stub_scorer, _SCORE_OUT, materialize=False)
            return out.select("doc_id", F.when(~bad, F.col("score")).alias("score"), F.when(bad, "timeout").alias("_error"))
        return run

    incremental.incremental_eval(spark, docs.where(F.col("doc_id") % 3 == 0), "doc_id", folder, score(F.col("doc_id") % 2 == 0))
    source = table(spark, d, "documents")
    # As a glob: without one, a stream takes its path for a folder.
    stream = spark.readStream.schema(source.schema).parquet(f"{d.rstrip('/')}/documents.parque[t]").select("doc_id", "text")
    incremental.stream_into_store(stream, "doc_id", folder, score(F.col("doc_id") % 5 == 0), f"{folder}-progress").awaitTermination()
    whole = incremental.incremental_eval(spark, docs, "doc_id", folder, score(F.lit(False)), retry_errors=True)
    return rounded(whole.select("doc_id", "score", F.col("_run").cast("int").alias("run"), F.col("_error").alias("error")))


_DEEP = 70


@plan("flatten_deep", f"""
SELECT s_suppkey, repeat('a.', {_DEEP - 1}) || 'a' AS key, s_name AS value FROM supplier WHERE s_suppkey % 7 > 0
UNION ALL SELECT s_suppkey, '_error', '{S.ERR_RECORD}' FROM supplier WHERE s_suppkey % 7 = 0""")
def flatten_deep(spark, d):
    """S7 on records {_DEEP} levels deep; a record that is no JSON gives an error row."""
    s = table(spark, d, "supplier")
    text = F.concat(F.lit('{"a":' * _DEEP), F.lit('"'), "s_name", F.lit('"'),
                    F.when(F.col("s_suppkey") % 7 > 0, F.lit("}" * _DEEP)).otherwise(F.lit("")))
    return S.flatten_json(s.select("s_suppkey", text.alias("record")), "s_suppkey", "record")


@plan("flatten_broken", f"""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'a[0]' WHEN 2 THEN 'a' WHEN 3 THEN 'a.b' ELSE '_error' END AS key,
       CASE o_orderkey % 5 WHEN 1 THEN o_orderstatus WHEN 2 THEN '[[[' WHEN 3 THEN o_orderstatus
            ELSE '{S.ERR_RECORD}' END AS value FROM orders""")
def flatten_broken(spark, d):
    """S7 among broken records: cut ones, runs of brackets that are no JSON, one of 1,200 brackets."""
    k, s = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    text = (F.when(k == 1, F.concat(F.lit('{"a": ["'), s, F.lit('"]}'))).when(k == 2, F.lit('{"a": "[[["}'))
            .when(k == 3, F.concat(F.lit('{"a": {"b": "'), s, F.lit('"}}'))).when(k == 4, F.lit('{"a": {"b": [1'))
            .otherwise(F.when(F.col("o_orderkey") < 1000, F.lit("[" * 1200)).otherwise(F.lit('"[[{{'))))
    return S.flatten_json(dealt(table(spark, d, "orders")).select("o_orderkey", text.alias("record")), "o_orderkey", "record")
