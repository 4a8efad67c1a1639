"""Frontier flattening, positions over several files, the shared store, and the plans of the
lookups, samples and running sums."""

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from caliper.operators import linkage as J
from caliper.operators import metrics, prefix, sampling, scoring
from caliper.sources import readers as S
from caliper.sources import sinks
from caliper.streaming import incremental

OUT = StructType([StructField("score", DoubleType(), True)])


# ---------------------------------------------------------------- flatten
def _flat(value, key=None):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, k if key is None else f"{key}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _flat(v, f"{key or ''}[{i}]")
    else:
        yield key, value


def test_flatten_equals_recursion(spark):
    rng = np.random.default_rng(3)

    def made(depth):
        kind = rng.integers(0, 4) if depth else 3
        if kind == 0:
            return {f"k{i}": made(depth - 1) for i in range(rng.integers(0, 4))}
        if kind == 1:
            return [made(depth - 1) for _ in range(rng.integers(0, 4))]
        return [None, "x", "", "[[{"][rng.integers(0, 4)]

    records = [made(int(d)) for d in rng.integers(0, 15, 120)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, j string")
    got = sorted(((r.id, r.key or "", r.value) for r in S.flatten_json(df, "id", "j").collect()), key=str)
    assert got == sorted(((i, k or "", v) for i, r in enumerate(records) for k, v in _flat(r)), key=str)


def test_flatten_broken_brackets_are_cheap(spark):
    rows = [(i, '{"a": [1, {"b": "x"}]}') for i in range(200)] + [(900, "[" * 1200), (901, '{"a":' * 1200), (902, "")]
    df = spark.createDataFrame(rows, "id int, j string")
    begin = time.time()
    got = S.flatten_json(df, "id", "j").collect()
    assert time.time() - begin < 30
    assert sorted(r.id for r in got if r.key == "_error") == [900, 901, 902]
    assert sum(r.id < 900 for r in got) == 400


# ---------------------------------------------------------------- positions
def test_positions_over_growing_files(spark, tmp_path):
    lines, n = [], 0
    for k, size in enumerate((3, 400, 20_000)):
        part = [f" id{(n + i) % 5000} " if (n + i) % 7 else "" for i in range(size)]
        n += size
        (tmp_path / f"{k}.txt").write_text("\n".join(part) + "\n")
        lines += part
    want = {}
    for i, x in enumerate(lines):
        if x.strip():
            want.setdefault(x.strip(), i)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")     # several blocks of the largest file
        got = {r.id: r.pos for r in S.read_ids(spark, str(tmp_path)).collect()}
        raw = S.with_row_id(spark.read.text(str(tmp_path)), col="at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want
    assert [r.value for r in sorted(raw, key=lambda r: r.at)] == lines


def test_positions_of_empty_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert S.read_ids(spark, str(tmp_path)).collect() == []


# ---------------------------------------------------------------- the store
def _score(bad):
    def run(df):
        return df.select("k", F.when(~bad, F.col("k") * 1.0).alias("score"), F.when(bad, F.lit("timeout")).alias("_error"))
    return run


def test_batch_and_stream_share_a_store(spark, tmp_path):
    store, src = str(tmp_path / "store"), tmp_path / "in"
    cases = spark.range(0, 30).select(F.col("id").alias("k"))
    incremental.incremental_eval(spark, cases.where("k < 10"), "k", store, _score(F.col("k") % 2 == 0))
    cases.write.parquet(str(src))
    stream = spark.readStream.schema("k long").parquet(str(src))
    incremental.stream_into_store(stream, "k", store, _score(F.col("k") % 5 == 0), str(tmp_path / "ck")).awaitTermination(120)
    whole = incremental.latest_rows(incremental.read_store(spark, store), "k").collect()
    assert sorted(r.k for r in whole) == list(range(30)) and all(r._run is not None for r in whole)
    assert sorted(r.k for r in whole if r._error) == [0, 2, 4, 6, 8, 10, 15, 20, 25]
    whole = incremental.incremental_eval(spark, cases, "k", store, _score(F.lit(False)), retry_errors=True).collect()
    assert sorted((r.k, r.score) for r in whole) == [(k, float(k)) for k in range(30)]
    assert {r.k for r in whole if r._run == 2} == {0, 2, 4, 6, 8, 10, 15, 20, 25}
    runs = [(r.run, r.kind, r.batch_id) for r in incremental.read_manifest(spark, store).orderBy("run").collect()]
    assert runs == [(0, "batch", None), (1, "stream", 0), (2, "batch", None)]


def test_replayed_batches_do_nothing(spark, tmp_path):
    """A stream that lost its own progress but not the manifest scores no case again."""
    store, src, log = str(tmp_path / "store"), tmp_path / "in", []
    spark.range(0, 8).select(F.col("id").alias("k")).write.parquet(str(src))

    def score(df):
        log.append(1)
        return _score(F.col("k") == 3)(df)

    for step in ("commits", "offsets"):
        stream = spark.readStream.schema("k long").parquet(str(src))
        incremental.stream_into_store(stream, "k", store, score, str(tmp_path / "ck"), retry_errors=True).awaitTermination(120)
        for f in os.listdir(tmp_path / "ck" / "commits"):       # as after a crash before the commit
            os.remove(tmp_path / "ck" / "commits" / f)
    assert len(log) == 1 and incremental.read_store(spark, store).count() == 8


def test_rows_without_a_manifest_row_count(spark, tmp_path):
    """A run that failed between its rows and its manifest row: its number is not used again."""
    store = str(tmp_path / "store")
    cases = spark.range(0, 4).select(F.col("id").alias("k"))
    _score(F.col("k") == 1)(cases).withColumn("_run", F.lit(5).cast("long")).write.parquet(store)
    whole = incremental.incremental_eval(spark, cases, "k", store, _score(F.lit(False)), retry_errors=True).collect()
    assert sorted((r.k, r._run) for r in whole) == [(0, 5), (1, 6), (2, 5), (3, 5)]


def test_blank_errors_are_fine(spark, tmp_path):
    store = str(tmp_path / "store")
    spark.createDataFrame([(1, "\t"), (2, "x"), (3, None)], "k long, _error string").write.parquet(store)
    assert sorted(r.k for r in incremental.done_keys(spark, store, "k", retry_errors=True).collect()) == [1, 3]


# ---------------------------------------------------------------- lookups
def test_only_hits_reach_the_substring_aggregate(spark):
    cat = spark.range(0, 3000).select(F.format_string("d/scan_%06d_of_a_long_name.jpg", "id").alias("path"))
    keys = spark.createDataFrame([("002999",), ("nothing",), (None,), ("",), ("002999",)], "key string")
    assert [(r.key, r.n) for r in J.substring_hits(keys, "key", cat).collect()] == [("002999", 26)]
    assert J.substring_hits(keys.where("key IS NULL"), "key", cat).count() == 0
    plan = J.resolve_by_substring(keys, "key", cat)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_present_only_looks_up_once(spark):
    cat = spark.range(0, 50).select(F.format_string("p%d.jpg", "id").alias("path"))
    k = F.col("id")
    cases = spark.range(0, 300).select(
        "id", *[F.when((k + i) % 3 > 0, F.format_string("p%d.jpg", k % (40 + 10 * i))).alias(f"c{i}") for i in range(2)],
        F.lit("p1.jpg").alias("c2"), F.lit(None).cast("string").alias("note"))
    cases = cases.unionByName(cases.where("id = 1"))                     # an equal row stays a row
    kept, skipped = J.present_only(cases, cat, ["c0", "c1", "c2"])
    rows = [tuple(r) for r in cases.collect()]
    there = {f"p{i}.jpg" for i in range(50)}
    good = [r for r in rows if all(x in there for x in r[1:4])]
    assert sorted(map(str, kept.collect())) == sorted(map(str, (r for r in cases.collect() if tuple(r) in good)))
    assert kept.count() + skipped.count() == len(rows)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Join") == 0    # written once, then a filter


# ---------------------------------------------------------------- samples
def test_sample_is_the_least_keys(spark):
    df = spark.range(0, 30_000).select(F.col("id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None)
                                       .otherwise("cool").alias("c"))
    rows = [(r.id, r.c) for r in df.collect()]
    import hashlib
    for n in (1, 50, 2999, 3000, 25_000):
        want = []
        for c in ("hot", "cool", None):
            own = sorted((hashlib.md5(f"7{i}".encode()).hexdigest(), i) for i, x in rows if x == c)
            want += [(c, i) for _, i in own[:n]]
        got = [(r.c, r.id) for r in sampling.sample_per_class(df, "c", n, 7, "id").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sampling.sample_per_class(df.limit(0), "c", 5, 7, "id").count() == 0


def test_sample_sorts_one_cell(spark, monkeypatch):
    """Of a class only the rows of its cut-off cell are ordered."""
    df = spark.range(0, 200_000).select("id", F.lit("a").alias("c"))
    out = sampling.sample_per_class(df, "c", 100_000, 1, "id")
    cells = df.groupBy(F.substring(sampling.sample_key("id", 1), 1, sampling.FINE)).count().agg(F.max("count")).first()[0]
    assert cells <= 4 and out.count() == 100_000
    edge = out._jdf.queryExecution().optimizedPlan().toString()
    assert edge.count("Window") >= 1 and "__cut" in edge


def test_sample_of_one_repeated_id(spark):
    df = spark.range(0, 5000).select((F.col("id") % 2).alias("id"), F.lit("a").alias("c"))
    assert sampling.sample_per_class(df, "c", 3000, 1, "id").groupBy("id").count().agg(F.max("count")).first()[0] == 2500
    assert sampling.sample_per_class(df, "c", 3000, 1, "id").count() == 3000


# ---------------------------------------------------------------- scoring
def test_large_batch_costs_little_beyond_the_scorer(spark):
    spent = []

    def scorer(pdf):
        begin = time.time()
        out = pd.DataFrame({"score": pdf["x"] * 1.0, "n": pdf["x"], "s": pdf["x"].astype(str)})
        out["_error"] = [None if x % 10 else "odd" for x in pdf["x"].tolist()]
        spent.append(time.time() - begin)
        return out

    fields = StructType([StructField("score", DoubleType()), StructField("n", LongType()), StructField("s", StringType())])
    df = spark.range(0, 10).select(F.col("id").alias("x"))
    holder = {}

    class Frame:                # takes the function that mapInPandas would run
        schema = df.schema

        def mapInPandas(self, fn, schema):
            holder["fn"] = fn
            return self
    scoring.score_table(Frame(), scorer, fields, materialize=False)
    big = pd.DataFrame({"x": np.arange(100_000)})
    begin = time.time()
    out = next(holder["fn"](iter([big])))
    assert time.time() - begin - sum(spent) < 1.0 and len(spent) == 3
    assert out["_error"].isna().sum() == 90_000 and out["n"].isna().sum() == 10_000
    got = scoring.score_table(df, scorer, fields).orderBy("x").collect()
    assert [(r.score, r.n, r.s, r._error) for r in got] == \
        [(None, None, None, "odd") if x % 10 == 0 else (float(x), x, str(x), None) for x in range(10)]


def test_equal_rows_spread_over_loads(spark, tmp_path):
    log = str(tmp_path / "loads.log")

    def scorer(model, pdf, last=[None]):
        import os
        key = (model, os.getpid(), id(last))
        if last[0] != model:
            last[0] = model
            with open(log, "a") as f:
                f.write(f"{model}\n")
        return pd.DataFrame({"score": [float(len(pdf))] * len(pdf)}) if key else None

    cases = spark.range(0, 10_000, 1, 3).select(F.lit("same").alias("x"))
    out = scoring.score_once_per_model(cases, [f"m{i}" for i in range(3)], scorer, OUT, rows_per_load=2500)
    sizes = out.groupBy("checkpoint", "score").count().collect()
    assert out.count() == 30_000 and all(r.score <= 2500 for r in sizes)
    assert len(open(log).read().split()) == 3 * 4


# ---------------------------------------------------------------- running sums
def test_running_sums_move_the_rows_once(spark):
    rows = spark.range(0, 4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 7 % 4000).alias("k"),
                                       F.lit(2).alias("v"))
    seen = []
    for most in (100_000, 0):                   # offsets broadcast, and joined as the window is dealt
        out = prefix.running_sums(rows, ["g"], "k", ["v"], buckets=6, most_broadcast=most)
        got = {(r.g, r.k): (r.cum_v, r.tot_v) for r in out.collect()}
        own = {}
        for r in rows.collect():
            own.setdefault(r.g, []).append(r.k)
        assert got == {(g, k): (2 * (i + 1), 2 * len(ks)) for g, ks in own.items() for i, k in enumerate(sorted(ks))}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            bare = prefix.running_sums(rows, ["g"], "k", ["v"], buckets=6, most_broadcast=most)
            if not most:
                bare = bare.hint("merge")
            plan = bare._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        scans = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        seen.append(len(scans))
    assert seen[0] == 1 and seen[1] <= 2        # the rows once; beyond the bound the offsets once more


# ---------------------------------------------------------------- metrics
def test_label_report_keeps_a_null_group(spark):
    df = spark.createDataFrame([(None, 1, 1, 0.9), (None, 0, 0, 0.1), ("a", 1, 0, 0.2), ("a", 0, 0, 0.3)],
                               "g string, y int, p int, s double")
    got = {r.g: (r.n, r.roc_auc) for r in metrics.label_report(df, "y", "p", "s", ["g"]).collect()}
    assert got == {None: (2, 1.0), "a": (2, 0.0)}


def test_eval_counts_take_any_white_space_as_blank(spark):
    df = spark.createDataFrame([("x", "\t", None), ("x", "y", "\n"), (" ", "y", None)], "t string, p string, e string")
    r = metrics.eval_counts(df, "t", "p", "e").first()
    assert (r.n_total, r.n_with_truth, r.n_with_pred, r.n_evaluated) == (3, 2, 2, 1)


def test_nested_document_is_one_json_text(spark, tmp_path):
    m = spark.createDataFrame([(t, s, "fixed", i * 1.0) for i, (t, s) in enumerate(
        [('ma"l', "prob"), ('ma"l', "rank"), (None, "prob"), ("mel", "prob")])], "target string, score_name string, mode string, auc double")
    levels = ["target", "score_name", "mode"]
    sinks.write_metrics_nested(m, str(tmp_path / "m"), levels, notes={"set": "d", "by": "x"})
    text = "\n".join(r.value for r in sorted(spark.read.text(str(tmp_path / "m")).select(
        "value", "_metadata.file_name").collect(), key=lambda r: r.file_name))
    doc = json.loads(text)
    assert doc["metrics"]['ma"l']["rank"]["fixed"]["auc"] == 1.0 and doc["metrics"]["null"]["prob"]["fixed"]["auc"] == 2.0
    rows, notes = sinks.read_metrics_nested(spark, str(tmp_path / "m"), levels, "auc: double")
    assert sorted(tuple(r) for r in rows.collect()) == sorted((r.target or "null", r.score_name, r.mode, r.auc) for r in m.collect())
    assert {r.note: r.value for r in notes.collect()} == {"set": "d", "by": "x"}
    sinks.write_metrics_nested(m.limit(0), str(tmp_path / "e"), levels)
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "e")).collect())) == {"metrics": {}}
