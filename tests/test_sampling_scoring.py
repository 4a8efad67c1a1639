"""Sampling, batch scoring, incremental runs and the scenario report."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caliper.operators import reports, sampling, scoring
from caliper.streaming import incremental

OUT = StructType([StructField("score", DoubleType(), True)])


def test_sample_per_class_exact(spark):
    df = spark.range(0, 3000).select("id", F.when(F.col("id") < 2000, "hot")
                                     .otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")))
                                     .alias("cls"))
    s = sampling.sample_per_class(df, "cls", 92, 42, "id", salt_buckets=16)
    counts = {r.cls: r["count"] for r in s.groupBy("cls").count().collect()}
    assert counts == {"hot": 92, "c0": 92, "c1": 92, "c2": 92}
    # the same sample as a single sort by the md5 key
    pdf = df.toPandas()
    import hashlib
    pdf["k"] = [hashlib.md5(f"42{i}".encode()).hexdigest() for i in pdf["id"]]
    exp = set(pdf.sort_values(["k", "id"]).groupby("cls").head(92)["id"])
    assert set(r.id for r in s.collect()) == exp
    assert sampling.sample_n(df, 10, 42, "id").count() == 10


def test_score_table_retries_fallback(spark):
    calls = {"n": 0}

    def flaky(pdf):
        if (pdf["x"] == 3).any():
            raise RuntimeError("bad row")
        return pd.DataFrame({"score": pdf["x"] / 10.0})

    def fallback(pdf):
        if (pdf["x"] == 3).any() and (pdf["y"] == "no").any():
            raise RuntimeError("still bad")
        return pd.DataFrame({"score": [-1.0] * len(pdf)})

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "no"), (4, "c")], "x long, y string").coalesce(1)
    out = {r.x: (r.score, r._error) for r in scoring.score_table(df, flaky, OUT, attempts=2,
                                                                fallback=fallback).collect()}
    assert out[1] == (0.1, None) and out[4] == (0.4, None)
    assert out[3][0] is None and "still bad" in out[3][1]
    del calls


def test_only_failed_rows_are_retried(spark, tmp_path):
    log = str(tmp_path / "rows.log")

    def scorer(pdf):
        with open(log, "a") as f:
            f.writelines(f"{x}\n" for x in pdf["x"])
        return pd.DataFrame({"score": pdf["x"] * 1.0, "_error": ["busy" if x % 10 == 0 else None for x in pdf["x"]]})

    def fallback(pdf):
        if (pdf["x"] == 20).any():
            raise RuntimeError("no")
        return pd.DataFrame({"score": [-1.0] * len(pdf)})

    df = spark.range(0, 40, 1, 1).select(F.col("id").alias("x"))
    out = {r.x: (r.score, r._error) for r in scoring.score_table(df, scorer, OUT, attempts=3, fallback=fallback).collect()}
    calls = [int(x) for x in open(log).read().split()]
    assert all(calls.count(x) == (3 if x % 10 == 0 else 1) for x in range(40))
    assert out == {x: (None, "no") if x == 20 else (-1.0, None) if x % 10 == 0 else (x * 1.0, None) for x in range(40)}


def test_models_are_loaded_once(spark, tmp_path):
    log = str(tmp_path / "loads.log")

    def scorer(model, pdf, last=[None]):
        if last[0] != model:
            last[0] = model
            with open(log, "a") as f:
                f.write(f"{model}\n")
        return pd.DataFrame({"score": pdf["x"] * 1.0})

    cases = spark.range(0, 400, 1, 16).select(F.col("id").alias("x"))
    for rows, salts in ((1000, 1), (100, 4)):
        open(log, "w").close()
        out = scoring.score_once_per_model(cases, [f"m{i}" for i in range(9)], scorer, OUT, rows_per_load=rows)
        assert out.count() == 3600 and len(open(log).read().split()) <= 9 * salts


def test_score_per_model_and_scenarios(spark):
    cases = spark.createDataFrame([(1, "d1", "c1"), (2, "d2", "c2")], "id long, derm string, clin string")
    loads = []

    def scorer(model, pdf):
        loads.append(model)
        return pd.DataFrame({"score": pdf["id"] * (1.0 if model == "m1" else 2.0)})

    out = scoring.score_once_per_model(cases, ["m1", "m2"], scorer, OUT).collect()
    assert sorted((r.id, r.checkpoint, r.score) for r in out) == [
        (1, "m1", 1.0), (1, "m2", 2.0), (2, "m1", 2.0), (2, "m2", 4.0)]
    sc = scoring.with_scenarios(cases, {"derm_only": ["derm"], "derm_plus_clin": ["derm", "clin"]})
    assert sorted((r.id, r.scenario, len(r.images)) for r in sc.collect())[:2] == [
        (1, "derm_only", 1), (1, "derm_plus_clin", 2)]


def test_incremental_two_halves_equal_one(spark, tmp_path):
    df = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))

    def score(d):
        return d.select("k", (F.col("x") / 100.0).alias("score"), F.lit(None).cast("string").alias("_error"))

    store = str(tmp_path / "store")
    incremental.incremental_eval(spark, df.where("k < 20"), "k", store, score)
    whole = incremental.incremental_eval(spark, df, "k", store, score)
    assert whole.count() == 50 and whole.select("k").distinct().count() == 50
    again = incremental.incremental_eval(spark, df, "k", store, score)
    assert again.count() == 50


def test_streaming_store(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(0, 30).select(F.col("id").alias("k")).write.parquet(str(src))
    stream = spark.readStream.schema("k long").parquet(str(src))

    def score(d):
        return d.select("k", (F.col("k") * 1.0).alias("score"))

    q = incremental.stream_into_store(stream, "k", str(tmp_path / "store"), score,
                                      str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 30


def test_scenario_report_grouping_sets(spark):
    mel = "Malignant melanocytic proliferations (Melanoma)"
    ben = "Benign melanocytic proliferations"
    rows = [("1", "derm_only", mel, "melanoma", "nevus", "x", "A", ""),
            ("2", "derm_only", ben, "melanoma", "nevus", "x", "A", ""),
            ("3", "derm_only", ben, "nevus", "x", "y", None, ""),
            ("4", "derm_only", ben, None, None, None, "B", "timeout"),
            ("1", "derm_plus_clin", mel, "bcc", "melanoma", "x", "A", "")]
    df = spark.createDataFrame(rows, "lesion_id string, scenario string, truth string, p1 string, "
                                     "p2 string, p3 string, skin_tone_class string, _error string")
    store = reports.prediction_rows(df, "truth", ["p1", "p2", "p3"], error="_error")
    rep = {(r.scenario, r.level, r.skin_tone_class): r for r in reports.scenario_report(store).collect()}
    o = rep[("derm_only", "overall", None)]
    assert (o.n_total, o.n_eval, o.top1_accuracy, o.hit_at3) == (4, 3, 2 / 3, 1.0)
    assert (o.tp, o.fp, o.tn, o.fn) == (1, 1, 1, 0)
    a = rep[("derm_only", "skin_tone_class", "A")]
    assert (a.n_eval, a.top1_accuracy) == (2, 0.5)
    assert ("derm_only", "skin_tone_class", None) not in rep
    p = rep[("derm_plus_clin", "overall", None)]
    assert (p.top1_accuracy, p.hit_at3, p.fn) == (0.0, 1.0, 0)


def test_incremental_retry_errors(spark, tmp_path):
    """Q6: error rows count as done unless retry_errors is asked for."""
    store = str(tmp_path / "store")
    spark.createDataFrame([(1, 0.5, None), (2, None, "timeout")], "k long, score double, _error string") \
        .write.parquet(store)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    done = incremental.done_keys(spark, store, "k")
    assert sorted(r.k for r in done.collect()) == [1, 2]
    retry = incremental.done_keys(spark, store, "k", retry_errors=True)
    assert sorted(r.k for r in retry.collect()) == [1]
    from caliper.operators.linkage import not_yet_done
    assert sorted(r.k for r in not_yet_done(cases, retry, "k").collect()) == [2, 3]
    assert incremental.done_keys(spark, str(tmp_path / "none"), "k") is None


def test_retry_reports_one_row_per_case(spark, tmp_path):
    store, tries = str(tmp_path / "store"), []
    cases = spark.range(0, 6).select(F.col("id").alias("k"))

    def score(df):
        bad = F.col("k") % 3 == 0 if not tries else F.col("k") == 0
        tries.append(1)
        return df.select("k", F.when(~bad, F.col("k") * 1.0).alias("score"), F.when(bad, "timeout").alias("_error"))

    for want in ([0, 3], [0], [0]):
        whole = incremental.incremental_eval(spark, cases, "k", store, score, retry_errors=True).collect()
        assert len(whole) == 6 and sorted(r.k for r in whole if r._error) == want
    assert max(r._run for r in whole) == 2
    (tmp_path / "store" / "part-9.parquet").write_bytes(b"broken")
    try:
        incremental.done_keys(spark, store, "k").collect()
        raise AssertionError("a broken store must not count as empty")
    except AssertionError:
        raise
    except Exception:
        pass


def test_scoring_runs_once(spark, tmp_path):
    """The scored table is materialised: later actions never call the scorer again."""
    log = str(tmp_path / "calls.log")

    def scorer(pdf):
        with open(log, "a") as f:
            f.write(f"{len(pdf)}\n")
        return pd.DataFrame({"score": pdf["x"] * 1.0})

    df = spark.range(0, 200, 1, 4).select(F.col("id").alias("x"))
    scored = scoring.score_table(df, scorer, OUT)
    first = sum(int(x) for x in open(log).read().split())
    assert first == 200
    scored.count()
    scored.agg(F.sum("score")).collect()
    assert sum(int(x) for x in open(log).read().split()) == 200


def test_scenario_report_q4(spark):
    rows = [("1", "derm_only", None, "nevus", "", "A"), ("2", "derm_only", "Benign melanocytic proliferations",
                                                         "nevus", "", "A")]
    df = spark.createDataFrame(rows, "lesion_id string, scenario string, truth string, p1 string, "
                                     "_error string, skin_tone_class string")
    store = reports.prediction_rows(df, "truth", ["p1"], error="_error", k=3)
    strict = [r for r in reports.scenario_report(store).collect() if r.level == "overall"][0]
    loose = [r for r in reports.scenario_report(store, strict_blank=False).collect()
             if r.level == "overall"][0]
    assert (strict.n_eval, strict.top1_accuracy) == (1, 1.0)
    assert (loose.n_eval, loose.top1_accuracy) == (2, 0.5)


def test_prompts_and_first_present(spark):
    from caliper.functions import labels as L
    from caliper.operators import fusion
    df = spark.createDataFrame([(1, "MEL", None, 0.3, 0.5, 0.2), (2, None, "NV", None, 0.1, 0.1)],
                               "row_id int, top1_family string, base_top1_family string, melanoma_probability double, "
                               "concerning_probability double, specialist_probability double")
    f = df.select(L.first_present(df.columns, ["top1_family", "base_top1_family"], "").alias("f"),
                  L.first_present(df.columns, ["family_prob_MEL"], 0).alias("m")).collect()
    assert [(r.f, r.m) for r in f] == [("MEL", 0), ("NV", 0)]
    x = fusion.base_flags(df, "melanoma_probability", "concerning_probability", "specialist_probability")
    p = fusion.render_prompts(x, fusion.evidence_template(x.columns)).orderBy("row_id").collect()
    assert "\nrank 1 family: MEL\n" in p[0].prompt and "\nrank 1 family: NV\n" in p[1].prompt
    assert "clinically concerning, base model: 0.5\ncut for it: 0.2213" in p[0].prompt
    assert p[0].prompt.count("reaches the cut: 1") == 3 and p[1].prompt.count("reaches the cut: 0") == 3
    assert "share of MEL: 0\n" in p[0].prompt


def test_fusion_change_flags_normalise_families(spark):
    """Q8: base families that replies do not know are MISC before they are compared."""
    from caliper.operators import fusion
    rows = [("MISC", "AKIEC", 0), ("MEL", "MEL", 0), ("nevus", "NV", 0), ("MEL", "INF", 1), (None, "BEN_OTH", 0)]
    df = spark.createDataFrame(rows, "f string, b string, want int").withColumns(
        {c: F.lit(0) for c in ("base_melanoma_prediction", "base_malignancy_prediction", "specialist_melanoma_prediction")})
    got = fusion.change_flags(df, "f", "b", "base_melanoma_prediction", "base_malignancy_prediction").collect()
    assert all(r.changed_family_from_base == r.want for r in got)


def test_scoring_memory_is_a_batch(spark):
    """Wide rows come in batches of bounded size, and a scored batch is gone when the next one comes,
    even if the scorer leaves it in a cycle, as pandas' ``.str`` does."""
    out = StructType([StructField(n, DoubleType(), True) for n in ("rows", "held")])
    seen = []

    def scorer(pdf):
        import weakref

        class Held:
            pass

        held = Held()
        held.itself = held
        seen.append(weakref.ref(held))
        return pd.DataFrame({"rows": [float(len(pdf))] * len(pdf), "held": float(sum(x() is not None for x in seen) - 1)})

    wide = spark.range(0, 8000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    got = scoring.score_table(wide, scorer, out).agg(F.count("*"), F.max("rows"), F.max("held")).first()
    assert got[0] == 8000 and got[1] < 4000 and got[2] == 0


def test_manifest_needs_no_python(spark, tmp_path):
    """The manifest is written and read without a Python worker, and its rows are as before."""
    store = str(tmp_path / "store")
    empty = incremental.read_manifest(spark, store)
    assert empty.count() == 0 and [f"{n} {t}" for n, t in empty.dtypes] == incremental.MANIFEST.replace("long", "bigint").split(", ")
    assert "ExistingRDD" not in empty._jdf.queryExecution().toString()
    incremental._finish(spark, store, 3, "stream", "a", 7)
    incremental._finish(spark, store, 4, "batch")
    rows = incremental.read_manifest(spark, store).orderBy("run").collect()
    assert [(r.run, r.kind, r.stream, r.batch_id) for r in rows] == [(3, "stream", "a", 7), (4, "batch", None, None)]
    assert all(r.finished is not None for r in rows)
