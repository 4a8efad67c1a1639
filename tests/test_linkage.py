"""Linkage (FIXTURES tables 4 and 5) and substring resolution vs brute force."""

import random

from pyspark.sql import functions as F

from caliper.operators import linkage as J


def test_catalog_fixture(spark):
    cat = spark.createDataFrame([("x/ISIC_12.jpg",), ("x/ISIC_120.PNG",), ("notes.txt",)], "path string")
    files = J.image_files(cat)
    assert files.count() == 2
    wanted = spark.createDataFrame([("12",), ("SIC_12",), ("99",), ("isic_120",)], "key string")
    got = {r.key: (r.path, r.path_by) for r in J.find_files(wanted, "key", files).collect()}
    assert got["12"] == ("x/ISIC_12.jpg", "0")          # alias without the prefix
    assert got["SIC_12"] == ("x/ISIC_12.jpg", "substring")  # both contain it, shortest stem
    assert got["99"] == (None, None)
    assert got["isic_120"] == ("x/ISIC_120.PNG", "0")    # lower-case alias


def test_substring_brute_force(spark):
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("ab1_") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    paths = sorted({f"d/{s}.jpg" for s in stems})
    keys = sorted({"".join(rnd.choice("ab1_") for _ in range(rnd.randint(1, 6))) for _ in range(80)})
    cat = spark.createDataFrame([(p,) for p in paths], "path string")
    kd = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.path for r in J.resolve_by_substring(kd, "key", cat).collect()}
    for k in keys:
        hits = [p for p in paths if k in p[2:-4]]
        exp = min(hits, key=lambda p: (len(p) - 6, p)) if hits else None
        assert got.get(k) == exp, k
    plan = J.resolve_by_substring(kd, "key", cat)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_pair_views(spark):
    rows = [("L1", "D1", "Dermoscopic"), ("L1", "C1", "clinical: close-up"), ("L2", "D2", "dermoscopic"),
            ("L3", "D3", "dermoscopic"), ("L3", "C3", "clinical: close-up"), ("L3", "C4", "clinical: close-up")]
    df = spark.createDataFrame(rows, "lesion_id string, isic_id string, image_type string")
    got = sorted(tuple(r) for r in J.pair_views(df, "lesion_id", "image_type", ["isic_id"],
                                                multiple="all").collect())
    assert got == [("L1", "D1", "C1"), ("L3", "D3", "C3"), ("L3", "D3", "C4")]
    first = sorted(tuple(r) for r in J.pair_views(df, "lesion_id", "image_type", ["isic_id"],
                                                  multiple="first").collect())
    assert first == [("L1", "D1", "C1"), ("L3", "D3", "C3")]
    try:
        J.pair_views(df, "lesion_id", "image_type", ["isic_id"], multiple="some")
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "multiple" in str(e)


def test_truth_and_sets(spark):
    preds = spark.createDataFrame([("isic_1", 0.3), ("ISIC_2 ", 0.6), ("ISIC_9", 0.1)], "fid string, p double")
    truth = spark.createDataFrame([(" ISIC_1", "benign", 0), ("ISIC_1", "malignant", 1), ("isic_2", "benign", 2)],
                                  "mid string, dx string, ord int")
    got = {r.fid: r.dx for r in J.attach_truth(preds, "fid", truth, "mid", ["dx"], "ord").collect()}
    assert got == {"isic_1": "malignant", "ISIC_2 ": "benign"}   # last wins, inner
    ids = J.matched_ids(preds, "fid", truth, "mid")
    assert sorted(r.id for r in ids.collect()) == ["ISIC_1", "ISIC_2"]
    rem = J.not_yet_done(preds, truth.select(F.col("mid").alias("fid")), "fid")
    assert sorted(r.fid for r in rem.collect()) == ["ISIC_2 ", "ISIC_9", "isic_1"]
    assert J.not_yet_done(preds, None, "fid").count() == 3
    empty = spark.createDataFrame([("zzz",)], "mid string")
    try:
        J.matched_ids(preds, "fid", empty, "mid")
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "no file id matches" in str(e)


def test_present_missing_existing(spark):
    cat = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("b.png",), ("c.png",)], "path string")
    cases = spark.createDataFrame([(1, "a.jpg", "b.jpg", None), (2, "a.jpg", "z.jpg", "n"), (3, None, "b.jpg", "n")],
                                  "id int, x string, y string, note string")
    kept, skipped = J.present_only(cases, cat, ["x", "y"])
    assert [r.id for r in kept.collect()] == [1] and sorted(r.id for r in skipped.collect()) == [2, 3]
    ids = spark.createDataFrame([("b",), ("c",), ("d",)], "id string")
    got = {r.id: (r.existing_path, r.image_src) for r in J.skip_existing(ids, "id", cat).collect()}
    assert got == {"b": ("b.jpg", "existing"), "c": ("c.png", "existing"), "d": (None, None)}
    res = spark.createDataFrame([("k1", None), ("k2", "p"), ("k0", None)], "key string, path string")
    rep = J.missing_report(res, "key", "path").first()
    assert rep.n_missing == 2 and list(rep.first_missing) == ["k0", "k1"]


def test_model_outputs_join(spark):
    a = spark.createDataFrame([(0, 0.1), (1, None), (2, 0.3)], "row_id long, p double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.6), (3, 0.7)], "derm7pt_row_id long, q double")
    j = J.join_model_outputs(a, b, "row_id", "derm7pt_row_id", ["p", "q"])
    assert [r.row_id for r in j.collect()] == [0]
    stacked = J.stack_scenarios({"one": a.limit(1), "two": a.limit(1)})
    assert sorted(r.scenario for r in stacked.collect()) == ["one", "two"]


def test_filters(spark):
    from caliper.operators import filters
    df = spark.createDataFrame([(1, "a", "x", None, "Dermoscopic"), (2, "", "x", None, "clinical"),
                                (3, "b", None, None, "derm"), (4, "c", "y", "boom", "clinic")],
                               "id int, t string, p string, e string, kind string")
    assert [r.id for r in filters.evaluable(df, "t", "p", "e").collect()] == [1]
    assert sorted(r.id for r in filters.evaluable(df, "t", "p", strict_blank=False).collect()) == [1, 3, 4]
    assert [r.id for r in filters.limit_cases(df, 2, "id").collect()] == [1, 2]
    assert filters.limit_cases(df, 0, "id").count() == 4
    assert sorted(r.id for r in filters.image_type_filter(df, "kind", "derm").collect()) == [1, 3]
    assert [r.id for r in filters.sorted_listing(df, "id").collect()] == [1, 2, 3, 4]


def test_all_exact_skips_substring(spark):
    cat = spark.createDataFrame([("x/ISIC_12.jpg",), ("x/ISIC_13.jpg",)], "path string")
    wanted = spark.createDataFrame([("12",), ("ISIC_13",)], "key string")
    got = {r.key: r.path_by for r in J.find_files(wanted, "key", cat).collect()}
    assert got == {"12": "0", "ISIC_13": "0"}


def test_substring_hits_are_not_sorted(spark, monkeypatch):
    """The best file of a key is kept in a hash table: no task sorts its hits.  Shortest stem, then smallest
    path; paths that come twice count once."""
    cat = spark.createDataFrame([("z/ab.jpg",), ("b/xabx.jpg",), ("a/xabx.jpg",), ("a/xabx.jpg",), ("c/qq.jpg",), (None,)], "path string")
    files = [r.path for r in J.ordered_files(cat).orderBy("rank").collect()]
    assert files == [None, "c/qq.jpg", "z/ab.jpg", "a/xabx.jpg", "b/xabx.jpg"]
    plans, write = [], J.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(J, "materialize", noted)
    keys = spark.createDataFrame([("ab",), ("xab",), ("q",), ("none",), (None,)], "k string")
    found = J.resolve_by_substring(keys, "k", cat)
    assert {r.key: r.path for r in found.collect()} == {"ab": "z/ab.jpg", "xab": "a/xabx.jpg", "q": "c/qq.jpg"}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("min(rank" in p for p in plans) and not any("SortAggregate" in p for p in plans)
