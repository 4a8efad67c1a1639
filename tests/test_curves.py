"""ROC / PR / Youden against hand values (FIXTURES table 11) and brute force."""

import math
import random

import pytest

from caliper.operators import curves, metrics, prefix


def _df(spark, rows, grp=False):
    if grp:
        return spark.createDataFrame(rows, "g string, y int, score double")
    return spark.createDataFrame(rows, "y int, score double")


def brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y != 1]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    thr = sorted({s for _, s in rows}, reverse=True)
    ap, prev_r = 0.0, 0.0
    best = (0.0, math.inf)
    for t in thr:
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y != 1 and s >= t)
        r = tp / len(pos)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
        j = tp / len(pos) - fp / len(neg)
        if j > best[0]:
            best = (j, t)
    return auc, ap, best[1]


def test_fixture_values(spark):
    df = _df(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3)])
    s = curves.curve_summary(df, "y", "score").first()
    assert s.roc_auc == pytest.approx(0.875)
    assert s.pr_auc == pytest.approx(0.833333, abs=1e-6)
    assert s.youden_threshold == 0.9  # tie between 0.9 and 0.8 -> larger threshold
    m = {r["mode"]: r for r in curves.metrics_at_threshold(df, "y", "score", threshold=0.5).collect()}
    f = m["fixed_threshold"]
    assert (f.tp, f.fp, f.tn, f.fn) == (2, 1, 1, 0)
    assert (f.accuracy, f.recall, f.specificity) == (0.75, 1.0, 0.5)
    assert f.precision == pytest.approx(2 / 3) and f.npv == 1.0 and f.f1 == pytest.approx(0.8)


def test_edge_rows(spark):
    one = curves.curve_summary(_df(spark, [(1, 0.3), (1, 0.9)]), "y", "score").first()
    assert one.roc_auc is None and one.pr_auc is None and one.youden_threshold is None
    inv = curves.curve_summary(_df(spark, [(1, 0.1), (0, 0.9)]), "y", "score").first()
    assert inv.youden_threshold == math.inf and inv.roc_auc == 0.0
    c = metrics.binary_metrics(metrics.confusion_counts(
        _df(spark, [(1, 0.0), (0, 0.0)]), "y", "score")).first()
    assert c.precision == 0.0 and c.recall == 0.0 and c.specificity == 1.0
    e = metrics.binary_metrics(metrics.confusion_counts(
        _df(spark, [(1, 1.0), (1, 0.0)]), "y", "score"), style="eps").first()
    assert e.specificity == 0.0 and list(e.confusion_matrix[1]) == [1, 1]
    a = metrics.binary_metrics(metrics.confusion_counts(
        _df(spark, [(1, 1.0), (1, 0.0)]), "y", "score")).first()
    assert a.specificity is None


@pytest.mark.parametrize("buckets", [None, 1, 23])
def test_brute_force_grouped(spark, buckets):
    rnd = random.Random(7)
    rows = []
    for g in ("a", "b", "c"):
        for _ in range(400 if g == "a" else 60):
            s = round(rnd.random(), 2)  # ties
            rows.append((g, int(rnd.random() < 0.3 + 0.5 * s), s))
    df = _df(spark, rows, grp=True)
    got = {r.g: r for r in curves.curve_summary(df, "y", "score", by=["g"], thresholds=(),
                                                buckets=buckets).collect()}
    for g in ("a", "b", "c"):
        sub = [(y, s) for gg, y, s in rows if gg == g]
        auc, ap, thr = brute(sub)
        assert got[g].roc_auc == pytest.approx(auc, abs=1e-12)
        assert got[g].pr_auc == pytest.approx(ap, abs=1e-12)
        assert got[g].youden_threshold == thr
    # a permutation of the input (here: repartitioning) changes nothing
    again = {r.g: r.roc_auc for r in curves.curve_summary(
        df.repartition(7), "y", "score", by=["g"], thresholds=(),
        buckets=buckets).collect()}
    assert again == {g: got[g].roc_auc for g in got}


def test_auc_symmetry_and_curve(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.4), rnd.random()) for _ in range(300)]
    df = _df(spark, rows)
    a = curves.curve_summary(df, "y", "score", thresholds=()).first().roc_auc
    flipped = spark.createDataFrame([(y, 1 - s) for y, s in rows], "y int, score double")
    b = curves.curve_summary(flipped, "y", "score", thresholds=()).first().roc_auc
    assert a + b == pytest.approx(1.0)
    curve = curves.roc_curve(df, "y", "score").collect()
    assert len(curve) == len({s for _, s in rows}) + 1
    assert max(r.tpr for r in curve) == 1.0


def test_grid_one_pass_matches_cells(spark):
    rnd = random.Random(11)
    rows = [(int(rnd.random() < 0.5), int(rnd.random() < 0.2), rnd.random(), round(rnd.random(), 1))
            for _ in range(500)]
    df = spark.createDataFrame(rows, "y1 int, y2 int, s1 double, s2 double")
    from pyspark.sql import functions as F
    g = curves.metrics_grid(df, {"t1": F.col("y1"), "t2": F.col("y2")},
                            {"a": F.col("s1"), "b": F.col("s2")})
    got = {(r.target, r.score_name, r["mode"]): r for r in g.collect()}
    assert len(got) == 8
    one = curves.metrics_at_threshold(df, "y2", "s2").collect()
    for r in one:
        assert got[("t2", "b", r["mode"])].roc_auc == pytest.approx(r.roc_auc)
        assert got[("t2", "b", r["mode"])].tp == r.tp
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_few_and_many_buckets_agree(spark, by):
    """One bucket and many give equal rows, NULL groups included."""
    rows = [(None if i % 3 == 0 else i % 3, None if i % 2 else "x", float(i), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, h string, v double, c long")
    want = {r[2]: (sum(x[3] for x in rows if x[2] <= r[2] and all(x["gh".index(b)] == r["gh".index(b)] for b in by)),
                   sum(x[3] for x in rows if all(x["gh".index(b)] == r["gh".index(b)] for b in by))) for r in rows}
    for buckets in (1, 13):
        got = prefix.running_sums(df, by, "v", ["c"], buckets=buckets)
        assert {r.v: (r.cum_c, r.tot_c) for r in got.collect()} == want
    assert prefix.bucketed(df, by, "v", 13).select("__bucket").distinct().count() > 8


def test_missing_prediction_modes(spark):
    """Q3: metadata rows without a prediction are excluded by default; the
    'negative' mode counts them as predicted non-melanoma, like the original."""
    df = spark.createDataFrame([("melanoma", "melanoma"), ("melanoma", None), ("non-melanoma", None),
                                ("", "melanoma")], "truth string, pred string")
    e = metrics.eval_counts(df, "truth", "pred").first()
    assert (e.n_total, e.n_with_truth, e.n_with_pred, e.n_evaluated) == (4, 3, 2, 1)
    q3 = metrics.eval_counts(df, "truth", "pred", missing_pred="negative").first()
    assert (q3.n_with_pred, q3.n_evaluated) == (4, 3)
    ev = df.where("truth <> ''")
    a = metrics.binary_metrics_label(ev, "truth", "pred").first()
    b = metrics.binary_metrics_label(ev, "truth", "pred", missing_pred="negative").first()
    assert (a.n, a.tp, a.fn, a.tn) == (1, 1, 0, 0)
    assert (b.n, b.tp, b.fn, b.tn) == (3, 1, 1, 1) and list(b.labels) == ["non-melanoma", "melanoma"]
