"""Ensembles (FIXTURES tables 9 and 10) and the average-tie percentile rank."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caliper.operators import ensemble


def test_checkpoint_fixture(spark):
    rows = []
    vals = {0: (0.2, 0.4, 0.9), 1: (0.5, 0.5, 0.1), 2: (0.5, 0.5, 0.3), 3: (None, None, None)}
    for r, (a1, a2, b1) in vals.items():
        rows += [(r, "A1", "A", a1), (r, "A2", "A", a2), (r, "B1", "B", b1)]
    long = spark.createDataFrame(rows, "row_id long, checkpoint string, arch string, prob double")
    got = {r.row_id: r for r in ensemble.ensemble_scores(long).collect()}
    assert got[0].prob_ensemble == pytest.approx(0.6)
    assert got[1].prob_ensemble == pytest.approx(0.3)
    assert got[2].prob_ensemble == pytest.approx(0.4)
    assert got[3].prob_ensemble is None and got[3].rank_ensemble is None
    assert got[0].rank_ensemble == pytest.approx(2 / 3)
    assert got[1].rank_ensemble == pytest.approx(0.583333, abs=1e-6)
    assert got[2].rank_ensemble == pytest.approx(0.75)
    wide = ensemble.wide_checkpoint_matrix(long, ["A1", "A2", "B1"]).where("row_id = 0").first()
    assert (wide.A1, wide.A2, wide.B1) == (0.2, 0.4, 0.9)


@pytest.mark.parametrize("buckets", [None, 13])
def test_pct_rank_matches_pandas(spark, buckets):
    rnd = random.Random(5)
    rows = [(i, g, None if rnd.random() < 0.1 else round(rnd.random(), 1))
            for i, g in enumerate(["x"] * 150 + ["y"] * 40)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: r.pct_rank for r in ensemble.pct_rank_avg(df, ["g"], "v",
                                                           buckets=buckets).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    exp = pdf.groupby("g")["v"].rank(pct=True)
    for i, e in zip(pdf["id"], exp):
        if math.isnan(e):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(e)
    small = spark.createDataFrame([(1, "k", 0.2), (2, "k", 0.2), (3, "k", 0.5)], "id long, g string, v double")
    assert sorted(r.pct_rank for r in ensemble.pct_rank_avg(small, ["g"], "v").collect()) == [0.5, 0.5, 1.0]


def test_softmax_and_top_families(spark):
    probs = [0.30, 0.28, 0.27, 0.15]
    logits = [math.log(p) for p in probs]
    df = spark.createDataFrame([(0, 0, logits), (0, 1, logits)], "row long, fold int, logits array<double>")
    sm = df.select(ensemble.softmax("logits").alias("p")).first().p
    assert sm == pytest.approx(probs)
    dim = spark.createDataFrame([(0, "melanoma-a", "MEL"), (1, "nevus-a", "NV"), (2, "nevus-b", "NV"),
                                 (3, "bcc", "BCC")], "class_idx int, class string, family string")
    cp = ensemble.class_probabilities(df, "row", "fold", "logits")
    sd = cp.where("class_idx = 0").first().sd
    assert sd == pytest.approx(0.0, abs=1e-12)
    scores = ensemble.map_class_to_family(cp, dim)
    fam = {r.family: r.prob for r in ensemble.family_probability(scores, "row").collect()}
    assert fam == pytest.approx({"NV": 0.55, "MEL": 0.30, "BCC": 0.15})
    top = ensemble.top_families(scores, "row", k=3).first().top
    assert [(t.family, t.diagnosis) for t in top] == [("MEL", "melanoma-a"), ("NV", "nevus-a"),
                                                      ("BCC", "bcc")]
    comp = ensemble.composite_probability(ensemble.family_probability(scores, "row"), "row").first()
    assert comp.invasive == pytest.approx(0.45) and comp.benign == pytest.approx(0.55)
    hit = ensemble.top_families(scores, "row", 3).select(
        ensemble.topk_hit("top", F.lit("BCC"), 2).alias("h2"),
        ensemble.topk_hit("top", F.lit("BCC"), 3).alias("h3")).first()
    assert (hit.h2, hit.h3) == (False, True)
    # unmapped class -> NA
    dim2 = dim.where("class_idx < 3")
    fams = {r.family for r in ensemble.map_class_to_family(cp, dim2).collect()}
    assert "NA" in fams
