"""Skew: one group holding most of the rows must not land in one window task."""

import random

from pyspark.sql import functions as F

from caliper.operators import curves, prefix


def test_hot_group_is_split_into_bounded_buckets(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.random()) for _ in range(2000)] + \
           [(g, rnd.random()) for g in ("a", "b") for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").count()
    sizes = (prefix.bucketed(df, ["g"], "v", buckets=10)
             .groupBy("g", "__bucket").count().agg(F.max("count")).first()[0])
    # the hot group is cut like every other group: no (group, bucket) cell is far
    # above the per-bucket budget, although the group itself holds 2000 rows
    assert sizes <= 300 * 1.5


def test_hot_score_value_collapses_before_the_shuffle(spark):
    rows = [(1 if i % 3 else 0, 0.5) for i in range(3000)] + [(i % 2, i / 100.0) for i in range(100)]
    df = spark.createDataFrame(rows, "y int, s double")
    pts = curves.roc_points(df, "y", "s", buckets=20)
    got = {r.score: (r.pos, r.neg) for r in pts.collect()}
    assert got[0.5][0] + got[0.5][1] >= 3000   # one points row carries the whole hot value
    s = curves.curve_summary(df, "y", "s", buckets=20).first()
    assert 0.0 <= s.roc_auc <= 1.0
