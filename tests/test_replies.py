"""Reply parsing (FIXTURES table 6) and field defaults."""

from pyspark.sql import functions as F

from caliper.operators import replies as R

OBJ = '{"pred":"Benign","confidence":0.8}'
TEXTS = [OBJ, "```json " + OBJ + " ```", "Sure: " + OBJ + " hope it helps",
         '{"a":1} {"b":2}', '{"a":1} x', "no json here"]


def _ok(spark, mode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    out = R.parse_replies(df, "text", mode=mode).orderBy("id").collect()
    return [r["_error"] is None for r in out]


def test_modes(spark):
    assert _ok(spark, "fenced") == [True, True, False, False, False, False]
    assert _ok(spark, "fenced_or_embedded") == [True, True, True, False, True, False]
    assert _ok(spark, "embedded") == [True, True, True, False, True, False]
    assert _ok(spark, "strict") == [True, False, False, False, False, False]


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{'a':1}",), ('{"a":1},{"b":2}',), ("1],[2",), ("",)], "s string")
    got = [r[0] for r in df.select(R.parse_json_strict("s").isNotNull()).collect()]
    assert got == [True, False, False, False, False]


def test_on_error_modes(spark):
    df = spark.createDataFrame([(1, OBJ), (2, "junk")], "id int, text string")
    assert R.parse_replies(df, "text", "strict", on_error="drop").count() == 1
    kept = R.parse_replies(df, "text", "strict", on_error="keep").orderBy("id").collect()
    assert kept[1]["_error"] == R.ERR_PARSE and kept[1]["_reply"] is None
    shape = spark.createDataFrame([(1, '{"differential": [{"diagnosis": "a"}]}')], "id int, text string")
    s = R.parse_replies(shape, "text", "strict", list_key="differential", exact_items=3).first()
    assert s["_error"] == R.ERR_SHAPE.format(k=3)
    try:
        R.parse_replies(df, "text", "strict", on_error="fail").collect()
        raise AssertionError("expected failure")
    except Exception as e:  # noqa: BLE001
        assert "bad reply" in str(e)


def test_family_fields(spark):
    texts = [
        '{"primary_family": "mel", "top1_probability": "0.7", "top3_differential": '
        '[{"diagnosis": "x", "family": "NV", "probability": 0.2}]}',
        '{"primary_family": null, "top1_probability": null, "top3_differential": []}',
        '{"top3_differential": [{"diagnosis": "d1", "family": "sk", "probability": 0.4}]}',
        '{"top3_differential": "oops"}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    p = R.family_top3(R.parse_replies(df, "text", "strict")).orderBy("id").collect()
    assert (p[0].top1_family, p[0].top1_probability, p[0].top2_family, p[0].top2_probability) == \
        ("MEL", 0.7, "MISC", 0.0)
    assert (p[1].top1_family, p[1].top1_probability, p[1].n_items) == ("MISC", None, 0)
    assert (p[2].top1_family, p[2].top1_diagnosis, p[2].top1_probability) == ("BKL", "d1", 0.4)
    assert (p[3].top1_family, p[3].n_items) == ("MISC", 0)


def test_truthy_and_differential(spark):
    df = spark.createDataFrame([('{"a": true, "b": "false", "c": 0, "d": [], "e": "x",'
                                 ' "differential": [{"diagnosis": "Melanoma", "confidence": "0.6"},'
                                 ' {"diagnosis": "blue nevus"}]}',)], "text string")
    v = R.parse_replies(df, "text", "strict")
    r = v.select(*[R.truthy(R.field("_reply", k)).alias(k) for k in "abcdef"],
                 R.differential("_reply", two_class=True).alias("dd")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (True, True, False, False, True, False)
    assert [(x.diagnosis, x.confidence) for x in r.dd] == [
        ("melanoma", 0.6), ("melanocytic nevus", 0.0), ("melanocytic nevus", 0.0)]
    j = v.select(R.list_to_json(F.array(F.lit(1), F.lit(2)))).first()[0]
    assert j == "[1,2]"


def test_several_modes_parse_a_text_once(spark):
    """A list of modes gives what one row per mode gives, and texts that the modes read alike are parsed once."""
    ok = '{"primary_diagnosis": "x", "top3_differential": []}'
    texts = [ok, f"```json\n{ok}\n```", f"  {ok}\n", f"Sure: {ok} Bye.", f"{ok} {ok}", "[1]", "7", "", "   ", None, "no", "{", "}{",
             f"```\nSo: {ok}\n```", f"```JSON {ok}```", '{"a": 1}}', f"x {ok} ```", "null", '"{}"', f" {ok}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    one = R.parse_replies(df.select("*", F.explode(F.array(*[F.lit(m) for m in R.MODES])).alias("mode")), "text", mode=F.col("mode"))
    every = R.parse_replies(df, "text", mode=R.MODES)
    cols = ["id", "mode", F.col("_reply").cast("string").alias("reply"), "_error"]
    assert sorted(map(str, every.withColumn("mode", F.explode("modes")).select(*cols).collect())) == sorted(map(str, one.select(*cols).collect()))
    assert [sorted(r.modes) for r in every.where("id = 0").collect()] == [sorted(R.MODES)]
    assert R.parse_replies(df, "text", mode=["strict", "fenced"], on_error="drop").where("id = 0").count() == 1
