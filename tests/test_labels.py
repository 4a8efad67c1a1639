"""Label rules on the hand fixtures (FIXTURES.md, tables 2, 3, 12)."""

from pyspark.sql import functions as F

from caliper.functions import labels as L
from caliper.functions import rules
from caliper.functions.text import extract_id, norm_dx2, strip, to_double_or_null


def _rows(spark, values, schema="x string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_binary_and_family_rules(spark):
    dx = ["Melanoma (in situ)", "basal cell carcinoma", "clark nevus", "seborrheic keratosis",
          "BCC", "nevus with squamous cell carcinoma", None]
    df = _rows(spark, dx).select(
        "x", L.label_binary("x").alias("b"), L.label_family("x").alias("fam"),
        L.label_family("x", exact_codes=rules.FAMILY_EXACT_CODES).alias("fam_codes"))
    got = {r["x"]: r for r in df.collect()}
    assert (got["Melanoma (in situ)"]["b"]["y_malignant"], got["Melanoma (in situ)"]["b"]["y_melanoma"]) == (1, 1)
    assert tuple(got["basal cell carcinoma"]["b"]) == (1, 0)
    assert tuple(got["clark nevus"]["b"]) == (0, 0)
    assert tuple(got["BCC"]["b"]) == (0, 0)
    assert tuple(got[None]["b"]) == (0, 0)
    assert [got[x]["fam"] for x in dx] == ["MEL", "BCC", "NV", "BKL", "MISC", "NV", "MISC"]
    assert got["BCC"]["fam_codes"] == "BCC"
    # Q7: family-derived malignancy differs from the contains rule
    f = df.select("x", L.labels_from_family("fam_codes").alias("f")).collect()
    q7 = {r["x"]: r["f"]["y_malignant"] for r in f}
    assert q7["nevus with squamous cell carcinoma"] == 0
    assert got["nevus with squamous cell carcinoma"]["b"]["y_malignant"] == 1


def test_normalize_family(spark):
    df = _rows(spark, [" melanoma ", "sk", "Basal Cell Carcinoma", "weird", None, "scc"])
    out = [r[0] for r in df.select(L.normalize_family("x")).collect()]
    assert out == ["MEL", "BKL", "BCC", "MISC", "MISC", "SCCKA"]


def test_archive_truth(spark):
    raw = ["Malignant", "Benign", "Indeterminate (malignant?)", "naevus", ""]
    df = _rows(spark, raw).select(L.canon_truth_two_class("x").alias("a"),
                                  L.canon_truth_melanoma("x").alias("b"))
    rows = df.collect()
    assert [r["a"] for r in rows] == ["melanoma", "melanocytic nevus", "melanocytic nevus",
                                      "melanocytic nevus", ""]
    assert [r["b"] for r in rows] == ["melanoma", "non-melanoma", "non-melanoma", "", ""]


def test_dx_groups_and_hits(spark):
    preds = ["Lentigo maligna", "solar lentigo", "Dysplastic nevus", "Bowen's disease",
             "actinic keratoses", "Cherry angioma", None]
    df = _rows(spark, preds).select("x", L.dx_to_group("x").alias("g"))
    got = [r["g"] for r in df.collect()]
    assert got == ["malignant melanocytic proliferations melanoma",
                   "flat melanotic pigmentations not melanocytic nevus",
                   "benign melanocytic proliferations", "malignant epidermal proliferations",
                   None, "benign soft tissue proliferations vascular", None]
    hits = spark.createDataFrame(
        [("Benign melanocytic proliferations", ["wart", "mole", "x"]),
         ("benign melanocytic proliferations", ["wart", "x", "y", "nevus"]),
         ("", ["nevus"])], "t string, p array<string>")
    h = hits.select(L.hit_at_k("t", "p", 1).alias("h1"), L.hit_at_k("t", "p", 3).alias("h3")).collect()
    assert [(r.h1, r.h3) for r in h] == [(False, True), (False, False), (False, False)]
    mal = spark.createDataFrame([("Malignant epidermal proliferations",), (None,)], "g string")
    assert [r[0] for r in mal.select(L.is_malignant_group("g")).collect()] == [True, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t Foo--Bar  ", "x/ISIC_0012.JPG", " 0.7 ")], "a string, b string, c string")
    r = df.select(strip("a").alias("s"), norm_dx2("a").alias("n"), extract_id("b").alias("i"),
                  extract_id(F.lit("none")).alias("j"), to_double_or_null("c").alias("d")).first()
    assert (r.s, r.n, r.i, r.j, r.d) == ("Foo--Bar", "foo bar", "ISIC_0012", None, 0.7)


def test_flags(spark):
    df = spark.createDataFrame([("MEL", "MEL", "NV", 0.2, "Malignant", 0.8),
                                ("NV", "MEL", None, None, "Benign", 0.8)],
                               "a string, b string, c string, p double, lab string, conf double")
    r = df.select(L.flag_equal("a", "b").alias("eq"), L.flag_in("b", ["a", "c"]).alias("inn"),
                  L.threshold_flag("p", rules.RESNET_MEL_THRESHOLD).alias("t"),
                  L.prob_from_label("lab", "conf").alias("pm"),
                  L.correct_flag("a", "b").alias("ok")).collect()
    assert [(x.eq, x.inn, x.t, round(x.pm, 6), x.ok) for x in r] == [
        (1, 1, 1, 0.8, True), (0, 0, 0, 0.2, False)]


def test_resolve_path(spark):
    from caliper.functions.text import resolve_path
    df = spark.createDataFrame([("/abs/x.jpg",), (" rel/y.jpg ",)], "v string")
    assert [r[0] for r in df.select(resolve_path("/base/", "v")).collect()] == ["/abs/x.jpg",
                                                                               "/base/rel/y.jpg"]


def test_metrics_by_group(spark):
    from caliper.operators import metrics
    df = spark.createDataFrame([("b", 1, 1, 0.9), ("b", 0, 0, 0.1), ("a", 1, 1, 0.8), ("a", 1, 0, 0.4),
                                (None, 0, 1, 0.7)], "g string, y int, p int, s double")
    rows = metrics.metrics_by_group(df, "y", "p", "s", "g").collect()
    assert [r.g for r in rows] == ["a", "b"]
    assert rows[0].roc_auc is None and rows[1].roc_auc == 1.0
    assert (rows[0].sensitivity, rows[0].specificity) == (0.5, None)
