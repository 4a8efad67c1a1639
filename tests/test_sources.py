"""Sources and sinks on small files written by the test."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from caliper.sources import readers as S
from caliper.sources import sinks


def test_read_ids_text_and_csv(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_bytes(b"ISIC_2\r\n\r\n ISIC_1 \r\nISIC_2\r\n")
    got = [r.id for r in S.read_ids(spark, str(p)).orderBy("pos").collect()]
    assert got == ["ISIC_2", "ISIC_1"]
    c = tmp_path / "ids.csv"
    c.write_text("x,id\n1,b\n2,a\n3,b\n")
    assert [r.id for r in S.read_ids(spark, str(c), "id").orderBy("pos").collect()] == ["b", "a"]
    try:
        S.read_ids(spark, str(c))
        raise AssertionError
    except ValueError:
        pass


def test_csv_tables(spark, tmp_path):
    p = tmp_path / "meta.csv"
    p.write_text("case,score,n\nA,0.5,1\nB,NA,2\nNA,nan,x\n")
    schema = StructType([StructField("case", StringType()), StructField("score", DoubleType()),
                         StructField("n", IntegerType())])
    rows = S.read_table_csv(spark, str(p), schema).collect()
    assert [tuple(r) for r in rows] == [("A", 0.5, 1), ("B", None, 2), (None, None, None)]
    s = S.read_table_strings(spark, str(p)).collect()
    assert s[2]["case"] == "NA"
    try:
        S.require_columns(s and spark.read.option("header", True).csv(str(p)), ["nope"])
        raise AssertionError
    except ValueError as e:
        assert "nope" in str(e) and "available" in str(e)


def test_file_catalog_and_payloads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"\xff\xd8jpeg")
    (tmp_path / "sub" / "ISIC_7.png").write_bytes(b"\x89PNGdata" * 20)
    (tmp_path / "notes.txt").write_text("x")
    cat = S.read_file_catalog(spark, str(tmp_path))
    names = [os.path.basename(r.path) for r in cat.collect()]
    assert names == ["a.JPG", "ISIC_7.png"]
    plan = cat._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    top = S.read_file_catalog(spark, str(tmp_path), recursive=False)
    assert [os.path.basename(r.path) for r in top.collect()] == ["a.JPG"]
    one = S.read_file_catalog(spark, str(tmp_path), name_regex=r"ISIC_\d+", limit=1)
    assert one.count() == 1
    pay = S.image_payloads(S.read_file_catalog(spark, str(tmp_path), with_content=True)).collect()
    urls = sorted(r.data_url for r in pay)
    assert urls[0].startswith("data:image/jpeg;base64,") and "\n" not in urls[1]
    ext = S.read_file_catalog(spark, str(tmp_path), with_content=True).select(
        S.data_url("content", "path", "extension").alias("u")).collect()
    assert sorted(r.u.split(";")[0] for r in ext) == ["data:image/jpeg", "data:image/png"]


def test_class_map(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"0": "mel", "1": "nev", "2": "odd"}))
    (tmp_path / "f.json").write_text(json.dumps({"mel": "MEL", "nev": "NV"}))
    got = sorted(tuple(r) for r in S.read_class_map(spark, str(tmp_path / "i.json"),
                                                     str(tmp_path / "f.json")).collect())
    assert got == [(0, "mel", "MEL"), (1, "nev", "NV"), (2, "odd", "NA")]


def test_flatten_and_widen(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": [10, {"d": null}], "e": {}, "f": []}'),
                                (2, '{"isic_id": "X", "a": {"b": 2}}')], "id int, j string")
    flat = sorted((r.id, r.key, r.value) for r in S.flatten_json(df, "id", "j").collect())
    assert flat == [(1, "a.b", "1"), (1, "c[0]", "10"), (1, "c[1].d", None),
                    (2, "a.b", "2"), (2, "isic_id", "X")]
    long = S.flatten_json(df, "id", "j")
    keys = [r.key for r in S.metadata_keys(long, "id").orderBy("first", "key").collect()]
    wide = S.widen_metadata(long, "id", keys)
    assert wide.columns[:2] == ["id", "isic_id"]
    r = {x.id: x for x in wide.collect()}
    assert r[1]["isic_id"] == "" and r[2]["a.b"] == "2" and r[1]["c[1].d"] == ""


def test_flatten_deep_and_broken(spark):
    deep = '{"a":' * 70 + '["x", {}]' + "}" * 70
    rows = [(1, deep), (2, '{"a": 1'), (3, None), (4, '"s \\" {[ "'), (5, '{"k\\\\": "{{{{", "l": [[1]]}')]
    got = sorted((r.id, r.key, r.value) for r in S.flatten_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect())
    assert got == [(1, ".".join("a" * 70) + "[0]", "x"), (2, "_error", S.ERR_RECORD), (4, None, 's " {[ '),
                   (5, "k\\", "{{{{"), (5, "l[0][0]", "1")]


def test_row_ids(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3 % 1000).alias("v"))
    ids = S.with_row_id(df, ["v"]).orderBy("v").collect()
    assert [r.row_id for r in ids] == list(range(1000))


def test_fetch_status(spark):
    rows = [("A", "meta", None, True, None, None, 0), ("A", "image", "existing", False, None, "no", 1),
            ("A", "image", "s3_png", True, None, None, 2),
            ("B", "meta", None, False, 404, None, 0), ("B", "image", "s3_jpg", False, None, "403", 1),
            ("C", "meta", None, False, None, "boom", 0), ("C", "image", "api_download", True, None, None, 1)]
    att = spark.createDataFrame(rows, "id string, kind string, source string, ok boolean, "
                                      "http_code int, message string, seq int")
    got = {r.id: (r._status, r._image_src) for r in S.fetch_status(att).collect()}
    assert got == {"A": ("OK", "s3_png"), "B": ("HTTPError 404 (image error: 403)", ""),
                   "C": ("Error: boom", "api_download")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "OK"), (2, "HTTPError 404")], "id int, st string")
    sinks.write_predictions(df, str(tmp_path / "p"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "p")).count()
    assert back == 2
    sinks.append_predictions(df, str(tmp_path / "s"))
    sinks.append_predictions(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    sinks.write_metrics(df, str(tmp_path / "m"), notes={"dataset": "x"})
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert {"notes": {"dataset": "x"}} in lines and len(lines) == 3
    sinks.write_failures(df, "id", "st", str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ["2\tHTTPError 404"]


def test_nested_metrics(spark, tmp_path):
    m = spark.createDataFrame([("mal", "prob", "fixed", 0.9, 3), ("mal", "prob", "youden", 0.8, 4),
                               ("mel", "rank", "fixed", 0.7, 5)],
                              "target string, score_name string, mode string, auc double, n int")
    sinks.write_metrics_nested(m, str(tmp_path / "m"), ["target", "score_name", "mode"],
                               notes={"dataset": "d"}, csv_path=str(tmp_path / "c"))
    doc = json.loads("".join(open(os.path.join(tmp_path, "m", f)).read()
                             for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part-")))
    assert doc["metrics"]["mal"]["prob"]["youden"] == {"auc": 0.8, "n": 4}
    assert doc["metrics"]["mel"]["rank"]["fixed"]["n"] == 5 and doc["notes"] == {"dataset": "d"}
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
