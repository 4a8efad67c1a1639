import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from caliper.llm import registry
from caliper.llm.common import bounded_batches, map_text
from caliper.plans.tables import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(n))
    texts = [prose(8) for _ in range(40)]
    item = " ".join(rng.choice(vocab) for _ in range(15))
    texts[1] = f"{texts[1]} {item}"                          # leaks
    texts[3] = texts[2]                                      # an exact copy
    texts[4] = texts[2].replace(texts[2].split()[50], "new", 1)
    texts[5] = " ".join(f"{w}$$$" for w in texts[5].split())    # junk
    texts[6:9] = [None, "", "too short"]
    foot = "one line that stands on every site there is in this table"
    texts[20:34] = [f"{t}\n{foot}" for t in texts[20:34]]
    docs = pa.table({"doc_id": pa.array(range(40)), "text": texts, "lang": ["en"] * 40, "source": [f"s{i}" for i in range(40)],
                     "n_chars": [len(t or "") for t in texts]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    good = [i for i in range(40) if i not in (5, 6, 7, 8)]
    pq.write_table(pa.table({"doc_id": good, "quality": [1] * len(good), "toxic": [0] * len(good)}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    now, seen = table(spark, str(tmp_path), "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.column_names
            now.write.parquet(str(tmp_path / f"stage{k}"))
            now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r.doc_id: r for r in now.collect()})
    assert set(seen[0]) == set(good)
    assert set(seen[1]) == set(good)
    for i, r in seen[1].items():
        assert r.text == texts[i].replace(f"\n{foot}", "") and r.n_chars == len(r.text)
    assert set(seen[2]) == set(good) - {3, 4}
    assert set(seen[3]) == set(seen[4]) == set(good) - {3, 4, 1}
    assert all(r.exact for r in seen[4].values())


def test_copies_on_many_sites_keep_one(spark):
    """Exact and near copies on 12 sites pass the line stage, and near-dedup keeps one of each."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(n))
    foot = "one line that stands on every site there is in this table"
    copy, near = prose(8), prose(8)
    texts = [copy] * 12 + [near.replace(near.split()[20 * k // 2 + 5], f"new{k}", 1) for k in range(12)] \
        + [f"{prose(6)}\n{foot}" for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 12}", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.lines(spark, docs, "")
    got = {r.doc_id: r for r in left.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t.replace(f"\n{foot}", "") for i, t in enumerate(texts)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    kept = {r.doc_id for r in corpus_pipeline.near(spark, left, "").collect()}
    assert kept & set(range(12)) == {0} and kept >= set(range(24, 36)) and kept & set(range(12, 24))


def _prose(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    return lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(n))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def test_menus_go_from_every_page(spark):
    """Pages that are mostly menu lose the menu on all sites; near copies on as many keep their lines."""
    prose = _prose(8)
    menu = "\n".join(f"menu entry number {k} of the site" for k in range(6))
    near = prose(8)
    texts = [f"{menu}\n{prose(4)}" for _ in range(20)] + [near.replace(near.split()[7 * k + 3], "new", 1) for k in range(20)]
    rows = [(i, t, "en", f"s{i % 20}", len(t)) for i, t in enumerate(texts)]
    rows += [(40, None, "en", "s1", 0), (None, texts[0], None, None, None), (41, "", "en", None, 0)]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert all(got[i] == texts[i].removeprefix(f"{menu}\n") for i in range(20)) and got[None] == got[0]
    assert all(got[i] == texts[i] for i in range(20, 40)) and got[40] is None and got[41] == ""
    want = brute.spread_lines_over_classes([(t, s) for _, t, _, s, _ in rows], 10)
    assert [got[r[0]] for r in rows] == want


def test_shared_and_missing_ids_lose_no_text(spark):
    prose = _prose(9)
    a, b, c = prose(8), prose(8), prose(8)
    a2, c2, c3 = (x.replace(x.split()[k], "new", 1) for x, k in ((a, 40), (c, 30), (c, 60)))
    rows = [(1, a), (2, a2), (2, b), (None, c), (None, c2), (None, c3), (None, c), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int, k1 string, node string")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert (1, a) in got and (2, b) in got and (2, a2) not in got
    assert sum(t in (c, c2, c3) for _, t in got) == 1 and got.count((5, "")) == 1 and (6, None) in got and len(got) == 5
    same = spark.createDataFrame([(1, a, "en", "s", 1), (1, a2, "en", "s", 1)], COLUMNS)
    assert corpus_pipeline.near(spark, same, "").count() == 1


def test_stages_on_empty_tables_equal_rows_and_extra_columns(spark, tmp_path):
    prose = _prose(10)
    text = prose(8)
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                      ("n_chars", pa.int64()), ("row", pa.string()), ("k2", pa.int64()), ("component", pa.string())])
    labels = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])
    items = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    full = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": 1, "row": "r", "k2": 2, "component": "c"}
            for i, t in ((1, text), (1, text), (1, text), (2, prose(8)), (None, prose(8)))]
    for name, docs in (("empty", []), ("full", full)):
        d = tmp_path / name
        d.mkdir()
        pq.write_table(pa.Table.from_pylist(docs, kind), d / "documents.parquet")
        pq.write_table(pa.Table.from_pylist([], labels), d / "labels.parquet")
        pq.write_table(pa.Table.from_pylist([], items), d / "benchmark.parquet")
        now = table(spark, str(d), "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(d))
            assert now.columns == kind.names
            now = spark.createDataFrame(now.collect(), now.schema)
        rows = now.collect()
        assert sorted((r.doc_id or 0, r.row, r.k2, r.component) for r in rows) == ([(0, "r", 2, "c"), (1, "r", 2, "c"), (2, "r", 2, "c")] if docs else [])
        assert corpus_pipeline.run(spark, str(d)).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_run_equals_brute_force(spark):
    """run() over the smallest tables: every stage's verdict against plain Python."""
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert all(brute.base_measures(r.text)[0] >= 20 for r in kept.values())
    rows = sorted(kept.items())
    texts = dict(zip(kept and [i for i, _ in rows], brute.spread_lines_over_classes([(r.text, r.source) for _, r in rows], 10)))
    near = brute.near(texts.items(), size=5)
    left = {i: t for i, t in texts.items() if near[i][1] == i}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {i for (i, t), c in zip(left.items(), brute.contamination(left.values(), items)) if not c[1]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: brute.sha(left[i]) for i in clean}


def test_batches_of_texts_are_small(spark):
    """An executor keeps what batches once took outside its heap, so no batch is more than 2 MB and a row."""
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat(concat(id, ' '), 5000) AS text")
    size = lambda part: iter([pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], ["n", "size"])])
    got = map_text(docs, size, "n long, size long", most=1 << 40).collect()
    assert sum(r.n for r in got) == 400 and sum(r.size for r in got) > 7 << 20
    assert max(r.size for r in got) <= (2 << 20) + (1 << 16)
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        bounded_batches(spark, 8 << 20)
        assert spark.conf.get(key) == str(8 << 20)
        spark.conf.set(key, "5000000")                       # the session's own
        bounded_batches(spark)
        assert spark.conf.get(key) == "5000000"
    finally:
        spark.conf.set(key, before)


def test_registered():
    names, _ = registry.load()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
