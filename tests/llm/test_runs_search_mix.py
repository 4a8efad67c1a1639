"""Operators 11, 12 and 13 against their plain-Python versions, and their edge cases."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caliper.llm import lexical_search, mixing, periodic_runs
from caliper.plans.tables import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"
no_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
DOCS = "doc_id long, text string, source string, rank int, score string, start string, size string, key string, term string"


def _docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "x", "y", "z", "k", "t") for i, t, s in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- 11
@given(st.lists(st.integers(0, 2), max_size=50), st.sampled_from([(2, 2), (6, 3), (24, 3)]))
@settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(words, least):
    r = periodic_runs.find_runs(np.array(words, np.int64), *least)
    got = list(zip(r.start.tolist(), (r.end - r.start).tolist(), r.period.tolist(), strict=True))
    assert got == brute.runs(words, *least)


@pytest.mark.parametrize("words", ["ab" * 200, "a" * 700, "abaab" * 90 + "b", "aab" * 20 + "aabaab" * 20, "x" * 30 + "y" + "x" * 30])
def test_runs_of_long_periods_and_nested_ones(words):
    r = periodic_runs.find_runs(np.frombuffer(words.encode(), np.uint8).astype(np.int64), 2, 2)
    got = list(zip(r.start.tolist(), (r.end - r.start).tolist(), r.period.tolist(), strict=True))
    assert got == brute.runs(words, 2, 2)


def test_fibonacci_words_test_few_suffixes():
    """The string with most runs for its length: as many as brute force finds, in parts of TESTED suffixes."""
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    old, periodic_runs.TESTED = periodic_runs.TESTED, 64
    try:
        r = periodic_runs.find_runs(np.frombuffer(b[:1500].encode(), np.uint8).astype(np.int64), 2, 2)
    finally:
        periodic_runs.TESTED = old
    got = list(zip(r.start.tolist(), (r.end - r.start).tolist(), r.period.tolist(), strict=True))
    assert got == brute.runs(b[:1500], 2, 2)


def _run_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "日本", "x" * 200]
    texts = [None, "", " \n ", "one", " ".join(["same"] * 90), "a  b\tc " * 40, "\n".join(["l1 l2 l3"] * 30)]
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        if rng.random() < 0.5:
            k = rng.randint(1, 12)
            w += (w[-k:] * 40)[:rng.randint(20, 120)] + [rng.choice(vocab)]
        texts.append("\n".join(" ".join(w[i:i + 13]) for i in range(0, len(w), 13)))
    return texts + [" ".join(rng.choice(vocab) for _ in range(40_000)), " ".join(["ab", "c"] * 30_000)]


def test_periodic_runs_operator(spark):
    texts = _run_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (None, texts[4], "s")]
    got = defaultdict(list)
    for r in periodic_runs.periodic_runs(_docs(spark, rows)).collect():
        got[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.text))
    assert len(got[7]) == 2 and got[7][0] == got[7][1] and got[None] == got[4]
    for i, t in enumerate(texts[:-2]):
        w = brute.WORD.findall(t or "")
        found = brute.runs(w)
        assert got[i][0] == (len(w), found, brute.collapse(w, found))
    assert got[len(texts) - 1][0] == (60_000, [(0, 60_000, 2)], "ab c")
    empty = spark.createDataFrame([], DOCS)
    assert periodic_runs.digest(periodic_runs.planted(empty)).count() == 0


def test_best_run_is_compared_exactly(spark):
    kind = "runs array<struct<start:long,length:long,period:long>>"
    rows = [([(5, 30, 10), (9, 9, 3), (2, 33, 11)],), ([],), ([(0, 10**9 + 1, 10**9), (1, 10**9, 10**9 - 1)],), ([(4, 24, 8), (4, 12, 4)],)]
    got = [r.b and tuple(r.b) for r in spark.createDataFrame(rows, kind).select(periodic_runs.best_run().alias("b")).collect()]
    assert got == [(2, 33, 11), None, (1, 10**9, 10**9 - 1), (4, 12, 4)]


@no_data
def test_op11_equals_brute_force(spark):
    from caliper.llm import queries
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = queries.op11(spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        w = brute.planted(r.doc_id, docs[r.doc_id])
        found = brute.runs(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert r.collapsed_sha256 == brute.sha(brute.collapse(w, found))


def test_planted_edges(spark):
    rows = [(i, t, "s") for i in range(60) for t in ("a b  c\nd e f g h i j k l m n o", None, " ", "one")] + [(None, " x  y ", "s")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in periodic_runs.planted(_docs(spark, rows)).collect())
    assert [(a, b, brute.WORD.findall(t)) for a, b, t in got] == sorted(
        (i is None, i or 0, brute.planted(i, t)) for i, t, _ in rows)


# ---------------------------------------------------------------- 12
def _search_rows():
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(120)] + ["É", "日本", "ab1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    def prose(n):
        return " ".join(rng.choices(vocab, weights, k=n))
    docs = [(i, prose(rng.randint(1, 60)), "s") for i in range(300)]
    docs += [(None, docs[5][1], "s"), (400, docs[5][1].upper(), "s"), (5, docs[5][1], "s"), (401, None, "s"), (402, "", "s"), (403, "--", "s"),
             (404, prose(20_000), "s")] + [(500 + i, docs[9][1], "s") for i in range(40)]
    items = [(i, prose(rng.randint(1, 30))) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere at all"), (None, docs[5][1]),
             (3, docs[9][1]), (33, " ".join(vocab))]
    return docs, items


@pytest.mark.parametrize("small", [{}, {"centres": 4, "block": 3, "shard": 16}, {"most_terms": 60, "centres": 2}, {"top": 3}])
def test_search_equals_brute_force(spark, small):
    docs, items = _search_rows()
    got = lexical_search.lexical_search(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **small)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=str)
    assert got == brute.search([(d, t) for d, t, _ in docs], items, small.get("top", 10))


def test_search_of_empty_tables(spark):
    docs, items = _search_rows()
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some_docs, some = _docs(spark, docs[:20]), spark.createDataFrame(items, "item_id long, text string")
    for d, i in ((no_docs, some), (some_docs, no_items), (no_docs, no_items)):
        out = lexical_search.lexical_search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_terms_of_every_document_weigh_nothing(spark):
    docs = _docs(spark, [(i, "all", "s") for i in range(2000)] + [(2000, "all rare", "s")])
    items = spark.createDataFrame([(1, "ALL"), (2, "all Rare")], "item_id long, text string")
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.lexical_search(docs, items).collect())
    assert got == brute.search([(i, "all") for i in range(2000)] + [(2000, "all rare")], [(1, "all"), (2, "all rare")])


def test_blocks_are_skipped_by_their_bounds():
    """A shard of two kinds of documents: an item of one kind never scores the other's blocks."""
    rng = np.random.default_rng(1)
    n, width = 400, 40
    rows = []
    for d in range(n):
        own = np.unique(rng.integers(0, 20, 8) + (20 if d >= n // 2 else 0))
        rows.append(own)
    at = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    terms = np.concatenate(rows)
    impacts = rng.integers(1, 1000, len(terms))
    weights = np.arange(width, 0, -1, dtype=np.int64) * 10
    items, asked = [], []
    for q in range(6):
        own = np.unique(rng.integers(0, 20, 6) + (20 if q % 2 else 0))
        own = np.append(own, 39 if q % 2 == 0 else 19)
        items += [q] * len(own)
        asked += own.tolist()
    queries = lexical_search.Queries(np.array(items), np.array(asked), weights)
    shard = lexical_search.Shard(np.arange(n), at, terms, impacts)
    shard.build((np.arange(n) >= n // 2).astype(np.int64), queries, 8)
    back = lexical_search.Shard.read(dict(zip(lexical_search.NAMES, shard.row(), strict=True)))
    best = [lexical_search.Best(5) for _ in queries.iids]
    looked, scored = lexical_search.search_shard(back, queries, best)
    blocks = len(back.block_term)
    assert scored < looked <= blocks * len(best) and scored < 0.5 * sum(
        int((back.held[back.block_term] == t).sum()) for t in asked)
    for q, b in enumerate(best):
        own = [t for i, t in zip(items, asked, strict=True) if i == q]
        score = back.matrix[:, np.searchsorted(back.held, own)].astype(np.int64) @ weights[own]
        order = np.lexsort((np.arange(n), -score))[:5]
        assert b.ids.tolist() == order.tolist() and b.scores.tolist() == score[order].tolist()


def test_ids_of_binary_vectors_survive_slices():
    flat, at = np.arange(10), np.array([0, 3, 3, 10])
    blobs = lexical_search._blobs(flat, at)
    for cut in (blobs, blobs.slice(1), blobs.slice(2), pa.concat_arrays([blobs.slice(2), blobs])):
        values, offs = lexical_search._ints(cut)
        assert [values[a:b].tolist() for a, b in zip(offs, offs[1:])] == [np.frombuffer(x, np.int32).tolist() for x in cut.to_pylist()]


# ---------------------------------------------------------------- 13
def _mixed(spark, rows, **how):
    return mixing.mix(_docs(spark, rows), **how)


def _words(rng, n):
    return " ".join(rng.choice(["a", "bc", "é", "d1"]) for _ in range(n))


@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=2)), st.integers(0, 400), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_brute_targets_share_all_words(sizes):
    got = brute.targets(sizes)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))
    assert all(t <= 3 * sizes[s] for s, t in got.items())


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, _words(rng, rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "B", "é", None, ""])) for i in range(600)]
    rows += [(1000 + i, _words(rng, 3), "tiny") for i in range(4)] + [(2000, None, "void"), (2001, "", "void"), (None, "x y z", "b")]
    rows += [(3000, "same words here and there", "b")] * 30
    out = _mixed(spark, rows).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(sizes))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.epochs * r.size <= r.taken <= min(3, r.epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, _mixed(spark, rows).collect()))      # reruns agree
    assert want["tiny"] == 3 * sizes["tiny"]


def test_mixed_texts_hold_the_words_taken(spark):
    rng = random.Random(4)
    rows = [(i, _words(rng, rng.randint(0, 20)), rng.choice("abc")) for i in range(120)] + [(7, "one two", "a")] * 3
    docs = _docs(spark, rows)
    mixed = mixing.mix(docs).persist()
    texts = mixing.mixed_texts(docs, mixed)
    words = texts.select("source", F.size(mixing.text_words(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    assert {r.source: r.n for r in words.collect()} == {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    one = mixed.where("size > 0 AND taken > size").orderBy(F.desc("taken")).first()
    own = [r.text for r in texts.where((F.col("doc_id") == one.doc_id)).collect()]
    assert len(own) >= 2 and set(own) <= {r[1] for r in rows} | {" ".join(r[1].split()[:one.taken % one.size]) for r in rows}


def test_better_documents_are_taken_first(spark):
    """Of one source with a fraction of an epoch, documents of quality 4 are taken more often than those of 1."""
    rows = [(i, "a b c d", "a") for i in range(4000)] + [(9000 + i, "x y z", "b") for i in range(2000)]
    out = mixing.mix(_docs(spark, rows), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'a' AND epochs = 0")
    share = {r.k: r.n for r in out.groupBy((F.col("doc_id") % 2).alias("k")).agg(F.avg((F.col("taken") > 0).cast("int")).alias("n")).collect()}
    assert share[0] > 1.5 * share[1] > 0


def test_mix_of_empty_tables_and_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = _mixed(spark, [(1, None, "a"), (2, "", None), (3, " ", "a")]).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3
