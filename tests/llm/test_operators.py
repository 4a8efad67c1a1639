import json
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caliper.llm import (
    decontaminate, html_text, line_dedup, masked_lm, near_dedup, quality_rules, sentencepiece_trie,
    substring_dedup, textnp, token_file, tool_chat,
)
from caliper.llm.components import components
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, k1 string, row string, h1 int"


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "日本", "Über,", "$$", "|", "x" * 300]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 160))) for _ in range(12)]
    out = [None, "", "  \n ", "one", "two words", "a b c", "A B C", "a  b\tc", " ".join(["same"] * 90)]
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 3, 8, 30])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = rng.choice(base).split()[:50] + w
        out.append("\n".join(" ".join(w[i:i + 17]) for i in range(0, len(w), 17)))
    out += [out[20], out[20], rng.choice(base) * 3, " ".join(rng.choice(vocab) for _ in range(30_000))]
    return out


def _docs(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 7}" if i % 11 else None, "k", "r", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@given(st.lists(st.one_of(st.none(), st.text("ab \n\té \x1c", max_size=30)), max_size=20), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_words_and_grams(texts, size):
    w = textnp.Words(pa.array(texts, pa.string()))
    cut = [brute.WORD.findall(t or "") for t in texts]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == [x for c in cut for x in c]
    assert w.n_words.tolist() == list(map(len, cut))
    runs = [tuple(c[i:i + size]) for c in cut for i in range(len(c) - size + 1)]
    got, at = w.grams(w.hashes(), size)
    assert at[-1] == len(got) == len(runs)
    assert len(set(zip(runs, got.tolist()))) == len(set(runs)) == len(set(got.tolist()))


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = _texts() + ["  two  spaces \n\n x ", " a", "a ", "a \nb", "it's <|endoftext|> x", "\x1c \x85 y", "  z  q", "1 234"]
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    ids[5] = None
    got = token_file.token_digest(_docs(spark, texts, ids), path).orderBy("start").collect()
    want, start = [], 0
    for doc, text in sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0])):
        found = tok.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    assert [tuple(r) for r in got] == want


@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]), min_size=1, max_size=9), max_size=6))
@settings(max_examples=100, deadline=None)
def test_variable_bytes(docs):
    coded = [token_file.encode_ranks(np.array(d, np.uint32)) for d in docs]
    n = np.array([len(d) for d in docs], np.int64)
    got = token_file.decode_ranks(b"".join(c for c, _ in coded), b"".join(d for _, d in coded), n)
    assert got.tolist() == [x for d in docs for x in d]


def test_line_dedup(spark):
    texts = _texts() + ["a shared line\nown one\n\n", "a shared line", "a shared line\nb", "a shared line", None]
    docs = _docs(spark, texts)
    for least in (2, 3, 6):
        got = line_dedup.line_dedup(docs, min_sites=least).select("row.doc_id", "text").collect()
        rows = [(t, f"s{i % 7}" if i % 11 else None) for i, t in enumerate(texts)]
        assert dict(map(tuple, got)) == dict(enumerate(brute.spread_lines(rows, least)))
    exact = line_dedup.boilerplate(docs, min_sites=3, margin=0.9)      # all near the threshold
    clear = line_dedup.boilerplate(docs, min_sites=3, margin=0.0)      # none
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, clear.collect()))


def test_quality_score_equals_plain_python(spark):
    """Every document's log ratio, from counts made in plain Python over the same cells."""
    texts = _texts(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9, 40)] + [(41, 0, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")

    def cells(words):
        w = textnp.Words(pa.array([" ".join(words)]))
        single = [int(x) for x in textnp.mix(w.hashes())]
        pairs = [int(textnp.Words(pa.array([" ".join(p)])).grams(textnp.Words(pa.array([" ".join(p)])).hashes(), 2)[0][0])
                 for p in zip(words, words[1:])]
        return [x % quality_rules.BUCKETS for x in single + pairs]

    texts = [t if t is None or len(t) < 20_000 else t[:2000] for t in texts]
    want = brute.log_ratio_scores(texts, [i for i in range(9, 40)], cells, quality_rules.BUCKETS)
    got = {r.doc_id: r.score for r in quality_rules.quality_rules(_docs(spark, texts), labels).collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in enumerate(want)) and max(want) - min(want) > 0.1


def test_quality_measures_and_verdict(spark):
    texts = _texts() + ["#*$%&|<> x", "l\nl\nl \nl"]
    junk = [" ".join(f"{w}$$$" for w in t.split()) for t in texts[9:30]]
    docs = _docs(spark, texts + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9, 50)] + [(None, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, text in enumerate(texts + junk):
        r, want = got[i], brute.base_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert not any(got[i].kept for i in range(len(texts), len(texts) + len(junk)))
    assert sum(got[i].kept for i in range(9, 50)) >= 30
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    bare = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in bare)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_dedup(spark, rounds):
    texts = _texts(n=90)
    got = near_dedup.near_dedup(_docs(spark, texts), rounds=rounds).collect()
    want = brute.near(enumerate(texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(texts) - 20


def test_near_dedup_chain_and_ids(spark):
    """A chain of neighbours, none of them near the first; null ids and repeated rows."""
    w = [f"v{i}" for i in range(130)]
    chain = [" ".join(w[i:i + 100]) for i in range(0, 30, 5)]
    ids = [7, 3, 9, 4, 8, 6, None, 3, None]
    texts = [*chain, chain[2], chain[1], "something else that stands alone here"]
    rows = near_dedup.near_dedup(_docs(spark, texts, ids)).collect()
    assert {r.component_id for r in rows} == {3, None}
    assert [r.kept for r in rows if r.doc_id == 3] == [True, True]
    assert sorted(r.kept for r in rows if r.doc_id is None) == [False, True]
    kept = near_dedup.keep_one(_docs(spark, texts, ids), size=4)
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, chain[1]), (True, texts[-1])]
    assert kept.columns == DOCS.replace(",", "").split()[::2]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: up[x] for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot", [0, 4 << 20])
def test_substring_dedup(spark, hot):
    texts = _texts(n=80) + ["x y " * 60, " ".join(f"u{i}" for i in range(36)) * 1]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(_docs(spark, texts), hot_bytes=hot).collect()}
    for i, want in enumerate(brute.substring(enumerate(texts))):
        assert (got[i].n_words, got[i].n_removed, got[i].text) == want
    assert sum(r.n_removed for r in got.values()) > 1000


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"u{i}" for i in range(50))
    rows = substring_dedup.substring_dedup(_docs(spark, [text, text, "z"], [None, None, 1])).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(1, 0), (50, 50), (50, 50)]


def test_line_dedup_heads_carry_no_sketches(spark, monkeypatch):
    """Heads of sketches meet by hash and number; groups are led as by a comparison of all pairs that share a head."""
    rng = random.Random(4)
    base = [sorted(rng.sample(range(10_000), line_dedup.SKETCH)) for _ in range(4)]
    rows = []
    for g in range(40):
        own = list(base[g % 4])
        for _ in range(rng.choice([0, 1, 6, 20, 40])):
            own[rng.randrange(len(own))] = rng.randrange(10_000)
        rows.append((g, sorted(set(own))))
    rows.append((40, [7]))
    wrote, saved = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df: wrote.append(df) or saved(df))
    got = {r.g: r.first for r in line_dedup._led(spark.createDataFrame(rows, "g long, sketch array<long>"), 65).collect()}
    assert wrote and not any("sketch" in json.dumps(kind) or "array" in kind for df in wrote for _, kind in df.dtypes)

    def alike(a, b):
        least = sorted({*a, *b})[:line_dedup.SKETCH]
        return 100 * len({*least} & {*a} & {*b}) >= 65 * len(least)

    heads = {}
    for g, sketch in rows:
        for h in sketch[:line_dedup.HEADS]:
            heads.setdefault(h, []).append(g)
    want = {}
    for g, sketch in rows:
        found = [min(heads[h]) for h in sketch[:line_dedup.HEADS] if min(heads[h]) < g and alike(sketch, rows[min(heads[h])][1])]
        if found:
            want[g] = min(found)
    assert got == want and len(want) > 5


def test_masked_lm(spark):
    rng = random.Random(5)
    heads = [f"h{i}" for i in range(20)]
    phrase = lambda h: f"{h} t{h} end"
    texts = [" ".join(phrase(rng.choice(heads)) for _ in range(150)) for _ in range(60)]
    docs = _docs(spark, texts + [None, "", " \n"])
    weights, top, rank = model = masked_lm.fit(docs, rounds=4, stride=2)
    held = [" ".join(phrase(rng.choice(heads)) for _ in range(100)) for _ in range(5)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    got = {r.doc_id: r for r in masked_lm.score(_docs(spark, [*held, *mixed, None, "end"]), model).collect()}
    unigram = masked_lm.start(masked_lm.vocabulary(docs)[2])
    w = textnp.Words(pa.array(held))
    ids = masked_lm.word_ids(w.hashes(), top, rank)
    around = masked_lm.contexts(ids, w.word_at)
    assert masked_lm.log_probs(masked_lm.unflat(weights), ids, around).mean() > masked_lm.log_probs(unigram, ids, around).mean() + 0.5
    assert min(got[i].mean_log_prob for i in range(5)) > max(got[i].mean_log_prob for i in range(5, 10))
    assert (got[10].n_tokens, got[10].log_prob) == (0, 0.0) and got[11].n_tokens == 1
    # brute force: one word at a time, the two-step softmax written out
    net = masked_lm.unflat(weights)
    own = ids[w.word_at[0]:w.word_at[1]]
    total = 0.0
    for i, y in enumerate(own):
        x = [own[j] if 0 <= j < len(own) else masked_lm._V for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(np.concatenate([net["emb"][k] for k in x]).astype(float) @ net["w"] + net["b"])
        c, m = divmod(int(y), masked_lm.MEMBERS)
        for logits, k in ((h @ net["c"] + net["cb"], c), (h @ net["m"][c] + net["mb"][c], m)):
            total += logits[k] - np.log(np.exp(logits).sum())
    assert abs(total - got[0].log_prob) < 1e-2


def test_masked_lm_classes_meet_once(monkeypatch):
    """Words are scored by class, so that classes take few products; ids and scores are those of each word alone."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, masked_lm._V, 20_000)
    net = masked_lm.start(np.bincount(ids, minlength=masked_lm._V))
    around = masked_lm.contexts(ids, np.array([0, 3, 3, 9_000, 20_000]))
    members, products = masked_lm._members, []
    monkeypatch.setattr(masked_lm, "_members", lambda net, h, spans, room: products.append(len(spans)) or members(net, h, spans, room))
    got = masked_lm.log_probs(net, ids, around)
    assert sum(products) < 2 * masked_lm.CLASSES
    some = [0, 2, 3, 8_999, 9_000, 19_999]
    assert np.allclose(got[some], [masked_lm.log_probs(net, ids[[k]], around[[k]])[0] for k in some], atol=1e-5)
    top = np.sort(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(7, dtype=np.uint64) + np.uint64(5 << 48)]))
    order = rng.permutation(len(top))
    for n in (0, 1, len(top)):
        words = np.concatenate([top, top + np.uint64(1), rng.integers(0, 1 << 63, 99, dtype=np.uint64) * np.uint64(2)])
        place = {h: k for h, k in zip(top[:n].tolist(), order[:n].tolist())}
        cells = masked_lm.TOP + textnp.mix(words ^ np.uint64(99)) % np.uint64(masked_lm._V - masked_lm.TOP)
        assert masked_lm.word_ids(words, top[:n], order[:n]).tolist() == [place.get(h, int(c)) for h, c in zip(words.tolist(), cells)]


def test_masked_lm_rare_words(spark, monkeypatch):
    """A rare word is scored by its own share of its cell, broadcast or joined alike; the
    rounds visit every position once."""
    assert masked_lm.ROUNDS == masked_lm.STRIDE and len({t * 7 % masked_lm.STRIDE for t in range(masked_lm.ROUNDS)}) == masked_lm.STRIDE
    rng = random.Random(8)
    texts = [" ".join(f"r{rng.randrange(9000)}" for _ in range(500)) for _ in range(40)] + [None, "", "r1 r1 once"]
    docs = _docs(spark, [*texts, texts[0]], [*range(len(texts)), 0])
    vocab = masked_lm.vocabulary(docs)
    model = masked_lm.fit(docs, rounds=1, vocab=vocab)
    plain = {r.doc_id: r.log_prob for r in masked_lm.score(docs, model).collect()}
    fresh = _docs(spark, ["r1 neverseen"])
    got, unseen = masked_lm.score(docs, model, vocab).collect(), masked_lm.score(fresh, model, vocab).collect()
    monkeypatch.setattr(masked_lm, "MOST_BROADCAST_WORDS", 0)
    again, unseen_again = masked_lm.score(docs, model, vocab).collect(), masked_lm.score(fresh, model, vocab).collect()
    assert len(got) == len(again) == len(texts) + 1
    n = Counter(w for t in [*texts, texts[0]] for w in (t or "").split())
    names = sorted(n)
    ids = dict(zip(names, masked_lm.word_ids(textnp.Words(pa.array([" ".join(names)])).hashes(), *vocab[:2]).tolist()))
    cell = Counter()
    for w, k in n.items():
        cell[ids[w]] += k
    assert max(cell.values()) > 1 and any(n[w] < cell[ids[w]] for w in names if ids[w] >= masked_lm.TOP)
    for rows in (got, again):
        for r in rows:
            extra = sum(np.log(n[w] / cell[ids[w]]) for w in (texts[r.doc_id] or "").split() if ids[w] >= masked_lm.TOP)
            assert abs(r.log_prob - plain[r.doc_id] - extra) < 1e-6
            assert r.n_tokens == 0 or abs(r.mean_log_prob - r.log_prob / r.n_tokens) < 1e-9
    assert abs(unseen[0].log_prob - unseen_again[0].log_prob) < 1e-9


def test_masked_lm_gradient():
    rng = np.random.default_rng(1)
    net = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in masked_lm._SHAPES.items()}
    y, x = rng.integers(0, 200, 64), rng.integers(0, 200, (64, 4))
    before = masked_lm.log_probs(net, y, x).mean()
    seen = {k: np.full(s, masked_lm.FLOOR, np.float32) for k, s in masked_lm._SHAPES.items()}
    for _ in range(30):
        masked_lm.train_step(net, seen, y, x)
    assert masked_lm.log_probs(net, y, x).mean() > before + 1


def test_masked_lm_steps_share_memory():
    rng = np.random.Generator(np.random.PCG64(8))
    alone, shared = [masked_lm.start(rng.integers(1, 99, masked_lm._V))] * 2
    alone, shared = [{k: v.copy() for k, v in net.items()} for net in (alone, shared)]
    seen = [{k: np.full(s, masked_lm.FLOOR, np.float32) for k, s in masked_lm._SHAPES.items()} for _ in range(2)]
    room, held = {}, None
    for n in (600, 2048, 1, 600, 2048):
        y, x = rng.integers(0, masked_lm._V, n), rng.integers(0, masked_lm._V + 1, (n, 2 * masked_lm.SIDE))
        masked_lm.train_step(alone, seen[0], y, x)
        masked_lm.train_step(shared, seen[1], y, x, room)
        if n == 2048:
            assert held is None or (held.keys() == room.keys() and all(room[k] is v for k, v in held.items()))
            held = dict(room)
    assert all((alone[k] == shared[k]).all() for k in alone)
    got = masked_lm.log_probs(shared, y, x, most=700)
    assert np.allclose(got, np.concatenate([masked_lm.log_probs(shared, y[a:a + 500], x[a:a + 500]) for a in range(0, len(y), 500)]), atol=1e-4)


def test_masked_lm_step_equals_plain():
    """A step on some classes, or on all, is one Adagrad step with the gradient written out; contexts of
    picked words are those of all words."""
    rng = np.random.default_rng(2)
    V, E, M = masked_lm._V, masked_lm.WIDTH, masked_lm.MEMBERS
    for most in (300, V):
        net = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in masked_lm._SHAPES.items()}
        y, x = rng.integers(0, most, 900), rng.integers(0, V + 1, (900, 4))
        want = {k: v.astype(float) for k, v in net.items()}
        grad = {k: np.zeros(s) for k, s in masked_lm._SHAPES.items()}
        for t, around in zip(y, x, strict=True):
            c, m = divmod(int(t), M)
            e = want["emb"][around].ravel()
            h = np.tanh(e @ want["w"] + want["b"])
            dh = 0
            for w, b, at, k in (("c", "cb", ..., c), ("m", "mb", c, m)):
                p = np.exp(h @ want[w][at] + want[b][at])
                p /= p.sum()
                p[k] -= 1
                grad[w][at] += np.outer(h, p)
                grad[b][at] += p
                dh = dh + want[w][at] @ p
            dh = dh * (1 - h * h)
            grad["w"] += np.outer(e, dh)
            grad["b"] += dh
            np.add.at(grad["emb"], around, (want["w"] @ dh).reshape(-1, E))
        seen = {k: np.full(s, masked_lm.FLOOR, np.float32) for k, s in masked_lm._SHAPES.items()}
        masked_lm.train_step(net, seen, y, x)
        for k, g in grad.items():
            g /= len(y)
            step = masked_lm.RATE * g / np.sqrt(masked_lm.FLOOR + g * g)
            assert np.abs(net[k] - (want[k] - step)).max() < 1e-4, k
    w = textnp.Words(pa.array(["a b c d", None, "e", "", "f g"]))
    ids, pick = np.arange(10, 17), np.array([1, 4, 6])
    every = masked_lm.contexts(ids, w.word_at)
    assert every.tolist() == [[V, V, 11, 12], [V, 10, 12, 13], [10, 11, 13, V], [11, 12, V, V], [V] * 4, [V, V, 16, V], [V, 15, V, V]]
    assert (masked_lm.contexts(ids, w.word_at, pick) == every[pick]).all()


def test_token_pieces_in_short_texts(monkeypatch):
    """New pieces go to the library in texts of at most 200, whose ids are split again; ids equal the library's."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    enc, sent = token_file.Encoder(path), []
    plain = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda texts: sent.extend(texts) or plain(texts))
    texts = [" ".join(f"q{i}é{i * i}" for i in range(900)), "", None, "a  b", " x\n y", "z\u00a0 z", "\x1c u v", "end \n", " begin,  ", "日本 日本\nUna"]
    for arr in (pa.array(texts), pa.array(texts[::-1]), pa.array(texts).slice(2, 5)):
        ids, at = enc.encode(arr)
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in arr.to_pylist()], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert max(t.count(" ") for t in sent if "  " not in t) <= 200


def test_sentencepiece_equals_library(spark):
    import hashlib

    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = _texts() + ["  a  b\n c\t ﬁ é ", " ", "   ", "日本語 テキスト", "😀 x 😀", "\x00a", "1234 a1b2", "a" * 40, "</s> <0x0A>", "▁a"]
    rows = {r.doc_id: r for r in sentencepiece_trie.digest(_docs(spark, texts), path).collect()}
    ids = {r.doc_id: r.ids for r in sentencepiece_trie.encode(_docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert ids[i] == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[i].exact == ("▁" not in (t or ""))


@given(st.text("abelostr▁é😀", max_size=25))
@settings(max_examples=200, deadline=None)
def test_trie_walk(text):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sentencepiece_trie.Model.of(path).encode([text])[0].tolist() == sp.encode(text)


def _unigram_model(path, pieces):
    """A unigram model file with these (piece, score) and a piece for every byte, written by hand."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in pieces]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 1) + field(35, 1)
    normal = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path.write_bytes(body + field(2, trainer) + field(3, normal))
    return str(path)


def test_unigram_models_are_walked_by_scores(tmp_path):
    import sentencepiece
    rng = random.Random(7)
    pieces = {"\u2581"} | set("abc\u2581") | {"\u2581" * (rng.random() < 0.3) + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(150)}
    scored = [(p, -rng.randint(1, 4000) / 256) for p in sorted(pieces)]
    path = _unigram_model(tmp_path / "u.model", scored)
    model = sentencepiece_trie.Model(path)
    assert model.kind == sentencepiece_trie.UNIGRAM
    table, least = dict(scored), min(s for _, s in scored)
    texts = ["".join(rng.choice(["a", "b", "c", "é", " ", "ab", "cab", "x", "\n", "日", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        marked = "\u2581" + text.replace(" ", "\u2581") if text else ""
        best = [0.0]
        for i in range(1, len(marked) + 1):     # Viterbi over the whole text, all pieces tried
            best.append(max(best[k] + (table[marked[k:i]] if marked[k:i] in table else least - sentencepiece_trie.UNKNOWN)
                            for k in range(i) if marked[k:i] in table or k == i - 1))
        words = model.segment(sorted({w for w in sentencepiece_trie._WORD.findall(marked)}))
        made = [p for w in sentencepiece_trie._WORD.findall(marked) for p in words[w]]
        assert abs(sum(table.get(p, least - sentencepiece_trie.UNKNOWN) for p in made) - best[-1]) < 1e-9
        assert "".join(made) == marked and model.decode(ids) == text
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [x.tolist() for x in model.encode(texts)] == [sp.encode(t) for t in texts]


def test_other_model_types_are_refused(tmp_path):
    path = tmp_path / "w.model"
    raw = open(_unigram_model(path, [("a", -1.0)]), "rb").read()
    path.write_bytes(raw.replace(b"\x18\x01\x98\x02\x01", b"\x18\x03\x98\x02\x01"))
    assert sentencepiece_trie.model_type(path.read_bytes()) == 3
    with pytest.raises(ValueError):
        sentencepiece_trie.Model(str(path))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, for all the things you know.</p></div>
<div id="wrap">%s</div><!-- <p>hidden, hidden, hidden</p> -->
<aside><p>An aside, with commas, that is long enough to count as a paragraph.</p></aside>
<section id="comments"><article class="comment"><p>First, I say, this is a reader comment, long enough.</p></article></section>
<form><p>Search, here, for whatever you like to search for today.</p></form><footer>&copy; foot</footer>"""
BODY = """<h1>Head &amp; more</h1><p>First  paragraph, with <b>bold</b>,\n and <a href="x">a link</a>, it goes on.<br><p>Second&nbsp;one &lt;is&gt;
shorter, but fine.<ul><li>one<li>two</ul><div class="ad">Buy, buy, buy this thing now, really.</div><p>Ok.</p>"""
WANT = "Head & more\nFirst paragraph, with bold, and a link, it goes on.\nSecond one <is> shorter, but fine.\none\ntwo\nOk."


@pytest.mark.parametrize("tag", ["article", "div", "main", "div class='post-content'", "div class='page has-sidebar'"])
def test_html(tag):
    assert html_text.main_text(PAGE % f"<{tag}>{BODY}</{tag.split()[0]}>") == WANT


LONG = "A long paragraph, with commas, that goes on and on, so that its container scores, and scores well. " * 3


def test_html_siblings_without_article():
    menu = "<ul><li><a href='/a'>One entry of a menu</a><li><a href='/b'>Another entry of a menu</a></ul>"
    page = f"""<body>{menu}<div id=page><h1>Title</h1>By <b>someone</b>, <i>today</i><div class=entry><p>{LONG}<p>{LONG}</div><h2>Note</h2>
<ul><li>a<li>b</ul><pre>x = 1</pre><div class=ad>Buy now</div><table><tr><td>cell</table><p>Short end.</p>{menu}<p>Far away.</p></div>"""
    long = " ".join(LONG.split())
    assert html_text.main_text(page).split("\n") == ["Title", "By someone, today", long, long, "Note", "a", "b", "x = 1", "cell", "Short end."]
    parts = f"<body><div id=c><section><p>{LONG}</section><section><h2>Two</h2><p>Short.</section><section><p>{LONG}</section></div>"
    assert html_text.main_text(parts).split("\n") == [long, "Two", "Short.", long]
    between = f"<body><div id=c><section><p>{LONG}</section><h2><a href='#t'>Two</a></h2>{menu}<section><p>{LONG}</section></div>"
    assert html_text.main_text(between).split("\n") == [long, "Two", long]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_slugs_do_not_cut(tag):
    body = f"""<p>{LONG}</p><section id='related-work'><h2>Related</h2><p>Work of others.</p></section><h2 id='search-algorithms'>
<a href='#search-algorithms'>Search</a></h2><div id='social-history'>History, in <a href=x>a link</a>.</div><p id='reply-to-critics'>Reply.</p>
<div class='notice-of-death'><p>Died in 1900.</p></div><div class='social-share'>Tell all</div><div class='ad'>Buy</div><div role=navigation>Go</div>
<div id='related-links'><a href=1>First link</a> <a href=2>Second link</a></div><p>{LONG}</p>"""
    long = " ".join(LONG.split())
    assert html_text.main_text(f"<body><{tag}>{body}</{tag}><div id=sidebar>Aside.</div>").split("\n") == [
        long, "Related", "Work of others.", "Search", "History, in a link.", "Reply.", "Died in 1900.", long]


@pytest.mark.parametrize("name", ["section id='comments'", "div id='disqus_thread'", "div id='cookie-notice'", "div id=search",
                                  "div class='ad-slot-300x250 lazy'", "section class='wide comments'", "div id='comment-12'"])
def test_html_names_cut_inside_the_article(name):
    page = f"<body><article><p>{LONG}</p><{name}><h2>Comments</h2><p>First, I say, a reader's words.</p></{name.split()[0]}><p>{LONG}</p>"
    assert html_text.main_text(page).split("\n") == [" ".join(LONG.split())] * 2


def test_html_slug_of_a_cut_name_with_its_own_heading():
    page = f"<body><main><p>{LONG}</p><section id='social-media'><h2>Social <i>media</i></h2><p>Their history.</p></section>"
    assert html_text.main_text(page).split("\n") == [" ".join(LONG.split()), "Social media", "Their history."]


def test_html_forms_and_open_heads():
    long = " ".join(LONG.split())
    whole = f"<body><form id=f><ul id=menu><li><a href=1>Home</a></ul><div class=body><h1>T</h1><p>{LONG}</p><p>Short.</p></div><input></form>"
    assert html_text.main_text(whole).split("\n") == ["T", long, "Short."]
    assert html_text.main_text(f"<body><form><article><p>{LONG}</p></article></form>") == long
    beside = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG}</p></form>"
    assert html_text.main_text(beside).split("\n") == [long, long]
    assert html_text.main_text("<body><form><label>Name</label><input><p>Log in here.</p></form>") == ""
    for start in ("<html><head><title>x</title><meta a=b><body>", "<head><link rel=x><script>1</script>", "<head><style>p{}</style>Words. "):
        assert html_text.main_text(f"{start}<div><p>{LONG}</p></div>").endswith(long)


def test_html_points_equal_recursion():
    rng = random.Random(12)

    def made(depth):
        tag = rng.choice(["div", "section", "p", "blockquote", "b", "td", "span"])
        kids = [rng.choice(["", "a, b", "Some words, that are long enough to be a paragraph", "x"]) if not depth or rng.random() < 0.4
                else made(depth - 1) for _ in range(rng.randint(1, 4))]
        return f"<{tag}>{''.join(kids)}</{tag}>"

    for _ in range(200):
        tree = html_text.Tree()
        tree.feed("<body>" + "".join(made(4) for _ in range(3)))
        tree.close()
        html_text.main_nodes(tree.root)
        nodes = html_text._walk(tree.root)

        def text(node):
            return [y for k in node.kids for y in ([k] if isinstance(k, str) else text(k))]

        want = dict.fromkeys(map(id, nodes), 0.0)
        for node in nodes:
            size = sum(len(x.strip()) for x in text(node))
            direct = node.tag == "div" and sum(len(k.strip()) for k in node.kids if isinstance(k, str)) >= html_text.LEAST_CHARS
            if (direct or node.tag in html_text.PARAGRAPH) and size >= html_text.LEAST_CHARS:
                points = 1 + "".join(text(node)).count(",") + min(size / 100, 3)
                up, level = (node if direct else node.parent), 0
                while up is not None and up.parent is not None:
                    want[id(up)] += points * (1 if not level else 1 / 2 if level == 1 else 1 / (3 * level))
                    up, level = up.parent, level + 1
        assert all(abs(n.score - want[id(n)]) < 1e-9 for n in nodes)


@pytest.mark.parametrize("page", ["<ul><li>Some words, in a paragraph, of a deep page." * 20_000,
                                  "<div>" * 3000 + "</p></span></b>" * 60_000 + "<p>text</p>",
                                  "<div><p>Some words, in a paragraph, of a deep page.</p>" * 20_000,
                                  "<span>" * 20_000 + "<div>x</div>" * 60_000,
                                  "<table><tr><td>Some words, in a paragraph, of a deep page." * 15_000])
def test_html_deep_pages_take_linear_time(page):
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 2 * max(1.0, SLOW)


def _slowness():
    begin = time.process_time()
    sum(i * i for i in range(2_000_000))
    return (time.process_time() - begin) / 0.15


SLOW = _slowness()


def test_html_edges(spark):
    deep = "<div>" * 3000 + "<p>Deep text, that still counts as a paragraph.</p>"
    rows = [(1, "u", PAGE % f"<article>{BODY}"), (None, None, None), (3, "", ""), (4, "v", "plain words"), (5, "w", "<p>short"), (5, "w", deep)]
    got = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, WANT), (None, ""), (3, ""), (4, "plain words"), (5, "short"), (5, "Deep text, that still counts as a paragraph.")}
    assert all(r.n_chars == len(r.text) for r in got)


def test_tool_chat(spark):
    calls = [(1, f"c{i}", "note", json.dumps({"turn": i, "text": "é"}), f"c{i - 1}" if i else None) for i in range(20)]
    calls += [(2, "x", "note", '{"b":1,', None), (2, "y", "nope", "{}", "gone"), (2, "z", "note", '{"text":"a","turn":-1}', None),
              (3, "p", "note", '{"turn":1.0,"text":"a"}', "q"), (3, "q", "note", '{"text":"a","turn":2}', "p"), (4, None, "note", "{}", None),
              (5, "c0", "note", "{}", None), (None, "w", None, None, None)]
    results = [(f"c{i}", f"r{i}") for i in range(19)] + [("c3", "again"), ("lost", "l"), (None, "n"), ("x", None)]
    got = tool_chat.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string"),
                               spark.createDataFrame(results, "call_id string, content string"), tool_chat.SCHEMAS).collect()
    by = {r.call_id: r for r in got if r.call_id}
    assert [by[f"c{i}"].step for i in range(20)] == list(range(20))
    assert {k: by[k].status for k in ("c1", "c19", "x", "y", "z", "p", "q", "lost", "w")} == {
        "c1": "ok", "c19": "no_result", "x": "bad_json", "y": "no_schema", "z": "bad_arguments", "p": "cycle", "q": "cycle",
        "lost": "orphan", "w": "bad_json"}
    assert by["z"].error == "$.turn: range" and by["c3"].n_results == 2 and by["c0"].n_calls == 2 and by["p"].step is None
    assert by["c1"].message == ('[{"role":"assistant","tool_calls":[{"arguments":{"text":"é","turn":1},"id":"c1","name":"note"}]},'
                                '{"content":"r1","role":"tool","tool_call_id":"c1"}]')
    assert sorted(r.status for r in got if r.call_id is None) == ["bad_arguments", "orphan"]
    assert len(got) == 20 + 5 + 1 + 1 + 2


def test_tool_chat_of_turns(spark):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}" * (1 + 40 * (t == 3))) for c in (1, 2) for t in range(0, 8)]
                                  + [(None, 1, "assistant", None), (3, None, "user", "u")], "conv_id long, turn long, role string, text string")
    got = tool_chat.link_calls(*tool_chat.calls_of(turns), tool_chat.SCHEMAS).collect()
    assert [(r.call_id, r.step, r.status) for r in sorted((x for x in got if x.conv_id == 1), key=lambda r: r.step)] == [
        ("1:1", 0, "ok"), ("1:3", 1, "ok"), ("1:5", 2, "ok"), ("1:7", 3, "no_result")]
    assert sorted(r.status for r in got if r.call_id is None) == ["bad_arguments", "orphan"]


def test_tool_chat_of_text_ids_and_empty_tables(spark):
    """Conversations go by ids of any type; every turn of a table is in some row's message."""
    kind = "conv_id string, turn string, role string, text string"
    rows = [(f"c-{c}", str(t) if t != 5 else "five", "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in (1, 2) for t in range(8)]
    rows += [(None, None, "user", "lost"), ("c-1", "1", "assistant", "text 1 1 again"), ("c-9", None, None, None)]
    got = tool_chat.chat(spark.createDataFrame(rows, kind)).collect()
    assert dict(tool_chat.chat(spark.createDataFrame([], kind)).dtypes)["conv_id"] == "string"
    for _, _, _, text in rows:
        assert text is None or sum(f'"{text}"' in r.message for r in got) == 1
    assert {(r.conv_id, r.call_id) for r in got if r.status == "ok"} >= {("c-1", "c-1:3"), ("c-2", "c-2:1"), ("c-2", "c-2:3")}
    for empty in (kind, "conv_id long, turn long, role string, text string"):
        assert tool_chat.chat(spark.createDataFrame([], empty)).count() == 0


def test_tool_chat_carries_every_turn(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "after the system turn"), (1, 2, "assistant", "a"), (1, 3, "user", "b"),
            (2, 0, "user", "opening"), (2, 1, "assistant", "c"), (3, 0, None, "no role"), (3, 1, "narrator", "é"), (None, 0, "system", None)]
    got = tool_chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.status, r.message) for r in got if r.status in ("message", "orphan")) == [
        (0, "message", '[{"content":null,"role":"system","turn":0}]'),
        (1, "message", '[{"content":"be brief","role":"system","turn":0}]'),
        (1, "orphan", '[{"content":"after the system turn","role":"tool","tool_call_id":"1:0","turn":1}]'),
        (2, "message", '[{"content":"opening","role":"user","turn":0}]'),
        (3, "message", '[{"content":"no role","role":null,"turn":0}]'), (3, "message", '[{"content":"é","role":"narrator","turn":1}]')]
    assert sorted((r.conv_id, r.status) for r in got if r.status not in ("message", "orphan")) == [(1, "ok"), (2, "no_result")]


def test_tool_chat_keeps_long_and_failed_calls(spark):
    text = "long " * 1000
    rows = [(1, 1, "assistant", text), (1, 2, "user", "reply"), (2, 1, "assistant", ""), (2, 2, "user", "to nothing")]
    by = {r.conv_id: r for r in tool_chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[1].status == "ok" and text in by[1].message and '"reply"' in by[1].message
    assert (by[2].status, by[2].error) == ("bad_arguments", "$.text: length") and '"to nothing"' in by[2].message
    assert tool_chat.render("a", "note", '{"b":1,', "r", tool_chat.SCHEMAS) == ("bad_json", None, (
        '[{"role":"assistant","tool_calls":[{"arguments":"{\\"b\\":1,","id":"a","name":"note"}]},'
        '{"content":"r","role":"tool","tool_call_id":"a"}]'))
    assert tool_chat.render("a", "nope", "{}", None, tool_chat.SCHEMAS)[:2] == ("no_schema", "nope")


def test_tool_chat_reused_ids(spark):
    """One id in several conversations, and repeated rows with different texts."""
    calls = [(c, i, "note", json.dumps({"text": f"{c}{i}", "turn": 1}), "call_1" if i == "call_2" else None)
             for c in (1, 2, 3) for i in ("call_1", "call_2")]
    results = [(1, "call_1", "one"), (2, "call_1", "two"), (2, "call_2", "end"), (4, "call_1", "lost")]
    got = tool_chat.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string"),
                               spark.createDataFrame(results, "conv_id long, call_id string, content string"), tool_chat.SCHEMAS).collect()
    assert sorted((r.conv_id, r.call_id, r.step, r.status, r.n_calls) for r in got) == [
        (1, "call_1", 0, "ok", 1), (1, "call_2", 1, "no_result", 1), (2, "call_1", 0, "ok", 1), (2, "call_2", 1, "ok", 1),
        (3, "call_1", 0, "no_result", 1), (3, "call_2", 1, "no_result", 1), (4, "call_1", None, "orphan", 0)]
    assert all(('"one"' in r.message) == ((r.conv_id, r.call_id) == (1, "call_1")) for r in got)
    turns = [(1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", "x"), (1, 2, "user", "y"), (1, 3, "assistant", "")]
    turns += [(1, 3, "assistant", "z")]
    rows = tool_chat.chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.call_id, r.step, r.status, r.error or "", r.n_calls, r.n_results) for r in rows) == [
        ("1:1", 0, "duplicate", "", 0, 1), ("1:1", 0, "duplicate", "", 2, 0), ("1:1", 0, "ok", "", 3, 2),
        ("1:3", 1, "bad_arguments", "$.text: length", 2, 0), ("1:3", 1, "duplicate", "", 1, 0)]
    assert {t for t in "abxyz" if any(f'"{t}"' in r.message for r in rows)} == set("abxyz")


def test_decontaminate(spark):
    rng = random.Random(9)
    vocab = ["The", "of", "é", "x1", "Zeta"] + [f"q{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 25, 30])]
    items += [(100, None), (101, "!!"), (None, "lonely item words here"), (2, items[5][1]), (7, items[7][1])]
    texts = [None, "", "--"] + [" ".join(rng.choice(vocab[3:]) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    for _, t in items:
        if t:
            texts += [f"pre, {t.upper()}! post", t[:len(t) // 2], f"{t} and {t}", t.replace(" ", "--")]
    texts.append("a lonely  ITEM, words-here")
    got = decontaminate.decontaminate(_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    want = brute.contamination(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == dict(enumerate(want))
    clean = decontaminate.drop_contaminated(_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, x in enumerate(want) if not x[1]}


def test_empty_tables(spark):
    docs = _docs(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = P.path("piece_bpe_32k.model")
    for df in (quality_rules.quality_rules(docs, labels), line_dedup.line_dedup(docs), near_dedup.near_dedup(docs),
               substring_dedup.substring_dedup(docs), masked_lm.masked_lm(docs), sentencepiece_trie.digest(docs, path),
               decontaminate.decontaminate(docs, items), token_file.token_digest(docs, P.path("byte_bpe_50k.json"))):
        assert df.count() == 0
    one = _docs(spark, ["a b c"])
    assert decontaminate.decontaminate(one, items).select("n_hit").first()[0] == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_chat.link_calls(*tool_chat.calls_of(turns), tool_chat.SCHEMAS).count() == 0


def test_native_plans(spark):
    """Line dedup and decontamination run no Python and no join without keys."""
    docs, items = _docs(spark, _texts()), spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for df in (line_dedup.line_dedup(docs), decontaminate.decontaminate(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
