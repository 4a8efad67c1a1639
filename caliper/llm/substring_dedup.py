"""Operator 5, substring dedup by super-k-mers.

A window is ``size`` consecutive words.  Its minimiser is the least hash among its runs
of ``M`` words, so equal windows have equal minimisers.  Consecutive windows with one
minimiser form a super-k-mer: they travel as one packed string of words to the bucket
of the minimiser, where all windows of the bucket are sorted and counted.

Plan: (1) minimisers that occur once can have no repeated window: they are counted
first, as bare hashes; (2) only super-k-mers of repeated minimisers are packed; equal
strings are added up on the map side before their bucket sees them; (3) buckets count
windows by sorting; a bucket above ``HOT_BYTES`` of distinct strings (a passage in
thousands of contexts) is instead split by window, each an aggregated 128-bit hash;
(4) covered word ranges go back to their documents, which drop those words.

Edge cases: null and empty texts have no words; white space other than between kept
words is lost, as kept words are joined by one space; repeated rows count as documents
of their own, so all their windows repeat; a null doc_id is kept; texts shorter than a
window lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import CHUNK_BYTES, map_text, row_key, saved
from caliper.llm.textnp import Words, mix

SIZE = 35
M = 6
HOT_BYTES = 4 << 20
_U = np.uint64
_RANGES = pa.list_(pa.int32())


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def super_kmers(w: Words, size: int = SIZE, m: int = M):
    """doc, start word, number of windows, minimiser and weight of each super-k-mer.

    The weight is 2 where the text holds the minimiser's words more than once, as then
    windows may repeat within one text."""
    grams, at = w.grams(w.hashes(), m)
    windows = np.maximum(w.n_words - size + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    doc = np.repeat(np.arange(w.n), windows)
    first = np.cumsum(windows) - windows
    place = np.arange(len(doc)) - first[doc]                       # a window's first word in its text
    low = _sliding_min(grams, size - m + 1)[at[doc] + place]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(low)))
    salt = mix(np.arange(w.n, dtype=np.uint64) + _U(1))
    own = np.sort(mix(grams + salt[np.repeat(np.arange(w.n), np.diff(at))]))
    twice = np.unique(own[1:][own[1:] == own[:-1]])
    weight = 1 + np.isin(mix(low[begin] + salt[doc[begin]]), twice).astype(np.int64)
    return doc[begin], place[begin], n, low[begin], weight


def _keys(part: pa.RecordBatch, doc: np.ndarray) -> list[pa.Array]:
    pick = pa.array(doc)
    return [part.column(c).take(pick) for c in ("k1", "k2")]


def repeated_minimisers(keyed: DataFrame, size: int, m: int) -> DataFrame:
    def run(part):
        _, _, _, low, weight = super_kmers(Words(part.column("text")), size, m)
        yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(weight)], ["minimiser", "n"])

    return (map_text(keyed.select("text"), run, "minimiser long, n long").groupBy("minimiser")
            .agg(F.sum("n").alias("n")).where("n > 1").select("minimiser"))


def packed(keyed: DataFrame, size: int, m: int) -> DataFrame:
    """k1, k2, start, minimiser, words (packed string) of super-k-mers that may repeat."""
    def run(part):
        doc, start, n, low, _ = super_kmers(Words(part.column("text")), size, m)
        yield pa.RecordBatch.from_arrays(
            [*_keys(part, doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(low.view(np.int64))],
            ["k1", "k2", "start", "n", "minimiser"])

    def pack(part):
        w = Words(part.column("text"))
        data, out, doc, starts, lows = w.data.tobytes(), [], [], [], []
        for d, runs in enumerate(part.column("runs").to_pylist()):
            base = w.word_at[d]
            for r in runs:
                a = base + r["start"]
                b = a + r["n"] + size - 1
                text = data[w.starts[a]:w.ends[b - 1]]
                if b - a != len(text.split(b" ")) or text.split(b" ") != text.split():
                    text = b" ".join(text.split())
                out.append(text)
                doc.append(d)
                starts.append(r["start"])
                lows.append(r["minimiser"])
        yield pa.RecordBatch.from_arrays(
            [*_keys(part, np.array(doc, np.int64)), pa.array(starts, pa.int32()), pa.array(lows, pa.int64()),
             pa.array(out, pa.binary()).cast(pa.string())], ["k1", "k2", "start", "minimiser", "words"])

    often = saved(repeated_minimisers(keyed, size, m))
    runs = (map_text(keyed, run, "k1 long, k2 long, start int, n int, minimiser long")
            .join(often, "minimiser", "leftsemi").groupBy("k1", "k2")
            .agg(F.collect_set(F.struct("start", "n", "minimiser")).alias("runs")))
    return map_text(keyed.join(runs, ["k1", "k2"]), pack, "k1 long, k2 long, start int, minimiser long, words string")


def _ranges(first: np.ndarray, size: int) -> list[int]:
    """Flat list from, to, from, to ... of the words that windows at ``first`` cover."""
    gap = np.flatnonzero(np.diff(first) > size)
    return np.stack([first[np.append(0, gap + 1)], first[np.append(gap, len(first) - 1)] + size], axis=1).ravel().tolist()


def _count_windows(part: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Ranges of repeated words in each string; all strings of a minimiser are in ``part``."""
    w = Words(part.column("words"))
    own, at = w.grams(w.hashes(), size)
    often = np.asarray(part.column("n")) > 1
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.repeat(often, np.diff(at))
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = [_ranges(j, size) if len(j := np.flatnonzero(twice[at[d]:at[d + 1]])) else None for d in range(w.n)]
    ok = pa.array([x is not None for x in found], pa.bool_())
    out = pa.RecordBatch.from_arrays([part.column("p1"), part.column("p2"), pa.array(found, _RANGES)], ["p1", "p2", "ranges"])
    return out.filter(ok)


def repeated_ranges(strings: DataFrame, size: int, hot_bytes: int) -> DataFrame:
    """p1, p2 (hash of a packed string) and the word ranges that repeated windows cover."""
    per = strings.groupBy("minimiser").agg(F.sum(F.octet_length("words")).alias("bytes"))
    hot = saved(per.where(F.col("bytes") > hot_bytes).select("minimiser"))
    cool = strings.join(hot, "minimiser", "leftanti")

    def count(batches):
        held, size_held, last = [], 0, None

        def flush(tables):
            one = pa.Table.from_batches(tables).combine_chunks()
            return [_count_windows(b, size) for b in one.to_batches()] if one.num_rows else []

        for batch in batches:
            low = np.asarray(batch.column("minimiser"))
            ends = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, len(low)) if len(low) else []
            lengths = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("words")).to_numpy())))
            begin = 0
            for a, e in zip(np.append(0, ends[:-1]).astype(int) if len(low) else [], ends, strict=True):
                if size_held + lengths[a] - lengths[begin] > CHUNK_BYTES and low[a] != last:
                    held.append(batch.slice(begin, a - begin))
                    yield from flush(held)
                    held, size_held, begin = [], 0, a
                last = low[a]
            held.append(batch.slice(begin))
            size_held += int(lengths[-1] - lengths[begin]) if len(low) else 0
        if held:
            yield from flush(held)

    counted = (cool.repartition("minimiser").sortWithinPartitions("minimiser")
               .mapInArrow(count, "p1 long, p2 long, ranges array<int>"))

    def cut(part):
        w = Words(part.column("words"))
        h = w.hashes()
        one, at = w.grams(h, size)
        two, _ = w.grams(mix(h + _U(77)), size)
        string = np.repeat(np.arange(w.n), np.diff(at))
        pick = pa.array(string)
        yield pa.RecordBatch.from_arrays(
            [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(part.column(c).take(pick) for c in ("p1", "p2", "n")),
             pa.array((np.arange(len(one)) - at[string]).astype(np.int32))], ["w1", "w2", "p1", "p2", "n", "j"])

    single = saved(map_text(strings.join(hot, "minimiser", "leftsemi"), cut,
                            "w1 long, w2 long, p1 long, p2 long, n long, j int", "words"))
    often = single.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    places = single.join(often, ["w1", "w2"], "leftsemi").groupBy("p1", "p2").agg(F.collect_list("j").alias("j"))
    spans = places.select("p1", "p2", F.flatten(F.transform("j", lambda j: F.array(j, j + size))).alias("ranges"))
    return counted.unionByName(spans)


def substring_dedup(docs: DataFrame, size: int = SIZE, m: int = M, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the kept words)."""
    keyed = docs.select(*row_key(), "text")
    rows = saved(packed(keyed, size, m).withColumn("p1", F.xxhash64("words")).withColumn("p2", F.xxhash64(F.lit(7), "words")))
    strings = rows.groupBy("minimiser", "words", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    spans = saved(repeated_ranges(strings, size, hot_bytes))
    cover = (rows.select("k1", "k2", "start", "p1", "p2").join(spans, ["p1", "p2"])
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "ranges")).alias("cover")))
    todo = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).join(cover, ["k1", "k2"], "left")

    def drop(part):
        w = Words(part.column("text"))
        gone, out = [], []
        for d, cover in enumerate(part.column("cover").to_pylist()):
            found = w.text(d).split()
            if cover:
                edge = np.zeros(len(found) + 1, np.int64)
                for c in cover:
                    span = np.array(c["ranges"], np.int64) + c["start"]
                    np.add.at(edge, span[::2], 1)
                    np.add.at(edge, span[1::2], -1)
                keep = np.cumsum(edge)[:-1] == 0
                gone.append(int((~keep).sum()))
                found = [x for x, k in zip(found, keep.tolist(), strict=True) if k]
            else:
                gone.append(0)
            out.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.n_words.astype(np.int64)), pa.array(gone, pa.int64()),
             pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return map_text(todo.select("doc_id", "text", "cover"), drop, "doc_id long, n_words long, n_removed long, text string")


def sha256_of(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
