"""Operator 11, periodic runs of words, found over an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
that no neighbouring word extends.  The words of a slice of texts become ids that differ
between texts, so no suffix of one text equals a part of another.

Method (the branching-tandem test on an enhanced suffix array; intervals are held as
arrays, no tree is built): (1) prefix doubling ranks all suffixes, and the ranks of each
round, ids of the stretches of 2^k words, are kept; (2) they give the LCP values; minima over
2^k of those give the LCP interval of every split between two neighbours; (3) for each
interval of depth q, suffixes i of all but its largest child are tested: if suffix i + q
lies in the interval but not in i's child, words i .. i + 2q are a square whose next word
ends the repetition, and so they are if suffix i - q does; (4) each such square is
rotated to the left as far as words agree, 2^k words at a time, and squares of one
stretch merge into its run, the least period winning.

Plan: one map over slices of ``CHUNK_BYTES`` of text, a longer text alone; no shuffle.  A slice
of n words needs O(n log n) time and 4 n bytes a round, of which there are log2 of its
longest repeat inside a text.

Edge cases: null and empty texts have no words and no run; equal rows give equal rows; a
null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import map_text
from caliper.llm.textnp import Words

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Suffixes tested at once.
TESTED = 1 << 20
_I = np.int64


def word_ids(w: Words) -> np.ndarray:
    """An id for every word; equal words of one text have one id, others differ."""
    coded = w.strings().dictionary_encode()
    local = coded.indices.to_numpy(zero_copy_only=False).astype(_I)
    return w.doc_of_word() * (len(coded.dictionary) + 1) + local


def _dense(key: np.ndarray) -> np.ndarray:
    """The place at which each key's group starts in sorted order."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    rank = np.empty(len(key), _I)
    rank[order] = start
    return rank


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4 .. words at each place; those of the last round differ."""
    n = len(ids)
    rank = _dense(ids)
    out = [rank.astype(np.int32)]
    width = 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)      # places that still share their rank
        if not len(open_):
            return out
        after = open_ + width
        own, nxt = rank[open_], np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = own * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(key), bool)
        group[1:] = own[1:] != own[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))
        base = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[open_[order]] = own + start - base
        out.append(rank.astype(np.int32))
        width *= 2


def common_prefixes(ranks: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """``lcp[r]``: words that the suffixes of places r - 1 and r in sorted order share (n + 1 of them)."""
    n = len(sa)
    lcp = np.zeros(n + 1, np.int32)
    first = ranks[0]
    pick = np.flatnonzero(first[sa[1:]] == first[sa[:-1]]) + 1
    a, b = sa[pick - 1].copy(), sa[pick].copy()
    got = np.zeros(len(pick), np.int32)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = same.astype(_I) << k
        a += step
        b += step
        got += step.astype(np.int32)
    lcp[pick] = got
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each split r with lcp[r] > 0: r and its LCP interval [lo, hi) of sorted places."""
    split = np.flatnonzero(lcp > 0)
    least = [lcp]                                   # minima over 2^k neighbours
    while (least[-1] > 0).any() and len(least[-1]) > 1 << (len(least) - 1):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    depth = lcp[split]
    lo, hi = split.copy(), split.copy()
    for k in range(len(least) - 1, -1, -1):
        low = least[k]
        if not len(low):
            continue
        ok = (hi < len(low)) & (low[np.minimum(hi, len(low) - 1)] >= depth)
        hi += ok.astype(_I) << k
        at = lo - (1 << k)
        ok = (at >= 0) & (at < len(low)) & (low[np.clip(at, 0, len(low) - 1)] >= depth)
        lo -= ok.astype(_I) << k
    return split, lo - 1, hi


def branching_squares(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the squares that the word after them does not rotate further."""
    isa = ranks[-1].astype(_I)
    n = len(isa)
    sa = np.empty(n, _I)
    sa[isa] = np.arange(n)
    lcp = common_prefixes(ranks, sa)
    split, lo, hi = intervals(lcp)
    none = np.zeros(0, _I)
    if not len(split):
        return none, none
    # Children of an interval lie between its splits: one from lo, and one from each split.
    depth = lcp[split].astype(_I)
    order = np.lexsort((split, depth, lo))
    split, lo, hi, depth = split[order], lo[order], hi[order], depth[order]
    new = np.ones(len(split), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    node = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    n_node = len(head)
    begin = np.concatenate((lo[head], split))
    owner = np.concatenate((np.arange(n_node), node))
    back = np.argsort(owner * (n + 1) + begin, kind="stable")
    begin, owner = begin[back], owner[back]
    end = np.append(begin[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = hi[head][owner[last]]
    size = end - begin
    by_size = np.lexsort((size, owner))
    largest = by_size[np.append(owner[by_size][1:] != owner[by_size][:-1], True)]
    small = np.ones(len(begin), bool)
    small[largest] = False
    begin, end, owner, size = begin[small], end[small], owner[small], size[small]
    n_lo, n_hi, n_depth = lo[head], hi[head], depth[head]
    starts, periods = [none], [none]
    total = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(total, total[at] + TESTED, "right")) - 1)
        child = np.repeat(np.arange(at, to), size[at:to])
        place = np.arange(total[at], total[to]) - total[child] + begin[child]
        i, q = sa[place], n_depth[owner[child]]
        for side in (1, -1):
            other = i + side * q
            ok = (other >= 0) & (other < n)
            rank = isa[np.where(ok, other, 0)]
            ok &= (rank >= n_lo[owner[child]]) & (rank < n_hi[owner[child]])
            ok &= (rank < begin[child]) | (rank >= end[child])
            starts.append(np.minimum(i, other)[ok])
            periods.append(q[ok])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


@dataclass
class Runs:
    """Runs in the order of their start, then their period: places in the slice's words."""
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Runs:
    """All runs of at least ``min_length`` words and ``min_exponent`` (2 or more) periods."""
    if not len(ids):
        none = np.zeros(0, _I)
        return Runs(none, none, none)
    ranks = suffix_ranks(ids)
    start, period = branching_squares(ranks)
    end = start + 2 * period
    for k in range(len(ranks) - 1, -1, -1):          # rotate to the left, 2^k words at a time
        to = start - (1 << k)
        ok = to >= 0
        to = np.where(ok, to, 0)
        ok &= ranks[k][to] == ranks[k][np.minimum(to + period, len(ids) - 1)]
        start = np.where(ok, to, start)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)                  # of one stretch the least period
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return Runs(start[order], end[order], period[order])


def collapsed_words(n: int, runs: Runs) -> np.ndarray:
    """Which of ``n`` words stay: all but those after the first period of a run."""
    edge = np.zeros(n + 1, _I)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.end, -1)
    return np.cumsum(edge[:-1]) == 0


SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period), text (the words
    that stay when every run is cut to its first period, joined by one space)."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(part):
        w = Words(part.column("text"))
        runs = find_runs(word_ids(w), min_length, min_exponent)
        doc = np.searchsorted(w.word_at, runs.start, "right") - 1
        stays = collapsed_words(len(w.starts), runs)
        flat = pa.StructArray.from_arrays(
            [pa.array(runs.start - w.word_at[doc]), pa.array(runs.end - runs.start), pa.array(runs.period)],
            ["start", "length", "period"])
        offsets = pa.array(np.searchsorted(doc, np.arange(w.n + 1)).astype(np.int32))
        out = []
        for d in range(w.n):
            found = w.text(d).split()
            own = stays[w.word_at[d]:w.word_at[d + 1]]
            if not own.all():
                found = [x for x, k in zip(found, own.tolist(), strict=True) if k]
            out.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.n_words.astype(_I)),
             pa.ListArray.from_arrays(offsets, flat).cast(run_type), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "text"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def best_run(runs: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; ties: least start, then period."""
    def better(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (left > right) | ((left == right) & ((a["start"] < b["start"]) |
                                                    ((a["start"] == b["start"]) & (a["period"] <= b["period"]))))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(best, x), best).otherwise(x))


def runs_listing(runs: str = "runs") -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(
        "", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten (h = crc32 of its id, h % 10 = 0) repeats a stretch of
    its own: from word a = g % n on, word i is word a + (i - a) % p of the text, where
    g = h div 10 and p = 1 + (n - a) div (3 + g % 8).  Others, and null ids, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)) \
        .withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    on = F.col("n") > 0
    rows = rows.withColumn("a", F.when(on, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.when(on, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    stretch = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    made = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(stretch, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(on, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts, best run and digests of ``periodic_runs``, one row per document."""
    rows = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best_run().alias("b"),
                                      F.sha2(runs_listing(), 256).alias("runs_sha256"),
                                      F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                       F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
