"""Operator 3, quality rules: hashed n-gram log-likelihood ratio plus base rules.

Words and word pairs of a text are hashed into ``buckets`` cells.  Two multinomials
over the cells are estimated with add-one smoothing: the *target*, from documents
that labels call good, and the *raw* corpus, from all documents.  A document's score
is the mean over its words and pairs of ``log p_target - log p_raw``; it is kept if
the score reaches ``threshold`` (a fixed number, so one document's verdict never
depends on a random draw).  Base rules on length and repetition come first.

Plan: one map-side count pass (each task sends ``buckets`` sums per slice of tasks,
added up by an aggregate), then one map-only scoring pass.  No text is shuffled.  The
target is a classifier's fit on labelled rows: of those at most ``max_target`` are
taken, the smallest hashes of doc_id first, so that their ids may be broadcast.  The
raw counts cover every document.

Edge cases: null or empty text has no words and fails the base rules; a null doc_id is
kept in the output and never in the target; repeated rows are scored one by one; an
empty table gives an empty result; without good labels the ratio is 0 for every text
and only the base rules decide; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import bounded_batches, map_text, slices
from caliper.llm.textnp import Words, mix, per_doc_sum

BUCKETS = 1 << 14
MAX_TARGET = 20_000
THRESHOLD = -0.12
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _cells(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every word, then of every pair, and the offsets of each text's pairs."""
    h = words.hashes()
    pairs, at = words.grams(h, 2)
    cell = (np.concatenate((mix(h), pairs)) % np.uint64(buckets)).astype(np.int64)
    return cell, at


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all documents' words and pairs by cell: ``buckets`` numbers.

    Each task adds up its own texts; what reaches the driver is one row per cell."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_cells(Words(part.column("text")), buckets)[0], minlength=buckets)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    bounded_batches(docs.sparkSession)
    rows = (docs.select("text").mapInArrow(count, "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """At most ``max_target`` ids that labels call good, smallest hashes first."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
               max_target: int = MAX_TARGET) -> np.ndarray:
    """``log p_target - log p_raw`` of every cell (zeros without a target)."""
    raw = ngram_counts(docs, buckets)
    target = ngram_counts(docs.join(F.broadcast(target_ids(labels, max_target)), "doc_id", "leftsemi"), buckets)
    if not target.sum():
        return np.zeros(buckets)
    def smooth(c):
        return np.log((c + 1.0) / (c.sum() + buckets))
    return smooth(target) - smooth(raw)


def _repeat_words(words: Words) -> np.ndarray:
    """Words inside runs of WINDOW words that stand twice or more in their text."""
    runs, at = words.grams(words.hashes(), WINDOW)
    out = np.zeros(words.n, np.int64)
    if not len(runs):
        return out
    doc = np.repeat(np.arange(words.n), np.diff(at))
    own = mix(runs + mix(doc.astype(np.uint64) + np.uint64(1)))     # runs of one text only
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if twice.any():
        first = (words.word_at[doc] + np.arange(len(own)) - at[doc])[twice]
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + WINDOW, -1)
        out = per_doc_sum((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.word_at)
    return out


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def measures(arr: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of every text of ``arr``."""
    w = Words(arr)
    points = ((w.data & 0xC0) != 0x80).astype(np.int64)             # first bytes of code points
    inside = np.concatenate(([0], np.cumsum(points)))
    chars = inside[w.ends] - inside[w.starts]
    return {"n_words": w.n_words.astype(np.int64),
            "word_chars": per_doc_sum(chars, w.word_at),
            "n_symbols": per_doc_sum(_SYMBOL[w.data], w.doc_at),
            "n_dup_lines": np.array([_dup_lines(w.text(d)) for d in range(w.n)], np.int64),
            "n_repeat_words": _repeat_words(w)}


def scores(arr: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio over each text's words and pairs (0.0 without words)."""
    w = Words(arr)
    cell, pair_at = _cells(w, len(ratios))
    value, k = ratios[cell], len(w.starts)
    n = w.n_words + np.diff(pair_at)
    out = np.zeros(w.n)
    for d in np.flatnonzero(n):     # one sum per text, so it does not depend on its neighbours
        a, b, c, e = w.word_at[d], w.word_at[d + 1], k + pair_at[d], k + pair_at[d + 1]
        out[d] = (value[a:b].sum() + value[c:e].sum()) / n[d]
    return out


def _judge(arr: pa.Array, ratios: np.ndarray, threshold: float):
    m, s = measures(arr), scores(arr, ratios)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return m, failed, s, ~failed & (s >= threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, score, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = log_ratios(docs, labels, buckets, max_target)

    def run(part):
        m, failed, s, kept = _judge(part.column("text"), ratios, threshold)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *map(pa.array, m.values()), pa.array(failed), pa.array(s), pa.array(kept)],
            ["doc_id", *m, "base_failed", "score", "kept"])

    return map_text(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                               "n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
              buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps."""
    ratios = log_ratios(docs.select("doc_id", "text"), labels, buckets, max_target)
    return map_text(docs, lambda part: [part.filter(pa.array(_judge(part.column("text"), ratios, threshold)[3]))], docs.schema)
