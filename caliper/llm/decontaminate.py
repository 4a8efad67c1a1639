"""Operator 10, benchmark decontamination: a prefix-filtered set join.

An item's windows (``size`` consecutive words, or the whole item if it has fewer) are
sets of word shingles.  Shingles are ordered by how rare they are in the documents; a
document that holds a window holds all its shingles, so the rarest one is the prefix
that the join needs.  A match fixes where the window would start, which must fit into
the document (positional and length bounds); the words there are then compared in full.

DataFrame functions only.  Documents are cut into shingles of all needed lengths in one
scan; only those that some benchmark window holds are kept, and one row for each document
with its number of words.  The benchmark's shingles are broadcast up to a checked number of
rows and joined by shuffle above.  Only the texts of documents with candidates are shuffled,
and cut into words again after they met their candidates; all others are judged by the
first scan.

Edge cases: null or empty texts have no words; items without words have no window; a
null item_id goes by the empty string, repeated item_ids count once; null and repeated
doc_ids are judged row by row; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import row_key, saved, without

SIZE = 10
SHINGLE = 3
MOST_BROADCAST_SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All of ASCII but letters and digits parts words.
PARTS = "".join(chr(c) for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))


def words(text: str) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased (null: none)."""
    plain = F.translate(text, UPPER + PARTS, LOWER + " " * len(PARTS))
    return F.coalesce(F.filter(F.split(plain, " "), lambda x: x != ""), F.array().cast("array<string>"))


def _shingle(w: Column, x: Column, i: Column, size: int) -> Column:
    """The hash of the shingle at place i; the last places, short of words, hash what there is."""
    return F.xxhash64(F.lit(size), x, *[F.get(w, i + j) for j in range(1, size)])


def _shingles(w: Column, size: int) -> Column:
    return F.transform(w, lambda x, i: _shingle(w, x, i, size))


def benchmark_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, win, len): the windows of every item; ``win`` joins its words by a space."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(size)))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
    return rows.select("item", "len", F.explode(cut).alias("x")) \
        .select("item", F.array_join("x", " ").alias("win"), "len").distinct()


def _small(df: DataFrame) -> DataFrame:
    few = df.limit(MOST_BROADCAST_SHINGLES + 1).count() <= MOST_BROADCAST_SHINGLES
    return F.broadcast(df) if few else df


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(g, win, len, off, sh): the shingles of every window, of g words (fewer if the window has)."""
    cut = windows.select("win", "len").distinct().select("win", "len", F.split("win", " ").alias("w"))
    own = None
    for g in range(1, shingle + 1):
        part = cut.where(F.col("len") >= g) if g == shingle else cut.where(F.col("len") == g)
        part = part.select("win", "len", F.posexplode(_shingles(F.col("w"), g)).alias("off", "sh")) \
            .where(F.col("off") <= F.col("len") - g).withColumn("g", F.lit(g))
        own = part if own is None else own.unionByName(part)
    return own


def places(docs: DataFrame, own: DataFrame) -> DataFrame:
    """k1, k2, doc_id, g, pos, sh: where documents hold a window's shingle, and for every document
    a row with g = 0 whose pos is its number of words."""
    sizes = [r[0] for r in own.select("g").distinct().orderBy("g").collect()]       # at most the shingle's length
    w = F.col("w")

    def at(g):
        return F.transform(w, lambda x, i: F.struct(F.lit(g).alias("g"), i.alias("pos"), _shingle(w, x, i, g).alias("sh")))

    whole = F.array(F.struct(F.lit(0).alias("g"), F.size(w).alias("pos"), F.lit(0).cast("long").alias("sh")))
    cut = docs.select(*row_key(), "doc_id", words("text").alias("w")) \
        .select("k1", "k2", "doc_id", F.inline(F.concat(whole, *[at(g) for g in sizes])))
    keep = own.select("sh").distinct().unionByName(own.sparkSession.range(1).select(F.lit(0).cast("long").alias("sh")))
    return cut.join(_small(saved(keep)), "sh", "left_semi")


def candidates(found: DataFrame, own: DataFrame) -> DataFrame:
    """k1, k2 and ``cands``, the places (start, len, win) where a window may stand."""
    found = found.where("g > 0")
    counts = found.groupBy("sh").agg(F.count(F.lit(1)).alias("n"))
    # A shingle without a count is nowhere, so neither is its window.
    ranked = own.join(counts, "sh", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = saved(ranked.groupBy("win", "len").agg(F.min(F.struct("n", "sh", "off")).alias("r"))
                   .where("r.n > 0").select("r.sh", "r.off", "win", "len"))
    fits = found.join(_small(prefix), "sh").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    return fits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len", "win")).alias("cands"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: k1, k2, doc_id, n_words, n_hit, n_items, items (sorted)."""
    windows = saved(benchmark_windows(items, size))
    own = saved(window_shingles(windows, shingle))
    found = saved(places(docs, own))
    cands = saved(candidates(found, own))
    # Rows of one key have one text: each key's is cut once.
    texts = docs.select(*row_key(), "text").join(_small(cands.select("k1", "k2")), ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    # Written, so that no text is cut again for each of its candidates inside the lambda below.
    rows = saved(texts.join(cands, ["k1", "k2"]).select("k1", "k2", words("text").alias("w"), "cands"))

    def stands(c):
        return F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ") == c["win"]

    hits = rows.select("k1", "k2", F.filter("cands", stands).alias("hits")).where(F.size("hits") > 0)
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    hits = saved(hits.select("k1", "k2", F.size(covered).cast("long").alias("n_hit"),
                             F.array_distinct(F.transform("hits", lambda c: c["win"])).alias("wins")))
    named = (hits.select("k1", "k2", F.explode("wins").alias("win")).join(windows.select("win", "item"), "win")
             .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items")))
    judged = hits.drop("wins").join(named, ["k1", "k2"])
    whole = found.where("g = 0").select("k1", "k2", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return whole.join(judged, ["k1", "k2"], "left") \
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))) \
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))) \
        .withColumn("n_items", F.size("items").cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    found = decontaminate(docs, items, size).where("n_hit > 0").select("k1", "k2").distinct()
    return without(docs, saved(found))
