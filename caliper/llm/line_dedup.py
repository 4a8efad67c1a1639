"""Operator 2, line dedup: lines that stand on many sites are boilerplate.

Every line with a word goes by a 128-bit hash.  A HyperLogLog sketch of its sites is
kept per hash and merged by aggregation; a line whose estimate is clearly at or above
``min_sites`` is boilerplate, clearly below is not, and a line within ``margin`` of the
threshold gets an exact distinct count.  Boilerplate lines are removed from every text.

DataFrame functions only.  Sketches are merged on the map side first, so a line that
a third of all rows hold sends one sketch a task.  Only hashes and sites shuffle, but
for one last join that brings the hashes to remove to their documents; it is per
document, so bounded by the text itself.

Edge cases: lines without a word are never removed; a null text stays null; a null
source is one site of its own; null and repeated doc_ids are kept row by row; a text
whose lines all go becomes empty; an empty table gives an empty result; all input
columns are kept, whatever their names, with the new text in ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import MOST_BROADCAST_KEYS, row_key, saved

MIN_SITES = 10
MARGIN = 0.1
LG_K = 12
#: Near copies by sketches (pipeline stage): least hashes of a text, those by which groups meet, rounds.
SKETCH, HEADS, ROUNDS = 48, 8, 3


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """k1, k2, site, h1, h2 of every line with a word."""
    there = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("-"))
    rows = docs.select(*row_key(), there.alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")) \
        .select("k1", "k2", "site", _hash(F.col("line")).alias("h")).select("k1", "k2", "site", "h.h1", "h.h2")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                margin: float = MARGIN) -> DataFrame:
    """Hashes (h1, h2) of the lines that stand on ``min_sites`` distinct sites or more."""
    lines = _lines(docs, site)
    spread = saved(lines.groupBy("h1", "h2")
                   .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
                   .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
                   .where(F.col("sites") >= min_sites * (1 - margin)))
    clear = F.col("sites") >= min_sites * (1 + margin)
    near = spread.where(~clear).select("h1", "h2")
    exact = (lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "leftsemi")
             .distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
             .where(F.col("sites") >= min_sites))
    return saved(spread.where(clear).select("h1", "h2").unionByName(exact.select("h1", "h2")))


def _sketch(words: Column, size: int) -> Column:
    """The ``SKETCH`` least hashes of the runs of ``size`` words (of all words, if they are fewer), sorted."""
    runs = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, size)]))
    runs = F.when(F.size(words) >= size, F.slice(runs, F.lit(1), F.size(words) - (size - 1))) \
        .otherwise(F.array(F.xxhash64(F.array_join(words, " "))))
    return F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH)


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Are two texts near copies, by their sketches: of the least hashes of both, how many do both hold?"""
    least = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.least(F.lit(SKETCH), F.size(F.array_union(a, b))))
    return 100 * F.size(F.array_intersect(F.array_intersect(least, a), b)) >= percent * F.size(least)


def _led(groups: DataFrame, percent: int) -> DataFrame:
    """(g, first): groups (g, sketch) that are near copies of one of a smaller number.

    Heads meet by their hashes and numbers alone; sketches join the distinct pairs that are to be compared."""
    held = groups.select("g", F.explode(F.slice("sketch", 1, HEADS)).alias("h"))
    leaders = saved(held.groupBy("h").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("h", "first"))
    pairs = saved(held.join(leaders, "h").where("first < g").select("g", "first").distinct())
    its = groups.select(F.col("g").alias("first"), F.col("sketch").alias("its"))
    return pairs.join(groups.select("g", "sketch"), "g").join(its, "first").where(_alike(F.col("sketch"), F.col("its"), percent)) \
        .groupBy("g").agg(F.min("first").alias("first"))


def one_row_a_class(docs: DataFrame, bad: DataFrame, site: str, size: int, percent: int) -> DataFrame:
    """doc_id, text and site of the documents that hold a line of ``bad``, of each class of near copies
    among them one: copies of a document are one place where its lines stand.

    Equal sketches are one group.  A group is led by the first group that shares one of its ``HEADS``
    least hashes and is alike; groups that lead are compared again, ``ROUNDS`` times, as a class may have
    several leaders.  Leaders of a hash are one row, so a large class never emits its pairs."""
    holders = saved(_lines(docs, site).select("k1", "k2", "h1", "h2").join(bad, ["h1", "h2"], "leftsemi").select("k1", "k2").distinct())
    few = holders.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS
    rows = docs.select(*row_key(), *[F.col(f"`{c}`") for c in ("doc_id", "text", site)]) \
        .join(F.broadcast(holders) if few else holders, ["k1", "k2"], "leftsemi")
    plain = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), lambda x: x != "")
    cut = rows.select("k1", "k2", plain.alias("w")).select("k1", "k2", _sketch(F.col("w"), size).alias("sketch"))
    groups = saved(cut.groupBy("sketch").agg(F.min(F.struct("k1", "k2")).alias("r"))
                   .select("sketch", "r.k1", "r.k2", F.monotonically_increasing_id().alias("g")))
    for _ in range(ROUNDS):
        led = saved(_led(groups, percent))
        if led.isEmpty():
            break
        groups = saved(groups.join(led, "g", "leftanti"))
    firsts = groups.select("k1", "k2")
    one = rows.join(firsts, ["k1", "k2"], "leftsemi").groupBy("k1", "k2")
    return one.agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(site).alias(site)).select("doc_id", "text", site)


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
               margin: float = MARGIN, bad: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` in ``row`` (a struct), and text, n_lines, n_removed."""
    if bad is None:
        bad = boilerplate(docs, site, min_sites, margin)
    removed = (_lines(docs, site).select("k1", "k2", "h1", "h2").join(bad, ["h1", "h2"], "leftsemi")
               .groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("removed")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    lines = F.split("row.text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("removed"), _hash(x)))
    return (rows.join(removed, ["k1", "k2"], "left")
            .select("row", F.when(F.col("removed").isNull(), lines).otherwise(kept).alias("kept"))
            .select("row", F.array_join("kept", "\n").alias("text"),
                    F.coalesce(F.array_size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.array_size(lines) - F.array_size("kept"), F.lit(0)).cast("long").alias("n_removed")))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES,
                        margin: float = MARGIN, size: int = 5, percent: int = 65) -> DataFrame:
    """The rows of ``docs`` with the kept lines as ``text`` (and ``n_chars`` brought in line).

    A document that is copied to many sites, exactly or nearly, is no boilerplate: its lines are
    left for near-dedup, which keeps one of the copies.  So lines that stand on many sites are
    counted a second time, over one document of each class of near copies (by sketches of the runs of
    ``size`` words) among those that hold them; what is still on ``min_sites`` sites goes from every text.
    Sketches estimate: ``percent`` lies below the 80 at which near-dedup links, so that what it
    would link is one class here."""
    bad = boilerplate(docs, site, min_sites, margin)
    bad = boilerplate(saved(one_row_a_class(docs, bad, site, size, percent)), site, min_sites, margin)
    found = line_dedup(docs, site, min_sites, margin, bad)
    goes = F.col("n_removed") > 0
    new = {"text": F.when(goes, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed = F.when(goes, F.length("text")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
