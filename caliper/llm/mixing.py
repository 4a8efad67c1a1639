"""Operator 13, mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words; targets end at ``MOST_EPOCHS`` times
the source's size, and what is cut off goes to the other sources by weight until none is
above.  A target of T words over a source of S words is T div S complete epochs, in which
every document is taken whole, and a remainder: documents are sorted by an exponential
key, ``-ln(u) / quality`` with u from a hash of the document's id, so that better ones tend
to come first; a prefix sum of their sizes fills the remainder's budget.  The document at
the budget's end gives only its first words, so a source takes its target's whole words.

Plan: sizes and weights are columns of one scan; equal rows become one with a count, by a
partial aggregate.  The prefix sum is ``operators.prefix.running_sums``: range partitions of
(source, key), however many rows one source has, plus offsets.  Sources are a small table:
weights by rank from the same running sum, targets by rounds of one one-row aggregate.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is a source
of its own, last in rank; equal rows are taken one after the other; a null doc_id has the key of
an empty id; a source of size 0 has target 0; an empty table gives an empty result; other
columns are ignored.  Reruns agree: keys depend on ids, qualities and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import row_key, saved
from caliper.operators.prefix import broadcast_if_small, running_sums

MOST_EPOCHS = 3
CYCLE = 3               # sources weigh 1, 2 .. CYCLE, repeating, by rank
SEED = "mix"
#: A document's quality falls by this much a share of characters that are ``NOISE``.
NOISE = "0123456789#*$%&|<>[]{}=_~^@"
STEEP, LEAST = 4.0, 0.05
SPACE = "\t\n\x0b\x0c\r"


def text_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    found = F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def text_quality(text: Column) -> Column:
    """1 for plain prose, less with digits and symbols, ``LEAST`` at least (null or empty: 1)."""
    chars = F.length(text)
    noise = (chars - F.length(F.translate(text, NOISE, ""))).cast("double")
    return F.coalesce(F.greatest(F.lit(LEAST), 1.0 - STEEP * noise / F.nullif(chars, F.lit(0))), F.lit(1.0))


def exponential_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """``-ln(u) / quality``, u the first 52 bits of the md5 of seed and id."""
    id_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id_text)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / quality


def source_targets(sized: DataFrame, most_epochs: int = MOST_EPOCHS, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, weight, target) of rows (source, size)."""
    sources = saved(sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")))
    named = sources.where("source IS NOT NULL").withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(named, [], "source", ["one"]).select("source", "source_size", F.col("cum_one").alias("rank"))
    last = named.count() + 1
    ranked = ranked.unionByName(sources.where("source IS NULL").withColumn("rank", F.lit(last).cast("long")))
    ranked = saved(ranked.select("source", "source_size", ((F.col("rank") - 1) % cycle + 1).alias("weight")))

    def wide(c):
        return F.col(c).cast("decimal(19,0)")

    # Sources above their cap at a level of ``left / share`` words a weight stay above it as the level rises.
    left, share = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                             F.coalesce(F.sum("weight"), F.lit(0))).first()
    total = left
    while share:
        above = wide("weight") * F.lit(left).cast("decimal(19,0)") > \
            (most_epochs * wide("source_size")).cast("decimal(19,0)") * F.lit(share).cast("decimal(19,0)")
        capped, rest = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
                                  F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (total - most_epochs * capped, rest) == (left, share):
            break
        left, share = total - most_epochs * capped, rest
    cap = (most_epochs * F.col("source_size")).cast("double")
    level = (F.col("weight") * F.lit(left).cast("long")).cast("double") / F.lit(float(max(share, 1)))
    target = F.least(cap, level) if share else cap
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, source: str = "source", size: Column | None = None, quality: Column | None = None,
        most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: k1, k2 (its row key), doc_id, source, size, source_size, target,
    epochs (complete ones) and taken (words, epochs included)."""
    size = F.size(text_words(F.col("text"))).cast("long") if size is None else size
    quality = text_quality(F.col("text")) if quality is None else quality
    rows = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       size.alias("size"), exponential_key(F.col("doc_id"), quality, seed).alias("key"))
    same = saved(rows.groupBy("k1", "k2", "doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies"))
                 .withColumn("words", F.col("copies") * F.col("size"))
                 .withColumn("place", F.struct("key", "k1", "k2")))
    targets = saved(source_targets(same.select("source", F.col("words").alias("size")), most_epochs))
    summed = running_sums(same, ["source"], "place", ["words"])
    dims = broadcast_if_small(targets.select(F.col("source").alias("of"), "source_size", "target"))
    held = summed.join(dims, F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    held = held.withColumn("epochs", epochs)
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.col("cum_words") - F.col("words")
    # Equal rows share a key: the budget left goes to them one after the other.
    one = held.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "epochs",
                      (budget - before).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return one.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "epochs",
                      (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, mixed: DataFrame, source: str = "source") -> DataFrame:
    """The mixed corpus: (doc_id, source, epoch, text), one row for each time that a document is taken;
    a text of which only some words are taken has its first ones, joined by one space."""
    plan = mixed.where("taken > 0").groupBy("k1", "k2", "source", "size").agg(F.collect_list("taken").alias("takes"))
    rows = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), "text")
    rows = rows.groupBy("k1", "k2", "source").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    each = rows.alias("a").join(plan.alias("b"), same) \
        .select("a.doc_id", "a.source", "a.text", "b.size", F.explode("b.takes").alias("taken"))
    each = each.select("doc_id", "source", "text", "size", "taken", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr("(taken - 1) div size"))).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    cut = F.array_join(F.slice(text_words(F.col("text")), F.lit(1), words.cast("int")), " ")
    return each.select("doc_id", "source", "epoch", F.when(words == F.col("size"), F.col("text")).otherwise(cut).alias("text"))
