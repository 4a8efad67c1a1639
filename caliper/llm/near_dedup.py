"""Operator 4, MinHash near-dedup with tensored banding.

Two small collections of ``half`` entries are made for each set of word shingles, an
entry being a hash of ``rows`` minhash values.  Table keys are all pairs of an entry of
the first and an entry of the second collection: ``half ** 2`` tables of ``2 * rows``
values each from only ``2 * half * rows`` minhashes.  Two sets of Jaccard similarity J
share no key with probability of about ``2 * (1 - J ** rows) ** half``: with the
defaults 5e-6 at J = 0.8 and far less above.

Plan: texts become fixed-size signatures, map-only; equal sets (exact copies) collapse
to one representative by a partial aggregate; entries that only one representative has
are dropped, and keys are formed of what is left.  A shared key makes candidates, and
each candidate pair is confirmed on its full shingle sets.  Candidates of a key are
first tried in stars around the member that is most like the others, so that a key with
thousands of near copies costs thousands of checks; pairs whose ends are linked already
need none.  Members of keys that are still not connected then meet in an exact
prefix-filtered set join, so no link between different texts is lost, and a large group
of copies that are not quite similar enough does not emit its pairs.  Components come
from large-star/small-star steps.

The nodes that are linked are distinct shingle sets, numbered when they are written, not
doc_ids, so texts that share an id, or have none, are linked by what they hold.

Edge cases: a null or empty text has no shingles and links with nothing; a text shorter
than a shingle is one shingle; repeated rows and exact copies share a class; different
texts of one doc_id are judged each by its own class; a null doc_id takes part by its text
but cannot name a component (its component is that of its copies and near copies, or null
if all of them have none, and then the row of the class's first set is kept); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import bounded_batches, map_text, row_key, saved, slices, without
from caliper.llm.components import components
from caliper.llm.textnp import Words, mix
from caliper.operators.prefix import discard

SHINGLE = 4
PERCENT = 80
HALF = 12
ROWS = 2
STAR_ROUNDS = 2
#: Cells of the table that tells rare shingles from common ones; it steers the order only.
CELLS = 1 << 20
#: Up to so many candidate ids (8 bytes each) are broadcast to pick their texts, else joined.
MOST_BROADCAST_IDS = 1_000_000
_U = np.uint64


def shingle_sets(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and n+1 offsets."""
    w = Words(arr, lower=True)
    h = w.hashes()
    values, at = w.grams(h, size)
    doc = np.repeat(np.arange(w.n), np.diff(at))
    for short in range(1, size):            # fewer words than a shingle: all of them are one
        found, where = w.grams(h, short)
        pick = np.flatnonzero(w.n_words == short)
        values = np.concatenate((values, mix(found[where[pick]] + _U(short))))
        doc = np.concatenate((doc, pick))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(w.n + 1))


def signatures(docs: DataFrame, size: int = SHINGLE, half: int = HALF, rows: int = ROWS) -> DataFrame:
    """doc_id, k1, k2, n_shingles, s1, s2 (hash of the whole set), a, b (the two collections)."""
    rng = np.random.Generator(np.random.PCG64(41))
    factor = rng.integers(0, 1 << 63, 2 * half * rows, dtype=np.uint64) * _U(2) + _U(1)
    shift = rng.integers(0, 1 << 63, 2 * half * rows, dtype=np.uint64)

    def run(part):
        values, at = shingle_sets(part.column("text"), size)
        n = np.diff(at)
        has = np.flatnonzero(n)
        low = np.zeros((2 * half * rows, len(has)), np.uint64)
        sums = np.zeros((2, len(n)), np.uint64)
        if len(has):
            begin = at[:-1][has]
            for k in range(2 * half * rows):
                x = values * factor[k]
                x += shift[k]
                x ^= x >> _U(29)
                x *= _U(0x94D049BB133111EB)
                low[k] = np.minimum.reduceat(x, begin)
            sums[0][has] = np.add.reduceat(mix(values), begin)
            sums[1][has] = np.add.reduceat(mix(values ^ _U(0xA5A5A5A5A5A5A5A5)), begin)
        entry = np.zeros((2 * half, len(has)), np.uint64)
        for j in range(rows):
            entry = mix(entry + low[j::rows] + _U(1 + j))
        entry = np.ascontiguousarray(entry.T).view(np.int64).reshape(-1, half)   # row 2d: a, row 2d+1: b of text d
        where = np.concatenate(([0], np.cumsum(half * (n > 0)))).astype(np.int32)
        ab = [pa.ListArray.from_arrays(pa.array(where), pa.array(np.ascontiguousarray(entry[s::2]).ravel())) for s in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n.astype(np.int64)),
             *(pa.array(s.view(np.int64)) for s in sums), *ab],
            ["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "a", "b"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text"), run,
                    "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>")


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, rep, score): keys of the tensored tables whose two entries both occur
    elsewhere.  ``score`` adds up how often the entries of ``rep`` occur: in a group of
    near copies it is greatest for the copy that is most like all others."""
    def side(name):
        return reps.select("rep", F.posexplode(name).alias("i", "h")) \
            .select("rep", F.lit(name).alias("side"), F.xxhash64(F.lit(name), "i", "h").alias("e"))

    entries = saved(side("a").unionByName(side("b")))
    often = entries.groupBy("e").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    left = (entries.join(often, "e").groupBy("rep")
            .agg(*[F.collect_list(F.when(F.col("side") == s, F.col("e"))).alias(s) for s in "ab"],
                 F.sum("often").alias("score")))
    pairs = left.select("rep", "score", F.explode("a").alias("x"), "b").select("rep", "score", "x", F.explode("b").alias("y"))
    return pairs.select(F.xxhash64("x", "y").alias("key"), "rep", "score")


def pick_texts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(rep, text) of the rows named in ``picked`` (rep, k1, k2); repeated rows once."""
    few = picked.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    rows = docs.select(*row_key(), "text").join(F.broadcast(picked) if few else picked, ["k1", "k2"])
    return rows.groupBy("rep").agg(F.min("text").alias("text"))


def similar(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those (u, v) whose full shingle sets have ``100 * intersection >= percent * union``."""
    both = (pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u")
            .join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v"))

    def run(part):
        x, ax = shingle_sets(part.column("tu"), size)
        y, ay = shingle_sets(part.column("tv"), size)
        ok = []
        for d in range(part.num_rows):
            p, q = x[ax[d]:ax[d + 1]], y[ay[d]:ay[d + 1]]
            common = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * common >= percent * (len(p) + len(q) - common))
        keep = part.filter(pa.array(ok, pa.bool_()))
        yield keep.select(["u", "v"])

    return map_text(both.select("u", "v", "tu", "tv"), run, "u long, v long", column="tu")


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts hold a shingle, by hash cell: CELLS numbers, whatever the input."""
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((shingle_sets(part.column("text"), size)[0] % _U(CELLS)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    bounded_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefix_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v), u > v, of different components that may link: an exact set join.

    ``texts``: rep, component, n, text.  Shingles are ordered, rare cells first; two
    similar sets share one of their first ``n - ceil(percent * n / 100) + 1`` shingles, and
    at the first one they share, what is left of both must still make up the overlap that
    the threshold asks for.  A group of near copies that are not linked differ in rare
    shingles, which come first, so nearly none of its pairs pass, however large it is."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, size))     # CELLS numbers

    def run(part):
        values, at = shingle_sets(part.column("text"), size)
        doc = np.repeat(np.arange(part.num_rows), np.diff(at))
        order = np.lexsort((values, counts.value[(values % _U(CELLS)).astype(np.int64)], doc))
        n = np.diff(at)
        place = np.arange(len(values)) - at[:-1][doc]
        first = place < (n - -(-percent * n // 100) + 1)[doc]
        pick = pa.array(doc[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(values[order][first].view(np.int64)), pa.array(place[first].astype(np.int32)),
             *(part.column(c).take(pick) for c in ("rep", "component", "n"))], ["sh", "pos", "rep", "component", "n"])

    heads = saved(map_text(texts.select("rep", "component", "n", "text"), run,
                           "sh long, pos int, rep long, component long, n long"))
    often = heads.groupBy("sh").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sh")
    heads = saved(heads.join(often, "sh", "leftsemi"))
    other = heads.select("sh", *[F.col(c).alias(f"{c}_v") for c in ("rep", "component", "n", "pos")])
    rest = F.least(F.col("n") - F.col("pos"), F.col("n_v") - F.col("pos_v"))       # this one included
    enough = rest * (100 + percent) >= percent * (F.col("n") + F.col("n_v"))
    return heads.join(other, "sh").where((F.col("component") != F.col("component_v")) & (F.col("rep") > F.col("rep_v")) & enough) \
        .select(F.col("rep").alias("u"), F.col("rep_v").alias("v")).distinct()


def _with_component(keys: DataFrame, found: DataFrame | None) -> DataFrame:
    """Keys whose members are in different components, and those members."""
    if found is None:
        return keys.withColumn("component", F.col("rep"))
    held = saved(keys.join(found.withColumnRenamed("node", "rep"), "rep", "left")
                 .withColumn("component", F.coalesce("component", "rep")))
    split = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    left = saved(held.join(split, "key", "leftsemi"))
    discard(held)
    return left


def links(docs: DataFrame, keys: DataFrame, sizes: DataFrame, size: int = SHINGLE,
          percent: int = PERCENT, rounds: int = STAR_ROUNDS) -> DataFrame:
    """(node, component) of the representatives that link with another.

    ``docs``: rep, text of the representatives that have keys; ``sizes``: rep, n."""
    keys = saved(keys.join(sizes, "rep"))
    checked = good = found = None
    for turn in range(rounds + 1):
        held = _with_component(keys, found)
        if turn and held.isEmpty():
            break
        if turn < rounds:       # one centre a key: the member most like the others
            centre = held.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"), "component", "n")).alias("c")) \
                .select("key", (-F.col("c.r")).alias("v"), F.col("c.score").alias("sv"), F.col("c.component").alias("cv"), F.col("c.n").alias("nv"))
            near = F.least("n", "nv") * 100 >= F.greatest("n", "nv") * percent
            pairs = held.join(centre, "key").where((F.col("component") != F.col("cv")) & near)
            if turn == 0:       # the best of its centres is enough for a start
                pairs = pairs.groupBy("rep").agg(F.max(F.struct("sv", "v")).alias("b")).select("rep", "b.v")
            pairs = pairs.select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v")).distinct()
        else:
            members = held.select("rep", "component", "n").distinct()
            pairs = prefix_pairs(saved(docs.join(members, "rep")), size, percent)
        if checked is not None:
            pairs = pairs.join(checked, ["u", "v"], "leftanti")
        pairs = saved(pairs)
        if pairs.isEmpty():
            continue
        new = saved(similar(pairs, docs, size, percent))
        checked = pairs if checked is None else saved(checked.unionByName(pairs))
        good = new if good is None else saved(good.unionByName(new))
        found = saved(components(good))
        if turn:
            discard(held)
    return found if found is not None else docs.sparkSession.createDataFrame([], "node long, component long")


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, half: int = HALF,
               rows: int = ROWS, rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, its row key (k1, k2) and
    ``node``, which all rows of its class share (null without shingles)."""
    sets = saved(signatures(docs, size, half, rows))
    reps = sets.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles") \
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2", "a", "b")).alias("r")) \
        .select("s1", "s2", F.col("n_shingles").alias("n"), "least", "r.k1", "r.k2", "r.a", "r.b")
    reps = saved(reps.withColumn("rep", F.monotonically_increasing_id()))
    every = saved(table_keys(reps))
    few = saved(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    keys = saved(every.join(few, "key", "leftsemi"))
    discard(every)
    ids = saved(keys.select("rep").distinct())
    texts = saved(pick_texts(docs, saved(reps.select("rep", "k1", "k2").join(ids, "rep", "leftsemi"))))
    found = saved(links(texts, keys, reps.select("rep", "n"), size, percent, rounds).select(F.col("node").alias("rep"), "component"))
    named = saved(found.join(reps.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("named")))
    found = found.join(named, "component")
    classes = reps.join(found, "rep", "left").select(
        "s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("node"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"),
        F.when(F.coalesce("component", "rep") == F.col("rep"), F.col("k2")).alias("first_k2"))
    out = sets.select("doc_id", "k1", "k2", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    first = F.col("node").isNull() | F.coalesce(F.col("k2") == F.col("first_k2"), F.lit(False))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull() & first).alias("kept"), "k1", "k2", "node")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one of each class stays, one that ``near_dedup`` keeps;
    of rows without shingles, one of those equal in id and text."""
    found = saved(near_dedup(docs, size, percent).select("k1", "k2", "kept", "node"))
    held = found.where("node IS NOT NULL")
    stays = saved(held.where("kept").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("r")).select("r.*"))
    gone = held.select("k1", "k2").distinct().join(stays, ["k1", "k2"], "leftanti")
    again = saved(found.join(gone, ["k1", "k2"], "leftanti").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    gone = saved(gone)
    if again.isEmpty():
        return without(docs, gone)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    one = keyed.join(again, ["k1", "k2"], "leftsemi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return without(docs, gone.unionByName(again)).unionByName(one.select("row.*"))
