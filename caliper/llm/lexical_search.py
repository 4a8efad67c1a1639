"""Operator 12, ranked lexical search over an index of geometric blocks.

Terms are maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z
lower-cased.  The score of a document is the sum, over an item's distinct terms, of a
term's weight (from the documents that hold it) times the document's impact of the term,
all in integers.

Index: documents become vectors of impacts, and each gets a geometric code, its nearest and
second nearest of ``CENTRES`` representatives (documents of least hash: a bounded sample that
decides only the order, every document is indexed).  Rows range-partitioned by code form
shards of similar documents.  In a shard the posting list of each term, in order of the
code, is cut into blocks of at most ``BLOCK`` documents of one nearest representative; a block's
summary is the coordinatewise maximum of its documents' impacts.  Summaries hold the
coordinates that a search can read: terms no heavier that occur beside the block's term in
some item.

Search: an item's terms are taken by falling weight.  A document is owned by the heaviest of
them that it holds, so in the block of a term its score cannot exceed the summary's products
with that term and lighter ones.  Blocks whose bound is below the item's tenth best score so
far are skipped (equal bounds are not, as ids break ties); a bound over whole lists is tried
first.  Documents of the others are scored in full, best bounds first.  The tenth best score
goes from shard to shard inside a task, and the best of all tasks are merged by a window.

Plan: two passes over the documents' vectors, one shuffle of them (by code), no pair of a
document and an item but the best ten a task.  Items are searched in passes of about
``ITEM_TERMS`` rows of (item, term), which with their terms are broadcast.

Edge cases: null and empty texts have no terms and match nothing; each row of the items has a
ranking of its own, so repeated ids repeat theirs; repeated documents rank one by one; a null
doc_id ranks after others of its score; a term in every document may weigh 0 and adds
nothing; without documents or items the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliper.llm.common import map_text, saved
from caliper.llm.textnp import Words
from caliper.operators.prefix import broadcast_if_small

TOP = 10
CENTRES = 128
BLOCK = 64
#: Documents of a shard at most; fewer if its matrix of documents and terms had more than DENSE cells.
SHARD, DENSE = 2048, 1 << 23
ITEM_TERMS = 1 << 17
_I = np.int64
_LAST_ID = np.iinfo(np.int64).max
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[65:91] = _PARTS[97:123] = False
_PARTS[128:] = False


def term_words(arr: pa.Array) -> Words:
    return Words(arr, lower=True, cut=_PARTS)


def _blobs(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary strings of the stretches of an int32 array between the offsets ``at``."""
    flat = np.ascontiguousarray(flat, np.int32)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(_I)), pa.py_buffer(flat)]) \
        .cast(pa.binary())


def _ints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of an array of binary strings, and the offsets of each."""
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], _I)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view(np.int32) if not len(data) or data.ctypes.data % 4 == 0 else data.copy().view(np.int32), (off - off[0]) // 4


# Items ------------------------------------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """(iid, term): the distinct terms of every item."""
    def run(part):
        w = term_words(part.column("text"))
        coded = w.strings().dictionary_encode()
        size = len(coded.dictionary) + 1
        key = np.unique(w.doc_of_word() * size + coded.indices.to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [part.column("iid").take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)).cast(pa.string())],
            ["iid", "term"])

    return map_text(items.select("iid", "text"), run, "iid long, term string")


class Queries:
    """The items of one pass: terms by falling weight, those of each item in that order."""

    def __init__(self, iids: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        """``iids, terms``: one entry for each pair; ``weights``: of every term, falling."""
        order = np.lexsort((terms, iids))
        self.iids, first = np.unique(iids[order], return_index=True)
        self.at = np.append(first, len(order)).astype(_I)
        self.terms = terms[order]
        self.item = np.repeat(np.arange(len(self.iids)), np.diff(self.at))
        self.weights = weights
        by_term = np.argsort(self.terms, kind="stable")
        self.pairs, ends = by_term, np.searchsorted(self.terms[by_term], np.arange(len(weights) + 1))
        self.pairs_at = ends

    def beside(self, term: int) -> np.ndarray:
        """Terms no heavier than ``term`` that some item holds with it, itself included."""
        pairs = self.pairs[self.pairs_at[term]:self.pairs_at[term + 1]]
        return np.unique(np.concatenate([[term], *(self.terms[p:self.at[self.item[p] + 1]] for p in pairs)]).astype(_I))


# Documents as vectors ---------------------------------------------------------------------------

def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms of the text), terms, counts (int32 blobs of the vocabulary's terms in it)."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()).cast(pa.binary()))

    def run(part):
        w = term_words(part.column("text"))
        coded = w.strings().dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=shared.value), -1).to_numpy(zero_copy_only=False)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int32)
        has = ids >= 0
        size = len(shared.value) + 1
        key, counts = np.unique(w.doc_of_word()[has] * size + ids[has], return_counts=True)
        at = np.searchsorted(key, np.arange(w.n + 1) * size)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.n_words.astype(_I)), _blobs(key % size, at), _blobs(counts, at)],
            ["doc_id", "n", "terms", "counts"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n long, terms binary, counts binary")


def document_frequencies(vecs: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: as many numbers as the pass has terms."""
    def run(batches):
        total = np.zeros(n_terms, _I)
        for b in batches:
            total += np.bincount(_ints(b.column("terms"))[0], minlength=n_terms)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    out = np.zeros(n_terms, _I)
    for term, n in vecs.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, counts: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Impact of each count in texts of ``n`` terms each, among texts of ``n_words`` terms in all."""
    if n.size and int(n.max()) * n_docs * 90 > _LAST_ID:
        m = np.array([100 - 90 + (90 * int(x) * n_docs) // n_words for x in n.tolist()], _I)
    else:
        m = 100 - 90 + (90 * n * n_docs) // n_words
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _nearest(terms, values, at, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (nearest and second nearest centre) and nearness of each document's vector."""
    n, k = len(at) - 1, centres.shape[1]
    code, near = np.zeros(n, _I), np.zeros(n, np.float32)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 14), "right")) - 1)
        own = values[at[a]:at[b]].astype(np.float32)
        full = np.flatnonzero(np.diff(at[a:b + 1]) > 0)
        if len(full):
            dots = np.add.reduceat(centres[terms[at[a]:at[b]]] * own[:, None], at[a:b][full] - at[a], axis=0)
            norm = np.sqrt(np.add.reduceat(own * own, at[a:b][full] - at[a]))
            two = np.argpartition(-dots, 1, axis=1)[:, :2] if k > 2 else np.argsort(-dots, axis=1)[:, :2]
            rows = np.arange(len(full))
            left, right = dots[rows, two[:, 0]], dots[rows, two[:, -1]]
            swap = right > left
            first, second = np.where(swap, two[:, -1], two[:, 0]), np.where(swap, two[:, 0], two[:, -1])
            code[a + full] = first * k + second
            near[a + full] = np.maximum(left, right) / np.maximum(norm, 1e-9)
        a = b
    return code, near


def coded(vecs: DataFrame, queries: Queries, rename: np.ndarray, n_docs: int, n_words: int, centres: int) -> DataFrame:
    """doc_id, code, near, terms, impacts: vectors over the terms that weigh something, each by its rank."""
    def ranked(batch):
        terms, at = _ints(batch.column("terms"))
        counts, _ = _ints(batch.column("counts"))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
        imp = impacts(np.asarray(batch.column("n"))[doc], counts.astype(_I), n_docs, n_words)
        terms = rename[terms]
        order = np.lexsort((terms, doc))
        order = order[terms[order] < len(queries.weights)]
        doc = doc[order]
        return terms[order], imp[order], np.searchsorted(doc, np.arange(batch.num_rows + 1))

    n_terms = len(queries.weights)
    some = vecs.where(F.length("terms") > 0).orderBy(F.xxhash64("doc_id", "terms")).limit(centres)
    matrix = np.zeros((n_terms, centres), np.float32)
    for j, batch in enumerate(b for t in some.toArrow().to_batches() for b in (t.slice(i, 1) for i in range(t.num_rows))):
        terms, imp, _ = ranked(batch)
        column = imp * queries.weights[terms]
        matrix[terms, j] = column / max(float(np.sqrt((column.astype(float) ** 2).sum())), 1.0)
    shared = vecs.sparkSession.sparkContext.broadcast(matrix)
    weights = queries.weights

    def run(batches):
        for batch in batches:
            terms, imp, at = ranked(batch)
            code, near = _nearest(terms, imp * weights[terms], at, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(code), pa.array(near), _blobs(terms, at), _blobs(imp, at)],
                ["doc_id", "code", "near", "terms", "impacts"])

    return vecs.where(F.length("terms") > 0).mapInArrow(
        run, "doc_id long, code long, near float, terms binary, impacts binary").where(F.length("terms") > 0)


# The index --------------------------------------------------------------------------------------

INDEX = ("doc_ids binary, doc_at binary, terms binary, impacts binary, block_term binary, block_at binary, block_docs binary, "
         "summary_at binary, summary binary")


class Shard:
    """Some documents, the blocks of their posting lists and the blocks' summaries."""

    def __init__(self, doc_ids, doc_at, terms, impacts):
        self.doc_ids, self.doc_at, self.terms, self.impacts = doc_ids, doc_at, terms, impacts
        self.held = np.unique(terms)                   # terms of the shard, by rank
        self.doc = np.repeat(np.arange(len(doc_ids)), np.diff(doc_at))
        self.own = np.searchsorted(self.held, terms)
        self.matrix = np.zeros((len(doc_ids), len(self.held)), np.int32)
        self.matrix[self.doc, self.own] = impacts

    def local(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of those ``terms`` that the shard holds, and which they are."""
        at = np.searchsorted(self.held, terms)
        ok = at < len(self.held)
        ok[ok] = self.held[at[ok]] == terms[ok]
        return at[ok], ok

    def build(self, nearest: np.ndarray, queries: Queries, block: int) -> None:
        order = np.argsort(self.own, kind="stable")    # posting lists, documents by code
        lists = np.searchsorted(self.own[order], np.arange(len(self.held) + 1))
        docs, block_term, block_at, summary, at = self.doc[order], [], [], [], 0
        summary_at = [0]
        for t, term in enumerate(self.held):
            rows = docs[lists[t]:lists[t + 1]]
            new = np.ones(len(rows), bool)
            new[1:] = nearest[rows[1:]] != nearest[rows[:-1]]
            start = np.flatnonzero(new)
            run = np.repeat(start, np.diff(np.append(start, len(rows))))
            starts = np.flatnonzero((np.arange(len(rows)) - run) % block == 0)
            columns, _ = self.local(queries.beside(term))
            top = np.maximum.reduceat(self.matrix[np.ix_(rows, columns)], starts, axis=0)
            block_term.append(np.full(len(starts), t, np.int32))
            block_at.append(starts + at)
            summary.append(top.ravel())
            summary_at.append(summary_at[-1] + top.size)
            at += len(rows)
        self.block_docs, self.summary_at = docs, np.array(summary_at, _I)
        self.block_term = np.concatenate(block_term)
        self.block_at = np.append(np.concatenate(block_at), at)
        self.summary = np.concatenate(summary)

    def row(self) -> list[bytes]:
        long, short = (lambda x: x.astype(_I).tobytes()), (lambda x: x.astype(np.int32).tobytes())
        return [long(self.doc_ids), short(self.doc_at), short(self.terms), short(self.impacts), short(self.block_term),
                short(self.block_at), short(self.block_docs), long(self.summary_at), short(self.summary)]

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Shard:
        def ints(name, kind=np.int32):
            return np.frombuffer(row[name], kind)

        out = cls(ints("doc_ids", _I), ints("doc_at"), ints("terms"), ints("impacts"))
        out.block_term, out.block_at, out.block_docs = ints("block_term"), ints("block_at"), ints("block_docs")
        out.summary_at, out.summary = ints("summary_at", _I), ints("summary")
        return out


def build_index(rows: DataFrame, queries: Queries, centres: int, block: int = BLOCK, shard: int | None = None) -> DataFrame:
    """One row a shard; ``rows`` are those of ``coded``."""
    most = shard or max(64, min(SHARD, DENSE // max(len(queries.weights), 1)))
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        held, n = [], 0

        def flush(rest=False):
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while n - at >= most or (rest and at < n):
                part = table.slice(at, most).combine_chunks().to_batches()[0]
                at += part.num_rows
                terms, doc_at = _ints(part.column("terms"))
                values, _ = _ints(part.column("impacts"))
                ids = pc.fill_null(part.column("doc_id"), _LAST_ID).to_numpy(zero_copy_only=False)
                one = Shard(ids, doc_at, terms, values)
                one.build(np.asarray(part.column("code")) // centres, shared.value, block)
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, one.row(), strict=True))],
                                                 pa.schema([(c, pa.binary()) for c in NAMES]))
            held, n = (table.slice(at).to_batches(), n - at) if at < n else ([], 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield from flush()
        if n:
            yield from flush(True)

    dealt = rows.repartitionByRange("code", "near", "doc_id").sortWithinPartitions("code", "near", "doc_id")
    return dealt.mapInArrow(run, INDEX)


NAMES = [c.split()[0] for c in INDEX.split(", ")]


# Search -----------------------------------------------------------------------------------------

class Best:
    """The best documents of an item so far: greatest score, then least id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, _I), np.zeros(0, _I)

    @property
    def least(self) -> int:
        """Scores below this one are of no use."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = scores >= self.least
        scores, ids = np.concatenate((self.scores, scores[ok])), np.concatenate((self.ids, ids[ok]))
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(shard: Shard, queries: Queries, best: list[Best]) -> tuple[int, int]:
    """Put the shard's documents into the ``best`` of every item; blocks looked at and scored."""
    own, here = shard.local(queries.terms)
    item, terms = queries.item[here], queries.terms[here]
    weights = queries.weights[terms]
    if not len(own):
        return 0, 0
    # Of every item's lists from a term on: a bound from the greatest impacts of the shard.
    part = weights * shard.matrix.max(axis=0)[own].astype(_I)
    total = np.cumsum(part)
    edge = np.searchsorted(item, np.arange(len(best) + 1))
    whole = np.concatenate(([0], total))
    bound = whole[edge[item + 1]] - total + part
    block_of = np.searchsorted(shard.block_term, np.arange(len(shard.held) + 1))
    columns, looked, scored = {}, 0, 0
    for q in range(len(best)):
        a, b = edge[q], edge[q + 1]
        if a == b or bound[a] < best[q].least:
            continue
        bounds, blocks = [], []
        for p in range(a, b):
            if bound[p] < best[q].least:
                break               # bounds fall from term to term
            t = own[p]
            if t not in columns:
                columns[t] = shard.local(queries.beside(int(shard.held[t])))[0]
            at, to = block_of[t], block_of[t + 1]
            table = shard.summary[shard.summary_at[t]:shard.summary_at[t + 1]].reshape(to - at, -1)
            pick = np.searchsorted(columns[t], own[p:b])
            bounds.append(table[:, pick].astype(_I) @ weights[p:b])
            blocks.append(np.arange(at, to))
        bounds, blocks = np.concatenate(bounds), np.concatenate(blocks)
        looked += len(blocks)
        order = np.argsort(-bounds, kind="stable")
        bounds, blocks = bounds[order], blocks[order]
        seen = np.zeros(len(shard.doc_ids), bool)
        at, step = 0, 1
        while at < len(blocks) and bounds[at] >= best[q].least:
            to = min(at + step, len(blocks))
            to = at + int(np.searchsorted(-bounds[at:to], -best[q].least, "right"))
            docs = np.unique(np.concatenate([shard.block_docs[shard.block_at[k]:shard.block_at[k + 1]] for k in blocks[at:to]]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                best[q].add(shard.matrix[np.ix_(docs, own[a:b])].astype(_I) @ weights[a:b], shard.doc_ids[docs])
            scored += to - at
            at, step = to, step * 2
    return looked, scored


def search(index: DataFrame, queries: Queries, top: int = TOP) -> DataFrame:
    """(iid, doc_id, score): of every item the ``top`` best documents, of each task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        own = shared.value
        best = [Best(top) for _ in own.iids]
        for batch in batches:
            for row in range(batch.num_rows):
                search_shard(Shard.read({c: batch.column(c)[row].as_buffer() for c in NAMES}), own, best)
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, _I)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(own.iids, [len(b.ids) for b in best])), pa.array(ids, mask=ids == _LAST_ID),
             pa.array(np.concatenate([b.scores for b in best]) if best else ids)], ["iid", "doc_id", "score"])

    return index.mapInArrow(run, "iid long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, centres: int = CENTRES, block: int = BLOCK,
                   shard: int | None = None, most_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0."""
    rows = saved(items.select("item_id", "text").withColumn("iid", F.monotonically_increasing_id()))
    pairs = saved(item_terms(rows))
    passes = -(-pairs.count() // most_terms)
    found = []
    for number in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("iid"), F.lit(passes)) == number).toArrow()     # about ``most_terms`` rows
        coded_terms = own.column("term").combine_chunks().dictionary_encode()
        vocabulary = coded_terms.dictionary.to_pylist()
        vecs = saved(vectors(docs, vocabulary).where("n > 0"))
        n_docs, n_words = vecs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not vocabulary:
            continue
        df = document_frequencies(vecs, len(vocabulary))
        weight = np.array([term_weight(n_docs, x) if x else 0 for x in df.tolist()], _I)
        order = np.lexsort((np.array(vocabulary), -weight))
        order = order[weight[order] > 0]
        if not len(order):
            continue
        rename = np.full(len(vocabulary), len(order), _I)      # terms without weight or document: none
        rename[order] = np.arange(len(order))
        term = rename[coded_terms.indices.to_numpy(zero_copy_only=False)]
        iid = own.column("iid").to_numpy()
        has = term < len(order)
        queries = Queries(iid[has], term[has], weight[order])
        index = saved(build_index(coded(vecs, queries, rename, n_docs, n_words, centres), queries, centres, block, shard))
        found.append(saved(search(index, queries, top)))
    if not found:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                           F.lit(0).cast("long").alias("score")).limit(0)
    hits = reduce(DataFrame.unionByName, found).withColumn("part", F.spark_partition_id() % 64)
    for by in (["iid", "part"], ["iid"]):
        ranked = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        hits = hits.withColumn("rank", ranked).where(F.col("rank") <= top)
    return hits.join(broadcast_if_small(rows.select("iid", "item_id")), "iid").select("item_id", "rank", "doc_id", "score")
