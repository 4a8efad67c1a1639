"""Operator 1, token-ID output: frequency-ranked ids in byte-aligned variable length.

File format (a folder of Parquet files, so that Spark's commit protocol covers lost
tasks and any store works): one row per *block* of documents, with
``part, block`` (order), ``start_in_part`` (ids before the block in its part),
``doc_ids``, ``n_tokens`` (lists, in order), ``controls`` and ``data`` (bytes).
An id is stored as its corpus frequency rank in 1 to 4 little-endian bytes.  The byte
counts less 1 stand apart from the bytes, in ``controls``: two bits an id, lowest bits
first; each document begins a new control byte.  Decoding looks all four lengths of a
control byte up in one 256-row numpy table.  A second folder holds ``rank, id``.

Plan: (1) tokenise, map-only, ids saved as fixed-width integers; (2) count ids (each
task sends at most one row per vocabulary entry); (3) range-partition by doc_id, sort,
code by rank and pack blocks; (4) read back.  Text never shuffles, ids do once.
The rank table is bounded by the vocabulary, so it may pass through the driver.

Edge cases: a null text is empty and yields only the end id; a null doc_id sorts
first; repeated rows and ties in doc_id are each written, in the order of their ids
(length first); an empty table gives empty files; further input columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliper.llm.common import map_text
from caliper.llm.textnp import bytes_of, span_hashes
from caliper.session import working_dir

END_ID = 2
BLOCK_IDS = 1 << 19
#: A worker remembers the ids of so many pieces, of so many bytes at most each; when it holds more it
#: forgets those that it met in one slice only since it last did so (or all, if most were met again).
MOST_PIECES, MOST_BYTES = 1_000_000, 64
#: So many new pieces go to the library as one text; it is slower on longer ones.
GROUP = 200
#: How the byte-level vocabulary writes a space.
SPACE = "Ġ"
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CONTROL = np.isin(np.arange(256), [28, 29, 30, 31])
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_RARE = _CONTROL | _LEAD
#: UTF-8 of white space beyond ASCII.
_WIDE = {"\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"[k].encode() for k in range(8)} \
    | {chr(c).encode() for c in range(0x2000, 0x200B)}
_encoders: dict[str, Encoder] = {}


def _unusual(data: np.ndarray, at: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Texts with white space before a space (``space``: where spaces are), separators, or white space
    beyond ASCII: there a cut at each space might not be a cut of the tokenizer's splitter."""
    place = space[_BLANK[data[space - 1]]] if len(space) else space
    place = place[~np.isin(place, at)]  # a text's last byte stands before another text's first
    rare = np.flatnonzero(_RARE[data])
    kind = data[rare]
    wide = rare[_LEAD[kind]].tolist()
    raw = data.tobytes() if wide else b""
    wide = [i for i in wide if raw[i:i + 2] in _WIDE or raw[i:i + 3] in _WIDE]
    odd = np.concatenate((place, rare[_CONTROL[kind]], np.array(wide, np.int64)))
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, odd, side="right") - 1] = True
    return out


def _distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct pairs, in order of the first, and of each pair's among them."""
    order = np.argsort(h1)
    new = np.ones(len(h1), bool)
    new[1:] = h1[order[1:]] != h1[order[:-1]]
    pick, back = order[new], np.empty(len(h1), np.int64)
    back[order] = np.cumsum(new) - 1
    if not (h2 == h2[pick][back]).all():        # two pieces with one first hash: go by both
        _, pick, back = np.unique(np.stack((h1, h2)), axis=1, return_index=True, return_inverse=True)
    return pick, back


class Encoder:
    """A tokenizer whose splitter always cuts where a space follows other characters.

    Texts are cut there first, and the ids of each distinct piece are made once per
    worker, many in one call, and kept under two 64-bit hashes of the piece in sorted
    numpy tables.  Unusual texts (see ``_unusual``) are one piece each."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _forget(self) -> None:
        self.tables: list[np.ndarray] = []      # each: rows h1 (sorted), h2, place, length, times met again
        self.ids = np.zeros(0, self.dtype)

    def _age(self) -> None:
        """Forget the pieces that were not met again, and count anew."""
        every = np.concatenate(self.tables, axis=1)
        every = every[:, every[4] > 0]
        ids, size = self.ids, every[3].astype(np.int64)
        if 2 * every.shape[1] > MOST_PIECES or 16 * MOST_PIECES < size.sum():
            return self._forget()
        total = np.concatenate(([0], np.cumsum(size)))
        self.ids = ids[np.repeat(every[2].astype(np.int64) - total[:-1], size) + np.arange(total[-1])]
        every[2], every[4] = total[:-1].astype(np.uint64), 0
        self.tables = [every[:, np.argsort(every[0])]]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in made]

    def _learn(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces at bytes ``a`` to ``b``, and place and number of each one's ids among them.
        Pieces of one space and other characters are joined: in a joined text a piece begins
        at each id whose text begins with the space."""
        size, place = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        blanks = np.concatenate(([0], np.cumsum(data == 32)))
        joined = (b - a > 1) & (data[a] == 32) & (blanks[b] - blanks[a] == 1)
        made, held, left = [], 0, [np.flatnonzero(~joined)]
        joined = np.flatnonzero(joined)
        length = b[joined] - a[joined]
        end = np.concatenate(([0], np.cumsum(length)))
        body = data[np.arange(end[-1]) + np.repeat(a[joined] - end[:-1], length)].tobytes()
        for i in range(0, len(joined), GROUP):      # one at a time: the library's results are large
            group = joined[i:i + GROUP]
            ids = self._encode([body[end[i]:end[i + len(group)]].decode()])[0]
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(group) or at[0]:
                left.append(group)
                continue
            place[group], size[group] = at + held, np.diff(at, append=len(ids))
            made.append(ids)
            held += len(ids)
        for k in left:
            found = self._encode([data[i:j].tobytes().decode() for i, j in zip(a[k].tolist(), b[k].tolist(), strict=True)])
            size[k] = [len(x) for x in found]
            place[k] = held + np.cumsum(size[k]) - size[k]
            made += found
            held += int(size[k].sum())
        return np.concatenate(made) if made else np.zeros(0, self.dtype), place, size

    def _known(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place and length of every known piece; length -1 of others."""
        found = np.full((2, len(h1)), -1, np.int64)
        for t in self.tables:
            at = np.minimum(np.searchsorted(t[0], h1), t.shape[1] - 1)
            hit = (t[0][at] == h1) & (t[1][at] == h2)
            found[:, hit] = t[2:4, at[hit]].astype(np.int64)
            t[4, at[hit]] += np.uint64(1)
        return found

    def _keep(self, rows: np.ndarray) -> None:
        self.tables.append(rows)        # sorted, as the distinct pieces of a slice are
        if len(self.tables) > 6:        # few tables to search: merge all
            every = np.concatenate(self.tables, axis=1)
            self.tables = [every[:, np.argsort(every[0], kind="stable")]]

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their n+1 offsets."""
        if sum(t.shape[1] for t in self.tables) > MOST_PIECES or len(self.ids) > 16 * MOST_PIECES:
            self._age()
        data, doc_at = bytes_of(arr)
        space = data == 32
        odd = _unusual(data, doc_at, np.flatnonzero(space)) if len(data) else np.zeros(len(arr), bool)
        for i, j in zip(doc_at[:-1][odd].tolist(), doc_at[1:][odd].tolist(), strict=True):
            space[i:j] = False
        at = np.flatnonzero(space)
        filled = np.diff(doc_at) > 0
        first = doc_at[:-1][filled]
        # A piece is a text's beginning up to its first space, or a space and what follows.
        starts = np.sort(np.concatenate((first, at)), kind="stable")
        ends = np.sort(np.concatenate((at, doc_at[1:][filled])), kind="stable")
        n = np.zeros(len(arr), np.int64)
        n[filled] = 1 + np.diff(np.searchsorted(at, doc_at))[filled]
        h1 = span_hashes(data, starts, ends)
        h2 = span_hashes(data, starts, ends, second=True)
        pick, back = _distinct(h1, h2)
        found = self._known(h1[pick], h2[pick])
        new = np.flatnonzero(found[1] < 0)
        if len(new):
            a, b = starts[pick[new]], ends[pick[new]]
            made, found[0, new], found[1, new] = self._learn(data, a, b)
            found[0, new] += len(self.ids)
            self.ids = np.concatenate([self.ids, made])
            short = new[b - a <= MOST_BYTES]
            self._keep(np.stack((h1[pick[short]], h2[pick[short]], *found[:, short].astype(np.uint64),
                                 np.zeros(len(short), np.uint64))))
        size = found[1][back]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(found[0][back] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.concatenate(([0], np.cumsum(n)))]


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ``ids`` (raw little-endian integers, the end id last)."""
    def run(part):
        enc = Encoder.of(path)
        ids, at = enc.encode(part.column("text"))
        rows = np.arange(part.num_rows)
        out = np.full(len(ids) + len(rows), end_id, enc.dtype)
        out[np.arange(len(ids)) + np.repeat(rows, np.diff(at))] = ids
        where = ((at + np.arange(len(at))) * enc.dtype.itemsize).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(where), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], ["doc_id", "ids"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids binary",
                    most=1 << 20)


def id_counts(ids: DataFrame, dtype: np.dtype) -> list[tuple[int, int]]:
    """(id, count) of every id that occurs; at most as many rows as the vocabulary."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(bytes_of(batch.column("ids"))[0].view(dtype))
            if len(n) > len(total):
                n[:len(total)] += total
                total = n
            else:
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return [tuple(r) for r in ids.select("ids").mapInArrow(count, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect()]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[:len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    controls = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4)[None, :] < size[:, None]
    return controls.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(controls: bytes, data: bytes, n_tokens: np.ndarray) -> np.ndarray:
    """Ranks of all documents of a block, one after another."""
    lengths = _LENGTHS[np.frombuffer(controls, np.uint8)].ravel()
    slots = -(-n_tokens // 4) * 4                    # a document fills whole control bytes
    begin = np.cumsum(slots) - slots
    real = np.arange(int(slots.sum())) - np.repeat(begin, slots) < np.repeat(n_tokens, slots)
    size = lengths[real].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = size > k
        if longer.any():
            out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_file(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the documents' ids under ``path`` (blocks and ranks), ascending by doc_id."""
    spark = docs.sparkSession
    dtype = Encoder.of(tokenizer_path).dtype
    plain = f"{path}/plain"
    tokenise(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(plain)
    ids = spark.read.schema("doc_id long, ids binary").parquet(plain)
    counts = sorted(id_counts(ids, dtype), key=lambda x: (-x[1], x[0]))
    spark.createDataFrame([(r, i) for r, (i, _) in enumerate(counts)], "rank long, id long").coalesce(1) \
        .write.parquet(f"{path}/ranks")
    rank = np.zeros(1 + max((i for i, _ in counts), default=0), np.uint32)
    for r, (i, _) in enumerate(counts):
        rank[i] = r

    def pack(batches):
        names = ["block", "start_in_part", "doc_ids", "n_tokens", "controls", "data"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        block = start = in_block = 0
        held: list[tuple] = []

        def out():
            one = [[block], [start], [[x[0] for x in held]], [[x[1] for x in held]],
                   [b"".join(x[2] for x in held)], [b"".join(x[3] for x in held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds, strict=True)], names)

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                found = np.frombuffer(x.as_buffer(), dtype)
                held.append((doc, len(found), *encode_ranks(rank[found])))
                in_block += len(found)
                if in_block >= BLOCK_IDS:
                    yield out()
                    block, start, held, in_block = block + 1, start + in_block, [], 0
        if held:
            yield out()

    # The sample for the range bounds scans the saved ids; coding runs once, after the sort.
    ties = [F.octet_length("ids"), F.crc32("ids")]
    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), *ties) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), *ties, "ids")
    (ordered.mapInArrow(pack, "block long, start_in_part long, doc_ids array<long>, n_tokens array<long>, "
                              "controls binary, data binary")
     .withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/blocks"))


def read_token_file(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` (little-endian unsigned 32-bit) of every
    document; with ``digest`` only the ids' checksum, ``ids_crc32``."""
    blocks = spark.read.schema("block long, start_in_part long, doc_ids array<long>, n_tokens array<long>, "
                               "controls binary, data binary, part int").parquet(f"{path}/blocks")
    pairs = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").collect()   # at most the vocabulary
    table = np.zeros(len(pairs) + 1, "<u4")
    for r, i in pairs:
        table[r] = i
    sums = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()            # one row per file
    before, total = {}, 0
    for part, n in sums:
        before[part], total = total, total + n

    def decode(batches):
        for batch in batches:
            for b in batch.to_pylist():
                n = np.array(b["n_tokens"], np.int64)
                ids = table[decode_ranks(b["controls"], b["data"], n)]
                ends = np.cumsum(n)
                start = before[b["part"]] + b["start_in_part"] + ends - n
                made = [ids[e - k:e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                made = pa.array(map(zlib.crc32, made), pa.int64()) if digest else pa.array([x.tobytes() for x in made], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(start), pa.array(n), made],
                    ["doc_id", "start", "n_tokens", out])

    out, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    return blocks.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {out} {kind}")


def token_digest(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the file, read it back: doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    path = path or f"{working_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, tokenizer_path, path)
    return read_token_file(spark, path, digest=True)
