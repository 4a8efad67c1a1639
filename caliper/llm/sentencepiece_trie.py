"""Operator 7, SentencePiece encoding and decoding over a shared-prefix trie.

A text is marked (each space becomes U+2581, one more in front) and cut into marked
words; no piece of the model crosses their ends, which is checked when it is loaded.
The distinct words of a slice are sorted, which is a depth-first walk of their trie: a
forward table along the current path keeps, for each prefix, the last piece of its best
segmentation, and a word reuses the table as far as it shares its prefix with the one
before.  What the table holds goes by the model's type, which its file states:

* unigram: forward scores (Viterbi).  A prefix's score is the greatest, over the pieces that
  may end it, of the piece's score and that of the prefix in front; of equal ones the
  longest piece wins.  A character without a piece scores ``UNKNOWN`` less than any piece.
* byte-pair merges, whose scores are only the order of merges: a piece may end a prefix if it
  is *compatible* with the last piece of the prefix in front, that is, if encoding the two
  together gives back the two.  One piece is; so the result equals the library's.

Other types are refused.  The pieces that may end a prefix are found by the longest ending of
it that begins a piece, and a list for each such ending.

Characters outside the vocabulary become byte pieces.  Decoding joins pieces, bytes
included, turns marks to spaces and drops the first.

The work is a map over slices; a worker remembers words it has seen, up to a bound.
Edge cases: null and empty texts have no ids and decode to an empty text; a U+2581 in
a text decodes to a space, as with the library; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import map_text

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LINE_WORD = re.compile(f"\n[^{MARK}\n]*|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Entries of a memory's generation: words of ``MOST_CHARS`` at most, and pairs.  When it is full it
#: becomes the old one, and what is asked for again moves on; a worker holds two generations of each.
MOST_WORDS, MOST_CHARS, MOST_PAIRS = 100_000, 64, 100_000
UNIGRAM, MERGES = 1, 2
UNKNOWN = 10.0
_models: dict[str, Model] = {}


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message: ints, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, raw[at:at + size]
            at += size


def model_type(raw: bytes) -> int:
    """The type that a model file states: field 3 of its trainer's settings, field 2 (unigram if it is silent)."""
    kind = UNIGRAM
    for number, value in _fields(raw):
        if number == 2:
            kind = dict(_fields(value)).get(3, kind)
    return kind


class Model:
    """Pieces and scores of a model file, with the forward table of the current path."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.kind = model_type(raw)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and byte-pair models can be walked")
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded = [b""] * sp.vocab_size()
        for piece, i in self.ids.items():
            self.decoded[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            if sp.is_byte(i):
                self.decoded[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model crosses marked words")
        # Place of each merged piece among the merges; pieces with one score have no such order.
        count = Counter(self.scores.values())
        merged = sorted((p for p in self.scores if len(p) > 1), key=lambda p: -self.scores[p])
        self.order = {p: k for k, p in enumerate(merged)}
        self.tied = {p for p in merged if count[self.scores[p]] > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.ends: dict[str, tuple[str, ...]] = {}
        self.lines = not any("\n" in p for p in self.ids if len(p) > 1)     # no piece goes on after a line's end
        self.fits: dict[str, dict[str, bool]] = {}          # by left piece, then right piece
        self.old_fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge the best-scored neighbours, the leftmost if they tie; the same list if none makes a piece."""
        best = max(((self.scores[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
                    if a + b in self.scores), default=None)
        if best is None:
            return symbols
        k = -best[1]
        return [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2:]]

    def _merged(self, symbols: list[str]) -> list[str]:
        while (after := self._merge(symbols)) is not symbols:
            symbols = after
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        row = self.fits.setdefault(left, {})
        if (known := row.get(right)) is None:
            if (known := self.old_fits.get(left, row).get(right)) is None:
                known = self._stands(left, right)
            row[right] = known
            self.n_fits += 1
        return known

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two symbols that the last merge of a piece joins."""
        if (made := self.halves.get(piece)) is None:
            symbols = [*piece]
            while len(symbols) > 2:
                symbols = self._merge(symbols)
            made = self.halves[piece] = (symbols[0], symbols[1])
        return made

    def _stands(self, left: str, right: str) -> bool:
        """Does no merge join the inner ends of two pieces before both are whole?

        Merges are undone from the latest on, on the side where it is; a joint piece that
        would have been made before the merge just undone breaks the pair.  Of merges of
        one rank the left one comes first."""
        order = self.order
        if left in self.tied or right in self.tied:
            return self._merged([*left, *right]) == [left, right]
        limit = len(order) + 2.0
        while True:
            joint = order.get(left + right)
            if joint is not None and joint < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a > b:
                limit, left = a, self._halves(left)[1]
            elif b >= 0:
                limit, right = b + 1, self._halves(right)[0]
            else:
                return True

    def _pieces(self, ending: str) -> tuple[str, ...]:
        """The pieces that end a stretch which begins a piece, longest first; its last character is one."""
        found = [ending[k:] for k in range(len(ending) - 1) if ending[k:] in self.ids]
        self.ends[ending] = made = (*found, ending[-1])
        if len(self.ends) > MOST_PAIRS:     # beginnings of pieces, and single characters without one
            self.ends = {ending: made}
        return made

    def segment(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each of the sorted distinct words."""
        out, last, reach, best, before = {}, [""], [0], [0.0], ""
        rows: list[dict[str, bool]] = [{}]          # what is known of each last piece's right neighbours
        starts, fits, scores, merges = self.starts, self.fits, self.scores, self.kind == MERGES
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], reach[shared + 1:], best[shared + 1:], rows[shared + 1:]
            for i in range(shared + 1, len(word) + 1):
                k = reach[-1] + 1
                ending = word[i - k:i]
                while k > 1 and ending not in starts:       # the longest ending that may begin a piece
                    k -= 1
                    ending = ending[1:]
                reach.append(k)
                found = self.ends.get(ending) or self._pieces(ending)
                if merges:
                    for piece in found:
                        at = i - len(piece)
                        if not at or (known := rows[at].get(piece)) or known is None and self.compatible(last[at], piece):
                            last.append(piece)
                            rows.append(fits.setdefault(piece, {}))
                            break
                    else:
                        raise AssertionError(f"no piece ends {word[:i]!r}")
                else:
                    top = None
                    for piece in found:
                        score = best[i - len(piece)] + scores.get(piece, self.unknown)
                        if top is None or score > top:
                            top, choice = score, piece
                    best.append(top)
                    last.append(choice)
            pieces, i = [], len(word)
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            out[word] = pieces[::-1]
            before = word
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        found = [self.ids.get(p, -1) for p in pieces]
        if -1 not in found:
            return found
        return [i for p, k in zip(pieces, found, strict=True) for i in ([k] if k >= 0 else [self.byte_ids[b] for b in p.encode()])]

    def _cut(self, text: str) -> list[str]:
        """The words of a text, cut before each line's end too if pieces are: those with one mark in
        front stand without it, those with a line's end in front with that."""
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            found = (_LINE_WORD if self.lines else _WORD).findall(MARK + text.replace(" ", MARK))
            return [w[1:] if w[0] == MARK and MARK not in w[1:] else w for w in found]
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    def _marked(self, word: str) -> str:
        return word if word[:1] == MARK or self.lines and word[:1] == "\n" else MARK + word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > MOST_WORDS:
            self.words, self.old_words = {}, self.words
        if self.n_fits > MOST_PAIRS:
            self.fits, self.old_fits, self.n_fits = {}, self.fits, 0
        words, old = self.words, self.old_words
        cut = [self._cut(t) if t else [] for t in texts]
        new = [w for w in set().union(*cut) if w not in words]
        found = {w: old[w] for w in new if w in old}
        marked = {self._marked(w): w for w in new if w not in found}
        for word, pieces in self.segment(sorted(marked)).items():
            found[marked[word]] = array("i", self.piece_ids(pieces)).tobytes()
        short = {w: x for w, x in found.items() if len(w) <= MOST_CHARS}
        words.update(short)
        if len(short) == len(found):
            found = words
        else:
            found = {**{w: words[w] for w in set().union(*cut) if w in words}, **found}
        return [np.frombuffer(b"".join([found[w] for w in ws]), np.int32) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text and ``ids`` (array<int>)."""
    def run(part):
        found = Model.of(model_path).encode(part.column("text").to_pylist())
        at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], ["doc_id", "text", "ids"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ``ids``."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        model = Model.of(model_path)
        for batch in batches:
            ids = batch.column("ids")
            texts = [model.decode(np.asarray(x.values)) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256, exact (does
    decoding give the text back).  One map does both ways, so a task needs one worker."""
    def run(part):
        model = Model.of(model_path)
        texts = [t or "" for t in part.column("text").to_pylist()]
        ids = model.encode(texts)
        back = [model.decode(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
             pa.array([_sha(",".join(map(str, x.tolist()))) for x in ids], pa.string()),
             pa.array([_sha(x) for x in back], pa.string()),
             pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
