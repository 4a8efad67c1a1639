"""Operator 6, LM scoring by masked pseudo-likelihood.

A window network, trained in numpy, predicts every word of a text from the words on both
sides: embeddings of ``SIDE`` words to the left and right, one tanh layer, and a softmax
in two steps (the word's class, then the word within its class).  A document's score is
the sum of the log probabilities of its words, each given its neighbours.

Vocabulary: the ``TOP`` most frequent words of the corpus, and hash cells for all others.
Word counts cover all documents; they also start the output biases, so that the network
begins as the corpus's unigram model.  A word of a cell is scored as its cell times the
word's own share of it, by the counts of all words of the corpus, a table that grows with
the corpus: the shares of its most frequent words, ``MOST_BROADCAST_WORDS`` at most, are broadcast.
Words below that count leave the scoring map as (document, word, occurrences) and are joined by
word hash; no such word is frequent, so the join has no hot key.

Training is data-parallel over all partitions: each trains from the same weights on one
of every ``STRIDE`` positions of each of its texts, another one each round, so that the
rounds together visit every position once, and the weights are averaged by the number
of positions.  Averages are made in two shuffles of
weight chunks, salted in the first, and summed as they stream in; the driver only holds
one set of weights (0.8 MB, whatever the corpus).  Scoring is one map.

Edge cases: null and empty texts have no words and score 0.0; a null doc_id is kept and
trains like any other; an empty table gives an empty result; repeated rows are scored
alike; a word that the counts lack has half an occurrence in its cell; other columns are
ignored.  A rerun on the same files gives the same weights up
to the order in which floats are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import bounded_batches, map_text, saved, slices
from caliper.llm.textnp import Words, mix

TOP = 3072
CLASSES, MEMBERS = 64, 64                   # classes x members words in the vocabulary
SIDE, WIDTH, HIDDEN = 2, 16, 32
STRIDE, ROUNDS, BATCH, RATE, FLOOR = 2, 2, 2048, 0.1, 1e-5
TRAIN_BYTES = 8 << 20                       # of an Arrow batch in training: steps end with it, so weights depend on it
CHUNK = 8192                                # weights in one row of the averaging shuffle
SALTS = 64
#: Up to so many words outside the top (16 bytes each) are broadcast with their shares; the others are joined.
MOST_BROADCAST_WORDS = 1_000_000
#: Counts of words from here on are one step of the histogram that finds what is broadcast.
MOST_COUNT = 10_000
_U = np.uint64
_V = CLASSES * MEMBERS
_SHAPES = {"emb": (_V + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES),
           "cb": (CLASSES,), "m": (CLASSES, HIDDEN, MEMBERS), "mb": (CLASSES, MEMBERS)}


def word_ids(hashes: np.ndarray, top: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of words: the frequency rank of a top word, else a hash cell above TOP."""
    out = np.full(len(hashes), -1, np.int64)
    if len(top):
        first = top >> _U(48)                           # ``top`` is sorted, so words that share their first bits stand together
        begin = np.minimum(np.searchsorted(first, np.arange(1 << 16, dtype=np.uint64)), len(top) - 1)
        at = begin.take((hashes >> _U(48)).astype(np.uint16))
        for k in range(int(np.bincount(first.astype(np.int64)).max())):
            if k:
                at = np.minimum(at + 1, len(top) - 1)
            np.copyto(out, order.take(at), where=top.take(at) == hashes)
    rare = np.flatnonzero(out < 0)
    out[rare] = TOP + (mix(hashes[rare] ^ _U(99)) % _U(_V - TOP)).astype(np.int64)
    return out


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Sorted hashes of the top words, their ranks, the count of every id, and (h, n) of all words."""
    def count(part):
        h, n = np.unique(Words(part.column("text")).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = map_text(docs.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    best = counts.orderBy(F.desc("n"), "h").limit(TOP).collect()         # at most TOP rows
    top = np.array([h for h, _ in best], np.int64).view(np.uint64)
    order = np.argsort(top)
    top, rank = top[order], np.arange(len(top))[order]

    def spread(batches):
        total = np.zeros(_V, np.int64)
        for b in batches:
            ids = word_ids(np.asarray(b.column("h")).view(np.uint64), top, rank)
            np.add.at(total, ids, np.asarray(b.column("n")))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    n = np.zeros(_V, np.int64)
    for i, k in counts.mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n")).collect():    # at most _V rows
        n[i] = k
    return top, rank, n, counts


def shares(vocab) -> DataFrame:
    """(h, n, s) of every word outside the top: its count, and the log of its share of its cell."""
    top, rank, n, counts = vocab

    def run(batches):
        for b in batches:
            h = np.asarray(b.column("h")).view(np.uint64)
            ids = word_ids(h, top, rank)
            rare = ids >= TOP
            own = np.asarray(b.column("n"))[rare]
            s = np.log(own) - np.log(n[ids[rare]])
            yield pa.RecordBatch.from_arrays([pa.array(h[rare].view(np.int64)), pa.array(own), pa.array(s, pa.float64())], ["h", "n", "s"])

    return counts.mapInArrow(run, "h long, n long, s double")


def least_broadcast(rare: DataFrame) -> int:
    """The least count such that at most ``MOST_BROADCAST_WORDS`` words have it or more."""
    steps = rare.groupBy(F.least("n", F.lit(MOST_COUNT)).alias("n")).count().collect()      # MOST_COUNT rows at most
    held, least = 0, 1 << 62
    for n, words in sorted(map(tuple, steps), reverse=True):
        held += words
        if held > MOST_BROADCAST_WORDS:
            return least
        least = n
    return 1


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of an untrained network: the unigram model of ``counts``."""
    rng = np.random.Generator(np.random.PCG64(6))
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
    net["c"] *= 0.1
    net["m"] *= 0.1
    net["b"][:] = 0
    by = (counts + 0.5).reshape(CLASSES, MEMBERS)
    net["cb"] = np.log(by.sum(1) / by.sum()).astype(np.float32)
    net["mb"] = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
    return net


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        size = int(np.prod(s))
        out[k] = x[at:at + size].reshape(s).astype(np.float32)
        at += size
    return out


def contexts(ids: np.ndarray, word_at: np.ndarray, pick: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Ids of the neighbours of every word, or of those at ``pick``; ``_V`` stands beyond the ends of a text."""
    n_docs = len(word_at) - 1
    at = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(n_docs), np.diff(word_at)))
    padded = np.full(len(ids) + SIDE * (n_docs + 1), _V, np.int64)     # SIDE blanks before, between and after the texts
    padded[at] = ids
    at = at[pick]
    out = np.empty((len(at), 2 * SIDE), np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, k] = padded[at + step]
    return out


def _log_chosen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log of the softmax of every column at its ``y``: numpy is slow along short rows."""
    x -= x.max(axis=0)
    chosen = x[y, np.arange(len(y))]
    return chosen - np.log(np.exp(x, out=x).sum(axis=0))


def _softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of every column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order in which words of a class stand together, and (class, begin, end) of each there."""
    group = (y // MEMBERS).astype(np.uint16)            # numpy sorts short integers by counting
    ends = np.cumsum(np.bincount(group, minlength=CLASSES)).tolist()
    spans = [(c, i, j) for c, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i < j]
    return np.argsort(group, kind="stable"), spans


def _place(room: dict[str, np.ndarray], key: str, *shape: int) -> np.ndarray:
    """An array to be filled, in memory that the batches of a task share: new pages cost as much as much of the sums."""
    size = int(np.prod(shape))
    if key not in room or len(room[key]) < size:
        room[key] = np.empty(size, np.float32)
    return room[key][:size].reshape(shape)


def _hidden(net: dict[str, np.ndarray], x: np.ndarray, room: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of the neighbours, and the hidden layer."""
    e = _place(room, "e", x.size, WIDTH)
    e = net["emb"].take(x.ravel(), axis=0, out=e, mode="clip").reshape(len(x), -1)     # other modes copy
    h = np.matmul(e, net["w"], out=_place(room, "h", len(x), HIDDEN))
    h += net["b"]
    return e, np.tanh(h, out=h)


def _classes(net: dict[str, np.ndarray], h: np.ndarray, room: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of the classes, a column for each word."""
    out = np.matmul(net["c"].T, h.T, out=_place(room, "c", CLASSES, len(h)))
    out += net["cb"][:, None]
    return out


def _members(net: dict[str, np.ndarray], h: np.ndarray, spans: list[tuple[int, int, int]], room: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of the members of each word's own class, a column for each word."""
    out = _place(room, "m", MEMBERS, len(h))
    for c, i, j in spans:
        own = out[:, i:j]
        np.matmul(net["m"][c].T, h[i:j].T, out=own)
        own += net["mb"][c][:, None]
    return out


def log_probs(net: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray, most: int = 1 << 16, step: int = 1 << 11) -> np.ndarray:
    """log p(word | both sides) of every word.

    Words are put in order by class ``most`` at a time and scored ``step`` at a time, so that few classes meet in a step."""
    out, room = np.zeros(len(ids)), {}
    for a in range(0, len(ids), most):
        order = np.argsort((ids[a:a + most] // MEMBERS).astype(np.uint16), kind="stable") + a
        for b in range(0, len(order), step):
            at = order[b:b + step]
            y = ids.take(at)
            h = _hidden(net, around.take(at, axis=0), room)[1]
            got = _log_chosen(_classes(net, h, room), y // MEMBERS).astype(np.float64)
            got += _log_chosen(_members(net, h, _by_class(y)[1], room), y % MEMBERS)
            out[at] = got
    return out


def _sums(grad: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``ids`` in order, and for each the sum of its columns of ``grad`` (neighbour, width, word)."""
    rows = np.flatnonzero(np.bincount(ids))
    place = np.zeros(_V + 1, np.int64)
    place[rows] = np.arange(len(rows))
    ids = place[ids]
    out = np.empty((len(rows), grad.shape[1]), np.float32)
    for d in range(grad.shape[1]):
        out[:, d] = np.bincount(ids, grad[:, d].ravel())
    return rows, out


def train_step(net: dict[str, np.ndarray], seen: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray,
               room: dict[str, np.ndarray] | None = None) -> None:
    """One Adagrad step on a batch, in place; ``seen`` holds the sums of squares, ``room`` memory for other batches to use again."""
    room = {} if room is None else room
    order, spans = _by_class(y)                                # words of a class stand together
    y, x = y[order], x[order]
    n, every = len(y), np.arange(len(y))
    e, h = _hidden(net, x, room)
    dc = _softmax(_classes(net, h, room))
    dc[y // MEMBERS, every] -= 1
    dh = np.matmul(dc.T, net["c"].T, out=_place(room, "dh", n, HIDDEN))
    dm = _softmax(_members(net, h, spans, room))
    dm[y % MEMBERS, every] -= 1
    gm = _place(room, "gm", len(spans), HIDDEN, MEMBERS)
    for k, (c, i, j) in enumerate(spans):
        dh[i:j] += dm[:, i:j].T @ net["m"][c].T
        np.matmul(h[i:j].T, dm[:, i:j].T, out=gm[k])
    gc = h.T @ dc.T
    dh *= 1 - np.multiply(h, h, out=h)
    near = np.matmul(net["w"], dh.T, out=_place(room, "near", 2 * SIDE * WIDTH, n))
    rows, de = _sums(near.reshape(-1, WIDTH, n), x.T.ravel())

    def move(key, grad, rows=slice(None)):
        grad /= np.float32(n)
        step = np.multiply(grad, grad, out=_place(room, "step", *grad.shape))
        total = seen[key][rows]
        total += step
        np.sqrt(total, out=step)
        np.divide(np.multiply(grad, np.float32(RATE), out=grad), step, out=step)
        if isinstance(rows, slice):
            net[key] -= step
        else:
            seen[key][rows] = total
            net[key][rows] -= step

    classes = slice(None) if len(spans) == CLASSES else [c for c, _, _ in spans]
    move("c", gc)
    move("cb", dc.sum(1))
    move("m", gm, classes)
    move("mb", np.ascontiguousarray(np.add.reduceat(dm, [i for _, i, _ in spans], axis=1).T), classes)
    move("w", e.T @ dh)
    move("b", dh.sum(0))
    move("emb", de, rows)


def _train_round(docs: DataFrame, net: np.ndarray, top, rank, turn: int, stride: int) -> np.ndarray | None:
    """Average weights after every partition has trained on its share of positions."""
    size = len(net)

    def train(batches):
        own, seen, n, room = unflat(net), {k: np.full(s, FLOOR, np.float32) for k, s in _SHAPES.items()}, 0, {}
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                ids = word_ids(h, top, rank)
                place = np.arange(len(ids)) - np.repeat(w.word_at[:-1], w.n_words)
                pick = np.flatnonzero((place + (h % _U(5)).astype(np.int64)) % stride == turn * 7 % stride)
                around = contexts(ids, w.word_at, pick)
                mixed = np.argsort(mix(pick.astype(np.uint64) + _U(turn)))
                for a in range(0, len(pick), BATCH):
                    rows = mixed[a:a + BATCH]
                    train_step(own, seen, ids[pick[rows]], around[rows], room)
                n += len(pick)
        if n:
            x = flat(own) * np.float32(n)
            made = [x[a:a + CHUNK].astype("<f4").tobytes() for a in range(0, size, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(made)) * CHUNK), pa.array(np.full(len(made), n, np.int64)), pa.array(made, pa.binary())],
                ["chunk", "n", "x"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for c, n, x in zip(*(batch.column(k).to_pylist() for k in ("chunk", "n", "x")), strict=True):
                have = sums.setdefault(c, [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(x, "<f4").astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()),
                 pa.array([v[1].astype("<f4").tobytes() for v in sums.values()], pa.binary())], ["chunk", "n", "x"])

    kind = "chunk long, n long, x binary"
    bounded_batches(docs.sparkSession, TRAIN_BYTES)
    part = docs.select("text").mapInArrow(train, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    part = part.repartition("chunk", "salt").select("chunk", "n", "x").mapInArrow(add, kind)
    rows = part.repartition("chunk").mapInArrow(add, kind).collect()      # one set of weights
    if not rows:
        return None
    out = np.zeros(size)
    for c, n, x in rows:
        got = np.frombuffer(x, "<f4").astype(np.float64) / n
        out[c:c + len(got)] = got
    return out.astype(np.float32)


def fit(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, vocab=None):
    """(weights, top, rank) of a network trained on ``docs``."""
    top, rank, counts, _ = vocab or vocabulary(docs)
    net = flat(start(counts))
    for turn in range(rounds):
        new = _train_round(docs, net, top, rank, turn, stride)
        net = net if new is None else new
    return net, top, rank


def _unseen(n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.log(0.5) - np.log(n[ids] + 0.5)


def _tail(w: Words, h: np.ndarray, ids: np.ndarray, pick: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per text, the distinct ones of the words ``pick``: hash, occurrences, share if no count has it."""
    doc = w.doc_of_word()[pick]
    order = np.lexsort((h[pick], doc))
    pick, doc = pick[order], doc[order]
    new = np.ones(len(pick), bool)
    new[1:] = (h[pick][1:] != h[pick][:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    c = np.diff(np.append(at, len(pick)))
    rows = pa.StructArray.from_arrays([pa.array(h[pick[at]].view(np.int64)), pa.array(c.astype(np.int64)),
                                       pa.array(_unseen(n, ids[pick[at]]), pa.float64())], ["h", "c", "u"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(w.n + 1)).astype(np.int32)), rows)


def score(docs: DataFrame, model, vocab=None) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and mean_log_prob of every document; a rare
    word counts as itself if the ``vocab`` of the model is given, else as its cell."""
    weights, top, rank = model
    known, least, n = None, 1, None
    if vocab is not None:
        n, rare = vocab[2], saved(shares(vocab))
        least = least_broadcast(rare)
        got = rare.where(F.col("n") >= least).select("h", "s").toArrow()        # at most MOST_BROADCAST_WORDS rows
        order = np.argsort(got.column("h").to_numpy())
        known = docs.sparkSession.sparkContext.broadcast(
            (got.column("h").to_numpy()[order], got.column("s").to_numpy()[order]))

    def run(part):
        net = unflat(weights)
        w = Words(part.column("text"))
        h = w.hashes()
        ids = word_ids(h, top, rank)
        got = log_probs(net, ids, contexts(ids, w.word_at))
        missed = np.zeros(0, np.int64)
        if known is not None:
            pick = np.flatnonzero(ids >= TOP)
            words, logs = known.value
            own, s, there = h[pick].view(np.int64), np.zeros(len(pick)), np.zeros(len(pick), bool)
            if len(words):
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                there = words[at] == own
                s[there] = logs[at[there]]
            if least > 1:
                missed = pick[~there]
            else:
                s[~there] = _unseen(n, ids[pick[~there]])
            got[pick] += s
        sums = np.array([got[a:b].sum() for a, b in zip(w.word_at[:-1], w.word_at[1:], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.n_words.astype(np.int64)), pa.array(sums, pa.float64()),
             _tail(w, h, ids, missed, n if n is not None else np.zeros(_V))], ["doc_id", "n_tokens", "log_prob", "tail"])

    out = map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                   "doc_id long, n_tokens long, log_prob double, tail array<struct<h:long,c:long,u:double>>")
    if least > 1:
        out = saved(out.withColumn("place", F.monotonically_increasing_id()))
        tail = out.select("place", F.inline("tail")).join(rare.where(F.col("n") < least).select("h", "s"), "h", "left")
        extra = tail.groupBy("place").agg(F.sum(F.col("c") * F.coalesce("s", "u")).alias("extra"))
        out = out.drop("tail").join(extra, "place", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("extra", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0)
    return out.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def masked_lm(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    vocab = vocabulary(docs)
    return score(docs, fit(docs, rounds, vocab=vocab), vocab)
