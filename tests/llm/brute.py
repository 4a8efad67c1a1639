"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(runs)
    cover = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), dup, len(cover)


def log_ratio_scores(texts, target, cells, buckets):
    """Mean over each text's words and word pairs of log p_target - log p_raw, add-one smoothed, with
    ``cells(words)`` the cells of a text's words and of its pairs; ``target``: places of the target's texts."""
    held = [cells(WORD.findall(t or "")) for t in texts]
    raw, good = Counter(c for x in held for c in x), Counter(c for i in target for c in held[i])
    n_raw, n_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    value = {c: math.log((good[c] + 1) / n_good) - math.log((raw[c] + 1) / n_raw) for c in raw}
    return [sum(map(value.get, x)) / len(x) if x and good else 0.0 for x in held]


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def near(rows, size=4, percent=80):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows."""
    sets = {d: shingles(t, size) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def substring(rows, size=35):
    """[(n_words, n_removed, kept text)] of (doc_id, text) rows."""
    cut = [WORD.findall(t or "") for _, t in rows]
    often = Counter(tuple(w[i:i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for w in cut:
        gone = {j for i in range(len(w) - size + 1) if often[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(rows, items, size=10):
    """[(n_words, n_hit, sorted items)] of texts."""
    wins = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(x) for x in wins}
    out = []
    for text in rows:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (win := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[win]
        out.append((len(w), len(hit), sorted(found)))
    return out


def spread_lines(rows, min_sites):
    """Texts without lines that stand on ``min_sites`` sites; rows are (text, source)."""
    sites = defaultdict(set)
    for text, source in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                sites[line].add(source)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad) for t, _ in rows]


def spread_lines_over_classes(rows, min_sites, size=5):
    """Texts without the lines that stand on ``min_sites`` sites, counted over one row of each class
    of near copies among the rows that hold a line on so many sites; rows are (text, source).  Which
    row stands for its class is the library's choice: here its classes' sites must not matter."""
    def sites(some):
        out = defaultdict(set)
        for text, source in some:
            for line in (text or "").split("\n"):
                if WORD.search(line):
                    out[line].add(source)
        return {x for x, s in out.items() if len(s) >= min_sites}

    bad = sites(rows)
    holders = [i for i, (t, _) in enumerate(rows) if bad & set((t or "").split("\n"))]
    classes = near([(i, rows[i][0]) for i in holders], size)
    firsts = [rows[i] for i in holders if classes[i][1] == i]
    lasts = {classes[i][1]: rows[i] for i in holders}
    bad = sites(firsts)
    assert bad == sites(lasts.values()), "the choice of a class's row matters here"
    return [None if t is None else "\n".join(x for x in t.split("\n") if x not in bad) for t, _ in rows]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs(words, min_length=24, min_exponent=3):
    """[(start, length, period)] by start, then period: maximal stretches of smallest period q."""
    n, least = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in least.items())


def collapse(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score), null ids as None, of rows (doc_id, text) and (item_id, text)."""
    cut = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    cut = [(d, w) for d, w in cut if w]
    n_docs, total = len(cut), sum(len(w) for _, w in cut)
    df = Counter(t for _, w in cut for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER))) & set(weight)
        found = []
        for d, w in cut:
            m, count = 10 + 90 * len(w) * n_docs // total, Counter(w)
            score = sum(weight[t] * (10 ** 9 * count[t] // (1000 * count[t] + 8 * m)) for t in terms if t in count)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def targets(sizes, most=3, cycle=3):
    """{source: target} of {source: size}; sources in rank order, None last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % cycle for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - most * sum(sizes[s] for s in capped)
        level = {s: Fraction(weight[s] * left, sum(weight[x] for x in rest)) for s in rest}
        new = {s for s in rest if level[s] > most * sizes[s]}
        if not new:
            return {s: float(level[s]) if s in level else float(most * sizes[s]) for s in order}
        capped |= new
