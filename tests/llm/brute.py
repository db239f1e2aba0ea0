"""Plain versions of the operators, row by row, for small fixtures."""

import collections
import re

WHITE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return x.translate({c: c + 32 for c in range(65, 91)})


def near(rows, width, percent=80):
    """{id: (set size, component)} by comparing all sets that share a shingle."""
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[a : a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(rows, length):
    """{id: (bytes, removed, spans, kept)}"""
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), kept
    return out


def lines(rows, min_chars=20, min_docs=3):
    """{id: kept text}"""
    holders = collections.defaultdict(set)
    key = lambda x: lower(x.strip(WHITE))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    lost = lambda i, x: len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i
    return {i: "\n".join(x for x in (t or "").split("\n") if not lost(i, x)) for i, t in rows}


def measures(t):
    """(words, word characters, symbols, duplicate lines, words in repeated windows)"""
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    filled = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), len(covered)
