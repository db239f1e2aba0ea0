"""Periodic runs against comparing all words at all distances."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import periodic_runs as P
from quire.llm.queries import op11_periodic_runs

from . import brute


def plain_runs(w, least, exponent):
    """{(start, length, period)} by comparing all words at all distances; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            n = 0
            while i + n + q < len(w) and w[i + n] == w[i + n + q]:
                n += 1
            if n and n + q >= max(least, exponent * q):
                found.setdefault((i, n + q), q)
            i += n + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 12), st.integers(2, 4))
def test_runs_of_few_letters(w, least, exponent):
    assert P.runs_of(w, least, exponent) == plain_runs(w, least, exponent)
    assert P.text_runs([b"%d" % x for x in w], least, exponent) == plain_runs(w, least, exponent)


@pytest.mark.parametrize("seed", range(12))
def test_runs_within_runs(seed):
    """Loops of loops, of all lengths, with breaks, and prose between them."""
    r = random.Random(seed)
    w = []
    for _ in range(6):
        part = [r.randrange(4) for _ in range(r.randint(1, 9))]
        for _ in range(r.randint(1, 3)):
            part = part * r.randint(1, 5) + [r.randrange(4) for _ in range(r.randint(0, 3))]
        w += part[:400] + [r.randrange(1000) for _ in range(r.randint(0, 40))]
    assert P.text_runs([b"w%d" % x for x in w]) == P.runs_of(w) == plain_runs(w, 24, 3)


def test_long_runs():
    """Loops longer than what is compared word by word, at distances that are and that aren't reused."""
    for p in (1, 2, 30, 1500):
        loop = [k * k % 1009 for k in range(p)]
        w = [2000] + (loop * (6000 // p + 4))[: 6000 + p // 2] + [2001]
        assert P.runs_of(w) == [(1, 6000 + p // 2, p)]


def test_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "PRIME", 7)
    r = random.Random(1)
    w = [r.randrange(2) for _ in range(300)] + [0, 1, 1] * 20 + [r.randrange(2) for _ in range(300)] + [1] * 40
    assert P.runs_of(w) == plain_runs(w, 24, 3)


def test_periodic_runs(docs, corpus):
    got = {r["doc_id"]: r for r in P.periodic_runs(docs, least=6, exponent=2).collect()}
    assert got.keys() == {i for i, _ in corpus} and docs.columns + ["runs", "collapsed"] == P.periodic_runs(docs).columns
    for i, t in corpus:
        w = brute.WORD.findall(t or "")
        if len(w) > 5000:  # one line again and again
            assert [tuple(x) for x in got[i]["runs"]] == [(0, len(w), 6)] and got[i]["collapsed"] == " ".join(w[:6])
            continue
        runs = plain_runs(w, 6, 2)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [tuple(x) for x in got[i]["runs"]] == runs
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_odd(odd, empty, spark):
    rows = P.periodic_runs(odd).collect()
    assert len(rows) == 6 and sorted(len(r["runs"]) for r in rows) == [0, 0, 0, 1, 1, 1]
    assert P.periodic_runs(empty).count() == 0
    clash = spark.createDataFrame([(1, "a " * 30, "x", 5)], "doc_id long, text string, runs string, collapsed int")
    assert [tuple(x) for x in P.periodic_runs(clash).first()["runs"]] == [(0, 30, 1)]
    with pytest.raises(ValueError):
        P.periodic_runs(odd, exponent=1)


def test_query(spark, tmp_path):
    """The whole query, loops put in by the contract's rule, against plain Python."""
    r = random.Random(9)
    rows = [(i, None if i == 7 else " ".join(r.choice("abcdefgh") * 2 for _ in range(r.choice((0, 1, 30, 200))))) for i in range(150)] + [(None, "a\tb " * 20), (4_000_000_000, "q \n" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for i, t in rows:
        w = brute.WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, looped = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)], looped + 1
        runs = plain_runs(w, 24, 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert looped > 5
