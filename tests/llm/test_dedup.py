"""Exact, line, near and substring dedup against plain versions."""

import hashlib
import re

import numpy as np
import pytest

from quire.llm import exact_dedup as E
from quire.llm.components import components
from quire.llm.line_dedup import drop_lines, line_dedup
from quire.llm.minhash import drop_near_copies, near_duplicates
from quire.llm.repeats import remove_repeats

from . import brute


@pytest.mark.parametrize("bits", [64, 4])
def test_exact(docs, corpus, bits):
    form = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in corpus:
        groups.setdefault(form(t), []).append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in E.exact_dedup(docs, fingerprint_bits=bits).collect()}
    for i, t in corpus:
        own = groups[form(t)]
        assert got[i] == (own[0], len(own), own[0] == i, hashlib.sha256(form(t).encode()).hexdigest())


def test_exact_odd(odd, empty):
    rows = sorted(map(tuple, E.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert rows == sorted([(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (2, 2, 2, True), (None, 2, 2, False), (None, None, 1, True)], key=str)
    assert E.exact_dedup(empty).count() == 0


def test_drop_copies(docs, corpus):
    assert E.drop_copies(docs).count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus})


@pytest.mark.parametrize("top", [0, 1])
def test_quotient_filters_merge_without_loss(top):
    r = np.random.default_rng(1)
    low = np.uint64(top << 63)
    parts = [low | (r.integers(0, 1 << 63, n, dtype=np.uint64) // np.uint64(7) % np.uint64(900) * np.uint64(1 << 50)) >> np.uint64(1) for n in (500, 3, 700, 1)]
    parts.append(np.full(5000, parts[0][0]))
    filters = [E.CountingQuotientFilter.of(p) for p in parts]
    merged = E._merged(E.CountingQuotientFilter.unpack(f.pack(prefix_bits=1)) for f in filters)
    again = E.CountingQuotientFilter.unpack(merged.pack())
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    for f in (merged, again):
        assert (f.fingerprints == values).all() and (f.counts == counts).all()


def test_quotient_filter_of_crowded_quotients():
    """Runs that shift each other, in all of the last slots too."""
    values = np.concatenate([np.arange(40, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(40, dtype=np.uint64)])
    f = E.CountingQuotientFilter.of(np.repeat(values, np.arange(80) % 3 + 1))
    g = E.CountingQuotientFilter.unpack(f.pack())
    assert (g.fingerprints == np.sort(values)).all() and g.counts.sum() == (np.arange(80) % 3 + 1).sum()


def test_lines(docs, corpus):
    expected = brute.lines(corpus)
    got = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert {i: r["kept_text"] for i, r in got.items()} == expected
    assert all(got[i]["n_lines"] == (t or "").count("\n") + 1 for i, t in corpus)
    assert sum(r["n_dropped"] for r in got.values()) == 4
    dropped = {r["doc_id"]: r for r in drop_lines(docs).collect()}
    assert drop_lines(docs).columns == docs.columns
    assert all((dropped[i]["text"] or "") == expected[i] and dropped[i]["n_chars"] == len(expected[i]) for i, _ in corpus)


def test_lines_odd(odd, empty):
    assert line_dedup(odd).count() == 6
    assert line_dedup(empty).count() == 0


def test_line_with_over_64_lines(spark):
    shared = [f"a shared line with the number {k} in it" for k in range(150)]
    rows = [(i, "\n".join(shared if i < 3 else shared[::2])) for i in range(4)]
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.lines(rows)


@pytest.mark.parametrize(("width", "block"), [(2, 50_000), (5, 50_000), (2, 200)])
def test_near(docs, corpus, width, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, width=width, family_block=block).collect()}
    assert got == brute.near(corpus, width)


def test_near_long_lists(docs, corpus, monkeypatch):
    from quire.llm import minhash

    monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == brute.near(corpus, 2)


@pytest.mark.parametrize("percent", [40, 60, 80, 95, 100])
def test_near_at_other_thresholds(spark, percent):
    """Pairs of all similarities, also far below and right at each threshold."""
    r = np.random.default_rng(percent)
    rows = []
    for k in range(120):
        words = [f"w{x}" for x in r.integers(0, 1 << 30, r.integers(40, 200))]
        other = [f"v{x}" if r.random() < k / 240 else w for x, w in enumerate(words)] + [f"u{x}" for x in range(r.integers(0, 9))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=percent).collect()}
    want = brute.near(rows, 1, percent)
    assert got == want and (percent == 100 or 2 < sum(i != c for i, (_, c) in want.items()) < 120)
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=0)


def test_near_odd(odd, empty):
    rows = sorted({tuple(r) for r in near_duplicates(odd).select("doc_id", "component_id", "kept").collect()}, key=str)
    assert (2, 1, False) in rows and (1, 1, True) in rows and (None, None, True) in rows
    assert near_duplicates(empty).count() == 0
    assert drop_near_copies(odd).where("doc_id = 1").count() == 2


def test_components(spark):
    pairs = [(k, k + 1) for k in range(10, 60)] + [(5, 99), (99, 7), (200, 200), (60, 10)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{k: 10 for k in range(10, 61)}, 5: 5, 7: 5, 99: 5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("length", "reach", "most"), [(200, 100, 50_000), (200, 100, 1), (50, 30, 50_000)])
def test_repeats(docs, corpus, length, reach, most):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs, length=length, reach=reach, most=most).collect()}
    assert got == brute.without_repeats(corpus, length)


def test_repeats_odd(odd, empty):
    rows = remove_repeats(odd).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, 0, 600, 600, 600]
    assert remove_repeats(empty).count() == 0


def test_repeats_across_pieces(spark, monkeypatch):
    from quire.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", 64)
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    rows = [(1, text), (2, "x" * 30 + text[100:700] + "y" * 40), (3, text[350:600])]
    data, offsets = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.array([0, 900, 1570, 1820])
    parts = list(repeats.samples(data, offsets, 200, 100))
    assert sum(int(p[3].sum()) for p in parts) == sum(len(t) - 199 for _, t in rows)
