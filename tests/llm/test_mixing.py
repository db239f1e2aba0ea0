"""The mix against plain targets, the conditions of the optimum, and itself."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as M
from quire.llm.queries import op12_source_mixing

from . import brute


def plain_targets(own, weights, most):
    """{source: target} by sharing out again what is above the caps until nothing is."""
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, total = {}, sum(own.values())
    while True:
        rest, share = total - sum(fixed.values()), sum(w[s] for s in order if s not in fixed)
        now = {s: fixed[s] if s in fixed else rest * w[s] / share for s in order}
        over = [s for s in order if s not in fixed and now[s] > most * own[s]]
        if not over:
            return now
        fixed |= {s: most * own[s] for s in over}


def corpus_of(seed, sources):
    r = random.Random(seed)
    rows = []
    for source, n, longest in sources:
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * min(longest, int(r.paretovariate(1)))) if r.random() > 0.02 else None, source))
    r.shuffle(rows)
    return rows


CASES = {
    "many": [("s1", 900, 3000), ("s10", 60, 400), ("s2", 90, 50), (None, 300, 900), ("퟿", 40, 9), ("\U0001f600", 30, 9), ("Z", 5, 20)],
    "one": [("x", 100, 100)],
    "small first": [("a", 3, 5), ("b", 2000, 500), ("c", 2, 3)],
    "copies": [("a", 1500, 1), ("b", 700, 30)],
}


@pytest.mark.parametrize("name", CASES)
def test_mix(spark, name):
    rows = corpus_of(3, CASES[name])
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {x["doc_id"]: x for x in M.mix(table).collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _ in rows}
    own, taken, rates = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, _, s in rows:
        own[s] += size[i]
        taken[s] += size[i] * got[i]["copies"]
        rates[s].add((size[i], got[i]["rate"]))
        assert got[i]["size"] == size[i] and 0 <= got[i]["copies"] <= 3
    want = plain_targets(own, (5, 2, 1), 3)
    for i, _, s in rows:
        assert got[i]["source_size"] == own[s] and got[i]["target"] == pytest.approx(want[s], rel=1e-12)
    for s in own:
        least = min((size[i] for i, _, x in rows if x == s and size[i]), default=0)
        assert abs(taken[s] - want[s]) <= least / 2 + 1e-6 * want[s] + 1, s
        # the optimum: one lambda a source tells all rates but those at the cap, which would lie above it
        inner = [(n, r) for n, r in rates[s] if n and 1e-3 < r < 2.999999]
        if inner:
            n, r = max(inner)
            tilt = math.log(r) / n
            for n, r in rates[s]:
                assert r == pytest.approx(min(3, math.exp(tilt * n)), rel=1e-5, abs=2e-9)
            assert sum(size[i] * got[i]["rate"] for i, _, x in rows if x == s) == pytest.approx(want[s], rel=1e-5)


def test_reruns_agree(spark):
    rows = corpus_of(5, CASES["many"])
    mixed = lambda n: sorted(map(tuple, M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()))
    assert mixed(1) == mixed(6)


def test_odd(spark, odd, empty):
    assert M.mix(empty).count() == 0
    rows = M.mix(odd.withColumn("source", F.lit(None).cast("string")).withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))).collect()
    assert len(rows) == 6 and {x["copies"] for x in rows} == {1}  # one source: all of it once
    blank = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b"), (3, "", None)], "doc_id long, text string, source string")).collect()
    assert [(x["size"], x["source_size"], x["target"]) for x in blank] == [(0, 0, 0.0)] * 3
    long = M.mix(spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "a"), (3, "w " * 5, "b")], "doc_id long, text string, source string")).collect()
    assert {x["doc_id"]: x["copies"] for x in long}[3] == 3
    with pytest.raises(ValueError):
        M.mix(odd, weights=())


def test_query(spark):
    rows = op12_source_mixing(spark, "/root/testdata/sf0.001").collect()
    by = collections.defaultdict(list)
    for x in rows:
        by[x["source_size"], x["target"]].append(x)
        assert x["taken"] <= 3 * x["size"]
    for (_, target), found in by.items():
        assert abs(sum(x["taken"] for x in found) - target) <= 0.01 * target + min(x["size"] for x in found)
