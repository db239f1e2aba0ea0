"""Mended conversations against trying all edits, and against a plain dynamic programme over audit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import repair_turns as R
from quire.llm.queries import op13_conversation_repair

WHITE = " \t\n\x0b\f\r"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(turns):
    """Per (role, text) in order: blank, duplicate, truncated or none."""
    out, seen = [], set()
    for role, text in turns:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(turns):
    """(cost, audit) by trying every edit of each turn with up to two insertions anywhere."""
    wrong, best = faults(turns), None
    runs = ["", *("".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n))]
    choices = []
    for (role, _), fault in zip(turns, wrong, strict=True):
        stays = 5 if fault == "truncated" else 0
        own = [("D", "", 2)]
        if fault not in ("blank", "duplicate"):
            own += [("K", role[:1] or "?", stays), ("R", "u", 1 + stays), ("R", "a", 1 + stays)]
        choices.append([("I" * len(r) + e, r + x, 5 * len(r) + c) for r in runs for e, x, c in own])
    choices.append([("I" * len(r), r, 5 * len(r)) for r in runs])
    for way in itertools.product(*choices):
        if GOOD.fullmatch("".join(w[1] for w in way)):
            found = sum(w[2] for w in way), "".join(w[0] for w in way)
            best = found if best is None or found < best else best
    return best


def by_strings(turns):
    """(cost, audit, mended turns): the cheapest, with whole audits kept per state of the roles said so far."""
    wrong = faults(turns)
    after = lambda s, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((s, x))
    states = {"": (0, "", ())}

    def put(out, s, way):
        if s is not None and (s not in out or way < out[s]):
            out[s] = way

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    put(out, after(s, x), (c + 5, a + "I", (*t, (role, ""))))
        return out

    for (role, text), fault in zip(turns, wrong, strict=True):
        out, stays = {}, 5 if fault == "truncated" else 0
        for s, (c, a, t) in inserted(states).items():
            put(out, s, (c + 2, a + "D", t))
            if fault not in ("blank", "duplicate"):
                put(out, after(s, role[:1]), (c + stays, a + "K", (*t, (role, text))))
                for x, new in (("u", "user"), ("a", "assistant")):
                    put(out, after(s, x), (c + stays + 1, a + "R", (*t, (new, text))))
        states = out
    return min(v for s, v in inserted(states).items() if s in ("", "a"))


def solved(turns, cuts=()):
    """By the module's own layers, in blocks that end at cuts."""
    layers, blocks, wrong = R.Layers(), [], faults(turns)
    ends = [*cuts, len(turns)]
    parents = []
    for a, b in zip([0, *ends], ends, strict=False):
        costs, ranks, ways = [], [], []
        for start in range(4):
            c, r = layers.begin(start)
            total, way = 0, b""
            for k in range(a, b):
                kind = R.GONE if wrong[k] in ("blank", "duplicate") else R.CUT if wrong[k] else R.SOUND
                c, r, base, p = layers.step(c, r, "sua".find(turns[k][0][:1] or "?") % 4, kind)
                total, way = total + base, way + p
            costs.append([None if x is None else x + total for x in c])
            ranks.append(list(r))
            ways.append(way)
        blocks.append((costs, ranks))
        parents.append(ways)
    path, tail, cost = R.chain(blocks)
    return cost, "".join(R.read_off(p[s], e) for p, (s, e) in zip(parents, path, strict=True)) + "I" * tail


def some(r, n):
    return [(r.choice(("system", "user", "assistant", "tool", "user", "assistant", "")), r.choice(("yes.", "no.", "why", " ", "go on!", f"{r.randrange(9)}?"))) for _ in range(n)]


def test_codes_begin_no_other():
    assert not any(a != b and b.startswith(a) for a in R.CODES for b in R.CODES) and len(R.CODES) == 9


def test_all_edits():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 3, 3, 3):
        for _ in range(25 if n < 3 else 6):
            turns = some(r, n)
            assert by_strings(turns)[:2] == all_edits(turns) == (solved(turns) if n else (0, ""))


@pytest.mark.parametrize("seed", range(5))
def test_layers_and_blocks(seed):
    r = random.Random(seed)
    for _ in range(60):
        turns = some(r, r.randint(1, 30))
        cuts = sorted(r.sample(range(1, len(turns)), min(len(turns) - 1, r.randint(0, 5))))
        assert solved(turns, cuts) == by_strings(turns)[:2]


def expected(rows):
    """{conv_id: the query's row} of damaged rows (conv_id, turn, role, text)."""
    out, convs = {}, {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role, hashlib.md5(text.encode()).digest(), text))
    for c, found in convs.items():
        found.sort()
        turns, numbers = [(x[2], x[4]) for x in found], [x[1] for x in found if x[0]]
        wrong = faults(turns)
        cost, audit, mended = by_strings(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
        out[c] = (gaps, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talks():
    r = random.Random(4)
    rows = [(c, t, role, text) for c in range(60) for t, (role, text) in enumerate(some(r, r.randint(1, 12)))]
    rows += [(900, t, role, text + "x" * (t % 50) + ".") for t, (role, text) in enumerate(some(r, 3000))]  # a third of all and more
    rows += [(901, r.choice((None, 1, 2, 5, 9)), role, text) for role, text in some(r, 40)]  # ties and turns without number
    rows += [(None, r.randrange(5), role, text) for role, text in some(r, 9)] + [(902, None, None, None), (902, None, "user", None), (903, 1, "user", "long " * 50_000 + "!"), (903, 2, "assistant", "é\u0085.")]
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_against_strings(spark, talks, block):
    table = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(7)
    hurt = R.damaged(table)
    assert sorted(map(tuple, hurt.collect()), key=str) == sorted(damaged(talks), key=str)
    got = {x["conv_id"]: tuple(x)[1:] for x in R.repair_digests(hurt, table, block).collect()}
    want = expected(damaged(talks))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c in {x[0] for x in talks}}


def test_query(spark, talks, tmp_path):
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("cost", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: tuple(x)[1:] for x in op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert {c: got[c] for c in expected(damaged(talks))} == expected(damaged(talks))


def test_mended_turns_and_reports(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c."), (2, 1, "system", "s.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = sorted(map(tuple, R.mended_turns(table).collect()))
    assert kept == [(1, 0, "user", "b."), (1, 1, "assistant", "c.")]
    assert sorted(tuple(x)[-2:] for x in R.reports(table).collect()) == [(2, "D"), (2, "DKK")]
    assert R.mended(table.limit(0)).count() == 0 and R.repair_digests(table.limit(0), table.limit(0)).count() == 0
