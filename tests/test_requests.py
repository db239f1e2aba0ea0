"""Whole chunk requests against a walk over one reader's buffer, offsets in spans, and contents that lie in each other."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import prefetch as P
from quire.operators.search import chunks_at
from quire.sources import archives as A


def walk(chapters, held, start, count, size):
    """One request, cursor by cursor."""
    spine = [(c, k) for c in sorted(chapters) for k in range(chapters[c] + 1)]
    chapter, chunk = start
    if chapter not in chapters or (chunk > chapters[chapter] and chapter + 1 not in chapters):
        return None
    start = start if chunk <= chapters[chapter] else (chapter + 1, 0)
    following = lambda c, n: spine[spine.index(c) : spine.index(c) + n]
    queue, returned = set(), []
    if start not in held:
        queue.update(following(start, 2 * size))
    for c in following(start, count):
        if c not in held:
            break
        returned.append(c)
    last = returned[-1] if returned else start
    missing = [c for c in following(last, size) if c not in held]
    if missing:
        queue.update(missing + following(missing[-1], 2 * size))
    cut = spine[max(spine.index(last) - size // 2, 0)]
    return start, returned, last, sorted(queue - held), sum(c < cut for c in held)


@pytest.mark.parametrize("seed", range(3))
def test_requests(spark, seed):
    r = random.Random(seed)
    maxima, cursors, cache, want, number = [], [], [], {}, {}
    for book in range(60):
        chapters = {c: r.randint(0, 5) for c in range(r.randint(1, 6)) if c == 0 or r.random() < 0.9}
        spine = [(c, k) for c in sorted(chapters) for k in range(chapters[c] + 1)]
        number[book] = {c: i for i, c in enumerate(spine)}
        held = {c for c in spine if r.random() < 0.7}
        start = (r.randrange(7), r.randrange(6))
        maxima += [(book, c, k) for c, k in chapters.items()]
        cursors.append((1, book, *start))
        cache += [(1, book, number[book][c]) for c in held]
        want[book] = walk(chapters, held, start, 4, 6)
    got = P.answered(
        P.valid_requests(spark.createDataFrame(cursors, "user_id long, book long, chapter int, chunk int"), spark.createDataFrame(maxima, "book long, chapter int, max_chunk int")),
        spark.createDataFrame(cache, "user_id long, book long, ordinal long"), 4, 6,
    )
    rows = {x["book"]: x for x in got.collect()}
    assert rows.keys() == {b for b, w in want.items() if w} and len(rows) > 20
    for book, x in rows.items():
        start, returned, last, queue, trimmed = want[book]
        at = number[book]
        assert (x["start"], x["returned"], x["last"], x["queue"], x["trimmed"]) == (at[start], [at[c] for c in returned], at[last], [at[c] for c in queue], trimmed)


def test_requests_read_each_table_once(spark, tmp_path):
    for name, ddl in (("cursors", "user_id long, book long, chapter int, chunk int"), ("maxima", "book long, chapter int, max_chunk int"), ("cache", "user_id long, book long, ordinal long")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    plan = P.answered(P.valid_requests(read("cursors"), read("maxima")), read("cache"), 4, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_offsets_in_spans(spark):
    r = random.Random(7)
    spans, offsets = [], []
    for book in range(12):
        at = 0
        for k in range(r.randint(0, 40)):
            at += r.choice((0, 0, 3))
            n = r.choice((0, 1, 5, 90, 700))
            spans.append((book, at, at + n, k))
            at += n
    offsets = [(i, r.choice((0, 0, 0, *range(13))), r.randrange(-5, 6000)) for i in range(900)] + [(-1, None, 5), (-2, 1, None)]
    plain = lambda b, o: next((k for x, s, e, k in spans if x == b and o is not None and s <= o < e), 0)
    for width in (16, 1000):
        rows = chunks_at(spark.createDataFrame(offsets, "id int, book int, offset long").withColumn("stop", F.lit(1)), spark.createDataFrame(spans, "book int, start long, stop long, chunk int"), width=width).collect()
        assert {x["id"]: x["chunk"] for x in rows} == {i: plain(b, o) for i, b, o in offsets} and len(rows) == len(offsets)


def test_contents_tree(spark):
    point = lambda t, *inner: f'<navPoint id="x"><navLabel><text>{t}</text></navLabel><content src="c.xhtml#{t}"/>' + "".join(inner) + "</navPoint>"
    nested = point("A", point("B &amp; <i>b</i>", point("C")), point("D")) + "<!-- </navPoint> -->" + point("E", point("F"))
    files = {"nested": nested, "open": nested[: -len("</navPoint>")], "shut": "</navPoint>" + nested + "<navPoint>", "prefix": nested.replace("navPoint", "ncx:navPoint").replace("<text", "<ncx:text").replace("</text", "</ncx:text").replace("<content", "<ncx:content"), "none": ""}
    rows = A.contents_tree(spark.createDataFrame([(p, 0, "a/toc.NCX", bytearray(f"<ncx><navMap>{t}</navMap></ncx>".encode())) for p, t in files.items()], "path string, ord int, name string, data binary")).orderBy("path", "position").collect()
    got = {}
    for x in rows:
        got.setdefault(x["path"], []).append((x["depth"], x["parent"], x["place"], x["title"], x["trail"]))
        assert x["name"] == "a/c.xhtml" or x["path"] == "shut"
    assert got["nested"] == got["prefix"] == [
        (0, None, 0, "A", ["A"]), (1, 0, 0, "B & b", ["A", "B & b"]), (2, 1, 0, "C", ["A", "B & b", "C"]), (1, 0, 1, "D", ["A", "D"]), (0, None, 1, "E", ["E"]), (1, 4, 0, "F", ["E", "F"]),
    ]
    assert {(x["error"], x["parent"]) for x in rows if x["path"] in ("open", "shut")} == {("tags don't fit", None)} and "none" not in got
