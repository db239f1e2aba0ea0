"""Cursor algebra, progress, buffers and tables on small fixtures."""

import pytest

from quire.operators import cursors as C
from quire.operators import library as L
from quire.operators import prefetch as P


def maxima(spark, chapters, book=1):
    return spark.createDataFrame([(book, k, v) for k, v in chapters.items()], "book long, chapter int, max_chunk int")


def cursor(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "user_id long, book long, chapter int, chunk int")


@pytest.mark.parametrize(
    ("chapters", "at", "steps", "to"),
    [
        ({0: 3, 1: 3}, (0, 3), 1, (1, 0)), ({0: 3, 1: 3}, (1, 0), 1, (1, 1)), ({0: 3, 1: 3}, (1, 3), 1, (1, 3)),
        ({0: 3, 1: 3, 2: 3}, (1, 2), -1, (1, 1)), ({0: 3, 1: 3, 2: 3}, (2, 0), -1, (1, 3)), ({0: 3}, (0, 0), -1, (0, 0)),
        ({0: 2, 1: 3, 2: 1}, (0, 2), -2, (0, 0)), ({0: 2, 1: 3, 2: 1}, (2, 1), -4, (1, 1)), ({0: 2, 1: 3, 2: 1}, (0, 1), -5, (0, 0)),
    ],
)
def test_moved(spark, chapters, at, steps, to):
    row = C.moved(cursor(spark, at), maxima(spark, chapters), steps).first()
    assert (row["new_chapter"], row["new_chunk"]) == to


@pytest.mark.parametrize(("at", "progress"), [((0, 0), 0), ((0, 1), 1 / 6), ((0, 2), 2 / 6), ((1, 0), 2 / 6), ((1, 1), 3 / 6), ((2, 4), 1.0)])
def test_book_progress(spark, at, progress):
    row = C.book_progress(cursor(spark, at), maxima(spark, {0: 2, 1: 1, 2: 3})).first()
    assert row["progress"] == pytest.approx(progress, abs=1e-6)


@pytest.mark.parametrize(("chunk", "progress"), [(0, 0), (1, 0.5), (2, 1), (3, 1)])
def test_chapter_progress(spark, chunk, progress):
    assert C.chapter_progress(cursor(spark, (0, chunk)), maxima(spark, {0: 2})).first()["progress"] == progress


def test_validated(spark):
    got = C.validated(cursor(spark, (1, 2), (0, 3), (0, 1), (7, 0)), maxima(spark, {0: 2, 1: 1})).collect()
    found = {(r["chapter"], r["chunk"]): (r["ok"], r["valid_chapter"], r["valid_chunk"]) for r in got}
    assert found == {(1, 2): (False, None, None), (0, 3): (True, 1, 0), (0, 1): (True, 0, 1), (7, 0): (False, None, None)}


def requests(spark, ordinal, total):
    return spark.createDataFrame([(1, 1, ordinal, total)], "user_id long, book long, ordinal long, total long")


def cache(spark, ordinals):
    return spark.createDataFrame([(1, 1, o) for o in ordinals], "user_id long, book long, ordinal long")


def test_windows(spark):
    asked, held = requests(spark, 0, 4), cache(spark, [0, 2])
    assert [r["ordinal"] for r in P.contiguous(asked, held, 4).collect()] == [0]
    assert sorted(r["ordinal"] for r in P.fetch_queue(asked, held, 4).collect()) == [1, 3]
    several = P.contiguous(requests(spark, 0, 5), cache(spark, [0, 1, 2]), 4)
    assert sorted(r["ordinal"] for r in several.collect()) == [0, 1, 2]
    kept = P.trimmed(cache(spark, range(7)), requests(spark, 5, 11), 3)
    assert sorted(r["ordinal"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert P.trimmed(cache(spark, range(7)), requests(spark, 5, 11), 0).count() == 7


def test_queue_has_order_and_nothing_buffered(spark):
    held = [1, 4, 5, 11, 30]
    rows = P.fetch_queue(requests(spark, 0, 40), cache(spark, held), 10).orderBy("place").collect()
    got = [r["ordinal"] for r in rows]
    assert got == sorted(set(got)) and not set(got) & set(held)
    assert [r["place"] for r in rows] == list(range(len(rows)))


BOOKS = [("b2", "s1", 2, 1), ("b1", "s1", 1, 2), ("b3", "s2", 1, 3)]


def test_manifest(spark):
    books = spark.createDataFrame(BOOKS, "id string, series_id string, series_order int, saved int")
    assert {r["series_id"]: r["first_book_id"] for r in L.manifest(books).collect()} == {"s1": "b1", "s2": "b3"}
    assert L.matching(books, {"series_id": "s3"}).count() == 0


def test_filters(spark):
    rows = [(1, "1984", "Orwell", 1949), (2, "Animal Farm", "Orwell", 1945), (3, "Brave New World", "Huxley", 1932), (4, "Fahrenheit 451", "Bradbury", 1953)]
    table = spark.createDataFrame(rows, "id int, title string, author string, year int")
    assert [L.matching(table, w).count() for w in ({"author": "Orwell"}, {"year": 1932}, {"author": "Orwell", "year": 1945}, {"author": "Unknown"}, {})] == [2, 1, 1, 0, 4]
    with pytest.raises(ValueError, match="filter"):
        L.without(table, {})


def test_upsert(spark):
    table = spark.createDataFrame([("Alice", 30, "x")], "name string, age int, city string")
    changes = spark.createDataFrame([("Alice", 40), ("Bob", 1)], "name string, age int")
    assert sorted(map(tuple, L.upsert(table, changes, ["name"]).collect())) == [("Alice", 40, "x"), ("Bob", 1, None)]
    whole = L.upsert(table, changes, ["name"], partial=False)
    assert sorted(map(tuple, whole.collect())) == [("Alice", 40, None), ("Bob", 1, None)]


def test_queue_is_dealt_by_ordinals(spark, monkeypatch):
    """Several requests of a reader, and buffers in many parts; the parts grow with the ordinals, and Spark doesn't put them together."""
    asked = [(u, b, (u * 7 + b * 3) % 30, 31) for u in range(6) for b in range(5)] + [(1, 1, 2, 31), (1, 1, 28, 31), (2, 2, 30, 31)]
    held = {(u, b, o) for u in range(1, 6) for b in range(5) for o in range(31) if (u + b + o) % 4 and (u != 3 or o < 29)} | {(5, 5, 1)}
    want = {}
    for u, b, o, total in asked:
        gaps = [x for x in range(o, min(o + 4, total)) if (u, b, x) not in held]
        more = [x for x in range(gaps[-1] + 1, min(gaps[-1] + 9, total)) if (u, b, x) not in held] if gaps else []
        want.setdefault((u, b), set()).update(gaps + more)
    monkeypatch.setattr(P, "PART", 100)
    rows = P.fetch_queue(
        spark.createDataFrame(asked, "user_id long, book long, ordinal long, total long"), spark.createDataFrame(sorted(held), "user_id long, book long, ordinal long"), 4
    )
    assert sorted(map(tuple, rows.collect())) == sorted((u, b, o, k) for (u, b), found in want.items() for k, o in enumerate(sorted(found)))
    assert rows.rdd.getNumPartitions() == -(-len(asked) * (31 + 12) // 100)
