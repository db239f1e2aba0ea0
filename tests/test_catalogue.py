"""Ranked search against scoring every pair."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import catalogue as C


def grams(title):
    return {p[i : i + 3] for w in re.split(r"[\W_]+", (title or "").lower()) if w for p in ["  " + w + " "] for i in range(len(p) - 2)}


def plain(books, entries, least, most):
    """{book: [(entry, score)]} by all pairs."""
    sets = {e: grams(t) for e, t in entries}
    df = {}
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    weight = lambda s: sum(math.floor(1000 * math.log(1 + len(entries) / df[g] if g in df else 1 + len(entries)) + 0.5) for g in s)
    out = {}
    for b, t in books:
        own = grams(t)
        hits = [(-weight(own & s) / weight(own | s), e) for e, s in sets.items() if own & s]
        out[b] = [(e, -s) for s, e in sorted(hits) if -s >= least][:most]
    return out


@pytest.fixture(scope="module")
def titles():
    r = random.Random(6)
    words = ["".join(r.choice("abcdeéilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(120)]
    entries = [(k, " ".join(["The"] * (k % 3 > 0) + [r.choice(words).title() for _ in range(r.randint(1, 5))])) for k in range(150)]
    books = []
    for k, (_, t) in enumerate(entries[:100]):
        w = t.split()
        r.shuffle(w)
        t = " ".join(w)
        if k % 2:
            i = r.randrange(len(t))
            t = t[:i] + r.choice("xyz") + t[i + 1 :]
        books.append((1000 + k, t + r.choice(("", "!", " - "))))
    return books + [(2000, ""), (2001, None), (2002, "?!"), (2003, "zzzzzz qqq")], [*entries, (500, entries[3][1]), (501, ""), (502, None)]


@pytest.mark.parametrize(("least", "most"), [(0.3, 5), (0.7, 2), (0.05, 50)])
def test_ranked(spark, titles, least, most):
    books, entries = titles
    found = C.ranked(spark.createDataFrame(books, "book int, title string"), spark.createDataFrame(entries, "entry int, title string"), "book", "entry", least, most)
    got = {}
    for x in found.orderBy("book", "rank").collect():
        got.setdefault(x["book"], []).append((x["entry"], pytest.approx(x["score"], abs=1e-12)))
    assert {b: h for b, h in plain(books, entries, least, most).items() if h} == got


def test_misspelt_and_reordered_titles_are_found(spark, titles):
    books, entries = titles
    rows = C.identified(
        spark.createDataFrame([(b, t, "x") for b, t in books], "book int, title string, author string"),
        spark.createDataFrame([(e, t, "a", e == 500) for e, t in entries], "entry int, title string, author string, featured boolean"), "book", "entry", "featured",
    )
    got = {x["book"]: (x["entry"], x["found_by"]) for x in rows.collect()}
    right = [b for b, _ in books[:100] if got[b][0] is not None and dict(entries)[got[b][0]] == dict(entries)[b - 1000]]
    assert len(right) >= 85 and got[1003] == (500, "search")  # the featured one of two with one title
    assert got[2000] == got[2001] == got[2002] == got[2003] == (None, "none")


def test_title_and_author_come_first(spark):
    entries = spark.createDataFrame([(1, "Red Ring", "B", True), (2, "Red Ring", "A", False), (3, "Red Ring", "A", False)], "entry int, title string, author string, featured boolean")
    books = spark.createDataFrame([(7, "Red Ring", "A"), (8, "Red Ring (Rings, #2)", "A"), (9, None, None)], "book int, title string, author string")
    got = {x["book"]: (x["entry"], x["found_by"]) for x in C.identified(books, entries, "book", "entry", "featured").collect()}
    assert got == {7: (2, "title and author"), 8: (1, "search"), 9: (None, "none")}
    assert C.ranked(books.select("book", "title"), entries.select("entry", "title").where(F.lit(False)), "book", "entry").count() == 0


def test_copies_are_compared_once(spark, titles, monkeypatch):
    """Thousands of books and entries of one title are one pair of titles; and titles in many blocks find what they find in one."""
    of = lambda name: spark.range(3000).select(F.col("id").cast("int").alias(name), F.lit("The same title").alias("title"))
    known = C.weights(of("entry").groupBy("title").agg(F.count(F.lit(1)).alias("n")))
    own, theirs = (C.weighed(of(x).select("title").distinct(), known, 0.3) for x in ("book", "entry"))
    assert C.candidates(own, theirs, 0.3).count() == 1
    found = C.ranked(of("book"), of("entry"), "book", "entry")
    assert C.ranked(of("book"), of("entry").where("entry < 0"), "book", "entry").count() == 0
    assert [tuple(x) for x in found.groupBy("entry", "rank", "score").count().orderBy("rank").collect()] == [(k, k + 1, 1.0, 3000) for k in range(5)]
    books, entries = (spark.createDataFrame(rows, f"{name} int, title string") for rows, name in zip(titles, ("book", "entry"), strict=True))
    rows = lambda: sorted(map(tuple, C.ranked(books, entries, "book", "entry").collect()))
    one = rows()
    monkeypatch.setattr(C, "BLOCK", 40)
    assert C._blocks(150) == 4 and rows() == one


def test_only_the_best_hits_leave_a_block(spark):
    """400 titles that are nearly all hits of each other: what leaves the tasks grows with the titles, not with their pairs."""
    entries = spark.range(400).select(F.col("id").cast("int").alias("entry"), F.concat(F.lit("The very same long title no "), F.col("id").cast("string")).alias("title"))
    known = C.weights(entries.groupBy("title").agg(F.count(F.lit(1)).alias("n")))
    own, theirs = (C.weighed(entries.select("title"), known, 0.05) for _ in range(2))
    assert C.candidates(own, theirs, 0.05).count() == 400 * 5
    rows = [tuple(x) for x in entries.collect()]
    got = {}
    for x in C.ranked(entries.select(F.col("entry").alias("book"), "title"), entries, "book", "entry", 0.05).orderBy("book", "rank").collect():
        got.setdefault(x["book"], []).append((x["entry"], pytest.approx(x["score"], abs=1e-12)))
    assert plain(rows, rows, 0.05, 5) == got
