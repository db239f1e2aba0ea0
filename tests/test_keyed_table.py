"""Tables by key in files, against dictionaries; writers that meet, writers that die; names beside files that are there."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quire.operators.library import free_names
from quire.sources.keyed_table import Conflict, KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)


def rows_of(t, number=None):
    return {r["id"]: r.asDict() for r in t.read(number).collect()}


def test_upserts_and_deletes(spark, table):
    r, plain, history = random.Random(1), {}, []
    with pytest.raises(LookupError):
        table.read()
    for step in range(6):
        changes = {r.randrange(60): (r.choice("abc"), r.randrange(9)) for _ in range(12)}
        table.upsert(spark.createDataFrame([(k, *v) for k, v in changes.items()], "id long, name string, age int"), partial=step % 2 == 0)
        plain |= {k: {"id": k, "name": n, "age": a} for k, (n, a) in changes.items()}
        if step == 3:
            table.delete({"name": "b", "age": 4})
            plain = {k: v for k, v in plain.items() if (v["name"], v["age"]) != ("b", 4)}
        assert rows_of(table) == plain
        history.append((table.version().number, dict(plain)))
    for number, was in history:
        assert rows_of(table, number) == was
    table.upsert(spark.createDataFrame([(1, "x"), (777, "y")], "id long, city string"))  # a column more, the others kept
    assert rows_of(table)[777] == {"id": 777, "name": None, "age": None, "city": "y"} and rows_of(table)[1]["city"] == "x"
    assert {k: v["name"] for k, v in rows_of(table).items() if k in plain} == {k: v["name"] for k, v in plain.items()}
    with pytest.raises(ValueError):
        table.delete({})
    before = table.version().number
    assert table.delete({"name": "nobody"}).number == before  # nothing to do, no version
    assert table.vacuum(keep=1) > 0 and len(rows_of(table)) >= len(plain)
    with pytest.raises(LookupError):
        table.read(0)


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(200).withColumn("v", F.lit(0)))
    old = table.version()
    table.upsert(spark.createDataFrame([(5, 1)], "id long, v int"))
    new = table.version()
    assert len(old.buckets) == 8 and sum(old.buckets[b] != new.buckets[b] for b in old.buckets) == 1
    assert rows_of(table)[5]["v"] == 1 and len(rows_of(table)) == 200


def test_of_two_writers_one_loses(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))
    start, outcome = threading.Barrier(2), []
    commit = KeyedTable._commit

    def together(self, version):
        start.wait(60)
        commit(self, version)

    monkeypatch.setattr(KeyedTable, "_commit", together)

    def write(v):
        try:
            table.upsert(spark.createDataFrame([(1, v)], "id long, v string"))
            outcome.append(v)
        except Conflict:
            outcome.append(None)

    both = [threading.Thread(target=write, args=(v,)) for v in ("b", "c")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(outcome, key=str) in ([None, "b"], [None, "c"]) or outcome.count(None) == 1
    assert rows_of(table)[1]["v"] == next(x for x in outcome if x) and table.version().number == 1


def test_a_writer_that_dies_changes_nothing(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))

    def dies(self, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string"))
    assert rows_of(table) == {1: {"id": 1, "v": "a"}} and table.version().number == 0
    table.upsert(spark.createDataFrame([(2, "d")], "id long, v string"))
    assert {k: v["v"] for k, v in rows_of(table).items()} == {1: "a", 2: "d"}
    root = table.root.removeprefix("file://")
    assert len(os.listdir(f"{root}/data")) == 3 and table.vacuum(keep=2) == 1


def test_numbered_changes_count_once(spark, table):
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    table.upsert(one, source="s", number=4)
    table.upsert(spark.createDataFrame([(1, "b")], "id long, v string"), source="s", number=4)
    table.upsert(spark.createDataFrame([(1, "c")], "id long, v string"), source="s", number=3)
    assert rows_of(table)[1]["v"] == "a" and table.version().number == 0
    table.upsert(spark.createDataFrame([(1, "d")], "id long, v string"), source="other", number=0)
    assert rows_of(table)[1]["v"] == "d" and table.version().applied == {"s": 4, "other": 0}


def test_free_names(spark):
    r = random.Random(3)
    taken = [(a, f"{t}{f' ({n})' if n else ''}.epub") for a in "pq" for t in ("T", "T (2)", "u") for n in range(7) if r.random() < 0.5] + [("p", "T (01).epub"), ("p", "T.txt"), ("q", ".epub")]
    rows = [(k, r.choice("pqr"), r.choice(("T", "T (2)", "u", "v"))) for k in range(60)]
    found = free_names(spark.createDataFrame(rows, "id int, folder string, title string"), spark.createDataFrame(taken, "folder string, file string"), ["folder"], ["id"], "title", ".epub").collect()
    want = {}
    for k, a, t in sorted(rows):  # one after the other; a name that is made up for one title may be another title, so titles are looked at apart
        mine = {f for x, f in taken if x == a} | {w for i, w in want.items() if (rows[i][1], rows[i][2]) == (a, t)}
        want[k] = next(x for n in range(99) if (x := f"{t}{f' ({n})' if n else ''}.epub") not in mine)
    assert {x["id"]: x["unique_name"] for x in found} == want
