"""Streams in several batches: ingest that is stopped between its tables, buffers per entry, tokens that run out."""

import json
import os
import random

import pytest

from quire.sources.keyed_table import KeyedTable
from quire.streaming import ingest as I
from quire.streaming import positions as S
from quire.streaming.states import buffered, expired_tokens, state_by_entry

from .test_archives import book, container


def put(root, books):
    for name, files in books.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}.part", "wb") as f:
            f.write(files if isinstance(files, bytes) else container(files))
        os.rename(f"{root}/{name}.part", f"{root}/{name}")


def titled(k):
    return book(replace=[("<package>", f'<package xmlns:dc="x"><metadata><dc:title>T{k}</dc:title><dc:creator>A</dc:creator></metadata>')])


def test_ingest_is_stopped_and_started_again(spark, tmp_path, monkeypatch):
    root, books = f"{tmp_path}/in", {}
    tables = [KeyedTable(spark, f"file://{tmp_path}/{x}", ["path"], buckets=4) for x in ("good", "bad")]
    run = lambda: I.ingest(spark, root, *tables, f"{tmp_path}/checkpoint", files_per_batch=3)
    books = {f"a/{k}.epub": titled(k) if k % 3 else b"no zip" for k in range(8)}
    put(root, books)
    put(root, {"a/skip.txt": b"x"})
    calls, own = [], KeyedTable.upsert

    def stops(self, changes, **more):
        calls.append((self.root[-4:], more["number"]))
        if len(calls) == 4:  # after the second batch's catalogue, before its quarantine
            raise RuntimeError("the machine is gone")
        return own(self, changes, **more)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "upsert", stops)
        with pytest.raises(Exception, match="machine is gone"):
            run().awaitTermination()
    assert [n for _, n in calls] == [0, 0, 1, 1]
    assert tables[0].version().applied == {"ingest": 1} and tables[1].version().applied == {"ingest": 0}
    put(root, {"b/new.epub": titled("new")})
    run().awaitTermination()
    run().awaitTermination()  # nothing new, nothing done
    name = lambda p: p.split("/in/")[1]
    good = [(name(r["path"]), r["title"]) for r in tables[0].read().collect()]
    bad = [(name(r["path"]), r["reason"].rsplit(": ", 1)[1]) for r in tables[1].read().collect()]
    assert sorted(good) == sorted([(f"a/{k}.epub", f"T{k}") for k in range(8) if k % 3] + [("b/new.epub", "Tnew")])
    assert sorted(bad) == [(f"a/{k}.epub", "unreadable") for k in (0, 3, 6)]


def test_ingest_broadcasts_nothing(spark, tmp_path, monkeypatch):
    """A batch's joins send nothing through the driver; the session's own threshold stays as it was."""
    key, seen, own = "spark.sql.autoBroadcastJoinThreshold", [], KeyedTable.upsert

    def told(self, changes, **more):
        seen.append((self.spark.conf.get(key), changes.sparkSession.conf.get(key), "Broadcast" in changes._jdf.queryExecution().executedPlan().toString()))
        return own(self, changes, **more)

    put(f"{tmp_path}/in", {"a/0.epub": titled(0), "a/1.epub": b"no zip"})
    before = spark.conf.get(key)
    monkeypatch.setattr(KeyedTable, "upsert", told)
    tables = [KeyedTable(spark, f"file://{tmp_path}/{x}", ["path"], buckets=4) for x in ("good", "bad")]
    I.ingest(spark, f"{tmp_path}/in", *tables, f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == [("-1", "-1", False)] * 2 and spark.conf.get(key) == before != "-1"
    assert [t.read().count() for t in tables] == [1, 1]


def test_a_batch_of_ingest_is_few_tasks(spark, tmp_path):
    """A batch deals its entries out once, and neither its files nor its joins make tasks by the number of files or partitions set; the session's own settings stay."""
    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    cores, settings = spark.sparkContext.defaultParallelism, spark.conf.getAll
    put(f"{tmp_path}/in", {f"a/{k}.epub": titled(k) if k % 10 else b"no zip" for k in range(60)})
    tables = [KeyedTable(spark, f"file://{tmp_path}/{x}", ["path"], buckets=4) for x in ("good", "bad")]
    spark.conf.set(key, "50")
    try:
        query = I.ingest(spark, f"{tmp_path}/in", *tables, f"{tmp_path}/checkpoint")
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert 0 < len(jobs) <= 20 and max(tasks) <= 3 * cores and spark.conf.getAll == settings
    assert [t.read().count() for t in tables] == [54, 6]


def batches(folder, rows, n):
    """Parquet-free input: a JSON file per batch."""
    os.makedirs(folder)
    for k in range(n):
        with open(f"{folder}/{k:03d}.json", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in rows[k::n] if x)
        os.utime(f"{folder}/{k:03d}.json", (k, k))


def test_buffers_in_batches(spark, tmp_path):
    r = random.Random(5)
    rows = [{"user_id": r.randrange(3), "book": r.randrange(2), "ordinal": r.randrange(120) + k // 4, "requested": r.random() < 0.2} for k in range(400)]
    batches(f"{tmp_path}/in", rows, 8)
    stream = spark.readStream.schema("user_id long, book long, ordinal long, requested boolean").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    with state_by_entry(spark):
        S.run_once(buffered(stream, 20), f"{tmp_path}/out", "update")
    got = {(x["user_id"], x["book"]): (x["anchor"], x["n_held"]) for x in S.newest(spark, f"{tmp_path}/out", ["user_id", "book"]).collect()}
    held, anchors = {}, {}
    for k in range(8):
        for x in rows[k::8]:
            key = x["user_id"], x["book"]
            held.setdefault(key, set()).add(x["ordinal"])
            anchors[key] = max(anchors.get(key, 0), x["ordinal"] if x["requested"] else 0)
        for key in held:
            held[key] = {o for o in held[key] if o >= anchors[key] - 20}
    assert got == {key: (anchors[key], len(held[key])) for key in held}
    assert spark.read.parquet(f"{tmp_path}/out/data").select("batch").distinct().count() == 8


def test_a_batch_writes_what_changes(spark, tmp_path):
    """As many changes a batch, and ever more that is held: what is written to the state doesn't grow with it."""
    rows = [{"user_id": 1, "book": 1, "ordinal": k, "requested": False} for k in range(6 * 3000)]
    os.makedirs(f"{tmp_path}/in")
    for k in range(6):
        with open(f"{tmp_path}/in/{k}.json", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in rows[3000 * k : 3000 * (k + 1)])
        os.utime(f"{tmp_path}/in/{k}.json", (k, k))
    stream = spark.readStream.schema("user_id long, book long, ordinal long, requested boolean").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    with state_by_entry(spark):
        query = buffered(stream, 10).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.format("noop").mode("overwrite").save()).start()
        query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert len(updated) == 6 and max(updated[1:]) <= min(updated[1:]) + 5 and max(updated) < 6100


def test_a_readers_many_books_are_one_state(spark, tmp_path):
    """Readers with a row or two in each of many books: one call and one state row a reader, not several a book."""
    rows = [{"user_id": k % 3, "book": k % 700 if k % 11 else None, "ordinal": k, "requested": k % 2 == 0} for k in range(2000)]
    batches(f"{tmp_path}/in", rows, 2)
    stream = spark.readStream.schema("user_id long, book long, ordinal long, requested boolean").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    seen = []
    with state_by_entry(spark):
        query = buffered(stream, 500).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        query = query.foreachBatch(lambda df, n: seen.append({(x["user_id"], x["book"]): (x["anchor"], x["n_held"]) for x in df.collect()})).start()
        query.awaitTermination()
    anchors, held = {}, {}
    for x in rows:
        key = x["user_id"], x["book"]
        anchors[key] = max(anchors.get(key, 0), x["ordinal"] if x["requested"] else 0)
        held.setdefault(key, set()).add(x["ordinal"])
    assert {**seen[0], **seen[1]} == {key: (anchors[key], sum(o >= anchors[key] - 500 for o in held[key])) for key in held}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 6  # a null book stands apart


def test_tokens_run_out_once(spark, tmp_path):
    at = lambda m: f"2024-05-01T{m // 60:02d}:{m % 60:02d}:00.000001"
    uses = {1: [0, 10, 20], 2: [5], 3: [0, 200], 4: [395]}
    rows = sorted(({"user_id": u, "ts": at(m)} for u, ms in uses.items() for m in ms), key=lambda x: x["ts"])
    os.makedirs(f"{tmp_path}/in")
    for k, x in enumerate(rows):
        with open(f"{tmp_path}/in/{k}.json", "w") as f:
            f.write(json.dumps(x) + "\n")
        os.utime(f"{tmp_path}/in/{k}.json", (k, k))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    with state_by_entry(spark):
        S.run_once(expired_tokens(stream, 900, "30 minutes"), f"{tmp_path}/out")
    got = sorted((x["user_id"], x["expired"].strftime("%H:%M"), x["uses"]) for x in spark.read.parquet(f"{tmp_path}/out/data").collect())
    assert got == [(1, "00:35", 3), (2, "00:20", 1), (3, "00:15", 1), (3, "03:35", 1)]  # 4 is still good at 06:05


def test_the_sessions_own_store_comes_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(KeyError), state_by_entry(spark):
        raise KeyError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
