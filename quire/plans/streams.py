"""Queries that run a stream over what is there now, and return the table it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.archives import SHELF, shelf
from quire.plans.bindings import table
from quire.plans.sql import LOG, with_
from quire.sources.folders import run_folder
from quire.sources.keyed_table import KeyedTable
from quire.streaming import positions as S
from quire.streaming.ingest import ingest
from quire.streaming.states import buffered, expired_tokens, state_by_entry

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").agg(F.max("conv_id")).first()[0] + 1  # one number
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a file source wants a folder: the table's own if it is one, else the one it lies in
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    files = events.parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    return files.select(
        "event_id", "ts", "user_id", (F.col("event_id") % F.lit(n)).alias("book"), (k % 8).alias("chapter"), (F.floor("value").cast("int") % 4).alias("chunk")
    )


@query(with_(LOG) + "SELECT * FROM cursors")
def stream_latest_cursor(spark, d):
    to = run_folder(spark, "stream")
    S.run_once(S.latest_positions(log_stream(spark, d)), to, "update")
    return S.newest(spark, to, ["user_id", "book"])


@query("""WITH c AS (SELECT user_id, event_id % (SELECT max(conv_id) + 1 FROM conversations) AS book, event_id AS ordinal, event_id % 3 = 0 AS requested FROM events),
a AS (SELECT user_id, book, coalesce(max(ordinal) FILTER (requested), 0) AS anchor FROM c GROUP BY ALL)
SELECT user_id, book, anchor, count(*) FILTER (ordinal >= anchor - 500) AS n_held FROM c JOIN a USING (user_id, book) GROUP BY ALL""")
def stream_cache(spark, d):
    to = run_folder(spark, "stream")
    rows = log_stream(spark, d).select("user_id", "book", F.col("event_id").alias("ordinal"), (F.col("event_id") % 3 == 0).alias("requested"))
    with state_by_entry(spark):
        S.run_once(buffered(rows, 500), to, "update")
    return S.newest(spark, to, ["user_id", "book"])


@query("""WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 15 MINUTE, true) AS new FROM events),
r AS (SELECT user_id, ts, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT user_id, run, max(ts) + INTERVAL 15 MINUTE AS expired, count(*) AS uses FROM r GROUP BY ALL)
SELECT user_id, expired, uses FROM u WHERE expired <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_expired_tokens(spark, d):
    """Each event renews its user's token for a quarter of an hour or begins a new one; those that ran out, told by timers."""
    to = run_folder(spark, "stream")
    with state_by_entry(spark):
        S.run_once(expired_tokens(log_stream(spark, d).select("user_id", "ts")), to)
    return spark.read.parquet(f"{to}/data").select("user_id", F.col("expired").cast("timestamp_ntz").alias("expired"), "uses")


@query(with_(LOG) + """, m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS new FROM cursor_log),
r AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m),
e AS (SELECT user_id, run, max(ts) + INTERVAL 30 MINUTE AS shut, max({'ts': ts, 'event_id': event_id, 'chapter': chapter, 'chunk': chunk}) AS last FROM r GROUP BY ALL)
SELECT user_id, last.ts AS ts, last.event_id AS event_id, last.chapter AS chapter, last.chunk AS chunk FROM e WHERE shut <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_quiet_saves(spark, d):
    """The last cursor of each run of a reader's events that a half hour without any has ended."""
    to = run_folder(spark, "stream")
    S.run_once(S.quiet_saves(log_stream(spark, d)), to)
    return spark.read.parquet(f"{to}/data").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {SHELF} SELECT file AS path, 'Book ' || path AS title, 'Author ' || path AS author, 1 AS series_order, NULL AS reason FROM files WHERE kind NOT IN (3, 4)
UNION ALL SELECT file, NULL, NULL, NULL, 'Error in integrity: ' || file || ': unreadable' FROM files WHERE kind IN (3, 4)""")
def stream_ingest(spark, d):
    """Books that arrive as files, taken into a catalogue or a quarantine, batch by batch."""
    to, root = run_folder(spark, "ingest"), shelf(spark, d)
    catalogue, quarantine = (KeyedTable(spark, f"{to}/{x}", ["path"], buckets=8) for x in ("catalogue", "quarantine"))
    ingest(spark, root, catalogue, quarantine, f"{to}/checkpoint").awaitTermination()
    nothing = F.lit(None).cast("string")
    good = catalogue.read().select("path", "title", "author", "series_order", nothing.alias("reason"))
    both = good.unionByName(quarantine.read().select("path", nothing.alias("title"), nothing.alias("author"), F.lit(None).cast("int").alias("series_order"), "reason"))
    short = lambda c: F.regexp_replace(c, r"file:[^:]*/([^/:]+/[^/:]+)", "$1")
    return both.withColumn("path", short("path")).withColumn("reason", short("reason"))
