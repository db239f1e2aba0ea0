"""The library that the driver's tables stand for: books, chapters, chunks, cursors and a buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ChunkPolicy, chunks, one_line
from quire.operators.cursors import chapter_max, latest, ordinals
from quire.sources.folders import shared_dir

#: Chunk sizes for conversations, whose turns are shorter than chapters.
TURNS = ChunkPolicy(target=200, most=300)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books; the number of one is its place in its series."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("author_id"), F.col("source").alias("series_id"), F.col("doc_id").alias("series_order"), F.col("doc_id").alias("saved")
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("chapter"), one_line(F.col("text")).alias("text"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters(spark, sf_dir)
    return rows.select("book", "chapter", F.posexplode(chunks(F.col("text"), TURNS)).alias("chunk", "chunk_text"))


def cursor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    log = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    k = F.get_json_object("props", "$.k").cast("int")
    return log.select(
        "event_id", "ts", "user_id", (F.col("event_id") % F.col("n")).alias("book"), (k % 8).alias("chapter"), (F.floor("value").cast("int") % 4).alias("chunk")
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(cursor_log(spark, sf_dir), ["user_id", "book"], ["ts", "event_id"], ["chapter", "chunk"])


def maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapter_max(text_chunks(spark, sf_dir))


def library_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cursors, maxima, cache): all cursors, the books' maxima and the buffer of window(), each kept in the shared folder."""
    shared_dir(spark)
    own, most = cursors(spark, sf_dir).checkpoint(), maxima(spark, sf_dir).checkpoint()
    totals = most.groupBy("book").agg(F.sum(F.col("max_chunk") + 1).cast("long").alias("total"))
    rows = own.select("user_id", "book").join(totals, "book")
    cache = rows.select("user_id", "book", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("ordinal")).where("ordinal % 7 <> 3")
    return own, most, cache.checkpoint()


def window(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, cache): the cursors that lie in their book, with ordinals, and a buffer with gaps.

    The buffer holds of each reader's book all ordinals but every seventh, from the fourth on. Cursors and the chunked
    texts' maxima, which both are made from, are computed once and kept in the shared folder.
    """
    own, most, cache = library_state(spark, sf_dir)
    return ordinals(own, most), cache
