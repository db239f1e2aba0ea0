"""Cursors (chapter, chunk) over books: algebra by ordinals, latest positions, and reading progress.

chunks has book, chapter, chunk; cursors have book, chapter, chunk and any other columns. Everything is partitioned by
book, and ordinals number a book's chunks in reading order from 0, so a step in the book is a step in the ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chapter_max(chunks: DataFrame) -> DataFrame:
    """(book, chapter, max_chunk): the last index, not the count."""
    return chunks.groupBy("book", "chapter").agg(F.max("chunk").alias("max_chunk"))


def max_map(maxima: DataFrame) -> DataFrame:
    """(book, max_chunks): a map from chapter to last chunk; bounded by a book's chapters."""
    pairs = F.array_sort(F.collect_list(F.struct("chapter", "max_chunk")))
    return maxima.groupBy("book").agg(F.map_from_entries(pairs).alias("max_chunks"))


def latest(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key the values of its last row in order: one aggregate with partial maxima, no sort of a key's rows."""
    last = F.max(F.struct(*dict.fromkeys([*order, *values]))).alias("__last")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col("__last")[v].alias(v) for v in values])


def with_default(wanted: DataFrame, cursors: DataFrame) -> DataFrame:
    """wanted (user_id, book) with their cursor, or (0, 0) where there is none."""
    joined = wanted.join(cursors, ["user_id", "book"], "left")
    return joined.select("user_id", "book", F.coalesce("chapter", F.lit(0)).alias("chapter"), F.coalesce("chunk", F.lit(0)).alias("chunk"))


def chapter_starts(maxima: DataFrame) -> DataFrame:
    """Per chapter the ordinal of its first chunk, the book's chunk count, and the sum of max_chunk before and overall."""
    book = Window.partitionBy("book")
    before = book.orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("max_chunk") + 1
    return maxima.select(
        "book",
        "chapter",
        "max_chunk",
        F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias("start"),
        F.sum(n).over(book).cast("long").alias("total"),
        F.coalesce(F.sum("max_chunk").over(before), F.lit(0)).cast("long").alias("weight_before"),
        F.sum("max_chunk").over(book).cast("long").alias("weight"),
    )


def book_progress(cursors: DataFrame, maxima: DataFrame) -> DataFrame:
    """cursors with progress: the weight of chapters before and the chunk, over the book's weight; within 0..1, float.

    A chapter weighs its last index, so one of a single chunk weighs nothing. A cursor behind the last chapter has all
    chapters before it; a book without weight has progress 0.
    """
    weights = chapter_starts(maxima).groupBy("book").agg(F.max("weight").alias("w"), F.sort_array(F.collect_list(F.struct("chapter", "max_chunk"))).alias("m"))
    joined = cursors.join(weights, "book", "left")
    before = F.aggregate(F.filter("m", lambda x: x["chapter"] < F.col("chapter")), F.lit(0).cast("long"), lambda a, x: a + x["max_chunk"])
    share = F.least(F.lit(1.0), (before + F.col("chunk")) / F.col("w"))
    return joined.select(*cursors.columns, F.when(F.col("w") > 0, share).otherwise(F.lit(0.0)).cast("float").alias("progress"))


def chapter_progress(cursors: DataFrame, maxima: DataFrame) -> DataFrame:
    """cursors with progress in their chapter: chunk over last index, within 0..1; null where there is no such chapter."""
    joined = cursors.join(maxima, ["book", "chapter"], "left")
    share = F.when(F.col("max_chunk") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("chunk") / F.col("max_chunk")))
    return joined.select(*cursors.columns, F.when(F.col("max_chunk").isNotNull(), share).cast("float").alias("progress"))


def ordinals(cursors: DataFrame, maxima: DataFrame) -> DataFrame:
    """cursors within their book with `ordinal` and `total`; others are left out."""
    starts = chapter_starts(maxima).select("book", "chapter", "max_chunk", "start", "total")
    joined = cursors.join(starts, ["book", "chapter"]).where(F.col("chunk").between(0, F.col("max_chunk")))
    return joined.select(*cursors.columns, (F.col("start") + F.col("chunk")).alias("ordinal"), "total")


def at_ordinals(rows: DataFrame, maxima: DataFrame, ordinal: str = "ordinal", chapter: str = "chapter", chunk: str = "chunk") -> DataFrame:
    """rows (book, ordinal, ...) with the chapter and chunk of their ordinal, found in the book's array of chapters."""
    starts = chapter_starts(maxima).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("start", "chapter"))).alias("__starts"))
    found = F.element_at(F.filter("__starts", lambda x: x["start"] <= F.col(ordinal)), -1)
    kept = [c for c in rows.columns if c not in (chapter, chunk)]
    return rows.join(starts, "book").select(*kept, found["chapter"].alias(chapter), (F.col(ordinal) - found["start"]).cast("int").alias(chunk))


def moved(cursors: DataFrame, maxima: DataFrame, steps: int | Column) -> DataFrame:
    """cursors `steps` chunks on (back if negative), held at the book's first and last chunk; new_chapter, new_chunk."""
    own = ordinals(cursors, maxima)
    to = F.greatest(F.lit(0), F.least(F.col("total") - 1, F.col("ordinal") + steps))
    out = at_ordinals(own.withColumn("__to", to), maxima, "__to", "new_chapter", "new_chunk")
    return out.select(*cursors.columns, "new_chapter", "new_chunk")


def validated(cursors: DataFrame, maxima: DataFrame) -> DataFrame:
    """cursors with valid_chapter, valid_chunk and ok: a chunk past its chapter's end is the next chapter's first one.

    Not ok, with nulls: an unknown chapter, or past the end of the last one.
    """
    following = F.lead("chapter").over(Window.partitionBy("book").orderBy("chapter"))
    joined = cursors.join(maxima.withColumn("__next", following), ["book", "chapter"], "left")
    past = F.col("chunk") > F.col("max_chunk")
    chapter = F.when(past, F.when(F.col("__next") == F.col("chapter") + 1, F.col("__next"))).when(F.col("max_chunk").isNotNull(), F.col("chapter"))
    return joined.select(*cursors.columns, chapter.alias("valid_chapter"), F.when(chapter.isNotNull(), F.when(past, 0).otherwise(F.col("chunk"))).alias("valid_chunk"), chapter.isNotNull().alias("ok"))


def chapter_changes(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """log with `changed`: whether the chapter differs from that of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("changed", F.coalesce(F.lag("chapter").over(w) != F.col("chapter"), F.lit(False)))
