"""Buffered windows: what can be read on without a gap, what is missing, what to fetch next and what to forget.

requests: user_id, book, chapter, chunk. cache: user_id, book, ordinal. Both carry ordinals (see operators.cursors), by
which a window is a range, a gap a jump, and a trim a comparison; all joins are on (user_id, book).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.cursors import chapter_starts

#: Ordinals in a part of a fetch queue's input, about.
PART = 1 << 21


def wanted(requests: DataFrame, n: int, after: int = 0) -> DataFrame:
    """The n ordinals from `after` past each request's own, within the book: user_id, book, start, ordinal."""
    first, last = F.col("ordinal") + after, F.least(F.col("ordinal") + after + n, F.col("total")) - 1
    rows = requests.where(first <= last).select("user_id", "book", F.col("ordinal").alias("start"), F.explode(F.sequence(first, last)).alias("__o"))
    return rows.select("user_id", "book", "start", F.col("__o").alias("ordinal"))


def contiguous(requests: DataFrame, cache: DataFrame, n: int) -> DataFrame:
    """The buffered ordinals from each request on, up to the first gap or n of them: no gap so far if ordinal - rank holds."""
    held = wanted(requests, n).join(cache, ["user_id", "book", "ordinal"])
    rank = F.row_number().over(Window.partitionBy("user_id", "book", "start").orderBy("ordinal")) - 1
    return held.withColumn("__rank", rank).where(F.col("ordinal") - F.col("__rank") == F.col("start")).drop("__rank")


def missing(requests: DataFrame, cache: DataFrame, n: int) -> DataFrame:
    """Of the next n ordinals those that aren't buffered."""
    return wanted(requests, n).join(cache, ["user_id", "book", "ordinal"], "left_anti")


def fetch_queue(requests: DataFrame, cache: DataFrame, size: int) -> DataFrame:
    """What to fetch: the missing of the next `size`, and what is missing of 2 * size beyond the last of those.

    A request whose next `size` are all buffered asks for nothing. Distinct, never buffered; `place` is the order. Of a
    reader's buffer only the window that a request can ask for is gathered. Rows are dealt into parts of about PART
    ordinals: shuffles of ordinals pack so well that Spark, left to itself, puts very many of them into a task.
    """
    most = requests.agg(F.sum("total") + F.count(F.lit(1)) * 3 * size).first()[0] or 0  # one number
    dealt = lambda rows: rows.repartition(-(-int(most) // PART) or 1, "user_id", "book")
    own = dealt(requests.select("user_id", "book", F.col("ordinal").alias("start"), "total"))
    held = own.join(dealt(cache.select("user_id", "book", F.col("ordinal").alias("__o"))), ["user_id", "book"], "left")
    near = F.col("__o").between(F.col("start"), F.col("start") + 3 * size - 1)
    rows = held.groupBy("user_id", "book", "start", "total").agg(F.collect_set(F.when(near, F.col("__o"))).alias("__held"))
    upto = lambda first, n: F.when(first < F.col("total"), F.sequence(first, F.least(first + n, F.col("total")) - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__gaps", F.array_except(upto(F.col("start"), size), "__held"))
    last = F.array_max("__gaps")
    further = F.when(last.isNotNull(), F.array_except(upto(last + 1, 2 * size), "__held")).otherwise(F.array().cast("array<bigint>"))
    queues = rows.groupBy("user_id", "book").agg(F.flatten(F.collect_list(F.concat("__gaps", further))).alias("__queue"))
    return queues.select("user_id", "book", F.posexplode(F.sort_array(F.array_distinct("__queue"))).alias("place", "ordinal")).select("user_id", "book", "ordinal", "place")


def trimmed(cache: DataFrame, anchors: DataFrame, steps: int) -> DataFrame:
    """The cache without what lies more than `steps` before its anchor; all of it where steps is no more than 0."""
    cut = anchors.select("user_id", "book", F.greatest(F.col("ordinal") - steps, F.lit(0)).alias("__cut"))
    joined = cache.join(cut, ["user_id", "book"], "left")
    return joined.where(F.coalesce(F.col("ordinal") >= F.col("__cut"), F.lit(True)) | F.lit(steps <= 0)).drop("__cut")


def ahead(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Per request the number of buffered ordinals past it."""
    joined = requests.join(cache.withColumnRenamed("ordinal", "__o"), ["user_id", "book"], "left")
    return joined.groupBy("user_id", "book", "ordinal").agg(F.count_if(F.col("__o") > F.col("ordinal")).alias("n_ahead"))


def valid_requests(cursors: DataFrame, maxima: DataFrame) -> DataFrame:
    """Requests (user_id, book, start, total) of cursors that stand in their book: by one join with the books' maxima.

    A chunk past its chapter's last is the first of the next chapter, which must be numbered one higher. Cursors in no chapter, or past the last, are left out.
    """
    starts = chapter_starts(maxima)
    follows = F.lead("chapter").over(Window.partitionBy("book").orderBy("chapter")) == F.col("chapter") + 1
    starts = starts.withColumn("__follows", F.coalesce(follows, F.lit(False)))
    joined = cursors.join(starts, ["book", "chapter"])
    within = F.col("chunk") <= F.col("max_chunk")
    start = F.when(within, F.col("start") + F.col("chunk")).when(F.col("__follows"), F.col("start") + F.col("max_chunk") + 1)
    return joined.select("user_id", "book", start.cast("long").alias("__start"), F.col("total").cast("long").alias("total")).where("__start is not null").withColumnRenamed("__start", "start")


def answered(requests: DataFrame, cache: DataFrame, count: int, size: int) -> DataFrame:
    """Each request (user_id, book, start, total) answered: returned, last, queue and trimmed.

    returned are the buffered ordinals from start on, up to the first gap or `count` of them, last is the last of those
    or start. queue is what to fetch, in order and without what is buffered: the missing of the `size` from last on, and if
    there are any what follows the last of those up to 2 * size in all; if start itself is missing also the 2 * size from
    there on. trimmed is how many buffered ordinals lie more than size / 2 before last. Requests and the buffer are read once and
    joined once; of a reader's buffer only a window of count + 4 * size ordinals is gathered, the rest is counted.
    """
    back = size // 2
    held = requests.join(cache.select("user_id", "book", F.col("ordinal").alias("__o")), ["user_id", "book"], "left")
    near = F.col("__o").between(F.col("start") - back, F.col("start") + count + 3 * size)
    rows = held.groupBy("user_id", "book", "start", "total").agg(F.sort_array(F.collect_set(F.when(near, F.col("__o")))).alias("__held"), F.count_if(F.col("__o") < F.col("start") - back).alias("__far"))
    upto = lambda first, n: F.when(first < F.col("total"), F.sequence(first, F.least(first + n, F.col("total")) - 1)).otherwise(F.array().cast("array<bigint>"))
    lacks = lambda c: F.array_except(c, F.col("__held"))
    wanted = upto(F.col("start"), count)
    gap = F.array_min(lacks(wanted))
    rows = rows.withColumn("returned", F.filter(wanted, lambda x: gap.isNull() | (x < gap)))
    rows = rows.withColumn("last", F.coalesce(F.array_max("returned"), F.col("start")))
    rows = rows.withColumn("__missing", lacks(upto(F.col("last"), size)))
    ahead = F.when(F.size("__missing") > 0, upto(F.array_max("__missing"), 2 * size)).otherwise(F.array().cast("array<bigint>"))
    first = F.when(F.size("returned") == 0, upto(F.col("start"), 2 * size)).otherwise(F.array().cast("array<bigint>"))
    queue = F.sort_array(lacks(F.array_union(F.array_union(F.col("__missing"), ahead), first)))
    trimmed = F.col("__far") + F.size(F.filter("__held", lambda x: x < F.col("last") - back)) if back else F.lit(0).cast("long")
    return rows.select("user_id", "book", "start", "returned", "last", queue.alias("queue"), trimmed.cast("long").alias("trimmed"))
