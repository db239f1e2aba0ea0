"""Mixing sources to target weights: how many copies of each document make each source's words come to its target.

Entropy balancing: of all rates with which the documents of a source give its target of words, those are taken that lie
nearest to one for all in relative entropy, none above `most`. They are exponentials of the documents' sizes,
min(most, exp(lambda * size / mean)), and lambda solves the convex dual. As each document has one source, the dual's
Hessian is diagonal, so each Newton step is one grouped sum over the documents' sizes, for all sources at once. Rates
are whole billionths and all sums are exact, so the same table gives the same mix however it is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WHITE, cut, join_by_count

#: Rates are counted in billionths.
UNIT = 1_000_000_000

#: Parts that the documents of one source and size are dealt into, so that no group of copies meets in one task.
PARTS = 1024

WHOLE = "decimal(38,0)"


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """The number of words; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def placed(sources: DataFrame) -> DataFrame:
    """sources with `place`, their number from 0 by code point, null last: numbered within ranges, plus what lies before each range."""
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id())
    ranked = cut(ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last()))))
    before, offsets = 0, [F.lit(0), F.lit(0)]
    for r, n in sorted(map(tuple, ranked.groupBy("__range").agg(F.max("__n")).collect())):  # a number for each partition
        offsets += [F.lit(r), F.lit(before)]
        before += n
    offset = F.create_map(*[x.cast("long") for x in offsets[2:] or offsets])[F.col("__range").cast("long")]
    return ranked.withColumn("place", F.col("__n") - 1 + offset).drop("__range", "__n")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources (source, source_size) with `target`: shares of all words by weights, which repeat in the order of the sources.

    What lies above `most` times a source's own size is shared out again by weight among the others until none is above.
    """
    rows = placed(sources)
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("weight", given.cast("long")).withColumn("cap", F.col("source_size") * most))
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, over = total or 0, F.lit(False)
    held = -1
    while weight:
        over = F.col("cap").cast(WHOLE) * weight < F.col("weight").cast(WHOLE) * rest
        full, share, n = rows.where(over).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
        if n == held:
            break
        held, rest, weight = n, total - full, rows.agg(F.sum("weight")).first()[0] - share
    share = F.lit(rest).cast("double") * F.col("weight") / F.lit(weight or 1)
    return rows.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _null_safe(source: Column) -> Column:
    """A key that is null for no source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def rate(most: int, tilt: str = "tilt") -> Column:
    """The rate of a size in whole billionths; all are `most` where the tilt is null, as the target is all that can be had."""
    power = F.col(tilt) * F.col("size") / F.col("mean")
    full = F.lit(most * UNIT).cast("long")
    return F.when(F.col(tilt).isNull() | (power >= F.log(F.lit(float(most)))), full).otherwise(F.least(full, F.floor(F.exp(power) * UNIT)))


def tilts(counts: DataFrame, goals: DataFrame, most: int = 3, tolerance: float = 1e-8, most_rounds: int = 60) -> DataFrame:
    """(key, tilt, mean): each source's lambda, by Newton steps on the logarithm of its words, kept between bounds that enclose it.

    counts: key, size, n, the documents of each size. goals: key, target, mean, cap and n, the rows of counts.
    The tilt is null where the target is `most` times the source's size, for which every rate is `most`.
    """
    total = counts.count()
    unknown = (F.col("target") > 0) & (F.col("target") < F.col("cap").cast("double"))
    first = F.when(F.col("target") <= 0, 0.0).when(unknown, F.log(F.col("target") * most / F.col("cap")))
    bound = F.lit(None).cast("double")
    state = cut(goals.select("key", "target", "mean", "n", first.alias("tilt"), bound.alias("low"), bound.alias("high"), (~unknown).alias("done")))
    for _ in range(most_rounds):
        if not state.where("not done").limit(1).count():
            return state.select("key", "tilt", "mean")
        r = rate(most)
        at = join_by_count(counts, state.where("not done").select("key", "tilt", "mean", F.col("n").alias("__n")), ["key"], total, n="__n").withColumn("r", r)
        words = F.col("n").cast(WHOLE) * F.col("size")
        inner = F.when(F.col("r") < most * UNIT, words * F.floor(F.col("r") * F.col("size") / F.col("mean")))
        sums = at.groupBy("key").agg(F.sum((words * F.col("r")).cast(WHOLE)).alias("s"), F.coalesce(F.sum(inner.cast(WHOLE)), F.lit(0)).alias("d"))
        now = state.join(sums.select("key", F.col("s").cast("double").alias("s"), F.col("d").cast("double").alias("d")).hint("merge"), "key", "left")
        goal = F.col("target") * UNIT
        above = F.col("s") > goal
        low, high = F.when(above, F.col("low")).otherwise(F.col("tilt")), F.when(above, F.col("tilt")).otherwise(F.col("high"))
        now = now.withColumn("low", F.when(F.col("done"), F.col("low")).otherwise(low)).withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
        step = F.when((F.col("d") > 0) & (F.col("s") > 0), F.col("tilt") - F.log(F.col("s") / goal) * F.col("s") / F.col("d"))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        middle = (F.coalesce("low", F.col("high") - 2 * F.abs("high") - 1) + F.coalesce("high", F.col("low") + 2 * F.abs("low") + 1)) / 2
        near = (F.abs(F.col("s") - goal) <= tolerance * goal) | (F.col("high") - F.col("low") <= 1e-13 * F.abs("high"))
        settled = F.col("done") | F.coalesce(near, F.lit(False))
        moved = now.withColumn("__done", settled).withColumn("tilt", F.when(F.col("__done"), F.col("tilt")).when(inside, step).otherwise(middle))
        state = cut(moved.select("key", "target", "mean", "n", "tilt", "low", "high", F.col("__done").alias("done")))
    raise RuntimeError(f"the rates did not settle in {most_rounds} rounds")


def _rounded(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, size, n, r, target) with `copies`, those that all n documents of a size make together.

    Per source from the largest size down, what one size is rounded by is made good with the next, so that the words of a
    source differ from its target by about half of its smallest documents. One number a source is carried along.
    """
    schema = "key string, size bigint, n bigint, copies bigint"

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owed = None, 0
        for batch in batches:
            copies = []
            for k, size, n, r in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "n", "r")), strict=True):
                if k != key:
                    key, owed = k, 0
                if size:
                    owed += n * size * r
                    c = min(max((2 * owed + size * UNIT) // (2 * size * UNIT), 0), most * n)
                    owed -= c * size * UNIT
                else:
                    c = n * r // UNIT
                copies.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), batch.column("n"), pa.array(copies, pa.int64())], names=["key", "size", "n", "copies"])

    ordered = rows.select("key", "size", "n", "r").repartition("key").sortWithinPartitions("key", F.desc("size"))
    return ordered.mapInArrow(carry, schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, text: str = "text") -> DataFrame:
    """A row per document: doc_id, source, size (words), source_size, target (words of its source in the mix), rate and copies.

    A source's copies have about its target of words; no document has more than `most` copies. Sources stand in the order
    of code points, null last, and take the weights in turn. Documents of one source and size are alike but for their
    ids: which of them get the odd copy is told by a hash of the id, so reruns agree. Null and empty texts have size 0,
    add nothing and have the rate one, or `most` where all of their source have. Repeated rows count as documents of their
    own; of rows with the same id it is open which gets the odd copy. An empty table gives an empty result; other
    columns of docs play no part.
    """
    if not weights or min(weights) < 1 or most < 1:
        raise ValueError("weights and the most copies are 1 at least")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    base = cut(docs.select("doc_id", "source", sizes(docs, text).alias("size")).select("*", _null_safe(F.col("source")).alias("key"), part.alias("part")))
    dealt = cut(base.groupBy("key", "source", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = cut(dealt.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
    sources = cut(counts.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum((F.col("n").cast(WHOLE) * F.col("size") * F.col("size")).cast(WHOLE)).alias("squares"), F.count(F.lit(1)).alias("rows")))
    goals = targets(sources.select("source", "source_size"), weights, most).withColumn("key", _null_safe(F.col("source")))
    goals = cut(goals.join(sources.select("key", "squares", F.col("rows").alias("n")).hint("merge"), "key"))
    mean = F.when(F.col("source_size") > 0, F.col("squares").cast("double") / F.col("source_size")).otherwise(1.0)
    goals = goals.select("key", "source_size", "target", mean.alias("mean"), (F.col("source_size") * most).alias("cap"), "n")
    total = counts.count()
    solved = tilts(counts.select("key", "size", "n"), goals, most)
    known = cut(goals.drop("mean").join(solved.hint("merge"), "key"))
    rated = cut(join_by_count(counts.select("key", "size", F.col("n").alias("docs")), known, ["key"], total).withColumn("r", rate(most)))
    made = _rounded(rated.select("key", "size", F.col("docs").alias("n"), "r"), most)
    made = rated.join(made.select("key", "size", "copies").hint("merge"), ["key", "size"])
    whole, odd = F.expr("copies div docs"), F.expr("copies % docs")
    made = made.select("key", "size", "source_size", "target", (F.col("r") / UNIT).alias("rate"), whole.alias("whole"), odd.alias("odd"))
    in_size = Window.partitionBy("key", "size").orderBy("part")
    before = dealt.select("key", "size", "part", (F.sum("n").over(in_size) - F.col("n")).alias("before"))
    given = before.join(made.hint("merge"), ["key", "size"])
    rows = base.join(given.hint("merge"), ["key", "size", "part"])
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    rows = rows.withColumn("__rank", rank + F.col("before"))
    copies = F.col("whole") + (F.col("__rank") <= F.col("odd")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
