"""Where a snippet stands in a text: normal forms are compared, and the hit is mapped back to a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ChunkPolicy, chunk_spans, end_trimmed, entities_normalised, let, linear, search_form


def chunk_of(spans: Column, offset: Column) -> Column:
    """The number of the first span (start, stop) that holds the offset; 0 where none does."""
    hit = F.filter(F.transform(spans, lambda s, i: F.when((s["start"] <= offset) & (offset < s["stop"]), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(0))


def loosely(snippet: Column) -> Column:
    """A pattern of the snippet's letters and digits in either case, with anything else between them; of any one where it has none."""
    form = search_form(entities_normalised(snippet))
    return F.when(form == "", F.lit("[A-Za-z0-9]")).otherwise(F.concat(F.lit("(?i)"), F.regexp_replace(form, "(.)(?=.)", "$1[^A-Za-z0-9]*+")))


def located_all(rows: DataFrame, snippets: dict[str, Column], policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """rows (text, ...) once for each of the snippets, with `place` (its name), `status`, `position` and `chunk`.

    The text is linear, a snippet may have markup. It is made linear and its stops and spaces at the end are cut off.
    Status is "too short" if policy.snippet bytes of that are not left, "not found", or "found". References,
    punctuation, spaces and case are ignored on both sides. position is the 1-based character in the text, its
    references replaced, at which the snippet begins, chunk the number of the text's chunk that holds it; both are null
    unless it is found. A text is cut into chunks once for all its snippets, and only if one is found.
    """
    plain = {k: F.col(f"__plain{n}") for n, k in enumerate(snippets)}
    ready = rows.select("*", entities_normalised(F.col("text")).alias("__text"), *[end_trimmed(linear(c)).alias(f"__plain{n}") for n, c in enumerate(snippets.values())])
    short = lambda p: F.coalesce(F.octet_length(p) < policy.snippet, F.lit(True))
    place = lambda p: F.when(~short(p), F.nullif(F.regexp_instr("__text", loosely(p)), F.lit(0)))
    hits = F.array(*[F.struct(F.lit(k).alias("place"), short(p).alias("short"), place(p).alias("position")) for k, p in plain.items()])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def told(h: Column, spans: Column) -> Column:
        status = F.when(h["short"], "too short").when(h["position"].isNull(), "not found").otherwise("found")
        offset = F.octet_length(F.left("__text", h["position"] - 1))
        chunk = F.when(h["position"].isNotNull(), let(offset, lambda o: chunk_of(spans, o))).cast("int")
        return F.struct(h["place"].alias("place"), status.alias("status"), h["position"].alias("position"), chunk.alias("chunk"))

    def found(h: Column) -> Column:
        spans = F.when(F.exists(h, lambda x: x["position"].isNotNull()), chunk_spans(F.col("text"), policy)).otherwise(none)
        return let(spans, lambda s: F.transform(h, lambda x: told(x, s)))

    return ready.select(*rows.columns, F.inline(let(hits, found)))


def located(pairs: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """pairs (text, snippet, ...) with `status`, `position` and `chunk` of the one snippet; see located_all()."""
    return located_all(pairs, {"": F.col("snippet")}, policy).drop("place")


def chunks_at(offsets: DataFrame, spans: DataFrame, by: str = "book", width: int = 4096, salts: int = 8) -> DataFrame:
    """offsets (book, offset, ...) with the number `chunk` of their book's first span (start, stop, chunk) that holds them; 0 where none does.

    Books are cut into bins of `width`: a bin's spans stand in one row, which the offsets of that bin alone meet. So
    neither a long book nor one that everybody reads stands in one task; offsets of a bin are dealt into `salts` parts
    besides. Empty spans hold nothing. A null book or offset, or one of no known book, gets 0.
    """
    own = [c for c in offsets.columns if c != "chunk"]
    rows = offsets.select(*own).withColumn("__bin", F.floor(F.col("offset") / width)).withColumn("__salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    binned = spans.where("start < stop").select(by, F.struct("chunk", "start", "stop").alias("__s"), F.explode(bins).alias("__bin"))
    binned = binned.groupBy(by, "__bin").agg(F.array_sort(F.collect_list("__s")).alias("__spans"))  # as many as begin within a bin and one more, unless they overlap
    binned = binned.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(binned, [by, "__bin", "__salt"], "left")
    held = F.filter("__spans", lambda s: (s["start"] <= F.col("offset")) & (F.col("offset") < s["stop"]))
    return joined.select(*own, F.coalesce(F.get(held, F.lit(0))["chunk"], F.lit(0)).alias("chunk"))
