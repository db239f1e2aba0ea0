"""Line dedup: sorted line hashes are streamed, and documents get back compressed bitmaps of the lines they lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, cut, is_heavy, let

MIN_CHARS = 20
MIN_DOCS = 3

#: Lines are counted in so many slots of their hashes first; only lines in crowded slots are counted by key.
SLOTS = 65536

STRIP = " \t\n\x0b\f\r"


def _keys(lines: Column, min_chars: int) -> Column:
    """A 128-bit hash per line, null where the key is shorter than min_chars code points."""

    def one(x: Column) -> Column:
        return let(
            F.btrim(x, F.lit(STRIP)),
            lambda k: F.when(
                F.length(k) >= min_chars,
                let(ascii_lower(k), lambda y: F.struct(F.xxhash64(y).alias("a"), F.xxhash64(F.lit("second"), y).alias("b"))),
            ),
        )

    return F.transform(lines, one)


def hashed_lines(docs: DataFrame, id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (64-bit hash of the whole text, to tell repeated ids apart: two texts of one id that share it share a bitmap), pos and key (a, b) of each keyed line."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.xxhash64(t).alias("row"),
        F.posexplode(_keys(F.split(t, "\n"), min_chars)).alias("pos", "key"),
    )
    return rows.where("key is not null").select("doc_id", "row", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))


def _heavy_keys(lines: DataFrame, total: int) -> DataFrame:
    """a, b, docs (documents that hold the key) and last (the largest doc_id) of each heavy key: fewer than HEAVY rows.

    A heavy key makes its slot heavy, so only the lines of heavy slots, fewer than HEAVY too, are counted by key. All
    counts are added up within tasks before they are shuffled.
    """
    slot = F.expr(f"pmod(a, {SLOTS})")
    crowded = lines.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(is_heavy(total)).select("slot")
    inside = lines.join(F.broadcast(crowded), slot == F.col("slot"), "left_semi")
    keys = inside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(is_heavy(total)).select("a", "b")
    once = lines.join(F.broadcast(cut(keys)), ["a", "b"]).select("a", "b", "doc_id", "row").distinct()
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


def drop_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document that loses lines: doc_id, row, and `words`, the sparse bitmap of the lines it loses.

    `words` is an array of (word, bits): 64 lines a word, words without a lost line left out. Only hashes, ids and
    positions are shuffled here.

    Line hashes are range-partitioned by key, sorted by key, document (the largest id first) and position, and streamed:
    a key's first document keeps its lines, the later ones lose theirs if there are min_docs. A key that holds more than a
    HEAVY-th of all lines would burden one task; those keys, fewer than HEAVY at any size, are counted within tasks
    instead, and their lines meet the broadcast counts where they are.
    """
    lines = cut(hashed_lines(docs, id, text, min_chars))
    heavy = cut(_heavy_keys(lines, lines.count()))
    others = lines.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti")
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    key = Window.partitionBy("a", "b")
    stream = others.repartitionByRange("a", "b").sortWithinPartitions("a", "b", *order, "pos").select(
        "*", F.first("doc_id").over(key.orderBy(*order)).alias("last"), F.dense_rank().over(key.orderBy(*order)).alias("nth")
    )
    judged = stream.withColumn("docs", F.max("nth").over(key)).select("doc_id", "row", "pos", "docs", "last")
    found = judged.unionByName(lines.join(F.broadcast(heavy), ["a", "b"]).select("doc_id", "row", "pos", "docs", "last"))
    lost = found.where((F.col("docs") >= min_docs) & (F.col("doc_id") < F.col("last"))).select("doc_id", "row", "pos").repartition("doc_id", "row")
    bits = lost.groupBy("doc_id", "row", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    return bits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def _kept(lines: Column, words: Column) -> Column:
    """The lines whose bit isn't set, joined again."""
    bits = F.map_from_entries(words)

    def lost(m: Column, i: Column) -> Column:
        word = F.try_element_at(m, F.call_function("div", i, F.lit(64)).cast("int"))
        return F.call_function("getbit", word, i % 64) == 1

    return let(bits, lambda m: F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(lost(m, i), F.lit(False))), "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `__kept` (the text without the lost lines), `__n_lines` and `__n_dropped`; no other change.

    bitmaps has at most one row a document, and meets the texts by one sort-merge join at every size.
    """
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("words").alias("__words")).hint("merge")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    joined = docs.join(marks, (F.col(f"`{id}`") == F.col("__id")) & (F.xxhash64(t) == F.col("__row")), "left")
    lines = F.split(t, "\n")
    dropped = F.aggregate("__words", F.lit(0), lambda n, w: n + F.bit_count(w["bits"]))
    return joined.withColumns(
        {
            "__n_lines": F.size(lines).cast("long"),
            "__n_dropped": F.coalesce(dropped, F.lit(0)).cast("long"),
            "__kept": F.when(F.col("__words").isNull(), t).otherwise(_kept(lines, F.col("__words"))),
        }
    )


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""One row per document: doc_id, n_lines, n_dropped, kept_text and kept_sha256.

    Lines are split at \n. A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at
    least min_chars code points in at least min_docs documents keep their lines only in the largest doc_id that holds
    them: there all of them. Null or empty text is one empty line. Rows with equal doc_id and text count as one document and
    are treated alike; rows with equal doc_id and different text count as two. A null id never is the largest: its
    lines stay. An empty table gives an empty result; columns besides id and text are not read.
    """
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    done = apply_bitmaps(own, drop_bitmaps(own, min_chars=min_chars, min_docs=min_docs))
    return done.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.col("__kept").alias("kept_text"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with the lost lines taken out of the text, and the length column brought up to date if there is one.

    Every row stays; a null text stays null. Nulls, ties, repeated rows and empty tables are as in line_dedup. Columns
    of any other name stay as they are.
    """
    done = apply_bitmaps(docs, drop_bitmaps(docs, id, text), id, text)
    hit = F.col("__n_dropped") > 0
    out = {text: F.when(hit, F.col("__kept")).otherwise(F.col(f"`{text}`"))}
    if chars in docs.columns:
        out[chars] = F.when(hit, F.length("__kept").cast(docs.schema[chars].dataType)).otherwise(F.col(f"`{chars}`"))
    return done.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
