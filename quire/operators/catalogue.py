"""Ranked search of titles in a catalogue: an inverted index of word parts with weights, and the best hits of each book.

A title is the set of its words' trigrams, so misspelt and reordered words still meet. A trigram weighs the more the fewer
entries have it; weights are whole numbers, so scores are the same however sums are split. Two titles are as alike as
the weight they share is of the weight that either has. Hits need at least `least` of that, which bounds the rarest
trigram that both share: it must be among the first of either's, rarest first, before too little weight is left. Only
those are posted. Each title is taken once, however many have it. Blocks of titles meet blocks of titles in a task,
which adds up what any two share of their postings and scores in full those that can still be hits; only each title's
best hits leave it, so neither shuffles nor memory grow with the number of pairs, though the additions do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.sources.folders import shared_dir

#: A code is a trigram's weight, followed by so many bits of its number.
WEIGHT = 48

#: Titles in a block at most, about, and parts that the books of one title are dealt into.
BLOCK, SALTS = 1 << 16, 8


def trigrams(title: Column) -> Column:
    """The distinct trigrams of a title's words, each word with two spaces before it and one behind."""
    words = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    parts = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def weights(catalogue: DataFrame) -> DataFrame:
    """(term, w, code): how much each trigram of the catalogue's titles (title, n: how many have it) weighs, and a row with a null term for those it hasn't.

    code is a number of the trigram's own that begins with its weight, so codes are ordered by weight. Kept in the shared folder, where codes stay what they are.
    """
    n = catalogue.agg(F.sum("n")).first()[0] or 0  # one number
    each = catalogue.select("n", F.explode(trigrams(F.col("title"))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    known = each.select("term", F.round(1000 * F.log(1 + n / F.col("df"))).cast("long").alias("w"))
    known = known.unionByName(catalogue.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"), F.round(1000 * F.log(F.lit(1.0 + n))).cast("long").alias("w")))
    return _kept(known.withColumn("code", F.shiftleft("w", WEIGHT) + F.monotonically_increasing_id()))


def _kept(rows: DataFrame) -> DataFrame:
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def _weight(code: Column) -> Column:
    return F.shiftright(code, WEIGHT)


def weighed(titles: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(key, title, total, terms, posted, rest) of distinct titles, and what other columns they have, kept: the weight of all their terms; the codes of those the catalogue has, heaviest first; how many of these are posted and what the others weigh.

    A term is posted as long as it and what follows weighs half as much as a hit needs; with so little left unposted, few pairs but hits pass for candidates.
    """
    rows = titles.select("*", F.explode(trigrams(F.col("title"))).alias("term"))
    other = F.broadcast(known.where("term is null").select(F.col("w").alias("__other")))  # one row
    rows = rows.join(known.where("term is not null"), "term", "left").crossJoin(other)
    held = rows.groupBy(*titles.columns).agg(F.sort_array(F.collect_list("code"), asc=False).alias("terms"), F.sum(F.coalesce("w", "__other")).alias("total"))
    weight = F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + _weight(x))
    zero = F.struct(weight.alias("left"), F.lit(0).alias("posted"))
    step = lambda a, x: F.when(a["left"] >= least / 2 * F.col("total"), F.struct((a["left"] - _weight(x)).alias("left"), (a["posted"] + 1).alias("posted"))).otherwise(a)
    held = held.withColumn("p", F.aggregate("terms", zero, step))
    return _kept(held.select(F.monotonically_increasing_id().alias("key"), *titles.columns, "total", "terms", F.col("p.posted").alias("posted"), F.col("p.left").alias("rest")))


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    """key, total, rest, posted of titles, and of their terms the codes and where each title's begin and end."""
    lists = t.column("terms").combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    return *(t.column(c).to_numpy() for c in ("key", "total", "rest", "posted")), lists.flatten().to_numpy(), bounds


def _near(least: float, most: int, by: pa.DataType):
    share = least / (1 + least) * (1 - 1e-9)  # of what both weigh, that hits share at least

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        """The best hits of a block of books' titles in one of the catalogue's, at most `most` for a title.

        What two titles share beyond what both have posted lies in the rest of the one whose postings end first. Those that
        may be hits by that are scored by all their terms.
        """
        out = {"key": [], "other": [], "score": [], "by": []}
        if a.num_rows and b.num_rows:
            key, total, rest, posted, code, bounds = _columns(a)
            other, total_b, rest_b, posted_b, code_b, bounds_b = _columns(b)
            first = b.column("by").combine_chunks()
            sizes, order = np.diff(bounds_b), np.argsort(pc.sort_indices(first).to_numpy())
            terms, held = np.unique(code_b, return_inverse=True)  # held: the places of the terms, title by title
            known, held, row = np.append(terms, -1), held.astype("int32"), np.repeat(np.arange(len(other), dtype="int32"), sizes)
            up = np.arange(len(held)) - bounds_b[row] < posted_b[row]
            holders, ends = row[up][np.argsort(held[up], kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(held[up], minlength=len(terms)))))
            need, shared, mark = total_b * share, np.empty(len(other)), np.zeros(len(terms) + 1, dtype="int64")
            for k in range(len(key)):
                own = code[bounds[k] : bounds[k + 1]]
                place, weight = np.searchsorted(terms, own), own >> WEIGHT
                place[known[place] != own] = len(terms)
                shared[:] = 0
                for p, w in zip(place[: posted[k]].tolist(), weight[: posted[k]].tolist(), strict=True):
                    if p < len(terms):
                        shared[holders[ends[p] : ends[p + 1]]] += w
                hits = np.flatnonzero((shared + np.maximum(rest_b, rest[k]) >= need + total[k] * share) & (shared > 0))
                if not len(hits):
                    continue
                mark[place], mark[-1] = weight, 0
                start, size = bounds_b[hits], sizes[hits]
                begin = np.cumsum(size) - size
                both = np.add.reduceat(mark[held[np.repeat(start - begin, size) + np.arange(size.sum())]], begin)
                mark[place] = 0
                score = both / (total[k] + total_b[hits] - both)
                best = np.lexsort((order[hits], -score))[:most]
                best = best[score[best] >= least]
                for c, x in (("key", np.full(len(best), key[k])), ("other", other[hits[best]]), ("score", score[best]), ("by", hits[best])):
                    out[c].append(x)
        if not out["key"]:
            return pa.table({c: pa.array([], kind) for c, kind in (("key", pa.int64()), ("other", pa.int64()), ("score", pa.float64()), ("by", by))})
        return pa.table({c: first.take(pa.array(np.concatenate(x))) if c == "by" else pa.array(np.concatenate(x)) for c, x in out.items()})

    return near


def _blocks(n: int) -> int:
    """Into how many blocks so many titles are dealt: none is of more than about BLOCK, and a few there are even of few titles."""
    return max(1, min(n >> 10, 4), -(-n // BLOCK))


def candidates(own: DataFrame, theirs: DataFrame, least: float, most: int = 5, by: str = "key") -> DataFrame:
    """(key, other, score, by): of each of the weighed titles `own` the best hits in each block of `theirs`, at most `most`; of equal ones those that come first `by` a column of theirs.

    Each block of the ones meets each of the others in a task; nothing but these hits comes out, so it is no more than `most` rows a title and block.
    """
    n, m = _blocks(own.count()), _blocks(theirs.count())
    block = lambda of, by: F.pmod(F.xxhash64("title"), F.lit(of)).cast("int").alias(by)
    every = lambda of, by: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(by)
    plain = lambda rows, *more: rows.select("key", "total", "rest", "posted", "terms", *more).repartition(8 * n * m, "i", "j")
    a, b = plain(own.where("posted > 0"), block(n, "i"), every(m, "j")), plain(theirs.where("posted > 0"), F.col(by).alias("by"), every(n, "i"), block(m, "j"))
    kind = b.schema["by"].dataType
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_near(least, most, to_arrow_type(kind)), f"key bigint, other bigint, score double, by {kind.simpleString()}")


def ranked(books: DataFrame, catalogue: DataFrame, id: str, entry: str, least: float = 0.3, most: int = 5) -> DataFrame:
    """(id, entry, score, rank): each book's best entries, at most `most` of them, none below `least`; of equal ones the smaller entry first.

    books have id and title, the catalogue has entry and title, both with a row per key. Titles without letters or digits, and null ones, find nothing.
    Titles are compared once, however many books or entries have them: of a title's entries only the first `most` can be among the best, and
    of titles only the best `most` by their first entries.
    """
    held = catalogue.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("first"))
    known = weights(held)
    own, theirs = weighed(books.select("title").distinct(), known, least), weighed(held.select("title", "first"), known, least)
    hits = candidates(own, theirs, least, most, "first")
    hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "by"))).where(F.col("__n") <= most).select("key", "other", "score")
    nth = F.row_number().over(Window.partitionBy("title").orderBy(entry))
    firsts = catalogue.select("title", entry).withColumn("__n", nth).where(F.col("__n") <= most).join(theirs.select("title", F.col("key").alias("other")), "title").select("other", entry)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), entry))
    best = hits.join(firsts, "other").select("key", entry, "score").withColumn("rank", rank).where(F.col("rank") <= most).join(own.select("key", "title"), "key")
    # many books may have one title, so the hits go out to salted rows
    best = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = books.select(id, "title", F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int").alias("__salt"))
    return rows.join(best, ["title", "__salt"]).select(id, entry, "score", "rank")


def searched(books: DataFrame, catalogue: DataFrame, id: str, entry: str, featured: str, least: float = 0.3, most: int = 5) -> DataFrame:
    """books with the entry that a search finds: of the best hits the first that is featured, else the first; null if there is none."""
    hits = ranked(books.select(id, "title"), catalogue.select(entry, "title"), id, entry, least, most).join(catalogue.select(entry, featured), entry)
    best = F.min_by(entry, F.struct(~F.coalesce(featured, F.lit(False)), "rank"))
    return books.join(hits.groupBy(id).agg(best.alias(entry)), id, "left")


def identified(books: DataFrame, catalogue: DataFrame, id: str, entry: str, featured: str, least: float = 0.3) -> DataFrame:
    """books (id, title, author) with the catalogue's entry and found_by: by title and author where these are equal, else by a search for the title up to a bracket.

    catalogue: entry, title, author and whether it is featured. Of several entries with title and author the least is taken.
    """
    exact = catalogue.groupBy("title", "author").agg(F.min(entry).alias("__exact"))
    known = books.join(exact, ["title", "author"], "left")
    missed = known.where(F.col("__exact").isNull()).select(id, F.trim(F.split_part("title", F.lit(" ("), F.lit(1))).alias("title"))
    found = searched(missed, catalogue, id, entry, featured, least).select(id, F.col(entry).alias("__found"))
    joined = known.join(found, id, "left")
    by = F.when(F.col("__exact").isNotNull(), "title and author").when(F.col("__found").isNotNull(), "search").otherwise("none")
    return joined.select(*books.columns, F.coalesce("__exact", "__found").alias(entry), by.alias("found_by"))
