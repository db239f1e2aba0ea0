"""Books, series and keyed tables: look-ups, roll-ups, and copy-on-write changes as DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.names import before_bracket, cover_path


def matching(table: DataFrame, wanted: dict) -> DataFrame:
    """Rows equal to all wanted values; all rows if none are wanted. Null equals nothing."""
    return table.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in wanted.items()])) if wanted else table


def without(table: DataFrame, unwanted: dict) -> DataFrame:
    """Rows but those equal to all unwanted values; an empty filter is refused."""
    if not unwanted:
        raise ValueError("a delete needs a filter")
    hit = reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in unwanted.items()])
    return table.where(~F.coalesce(hit, F.lit(False)))


def with_series(books: DataFrame, manifest: DataFrame) -> DataFrame:
    """books with series_name, empty where the series is unknown; a manifest has a row per series."""
    return books.join(manifest.select("series_id", "series_name"), "series_id", "left").withColumn("series_name", F.coalesce("series_name", F.lit("")))


def manifest(books: DataFrame) -> DataFrame:
    """A row per series: series_id, series_name (the id until renamed), first_book_id, the least order, earlier saved on ties."""
    first = F.min(F.struct("series_order", "saved", "id"))["id"]
    return books.groupBy("series_id").agg(first.alias("first_book_id")).select("series_id", F.col("series_id").alias("series_name"), "first_book_id")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], partial: bool = True) -> DataFrame:
    """table with changes, at most one a key, put in: supplied columns replaced if partial, else whole rows.

    Columns that only changes have are added and null elsewhere. Replacing whole rows leaves columns not supplied null.
    """
    extra = [c for c in changes.columns if c not in table.columns]
    old = table.select("*", *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in extra])
    if not partial:
        return old.join(changes, keys, "left_anti").unionByName(changes, allowMissingColumns=True)
    given = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__new"))
    joined = old.join(renamed, keys, "full")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])


def rename_series(manifest: DataFrame, series_id: str, name: str) -> DataFrame:
    """manifest with the series' new name; an error if there is no such series."""
    if not manifest.where(F.col("series_id") == series_id).limit(1).count():
        raise LookupError(f"no series {series_id}")
    return manifest.withColumn("series_name", F.when(F.col("series_id") == series_id, F.lit(name)).otherwise(F.col("series_name")))


def save_books(books: DataFrame, series: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, manifest) with new books put in by id; a series that is not there yet is added, others stay as they are."""
    first = manifest(new).join(series.select("series_id"), "series_id", "left_anti")
    return upsert(books, new, ["id"]), series.unionByName(first)


def cards(series: DataFrame) -> DataFrame:
    """What the library page shows of each series: name, path and the cover of its first book."""
    return series.select(F.col("series_name").alias("name"), F.concat(F.lit("/series/"), "series_id").alias("path"), cover_path(F.col("first_book_id")).alias("pic_path"))


def owned(rows: DataFrame, owner: Column, asking: Column) -> DataFrame:
    """Rows whose owner is the user that asks; a null is neither."""
    return rows.where(owner == asking)


def token_users(asked: DataFrame, tokens: DataFrame, fresh: Column) -> DataFrame:
    """asked (token, ...) with user_id of the token's user; null for unknown and expired tokens. tokens has a row per token."""
    valid = tokens.where(fresh).select("token", "user_id")
    return asked.join(valid, "token", "left")


def catalogued(books: DataFrame, catalogue: DataFrame, id: str, entry: str) -> DataFrame:
    """books (id, title, author) with the catalogue's entry: by title and author, else by the title up to a bracket alone; and found_by.

    Letter case doesn't matter. Of several entries the least is taken.
    """
    known = catalogue.select(F.lower("title").alias("__t"), F.lower("author").alias("__a"), F.col(entry).alias("__e"))
    exact = known.groupBy("__t", "__a").agg(F.min("__e").alias("__exact"))
    loose = known.groupBy("__t").agg(F.min("__e").alias("__loose"))
    found = books.join(exact, (F.lower("title") == F.col("__t")) & (F.lower("author") == F.col("__a")), "left").drop("__t", "__a")
    found = found.join(loose, F.lower(F.trim(before_bracket(F.col("title")))) == F.col("__t"), "left").drop("__t")
    by = F.when(F.col("__exact").isNotNull(), "title and author").when(F.col("__loose").isNotNull(), "search").otherwise("none")
    return found.select(*books.columns, F.coalesce("__exact", "__loose").alias(entry), by.alias("found_by"))


def drop_empty_series(manifest: DataFrame, books: DataFrame, unwanted: Column) -> DataFrame:
    """manifest without the unwanted series that have no book."""
    used = books.select("series_id").distinct().withColumn("__used", F.lit(True))
    joined = manifest.join(used, "series_id", "left")
    return joined.where(~unwanted | F.col("__used").isNotNull()).drop("__used")


def existing(books: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Books whose file is listed."""
    return books.join(files, key, "left_semi")


def numbered_names(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `unique_name`: the name, and " (n)" for the n-th further one of its keys."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)) - 1
    return rows.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def free_names(rows: DataFrame, taken: DataFrame, keys: list[str], order: list[str], name: str, suffix: str = "") -> DataFrame:
    """rows with `unique_name`: the name, or the first "name (n)" that neither a taken name nor an earlier row has.

    taken has the keys and `file`, names with the suffix. The r-th row of a name gets the r-th number that is free, 0 being
    the bare name. A taken number with k free ones before it shifts all rows from the k-th on by one: so numbers and rows
    are sorted together, by free numbers before them, and each row counts the taken numbers at or before its own.
    """
    body = F.when(F.endswith("file", F.lit(suffix)), F.left("file", F.length("file") - len(suffix)))
    numbered = F.regexp_extract(body, r"(?s)\A(.*) \(([1-9][0-9]{0,8})\)\z", 2)
    names = F.when(numbered != "", F.regexp_extract(body, r"(?s)\A(.*) \([1-9][0-9]*\)\z", 1))
    both = F.array(F.struct(body.alias(name), F.lit(0).alias("n")), F.struct(names.alias(name), numbered.try_cast("int").alias("n")))
    used = taken.select(*keys, F.inline(both)).where(F.col(name).isNotNull() & F.col("n").isNotNull()).distinct()
    own = Window.partitionBy(*keys, name)
    used = used.join(rows.select(*keys, name).distinct(), [*keys, name], "left_semi")
    shifts = used.withColumn("__at", F.col("n") - (F.row_number().over(own.orderBy("n")) - 1)).select(*keys, name, "__at", F.lit(None).alias("__row"))
    ranked = rows.withColumn("__at", F.row_number().over(own.orderBy(*order)) - 1).select(*keys, name, "__at", F.struct(*[c for c in rows.columns if c not in (*keys, name)]).alias("__row"))
    upto = own.orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shifts.unionByName(ranked, allowMissingColumns=True).withColumn("__n", F.col("__at") + F.count_if(F.col("__row").isNull()).over(upto)).where("__row is not null")
    unique = F.concat(F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))), F.lit(suffix))
    return placed.select(*[c if c in (*keys, name) else F.col("__row")[c].alias(c) for c in rows.columns], unique.alias("unique_name"))


def ranked_first(rows: DataFrame, keys: list[str], preferred: Column, order: list[str], value: str) -> DataFrame:
    """Per key the value of the first preferred row, else of the first."""
    best = F.min(F.struct((~preferred).alias("rank"), *order, value))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, F.col("__best")[value].alias(value))
