"""Queries that look books up in a catalogue, name their files and keep them in tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import catalogue as C
from quire.operators import library as L
from quire.plans.bindings import table
from quire.sources.folders import run_folder
from quire.sources.keyed_table import KeyedTable

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a catalogue: their titles, hosts as authors; every fourth is featured."""
    title, host = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("url", "^https?://([^/]*)", 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("entry"), title.alias("title"), host.alias("author"), (F.col("page_id") % 4 == 0).alias("featured"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The same titles as books have them: a third as they are, a third with a series in brackets, a third with the words the other way round and a letter less."""
    e, way = entries(spark, d), F.col("entry") % 3
    turned = F.concat_ws(" ", F.reverse(F.split("title", " ")))
    title = F.when(way == 0, F.col("title")).when(way == 1, F.concat("title", F.lit(" (Series, #1)"))).otherwise(F.concat(F.substring(turned, 1, 3), F.substring(turned, F.lit(5), F.length(turned))))
    return e.select(F.col("entry").alias("book"), title.alias("title"), "author")


_CATALOGUE = r"""e AS (SELECT page_id AS entry, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]*)', 1) AS author, page_id % 4 = 0 AS featured FROM pages),
b AS (SELECT entry AS book, author, CASE entry % 3 WHEN 0 THEN title WHEN 1 THEN title || ' (Series, #1)' ELSE r[:3] || r[5:] END AS title FROM (SELECT *, array_to_string(list_reverse(string_split(title, ' ')), ' ') AS r FROM e)),
t AS (SELECT 'e' AS kind, entry AS id, title FROM e UNION ALL SELECT 'b', book, trim(split_part(title, ' (', 1)) FROM b),
w AS (SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM t),
g AS (SELECT DISTINCT kind, id, substring('  ' || w || ' ', i, 3) AS g FROM (SELECT kind, id, w, unnest(range(1, length(w) + 2)) AS i FROM w)),
f AS (SELECT g, count(*) FILTER (kind = 'e') AS df FROM g GROUP BY g),
x AS MATERIALIZED (SELECT kind, id, g, round(1000 * ln(CASE WHEN df = 0 THEN 1 + (SELECT count(*) FROM e) ELSE 1 + (SELECT count(*) FROM e) / df END))::BIGINT AS w FROM g JOIN f USING (g)),
s AS (SELECT kind, id, sum(w) AS total FROM x GROUP BY ALL),
p AS (SELECT a.id AS book, c.id AS entry, sum(a.w) AS shared FROM x a JOIN x c ON a.kind = 'b' AND c.kind = 'e' AND a.g = c.g GROUP BY ALL),
h AS (SELECT book, entry, (shared::BIGINT)::DOUBLE / ((m.total + n.total - shared)::BIGINT)::DOUBLE AS score FROM p JOIN s m ON m.kind = 'b' AND m.id = book JOIN s n ON n.kind = 'e' AND n.id = entry),
k AS (SELECT book, entry, score, row_number() OVER (PARTITION BY book ORDER BY score DESC, entry) AS rank FROM h WHERE score >= 0.3),
r AS (SELECT * FROM k WHERE rank <= 5)"""


@query(f"WITH {_CATALOGUE} SELECT book, entry, score, rank::INT AS rank FROM r")
def catalogue_ranked(spark, d):
    """The five best entries for each title, misspelt, reordered or not."""
    books = asked(spark, d).withColumn("title", F.trim(F.split_part("title", F.lit(" ("), F.lit(1))))
    return C.ranked(books.select("book", "title"), entries(spark, d).select("entry", "title"), "book", "entry")


@query(f"""WITH {_CATALOGUE}, q AS (SELECT title, author, min(entry) AS entry FROM e GROUP BY ALL),
v AS (SELECT book, arg_min(entry, (CASE WHEN featured THEN 0 ELSE 1 END) * 10 + rank) AS entry FROM r JOIN e USING (entry) GROUP BY book)
SELECT book, coalesce(q.entry, v.entry) AS entry, CASE WHEN q.entry IS NOT NULL THEN 'title and author' WHEN v.entry IS NOT NULL THEN 'search' ELSE 'none' END AS found_by
  FROM b LEFT JOIN q ON q.title = b.title AND q.author = b.author LEFT JOIN v USING (book)""")
def catalogue_search(spark, d):
    """Each book's entry: by title and author, else by a search whose first featured hit counts, else its first."""
    return C.identified(asked(spark, d), entries(spark, d), "book", "entry", "featured").select("book", "entry", "found_by")


_ROUTED = """p AS (SELECT p_partkey, p_brand AS author, p_name AS title, p_partkey % 3 = 0 AS there FROM part),
f AS (SELECT author, title, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 7 END AS n FROM p WHERE there GROUP BY ALL)"""


@query(f"""WITH {_ROUTED}, m AS (SELECT *, row_number() OVER (PARTITION BY author, title ORDER BY p_partkey) AS k FROM p WHERE NOT there),
n AS (SELECT author, title, n, row_number() OVER (PARTITION BY author, title ORDER BY n) AS k FROM (SELECT author, title, unnest(range(0, 8 + (SELECT max(k) FROM m))) AS n FROM (SELECT DISTINCT author, title FROM m)) ANTI JOIN f USING (author, title, n))
SELECT p_partkey, author || '/' || title || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || '.epub' AS file FROM m JOIN n USING (author, title, k)""")
def routed_names(spark, d):
    """Files for two thirds of the parts, taken as books of an author, beside the files that the others have already."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("author"), F.col("p_name").alias("title"))
    n = F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_partkey") % 7)
    there = part.where("p_partkey % 3 = 0").select("author", F.concat("title", F.when(n == 0, "").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))), F.lit(".epub")).alias("file"))
    named = L.free_names(part.where("p_partkey % 3 <> 0"), there, ["author"], ["p_partkey"], "title", ".epub")
    return named.select("p_partkey", F.concat_ws("/", "author", "unique_name").alias("file"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'new name' ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 3 THEN -1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 = 3 THEN 'x' END AS note FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey + 10000000, c_name, NULL, 'y' FROM customer WHERE c_custkey % 50 = 0""")
def stored_upserts(spark, d):
    """Customers put into a table by key in files, some changed in part, some added, a segment deleted, and the table read."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    stored = KeyedTable(spark, run_folder(spark, "keyed"), ["c_custkey"], buckets=8)
    stored.upsert(customers)
    stored.upsert(customers.where("c_custkey % 10 = 3").select("c_custkey", F.lit("new name").alias("c_name"), F.lit(-1.0).alias("c_acctbal"), F.lit("x").alias("note")))
    stored.delete({"c_mktsegment": "BUILDING"})
    stored.upsert(customers.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", F.lit("y").alias("note")))
    return stored.read().select("c_custkey", "c_name", "c_acctbal", "note")
