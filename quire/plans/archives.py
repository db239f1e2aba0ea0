"""Queries over book containers: books are built from the conversations, packed, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.names import content_type
from quire.functions.text import linear
from quire.operators import validation
from quire.plans.bindings import chapters
from quire.sources import archives as A
from quire.sources import assembly
from quire.sources import book_files as B
from quire.sources import repair as R
from quire.sources.folders import run_folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def containers(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a book per conversation. By the last digit of their number some are broken: 3 cut in half, 4 no container at all."""
    html = F.concat(F.lit("<p>"), F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    rows = chapters(spark, d).select("book", "chapter", F.concat(F.lit("Turn "), F.col("chapter").cast("string")).alias("title"), html.alias("html"))
    kind, whole = F.col("book") % 10, F.col("content")
    half = F.call_function("substring", whole, F.lit(1), (F.octet_length(whole) / 2).cast("int"))
    content = F.when(kind == 3, half).when(kind == 4, F.lit("no container").cast("binary")).otherwise(whole)
    return A.build_books(rows).select(F.col("book").cast("string").alias("path"), content.alias("content"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of those books, unzipped once. Some more are broken: 5 without contents, 6 without the first chapter's file; 7 lacks the pointer to its package."""
    found = A.zip_entries(containers(spark, d))
    kind, name = F.col("path").cast("long") % 10, F.coalesce("name", F.lit(""))
    gone = ((kind == 5) & F.endswith(name, F.lit(".ncx"))) | ((kind == 6) & F.endswith(name, F.lit("/c0.xhtml")))
    moved = F.when((kind == 7) & F.endswith(name, F.lit("container.xml")), "META-INF/other.xml").otherwise(F.col("name"))
    return A.kept(found.where(~gone).withColumn("name", moved))


def shelf(spark: SparkSession, d: str) -> str:
    """A new folder in which the books lie as files, in a folder per last digit. What ends in 8 isn't called a book, but a file to be converted, and what ends in 9 neither."""
    root = run_folder(spark, "shelf")
    kind = F.col("path").cast("long") % 10
    suffix = F.when(kind == 8, ".PDF").when(kind == 9, ".txt").otherwise(".epub")
    B.write_books(containers(spark, d).withColumn("path", F.concat(kind.cast("string"), F.lit("/"), "path", suffix)), root)
    return root


BOOKS = """books AS (SELECT conv_id::VARCHAR AS path, conv_id % 10 AS kind FROM conversations GROUP BY conv_id),
turns AS (SELECT conv_id::VARCHAR AS path, conv_id % 10 AS kind, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, replace(text, chr(10), ' ') AS text FROM conversations)"""


@query(f"WITH {BOOKS} SELECT path, kind NOT IN (3, 4) AS ok, CASE WHEN kind IN (3, 4) THEN 'entries,entry size,names,ratio,total size' ELSE '' END AS failed FROM books")
def zip_report(spark, d):
    return validation.verdicts(validation.container_checks(entries(spark, d)))


@query(f"""WITH {BOOKS} SELECT path, n AS position, 'c' || n AS item_id, 'OEBPS/text/c' || n || '.xhtml' AS name, CASE WHEN kind = 6 AND n = 0 THEN 'no such file' ELSE 'ok' END AS status FROM turns WHERE kind NOT IN (3, 4)""")
def opf_spine(spark, d):
    e = entries(spark, d)
    return A.spine(A.packages(e), e)


@query(f"""WITH {BOOKS} SELECT path, n AS position, n + 1 AS play_order, n + 2 AS number, 'Turn ' || turn AS title, 'OEBPS/text/c' || n || '.xhtml' AS name FROM turns WHERE kind NOT IN (3, 4, 5)""")
def ncx_nav(spark, d):
    return A.navigation(entries(spark, d))


@query(f"WITH {BOOKS} SELECT path, CASE WHEN kind IN (3, 4) THEN 'unreadable' WHEN kind IN (5, 6) THEN 'missing file' ELSE 'ok' END AS status FROM books")
def book_integrity(spark, d):
    return A.integrity(entries(spark, d))


@query(f"""WITH {BOOKS} SELECT path, n AS chapter, length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))::INT + 7 + length('<html><head><title>Turn ' || turn || '</title></head><body></body></html>')::INT AS n
  FROM turns WHERE kind NOT IN (3, 4) AND NOT (kind = 6 AND n = 0)""")
def chapter_markup(spark, d):
    return A.chapter_html(entries(spark, d)).select("path", "chapter", F.length("html").alias("n"))


@query(f"""WITH {BOOKS} SELECT path, n AS chapter, CASE WHEN trim(text) = '' THEN '' WHEN regexp_matches(text, '[.!? ]$') THEN text ELSE text || '. ' END AS text
  FROM turns WHERE kind NOT IN (3, 4) AND NOT (kind = 6 AND n = 0)""")
def chapter_linear(spark, d):
    """Containers all the way to readable text."""
    return A.chapter_html(entries(spark, d)).select("path", "chapter", linear(F.col("html")).alias("text"))


@query(f"WITH {BOOKS} SELECT path, 'Book ' || path AS title, 'Author ' || path AS author, 'Series' AS series, 1 AS series_order FROM books WHERE kind NOT IN (3, 4) UNION ALL SELECT path, NULL, NULL, NULL, NULL FROM books WHERE kind IN (3, 4)")
def book_titles(spark, d):
    return A.titles(entries(spark, d))


@query(f"WITH {BOOKS} SELECT path, 'OEBPS/cover.png' AS name, 'image/png' AS kind FROM books WHERE kind NOT IN (3, 4)")
def book_covers(spark, d):
    return A.covers(entries(spark, d)).select("path", "name", content_type(F.col("name")).alias("kind"))


@query(f"WITH {BOOKS} SELECT path, n AS position, 'Chapter ' || (n + 1) AS label, 'text/c' || n || '.xhtml' AS href, NULL::VARCHAR AS error FROM turns WHERE kind NOT IN (3, 4)")
def toc_points(spark, d):
    e = entries(spark, d)
    return R.contents_points(A.packages(e), e)


@query(f"WITH {BOOKS} SELECT path, CASE WHEN kind IN (3, 4) THEN 'unreadable' WHEN kind = 6 THEN 'missing file' ELSE 'ok' END AS status FROM books")
def toc_repair(spark, d):
    """Contents generated, containers written and read again: those that lacked nothing else are sound now."""
    e = entries(spark, d)
    unread = e.where("name is null")
    again = A.kept(A.zip_entries(R.written(R.repaired(e))))
    return A.integrity(again.unionByName(unread))


@query(f"WITH {BOOKS} SELECT path, 'Error in integrity: ' || path || ': ' || CASE WHEN kind = 6 THEN 'missing file' ELSE 'unreadable' END AS reason FROM books WHERE kind IN (3, 4, 6)")
def quarantine(spark, d):
    return R.quarantined(entries(spark, d))


@query("SELECT DISTINCT conv_id % 10 || '/' || conv_id || CASE conv_id % 10 WHEN 8 THEN '.PDF' WHEN 9 THEN '.txt' ELSE '.epub' END AS path, CASE conv_id % 10 WHEN 8 THEN 'needs conversion' WHEN 9 THEN 'skipped' ELSE 'book' END AS status FROM conversations")
def library_listing(spark, d):
    """Which of the files in a library's folders are books."""
    found = B.listed(spark, shelf(spark, d))
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "status")


SHELF = BOOKS + """,
files AS (SELECT kind || '/' || path || '.epub' AS file, path, kind FROM books WHERE kind < 8), lines AS (SELECT file, turns.* FROM turns JOIN files USING (path))"""


@query(f"""WITH {SHELF} SELECT file AS path, n AS position, 'c' || n AS item_id, 'OEBPS/text/c' || n || '.xhtml' AS name, 'ok' AS status FROM lines WHERE kind NOT IN (3, 4)""")
def spine_of_files(spark, d):
    """The reading order of books in files: directories are read, and of the entries only the pointers and the packages."""
    root = shelf(spark, d)
    opf = B.read_books(spark, root, names="*.opf,META-INF/container.xml")
    return A.spine(A.packages(opf), B.read_books(spark, root, data=False))


@query(f"""WITH {SHELF} SELECT file AS path, 'OEBPS/text/c' || n || '.xhtml' AS name, (n + 5)::INT AS ord FROM lines WHERE kind NOT IN (3, 4) AND n < 2""")
def first_chapters_of_files(spark, d):
    """The entries of the first two chapters, found by filters that reach the reader; the rest is never inflated."""
    found = B.read_books(spark, shelf(spark, d)).where(F.startswith("name", F.lit("OEBPS/text/")) & (F.col("ord") < 7)).where("name in ('OEBPS/text/c0.xhtml', 'OEBPS/text/c1.xhtml')")
    return found.where(F.contains(F.col("data").cast("string"), F.lit("<body>"))).select("path", "name", "ord")


@query("""WITH t AS (SELECT conv_id::VARCHAR AS path, conv_id % 10 = 9 AS broken, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n FROM conversations),
p AS (SELECT *, CASE WHEN NOT broken AND n % 4 > 0 THEN n - 1 END AS parent FROM t)
SELECT path, n AS position, (n % 4)::INT AS depth, parent, CASE WHEN NOT broken THEN CASE WHEN n % 4 > 0 THEN 0 ELSE n // 4 END END::INT AS place, 'Turn & ' || turn AS title, 'OEBPS/t' || n || '.xhtml' AS name,
  CASE WHEN NOT broken THEN array_to_string([x for x in list_transform(range(n - n % 4, n + 1), lambda i: 'Turn & ' || (turn - n + i))], ' / ') END AS trail, CASE WHEN broken THEN 'tags don''t fit' END AS error FROM p""")
def contents_tree(spark, d):
    """Contents whose points lie in each other, three deep and then back at the top; every tenth file lacks its last end tag."""
    rows = chapters(spark, d).select(F.col("book").cast("string").alias("path"), "chapter", (F.col("book") % 10 == 9).alias("hurt"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("chapter")) - 1
    point = F.concat(F.lit("<navPoint><navLabel><text>Turn &amp; "), F.col("chapter").cast("string"), F.lit('</text></navLabel><content src="t'), F.col("n").cast("string"), F.lit('.xhtml#x"/>'))
    shut = lambda k: F.repeat(F.lit("</navPoint>"), k)
    rows = rows.withColumn("n", n).withColumn("x", F.struct("n", F.concat(F.when((F.col("n") % 4 == 0) & (F.col("n") > 0), shut(F.lit(4))).otherwise(""), point).alias("t")))
    files = rows.groupBy("path", "hurt").agg(F.array_sort(F.collect_list("x")).alias("p"))
    left = (F.size("p") - 1) % 4 + 1
    body = F.concat(F.lit("<ncx><navMap>"), F.array_join(F.transform("p", lambda x: x["t"]), ""), shut(left - F.col("hurt").cast("int")), F.lit("</navMap></ncx>"))
    entries = files.select("path", F.lit(0).alias("ord"), F.lit("OEBPS/toc.ncx").alias("name"), body.cast("binary").alias("data"))
    return A.contents_tree(entries).withColumn("trail", F.array_join("trail", " / "))


@query(f"""WITH {SHELF}, n AS (SELECT path, count(*) AS n FROM turns GROUP BY path)
SELECT path || '.epub' AS path, (n + 5 - CASE kind WHEN 6 THEN 1 WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS n_entries, (n + 5 - CASE kind WHEN 6 THEN 1 WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS n_same FROM n JOIN books USING (path) WHERE kind NOT IN (3, 4)""")
def assembled_books(spark, d):
    """Sound books' entries packed in all tasks and written as files, then read again: as many entries, and as many with the same data."""
    e, root = entries(spark, d).where("name is not null").withColumn("path", F.concat("path", F.lit(".epub"))), run_folder(spark, "books")
    made = assembly.assembled(e, root)
    again = B.read_books(spark, root).select("path", "name", F.col("data").alias("again"))
    same = e.join(again, ["path", "name"]).groupBy("path").agg(F.count_if(F.col("data") == F.col("again")).alias("n_same"))
    return made.select("path", "n_entries").join(same, "path")
