"""Queries over the driver's tables: reading positions, windows, library changes; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import cursors as C
from quire.operators import library as L
from quire.operators import prefetch as P
from quire.operators.search import chunks_at
from quire.plans import bindings as B
from quire.plans.sql import BOOKS, CACHE, CHUNKS, LOG, ORDINALS, with_

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PROGRESS = """
totals AS (SELECT book, sum(max_chunk) AS w FROM maxima GROUP BY book),
before AS (SELECT u.user_id, u.book, coalesce(sum(m.max_chunk), 0) AS b FROM cursors u LEFT JOIN maxima m ON m.book = u.book AND m.chapter < u.chapter GROUP BY ALL)"""


@query(with_(CHUNKS, LOG, PROGRESS) + """SELECT user_id, book, chapter, chunk,
  (CASE WHEN w > 0 THEN least(1.0::DOUBLE, (b + chunk)::DOUBLE / w) ELSE 0.0::DOUBLE END)::FLOAT AS progress
  FROM cursors JOIN before USING (user_id, book) LEFT JOIN totals USING (book)""")
def book_progress(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: how far each reader is in each book."""
    return C.book_progress(B.cursors(spark, d), B.maxima(spark, d)).select("user_id", "book", "chapter", "chunk", "progress")


@query(with_(CHUNKS, LOG) + """SELECT user_id, book, chapter, chunk, (CASE WHEN max_chunk IS NULL THEN NULL WHEN max_chunk = 0 THEN 0.0
  ELSE least(1.0, chunk::DOUBLE / max_chunk) END)::FLOAT AS progress FROM cursors LEFT JOIN maxima USING (book, chapter)""")
def chapter_progress(spark, d):
    return C.chapter_progress(B.cursors(spark, d), B.maxima(spark, d)).select("user_id", "book", "chapter", "chunk", "progress")


@query(with_(LOG) + "SELECT * FROM cursors")
def latest_cursor(spark, d):
    return B.cursors(spark, d)


@query(with_(LOG) + """SELECT w.user_id, w.book, coalesce(c.chapter, 0)::INT AS chapter, coalesce(c.chunk, 0)::INT AS chunk
  FROM (SELECT user_id, book FROM cursor_log UNION SELECT user_id, book + 1 FROM cursor_log) w
  LEFT JOIN cursors c ON c.user_id = w.user_id AND c.book = w.book""")
def cursor_default_zero(spark, d):
    """Each reader's books, and the one after each of them, which may not have been opened yet."""
    seen = B.cursor_log(spark, d).select("user_id", F.explode(F.array("book", F.col("book") + 1)).alias("book")).distinct()
    return C.with_default(seen, B.cursors(spark, d))


@query(with_(CHUNKS, LOG) + "SELECT user_id, book, chapter, chunk, chunk_text FROM cursors JOIN chunks USING (book, chapter, chunk)")
def cursor_text(spark, d):
    return B.cursors(spark, d).join(B.text_chunks(spark, d), ["book", "chapter", "chunk"]).select("user_id", "book", "chapter", "chunk", "chunk_text")


@query(with_(CHUNKS) + """SELECT book, string_agg(chapter || ':' || max_chunk, ',' ORDER BY chapter) AS max_chunks, count(*) AS n_chapters FROM maxima GROUP BY book""")
def max_chunk_map(spark, d):
    m = C.max_map(B.maxima(spark, d))
    shown = F.array_join(F.transform(F.map_entries("max_chunks"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return m.select("book", shown.alias("max_chunks"), F.size(F.map_keys("max_chunks")).cast("long").alias("n_chapters"))


def _moved_sql(steps: int) -> str:
    return with_(CHUNKS, LOG, ORDINALS) + f"""SELECT r.user_id, r.book, r.chapter, r.chunk, s.chapter AS new_chapter, s.chunk AS new_chunk
  FROM requests r JOIN spine s ON s.book = r.book AND s.ordinal = greatest(0, least(r.total - 1, r.ordinal + ({steps})))"""


@query(_moved_sql(1))
def cursor_next(spark, d):
    return C.moved(B.cursors(spark, d), B.maxima(spark, d), 1)


@query(_moved_sql(-1))
def cursor_prev(spark, d):
    return C.moved(B.cursors(spark, d), B.maxima(spark, d), -1)


@query(_moved_sql(-5))
def step_back(spark, d):
    return C.moved(B.cursors(spark, d), B.maxima(spark, d), -5)


@query(with_(CHUNKS, LOG) + """, v AS (SELECT u.user_id, u.book, u.chapter, u.chunk, m.max_chunk, n.chapter AS nxt FROM cursors u
  LEFT JOIN maxima m ON m.book = u.book AND m.chapter = u.chapter LEFT JOIN maxima n ON n.book = u.book AND n.chapter = u.chapter + 1)
SELECT user_id, book, chapter, chunk, CASE WHEN chunk > max_chunk THEN nxt WHEN max_chunk IS NOT NULL THEN chapter END AS valid_chapter,
  CASE WHEN chunk > max_chunk THEN CASE WHEN nxt IS NOT NULL THEN 0 END WHEN max_chunk IS NOT NULL THEN chunk END AS valid_chunk,
  coalesce(CASE WHEN chunk > max_chunk THEN nxt IS NOT NULL ELSE max_chunk IS NOT NULL END, false) AS ok FROM v""".replace(", v AS", ", v AS", 1))
def validate_cursor(spark, d):
    out = C.validated(B.cursors(spark, d), B.maxima(spark, d))
    return out.select("user_id", "book", "chapter", "chunk", "valid_chapter", "valid_chunk", "ok")


HELD = """held AS (SELECT r.user_id, r.book, r.ordinal AS start, c.ordinal, c.ordinal - (row_number() OVER (PARTITION BY r.user_id, r.book ORDER BY c.ordinal) - 1) AS island
  FROM requests r JOIN cache c ON c.user_id = r.user_id AND c.book = r.book AND c.ordinal >= r.ordinal AND c.ordinal < r.ordinal + 10)"""
MISSING = """gaps AS (SELECT r.user_id, r.book, r.ordinal AS start, r.total, s.ordinal FROM requests r JOIN spine s ON s.book = r.book AND s.ordinal >= r.ordinal AND s.ordinal < r.ordinal + 10
  ANTI JOIN cache c ON c.user_id = r.user_id AND c.book = r.book AND c.ordinal = s.ordinal)"""


@query(with_(CHUNKS, LOG, ORDINALS, CACHE, HELD) + "SELECT user_id, book, start, ordinal FROM held WHERE island = start")
def contiguous_window(spark, d):
    return P.contiguous(*B.window(spark, d), 10).select("user_id", "book", "start", "ordinal")


@query(with_(CHUNKS, LOG, ORDINALS, CACHE, MISSING) + "SELECT user_id, book, start, ordinal FROM gaps")
def missing_cursors(spark, d):
    return P.missing(*B.window(spark, d), 10).select("user_id", "book", "start", "ordinal")


@query(with_(CHUNKS, LOG, ORDINALS, CACHE, MISSING, """queue AS (SELECT user_id, book, ordinal FROM gaps UNION SELECT g.user_id, g.book, s.ordinal
  FROM (SELECT user_id, book, max(ordinal) AS l FROM gaps GROUP BY ALL) g JOIN spine s ON s.book = g.book AND s.ordinal > g.l AND s.ordinal <= g.l + 20)""") + """
SELECT q.user_id, q.book, q.ordinal, (row_number() OVER (PARTITION BY q.user_id, q.book ORDER BY q.ordinal) - 1)::INT AS place
  FROM queue q ANTI JOIN cache c ON c.user_id = q.user_id AND c.book = q.book AND c.ordinal = q.ordinal""")
def prefetch_queue(spark, d):
    return P.fetch_queue(*B.window(spark, d), 10).select("user_id", "book", "ordinal", "place")


@query(with_(CHUNKS, LOG, ORDINALS, CACHE) + """SELECT c.user_id, c.book, c.ordinal FROM cache c LEFT JOIN requests r ON r.user_id = c.user_id AND r.book = c.book
  WHERE r.ordinal IS NULL OR c.ordinal >= greatest(r.ordinal - 5, 0)""")
def trim_cache(spark, d):
    requests, cache = B.window(spark, d)
    return P.trimmed(cache, requests, 5).select("user_id", "book", "ordinal")


@query(with_(CHUNKS, LOG, ORDINALS, CACHE) + """SELECT r.user_id, r.book, r.ordinal, count(c.ordinal) FILTER (c.ordinal > r.ordinal) AS n_ahead
  FROM requests r LEFT JOIN cache c ON c.user_id = r.user_id AND c.book = r.book GROUP BY ALL""")
def cursors_ahead(spark, d):
    return P.ahead(*B.window(spark, d))


@query(with_(LOG) + """SELECT event_id, user_id, chapter, coalesce(lag(chapter) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> chapter, false) AS changed FROM cursor_log""")
def chapter_change(spark, d):
    return C.chapter_changes(B.cursor_log(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "chapter", "changed")


@query(with_(LOG) + """SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM cursor_log)
  WHERE nxt IS NULL OR nxt > ts + INTERVAL 30 MINUTE""")
def debounce_last(spark, d):
    """The last of each run of events less than half an hour apart."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = B.cursor_log(spark, d).withColumn("__next", following)
    return rows.where(F.col("__next").isNull() | (F.col("__next") > F.col("ts") + F.expr("INTERVAL 30 MINUTES"))).select("event_id", "user_id", "ts")


@query("""WITH s AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
  SELECT user_id, seen, seen + INTERVAL 15 MINUTE >= now AS valid FROM s, n""")
def session_expiry(spark, d):
    events = B.table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    seen = events.groupBy("user_id").agg(F.max("ts").alias("seen")).crossJoin(F.broadcast(now))  # one row
    return seen.select("user_id", "seen", (F.col("seen") + F.expr("INTERVAL 15 MINUTES") >= F.col("now")).alias("valid"))


@query(with_(BOOKS) + "SELECT * FROM manifest")
def manifest(spark, d):
    return L.manifest(B.books(spark, d))


@query(with_(BOOKS) + "SELECT id, title, author_id, series_id, series_name, series_order FROM books JOIN manifest USING (series_id) WHERE series_id = 'src3' ORDER BY series_order, id")
def books_in_series(spark, d):
    books = B.books(spark, d)
    rows = L.with_series(L.matching(books, {"series_id": "src3"}), L.manifest(books))
    return rows.select("id", "title", "author_id", "series_id", "series_name", "series_order").orderBy("series_order", "id")


@query(with_(BOOKS) + "SELECT id, title, author_id, series_id, series_name, series_order FROM books JOIN manifest USING (series_id) WHERE id = 17")
def book_lookup(spark, d):
    books = B.books(spark, d)
    return L.with_series(L.matching(books, {"id": 17}), L.manifest(books)).select("id", "title", "author_id", "series_id", "series_name", "series_order")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src5'")
def multi_filter(spark, d):
    return L.matching(B.table(spark, d, "documents"), {"lang": "en", "source": "src5"}).select("doc_id", "lang", "source")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def order_filter(spark, d):
    return L.matching(B.table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "5-LOW"}).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT * FROM nation")
def full_scan(spark, d):
    return L.matching(B.table(spark, d, "nation"), {})


@query(with_(BOOKS) + "SELECT series_id, CASE WHEN series_id = 'src3' THEN 'The Third' ELSE series_name END AS series_name, first_book_id FROM manifest")
def series_rename(spark, d):
    return L.rename_series(L.manifest(B.books(spark, d)), "src3", "The Third")


@query(with_(BOOKS) + "SELECT '/series/' || series_id AS path, series_name AS name, '/api/v1/books/' || first_book_id || '/cover' AS pic_path FROM manifest")
def library_cards(spark, d):
    return L.cards(L.manifest(B.books(spark, d)))


@query(with_(BOOKS) + "SELECT series_id, series_name, first_book_id FROM manifest UNION ALL SELECT 'new', 'new', -1")
def save_book(spark, d):
    """A book of a series that is not there yet: the series comes with it."""
    books = B.books(spark, d)
    new = books.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("T").alias("title"), F.lit("en").alias("author_id"), F.lit("new").alias("series_id"), F.lit(0).cast("long").alias("series_order"), F.lit(0).cast("long").alias("saved"))
    return L.save_books(books, L.manifest(books), new)[1]


@query(with_(BOOKS) + "SELECT id, series_id FROM books WHERE id <> 17")
def delete_book(spark, d):
    return L.without(B.books(spark, d), {"id": 17}).select("id", "series_id")


@query("SELECT event_id, user_id FROM events WHERE user_id = event_id % 100")
def own_rows(spark, d):
    """Rows whose user is the one that asks."""
    return L.owned(B.table(spark, d, "events").withColumn("asking", F.col("event_id") % 100), F.col("user_id"), F.col("asking")).select("event_id", "user_id")


@query("""WITH t AS (SELECT 't' || c_custkey AS token, c_custkey AS user_id, c_acctbal > 0 AS fresh FROM customer), w AS (SELECT o_orderkey, 't' || o_custkey AS token FROM orders)
SELECT o_orderkey, CASE WHEN fresh THEN user_id END AS user_id FROM w LEFT JOIN t USING (token)""")
def token_user(spark, d):
    customer = B.table(spark, d, "customer")
    tokens = customer.select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("fresh"))
    asked = B.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("token"))
    return L.token_users(asked, tokens, F.col("fresh")).select("o_orderkey", "user_id")


@query(with_(CHUNKS) + "SELECT book, min(chapter) AS first_chapter FROM chunks GROUP BY book")
def first_chapter(spark, d):
    return B.text_chunks(spark, d).groupBy("book").agg(F.min("chapter").alias("first_chapter"))


@query("""WITH c AS (SELECT lower(p_name) AS t, lower(p_brand) AS a, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
n AS (SELECT lower(p_name) AS t, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL)
SELECT p_partkey, coalesce(c.id, n.id) AS match, CASE WHEN c.id IS NOT NULL THEN 'title and author' WHEN n.id IS NOT NULL THEN 'search' ELSE 'none' END AS found_by
  FROM part p LEFT JOIN c ON p.p_partkey % 3 <> 0 AND c.t = lower(p.p_name) AND c.a = lower(p.p_brand) LEFT JOIN n ON n.t = lower(p.p_name)""")
def catalogue_match(spark, d):
    """Parts stand for books and, but every third, for the catalogue; titles carry a series in brackets, which the search leaves out."""
    part = B.table(spark, d, "part")
    catalogue = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    books = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" (Series, #1)"))).otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("author"))
    return L.catalogued(books, catalogue, "p_partkey", "entry").select("p_partkey", F.col("entry").alias("match"), "found_by")


@query("SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(lang = 'de' AND source = 'src1', false)")
def delete_by_filter(spark, d):
    return L.without(B.table(spark, d, "documents").select("doc_id", "lang", "source"), {"lang": "de", "source": "src1"})


@query(with_(BOOKS) + "SELECT series_id, series_name, first_book_id FROM manifest WHERE series_id NOT LIKE 'src1%' OR series_id IN (SELECT series_id FROM books WHERE author_id <> 'en')")
def series_delete_guard(spark, d):
    books = B.books(spark, d)
    return L.drop_empty_series(L.manifest(books), books.where("author_id <> 'en'"), F.col("series_id").startswith("src1")).select("series_id", "series_name", "first_book_id")


@query("SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(spark, d):
    return C.latest(B.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT c_custkey + 1000000, NULL, NULL, c_acctbal, NULL FROM customer WHERE c_custkey % 50 = 0""")
def upsert_partial_columns(spark, d):
    customer = B.table(spark, d, "customer")
    changed = customer.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal"))
    added = customer.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_acctbal")
    return L.upsert(customer, changed.unionByName(added), ["c_custkey"])


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, upper(c_name), NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0""")
def upsert_whole_rows(spark, d):
    customer = B.table(spark, d, "customer")
    changed = customer.where("c_custkey % 5 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return L.upsert(customer, changed, ["c_custkey"], partial=False)


@query("SELECT source AS series_id, lang AS series_name, doc_id AS saved FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def manifest_dedup_first_wins(spark, d):
    rows = B.table(spark, d, "documents").select(F.col("source").alias("series_id"), F.col("lang").alias("series_name"), F.col("doc_id").alias("saved"))
    return L.first_wins(rows, ["series_id"], ["saved"])


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def orphan_validation(spark, d):
    return L.existing(B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), B.table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT p_brand, p_name AS best FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_type <> 'ECONOMY'), p_partkey) = 1""")
def ranked_fallback(spark, d):
    rows = B.table(spark, d, "part")
    return L.ranked_first(rows, ["p_brand"], F.col("p_type") == "ECONOMY", ["p_partkey"], "p_name").withColumnRenamed("p_name", "best")


@query("""SELECT p_partkey, p_brand, p_name, CASE WHEN n = 0 THEN p_name ELSE p_name || ' (' || n || ')' END AS unique_name
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS n FROM part)""")
def collision_suffix(spark, d):
    rows = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    return L.numbered_names(rows, ["p_brand"], ["p_partkey"], "p_name")


@query("""SELECT book, string_agg(text || chr(10), '' ORDER BY chapter) AS joined FROM (SELECT conv_id AS book, turn AS chapter, replace(text, chr(10), ' ') AS text FROM conversations) GROUP BY book""")
def css_concat(spark, d):
    """Parts of a book joined in order, a line break after each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
    return B.chapters(spark, d).groupBy("book").agg(F.array_join(parts, "").alias("joined"))


@query("""SELECT l_orderkey AS book, max(l_linenumber - 1)::INT AS max_chunk, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def position_maxima(spark, d):
    """Last positions at scale, over line items."""
    rows = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_linenumber") - 1).alias("chunk"))
    return rows.groupBy("book").agg(F.max("chunk").alias("max_chunk"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id AS book, row_number() OVER w - 1 AS chunk, coalesce(sum(strlen(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(strlen(text)) OVER w AS stop FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT event_id, user_id % (SELECT max(conv_id) + 1 FROM conversations) AS book, event_id * 7 % 3000 AS "offset" FROM events)
SELECT event_id, o.book, "offset", coalesce(t.chunk, 0)::INT AS chunk FROM o LEFT JOIN t ON t.book = o.book AND t.start <= "offset" AND "offset" < t.stop""")
def offsets_in_spans(spark, d):
    """Offsets of the event log, in the turns' spans that another table has; a few books have most of the offsets."""
    turns = B.table(spark, d, "conversations").select(F.col("conv_id").alias("book"), "turn", F.octet_length("text").cast("long").alias("n"))
    own = Window.partitionBy("book").orderBy("turn")
    spans = turns.select("book", (F.row_number().over(own) - 1).alias("chunk"), (F.sum("n").over(own) - F.col("n")).alias("start"), F.sum("n").over(own).alias("stop"))
    n = B.table(spark, d, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    log = B.table(spark, d, "events").crossJoin(F.broadcast(n))  # one row
    offsets = log.select("event_id", (F.col("user_id") % F.col("n")).alias("book"), (F.col("event_id") * 7 % 3000).alias("offset"))
    return chunks_at(offsets, spans, width=512)


#: The whole request, written row by row: each ordinal of a window is a row.
ANSWER = """raw AS (SELECT u.user_id, u.book, CASE WHEN u.chunk <= s.max_chunk THEN s.start + u.chunk WHEN n.chapter IS NOT NULL THEN n.start END AS start, s.total
  FROM cursors u JOIN starts s USING (book, chapter) LEFT JOIN starts n ON n.book = s.book AND n.chapter = s.chapter + 1),
req AS (SELECT * FROM raw WHERE start IS NOT NULL),
has AS (SELECT r.user_id, r.book, c.ordinal, c.ordinal - (row_number() OVER (PARTITION BY r.user_id, r.book ORDER BY c.ordinal) - 1) = r.start AS run FROM req r JOIN cache c ON c.user_id = r.user_id AND c.book = r.book AND c.ordinal >= r.start AND c.ordinal < r.start + 4),
run AS (SELECT r.*, coalesce(h.n, 0) AS n, r.start + greatest(coalesce(h.n, 0) - 1, 0) AS last FROM req r LEFT JOIN (SELECT user_id, book, count(*) FILTER (run) AS n FROM has GROUP BY ALL) h USING (user_id, book)),
miss AS (SELECT r.user_id, r.book, r.total, s.ordinal FROM run r JOIN spine s ON s.book = r.book AND s.ordinal >= r.last AND s.ordinal < r.last + 10 ANTI JOIN cache c ON c.user_id = r.user_id AND c.book = r.book AND c.ordinal = s.ordinal),
ahead AS (SELECT user_id, book, ordinal FROM miss UNION SELECT m.user_id, m.book, s.ordinal FROM (SELECT user_id, book, max(ordinal) AS l FROM miss GROUP BY ALL) m JOIN spine s ON s.book = m.book AND s.ordinal >= m.l AND s.ordinal < m.l + 20
  UNION SELECT r.user_id, r.book, s.ordinal FROM run r JOIN spine s ON r.n = 0 AND s.book = r.book AND s.ordinal >= r.start AND s.ordinal < r.start + 20),
q AS (SELECT user_id, book, count(*) AS n, min(ordinal) AS first, max(ordinal) AS final, sum(ordinal) AS total FROM (SELECT * FROM ahead ANTI JOIN cache USING (user_id, book, ordinal)) GROUP BY ALL),
cut AS (SELECT r.user_id, r.book, count(*) AS n FROM run r JOIN cache c ON c.user_id = r.user_id AND c.book = r.book AND c.ordinal < r.last - 5 GROUP BY ALL)"""


@query(with_(CHUNKS, LOG, ORDINALS, CACHE, ANSWER) + """SELECT r.user_id, r.book, r.start, r.n AS returned, r.last, coalesce(q.n, 0) AS queued, q.first, q.final, q.total::BIGINT AS queue_sum, coalesce(cut.n, 0) AS trimmed
  FROM run r LEFT JOIN q USING (user_id, book) LEFT JOIN cut USING (user_id, book)""")
def chunk_requests(spark, d):
    """The whole request for four chunks of each reader's cursor: validated, answered as far as there is no gap, what to fetch, what to forget."""
    cursors, most, cache = B.library_state(spark, d)
    got = P.answered(P.valid_requests(cursors, most), cache, 4, 10)
    queue = F.col("queue")
    return got.select(
        "user_id", "book", "start", F.size("returned").cast("long").alias("returned"), "last", F.size(queue).cast("long").alias("queued"), F.array_min(queue).alias("first"), F.array_max(queue).alias("final"),
        F.when(F.size(queue) > 0, F.aggregate(queue, F.lit(0).cast("long"), lambda a, x: a + x)).alias("queue_sum"), "trimmed",
    )
