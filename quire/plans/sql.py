"""Pieces of DuckDB SQL that several oracles share; they say independently what the library computes."""

TRIM = "' ' || chr(10) || chr(9) || chr(13)"


def words(x: str, most: int) -> str:
    white = r"[ \n\t\r]"
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '(?s){white}*(?:(.{{1,{most}}}\\z)|(.{{0,{most - 1}}}{white})|(.{{{most}}}))', 0),"
        f" lambda w: trim(w, {TRIM})), lambda w: w <> '')"
    )


def sentences(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).+?[.!?](?:[ \\t\\n\\f\\r]+|$)', 0)"


def chunk_list(x: str, target: int, most: int) -> str:
    """A list of chunks of the one-line text x, as a scalar expression over a subquery with columns t and ss."""
    flush = f"CASE WHEN trim(a.cur, {TRIM}) <> '' THEN list_append(a.done, trim(a.cur, {TRIM})) ELSE a.done END"
    fold = (
        "list_reduce(list_transform(ss, lambda s: {'done': []::VARCHAR[], 'cur': s}), lambda a, b: "
        f"CASE WHEN strlen(a.cur) + strlen(b.cur) <= {target} THEN {{'done': a.done, 'cur': a.cur || b.cur}} "
        f"WHEN strlen(b.cur) > {most} THEN {{'done': list_concat({flush}, {words('b.cur', most)}), 'cur': ''}} "
        f"ELSE {{'done': {flush}, 'cur': b.cur}} END, {{'done': []::VARCHAR[], 'cur': ''}})"
    )
    used = "coalesce(list_sum(list_transform(ss, lambda s: length(s))), 0)::BIGINT"
    return (
        f"(SELECT CASE WHEN trim(f.cur || substring(t, {used} + 1), {TRIM}) <> '' THEN list_append(f.done, trim(f.cur || substring(t, {used} + 1), {TRIM})) ELSE f.done END "
        f"FROM (SELECT t, ss, coalesce({fold}, {{'done': []::VARCHAR[], 'cur': ''}}) AS f FROM (SELECT {x} AS t, {sentences(x)} AS ss)))"
    )


CHUNKS = f"""
chapters AS (SELECT conv_id AS book, turn::INT AS chapter, replace(text, chr(10), ' ') AS text FROM conversations),
lists AS (SELECT book, chapter, {chunk_list('text', 200, 300)} AS l FROM chapters),
chunks AS (SELECT book, chapter, (i - 1)::INT AS chunk, l[i] AS chunk_text FROM (SELECT book, chapter, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
maxima AS (SELECT book, chapter, max(chunk) AS max_chunk FROM chunks GROUP BY ALL)"""

LOG = """
cursor_log AS (SELECT event_id, ts, user_id, event_id % (SELECT max(conv_id) + 1 FROM conversations) AS book,
  (json_extract_string(props, '$.k')::INT % 8)::INT AS chapter, (floor(value)::INT % 4)::INT AS chunk FROM events),
cursors AS (SELECT user_id, book, chapter, chunk FROM cursor_log QUALIFY row_number() OVER (PARTITION BY user_id, book ORDER BY ts DESC, event_id DESC) = 1)"""

ORDINALS = """
starts AS (SELECT book, chapter, max_chunk, coalesce(sum(max_chunk + 1) OVER (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  sum(max_chunk + 1) OVER (PARTITION BY book)::BIGINT AS total FROM maxima),
spine AS (SELECT c.book, c.chapter, c.chunk, s.start + c.chunk AS ordinal, s.total FROM chunks c JOIN starts s USING (book, chapter)),
requests AS (SELECT u.user_id, book, chapter, chunk, ordinal, total FROM cursors u JOIN spine USING (book, chapter, chunk))"""

CACHE = """
cache AS (SELECT u.user_id, book, ordinal FROM (SELECT user_id, book FROM cursors) u JOIN spine USING (book) WHERE ordinal % 7 <> 3)"""

BOOKS = """
books AS (SELECT doc_id AS id, text AS title, lang AS author_id, source AS series_id, doc_id AS series_order, doc_id AS saved FROM documents),
manifest AS (SELECT series_id, series_id AS series_name, min(id) AS first_book_id FROM books GROUP BY series_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "
