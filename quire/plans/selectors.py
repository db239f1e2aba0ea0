"""Queries over the elements of pages: the tree itself, and what selectors name in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import CLOSE_P
from quire.operators import elements as E
from quire.plans.bindings import table

QUERIES, SQL = {}, {}

#: A site as the scraper is told of it: where a chapter's text, its title and the list of chapters are, which attribute
#: marks a volume's rows, and what is taken out of the text.
SITE = {
    "chapter": "div.chapter-inner.chapter-content",
    "title": "div.col-5.center.title > h1",
    "book": "#chapters > tbody",
    "limiter": "data-volume-id",
    "row": "tr",
    "remover": ("span", "div.ad"),
}

SELECTORS = ("nav > ul li > a", "nav + div.ad ~ footer, article p b", "body > *", "li:first-child a[href^='/'], li:nth-child(3)")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CLOSERS = ", ".join(f"'{x}'" for x in CLOSE_P)

#: The tree of the pages there are, by a fold over tags: of what HTML lets be left out they lack only ends of paragraphs and of what stands in those.
TREE = rf"""t AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<!.*?>|<script.*?</script>|<style.*?</style>|<title.*?</title>|<[^>]*>') AS t FROM pages),
u AS (SELECT page_id, unnest(list_filter(t, lambda x: NOT starts_with(x, '<!'))) AS tag, generate_subscripts(list_filter(t, lambda x: NOT starts_with(x, '<!')), 1) AS i FROM t),
k AS MATERIALIZED (SELECT *, regexp_extract(tag, '^</?([a-z0-9]+)', 1) AS name, CASE WHEN regexp_matches(tag, '^<(script|style|title|meta|br|img|hr|link|input)\b') THEN 'v' WHEN starts_with(tag, '</') THEN 'e' ELSE 's' END AS kind FROM u),
r AS (SELECT page_id, 0::BIGINT AS i, 0 AS n, []::VARCHAR[] AS stack, []::INT[] AS nodes, []::INT[] AS ended, NULL::INT AS parent, 0 AS depth FROM pages
  UNION ALL SELECT page_id, i + 1, n + (kind <> 'e')::INT, CASE WHEN kind = 's' THEN list_append(stack[:keep], name) ELSE stack[:keep] END, CASE WHEN kind = 's' THEN list_append(nodes[:keep], n) ELSE nodes[:keep] END, nodes[keep + 1:],
  CASE WHEN keep > 0 THEN nodes[keep] END, keep FROM (SELECT r.*, k.kind, k.name, CASE WHEN kind = 'e' THEN CASE WHEN list_contains(stack, name) THEN len(stack) - list_position(list_reverse(stack), name) ELSE len(stack) END
    WHEN name IN ({_CLOSERS}) AND list_contains(stack, 'p') THEN list_position(stack, 'p') - 1 ELSE len(stack) END AS keep FROM r JOIN k ON k.page_id = r.page_id AND k.i = r.i + 1)),
ends AS (SELECT page_id, unnest(ended) AS node, n - (kind <> 'e')::INT - 1 AS last FROM r JOIN k USING (page_id, i)),
el AS MATERIALIZED (SELECT page_id, r.n - 1 AS node, CASE WHEN kind = 'v' THEN r.n - 1 ELSE coalesce(last, max(r.n) OVER (PARTITION BY page_id) - 1) END::INT AS last, parent, depth::INT AS depth,
  (row_number() OVER (PARTITION BY page_id, parent ORDER BY r.n) - 1)::INT AS place, name, tag FROM r JOIN k USING (page_id, i) LEFT JOIN ends ON ends.page_id = r.page_id AND ends.node = r.n - 1 WHERE kind <> 'e')"""


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query(f"WITH RECURSIVE {TREE} SELECT page_id, node, last, parent, depth, place, name FROM el")
def element_tree(spark, d):
    return E.elements(pages_of(spark, d)).select("page_id", "node", "last", "parent", "depth", "place", "name")


_INSIDE = "d.page_id = a.page_id AND a.node < d.node AND d.node <= a.last"


@query(f"""WITH RECURSIVE {TREE}, c AS (SELECT d.*, p.name AS pname, p.parent AS pparent FROM el d LEFT JOIN el p ON p.page_id = d.page_id AND p.node = d.parent),
s AS (SELECT 0 AS selector, c.page_id, c.node FROM c WHERE c.name = 'a' AND c.pname = 'li' AND EXISTS (SELECT 1 FROM c a WHERE a.name = 'ul' AND a.pname = 'nav' AND a.page_id = c.page_id AND a.node < c.parent AND c.parent <= a.last)
  UNION ALL SELECT 1, c.page_id, c.node FROM c WHERE c.name = 'footer' AND EXISTS (SELECT 1 FROM c a JOIN c b ON b.page_id = a.page_id AND b.parent = a.parent AND b.place = a.place - 1 WHERE a.page_id = c.page_id AND a.parent = c.parent AND a.place < c.place AND a.tag = '<div class="ad">' AND b.name = 'nav')
  UNION ALL SELECT 1, d.page_id, d.node FROM c d WHERE d.name = 'b' AND EXISTS (SELECT 1 FROM c a JOIN c e ON e.page_id = a.page_id AND e.node > a.node AND e.node <= a.last WHERE a.page_id = d.page_id AND a.name = 'article' AND e.name = 'p' AND e.node < d.node AND d.node <= e.last)
  UNION ALL SELECT 2, page_id, node FROM c WHERE pname = 'body'
  UNION ALL SELECT 3, d.page_id, d.node FROM c d WHERE d.name = 'a' AND d.tag LIKE '<a href="/%' AND EXISTS (SELECT 1 FROM c a WHERE {_INSIDE} AND a.name = 'li' AND a.place = 0)
  UNION ALL SELECT 3, page_id, node FROM c WHERE name = 'li' AND place = 2)
SELECT selector, page_id, node FROM s""")
def select_elements(spark, d):
    """Selectors with child, sibling and descendant steps, over all pages."""
    rows = E.elements(pages_of(spark, d))
    found = [E.chosen(rows, s).select(F.lit(k).alias("selector"), "page_id", "node") for k, s in enumerate(SELECTORS)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page as a site would show it: its heading in a titled box, its links as rows of volumes by turns, its article in a box with nested boxes, spans and an advert."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">'), 1)
    row = lambda x, i: F.concat(F.lit('<tr data-volume-id="'), (i % 2).cast("string"), F.lit('"><td><a href="'), x, F.lit('">c</a><td>now'))
    heading = F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1)
    article = F.regexp_extract(html, r"(?s)</h1>(.*?)</article>", 1)
    made = F.concat(
        F.lit('<body><div class="center col-5 x title"><h1>'), heading, F.lit("</h1></div><table class=list id=chapters>"), F.array_join(F.transform(links, row), ""),
        F.lit('</table><div class="chapter-content y chapter-inner"><div>before</div><span>by <span>me</span></span>'), article, F.lit('<div class="big ad"><div>buy</div></div>after</div></body>'),
    )
    return pages_of(spark, d).select("page_id", made.alias("html"))


@query(r"""SELECT page_id, h[x] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS x FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h FROM pages)) WHERE x % 2 = 0 GROUP BY ALL""")
def site_chapter_links(spark, d):
    """The links in the rows of the second volume, of the table that the site's settings name."""
    rows = E.elements(site_pages(spark, d))
    inside = E.below(rows, E.chosen(rows, SITE["book"]), "page_id")
    return E.row_links(inside, SITE["row"], SITE["limiter"], "1")


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title FROM pages""")
def site_titles(spark, d):
    pages = site_pages(spark, d)
    found = E.first_of(E.chosen(E.elements(pages), SITE["title"]))
    return E.with_markup(found, pages).select("page_id", F.col("inner").alias("title"))


@query(r"""SELECT page_id, '<div>before</div>' || regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) || 'after' AS chapter FROM pages""")
def site_chapters(spark, d):
    """The chapter's markup with what is to be removed cut out, nested boxes and all."""
    pages = site_pages(spark, d)
    rows = E.elements(pages)
    chapter = E.with_markup(E.first_of(E.chosen(rows, SITE["chapter"])), pages).select("page_id", F.col("inner").alias("html"))
    return E.removed(chapter, E.chosen(E.elements(chapter), ", ".join(SITE["remover"]))).select("page_id", F.col("html").alias("chapter"))
