"""Selectors over element tables against a walk over nested lists."""

import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.functions.text import linear
from quire.operators import elements as E

NAMES, CLASSES = ("div", "span", "ul", "b"), ("x", "y", "z")


def grown(r, depth=0):
    """A nested element (name, id, classes, attribute, children) of names whose end tags are all written."""
    children = [grown(r, depth + 1) for _ in range(r.choice((0, 1, 2, 3, 3)))] if depth < 4 else []
    return [r.choice(NAMES), r.choice((None, None, "one", "two")), r.sample(CLASSES, r.randint(0, 2)), r.choice((None, "v", "v w", "v-w")), children]


def said(e, r):
    name, id_, classes, attr, children = e
    given = (f" id='{id_}'" if id_ else "") + (f' class="{"  ".join(classes)}"' if classes else "") + (f" DATA = '{attr}'" if attr else "")
    return f"<{name}{given}>t{r.choice(('', '<br>', '<!-- <div> -->', '<img alt=\"a > b\">'))}" + "".join(said(c, r) for c in children) + f"</{name.upper()} >"


def walked(e, up=None, before=(), out=None):
    """(element, parent, earlier siblings), in order."""
    out = [] if out is None else out
    out.append((e, up, before))
    me = len(out) - 1
    for k, c in enumerate(e[4]):
        walked(c, me, tuple(id(x) for x in e[4][:k]), out)
    return out


def named(table, steps):
    """Indexes of what a selector (sign, test) names, by testing each element against the steps from the right."""
    at = {id(e): k for k, (e, _, _) in enumerate(table)}

    def holds(k, n):
        sign, test = steps[n]
        e, up, before = table[k]
        if not test(e, len(before)):
            return False
        if n == 0:
            return True
        if sign == ">":
            return up is not None and holds(up, n - 1)
        if sign == "+":
            return bool(before) and holds(at[before[-1]], n - 1)
        if sign == "~":
            return any(holds(at[x], n - 1) for x in before)
        while up is not None:
            if holds(up, n - 1):
                return True
            up = table[up][1]
        return False

    return {k for k in range(len(table)) if holds(k, len(steps) - 1)}


CASES = {
    "div.x.y": [("", lambda e, n: e[0] == "div" and {"x", "y"} <= set(e[2]))],
    "div > span": [("", lambda e, n: e[0] == "div"), (">", lambda e, n: e[0] == "span")],
    "#one .x": [("", lambda e, n: e[1] == "one"), (" ", lambda e, n: "x" in e[2])],
    "ul#two div span > b": [("", lambda e, n: e[:2] == ["ul", "two"]), (" ", lambda e, n: e[0] == "div"), (" ", lambda e, n: e[0] == "span"), (">", lambda e, n: e[0] == "b")],
    "div + span ~ b": [("", lambda e, n: e[0] == "div"), ("+", lambda e, n: e[0] == "span"), ("~", lambda e, n: e[0] == "b")],
    "*[data]": [("", lambda e, n: e[3] is not None)],
    "div[data=v] *": [("", lambda e, n: e[0] == "div" and e[3] == "v"), (" ", lambda e, n: True)],
    '[data~="w"]': [("", lambda e, n: e[3] == "v w")],
    "[data|='v']": [("", lambda e, n: e[3] in ("v", "v-w"))],
    "[data$=w]": [("", lambda e, n: (e[3] or "").endswith("w"))],
    "b:first-child": [("", lambda e, n: e[0] == "b" and n == 0)],
}


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(2)
    trees = [grown(r) for _ in range(40)]
    markup = [said(t, r) for t in trees]
    rows = spark.createDataFrame(list(enumerate(markup)), "page_id long, html string")
    return trees, markup, E.elements(rows).where("name not in ('br', 'img')").cache(), rows


def test_tree(forest):
    trees, markup, rows, _ = forest
    got = {}
    for x in rows.orderBy("page_id", "node").collect():
        got.setdefault(x["page_id"], []).append(x)
    for k, t in enumerate(trees):
        table = walked(t)
        assert [x["name"] for x in got[k]] == [e[0] for e, _, _ in table]
        number = {i: x["node"] for i, x in enumerate(got[k])}
        assert [x["parent"] for x in got[k]] == [None if up is None else number[up] for _, up, _ in table]
        for x in got[k]:
            assert markup[k][x["start"] :].startswith("<" + x["name"]) and markup[k][x["inner_stop"] : x["stop"]].lower().replace(" ", "") == f"</{x['name']}>"


@pytest.mark.parametrize("selector", CASES)
def test_selectors(forest, selector):
    trees, _, rows, _ = forest
    tables, nodes = [walked(t) for t in trees], {}
    if ":" in selector or "+" in selector:  # places count br and img as well
        nodes = None
    for x in rows.select("page_id", "node").orderBy("page_id", "node").collect():
        if nodes is not None:
            nodes.setdefault(x["page_id"], []).append(x["node"])
    got = sorted(map(tuple, E.chosen(rows, selector).select("page_id", "node").collect()))
    if nodes is not None:
        assert got == sorted((k, nodes[k][i]) for k, t in enumerate(tables) for i in named(t, CASES[selector]))
    both = E.chosen(rows, f"{selector}, {selector}").count()
    assert both == len(got)


def test_places(spark):
    """Siblings, where nothing stands between them."""
    r = random.Random(8)
    trees = [grown(r) for _ in range(30)]
    plain = lambda e: f"<{e[0]}>" + "".join(map(plain, e[4])) + f"</{e[0]}>"
    rows = E.elements(spark.createDataFrame([(k, plain(t)) for k, t in enumerate(trees)], "page_id long, html string")).cache()
    for selector in ("div + span ~ b", "b:first-child"):
        got = sorted(map(tuple, E.chosen(rows, selector).select("page_id", "node").collect()))
        assert got and got == sorted((k, i) for k, t in enumerate(trees) for i in named(walked(t), CASES[selector]))


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<div class=x>A<div>B</div>C</div>", [["div", 0, "A<div>B</div>C"], ["div", 1, "B"]]),
        ("<p>a<p>b<div>c</div>", [["p", 0, "a"], ["p", 0, "b"], ["div", 0, "c"]]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [["ul", 0, "<li>a<ul><li>b</ul><li>c"], ["li", 1, "a<ul><li>b</ul>"], ["ul", 2, "<li>b"], ["li", 3, "b"], ["li", 1, "c"]]),
        ("<table><tr><td>a<th>b</table>", [["table", 0, "<tr><td>a<th>b"], ["tbody", 1, "<tr><td>a<th>b"], ["tr", 2, "<td>a<th>b"], ["td", 3, "a"], ["th", 3, "b"]]),
        ("<table><tbody><tr><td><p>a</div></table>z", [["table", 0, "<tbody><tr><td><p>a</div>"], ["tbody", 1, "<tr><td><p>a</div>"], ["tr", 2, "<td><p>a</div>"], ["td", 3, "<p>a</div>"], ["p", 4, "a</div>"]]),
        ("<script>if (a<b) '</p>'</script><textarea><i>x</TEXTAREA>", [["script", 0, "if (a<b) '</p>'"], ["textarea", 0, "<i>x"]]),
        ("a</div><b>c<!-- </b> --><i", [["b", 0, "c<!-- </b> --><i"]]),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>a<option>b</select>", [["dl", 0, "<dt>a<dd>b<dt>c"], ["dt", 1, "a"], ["dd", 1, "b"], ["dt", 1, "c"], ["select", 0, "<option>a<option>b"], ["option", 1, "a"], ["option", 1, "b"]]),
        ("", []),
    ],
)
def test_ends_left_out(html, tree):
    assert [[x["name"], x["depth"], html[x["inner_start"] : x["inner_stop"]]] for x in E.tree(html)] == tree


def test_many_open_tags_are_quick():
    assert len(E.tree("<a" * 100_000)) == 0 and len(E.tree("<b>" * 20_000)) == 20_000


@pytest.mark.parametrize("selector", ["", " ", ">a", "a >", "a,,b", "a,", "a:hover", "..x", "a[b", "#", "a & b"])
def test_refused(selector):
    with pytest.raises(ValueError):
        E.steps(selector)


def test_the_sites_settings(spark):
    html = """<div class="col-md-5 col-lg-6 col-md-offset-1 text-center md-text-left"><h1>T &amp; u</h1><p><h1>no</h1></div>
<table id=chapters><thead><tr><th><a href=/no>x</a></thead><tr data-volume-id=1><td><a href=/1>1</a><td><a href=/1b>1b</a><tr data-volume-id=2><td><a href=/2>2</a><tr><td><a href=/3>3</a></table>
<div class="chapter-inner chapter-content">A<div>B</div><span>gone <span>too</span></span>C</div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    rows = E.elements(pages)
    title = E.first_of(E.chosen(rows, "div.col-md-5.col-lg-6.col-md-offset-1.text-center.md-text-left > h1"))
    assert [tuple(x) for x in E.with_markup(title, pages).select("outer", E.texts(F.col("inner"))).collect()] == [("<h1>T &amp; u</h1>", "T & u")]
    inside = E.below(rows, E.chosen(rows, "#chapters > tbody"), "page_id")
    assert sorted(x["href"] for x in E.row_links(inside, "tr", "data-volume-id", "1").collect()) == ["/1", "/1b"]
    assert sorted(x["href"] for x in E.row_links(inside, "tr").collect()) == ["/1", "/1b", "/2", "/3"]
    chapter = E.with_markup(E.chosen(rows, "div.chapter-inner.chapter-content"), pages).select("page_id", F.col("inner").alias("html"))
    assert E.removed(chapter, E.chosen(E.elements(chapter), "span")).first()["html"] == "A<div>B</div>C"
    assert {x["page_id"]: x["html"] for x in E.removed(pages, E.chosen(rows, "b")).collect()} == {1: html, 2: None, 3: ""}
    assert E.elements(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "found"),
    [
        ("<p>Rain &amp; <b>snow</b></p>\n<p>fell</p>", [("Rain & ", "p", 0), ("snow", "b", 7), ("fell", "p", 13)]),
        ("<!DOCTYPE html><title>no</title><div>It ended.<div>So</div></div>x<script>no</script><!-- no -->y", [("It ended.", "div", 0), ("So", "div", 9), ("x", None, 13), ("y", None, 14)]),
        ("a<textarea>&lt;<p></textarea><noscript>&lt;</noscript><svg><text>no</text></svg>", [("a", None, 0), ("<<p>", "textarea", 1), ("&lt;", "noscript", 5)]),
        ("<li>one<li>two </li>&nbsp;<script src=x />three", [("one", "li", 0), ("two ", "li", 5), ("three", None, 9)]),
        ("", []),
    ],
)
def test_spans(spark, html, found):
    rows = {r["node"]: r["name"] for r in E.tree(html)}
    got = E.spans(html)
    assert [(x["text"], rows.get(x["node"]), x["start"]) for x in got] == found
    whole = value_of(spark, html)
    assert all(whole[x["start"] : x["stop"]] == x["text"] for x in got)


def value_of(spark, html):
    return spark.createDataFrame([(html,)], "x string").select(linear(F.col("x"))).first()[0]


def test_spans_of_pages_make_their_linear_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    whole = {x["page_id"]: x["text"] for x in pages.select("page_id", linear(F.col("html")).alias("text")).collect()}
    made = {x["page_id"]: x["text"] for x in E.linear_from(E.text_spans(pages)).collect()}
    assert made.keys() == whole.keys() and all(whole[k] in (made[k], made[k] + ". ") for k in made)
    assert E.text_spans(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count() == 0


def test_open_references(spark):
    """&amp and the like without a semicolon: read as HTML reads them, or left alone."""
    html = "<h1>A &amp; B &amp</h1><p>&copy x &ampx; &lt;b&gt; &#65;&#66 &nosuch; &amp;amp</p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    for closed, text in ((False, "A & B &. © x &x; <b> AB &nosuch; &amp"), (True, "A & B &amp. &copy x &ampx; <b> A&#66 &nosuch; &amp")):
        assert pages.select(linear(F.col("html"), closed)).first()[0] == text + ". "
        assert E.linear_from(E.text_spans(pages, closed=closed)).first()["text"] == text
    rows = {name: __spark_entry__.queries()[name] for name in ("linearize_pages", "linear_spans")}
    with tempfile.TemporaryDirectory() as d:
        pages.write.parquet(f"{d}/pages.parquet")
        assert {name: f(spark, d).first()["text"].removesuffix(". ") for name, f in rows.items()} == dict.fromkeys(rows, text)
        assert rows["linear_spans"](spark, d).first()["sound"]


def test_pages_without_tag_or_text_have_no_linear_row(spark):
    """As in the SQL of linearize_pages; a page of tags alone has an empty text."""
    rows = [(1, None), (2, ""), (3, "<"), (4, "<<"), (5, "<p></p>"), (6, "<!-- -->"), (7, " \n"), (8, "a"), (9, "<p>b</p>")]
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
        found = __spark_entry__.queries()["linearize_pages"](spark, d).collect()
        sql = duckdb.sql(f"WITH pages AS (SELECT * FROM '{d}/pages.parquet/*.parquet') SELECT * FROM ({__spark_entry__.oracle_sql()['linearize_pages']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(sql) == [(5, ""), (6, ""), (7, ""), (8, "a"), (9, "b. ")]
