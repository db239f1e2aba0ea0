"""Markup as a table of elements, and selectors as joins over it.

An element has its number in the page's order (`node`) and that of its last descendant (`last`), so one lies within
another if its number lies between theirs. A child step of a selector is a semi-join on the parent, a sibling step one on
the place among siblings, and a descendant step a running maximum of `last` in the order of `node`: a structural join by
one sort, that never pairs all elements of a page with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import BLOCKS, CLOSE_P, PLAIN, SKIPPED, TAG, closed_decoded, unescaped

#: Fixed values of HTML: elements without content, and elements whose content is text up to their own end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())

#: Fixed values of HTML: what a start tag ends, and within which elements that is looked for.
_CELLS, _ROWS = {"td", "th"}, {"tr", "td", "th"}
_SECTIONS = {"tbody", "thead", "tfoot", "caption", "colgroup"}
_TABLES = _ROWS | _SECTIONS | {"table"}
ENDS = (
    {name: ({"p"}, {"table", "td", "th", "caption", "button", "object"}) for name in CLOSE_P if name not in _TABLES - {"table"}}
    | {"li": ({"li", "p"}, {"ul", "ol", "menu", "dir"} | _CELLS), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"})}
    | {"option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "tr": (_ROWS | {"caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"})}
    | {name: (_CELLS, {"tr", "table"}) for name in _CELLS} | {name: (_ROWS | _SECTIONS, {"table"}) for name in _SECTIONS}
)

#: White space of which a text that isn't read may consist.
WHITE = " \t\n\v\f\r\u0085\u00a0"

_TOKEN = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]*+=[ \t\n\f\r]*+(?:\"[^\"]*+\"|'[^']*+'|))*+[^>=]*+)(>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

COLUMNS = "node int, last int, parent int, depth int, place int, name string, id string, classes array<string>, attributes map<string,string>, start int, inner_start int, inner_stop int, stop int"


def attributes(text: str) -> dict[str, str]:
    """A start tag's attributes by lower-case name; of several of one name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def tree(html: str, events: list[tuple] | None = None) -> list[dict]:
    """A page's elements in order. End tags that were left out are understood as HTML does; end tags of nothing open are passed over.

    A row directly in a table gets the table's body around it, of which no tag is written. Formatting that was left
    open ends with the element that it stands in. events, if given, gets in order (node, start, stop) of each text, with the
    element that it stands in, and (node,) where an element ends.
    """
    rows: list[dict] = []
    open_: list[dict] = []

    def begin(name: str, found: dict, start: int, inner: int) -> dict:
        up = open_[-1] if open_ else None
        row = {
            "node": len(rows), "last": len(rows), "parent": up and up["node"], "depth": len(open_), "place": up["n"] if up else top[0], "name": name, "id": found.get("id"),
            "classes": found.get("class", "").split(), "attributes": list(found.items()), "start": start, "inner_start": inner, "inner_stop": inner, "stop": inner, "n": 0,
        }
        if up:
            up["n"] += 1
        else:
            top[0] += 1
        rows.append(row)
        return row

    def close(n: int, inner: int, stop: int) -> None:
        """All that is open from the n-th on; only that one has the end tag."""
        while len(open_) > n:
            row = open_.pop()
            row |= {"last": len(rows) - 1, "inner_stop": inner, "stop": inner if len(open_) > n else stop}
            if events is not None:
                events.append((row["node"],))

    def text(start: int, stop: int) -> None:
        if events is not None and start < stop:
            events.append((open_[-1]["node"] if open_ else None, start, stop))

    def within(bounds: set) -> int:
        return next((k + 1 for k in range(len(open_) - 1, -1, -1) if open_[k]["name"] in bounds), 0)

    top, at = [0], 0
    while m := _TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        if not m[4]:  # a comment, or a tag that never ends
            continue
        name = m[2].lower()
        if m[1]:
            bounds = {"table"} if name in _TABLES else _TABLES - {"tr"} | {"button"}
            first = within(bounds - {name})
            n = next((k for k in range(len(open_) - 1, first - 1, -1) if open_[k]["name"] == name), None)
            if n is not None:
                close(n, m.start(), m.end())
            continue
        if name in ENDS:
            ended, bounds = ENDS[name]
            first = within(bounds)
            n = next((k for k in range(first, len(open_)) if open_[k]["name"] in ended), None)
            if n is not None:
                close(n, m.start(), m.start())
        if name == "tr" and open_ and open_[-1]["name"] == "table":
            open_.append(begin("tbody", {}, m.start(), m.start()))
        row = begin(name, attributes(m[3]), m.start(), m.end())
        if name in ("script", "style") and m[3].endswith("/"):
            continue  # such a tag shall not swallow what follows
        if name in RAW:
            end = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])[^>]*>").search(html, at)
            at = end.end() if end else len(html)
            row |= {"inner_stop": end.start() if end else at, "stop": at}
            open_.append(row)
            text(row["inner_start"], row["inner_stop"])
            open_.pop()
            if events is not None:
                events.append((row["node"],))
        elif name not in VOID:
            open_.append(row)
    text(at, len(html))
    close(0, len(html), len(html))
    return rows


def spans(html: str, closed: bool = False) -> list[dict]:
    """The readable texts of a page in order: where each stands in the page and where in the linear text, which is all of them with a full stop and a space where a block ends."""
    events: list[tuple] = []
    rows, out, at, last = tree(html, events), [], 0, ""
    skipped = []
    for r in rows:
        skipped.append(r["name"] in SKIPPED or (r["parent"] is not None and skipped[r["parent"]]))
    for e in events:
        if len(e) == 1:
            if rows[e[0]]["name"] in BLOCKS and not skipped[e[0]] and last and last not in ".!? ":
                at, last = at + 2, " "
            continue
        node, start, stop = e
        if node is not None and skipped[node]:
            continue
        said = html[start:stop]
        said = said if node is not None and rows[node]["name"] in PLAIN else (closed_decoded if closed else unescape)(said)
        if said.strip(WHITE):
            out.append({"n": len(out), "node": node, "source_start": start, "source_stop": stop, "start": at, "stop": at + len(said), "text": said.replace("\n", " ")})
            at, last = at + len(said), out[-1]["text"][-1]
    return out


SPANS = "n int, node int, source_start int, source_stop int, start int, stop int, text string"


def text_spans(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """A row per readable text of each page: the element it stands in, its place in the page (source_start, source_stop) and in the linear text (start, stop), in characters, and the text, references decoded.

    Texts of white space alone, and those of scripts, styles and what else isn't read, are left out. Between two texts the linear text has a full stop
    and a space where a block ends after anything but a stop or a space. A null or empty page has none. References are read as linear() reads them.
    """
    kind = pages.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SPANS.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = spans(batch.column(1)[k].as_py() or "", closed)
                if rows:
                    columns = [pa.array([r[c] for r in rows], pa.string() if c == "text" else pa.int32()) for c in names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), *columns], names=[key, *names])

    return pages.select(key, html).mapInArrow(look, f"`{key}` {kind}, {SPANS}")


def linear_from(spans: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text): the linear text put together from its spans; what ends a block after the last of them is not among them."""
    parts = F.array_sort(F.collect_list(F.struct("n", "start", "stop", "text")))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["text"], F.when(x["start"] > a["at"], ". ").otherwise(""), x["text"]).alias("text"), x["stop"].alias("at"))
    return spans.groupBy(key).agg(parts.alias("p")).select(key, F.aggregate("p", zero, step, lambda a: a["text"]).alias("text"))


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row per element of each page: the key, its numbers, name, id, classes and attributes, and where it and its inside begin and end.

    Places are characters of the page, counted from 0. A null or empty page has no elements. Repeated keys stand for one page:
    keep them apart beforehand.
    """
    kind = pages.schema[key].dataType

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [x.split(" ", 1)[0] for x in COLUMNS.split(", ")]
        types = {"classes": pa.list_(pa.string()), "attributes": pa.map_(pa.string(), pa.string()), "name": pa.string(), "id": pa.string()}
        for batch in batches:
            for k in range(batch.num_rows):
                rows = tree(batch.column(1)[k].as_py() or "")
                for a in range(0, len(rows), 5000):
                    part = rows[a : a + 5000]
                    columns = [pa.array([r[c] for r in part], types.get(c, pa.int32())) for c in wanted]
                    own = batch.column(0).take(pa.array([k] * len(part)))
                    yield pa.RecordBatch.from_arrays([own, *columns], names=[key, *[c for c in wanted]])

    return pages.select(key, html).mapInArrow(look, f"`{key}` {kind.simpleString()}, {COLUMNS}")


_STEP = re.compile(r"\s*([>+~,]|(?<=\S)\s(?=\s*[^\s>+~,]))?\s*")
_COMPOUND = re.compile(r"(?:\*|[A-Za-z][\w-]*)?(?:#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:[~^$*|]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:first-child|:nth-child\(\d+\))*")
_PART = re.compile(r"""(?P<name>^[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]|(?P<first>:first-child)|:nth-child\((?P<nth>\d+)\)""")


def steps(selector: str) -> list[list[tuple[str, str]]]:
    """Per alternative its steps from the left, each the sign before it and a compound such as div#a.b.c[d=e]."""
    out: list[list[tuple[str, str]]] = [[]]
    text, at = selector.strip(), 0
    while at < len(text):
        sign = _STEP.match(text, at)
        at, mark = sign.end(), (sign[1] or "").strip() or (" " if out[-1] else "")
        if mark == ",":
            if not out[-1]:
                break
            out.append([])
            mark = ""
        found = _COMPOUND.match(text, at)
        if not found or not found[0] or (mark in (">", "+", "~") and not out[-1]):
            raise ValueError(f"not a selector: {selector!r}, at {text[at:]!r}")
        out[-1].append((mark, found[0]))
        at = found.end()
    if not all(out):
        raise ValueError(f"not a selector: {selector!r}")
    return out


def fits(compound: str) -> Column:
    """Whether an element is what a compound says."""
    tests = [F.lit(True)]
    for p in _PART.finditer(compound):
        if p["name"]:
            tests.append(F.col("name") == p["name"].lower())
        elif p["id"]:
            tests.append(F.col("id") == p["id"])
        elif p["cls"]:
            tests.append(F.array_contains("classes", p["cls"]))
        elif p["attr"]:
            value, wanted = F.col("attributes")[p["attr"].lower()], next((p[k] for k in "abc" if p[k] is not None), None)
            tests.append({
                None: lambda v, w: v.isNotNull(), "=": lambda v, w: v == w, "^=": lambda v, w: F.startswith(v, F.lit(w)), "$=": lambda v, w: F.endswith(v, F.lit(w)),
                "*=": lambda v, w: F.contains(v, F.lit(w)), "~=": lambda v, w: F.array_contains(F.split(v, r"\s+"), w), "|=": lambda v, w: (v == w) | F.startswith(v, F.lit(w + "-")),
            }[p["op"]](value, wanted))
        else:
            tests.append(F.col("place") == (0 if p["first"] else int(p["nth"]) - 1))
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def below(found: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Rows of found that lie within a row of above: of those that begin before, one ends later."""
    both = above.select(key, "node", F.col("last").alias("__end"), F.lit(None).alias("__row")).unionByName(
        found.select(key, "node", F.lit(None).cast("int").alias("__end"), F.struct(*[c for c in found.columns if c not in (key, "node")]).alias("__row")), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("__until", F.max("__end").over(before)).where(F.col("__row").isNotNull() & (F.col("__until") >= F.col("node")))
    return held.select(*[c if c in (key, "node") else F.col("__row")[c].alias(c) for c in found.columns])


def chosen(rows: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The rows of an element table that a selector names, each once.

    Selectors have names, *, #ids, .classes, attributes ([a], [a=b], and with ~= ^= $= *= |=), :first-child and
    :nth-child(n), joined by white space (within), > (child), + (next sibling), ~ (later sibling), and commas. Anything else
    is refused with a ValueError.
    """
    found = []
    for alternative in steps(selector):
        held = rows.where(fits(alternative[0][1]))
        for sign, compound in alternative[1:]:
            next_ = rows.where(fits(compound))
            if sign == ">":
                held = next_.join(held.select(key, F.col("node").alias("parent")), [key, "parent"], "left_semi")
            elif sign == "+":
                held = next_.join(held.select(key, "parent", (F.col("place") + 1).alias("place")), [key, "parent", "place"], "left_semi")
            elif sign == "~":
                first = held.groupBy(key, "parent").agg(F.min("place").alias("__first"))
                held = next_.join(first, [key, "parent"]).where(F.col("place") > F.col("__first")).drop("__first")
            else:
                held = below(next_, held, key)
        found.append(held.select(*rows.columns))
    all_ = reduce(DataFrame.unionByName, found)
    return all_.dropDuplicates([key, "node"]) if len(found) > 1 else all_


def first_of(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Of each page's rows the first."""
    least = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "node").alias("__r"))
    return least.select(*[c if c == key else F.col("__r")[c].alias(c) for c in rows.columns])


def with_markup(rows: DataFrame, pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """rows with `outer` and `inner`, their markup as it stands in the page."""
    cut_out = lambda a, b: F.substring(F.col(html), F.col(a) + 1, F.col(b) - F.col(a))
    joined = rows.join(pages.select(key, html), key)
    return joined.select(*rows.columns, cut_out("start", "stop").alias("outer"), cut_out("inner_start", "inner_stop").alias("inner"))


def texts(inner: Column) -> Column:
    """The texts in markup, joined by a space and trimmed."""
    parts = F.split(F.regexp_replace(inner, r"(?s)<!--.*?(?:-->|\z)", ""), f"(?s){TAG}")
    return F.trim(unescaped(F.array_join(F.filter(parts, lambda x: x != ""), " ")))


def removed(pages: DataFrame, rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages with the markup of the given elements cut out; what lies within another goes with it."""
    spans = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        part = F.when(s["start"] > a["at"], F.substring(F.col(html), a["at"] + 1, s["start"] - a["at"])).otherwise("")
        return F.struct(F.concat(a["done"], part).alias("done"), F.greatest(a["at"], s["stop"]).alias("at"))

    joined = pages.join(spans, key, "left")
    rest = F.aggregate("__spans", zero, step, lambda a: F.concat(a["done"], F.substring(F.col(html), a["at"] + 1, F.length(html))))
    return joined.withColumn(html, F.when(F.col("__spans").isNotNull(), rest).otherwise(F.col(html))).select(*pages.columns)


def row_links(rows: DataFrame, row_selector: str, attribute: str | None = None, value: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, href): the distinct targets of links within the selected rows, of those alone that have the attribute with that value."""
    held = chosen(rows, row_selector, key)
    if attribute:
        held = held.where(F.col("attributes")[attribute] == F.lit(value))
    hrefs = below(rows.where(F.col("name") == "a"), held, key).select(key, F.col("attributes")["href"].alias("href"))
    return hrefs.where("href is not null").distinct()
