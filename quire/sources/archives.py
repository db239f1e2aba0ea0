"""Book containers: zip entries as rows, package and contents files parsed, containers built."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.names import first_image, path_normalised, play_order, series_position, without_fragment
from quire.functions.text import unescaped
from quire.operators.validation import MOST_ENTRIES, MOST_ENTRY, MOST_RATIO, MOST_TOTAL
from quire.sources.folders import shared_dir

ENTRIES = "path string, ord int, name string, size bigint, csize bigint, data binary, error string"

PACKAGE = """metadata STRUCT<meta: ARRAY<STRUCT<_name: STRING, _content: STRING>>, `dc:title`: ARRAY<STRING>, `dc:creator`: ARRAY<STRING>>,
manifest STRUCT<item: ARRAY<STRUCT<_id: STRING, _href: STRING, `_media-type`: STRING, _properties: STRING>>>,
spine STRUCT<_toc: STRING, itemref: ARRAY<STRUCT<_idref: STRING, _linear: STRING>>>,
guide STRUCT<reference: ARRAY<STRUCT<_type: STRING, _href: STRING>>>"""

#: Files are sorted into these by suffix; all others are skipped.
BOOK_SUFFIXES, CONVERTIBLE = ("epub",), ("pdf", "mobi", "azw", "azw3", "kfx")


def bounded(opened: zipfile.ZipFile, entry: zipfile.ZipInfo, most: int) -> bytes:
    """An entry's data, inflated in pieces. It is an error if it hasn't as many bytes as the directory says, or more than `most`: no more than that is ever inflated."""
    pieces, left = [], min(entry.file_size, most) + 1
    with opened.open(entry) as source:
        while left and (piece := source.read(min(left, 1 << 20))):
            pieces.append(piece)
            left -= len(piece)
    if left != 1:
        raise ValueError("not as much data as its size says")
    return b"".join(pieces)


def unpacked(path, source, wanted=None, data=True, most_entries=MOST_ENTRIES, most_total=MOST_TOTAL, most_entry=MOST_ENTRY, most_ratio=MOST_RATIO) -> Iterator[list[tuple]]:
    """A container's entries in archive order, as lists of rows of at most some megabytes; source is a file that can be sought in.

    Headers are read first, and only what keeps the limits is inflated: in a container with too many entries or bytes
    none is, else each entry but those too large or packed too tightly. Entries that are left out, damaged, encrypted or
    packed in an unknown way have no data but an error; a container that can't be opened is one row with an error. Of
    entries that aren't wanted there is no row, and without `data` nothing is inflated.
    """
    try:
        opened = zipfile.ZipFile(source)
        listed = opened.infolist()
    except Exception as e:  # whatever a damaged directory raises
        yield [(path, None, None, None, None, None, str(e) or type(e).__name__)]
        return
    over = len(listed) > most_entries or sum(i.file_size for i in listed) > most_total
    rows, held = [], 0
    for n, i in enumerate(listed):
        if wanted and not wanted({"path": path, "ord": n, "name": i.filename, "size": i.file_size, "csize": i.compress_size}):
            continue
        content, error = None, None
        if over or i.file_size > most_entry or (i.compress_size and i.file_size > most_ratio * i.compress_size):
            error = "over the limits"
        elif data:
            try:
                content = bounded(opened, i, most_entry)
            except Exception as e:
                error = str(e) or type(e).__name__
        rows.append((path, n, i.filename, i.file_size, i.compress_size, content, error))
        held += len(content or b"")
        if held > 8 << 20 or len(rows) > 1000:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def zip_entries(containers: DataFrame, most_entries=MOST_ENTRIES, most_total=MOST_TOTAL, most_entry=MOST_ENTRY, most_ratio=MOST_RATIO) -> DataFrame:
    """containers (path, content) to a row per entry in archive order; see unpacked()."""

    limits = (most_entries, most_total, most_entry, most_ratio)
    return containers.select("path", "content").mapInArrow(lambda batches: unpacked_batches(batches, limits), ENTRIES)


def unpacked_batches(batches: Iterator[pa.RecordBatch], limits: tuple) -> Iterator[pa.RecordBatch]:
    """Entry rows of batches (path, content): beside the Arrow batch only one container is held at a time."""
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            for rows in unpacked(path.as_py(), io.BytesIO(content.as_py() or b""), None, True, *limits):
                yield entry_rows(rows)


def entry_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = ["path", "ord", "name", "size", "csize", "data", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def kept(entries: DataFrame) -> DataFrame:
    """Entries unzipped once and kept in the shared folder, for all that is read from them."""
    shared_dir(entries.sparkSession)
    return entries.checkpoint()


def packages(entries: DataFrame) -> DataFrame:
    """(path, opf_name, opf): the package file that the container names, else the first *.opf; null opf_name if none.

    A rootfile counts if its media type is that of packages or its path ends in .opf. Only package files are parsed.
    """
    roots = F.regexp_extract_all(F.col("data").cast("string"), F.lit(r"(?s)<rootfile\b[^>]*>"), 0)
    full = lambda x: F.regexp_extract(x, r"full-path\s*=\s*[\"']([^\"']+)[\"']", 1)
    meant = F.filter(roots, lambda x: (full(x) != "") & (F.contains(x, F.lit("application/oebps-package+xml")) | F.endswith(F.lower(full(x)), F.lit(".opf"))))
    rooted = full(F.get(meant, F.lit(0)))
    named = entries.where(F.endswith("name", F.lit("META-INF/container.xml"))).groupBy("path").agg(F.first(F.when(rooted != "", rooted)).alias("opf_name"))
    first = entries.where(F.endswith(F.lower("name"), F.lit(".opf"))).groupBy("path").agg(F.min(F.struct("ord", "name"))["name"].alias("__first"))
    chosen = entries.select("path").distinct().join(named, "path", "left").join(first, "path", "left")
    chosen = chosen.select("path", F.coalesce("opf_name", "__first").alias("opf_name"))
    found = chosen.join(entries.select("path", F.col("name").alias("opf_name"), "data"), ["path", "opf_name"], "left")
    return found.select("path", "opf_name", F.from_xml(F.col("data").cast("string"), PACKAGE).alias("opf"))


def _beside(name: Column, href: Column) -> Column:
    """href as an entry name: relative to the folder of name."""
    folder = F.regexp_extract(name, r"^(.*/)[^/]*$", 1)
    return path_normalised(F.concat(folder, without_fragment(href)))


def manifest_items(packed: DataFrame) -> DataFrame:
    rows = packed.select("path", "opf_name", F.explode("opf.manifest.item").alias("i"))
    return rows.select("path", F.col("i._id").alias("item_id"), _beside(F.col("opf_name"), F.col("i._href")).alias("name"), F.col("i")["_media-type"].alias("media"), F.col("i._properties").alias("properties"))


def spine(packed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, position, item_id, name, status): the reading order without what is not linear, numbered without gaps."""
    refs = packed.select("path", F.filter("opf.spine.itemref", lambda r: F.coalesce(r["_linear"], F.lit("")) != "no").alias("refs"))
    rows = refs.select("path", F.posexplode("refs").alias("position", "r")).select("path", "position", F.col("r._idref").alias("item_id"))
    joined = rows.join(manifest_items(packed), ["path", "item_id"], "left")
    joined = joined.join(entries.select("path", "name", F.lit(True).alias("__there")), ["path", "name"], "left")
    status = F.when(F.col("name").isNull(), "no such item").when(F.col("__there").isNull(), "no such file").otherwise("ok")
    return joined.select("path", "position", "item_id", "name", status.alias("status"))


def navigation(entries: DataFrame) -> DataFrame:
    """(path, position, play_order, number, title, name) of the contents file's points, depth first as in the file.

    Points are cut at their start tags, so that one lacking a part doesn't shift those after it.
    """
    toc = entries.where(F.endswith(F.lower("name"), F.lit(".ncx"))).select("path", F.col("name").alias("toc"), F.col("data").cast("string").alias("t"))
    points = F.split("t", r"<navPoint\b")
    rows = toc.select("path", "toc", F.posexplode(points).alias("position", "p")).where("position > 0").withColumn("position", F.col("position") - 1)
    pick = lambda pattern: F.regexp_extract("p", pattern, 1)
    order = play_order(pick(r"^[^>]*playOrder\s*=\s*[\"']([^\"']*)[\"']"))
    title = F.trim(unescaped(F.regexp_replace(pick(r"(?s)<text\b[^>]*>(.*?)</text>"), r"(?s)<[^>]*>", "")))
    target = unescaped(pick(r"<content\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)[\"']"))
    return rows.select("path", "position", order.alias("play_order"), (order + 1).alias("number"), title.alias("title"), _beside(F.col("toc"), F.url_decode(target)).alias("name"))


def contents_tree(entries: DataFrame) -> DataFrame:
    """(path, position, depth, parent, place, title, name, trail, error) of the contents file's points, depth first as in the file.

    A point's depth is how many are open before its start tag: a running sum over start and end tags. Its parent is the
    last point before it that is one less deep. trail has the titles from the top down to the point. Where the tags don't
    fit each other, an end without a start or a start without an end, all of the file's points have an error, and neither
    parent nor trail.
    """
    toc = entries.where(F.endswith(F.lower("name"), F.lit(".ncx"))).select("path", F.col("name").alias("toc"), F.col("data").cast("string").alias("t"))
    bare = F.regexp_replace("t", r"(?s)<!--.*?(?:-->|\z)", "")
    parts = F.regexp_extract_all(bare, F.lit(r"(?s)</?(?:\w+:)?navPoint\b[^>]*>(?:(?!</?(?:\w+:)?navPoint\b).)*+"), 0)
    tags = toc.select("path", "toc", F.posexplode(parts).alias("k", "tag")).withColumn("step", F.when(F.startswith("tag", F.lit("</")), -1).when(F.col("tag").rlike(r"^[^>]*/>"), 0).otherwise(1))
    by = Window.partitionBy("path", "toc")
    tags = tags.withColumn("after", F.sum("step").over(by.orderBy("k"))).withColumn("broken", (F.min("after").over(by) < 0) | (F.sum("step").over(by) != 0))
    points = tags.where("step >= 0").withColumn("position", F.row_number().over(by.orderBy("k")) - 1).withColumn("depth", (F.col("after") - F.col("step")).cast("int"))
    pick = lambda pattern: F.regexp_extract("tag", pattern, 1)
    title = F.trim(F.regexp_replace(unescaped(F.regexp_replace(pick(r"(?s)<(?:\w+:)?text\b[^>]*>(.*?)</(?:\w+:)?text>"), r"(?s)<[^>]*>", "")), r"\s+", " "))
    target = unescaped(pick(r"<(?:\w+:)?content\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)[\"']"))
    points = points.select("path", "toc", "position", "depth", "broken", title.alias("title"), _beside(F.col("toc"), F.url_decode(target)).alias("name"))
    # a point is put among those of its own depth, and as a possible parent among those one deeper
    sides = F.array(F.struct(F.col("depth").alias("slot"), F.lit(None).cast("int").alias("above")), F.struct((F.col("depth") + 1).alias("slot"), F.col("position").alias("above")))
    before = Window.partitionBy("path", "toc", "slot").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    both = points.select("*", F.inline(sides)).withColumn("parent", F.max("above").over(before)).where("above is null").drop("slot", "above")
    fit = both.withColumn("parent", F.when(~F.col("broken"), F.col("parent"))).withColumn("error", F.when(F.col("broken"), "tags don't fit"))
    fit = kept(fit.withColumn("place", F.row_number().over(Window.partitionBy("path", "toc", "parent").orderBy("position")) - 1))
    deepest = fit.where(~F.col("broken")).agg(F.max("depth")).first()[0]
    level = fit.where(~F.col("broken") & (F.col("depth") == 0)).select("*", F.array("title").alias("trail"))
    all_ = fit.where("broken").select("*", F.lit(None).cast("array<string>").alias("trail")).unionByName(level)
    for depth in range(1, (deepest or 0) + 1):  # a join per depth, each over the points of that depth
        above = level.select("path", "toc", F.col("position").alias("parent"), F.col("trail").alias("__above"))
        level = fit.where(~F.col("broken") & (F.col("depth") == depth)).join(above, ["path", "toc", "parent"]).withColumn("trail", F.concat("__above", F.array("title"))).drop("__above")
        all_ = all_.unionByName(level)
    return all_.select("path", "position", "depth", "parent", F.when(F.col("error").isNull(), F.col("place")).alias("place"), "title", "name", "trail", "error")


def integrity(entries: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """(path, status): ok, toc missing, no package, empty spine, missing file, unknown item, bad toc, or unreadable. packed are the entries' packages, if they are at hand."""
    packed = packages(entries) if packed is None else packed
    paths = packed.select("path", F.col("opf_name").isNull().alias("no_package"), (F.coalesce(F.size("opf.spine.itemref"), F.lit(0)) <= 0).alias("empty"))
    broken = entries.groupBy("path").agg(F.bool_or(F.col("error").isNotNull()).alias("unreadable"))
    order = spine(packed, entries).groupBy("path").agg(F.bool_or(F.col("status") == "no such item").alias("unknown"))
    files = manifest_items(packed).join(entries.select("path", "name"), ["path", "name"], "left_anti").groupBy("path").agg(F.lit(True).alias("missing"))
    nav = navigation(entries)
    there = nav.join(entries.select("path", "name", F.lit(True).alias("__there")), ["path", "name"], "left")
    fair = (F.col("play_order") > 0) & F.octet_length("title").between(1, 100) & F.col("__there")
    checked = there.groupBy("path").agg(F.bool_and(F.coalesce(fair, F.lit(False))).alias("fair"))
    tocs = entries.where(F.endswith(F.lower("name"), F.lit(".ncx"))).select("path", F.lit(True).alias("toc")).distinct()
    all_ = paths
    for part in (broken, order, files, checked, tocs):
        all_ = all_.join(part, "path", "left")
    status = (
        F.when(F.col("unreadable"), "unreadable").when(F.col("no_package"), "no package").when(F.col("empty"), "empty spine").when(F.col("missing"), "missing file")
        .when(F.col("unknown"), "unknown item").when(F.col("toc").isNull(), "toc missing").when(~F.coalesce("fair", F.lit(False)), "bad toc").otherwise("ok")
    )
    return all_.select("path", status.alias("status"))


def chapter_html(entries: DataFrame) -> DataFrame:
    """(path, chapter, html) of all chapters in reading order."""
    rows = spine(packages(entries), entries).where("status = 'ok'")
    return rows.join(entries.select("path", "name", F.col("data").cast("string").alias("html")), ["path", "name"]).select("path", F.col("position").alias("chapter"), "html")


def styles(entries: DataFrame) -> DataFrame:
    """(path, css): all style sheets in archive order, a line break after each."""
    sheets = entries.where(F.endswith(F.lower("name"), F.lit(".css"))).select("path", "ord", F.col("data").cast("string").alias("css"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "css"))), lambda x: F.concat(x["css"], F.lit("\n")))
    return sheets.groupBy("path").agg(F.array_join(parts, "").alias("css"))


def covers(entries: DataFrame) -> DataFrame:
    """(path, name) of the cover: the item marked as such, the one the metadata name, the guide's page, else an image named cover."""
    packed = packages(entries)
    items = manifest_items(packed)
    image = F.startswith(F.coalesce("media", F.lit("")), F.lit("image/"))
    marked = items.where(F.contains(F.coalesce("properties", F.lit("")), F.lit("cover-image"))).select("path", F.lit(1).alias("rank"), "name")
    meta = packed.select("path", F.explode("opf.metadata.meta").alias("m")).where("m._name = 'cover'").select("path", F.col("m._content").alias("item_id"))
    named = meta.join(items.where(image), ["path", "item_id"]).select("path", F.lit(2).alias("rank"), "name")
    guide = packed.select("path", "opf_name", F.explode("opf.guide.reference").alias("g")).where("g._type = 'cover'")
    page = guide.select("path", _beside(F.col("opf_name"), F.col("g._href")).alias("page"))
    shown = first_image(F.col("data").cast("string"))
    shown = page.join(entries, (page["path"] == entries["path"]) & (page["page"] == entries["name"])).select(page["path"], F.lit(3).alias("rank"), _beside(F.col("page"), shown).alias("name"))
    guessed = items.where(image & F.contains(F.lower("name"), F.lit("cover"))).select("path", F.lit(4).alias("rank"), "name")
    found = marked.unionByName(named).unionByName(shown).unionByName(guessed)
    found = found.join(entries.select("path", "name"), ["path", "name"], "left_semi")
    return found.groupBy("path").agg(F.min(F.struct("rank", "name"))["name"].alias("name"))


def titles(entries: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """(path, title, author, series, series_order) from the package: the first title and author, and the library's series marks; null where there is none. packed as for integrity()."""
    packed = packages(entries) if packed is None else packed
    meta = lambda name: F.get(F.filter("opf.metadata.meta", lambda m: m["_name"] == name), F.lit(0))["_content"]
    return packed.select(
        "path", F.get("opf.metadata.dc:title", F.lit(0)).alias("title"), F.get("opf.metadata.dc:creator", F.lit(0)).alias("author"),
        meta("calibre:series").alias("series"), series_position(meta("calibre:series_index").try_cast("double")).alias("series_order"),
    )


def build_books(chapters: DataFrame) -> DataFrame:
    """chapters (book, chapter, title, html) to (book, content): a container per book, made in the book's own task."""
    from xml.sax.saxutils import escape

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["chapter", "title", "html"]).to_pylist(), key=lambda r: r["chapter"])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            add = lambda name, text: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
            add("mimetype", "application/epub+zip")
            add("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
            items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(rows)))
            refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(rows)))
            book = escape(str(table.column("book")[0].as_py()))
            meta = (
                f'<metadata><dc:title>Book {book}</dc:title><dc:creator>Author {book}</dc:creator><meta name="cover" content="cover"/>'
                '<meta name="calibre:series" content="Series"/><meta name="calibre:series_index" content="1.5"/></metadata>'
            )
            items += '<item id="cover" href="cover.png" media-type="image/png"/>'
            add("OEBPS/cover.png", "no picture")
            add("OEBPS/content.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>')
            points = "".join(
                f'<navPoint playOrder="{i + 1}"><navLabel><text>{escape(r["title"] or "")}</text></navLabel><content src="text/c{i}.xhtml"/></navPoint>' for i, r in enumerate(rows)
            )
            add("OEBPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
            for i, r in enumerate(rows):
                add(f"OEBPS/text/c{i}.xhtml", f"<html><head><title>{escape(r['title'] or '')}</title></head><body>{r['html']}</body></html>")
        return pa.table({"book": table.column("book").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return chapters.groupBy("book").applyInArrow(build, f"book {chapters.schema['book'].dataType.simpleString()}, content binary")
