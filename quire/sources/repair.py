"""Containers without a contents file get one: entry rows in, entry rows out, and containers written from them."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import unescaped
from quire.sources.archives import integrity, kept, packages

#: The media type of a contents file, its name space, and the greatest length of a label in bytes.
NCX_MEDIA = "application/x-dtbncx+xml"
NCX_SPACE = "http://www.daisy.org/z3986/2005/ncx/"
MOST_LABEL = 99


def escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def contents_points(packed: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, position, label, href, error) of the contents to be: from the navigation document if there is one, else the spine.

    The spine's chapters are named by their number. error says what makes a point unfit: an item that isn't in the
    manifest, an empty label or one of 100 bytes or more, or an empty target.
    """
    items = packed.select("path", "opf_name", F.explode("opf.manifest.item").alias("i")).select("path", "opf_name", F.col("i._id").alias("item"), F.col("i._href").alias("href"))
    folder = F.regexp_extract("opf_name", r"^(.*/)[^/]*$", 1)
    navs = items.where(F.contains("item", F.lit("nav."))).groupBy("path").agg(F.min(F.concat(folder, "href")).alias("name"))
    navs = navs.join(entries.select("path", "name", F.col("data").cast("string").alias("x")), ["path", "name"])
    inner = F.regexp_extract("x", r"(?s)<nav\b[^>]*epub:type\s*=\s*[\"']toc[\"'][^>]*>(.*?)</nav>", 1)
    links = F.regexp_extract_all(inner, F.lit(r"(?s)<a\b[^>]*>.*?</a>"), 0)
    linked = navs.select("path", F.posexplode(links).alias("position", "a"))
    label = F.trim(F.regexp_replace(unescaped(F.regexp_replace("a", r"(?s)<[^>]*>", "")), r"\s+", " "))
    from_nav = linked.select("path", "position", label.alias("label"), F.url_decode(F.trim(unescaped(F.regexp_extract("a", r"href\s*=\s*[\"']([^\"']*)[\"']", 1)))).alias("href"), F.lit(True).alias("known"))
    refs = packed.select("path", F.posexplode("opf.spine.itemref").alias("position", "r")).select("path", "position", F.col("r._idref").alias("item"))
    refs = refs.join(navs.select("path"), "path", "left_anti").join(items.dropDuplicates(["path", "item"]).select("path", "item", "href"), ["path", "item"], "left")
    number = F.concat(F.lit("Chapter "), (F.col("position") + 1).cast("string"))
    from_spine = refs.select("path", "position", number.alias("label"), "href", F.col("href").isNotNull().alias("known"))
    size = F.octet_length("label")
    error = F.when(~F.col("known"), "no such item").when(size == 0, "empty label").when(size > MOST_LABEL, "label too long").when(F.coalesce("href", F.lit("")) == "", "empty target")
    return from_nav.unionByName(from_spine).select("path", "position", "label", "href", error.alias("error"))


def contents_text(points: DataFrame, titles: DataFrame) -> DataFrame:
    """(path, toc): the contents file of each book whose points are all fit; titles are (path, title)."""
    point = F.concat(
        F.lit('<navPoint id="navPoint-'), (F.col("position") + 1).cast("string"), F.lit('" playOrder="'), (F.col("position") + 1).cast("string"),
        F.lit('"><navLabel><text>'), escaped(F.col("label")), F.lit('</text></navLabel><content src="'), escaped(F.col("href")), F.lit('"/></navPoint>'),
    )
    rows = points.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", point.alias("x")))).alias("p"), F.bool_and(F.col("error").isNull()).alias("fit"))
    title = escaped(F.coalesce("title", F.lit("")))
    body = F.concat(F.lit(f'<ncx xmlns="{NCX_SPACE}"><head/><docTitle><text>'), title, F.lit("</text></docTitle><navMap>"), F.array_join(F.transform("p", lambda x: x["x"]), ""), F.lit("</navMap></ncx>"))
    return rows.where("fit").join(titles.select("path", "title"), "path", "left").select("path", body.alias("toc"))


def package_patched(opf: Column, href: str = "toc.ncx") -> Column:
    """A package's text with an item "ncx" in its manifest, put in if it has none, and a spine that names it."""
    manifest = F.regexp_extract(opf, r"(?s)<manifest\b.*?</manifest>", 0)
    item = f'<item id="ncx" href="{href}" media-type="{NCX_MEDIA}"/>'
    with_item = F.when(manifest.rlike(r"<item\b[^>]*\bid\s*=\s*[\"']ncx[\"']"), opf).otherwise(F.regexp_replace(opf, r"</manifest>", item + "</manifest>"))
    named = F.regexp_replace(with_item, r"(<spine\b[^>]*?\btoc\s*=\s*)(?:\"[^\"]*\"|'[^']*'|[^\s/>]+)", '$1"ncx"')
    return F.regexp_replace(named, r"<spine\b(?![^>]*\btoc\s*=)([^>]*?)\s*(/?)>", '<spine$1 toc="ncx"$2>')


def repaired(entries: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """Entries with a generated contents file beside the package and the package patched; old ones are left out.

    Books without a package, or with a point that is unfit, come out as they are. packed are the entries' packages, if
    they are at hand.
    """
    packed = packages(entries) if packed is None else packed
    toc = contents_text(contents_points(packed, entries), packed.select("path", F.get("opf.metadata.dc:title", F.lit(0)).alias("title")))
    made = kept(packed.select("path", "opf_name").join(toc, "path"))
    joined = entries.join(made, "path", "left")
    is_package = F.coalesce(F.col("name") == F.col("opf_name"), F.lit(False))
    old_toc = F.col("toc").isNotNull() & F.contains("name", F.lit("toc.ncx"))
    patched = F.when(is_package, package_patched(F.col("data").cast("string")).cast("binary")).otherwise(F.col("data"))
    size = lambda c: F.octet_length(c).cast("long")
    stay = joined.where(~F.coalesce(old_toc, F.lit(False))).withColumn("data", patched)
    stay = stay.select("path", "ord", "name", F.when(is_package, size("data")).otherwise(F.col("size")).alias("size"), F.when(is_package, size("data")).otherwise(F.col("csize")).alias("csize"), "data", "error")
    last = entries.groupBy("path").agg((F.max("ord") + 1).alias("ord"))
    name = F.concat(F.regexp_extract("opf_name", r"^(.*/)[^/]*$", 1), F.lit("toc.ncx"))
    new = made.join(last, "path").select("path", "ord", name.alias("name"), size("toc").alias("size"), size("toc").alias("csize"), F.col("toc").cast("binary").alias("data"), F.lit(None).cast("string").alias("error"))
    return stay.unionByName(new)


def written(entries: DataFrame) -> DataFrame:
    """(path, content): a container of each book's entries in their order, stored without compression, in the book's own task."""

    def build(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for row in sorted(table.to_pylist(), key=lambda r: r["ord"]):
                z.writestr(zipfile.ZipInfo(row["name"], (1980, 1, 1, 0, 0, 0)), row["data"] or b"")
        return pa.table({"path": table.column("path").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return entries.where("name is not null").groupBy("path").applyInArrow(build, "path string, content binary")


def quarantined(entries: DataFrame) -> DataFrame:
    """(path, reason) of the books to be set aside: all that are unfit even after repair. A missing contents file alone is mended."""
    return integrity(kept(repaired(entries))).where("status <> 'ok'").select("path", F.concat(F.lit("Error in integrity: "), "path", F.lit(": "), "status").alias("reason"))
