"""Containers made here, whole and broken."""

import io
import os
import pathlib
import subprocess
import sys
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import validation as V
from quire.sources import archives as A
from quire.sources import repair as R


def container(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def book(**changes) -> dict[str, str]:
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "OEBPS/content.opf": '<package><manifest><item id="a" href="text/a.xhtml"/><item id="b" href="text/b.xhtml"/><item id="ncx" href="toc.ncx"/></manifest>'
        '<spine toc="ncx"><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OEBPS/toc.ncx": '<ncx><navMap><navPoint playOrder="1"><navLabel><text>One</text></navLabel><content src="text/a.xhtml#x"/>'
        '<navPoint playOrder="2"><navLabel><text>Two</text></navLabel><content src="text/b.xhtml"/></navPoint></navPoint></navMap></ncx>',
        "OEBPS/text/a.xhtml": "<html><body><p>A</p></body></html>",
        "OEBPS/text/b.xhtml": "<html><body><p>B</p></body></html>",
        "OEBPS/style.CSS": "p{}",
    }
    for old, new in changes.get("replace", []):
        files = {k: v.replace(old, new) for k, v in files.items()}
    for name in changes.get("remove", []):
        del files[name]
    return files


@pytest.fixture
def entries(spark):
    def of(**books):
        rows = [(k, bytearray(v if isinstance(v, bytes) else container(v))) for k, v in books.items()]
        return A.zip_entries(spark.createDataFrame(rows, "path string, content binary"))

    return of


def test_integrity(entries):
    found = entries(
        good=book(),
        no_toc=book(remove=["OEBPS/toc.ncx"], replace=[('<item id="ncx" href="toc.ncx"/>', "")]),
        fallback=book(remove=["META-INF/container.xml"]),
        nothing=book(remove=["META-INF/container.xml", "OEBPS/content.opf"]),
        unknown=book(replace=[('idref="b"', 'idref="zz"')]),
        gone=book(remove=["OEBPS/text/b.xhtml"]),
        empty=book(replace=[('<itemref idref="a"/><itemref idref="b"/>', "")]),
        order=book(replace=[('playOrder="2"', 'playOrder="x"')]),
        target=book(replace=[("text/a.xhtml#x", "text/none.xhtml")]),
        label=book(replace=[("Two", "T" * 500)]),
        broken=b"no zip at all",
    )
    assert {r["path"]: r["status"] for r in A.integrity(found).collect()} == {
        "good": "ok", "no_toc": "toc missing", "fallback": "ok", "nothing": "no package", "unknown": "unknown item", "gone": "missing file",
        "empty": "empty spine", "order": "bad toc", "target": "bad toc", "label": "bad toc", "broken": "unreadable",
    }


def test_parts(entries):
    e = entries(x=book(replace=[('idref="a"', 'idref="a" linear="no"')]))
    order = A.spine(A.packages(e), e).collect()
    assert [(r["position"], r["item_id"], r["name"]) for r in order] == [(0, "b", "OEBPS/text/b.xhtml")]
    nav = A.navigation(e).orderBy("position").collect()
    assert [(r["play_order"], r["number"], r["title"], r["name"]) for r in nav] == [(1, 2, "One", "OEBPS/text/a.xhtml"), (2, 3, "Two", "OEBPS/text/b.xhtml")]
    assert A.styles(e).first()["css"] == "p{}\n"
    assert A.chapter_html(e).first()["html"].startswith("<html>")


def damaged() -> dict[str, bytes]:
    """Containers with one entry that can't be read: packed data damaged, encrypted, packed in an unknown way, and one far too large."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "good " * 50)
        z.writestr("bad.txt", "some text that is packed, " * 50)
    whole = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        i = z.getinfo("bad.txt")
    data = i.header_offset + 30 + len("bad.txt")
    hurt = bytearray(whole)
    hurt[data : data + 8] = b"\xff" * 8
    at = whole.rindex(b"PK\x01\x02")  # the second entry in the directory
    locked, strange = bytearray(whole), bytearray(whole)
    locked[at + 8] |= 1
    locked[i.header_offset + 6] |= 1
    strange[at + 10] = strange[i.header_offset + 8] = 99
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "good " * 50)
        z.writestr("bad.txt", b"\0" * (60 << 20))
    return {"hurt": bytes(hurt), "locked": bytes(locked), "strange": bytes(strange), "bomb": bomb.getvalue(), "cut": whole[:50], "empty": b""}


def test_damaged_entries_are_rows_with_an_error(entries):
    rows = {(r["path"], r["name"]): (r["data"], r["error"]) for r in entries(**damaged()).collect()}
    for path in ("hurt", "locked", "strange", "bomb"):
        assert bytes(rows[(path, "good.txt")][0]).startswith(b"good") and rows[(path, "good.txt")][1] is None
        assert rows[(path, "bad.txt")][0] is None and rows[(path, "bad.txt")][1]
    assert rows[("bomb", "bad.txt")][1] == "over the limits"
    assert rows[("cut", None)][1] and rows[("empty", None)][1]
    assert {r["status"] for r in A.integrity(entries(**damaged())).collect()} == {"unreadable"}


def test_repair(spark, entries):
    nav = '<html><body><nav epub:type="toc"><ol><li><a href="text/a.xhtml">The <b>first</b></a></li><li><a href="text/b.xhtml">B &amp; co</a></li></ol></nav></body></html>'
    lacking = {"remove": ["OEBPS/toc.ncx"], "replace": [('<item id="ncx" href="toc.ncx"/>', ""), (' toc="ncx"', "")]}
    with_nav = book(remove=["OEBPS/toc.ncx"], replace=[('<item id="ncx" href="toc.ncx"/>', '<item id="nav.x" href="nav.xhtml"/>')]) | {"OEBPS/nav.xhtml": nav}
    long = {k: v.replace("The <b>first</b>", "x" * 100) for k, v in with_nav.items()}
    e = entries(spine=book(**lacking), nav=with_nav, long=long, unknown=book(replace=[('idref="b"', 'idref="zz"')]), broken=b"no zip")
    again = A.zip_entries(R.written(R.repaired(e)))
    status = {r["path"]: r["status"] for r in A.integrity(again).collect()}
    assert status == {"spine": "ok", "nav": "ok", "long": "toc missing", "unknown": "unknown item"}
    titles = {(r["path"], r["title"]) for r in A.navigation(again).collect()}
    assert {("spine", "Chapter 1"), ("spine", "Chapter 2"), ("nav", "The first"), ("nav", "B & co")} <= titles
    assert {r["path"] for r in R.quarantined(e).collect()} == {"long", "unknown", "broken"}
    package = "<package><manifest><item id='ncx' href='x'/></manifest><spine page='l' toc='old'></spine></package>"
    row = spark.createDataFrame([(package,)], "x string").select(R.package_patched(F.col("x"))).first()[0]
    assert row.count("id='ncx'") == 1 and '<spine page=\'l\' toc="ncx"></spine>' in row
    patched = lambda x: spark.createDataFrame([(x,)], "x string").select(R.package_patched(F.col("x"))).first()[0]
    for spine, wanted in (('<spine toc="x"/>', '<spine toc="ncx"/>'), ("<spine/>", '<spine toc="ncx"/>'), ("<spine toc=old a='b'>", "<spine toc=\"ncx\" a='b'>"), ("<spine>", '<spine toc="ncx">')):
        assert wanted in patched(f"<package><manifest></manifest>{spine}")


def test_references_in_labels_and_targets(entries):
    e = entries(x=book(replace=[("One", "  A &amp; <b>B</b> &lt;&eacute;&gt; "), ("text/b.xhtml", "text/b&amp;c.xhtml")]))
    assert [(r["title"], r["name"]) for r in A.navigation(e).orderBy("position").collect()] == [("A & B <é>", "OEBPS/text/a.xhtml"), ("Two", "OEBPS/text/b&c.xhtml")]
    long = entries(x=book(replace=[("One", "&amp;" * 30)]))  # 30 bytes, not 150
    assert A.integrity(long).first()["status"] == "ok"


#: A container whose directory says of 200 MB that they are 1000 bytes, and one that says of 1000 bytes that they are 40 MB, each read in its own process.
LIAR = """
import io, resource, struct, sys, zipfile, zlib
sys.path.insert(0, {path!r})
from quire.sources.archives import bounded
said, real = {said}, {real}
out = io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
    with z.open("a", "w") as f:
        for _ in range(real // 1000):
            f.write(bytes(1000))
whole = bytearray(out.getvalue())
at = whole.rindex(b"PK\x01\x02")
whole[at + 24 : at + 28] = struct.pack("<I", said)
opened = zipfile.ZipFile(io.BytesIO(bytes(whole)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
try:
    bounded(opened, opened.infolist()[0], 50 << 20)
    print("read")
except Exception as e:
    print(type(e).__name__)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(("said", "real"), [(1000, 200_000_000), (40_000_000, 1000), (4_000_000_000, 80_000_000)])
def test_a_false_size_costs_no_memory(said, real):
    code = LIAR.format(path=str(pathlib.Path(__file__).parents[1]), said=said, real=real)
    told, megabytes = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert told != "read" and int(megabytes) < 64

def test_titles_and_covers(entries):
    meta = '<package xmlns:dc="x"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><meta name="calibre:series" content="S"/><meta name="calibre:series_index" content="2.5"/><meta name="cover" content="pic"/></metadata><manifest><item id="pic" href="pic.jpg" media-type="image/jpeg"/>'
    e = entries(full=book(replace=[("<package><manifest>", meta)]) | {"OEBPS/pic.jpg": "j"}, bare=book())
    rows = {r["path"]: tuple(r)[1:] for r in A.titles(e).collect()}
    assert rows == {"full": ("T", "A", "S", 2), "bare": (None, None, None, None)}
    assert [tuple(r) for r in A.covers(e).collect()] == [("full", "OEBPS/pic.jpg")]


def test_package_of_any_name(entries):
    files = {k.replace("content.opf", "package.xml"): v for k, v in book(replace=[('full-path="OEBPS/content.opf"', 'full-path="OEBPS/package.xml" media-type="application/oebps-package+xml"')]).items()}
    assert A.integrity(entries(x=files)).first()["status"] == "ok"


def test_limits(spark):
    rows = [("many", f"f{i}", 1, 1) for i in range(2001)] + [("big", "a", 51 << 20, 51 << 20), ("ratio", "a", 1000, 5), ("up", "../evil", 1, 1), ("root", "/x", 1, 1), ("ok", "a", 9, 0)]
    table = spark.createDataFrame(rows, "path string, name string, size long, csize long")
    found = {r["path"]: r["failed"] for r in V.verdicts(V.container_checks(table)).collect()}
    assert found == {"many": "entries", "big": "entry size", "ratio": "ratio", "up": "names", "root": "names", "ok": ""}


def test_built_books_are_sound(spark):
    rows = spark.createDataFrame([(1, 0, "A & B", "<p>x</p>"), (1, 1, "C", "<p>y</p>"), (2, 0, "D", "<p>z</p>")], "book long, chapter int, title string, html string")
    e = A.zip_entries(A.build_books(rows).select(F.col("book").cast("string").alias("path"), "content"))
    assert {r["path"]: r["status"] for r in A.integrity(e).collect()} == {"1": "ok", "2": "ok"}


def test_one_container_is_held_at_a_time():
    """Of a batch of 64 containers of a megabyte, no more than a few are ever beside it in memory."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", os.urandom(1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(64)]), pa.array([out.getvalue()] * 64, pa.binary())], ["path", "content"])
    tracemalloc.start()
    found = [b.column(0)[0].as_py() for b in A.unpacked_batches(iter([batch]), (10, 1 << 30, 1 << 30, 100))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [str(k) for k in range(64)] and peak < 16 << 20
