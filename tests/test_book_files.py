"""Books as files: what reaches the reader, what is inflated, and what a failed write leaves."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quire.operators import validation as V
from quire.sources import archives as A
from quire.sources import book_files as B


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    """Twelve books in folders, one of them large, one damaged, and files that are none."""
    root = tmp_path_factory.mktemp("shelf")
    r = random.Random(1)
    for k in range(12):
        folder = root / f"author {k % 3}"
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"b{k}.{'EPUB' if k == 5 else 'epub'}", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/container.xml", "<container/>")
            z.writestr("a/content.opf", f"<package>{k}</package>")
            for n in range(3):
                z.writestr(f"a/text/c{n}.xhtml", "x" * (n + 1))
            z.writestr("a/pictures.bin", r.randbytes(400_000 if k == 7 else 5000))
    (root / "broken.epub").write_bytes(b"no zip")
    (root / "book.MOBI").write_bytes(b"m")
    (root / "notes.txt").write_bytes(b"n")
    return str(root)


def test_all_entries(spark, shelf):
    rows = B.read_books(spark, shelf).collect()
    paths = {r["path"] for r in rows}
    assert len(paths) == 13 and sum(r["name"] is None for r in rows) == 1
    whole = A.zip_entries(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(shelf).where("lower(path) like '%.epub'").select("path", "content"))
    same = lambda x: sorted((r["name"] or "", r["ord"] or 0, r["size"] or 0, bytes(r["data"] or b"")) for r in x)
    assert same(rows) == same(whole.collect())
    assert {os.path.basename(r["path"]): r["status"] for r in B.listed(spark, shelf).collect()}.items() >= {"book.MOBI": "needs conversion", "notes.txt": "skipped", "b5.EPUB": "book", "broken.epub": "book"}.items()


class Counted(io.RawIOBase):
    def __init__(self, f):
        self.f, self.n = f, 0

    def read(self, size=-1):
        got = self.f.read() if size < 0 else self.f.read(size)
        self.n += len(got)
        return got

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()

    def seekable(self):
        return True

    def readable(self):
        return True


def test_only_what_is_asked_for_is_read(shelf, monkeypatch):
    files = []

    def opened(system, path):
        files.append(Counted(system.open_input_file(path)))
        return files[-1]

    monkeypatch.setattr(B, "opened", opened)

    def read(filters, **options):
        files.clear()
        reader = B.BookReader({"path": shelf, **options})
        left = list(reader.pushFilters(filters))
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        return rows, left, sum(f.n for f in files)

    rows, left, everything = read([])
    assert len(rows) == 12 * 6 + 1 and everything > 450_000
    rows, left, some = read([D.StringEndsWith(("name",), ".opf"), D.IsNotNull(("name",))])
    assert len(rows) == 12 and not left and some < 30_000 and all(r["data"] for r in rows)
    rows, left, _ = read([D.GreaterThan(("size",), 100_000), D.Not(D.EqualTo(("name",), "x"))])
    assert [r["name"] for r in rows] == ["a/pictures.bin"] and len(left) == 1
    rows, _, none = read([D.EqualTo(("path",), "author 1/b7.epub")], data="false")
    assert len(rows) == 6 and len(files) == 1 and none < 3000 and not any(r["data"] for r in rows)
    rows, _, _ = read([D.In(("ord",), (0, 1)), D.LessThan(("csize",), 20)], names="*.opf,META-INF/*")
    assert {r["name"] for r in rows} == {"META-INF/container.xml", "a/content.opf"}


def test_filters_reach_the_reader(spark, shelf):
    found = B.read_books(spark, shelf).where("name like 'a/text/%' and ord = 3 and path <> 'author 0/b0.epub'")
    assert {(r["name"], bytes(r["data"])) for r in found.collect()} == {("a/text/c1.xhtml", b"xx")} and found.count() == 11
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Filter" in line)
    assert "ord" not in kept and "StartsWith" not in kept  # the reader has them; only what it doesn't know is left


def test_limits_by_headers_alone(spark, tmp_path):
    """Too many entries, too much in all, one too large, one too tightly packed, and names that lead outside; all from directories."""
    def book(name, files, pack=zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w", pack) as z:
            for n, data in files:
                z.writestr(n, data)

    book("many", ((f"f{k}", "x") for k in range(V.MOST_ENTRIES + 1)))
    noise = random.Random(2).randbytes(1 << 16)
    book("large", [("big", noise * ((V.MOST_ENTRY >> 16) + 1))], zipfile.ZIP_STORED)
    book("tight", [("a", bytes(3_000_000))])
    book("up", [("a/../../b", "x")])
    book("root", [("/etc/x", "x")])
    book("fine", [("a", "x"), ("b", noise)], zipfile.ZIP_STORED)
    verdicts = {r["path"]: r["failed"] for r in V.verdicts(V.container_checks(B.read_books(spark, str(tmp_path), data=False))).collect()}
    assert verdicts == {"many.epub": "entries", "large.epub": "entry size", "tight.epub": "ratio", "up.epub": "names", "root.epub": "names", "fine.epub": ""}
    errors = {(r["path"], r["name"]): r["error"] for r in B.read_books(spark, str(tmp_path)).where("ord = 0").collect()}
    assert errors["fine.epub", "a"] is None and errors["tight.epub", "a"] == errors["large.epub", "big"] == errors["many.epub", "f0"] == "over the limits"


def test_written_files(spark, tmp_path):
    root = str(tmp_path / "new")
    rows = spark.createDataFrame([("a/x.epub", bytearray(b"1")), ("b/y.epub", bytearray(b"22")), ("z.epub", None)], "path string, content binary")
    B.write_books(rows.withColumn("more", F.lit(1)), root)
    found = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}
    assert found == {"a/x.epub", "b/y.epub", "z.epub"} and not os.path.exists(f"{root}/_temporary/x")
    with pytest.raises(Exception, match="outside its folder"):
        B.write_books(spark.createDataFrame([("ok.epub", bytearray(b"1")), ("../out.epub", bytearray(b"2"))], "path string, content binary").repartition(1), root)
    assert not os.path.exists(f"{root}/ok.epub") and not os.path.exists(tmp_path / "out.epub")
