"""Assembled containers, read by another reader."""

import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import assembly as S


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, ord int, name string, data binary")


def test_books_are_read_by_others(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"{a}/b{k}.epub", n, f"té/{n}.x" if n else "mimetype", bytearray(r.choice((b"", b"text " * r.randint(1, 900), r.randbytes(300))))) for a in "xy" for k in range(4) for n in range(r.randint(1, 9))]
    rows += [("x/b0.epub", 99, "none", None), ("x/b0.epub", 100, None, None)]
    made = {x["path"]: x for x in S.assembled(table(spark, rows).repartition(5), str(tmp_path)).collect()}
    books = {}
    for path, n, name, data in rows:
        if name:
            books.setdefault(path, []).append((n, name, bytes(data or b"")))
    assert made.keys() == books.keys() and not any(f for _, _, f in os.walk(tmp_path / "_temporary"))
    for path, entries in books.items():
        with zipfile.ZipFile(tmp_path / path) as z:
            assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == [(name, data) for _, name, data in sorted(entries)]
            assert made[path]["n_entries"] == len(entries) and made[path]["n_bytes"] == os.path.getsize(tmp_path / path)
            assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
    first = {p: (tmp_path / p).read_bytes() for p in books}
    S.assembled(table(spark, rows).repartition(3), str(tmp_path))
    assert first == {p: (tmp_path / p).read_bytes() for p in books}  # the same bytes, in the old ones' places


def test_a_book_of_very_many_entries(spark, tmp_path):
    """More than the short records can count."""
    rows = spark.range(70_000).select(F.lit("big.epub").alias("path"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("data"))
    assert S.assembled(rows, str(tmp_path)).first()["n_entries"] == 70_000
    with zipfile.ZipFile(tmp_path / "big.epub") as z:
        assert len(z.infolist()) == 70_000 and z.read("c69999") == b"69999"


def test_records_of_large_sizes():
    big = 5 << 30
    head, listed, end = S._head(b"n", 1, big, big, False), S._listed(b"n", 1, big, 7, False, big), S._end(3, 100, big)
    assert struct.unpack("<HHQQ", head[31:]) == (1, 16, big, big) and struct.unpack("<HHQQ", listed[47:]) == (1, 16, big, big)
    assert end.startswith(b"PK\6\6") and len(end) == 56 + 20 + 22 and struct.unpack("<Q", end[48:56])[0] == big


def test_books_stay_in_their_folder(spark, tmp_path):
    with pytest.raises(Exception, match="outside its folder"):
        S.assembled(table(spark, [("../x.epub", 0, "a", bytearray(b"1"))]), str(tmp_path / "in"))
    assert S.assembled(table(spark, []), str(tmp_path / "in")).count() == 0
