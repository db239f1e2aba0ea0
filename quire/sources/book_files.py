"""Book containers as a data source: entries are read by seeking, and only those that are asked for are inflated.

`spark.read.format("book_files").load(root)` has a row per entry of each *.epub under root, as zip_entries has. Filters on
path, name, ord, size and csize reach the reader: a container's directory is read first, from its end, and an entry that
no filter passes is never read. The option `names` does the same for several patterns, such as
"*.opf,*/container.xml", and `data=false` reads directories alone. `df.write.format("book_files").mode("append").save(root)`
writes rows (path, content) as files: each task under temporary names, all renamed when the job has succeeded.
"""

from __future__ import annotations

import operator
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quire.operators.validation import MOST_ENTRIES, MOST_ENTRY, MOST_RATIO, MOST_TOTAL
from quire.sources.archives import BOOK_SUFFIXES, CONVERTIBLE, ENTRIES, entry_rows, unpacked

#: Bytes of containers that one task reads, unless a single one is larger.
PER_TASK = 64 << 20

_COMPARED = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
_TEXTS = {D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: operator.contains}
KNOWN = ("path", "name", "ord", "size", "csize")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder or file."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def opened(system: fs.FileSystem, path: str):
    return system.open_input_file(path)


def passes(f: D.Filter, row: dict) -> bool:
    """Whether an entry's directory record passes a filter; null passes none."""
    value = row[f.attribute[0]]
    if value is None:
        return False
    if isinstance(f, D.In):
        return value in f.value
    if isinstance(f, D.IsNotNull):
        return True
    return (_COMPARED.get(type(f)) or _TEXTS[type(f)])(value, f.value)


@dataclass
class Files(D.InputPartition):
    paths: list[str]


class BookReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.filters = options["path"], []
        self.names = [x for x in options.get("names", "").split(",") if x]
        self.data = options.get("data", "true").lower() == "true"
        self.per_task = int(options.get("bytes_per_task", PER_TASK))

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if len(f.attribute if hasattr(f, "attribute") else ()) == 1 and f.attribute[0] in KNOWN and type(f) in {*_COMPARED, *_TEXTS, D.In, D.IsNotNull}:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        system, root = located(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [], 0
        for f in sorted((f for f in found if f.is_file and f.base_name.lower().endswith(".epub") and "/_temporary/" not in f.path), key=lambda f: f.path):
            if not all(passes(x, {"path": os.path.relpath(f.path, root)}) for x in self.filters if x.attribute[0] == "path"):
                continue
            if not out or held + f.size > self.per_task:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def wanted(self, row: dict) -> bool:
        return (not self.names or any(fnmatchcase(row["name"], x) for x in self.names)) and all(passes(f, row) for f in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = located(self.root)
        strict = any(f.attribute[0] != "path" for f in self.filters)
        for path in partition.paths:
            name = os.path.relpath(path, root)
            with opened(system, path) as f:
                for rows in unpacked(name, f, wanted=self.wanted, data=self.data):
                    rows = [r for r in rows if r[2] is not None or not strict]
                    if rows:
                        yield entry_rows(rows)


@dataclass
class Written(D.WriterCommitMessage):
    folder: str
    names: list[str]


class BookWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("book files are added to a folder: use mode('append')")
        self.root, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.root)
        folder, names = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"a book can't be written outside its folder: {path}")
                system.create_dir(os.path.dirname(f"{folder}/{path}"))
                with system.open_output_stream(f"{folder}/{path}") as out:
                    out.write(content or b"")
                names.append(path)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.root)
        for m in filter(None, messages):
            for name in m.names:
                system.create_dir(os.path.dirname(f"{root}/{name}"))
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.root)
        if system.get_file_info(f"{root}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary/{self.job}")


class BookFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_files"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> BookReader:
        return BookReader(self.options)

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BookFiles)
    return spark


def read_books(spark: SparkSession, root: str, names: str = "", data: bool = True) -> DataFrame:
    """The entries of all books under root: those alone that match a pattern of names, if there are any; without their data if that isn't wanted."""
    return registered(spark).read.format("book_files").option("names", names).option("data", str(data).lower()).load(root)


def write_books(books: DataFrame, root: str) -> None:
    """books (path, content) as files under root."""
    registered(books.sparkSession)
    books.select("path", "content").write.format("book_files").mode("append").save(root)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of all files under root: book, needs conversion, or skipped, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.when(suffix.isin(*BOOK_SUFFIXES), "book").when(suffix.isin(*CONVERTIBLE), "needs conversion").otherwise("skipped").alias("status"))
