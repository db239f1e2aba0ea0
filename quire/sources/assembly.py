"""Containers of any size: entries are packed in all tasks, and a book is written as a stream that nothing holds whole.

Packing, which is what costs time, is dealt out by entry. Then a book's packed entries are sorted by their order and go,
one Arrow batch after the other, through the task that writes its file; where an entry begins is the sum of the lengths
before it, and the directory, some bytes an entry, is written last. Files get their names when the job has succeeded.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.archives import kept
from quire.sources.book_files import located

PACKED = "path string, ord bigint, name string, crc bigint, size bigint, csize bigint, stored boolean, head binary, packed binary"
WRITTEN = "path string, draft string, n_entries bigint, n_bytes bigint"

#: Fixed values of zip containers: the greatest size, offset and number that fit into the short records.
SHORT, FEW = 0xFFFFFFFF, 0xFFFF

#: 1 January 1980, so that the same entries always give the same bytes.
DAY = 0x21


def _extra(*numbers: int) -> bytes:
    """The field that holds numbers too large for their places."""
    return struct.pack(f"<HH{len(numbers)}Q", 1, 8 * len(numbers), *numbers) if numbers else b""


def _head(name: bytes, crc: int, size: int, csize: int, stored: bool) -> bytes:
    """What stands before an entry's data."""
    extra = _extra(size, csize) if max(size, csize) >= SHORT else b""
    a, b = (SHORT, SHORT) if extra else (csize, size)
    return struct.pack("<4sHHHHHLLLHH", b"PK\3\4", 45 if extra else 20, 0x800, 0 if stored else 8, 0, DAY, crc, a, b, len(name), len(extra)) + name + extra


def _listed(name: bytes, crc: int, size: int, csize: int, stored: bool, at: int) -> bytes:
    """An entry's record in the directory."""
    extra = _extra(*(x for x in (size, csize, at) if x >= SHORT))
    return struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\1\2", 45 if extra else 20, 45 if extra else 20, 0x800, 0 if stored else 8, 0, DAY, crc, min(csize, SHORT), min(size, SHORT), len(name), len(extra), 0, 0, 0, 0, min(at, SHORT)) + name + extra


def _end(n: int, length: int, at: int) -> bytes:
    """What stands behind the directory."""
    long = b""
    if n >= FEW or max(length, at) >= SHORT:
        long = struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + length, 1)
    return long + struct.pack("<4sHHHHLLH", b"PK\5\6", 0, 0, min(n, FEW), min(n, FEW), min(length, SHORT), min(at, SHORT), 0)


def packed(entries: DataFrame) -> DataFrame:
    """entries (path, ord, name, data) with checksum, sizes, header and packed data; the first of a book is stored as it is, as readers look for it there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, name = row["data"] or b"", row["name"].encode()
                deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
                small = data if row["ord"] == 0 else deflate.compress(data) + deflate.flush()
                stored = len(small) >= len(data)
                small, crc = (data if stored else small), zlib.crc32(data)
                values = (row["path"], row["ord"], row["name"], crc, len(data), len(small), stored, _head(name, crc, len(data), len(small), stored), small)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split(" ")[0] for x in PACKED.split(", ")])

    rows = entries.where("name is not null").select("path", F.col("ord").cast("long").alias("ord"), "name", "data")
    return rows.mapInArrow(pack, PACKED)


def assembled(entries: DataFrame, root: str) -> DataFrame:
    """(path, n_entries, n_bytes) of the books written under root, as root/path, from entries (path, ord, name, data).

    Entries stand in the order of ord, those of one ord by name. A row without a name is no entry; null data is empty. A
    book that is written anew takes the place of the old one. Names of books must not lead out of root.
    """
    folder = f"{root.rstrip('/')}/_temporary/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        path, out, draft, at, directory, n = None, None, "", 0, [], 0
        done: list[tuple] = []

        def close() -> None:
            listed = b"".join(directory)
            end = _end(n, len(listed), at)
            out.write(listed)
            out.write(end)
            out.close()
            done.append((path, draft, n, at + len(listed) + len(end)))

        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if out is not None:
                        close()
                    path, at, directory, n = row["path"], 0, [], 0
                    if path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"a book can't be written outside its folder: {path}")
                    draft = uuid.uuid4().hex
                    system.create_dir(base)
                    out = system.open_output_stream(f"{base}/{draft}")
                out.write(row["head"])
                out.write(row["packed"])
                directory.append(_listed(row["name"].encode(), row["crc"], row["size"], row["csize"], row["stored"], at))
                at, n = at + len(row["head"]) + row["csize"], n + 1
        if out is not None:
            close()
        if done:
            columns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split(" ")[0] for x in WRITTEN.split(", ")])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drafts get their books' names. A task that is run again finds what it has named already."""
        (system, base), (_, top) = located(folder), located(root)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{top}/{row['path']}"
                system.create_dir(os.path.dirname(final))
                if system.get_file_info(f"{base}/{row['draft']}").type != fs.FileType.NotFound:
                    system.move(f"{base}/{row['draft']}", final)
            yield batch

    ordered = kept(packed(entries)).repartition("path").sortWithinPartitions("path", "ord", "name")
    drafts = kept(ordered.mapInArrow(write, WRITTEN))
    named = kept(drafts.mapInArrow(name, WRITTEN))
    system, base = located(folder)
    if system.get_file_info(base).type != fs.FileType.NotFound:
        system.delete_dir(base)
    return named.select("path", "n_entries", "n_bytes")
