"""WARC: a deterministic sharded writer of gzipped archives, and the reader that gives the records back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.llm.common import cut, join_by_count
from quire.sources.folders import run_folder

#: Payloads of at least this many bytes are written once.
REVISIT_BYTES = 1000

#: A shard holds a 200th of all payload bytes, but at least and at most so many.
SHARD_PART, SHARD_LEAST, SHARD_MOST = 200, 32 << 20, 1 << 30

#: A file is closed and the next begun at a compressed size of so many parts of a shard, several files a shard.
FILE_PART, FILE_LEAST = 16, 4 << 20

#: Compressed bytes that a task reads back.
READ_BYTES = 16 << 20

#: Cells of the histogram by which keys are cut into shards; all that is collected in a round.
CELLS = 4096

#: Fixed values of the format: the date of all records, the profile of a revisit, and the name space of record ids.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = 0x6F1C2A7B9D3E4C58 << 64
NONE = uuid.UUID(int=0)


def record_id(key: int | None) -> str:
    """A URN whose low 64 bits are the key; the nil UUID for a null key."""
    return f"<urn:uuid:{NONE if key is None else uuid.UUID(int=SPACE | (key & (1 << 64) - 1))}>"


def key_of(urn: str) -> int | None:
    number = uuid.UUID(urn.strip("<>").rpartition(":")[2]).int
    low = number & (1 << 64) - 1
    return None if number == 0 else low - (1 << 64) if low >> 63 else low


_BREAK = re.compile("\r\n|\r|\n")


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    """A header block; line breaks in values, which would begin a new field, become spaces."""
    return "\r\n".join([first, *(f"{k}: {_BREAK.sub(' ', v)}" for k, v in lines), "", ""]).encode()


def response(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, as its own gzip member with no time in it: a response, or a revisit of the record refers_to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key))]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_head(fields, "WARC/1.1") + block + b"\r\n\r\n", 6, mtime=0)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, by lower-case name, and the block of each gzip member of a file, a member at a time."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            chunk = rest or stream.read(1 << 20)
            rest = b""
            if not chunk:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(member.decompress(chunk))
            rest = member.unused_data
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = block[: int(fields["content-length"])]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"].partition(":")[2]:
            raise ValueError(f"block digest of {fields['warc-record-id']} differs")
        yield fields, block


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The first key of each shard but the first, from (key, bytes) rows: the same for the same rows, however they lie.

    Bytes are summed in CELLS equal cells between the least and the greatest key. While a cell holds more than a shard
    and more than one key, it is cut into CELLS again.
    """
    low, high = sizes.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    todo, cells = [(low, high)], []
    while todo:
        a, b = todo.pop()
        width = max(1, -(-(b - a + 1) // CELLS))
        inside = sizes.where(F.col("key").between(a, b))
        found = inside.groupBy(F.expr(f"(key - {a}L) div {width}L").alias("cell")).agg(F.sum("bytes").alias("n")).collect()
        for cell, n in found:
            first, last = a + cell * width, min(b, a + (cell + 1) * width - 1)
            if n > shard_bytes and width > 1:
                todo.append((first, last))
            else:
                cells.append((first, n))
    bounds, filled = [], 0
    for first, n in sorted(cells):
        if filled and filled + n > shard_bytes:
            bounds.append(first)
            filled = 0
        filled += n
    return bounds


def first_copies(pages: DataFrame) -> DataFrame:
    """(key, refers_to) of the pages that repeat a payload of REVISIT_BYTES or more; pages has key, digest, bytes.

    Partial counts are made before the shuffle by digest, so copies of one payload in a third of all rows arrive as one
    row a task; those rows then stay where they are and meet a broadcast table of such payloads.
    """
    large = pages.where(F.col("bytes") >= REVISIT_BYTES)
    groups = cut(large.groupBy("digest", "bytes").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = join_by_count(large, groups, ["digest", "bytes"], large.count())
    return again.where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "digest", F.col("first").alias("refers_to"))


def write_warc(
    pages: DataFrame, to: str, id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int | None = None, shard_bytes: int | None = None
) -> DataFrame:
    """Writes a record per row under the folder `to` and returns the manifest: file, records, bytes, sha256.

    Rows are cut into shards of consecutive keys and sorted by key; a shard's files are closed by compressed size. The
    same rows give the same files, byte by byte, whatever the cluster. A file is written under a temporary name that
    names the attempt and then renamed, so a lost, repeated or speculative task leaves nothing half written. Readers go
    by the manifest, which Spark commits as a whole once all shards are there; a file not in it doesn't count.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, the one with the greatest key is the response and the
    others are revisits of it; rows that share that key are all responses. A null payload is empty; a null url is left
    out of the record; null keys sort first, have the nil id, and are revisits of the greatest key as others are. An
    empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    key, payload = F.col(f"`{id}`").cast("long"), F.coalesce(F.col(f"`{html}`"), F.lit(""))
    place = F.coalesce(F.col(f"`{url}`"), F.lit(None).cast("string"))
    own = pages.select(key.alias("key"), place.alias("url"), payload.alias("html"))
    sized = cut(own.select("key", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("bytes")))
    if shard_bytes is None:
        total = sized.agg(F.sum("bytes")).first()[0] or 0
        shard_bytes = min(max(total // SHARD_PART, SHARD_LEAST), SHARD_MOST)
    file_bytes = file_bytes or max(shard_bytes // FILE_PART, FILE_LEAST)
    bounds = shard_bounds(sized.select("key", (F.col("bytes") + 600).alias("bytes")), shard_bytes)

    # revisit marks travel beside the rows and meet them in the sorted shard: no second shuffle of the texts
    marks = first_copies(sized).distinct()
    both = own.select("key", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = both.unionByName(marks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to"))
    # a shard is a partition: its number is looked up among the bounds, one number a shard, and dealt out as it is
    sent = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.pandas_udf(IntegerType())
    def shard_of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        return pd.Series(np.searchsorted(sent.value, keys.where(known, 0).astype("int64"), side="right") * known.to_numpy()).astype("int32")

    placed = both.withColumn("shard", shard_of("key")).repartitionById(max(1, len(bounds) + 1), "shard")
    ordered = placed.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "kind", "html", "url", "digest")

    def write(batches):
        store, base = fs.FileSystem.from_uri(to)
        store.create_dir(f"{base}/_temporary", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out: dict = {"shard": None, "number": 0, "file": None}
        done: list[tuple[str, int, int, str]] = []

        def close() -> None:
            if out["file"]:
                out["file"].close()
                store.move(out["temporary"], f"{base}/{out['name']}")
                done.append((out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))
            out["file"] = None

        def begin(shard: int) -> None:
            out["number"] = out["number"] + 1 if out["shard"] == shard else 0
            out["shard"], out["name"] = shard, f"part-{shard:06d}-{out['number']:05d}.warc.gz"
            out["temporary"] = f"{base}/_temporary/{out['name']}-{attempt}"
            out["file"] = store.open_output_stream(out["temporary"], compression=None)
            out["records"], out["bytes"], out["sha"] = 0, 0, hashlib.sha256()

        at, known = object(), {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, kind, link, text, digest, first, shard = row
                if k != at:
                    at, known = k, {}
                if kind == 0:
                    known[digest] = first
                    continue
                if out["file"] is None or out["shard"] != shard or out["bytes"] >= file_bytes:
                    close()
                    begin(shard)
                body = text.encode()
                data = response(k, link, body, known.get(hashlib.sha256(body).hexdigest()) if known else None)
                out["file"].write(data)
                out["records"] += 1
                out["bytes"] += len(data)
                out["sha"].update(data)
        close()
        if done:
            names = ["file", "records", "bytes", "sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names)

    ordered.mapInArrow(write, "file string, records bigint, bytes bigint, sha256 string").write.mode("overwrite").parquet(f"{to}/_manifest")
    store, base = fs.FileSystem.from_uri(to)
    if store.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{to}/_manifest")


def read_warc(spark: SparkSession, at: str, payloads: bool = False) -> DataFrame:
    """A row per record of the files in the manifest of the folder `at`; digests are checked, a bad one raises.

    Columns: page_id, url, payload_bytes, payload_digest (bare lower-case hex SHA-1 of the full payload), record_type,
    refers_to, and html if payloads are asked for (null in revisits).
    """
    manifest = spark.read.parquet(f"{at}/_manifest").select("file", "bytes")
    files = cut(manifest)
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def read(batches):
        store, base = fs.FileSystem.from_uri(at)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(body).digest() != digest:
                            raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
                        length = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        first = key_of(fields["warc-refers-to"]) if revisit else None
                        row = (key_of(fields["warc-record-id"]), fields.get("warc-target-uri"), length, digest.hex(), fields["warc-type"], first)
                        rows.append((*row, None if revisit else body.decode()) if payloads else row)
                        size += len(body) if payloads else 100
                        if size > 4 << 20:
                            yield to_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    each = files.repartition(max(1, -(-(files.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES)))
    return each.select("file").mapInArrow(read, schema + (", html string" if payloads else ""))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives of one run in the shared folder; it goes when the driver's program ends. Give write_warc() a folder of your own to keep them."""
    return run_folder(spark, "warc")
