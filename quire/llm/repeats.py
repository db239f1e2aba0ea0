"""Repeated byte strings: sampled suffixes are sorted across the cluster and decide about the suffixes between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_groups import runs, text_bytes
from quire.llm.shingles import mix, powers

#: Bytes of a string that counts as repeated, window starts that share a sampled suffix at most, bytes of a gram.
LENGTH = 200
REACH = 100
GRAM = 16

#: Window starts that are worked on together in a task.
PIECE = 1 << 19

#: Contexts of one sampled suffix that are compared in one task; beyond, their windows are counted across the cluster.
CONTEXTS = 50_000

DUP, CHECK = 1, 2


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; with powers() they give the hash of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data))[0], out=out[1:])
    return out


def _hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((prefix[b] - prefix[a]) * powers(len(prefix))[1][a])


def _window_min(v: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours, by doubling."""
    have = 1
    while 2 * have <= n:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (n - have)], v[n - have :]) if have < n else v


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(text number, first window start, past the last window start) of texts, about PIECE window starts at a time."""
    doc, a, b, size = [], [], [], 0
    for d in np.flatnonzero(np.diff(offsets) >= length):
        start, end = int(offsets[d]), int(offsets[d + 1]) - length + 1
        while start < end:
            stop = min(end, start + PIECE - size)
            doc.append(d)
            a.append(start)
            b.append(stop)
            size += stop - start
            start = stop
            if size >= PIECE:
                yield np.array(doc), np.array(a), np.array(b)
                doc, a, b, size = [], [], [], 0
    if doc:
        yield np.array(doc), np.array(a), np.array(b)


def _aranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def samples(data: np.ndarray, offsets: np.ndarray, length: int, reach: int):
    """The sampled suffixes of texts, as (text, lo, back, count, key, full), arrays of equal length.

    Each window of `length` bytes hangs on the suffix that begins at the least gram of its first `reach` positions, the
    first of equals: a choice that depends on the window's bytes alone. The windows that begin at lo..lo+count-1 hang on
    the suffix at lo+back. `key` hashes what all windows that could hang on a suffix share of it, `full` all bytes of
    its own windows and where the suffix lies in them.
    """
    for doc, a, b in _pieces(offsets, length):
        low, high = int(a[0]), int(b[-1]) + length - 1
        own = data[low:high]
        prefix = _prefix(own)
        at = np.arange(len(own) - GRAM + 1)
        grams = _hash(prefix, at, at + GRAM)
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        least = _window_min(ranked, reach)
        starts = _aranges(a - low, b - low)
        which = np.repeat(doc, b - a)
        anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        lo, suffix, text = starts[first], anchor[first], which[first]
        key = _hash(prefix, suffix, suffix + (length - reach + 1))
        full = _hash(prefix, lo, lo + count - 1 + length)
        full = mix(full + (suffix - lo).astype(np.uint64) * np.uint64(1_000_003) + count.astype(np.uint64))
        yield text, lo + low - offsets[text], suffix - lo, count, key, full


def _sampled(own: DataFrame, length: int, reach: int) -> DataFrame:
    """The sampled suffixes of all texts; place packs lo, count and a flag.

    Equal contexts within a batch are told here: one of them goes on, known as repeated, and the others are done and
    travel under a key of their own, so that a text in a third of all rows sends one suffix a batch to its key.
    """

    def sample(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column(2))
            parts = list(samples(data, offsets, length, reach))
            if not parts:
                continue
            text, lo, back, count, key, full = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, inverse, n = np.unique(full, return_index=True, return_inverse=True, return_counts=True)
            again = n[inverse] > 1
            done = again & (first[inverse] != np.arange(len(full)))
            key = np.where(done, mix(full + np.arange(len(full)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key)
            place = (lo << 16) | (count << 8) | done.astype(np.int64) * 2 | again.astype(np.int64)
            rows = pa.array(text)
            columns = [pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)]
            table = pa.RecordBatch.from_arrays(columns, ["key", "full", "doc_id", "row", "place"])
            for i in range(0, table.num_rows, 100_000):
                yield table.slice(i, 100_000)

    return own.mapInArrow(sample, "key bigint, full bigint, doc_id bigint, row bigint, place bigint")


def _with_neighbours(batches: Iterator[pa.RecordBatch], names: list[str], told) -> Iterator[pa.RecordBatch]:
    """told(table, a, b) for all rows in turn as rows a..b-1 of a table that holds their neighbours on both sides too."""
    held: pa.Table | None = None  # the last row told, and the one that waits for the next batch
    context = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(names)
        table = table if held is None else pa.concat_tables([held, table])
        yield told(table, context, table.num_rows - 1)
        context = min(1, table.num_rows - 1)
        held = table.slice(table.num_rows - 1 - context)
    if held is not None:
        yield told(held, context, held.num_rows)


def _judged(sampled: DataFrame) -> DataFrame:
    """The suffixes in order of key and context, each judged by its two neighbours: kind has DUP, CHECK or both.

    A neighbour with the same context makes all windows of a suffix repeated. A neighbour with the same key only means
    that some may be, so both contexts have to be looked at. Rows with neither are dropped here.
    """

    def judge(batches):
        names = ["key", "full", "doc_id", "row", "place"]

        def told(table: pa.Table, a: int, b: int):
            key, full, place = (table.column(k).to_numpy() for k in ("key", "full", "place"))
            same_key, same_full = key[1:] == key[:-1], (key[1:] == key[:-1]) & (full[1:] == full[:-1])
            false = np.zeros(1, bool)
            near = np.concatenate((false, same_full)) | np.concatenate((same_full, false))
            other = np.concatenate((false, same_key & ~same_full)) | np.concatenate((same_key & ~same_full, false))
            kind = np.where(near | (place & 3 > 0), DUP, 0) | np.where(other & (place & 2 == 0), CHECK, 0)
            take = np.flatnonzero(kind[a:b]) + a
            kept = table.take(pa.array(take))
            arrays = [kept.column(k).combine_chunks() for k in ("key", "doc_id", "row", "place")]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(kind[take].astype(np.int32))], ["key", "doc_id", "row", "place", "kind"])

        yield from _with_neighbours(batches, names, told)

    ordered = sampled.repartition("key").sortWithinPartitions("key", "full")
    return ordered.mapInArrow(judge, "key bigint, doc_id bigint, row bigint, place bigint, kind int")


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of window starts, inclusive, with neighbouring and overlapping ones made one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1] + 1
    first = np.flatnonzero(new)
    return lo[first], np.append(hi[first[1:] - 1], hi[-1])


FOUND = "key bigint, doc_id bigint, row bigint, lo bigint, hi bigint, context binary"


def _contexts(own: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """Per text its ranges known as repeated (context is null), and the bytes around each suffix to be checked."""
    lists = judged.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "place", "kind")).alias("found"))
    joined = own.join(lists, own["doc_id"].eqNullSafe(lists["doc_id"]) & (own["row"] == lists["row"])).select(own["doc_id"], own["row"], "t", "found")

    def open_up(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                found = batch.column(3)[i].values
                key, place, kind = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                lo, hi = place >> 16, (place >> 16) + ((place >> 8) & 0xFF) - 1
                doc, row = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                dup = kind & DUP > 0
                if dup.any():
                    for n, (a, b) in enumerate(zip(*_merge(lo[dup], hi[dup]), strict=True)):
                        out.append((int(row) ^ n, doc, row, int(a), int(b), None))
                text = data[offsets[i] : offsets[i + 1]]
                for k in np.flatnonzero(kind & CHECK):
                    out.append((int(key[k]), doc, row, int(lo[k]), int(hi[k]), text[lo[k] : hi[k] + length].tobytes()))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return joined.mapInArrow(open_up, FOUND)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    columns = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "row", "lo", "hi", "context"])


def _compared(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """Ranges of repeated windows (window is null), and for suffixes with over `most` contexts their windows' hashes."""

    def windows(table: pa.Table):
        """The hash of each window of each context, the context it is of, and where the contexts' windows end."""
        data, offsets = text_bytes(table.column("context").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        prefix = _prefix(data)
        n = np.diff(offsets) - length + 1
        starts = _aranges(offsets[:-1], offsets[:-1] + n)
        return _hash(prefix, starts, starts + length), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n

    def compare(batches):
        names = ["doc_id", "row", "lo", "hi", "window"]
        for table, at in runs(batches, ["key"], most):
            known = table.filter(pa.compute.is_null(table.column("context")))
            if known.num_rows:
                known = known.select(names[:4]).append_column("window", pa.nulls(known.num_rows, pa.int64()))
                yield from known.to_batches()
            table = table.filter(pa.compute.is_valid(table.column("context")))
            if not table.num_rows:
                continue
            for i in range(0, table.num_rows, most) if at is None else [0]:
                part = table.slice(i, most) if at is None else table
                hashes, of, first = windows(part)
                lo = part.column("lo").to_numpy()[of] + np.arange(len(of)) - first[of]
                if at is None:
                    rows = pa.array(of)
                    ids = [part.column(k).combine_chunks().take(rows) for k in ("doc_id", "row")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(lo), pa.array(lo), pa.array(hashes.view(np.int64))], names)
                    continue
                _, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
                hit = np.flatnonzero(n[inverse] > 1)
                if not len(hit):
                    continue
                new = np.ones(len(hit), bool)
                new[1:] = (of[hit][1:] != of[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
                begin = np.flatnonzero(new)
                end = np.append(begin[1:] - 1, len(hit) - 1)
                rows = pa.array(of[hit[begin]])
                ids = [part.column(k).combine_chunks().take(rows) for k in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(lo[hit[begin]]), pa.array(lo[hit[end]]), pa.nulls(len(begin), pa.int64())], names
                )

    ordered = contexts.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(compare, "doc_id bigint, row bigint, lo bigint, hi bigint, window bigint")


def _settled(found: DataFrame) -> DataFrame:
    """The ranges of `found` that are sure, and of the windows those whose hash a neighbour in order of hash shares."""

    def settle(batches):
        names = ["doc_id", "row", "lo", "hi", "window"]

        def told(table: pa.Table, a: int, b: int):
            window = table.column("window").combine_chunks()
            known = window.is_valid().to_numpy(zero_copy_only=False)
            value = window.fill_null(0).to_numpy()
            same = known[1:] & known[:-1] & (value[1:] == value[:-1])
            false = np.zeros(1, bool)
            keep = ~known | np.concatenate((false, same)) | np.concatenate((same, false))
            kept = table.select(names[:4]).take(pa.array(np.flatnonzero(keep[a:b]) + a)).combine_chunks()
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], names[:4])

        yield from _with_neighbours(batches, names, told)

    spread = F.coalesce("window", F.xxhash64("doc_id", "row", "lo"))
    return found.repartition(spread).sortWithinPartitions("window").mapInArrow(settle, "doc_id bigint, row bigint, lo bigint, hi bigint")


def repeated_ranges(own: DataFrame, length: int = LENGTH, reach: int = REACH, most: int = CONTEXTS) -> DataFrame:
    """own has doc_id, row (hash of the text) and t. Per text with repeated strings: doc_id, row, ranges (lo, hi).

    A range holds the starts, in bytes, of strings of `length` bytes that begin anywhere else too.
    """
    found = _compared(_contexts(own, _judged(_sampled(own, length, reach)), length), length, most)
    return _settled(found).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _removed(n: int, ranges, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each maximal removed run."""
    if ranges is None or not len(ranges):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = (ranges.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    a, b = _merge(lo, hi + length - 1)
    return a, b + 1


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, most: int = CONTEXTS) -> DataFrame:
    """One row per document: doc_id (bigint), n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Texts are UTF-8 bytes, null is empty. Each byte covered by a string of `length` bytes that begins anywhere else too,
    in the same or another text, is removed; strings are judged on the input. Matches never cross texts. What is kept
    can end within a character, so it is binary.

    Rows with equal id and text are two texts that repeat each other. Texts shorter than `length` stay as they are. A
    null id stays null. An empty table gives an empty result; columns besides id and text are not read.
    """
    if length - reach < 1 or reach < 1 or length < reach + GRAM or reach > 255:
        raise ValueError("length must exceed reach by a gram, and reach must fit a byte")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("row"), t.alias("t"))
    # one plan to the end: both joins use the texts' one exchange
    ranges = repeated_ranges(own, length, reach, most).withColumnsRenamed({"doc_id": "d", "row": "r"})
    joined = own.join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "t", "ranges")

    def take(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                found = batch.column(2)[i]
                a, b = _removed(len(own), found.values if found.is_valid else None, length)
                edges = np.column_stack((np.append(0, b), np.append(a, len(own))))
                kept = own.tobytes() if not len(a) else b"".join(own[x:y].tobytes() for x, y in edges)
                out.append((len(own), len(own) - len(kept), len(a), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return joined.mapInArrow(take, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
