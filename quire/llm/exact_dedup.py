"""Exact dedup: counting quotient filters find repeated fingerprints, and bytes decide among those."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, is_heavy, join_by_count, let

#: Distinct fingerprints that one merging task is meant to hold, and the least number of bits of a segment's number.
SEGMENT_ROWS = 1 << 20
LEAST_SEGMENT_BITS = 8

#: Slots a filter has per fingerprint at least.
ROOM = 1.1


def normalised(text: Column) -> Column:
    """Runs of white space replaced by one space; null is empty. Only texts with two spaces running meet a regex."""
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), "\t\n\x0b\f\r", F.coalesce(text, F.lit("")))
    return let(spaced, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def fingerprint(text: Column, bits: int = 64) -> Column:
    """The low bits of a 64-bit hash; fewer bits are for tests, where fingerprints should collide."""
    h = F.xxhash64(text)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = (n + 7) // 8
    return np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n, bitorder="little").astype(bool), at + size


class CountingQuotientFilter:
    """Sorted fingerprints with counts, and their packed form, a counting quotient filter.

    A fingerprint's high bits are its quotient, its home among the slots; the rest, its remainder, is what a slot holds.
    The remainders of one quotient form a run, sorted, at its home or, where the run before reaches beyond that, right
    behind it. A count above one takes the slot behind its remainder. Three bits a slot tell them apart: whether the slot
    is the home of some run (occupied), whether a run ends in it, and whether it holds a count. Nothing is lost: slots in
    order give back the fingerprints in order, so filters of any sizes merge by their sorted remainders.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: distinct uint64 in ascending order; counts: int64 above zero."""
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints, return_counts=True)
        return cls(values, counts)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both in one, by a merge of sorted runs: the shorter is looked up in the longer, equal ones add their counts."""
        a, b = (self, other) if len(self.fingerprints) >= len(other.fingerprints) else (other, self)
        at = np.searchsorted(a.fingerprints, b.fingerprints)
        same = at < len(a.fingerprints)
        same[same] = a.fingerprints[at[same]] == b.fingerprints[same]
        counts = a.counts.copy()
        counts[at[same]] += b.counts[same]
        new = ~same
        return CountingQuotientFilter(np.insert(a.fingerprints, at[new], b.fingerprints[new]), np.insert(counts, at[new], b.counts[new]))

    def pack(self, prefix_bits: int = 0) -> bytes:
        """The slots. The first prefix_bits of all fingerprints must be equal; they are kept once."""
        n = len(self.fingerprints)
        used = n + int((self.counts > 1).sum())
        q = max(1, int(np.ceil(np.log2(max(2.0, ROOM * used)))))
        q = min(q, 64 - prefix_bits - 1)
        r = 64 - prefix_bits - q
        prefix = int(self.fingerprints[0]) >> (64 - prefix_bits) if n and prefix_bits else 0
        quotient = ((self.fingerprints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
        width = 1 + (self.counts > 1)  # slots of each fingerprint
        first = np.flatnonzero(np.concatenate(([True], quotient[1:] != quotient[:-1]))) if n else np.zeros(0, np.int64)
        length = np.add.reduceat(width, first) if n else np.zeros(0, np.int64)
        before = np.cumsum(length) - length
        start = np.maximum.accumulate(quotient[first] - before) + before  # a run's home, or right behind the run before
        slots = max(1 << q, int(start[-1] + length[-1]) if n else 0)
        at = np.repeat(start - before, np.diff(np.append(first, n))) + np.cumsum(width) - width
        values, occupied, ends, counted = np.zeros(slots, "<u8"), np.zeros(slots, bool), np.zeros(slots, bool), np.zeros(slots, bool)
        values[at] = self.fingerprints & np.uint64((1 << r) - 1)
        many = self.counts > 1
        values[at[many] + 1] = self.counts[many]
        counted[at[many] + 1] = True
        occupied[quotient] = True
        ends[start + length - 1] = True
        size = (max(r, int(self.counts.max(initial=1)).bit_length()) + 7) // 8  # bytes of a slot
        head = np.array([prefix, prefix_bits, q, slots, size], "<u8").tobytes()
        return head + _bits(occupied) + _bits(ends) + _bits(counted) + np.ascontiguousarray(values.view(np.uint8).reshape(slots, 8)[:, :size]).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        prefix, prefix_bits, q, slots, size = (int(x) for x in np.frombuffer(data, "<u8", 5))
        occupied, at = _flags(data, 40, slots)
        ends, at = _flags(data, at, slots)
        counted, at = _flags(data, at, slots)
        values = np.zeros((slots, 8), np.uint8)
        values[:, :size] = np.frombuffer(data, np.uint8, slots * size, at).reshape(slots, size)
        values = values.view("<u8").ravel()
        home, end = np.flatnonzero(occupied), np.flatnonzero(ends)  # the k-th occupied slot is the home of the k-th run
        start = np.maximum(home, np.concatenate(([0], end[:-1] + 1))) if len(home) else home
        length = end + 1 - start
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        quotient, is_count = np.repeat(home, length), counted[at]
        r = 64 - prefix_bits - q
        top = (prefix << (64 - prefix_bits)) & ((1 << 64) - 1) if prefix_bits else 0
        found = values[at][~is_count] | (quotient[~is_count].astype(np.uint64) << np.uint64(r)) | np.uint64(top)
        counts = np.ones(len(found), np.int64)
        counts[(np.cumsum(~is_count) - 1)[is_count]] = values[at][is_count].astype(np.int64)
        return cls(found, counts)


def _merged(filters: Iterator[CountingQuotientFilter]) -> CountingQuotientFilter:
    """All in one: filters of like sizes are merged first, so that each entry takes part in few merges."""
    held: list[CountingQuotientFilter] = []
    for f in filters:
        while held and len(held[-1].fingerprints) <= 2 * len(f.fingerprints):
            f = held.pop().merge(f)
        held.append(f)
    return reduce(lambda a, b: b.merge(a), reversed(held)) if held else CountingQuotientFilter(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def repeated_fingerprints(prints: DataFrame, total: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """prints has one bigint column, fp, and total rows. Returns (fp, n) of the fingerprints that occur more than once.

    Each input partition builds its filter and sends it cut into segments, one per range of fingerprints; a segment's
    filters are merged by sorted remainders. Segments are as many as total asks for, so that a task holds about
    segment_rows entries at any size. A fingerprint in a third of all rows is one entry a partition.
    """
    segment_bits = max(LEAST_SEGMENT_BITS, int(np.ceil(np.log2(max(1, total / segment_rows)))))
    shift = np.uint64(64 - segment_bits)

    def build(batches):
        own = _merged(CountingQuotientFilter.of(x.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for x in batches if x.num_rows)
        segment = (own.fingerprints >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if len(segment) else np.zeros(0, np.int64)
        for k in range(0, len(first), 1000):
            bounds = [*first[k : k + 1000], len(segment)] if k + 1000 >= len(first) else first[k : k + 1001]
            packed = [CountingQuotientFilter(own.fingerprints[a:b], own.counts[a:b]).pack(segment_bits) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(segment[bounds[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["segment", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        whole = _merged(CountingQuotientFilter.unpack(x.as_py()) for x in table.column("filter"))
        twice = whole.counts > 1
        return pa.table({"fp": whole.fingerprints[twice].view(np.int64), "n": whole.counts[twice]})

    packed = prints.mapInArrow(build, "segment int, filter binary")
    return packed.groupBy("segment").applyInArrow(merge, "fp bigint, n bigint")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of white space become one space; null counts as empty. Of equal texts the
    row with the smallest id stays. Documents whose fingerprint occurs once go straight to the result. The texts of the
    others are compared byte by byte: they are grouped by fingerprint and whole text. Texts of heavy fingerprints are
    grouped within their tasks before any is moved; the other texts are moved once, by fingerprint, at every size.

    Rows with equal id and text are each a member of their group, and all have kept true if theirs is the smallest id.
    Null ids sort after all others and are kept only if no other id has the text. An empty table gives an empty result;
    other columns are not read.
    """
    t = normalised(F.col(f"`{text}`"))
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), t.alias("t")).withColumn("fp", fingerprint(F.col("t"), fingerprint_bits))
    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    base = cut(own.select("doc_id", "fp", sha))
    total = base.count()
    repeated = cut(repeated_fingerprints(base.select("fp"), total))
    heavy = repeated.where(is_heavy(total)).select("fp")

    def groups(texts: DataFrame) -> DataFrame:
        return texts.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")

    light = own.join(F.broadcast(heavy), "fp", "left_anti").join(repeated.where(~is_heavy(total)).select("fp").hint("merge"), "fp")
    same = groups(own.join(F.broadcast(heavy), "fp")).unionByName(groups(light))
    same = cut(same.select("fp", sha, F.col("keep_id").alias("first_id"), "group_size", F.col("group_size").alias("n")))
    matched = join_by_count(base, same, ["fp", "text_sha256"], total, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    return matched.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; repeated rows of the id that stays, stay.

    Null texts count as empty; a null id is dropped if another id has its text. An empty table stays empty.
    """
    t = F.sha2(normalised(F.col(f"`{text}`")).cast("binary"), 256)
    gone = exact_dedup(docs, id, text).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    return docs.join(gone.hint("merge"), F.col(f"`{id}`").eqNullSafe(F.col("__gone")) & (t == F.col("__sha")), "left_anti")
