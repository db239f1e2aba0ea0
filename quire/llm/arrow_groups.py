"""Streaming over sorted Arrow batches, one group of equal keys at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The row numbers at which any of the integer key columns differs from the row before."""
    differ = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table.column(k)
        v = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
        differ |= v[1:] != v[:-1]
    return np.flatnonzero(differ) + 1


def _key(batch: pa.RecordBatch, row: int, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Tables of whole groups, each with its groups' first rows and, last, its length; the open group is carried on.

    A group of more than `most` rows comes in parts, each a table of that group alone with None for the first rows.
    """
    carry: list[pa.RecordBatch] = []
    held, broken = 0, None
    for batch in batches:
        if broken is not None and batch.num_rows:
            first = _key(batch, 0, keys) == broken
            at = changes(batch, keys)
            end = (at[0] if len(at) else batch.num_rows) if first else 0
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), None
            batch = batch.slice(end)
            if batch.num_rows:
                broken = None
        if not batch.num_rows:
            continue
        at = changes(batch, keys)
        if carry and not len(at) and _key(carry[-1], carry[-1].num_rows - 1, keys) == _key(batch, 0, keys):
            carry.append(batch)
            held += batch.num_rows
        else:
            table = pa.Table.from_batches([*carry, batch])
            at = changes(table, keys)
            if len(at):
                yield table.slice(0, at[-1]), np.concatenate(([0], at))
            carry = table.slice(at[-1] if len(at) else 0).to_batches()
            held = sum(x.num_rows for x in carry)
        if most is not None and held > most:
            broken = _key(carry[-1], carry[-1].num_rows - 1, keys)
            yield pa.Table.from_batches(carry), None
            carry, held = [], 0
    if carry:
        table = pa.Table.from_batches(carry)
        yield table, np.concatenate(([0], changes(table, keys), [table.num_rows]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes, one text after the other, and the offsets of the texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes together, or one longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
