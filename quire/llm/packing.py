"""Packing: sum-of-squares placement of tokenised documents into windows, with fill levels tracked in an array."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"

#: Bytes of text that are tokenised together.
BATCH_BYTES = 1 << 21


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}


class Tokens:
    """The ids that the tokenizer of a vocabulary file gives, by the faster of two libraries.

    A byte-level BPE file whose merges follow its ids is handed to tiktoken as ranks, which gives the same ids in a
    fifth of the time; texts with the string of a special token, and all texts under any other file, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked(json.loads(Path(path).read_text(encoding="utf-8")))

    def _ranked(self, spec: dict):
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
            return None
        if before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        letter = _bytes_of_letters()
        special = set(self.special)
        ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One per worker and vocabulary file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Levels:
    """Partially filled windows by fill level: how many there are, and which; windows themselves are only numbers."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        """The window and offset for a piece, chosen so that the sum of squared counts grows least; the fullest on ties.

        Moving a window from level h to h + size changes the sum by 2 * (count[h + size] - count[h] + 1), and by less
        where h is no partial level (a new window) or h + size is none (a full one).
        """
        c, room = self.count, self.window - size
        levels = np.flatnonzero(c[: room + 1])
        levels = levels[levels > 0]
        best, at = 2 * c[size] + 1 if size < self.window else 0, 0
        if len(levels):
            after = levels + size
            change = np.where(after == self.window, 1 - 2 * c[levels], 2 * (c[np.minimum(after, self.window)] - c[levels]) + 2)
            i = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                at = int(levels[i])
        if at:
            c[at] -= 1
            where = self.open[at].pop()
        else:
            where = self.new()
        if at + size < self.window:
            c[at + size] += 1
            self.open[at + size].append(where)
        return where, at

    def gaps(self) -> list[tuple[int, int]]:
        """The partial windows as (level, window), fullest first."""
        return [(h, w) for h in range(self.window - 1, 0, -1) for w in self.open[h]]


SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"
)
DIGESTS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are the tokenizer's, then END. Full windows are cut off its front; the rest is one piece, placed
    into the partially filled window whose choice keeps the sum of squared counts of windows by fill level least. Each
    input partition packs its own documents in their order, so nothing is shuffled, the result of a task computed again
    is the same, and memory holds one batch, the levels and the pieces of windows that are still open. At its end the
    windows still open are filled up from each other: pieces of the emptiest are cut to the gaps of the fullest, so one
    window a partition, at most, is padded.

    Null text counts as empty: its only id is END. Rows with equal ids are packed one by one. Null ids stay null. An
    empty table gives an empty result; columns besides id and text are not read.
    """
    vocabulary = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        first_sequence = TaskContext.get().partitionId() << 40
        tokens, levels = tokens_of(vocabulary), Levels(window)
        held: dict[int, list[tuple]] = {}

        def rows(done):
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(columns[k], pa.int64()) for k in range(5)]
            arrays.append(pa.array(np.array(columns[5], np.int64) + first_sequence))
            arrays.append(pa.array(columns[6], pa.int64()))
            if ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [*DIGESTS, "ids"][: len(arrays)])

        def row(doc, start, piece, total, where, offset):
            return (doc, start, len(piece), zlib.crc32(piece), total, where, offset, piece.tobytes() if ids else None)

        for names, texts in _texts(batches):
            done = []
            for doc, t in zip(names, texts, strict=True):
                own = np.append(tokens.encode(t), np.uint32(END)).astype("<u4", copy=False)
                whole = len(own) // window * window
                for start in range(0, whole, window):
                    done.append(row(doc, start, own[start : start + window], len(own), levels.new(), 0))
                if whole < len(own):
                    where, offset = levels.place(len(own) - whole)
                    held.setdefault(where, []).append((doc, whole, own[whole:].copy(), len(own), offset))
                    if offset + len(own) - whole == window:
                        done += [row(d, s, p, n, where, o) for d, s, p, n, o in held.pop(where)]
            if done:
                yield rows(done)

        done, order = [], levels.gaps()
        loose: list[tuple] = []  # pieces of windows given up to fill the gaps of others
        while order:
            level, where = order.pop(0)
            done += [row(d, s, p, n, where, o) for d, s, p, n, o in held.pop(where)]
            while level < window and (loose or order):
                if not loose:
                    loose = [(d, s, p, n) for d, s, p, n, _ in held.pop(order.pop()[1])]
                doc, start, piece, total = loose.pop()
                now, later = piece[: window - level], piece[window - level :]
                done.append(row(doc, start, now, total, where, level))
                level += len(now)
                if len(later):
                    loose.append((doc, start + len(now), later, total))
        where, level = levels.new(), 0
        while loose:
            doc, start, piece, total = loose.pop()
            now, later = piece[: window - level], piece[window - level :]
            done.append(row(doc, start, now, total, where, level))
            level += len(now)
            if len(later):
                loose.append((doc, start + len(now), later, total))
            if level == window:
                where, level = levels.new(), 0
        if done:
            yield rows(done)

    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return own.mapInArrow(run, SCHEMA if ids else SCHEMA.rpartition(",")[0])
