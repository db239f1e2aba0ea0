"""Stretches of a text whose words repeat with one period, found by Lyndon words; what is repeated can be taken out.

Every run of period p holds a Lyndon word of p words, under the order of the words or its reverse, that is the longest
Lyndon word beginning at its place. So both orders are scanned from the right with a stack of next smaller suffixes,
and each such word is extended both ways by longest common extensions: binary search over rolling hashes, then the
words themselves. There is no suffix array and no pass over all periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Of the rolling hash: a prime, so that words' numbers are residues, and a base.
PRIME, BASE = (1 << 61) - 1, 911_382_323_987_654_321

#: Words up to which an extension is compared word by word, and distances up to which one found further right is reused.
FEW, NEAR = 8, 1024

FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Extensions:
    """Longest common extensions of a sequence of word numbers with itself, to either side."""

    def __init__(self, words: list[int]) -> None:
        self.words, self.hashes, self.powers = words, None, None
        self.known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether the n words at i and at j have one hash."""
        h, p = self.hashes, self.powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % PRIME == 0

    def _longest(self, at, most: int, least: int = 0) -> int:
        """The greatest n up to most with equal hashes at at(n), which holds for least."""
        if self.hashes is None:
            h, p = [0], [1]
            for w in self.words:
                h.append((h[-1] * BASE + w + 1) % PRIME)
                p.append(p[-1] * BASE % PRIME)
            self.hashes, self.powers = h, p
        while least < most:
            n = (least + most + 1) // 2
            if self._same(*at(n), n):
                least = n
            else:
                most = n - 1
        return least

    def ahead(self, i: int, j: int) -> int:
        """How many words are equal from i and from j > i on. Asked from the right to the left, as the scan does, an answer reuses the last of its distance."""
        w, most, n = self.words, len(self.words) - j, 0
        while n < most and n < FEW and w[i + n] == w[j + n]:
            n += 1
        if n < FEW or n == most:
            return n
        last = self.known.get(j - i)
        gap = last[0] - i if last else NEAR + 1
        if 0 < gap <= NEAR and w[i : i + gap] == w[j : j + gap]:
            n = gap + last[1]
        else:
            n = self._longest(lambda n: (i, j), most, n)
            if w[i : i + n] != w[j : j + n]:  # equal hashes of different words
                n = next(k for k in range(n) if w[i + k] != w[j + k])
        self.known[j - i] = (i, n)
        return n

    def behind(self, i: int, j: int) -> int:
        """How many words are equal just before i and just before j > i."""
        w = self.words
        n = self._longest(lambda n: (i - n, j - n), i)
        if w[i - n : i] != w[j - n : j]:
            n = next(k for k in range(n) if w[i - 1 - k] != w[j - 1 - k])
        return n


def _lyndon(words: list[int], extensions: Extensions) -> Iterator[tuple[int, int, int]]:
    """(place, length, extension): the longest Lyndon word at each place, and how far what follows it repeats it."""
    n = len(words)
    smaller = [n] * n  # the next smaller suffix, which is where the longest Lyndon word ends; as links, a stack
    extensions.known.clear()
    for i in range(n - 1, -1, -1):
        a, j, l = words[i], i + 1, 0
        while j < n:
            b = words[j]
            if a == b:
                l = extensions.ahead(i, j)
                if j + l == n:
                    break  # the suffix at j is a beginning of that at i
                a_, b_ = words[i + l], words[j + l]
            else:
                l, a_, b_ = 0, a, b
            if a_ > b_:
                break
            j = smaller[j]
        smaller[i] = j
        if j < n and l:
            yield i, j - i, l


def runs_of(words: list[int], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence with a length of at least `least` and `exponent` periods, by start and period."""
    n, found = len(words), {}
    extensions, backward = Extensions(words), Extensions([-w for w in words])
    for e in (extensions, backward):
        for i, p, l in _lyndon(e.words, e):
            length = max(least, exponent * p)
            # of a long enough run the first of its Lyndon words begins within its first period
            if l <= length - 2 * p or (i + p + l, p) in found:
                continue
            start, stop = i - extensions.behind(i, i + p), i + p + l
            if stop - start >= length:
                found[stop, p] = start
    out = []
    for (stop, p), start in found.items():
        ends = (not start or words[start - 1] != words[start - 1 + p]) and (stop == n or words[stop] != words[stop - p])
        if not ends or words[start : stop - p] != words[start + p : stop]:
            raise ArithmeticError("a run isn't what its extensions say")
        out.append((start, stop - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def window_of(least: int, exponent: int) -> int:
    """A length of which each run has a window that returns one period later, at each of its words."""
    return min(max(least - p, (exponent - 1) * p) for p in range(1, least + 1))


def suspects(words: list[bytes], width: int) -> list[tuple[int, int]]:
    """The stretches covered by windows of that width which stand in the sequence twice; every run lies within one of them.

    Equal windows have equal hashes, so none is missed; unequal ones that share a hash only cost time.
    """
    if len(words) <= width:
        return []
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        size, base, out, skip = 1, np.uint64(0x9E3779B97F4A7C15), None, 0
        rest = width
        while rest:  # windows of 1, 2, 4, ... words, joined to one of the wanted width
            if rest & 1:
                out = h[: len(h)] if out is None else out[: len(words) - skip - size + 1] * base + h[skip : len(words) - size + 1]
                skip += size
            rest >>= 1
            if rest:
                h = h[:-size] * base + h[size:]
                base, size = base * base, 2 * size
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return []
    starts = np.sort(order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))])
    breaks = np.flatnonzero(np.diff(starts) > width) + 1
    first, last = starts[np.concatenate(([0], breaks))], starts[np.concatenate((breaks - 1, [-1]))] + width
    return list(zip(first.tolist(), last.tolist(), strict=True))


def text_runs(words: list[bytes], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """runs_of, asked only of the stretches that can hold a run."""
    out = []
    if len(words) >= least:
        for a, b in suspects(words, window_of(least, exponent)):
            number: dict[bytes, int] = {}
            coded = [number.setdefault(w, len(number)) for w in words[a:b]]
            out += [(a + s, n, p) for s, n, p in runs_of(coded, least, exponent)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words), bool)
        for s, n, p in runs:
            gone[s + p : s + n] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """docs with `runs`, the runs of the text's words by start and period, and `collapsed`, the text that says each only once.

    Words are what stands between white space of ASCII; they are numbered from 0. A run is a stretch with smallest period
    p, at least `least` words and `exponent` (2 or more) periods long, that can't be made longer. A null or empty text
    has no runs and an empty collapsed text. Rows are looked at one by one, so repeated rows and ids, ties and nulls
    elsewhere don't matter; columns of docs that are called runs or collapsed are replaced.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    out = StructType([docs.schema[c] for c in own]).add("__text", "binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields[:-1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts, first = batch.column(batch.num_columns - 1), 0
            found, kept, held = [], [], 0
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or b"").split()  # at the white space of ASCII
                runs = text_runs(words, least, exponent)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(collapsed(words, runs))
                held += len(kept[-1])
                if held > 8 << 20 or k == batch.num_rows - 1:
                    rows = batch.slice(first, k + 1 - first)
                    columns = [*rows.columns[:-1], pa.array(found, run), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*own, "runs", "collapsed"])
                    first, found, kept, held = k + 1, [], [], 0

    return docs.select(*own, F.col(text).cast("binary").alias("__text")).mapInArrow(look, ", ".join(filter(None, (schema, FOUND))))


def strongest(runs: Column) -> Column:
    """Of runs by start and period the one with the most periods, compared exactly; of several the first. Null if there are none."""
    more = lambda a, x: x["length"].cast("decimal(19,0)") * a["period"] > a["length"].cast("decimal(19,0)") * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def looped(docs: DataFrame) -> DataFrame:
    """docs with repetition put into a tenth of the texts: those whose id has a CRC-32 h divisible by ten.

    With g = h / 10 and n words, from word a = g % n on the words are those of the stretch of p = 1 + (n - a) / (3 + g % 8)
    words at a, again and again. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        loop = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), loop), " ")).otherwise(F.col("text"))

    made = F.transform(F.array(words), again)[0]
    return docs.withColumn("text", F.when(h % 10 == 0, made).otherwise(F.col("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """Of what periodic_runs gives: doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    best = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("b"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
