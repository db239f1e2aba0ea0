"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling."""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import mix

MODEL = "piece_bpe_32k.model"

#: Fixed value of the format: the space in pieces.
SPACE = "▁"

#: Stands, inside this module, for a SPACE that the text itself holds: a lone surrogate, which no text can hold.
GIVEN = "\udfff"

#: A piece of rank r has the log probability -EXPONENT * ln(r + 1): the file's scores are ranks, not probabilities.
EXPONENT = 1.0

#: Inverse temperature of the sampled distribution; 0 makes all segmentations alike, large values the best one.
ALPHA = 1.0

#: Characters of text that are segmented together; a longer text is worked on in parts, a longer stretch alone.
CHUNK = 1 << 20

#: Slots of the tables by which a substring's hash leads to its piece.
SLOTS = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolled(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hashes of strings that end in these characters, from the hashes of what stands before those; 0 for nothing."""
    return (codes + before * _BASE) * np.uint64(0xD6E8FEB86659FD93)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Pieces:
    """The pieces of a model file: their log probabilities, bytes, and hashes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        plain = []
        self.raw = [b""] * n  # what a piece decodes to; control pieces decode to nothing
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                plain.append((i, text, model.get_score(i)))
                self.raw[i] = text.replace(SPACE, " ").encode()
        if (self.byte < 0).any():
            raise ValueError("lossless coding needs a model with a piece for every byte")
        self.logp = np.full(n, -EXPONENT * np.log(n + 1.0))
        plain.sort(key=lambda x: (-x[2], x[0]))
        by_length: dict[int, list[tuple[int, int]]] = {}
        for rank, (i, text, _) in enumerate(plain):
            self.logp[i] = -EXPONENT * np.log(rank + 1.0)
            codes, h = _codes(text).astype(np.uint64), np.zeros(1, np.uint64)
            for k in range(len(codes)):
                h = _rolled(codes[k : k + 1], h)
            by_length.setdefault(len(codes), []).append((int(h[0]), i))
        self.longest = max(by_length)
        self.tables = {}
        for k, rows in by_length.items():
            rows.sort()
            known = np.array([h for h, _ in rows] + [0], np.uint64)  # one more, for empty slots to point to
            slot, level = _slot(known[:-1]), []
            rest = np.arange(len(rows), dtype=np.int32)
            while len(rest):  # of pieces in one slot, each stands in a table of its own
                _, one = np.unique(slot[rest], return_index=True)
                level.append(np.full(SLOTS, len(rows), np.int32))
                level[-1][slot[rest[one]]] = rest[one]
                rest = np.delete(rest, one)
            self.tables[k] = known, np.array([i for _, i in rows], np.int32), level


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _stretches(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first character of each stretch: a run of spaces with all up to the next one, of any length.

    Stretches are segmented independently of each other.
    """
    space = codes == ord(SPACE)
    new = np.ones(len(codes), bool)
    new[1:] = (space[1:] & ~space[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def _forward(p: Pieces, codes: np.ndarray, starts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character the first of its edges, one per piece that ends there; and the edges' cumulative probabilities, pieces and lengths.

    Forward filtering, all stretches abreast: the probability of all segmentations up to a character sums those up to
    where each piece begins, times the piece's. A character without a piece has its UTF-8 bytes as an edge; that edge's
    piece is -1 - code. The last edge of a character has a cumulative probability above 1.
    """
    n = len(codes)
    lengths = np.diff(np.append(starts, n))
    into = np.arange(n) - np.repeat(starts, lengths)
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, ends, pieces, log probabilities
    degree = np.zeros(n, np.int64)
    h, wide, act = np.zeros(n, np.uint64), codes.astype(np.uint64), np.arange(n)
    for k in range(1, p.longest + 1):
        if k > 1:  # the characters that have k - 1 before them in their stretch
            act = act[into[act] >= k - 1]
        own = _rolled(wide[act], h[act - 1] if k > 1 else np.zeros(n, np.uint64))
        h[act] = own
        if k not in p.tables:
            continue
        known, ids, levels = p.tables[k]
        slot, rest, some, row = _slot(own), None, [], []
        for level in levels:
            to = level[slot if rest is None else slot[rest]]
            full, same = to < len(ids), known[to] == (own if rest is None else own[rest])
            hit, miss = np.flatnonzero(same & full), np.flatnonzero(~same & full)
            some.append(hit if rest is None else rest[hit])
            row.append(to[hit])
            rest = miss if rest is None else rest[miss]  # those whose slot holds another piece
        some, row = np.concatenate(some), np.concatenate(row)
        at, piece = act[some], ids[row]
        found.append((k, at, piece, alpha * p.logp[piece]))
        degree[at] += 1
    alone = np.ones(n, bool)
    if found and found[0][0] == 1:
        alone[found[0][1]] = False
    bare = np.flatnonzero(alone)
    letters, which = np.unique(codes[bare], return_inverse=True)
    spelled = [SPACE if c == ord(GIVEN) else chr(c) for c in letters]
    cost = np.array([alpha * float(sum(p.logp[p.byte[b]] for b in x.encode())) for x in spelled])
    if len(bare):
        found.insert(0, (1, bare, np.array([-1 - ord(x) for x in spelled], np.int32)[which], cost[which]))
        degree[bare] += 1

    # characters in order of their place in their stretch, edges in order of characters, then of length
    order = np.argsort(into, kind="stable")
    sizes = degree[order]
    first = np.empty(n, np.int64)
    first[order] = np.cumsum(sizes) - sizes
    edges = int(sizes.sum())
    weight, pieces_, long, before = np.empty(edges), np.empty(edges, np.int32), np.empty(edges, np.uint8), np.empty(edges, np.int64)
    place = np.arange(n) + np.repeat(np.arange(len(starts)), lengths) + 1  # total has a place before each stretch too, where it is 0
    free = first.copy()
    for k, at, piece, logp in found:
        e = free[at]
        weight[e], pieces_[e], long[e], before[e] = logp, piece, k, place[at] - k
        free[at] += 1
    total, cum = np.zeros(n + len(starts)), np.empty(edges, np.float32)
    bounds = np.searchsorted(into[order], np.arange(int(into.max(initial=0)) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        at, count = order[a:b], sizes[a:b]
        low, high = int(first[at[0]]), int(first[at[-1]] + count[-1])
        w, begin = weight[low:high] + total[before[low:high]], first[at] - low
        top = np.maximum.reduceat(w, begin)
        np.exp(np.subtract(w, np.repeat(top, count), out=w), out=w)
        run, rest = np.zeros(b - a), np.arange(b - a)
        for j in range(int(count.max())):  # sums within each character alone, so that they don't depend on the others
            rest = rest[count[rest] > j]
            run[rest] += w[begin[rest] + j]
            w[begin[rest] + j] = run[rest]
        total[place[at]] = top + np.log(run)
        cum[low:high] = w / np.repeat(run, count)
        cum[low + begin + count - 1] = 2.0
    return first, cum, pieces_, long


def _uniform(seed: np.ndarray, ordinal: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row's seed, the stretch's place in the row and the step alone."""
    with np.errstate(over="ignore"):
        x = seed + ordinal.astype(np.uint64) * _BASE + np.uint64(step * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
    return (mix(mix(x)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def encode(p: Pieces, texts: list[str], keys: list[int], alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """The sampled piece ids of all texts, one after the other, and the offsets of the texts."""
    prepared = [SPACE + t.replace(SPACE, GIVEN).replace(" ", SPACE) if t else "" for t in texts]
    sizes = np.array([len(t) for t in prepared], np.int64)
    codes = _codes("".join(prepared))
    doc = np.repeat(np.arange(len(texts)), sizes)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    starts = _stretches(codes, doc)
    lengths = np.diff(np.append(starts, len(codes)))
    of = doc[starts]
    ordinal = np.arange(len(starts)) - np.searchsorted(of, of)
    seed = mix(np.array([(k if k is not None else -1) & (1 << 64) - 1 for k in keys], np.uint64) + _BASE)[of]
    # stretches are drawn on their own, so a long text's can be worked on in parts
    cuts = np.append(np.unique(np.searchsorted(starts, np.arange(0, len(codes), CHUNK))), len(starts))
    flat, owner = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            ids, steps = _drawn(p, codes, starts[a:b], lengths[a:b], seed[a:b], ordinal[a:b], alpha)
            flat.append(ids)
            owner.append(np.repeat(of[a:b], steps))
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    raw = np.flatnonzero(flat < 0)
    if len(raw):
        spelled = [chr(-1 - int(x)).encode() for x in flat[raw]]
        n = np.ones(len(flat), np.int64)
        n[raw] = [len(x) for x in spelled]
        place = np.cumsum(n) - n
        flat, owner = np.repeat(flat, n), np.repeat(owner, n)
        letters = np.frombuffer(b"".join(spelled), np.uint8)
        at = np.repeat(place[raw] - (np.cumsum(n[raw]) - n[raw]), n[raw]) + np.arange(len(letters))
        flat[at] = p.byte[letters]
    return flat.astype(np.int32), np.searchsorted(owner, np.arange(len(texts) + 1))


def _drawn(p: Pieces, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: np.ndarray, ordinal: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The pieces drawn for each stretch, in order, and their number by stretch; equal stretches share a lattice.

    Stretches are told apart by a hash of 64 bits and the length, then compared letter by letter.
    """
    into = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = codes[np.repeat(starts, lengths) + into]
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
    h = mix(np.add.reduceat(mix(letters.astype(np.uint64) + np.uint64(1)) * powers[into], np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    _, one, lattice = np.unique(h, return_index=True, return_inverse=True)
    if (lengths[one][lattice] != lengths).any() or (letters != codes[np.repeat(starts[one][lattice], lengths) + into]).any():
        raise ValueError("two stretches share a hash; change the base")
    taken = lengths[one]
    ends = np.cumsum(taken)
    own = codes[np.repeat(starts[one] - (ends - taken), taken) + np.arange(ends[-1])]
    first, cum, piece, long = _forward(p, own, ends - taken, alpha)
    node, left, active = ends[lattice] - 1, lengths.copy(), np.arange(len(starts))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    while len(active):
        u = _uniform(seed[active], ordinal[active], len(drawn))
        e = first[node[active]]
        up = np.arange(len(e))
        while len(up := up[u[up] >= cum[e[up]]]):
            e[up] += 1
        drawn.append((active, piece[e]))
        k = long[e].astype(np.int64)
        node[active] -= k
        left[active] -= k
        active = active[left[active] > 0]
    steps = np.zeros(len(starts), np.int64)
    for where, _ in drawn:
        steps[where] += 1
    begin = np.cumsum(steps) - steps
    flat = np.zeros(int(steps.sum()), np.int64)
    for step, (where, ids) in enumerate(drawn):
        flat[begin[where] + steps[where] - 1 - step] = ids
    return flat, steps


def decode(p: Pieces, ids: np.ndarray) -> bytes:
    """The UTF-8 bytes of a text from its ids, without the space that encoding puts in front."""
    return b"".join(map(p.raw.__getitem__, ids.tolist()))[1:]


def _groups(batch: pa.RecordBatch):
    keys, texts, size = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        keys.append(k)
        texts.append(t or "")
        size += len(texts[-1])
        if size >= CHUNK:
            yield keys, texts
            keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def sample_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id (bigint), ids (array of the sampled piece ids), n_pieces, ids_crc32.

    A segmentation is drawn with a probability in proportion to the product of its pieces' probabilities to the power
    alpha, by forward filtering and backward sampling. The draws are seeded by the row's id alone, so that they don't
    change with the partitioning, and rows with equal id and text get equal ids. Characters without a piece, and the
    space mark where the text itself holds it, become byte pieces, so that decoding gives back every text.

    Null or empty text has no pieces. A null id counts as -1 for the seed. An empty table gives an empty result; columns
    besides id and text are not read.
    """
    model = path or public_tokenizers.path(MODEL)

    def run(batches):
        p = pieces(model)
        for batch in batches:
            for keys, texts in _groups(batch):
                ids, offsets = encode(p, texts, keys, alpha)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "ids", "n_pieces", "ids_crc32"],
                )

    own = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return own.mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, ids_crc32 bigint")


def decode_pieces(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with `text`, the decoded text, and `text_sha256`, its lower-case hex digest; null ids decode to empty."""
    model = path or public_tokenizers.path(MODEL)
    kept = [c for c in encoded.columns if c not in ("text", "text_sha256")]

    def run(batches):
        p = pieces(model)
        for batch in batches:
            column = batch.column(kept.index(ids))
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = [decode(p, values[offsets[k] : offsets[k + 1]]) for k in range(i, i + part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x.decode() for x in raw], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])],
                    [*kept, "text", "text_sha256"],
                )

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string, text_sha256 string"
    return rows.mapInArrow(run, schema)
