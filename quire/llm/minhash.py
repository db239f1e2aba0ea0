"""MinHash near-dedup: an inverted join on signature coordinates, then exact links on full shingle sets."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_groups import runs
from quire.llm.common import cut, is_heavy, join_by_count
from quire.llm.components import components
from quire.llm.shingles import mix, shingle_sets

#: Coordinates of a signature, and the share of pairs at the threshold that may be missed; above it fewer are.
COORDINATES = 48
MISSED = 5e-5

#: Slots of the table of coordinate-value counts, the one thing that is collected and sent to all tasks: 256 KB.
SLOTS = 1 << 16

#: Documents of a posting list, and shingles of a family, that meet in one task; larger ones are split into blocks.
LIST_BLOCK = 4096
FAMILY_BLOCK = 50_000


def matches(percent: int) -> int:
    """How many coordinates must agree for a pair to be looked at: the most that all but MISSED of the pairs at the threshold have.

    A coordinate agrees with the probability of the similarity, so their number is binomial: at 80 per cent 38.4 of 48 in
    the mean, and fewer than 27 in about three of 100,000 pairs. One is the least that can be asked for: below about 19
    per cent more pairs are missed.
    """
    p, below, k = percent / 100, 0.0, 0
    while k < COORDINATES and (below := below + comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) <= MISSED:
        k += 1
    return max(k, 1)


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _signature(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Per coordinate the least 32-bit hash over the set, a slice of the set at a time."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, ((s[i : i + 4096, None] * a[None, :]) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype("<u4")


def signatures(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """doc_id, row (hash of the text), n (size of the shingle set), digest (of the whole set) and sig (COORDINATES 32-bit minima)."""

    def sign(batches):
        a = _multipliers(COORDINATES)
        for batch in batches:
            n, digest, sig = [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(_signature(s, a).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "digest", "sig"])

    own = _own(docs, id, text).select("doc_id", "row", "t")
    return own.mapInArrow(sign, "doc_id bigint, row bigint, n bigint, digest binary, sig binary")


def _own(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("row"), t.alias("t"))


def _keys(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's signatures as rows, and the 64-bit key of each coordinate with its value."""
    sig = np.frombuffer(b"".join(batch.column(at).to_pylist()), "<u4").reshape(-1, COORDINATES)
    return sig, mix(sig.astype(np.uint64) | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How often the coordinate-value pairs of each slot occur, over all sets; SLOTS numbers."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((_keys(batch, 0)[1] & np.uint64(SLOTS - 1)).astype(np.int64).ravel(), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    rows = sets.select("sig").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for slot, n in rows:
        out[slot] = n
    return out


def _postings(sets: DataFrame, counts: np.ndarray, least: int) -> DataFrame:
    """Each set under the first COORDINATES - least + 1 of its coordinate-value pairs, the rarest by slot first.

    Two sets that agree in `least` pairs share one of these, whatever the order, as long as all sets follow the same.
    The rarest-first order keeps frequent values out of the lists.
    """
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    prefix = COORDINATES - least + 1

    def post(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, keys = _keys(batch, 2)
            rank = sent.value[(keys & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((keys, rank), axis=1)[:, :prefix]
            key = np.take_along_axis(keys, order, 1).ravel().view(np.int64)
            full = np.take_along_axis(rank, order, 1).ravel()
            row = np.repeat(np.arange(batch.num_rows), prefix)
            short = [x.tobytes() for x in sig.astype(np.uint8)]
            columns = [pa.array(key), batch.column(0).take(row), batch.column(1).take(row), pa.array(short, pa.binary()).take(row)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(full)], ["key", "node", "n", "sig", "most"])

    wanted = sets.select("node", "n", "sig")
    return wanted.mapInArrow(post, "key bigint, node bigint, n bigint, sig binary, most bigint")


def _spanning(m: int, near) -> list[tuple[int, int]]:
    """Edges that span the components of the graph on 0..m-1; near(i, others) is a mask of others linked to i.

    Each node is compared once with the nodes not yet reached, so that a group of like documents costs little more
    than one comparison each, and at most m - 1 edges come out.
    """
    rest, edges = np.arange(m), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            found, rest = rest[hit], rest[~hit]
            edges += [(root, x) for x in found]
            todo += list(found)
    return edges


def _candidates(postings: DataFrame, total: int, least: int, percent: int) -> DataFrame:
    """Edges (u, v) that span the sets which agree in `least` coordinates, list by list; postings are total rows.

    Lists longer than LIST_BLOCK are split into blocks that meet pair by pair, so no task holds a whole one. Those of
    heavy keys, fewer than HEAVY, are told by a broadcast table, the other long ones by a shuffled join.
    """
    columns = ["key", "node", "n", "sig"]
    single = lambda rows: rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "n", "sig")
    crowded = postings.where(F.col("most") > LIST_BLOCK).select(columns)
    long = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > LIST_BLOCK)
    long = cut(long.select("key", F.ceil(F.col("count") / LIST_BLOCK).cast("int").alias("blocks"), "count"))
    heavy = F.broadcast(long.where(is_heavy(total, "count")).select("key"))
    others = long.where(~is_heavy(total, "count")).select("key").hint("merge")
    rest = crowded.join(heavy, "key", "left_anti").join(others, "key", "left_anti").select(columns)
    short = single(postings.where(F.col("most") <= LIST_BLOCK).select(columns).unionByName(rest))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = join_by_count(crowded, long, ["key"], total, n="count").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "sig")
    return _linked_lists(short.unionByName(blocked), least, percent)


def _linked_lists(dealt: DataFrame, least: int, percent: int) -> DataFrame:
    """Edges that span the near sets of each (key, i, j), which meet in one task."""

    def link(batches):
        for table, at in runs(batches, ["key", "i", "j"]):
            many = np.flatnonzero(np.diff(at) > 1)
            if not len(many):
                continue
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            sig = table.column("sig").combine_chunks()
            sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, COORDINATES)
            u, v = [], []
            for g in many:
                a, b = at[g], at[g + 1]
                own, sizes = sig[a:b], n[a:b]

                def near(i, others, own=own, sizes=sizes):
                    like = (own[others] == own[i]).sum(axis=1) >= least
                    return like & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))

                for x, y in _spanning(b - a, near):
                    u.append(node[a + x])
                    v.append(node[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(link, "u bigint, v bigint")


def _exact_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """members: family, i, j, node, t. Edges that span, in each (family, i, j), the pairs that are similar enough."""

    def link(batches):
        for table, at in runs(batches, ["family", "i", "j"]):
            node, texts = table.column("node").to_numpy(), table.column("t")
            u, v = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a < 2:
                    continue
                sets = list(shingle_sets(texts.slice(a, b - a).combine_chunks(), width))
                _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                sizes = np.array([len(s) for s in sets])
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                seen = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)

                def near(i, others, ids=ids, sizes=sizes, bounds=bounds, seen=seen):
                    mine = ids[bounds[i] : bounds[i + 1]]
                    seen[mine] = 1
                    lengths = sizes[others]
                    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                    flat = np.repeat(bounds[others] - starts, lengths) + np.arange(lengths.sum())
                    both = np.add.reduceat(seen[ids[flat]], starts) if len(flat) else np.zeros(len(others), np.int64)
                    seen[mine] = 0
                    return 100 * both >= percent * (lengths + sizes[i] - both)

                for x, y in _spanning(b - a, near):
                    u.append(node[a + x])
                    v.append(node[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    placed = members.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return placed.mapInArrow(link, "u bigint, v bigint")


def _confirmed(docs: DataFrame, families: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """The exact links within families (node, row, family, n), spanning each family's true components.

    A family of up to `block` shingles meets in one task. A larger one is dealt into blocks: first each block alone,
    with the family's first document in all of them; then the documents outside the family's largest component so far
    meet every block. Documents inside one component needn't meet again, so no link between components is lost.
    """
    sizes = families.groupBy("family").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("members"))
    placed = join_by_count(families, cut(sizes), ["family"], families.count(), n="members").withColumn("blocks", F.ceil(F.col("s") / block).cast("int"))
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("node", "row", "family", "blocks", "block"))
    meant = (docs["doc_id"] == placed["node"]) & (docs["row"] == placed["row"])
    texts = cut(docs.join(placed.hint("merge"), meant).select("node", "family", "blocks", "block", "t"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = F.explode(F.when(F.col("node") == F.col("family"), everywhere).otherwise(F.array("block")))
    alone = cut(_exact_links(texts.select("family", spread.alias("i"), F.lit(-1).alias("j"), "node", "t"), width, percent))
    dealt = placed.where("blocks > 1").select("node", "family").distinct()
    large = dealt.join(components(alone).hint("merge"), "node", "left")
    large = cut(large.select("node", "family", F.coalesce("component", "node").alias("component")))
    counted = large.groupBy("family", "component").agg(F.count(F.lit(1)).alias("count"))
    main = counted.groupBy("family").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.sum("count").alias("members"))
    outside = join_by_count(large, cut(main), ["family"], large.count(), n="members").where(F.col("component") != F.col("main"))
    outside = cut(outside.select("node", "family"))
    parts = outside.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("parts"))
    parts = cut(parts.join(main.select("family", "members").hint("merge"), "family"))
    of = texts.where("blocks > 1").select("node", "family", "blocks", "block", "t")
    met = join_by_count(of, parts, ["family"], large.count(), n="members")
    is_outside = outside.select("node", F.lit(True).alias("out"))
    met = met.join(is_outside.hint("merge"), "node", "left")
    own = met.where("out").select("family", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("i"), F.explode(everywhere).alias("j"), "node", "t")
    whole = met.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), "node", "t")
    return alone.unionByName(_exact_links(own.unionByName(whole), width, percent))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, family_block: int = FAMILY_BLOCK
) -> DataFrame:
    """One row per document: doc_id (bigint), n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; a document's set holds its distinct shingles of `width` words,
    or its whole sequence if it has fewer. Documents are linked if 100 * intersection >= percent * union, which is
    confirmed on full sets; component_id is the least id reachable. Null, empty and wordless texts have an empty set
    and are linked with nothing, not even each other.

    Equal sets are folded into their least id first; the rest compares different sets only. Each row has the class of its
    own set, also where rows share an id. Sets whose least id is the same are one class. A null id is linked to nothing
    but equal sets, and stays if no other id has its set. Ties in size or signature make no difference. An empty table
    gives an empty result; columns besides id and text are not read.

    Links are found with a recall of over 0.9999 at a threshold of 20 per cent or more (see matches()) and are exact where found.
    """
    return _labelled(docs, id, text, width, percent, family_block).drop("row")


def _labelled(docs: DataFrame, id: str, text: str, width: int, percent: int, family_block: int) -> DataFrame:
    """The rows of near_duplicates, with the hash of their text as row."""
    if not 0 < percent <= 100:
        raise ValueError("a threshold lies above 0 and is 100 per cent at most")
    least = matches(percent)
    signed = cut(signatures(docs, id, text, width))
    # equal sets are counted within tasks first; one of the texts with a set stands for them
    named = F.col("doc_id").isNotNull()
    folded = signed.where("n > 0").groupBy("digest").agg(F.min(F.when(named, F.struct("doc_id", "row", "n", "sig"))).alias("first"), F.count(F.lit(1)).alias("rows"))
    folded = cut(folded.select("digest", "rows", F.col("first.doc_id").alias("node"), "first.row", "first.n", "first.sig"))
    sets = folded.where("node is not null").select("node", "row", "n", "sig")
    counts = _slot_counts(sets)
    postings = _postings(sets, counts, least)
    linked = components(_candidates(postings, sets.count() * (COORDINATES - least + 1), least, percent))
    families = sets.select("node", "row", "n").join(linked.hint("merge"), "node").withColumnRenamed("component", "family")
    joined = components(_confirmed(_own(docs, id, text), cut(families), width, percent, family_block)).where("node <> component")
    # what each set's documents are called
    called = folded.select("digest", "rows", "node").join(joined.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("name"), "rows")
    found = join_by_count(signed.select("doc_id", "row", "n", "digest"), cut(called), ["digest"], signed.count(), "left", n="rows")
    component = F.coalesce("name", "doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
        "row",
    )


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the least id of each class of near copies; their columns stay as they are.

    Null, empty and wordless texts stay, as they are linked with nothing. Repeated rows of the id that stays, stay. A
    null id goes if another id has its set. An empty table stays empty.
    """
    gone = _labelled(docs, id, text, width, percent, FAMILY_BLOCK).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).distinct()
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.join(gone.hint("merge"), F.col(f"`{id}`").cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(t) == F.col("__row")), "left_anti")
