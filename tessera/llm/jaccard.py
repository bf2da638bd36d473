"""Near copies by exact Jaccard similarity of word shingles.

1. Each text becomes the set of its shingles' hashes (as in ``simhash``: A-Z lowered, split
   at ASCII space; a text of fewer words than a shingle is one shingle, one without words
   the empty set). Texts of equal sets collapse to one *distinct text*, known by a 64-bit
   hash of its set.
2. Candidates: the anchor-point covering of the texts' SimHash fingerprints (``simhash``)
   ties those at most ``simhash.NEAR`` bits apart. A 64-bit fingerprint can't reach a
   similarity of 0.8 (its copies lie up to 20 bits apart), so ``BANDS`` keys of ``ROWS``
   min-hashes each add what it misses: a pair of similarity 0.8 shares no key with
   probability (1 - 0.8^6)^50 = 3e-7, a more similar pair with less. A bucket's texts are
   tied to the least of them.
3. Ties are decided by the exact Jaccard of the two texts: first each text's strongest tie,
   which joins a group of copies at a row a text, then all ties between what is still apart.
4. Buckets of three texts and more that still hold several groups are compared pair by pair
   (prefix filter, so no pair is missed there). A bucket is cut into blocks of ``BLOCK``
   shingles, each pair of blocks a task's work, so no task holds more than two blocks and a
   bucket of any size is spread.
5. Components of the edges found are the groups of near copies.

Edge cases: null text is an empty text, empty texts are copies of each other; a very long
text is one set, 8 bytes a shingle; repeated rows are one distinct text; ties between ids
don't arise, as ids hold the row's place; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._common import map_arrow, map_arrow_stream, texts, written
from ._graph import components

#: Keys of a text, min-hashes of a key; shingles of a block.
BANDS, ROWS, BLOCK = 50, 6, 1_000_000
_rng = np.random.default_rng(20240607)
_MIX = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, in their order and as often as they occur."""
    w = text.lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(hashes(text, words))


def bands(found: np.ndarray) -> np.ndarray:
    """The band keys of a set of hashes; the empty set has keys of its own."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, (_MIX[:, None] * short[None, i : i + 1024]).min(axis=1), out=least)
    key = _BAND.copy()
    for j, x in enumerate(least.reshape(BANDS, ROWS).T.astype(np.uint64)):
        key = (key ^ x) * _FOLD[j]
        key ^= key >> np.uint64(29)
    return key


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs [start, start + size), one after another."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the sets (of distinct hashes) just as all pairs of at least that
    similarity do; every edge is such a pair."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and both / (int(size.sum()) - both) >= similarity else []
    start = np.cumsum(size) - size
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rarest first
    doc = np.repeat(np.arange(n), size)
    ranks = rank[inverse]
    ranks = ranks[np.lexsort((ranks, doc))]
    # A pair's overlap is at least similarity times either size: the prefixes meet.
    prefix = np.array([max(0, s - math.ceil(similarity * s - 1e-9) + 1) if s else 0 for s in size.tolist()], np.int64)
    at = _flat(start, prefix)
    key, owner = ranks[at], doc[at]
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    left, seen, marked = np.ones(n, bool), np.zeros(n, bool), np.zeros(len(count), bool)
    rest, kept, edges = n, n, []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        rest -= 1
        queue = [seed]
        while queue and rest:
            x = queue.pop()
            if 2 * rest < kept:  # postings only of those not joined yet
                key, owner, kept = key[left[owner]], owner[left[owner]], rest
            mine = ranks[start[x] : start[x] + size[x]]
            low = np.searchsorted(key, mine[: prefix[x]], "left")
            high = np.searchsorted(key, mine[: prefix[x]], "right")
            seen[owner[_flat(low, high - low)]] = True
            near = np.flatnonzero(seen & left)
            seen[:] = False
            near = near[(size[near] >= similarity * size[x] - 1e-6) & (size[x] >= similarity * size[near] - 1e-6)]
            if not len(near):
                continue
            marked[mine] = True
            both = np.add.reduceat(marked[ranks[_flat(start[near], size[near])]], np.cumsum(size[near]) - size[near], dtype=np.int64)
            marked[mine] = False
            near = near[both / (size[near] + size[x] - both) >= similarity]
            left[near] = False
            rest -= len(near)
            queue.extend(near.tolist())
            edges.extend((x, y) for y in near.tolist())
    return edges


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(x, T.LongType()) for x in names])


def _placed(distinct: DataFrame) -> DataFrame:
    """(key, node): each distinct text under its band keys."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, BANDS))], names=["key", "node"])

    return map_arrow(distinct.select("node", "bands"), spread, _longs("key", "node"))


def _ties(placed: DataFrame) -> DataFrame:
    """(a, b): each distinct text tied to the least of those it shares a key with, a row for
    each such key."""
    least = placed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return placed.join(least, "key").where("a <> node").select("a", F.col("node").alias("b"))


def _covered(distinct: DataFrame) -> DataFrame:
    """(a, b): ties of the fingerprints' covering, and of texts with equal fingerprints."""
    of_fp = written(distinct.groupBy("fp").agg(F.min("node").alias("first")), "jaccard-fp")
    near = simhash.links(of_fp.select("fp"), of_fp.count(), simhash.NEAR)
    ends = [of_fp.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}")) for x in "ab"]
    apart = near.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    equal = distinct.join(of_fp, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(equal)


def _verified(pairs: DataFrame, held: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts in ``held`` (node, text) are near copies. Where one text
    is in many pairs, its side of the join is the one that execution may split."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), texts(batch, "x"), texts(batch, "y"), strict=True)):
                if a != last:
                    last, mine = a, shingles(x, words)
                other = shingles(y, words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both and both / (len(mine) + len(other) - both) >= similarity:
                    kept.append(i)
            at = np.array(kept, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in (0, 1)], names=["a", "b"])

    of_b = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = of_b.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return map_arrow_stream(both.select("a", "b", "x", "y"), decide, _longs("a", "b"), 200)


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs whose ends are in different groups of (node, root)."""
    for x in "ab":
        pairs = pairs.join(group.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    return pairs.where("root_a <> root_b").select("a", "b")


def _compared(placed: DataFrame, group: DataFrame, distinct: DataFrame, held: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges within buckets of three texts or more that hold several groups."""
    several = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key")
    members = placed.join(several, "key").join(group, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = members.join(distinct.select("node", "size"), "node")
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor("node").alias("mark"), F.count("*").alias("n"), F.sum("size").alias("size")).where("low <> high")
    once = open_.groupBy("mark", "n", "low", "high").agg(F.min(F.struct("key", "size")).alias("of"))  # buckets of the same texts
    blocks = once.select("of.key", F.expr(f"cast(ceil(of.size / {float(BLOCK)}) as int)").alias("blocks"))
    dealt = members.select("key", "node").join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    others = F.expr("case when blocks < 2 then array(mine) else filter(sequence(0, blocks - 1), i -> i <> mine) end")
    dealt = dealt.withColumn("other", F.explode(others)).select("key", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def decided() -> pa.RecordBatch:
            found = forest(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *place, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), texts(batch, "text"), strict=True):
                if place != at:
                    yield decided()
                    at, nodes, sets = place, [], []
                nodes.append(node)
                sets.append(shingles(text, words))
        yield decided()

    near = dealt.join(held, "node").select("key", "i", "j", "node", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return map_arrow_stream(near, compare, _longs("a", "b"), 200)


def kept_rows(docs: DataFrame, key_of: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(all, kept): the rows (id) of ``key_of`` (id, text), and those that stand for their
    group, one each, the least. ``id`` is a struct with field ``row``; ``docs`` (row, text)
    are the same rows, read again for the texts of candidates."""
    schema = T.StructType([T.StructField("id", key_of.schema["id"].dataType), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.BinaryType())])

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, fps, sizes, keys = [], [], [], []
        for text in texts(batch, "text"):
            raw = hashes(text, words)
            found = np.unique(raw)
            nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            fps.append(simhash.majority(raw) if len(raw) else 0)
            sizes.append(len(found))
            keys.append(bands(found).tobytes())
        columns = [np.array(x, np.uint64).view(np.int64) for x in (nodes, fps, sizes)]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(keys, pa.binary())], names=schema.names)

    rows = written(map_arrow(key_of.select("id", "text"), sketch, schema), "jaccard-rows")
    distinct = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "jaccard-distinct")
    placed = written(_placed(distinct), "jaccard-keys")
    ties = _ties(placed).unionByName(_covered(distinct)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ties = written(ties.groupBy("a", "b").agg(F.count("*").alias("n")), "jaccard-ties")
    candidates = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct, "node").select("node", F.col("least.row").alias("row"))
    held = written(docs.join(candidates, "row").select("node", "text"), "jaccard-texts")

    # A text's strongest tie is that with the most keys in common.
    best = ties.groupBy("b").agg(F.max(F.struct("n", -F.col("a"))).alias("m"))
    best = ties.join(best.select("b", (-F.col("m.col2")).alias("a")), ["a", "b"])
    edges = written(_verified(best.select("a", "b"), held, words, similarity), "jaccard-edges")
    left = _apart(ties.join(best.select("a", "b"), ["a", "b"], "left_anti"), components(edges))
    edges = written(edges.unionByName(_verified(left, held, words, similarity)), "jaccard-edges")
    edges = edges.unionByName(_compared(placed, components(edges), distinct, held, words, similarity))
    groups = components(edges).withColumnRenamed("node", "of")
    of_node = distinct.select("node", "least").join(groups, F.col("node") == F.col("of"), "left").select("least", F.coalesce("root", "node").alias("root"))
    return rows.select("id"), of_node.groupBy("root").agg(F.min("least").alias("id")).select("id")
