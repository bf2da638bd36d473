"""SimHash near-duplicates by anchor-point covering.

1. ``fingerprint``: 64-bit SimHash of each whole text over its word shingles.
2. Equal fingerprints collapse to one *distinct fingerprint* (exact copies cost one row).
3. The 64 bits are cut into ``m`` segments. Two fingerprints at most ``t`` bits apart are
   at most ``t // m`` apart in one segment. In each segment the anchors are the words of a
   covering code: a perfect Hamming code on the first ``2^r - 1`` bits (covering radius 1)
   times all words on the remaining bits. A fingerprint is at home at the anchor that
   covers it (within radius 1) and is replicated to every anchor within
   ``1 + t // m`` of it: a link's one end meets the other's home anchor for certain.
4. Per anchor, those at home are compared with all there; a batch of anchors yields a
   spanning forest of its links, not all pairs, so a group of copies costs rows in proportion
   to its size. An anchor with more than ``HOMES`` homes is cut into blocks of homes, each a
   task's work, to which all others there stream by; a task holds one block and a chunk.
5. Components of the forest edges by min-label contraction (``_graph.components``).

The number of segments is chosen by the number of distinct fingerprints (fewer, longer
segments mean more replicas and fewer comparisons); each choice finds every link.

Edge cases: null text is an empty text; a very long text is hashed whole, some thousand
shingles at a time; a text of fewer words than a shingle is hashed
whole; a text without words has fingerprint 0 and is linked like any other; repeated rows
and repeated ids keep their rows; an empty table gives no rows; null ids are kept, and a
component's id is its smallest id that isn't null (null if there is none); ties don't arise. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from ._common import BROADCAST_ROWS, column, fresh, map_arrow, map_arrow_stream, numbered, texts, without, written
from ._graph import components

BITS = 64
#: Groups up to this many fingerprints are compared pair by pair; bits that links may differ in.
SMALL, NEAR = 48, 4
#: Homes of an anchor that one task holds; fingerprints compared with them at once; bits of a
#: key that tell an anchor's blocks apart.
HOMES, CHUNK, KEY_BITS = 8192, 1 << 18, 24


def fingerprint_of(text: bytes, words: int) -> int:
    """Unsigned SimHash of one text: bit i is set if over half the shingle hashes set it."""
    h = jaccard.hashes(text, words)
    return majority(h) if len(h) else 0


def majority(h: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``df``; the fingerprint as a signed long."""
    rows = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint_of(t, words) for t in texts(batch, "text")], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return map_arrow(rows, run, schema)


class Segment:
    """A covering code on bits [low, low + width) and the anchors near a word.

    The first ``2^r - 1`` bits carry a Hamming code; the syndrome of a word alone fixes
    which error patterns lead from it to a code word, so anchors come from a small table.
    """

    def __init__(self, low: int, width: int, r: int, reach: int) -> None:
        self.low, self.mask, n = low, (1 << width) - 1, (1 << r) - 1
        self.checks = [sum(1 << (i - 1) for i in range(1, n + 1) if i >> b & 1) for b in range(r)]
        self.errors: list[np.ndarray] = []
        for s in range(1 << r):
            found = []
            for weight in range(reach + 1):
                for bits in combinations(range(width), weight):
                    syndrome = 0
                    for i in bits:
                        syndrome ^= i + 1 if i < n else 0
                    if syndrome == s:
                        found.append(sum(1 << i for i in bits))
            home = 1 << (s - 1) if s else 0
            found.remove(home)
            self.errors.append(np.array([home, *found], dtype=np.uint64))  # home first

    def anchors(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of fp, anchor, at home) of each fingerprint, for each syndrome."""
        x = (fp >> np.uint64(self.low)) & np.uint64(self.mask)
        syndrome = np.zeros(len(fp), np.int64)
        for b, check in enumerate(self.checks):
            syndrome |= (np.bitwise_count(x & np.uint64(check)) & 1).astype(np.int64) << b
        for s, errors in enumerate(self.errors):
            rows = np.flatnonzero(syndrome == s)
            if len(rows):
                yield np.repeat(rows, len(errors)), (x[rows][:, None] ^ errors[None, :]).ravel(), np.tile(np.arange(len(errors)) == 0, len(rows))


def covering(distinct: int, threshold: int) -> list[Segment]:
    """The cheapest covering for so many distinct fingerprints; all are exact."""
    plans = []
    for m, r in ((4, 3), (3, 4), (2, 5)):
        if m > threshold + 1:
            continue
        reach = 1 + threshold // m
        widths = [BITS // m + (i >= m - BITS % m) for i in range(m)]
        # A plan's cost before its tables are built: rows to shuffle, and pairs to compare.
        from math import comb

        near = [sum(comb(w, i) for i in range(reach + 1)) / 2**r for w in widths]
        cost = sum(distinct * a + 0.003 * distinct * distinct * a / 2.0 ** (w - r) for a, w in zip(near, widths, strict=True))
        plans.append((cost, widths, r, reach))
    _, widths, r, reach = min(plans)
    return [Segment(sum(widths[:i]), w, r, reach) for i, w in enumerate(widths)]


class _Forest:
    """Union-find over the fingerprints of one batch; the root is the smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in self.up]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _link_dense(fp: np.ndarray, limit: int, forest: _Forest) -> None:
    """Links of a group most of which is linked: what is reached isn't compared again."""
    left = fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= limit
            if near.any():
                for y in left[near].view(np.int64).tolist():
                    forest.join(int(x.view(np.int64)), y)
                queue.extend(left[near])
                left = left[~near]


def _link_homes(fp: np.ndarray, home: np.ndarray, limit: int, forest: _Forest) -> None:
    """Links of one anchor's homes with all its fingerprints, some homes at a time. Where
    links are many, those they touch are linked as a dense group instead of one by one."""
    homes = np.flatnonzero(home)
    step = max(1, (1 << 20) // len(fp))
    touched = np.zeros(len(fp), bool)
    for i in range(0, len(homes), step):
        part = homes[i : i + step]
        near = np.bitwise_count(fp[part][:, None] ^ fp[None, :]) <= limit
        near[np.arange(len(part)), part] = False
        if np.count_nonzero(near) > 4 * len(fp):
            touched[part[near.any(axis=1)]] = True
            touched |= near.any(axis=0)
            continue
        a, b = np.nonzero(near)
        for x, y in zip(fp[part[a]].view(np.int64).tolist(), fp[b].view(np.int64).tolist(), strict=True):
            forest.join(x, y)
    if touched.any():
        _link_dense(fp[touched], limit, forest)


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, limit: int, forest: _Forest) -> None:
    """Compare within each run of equal ``key``: homes against all."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(key)])))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        _link_homes(fp[s : s + n], home[s : s + n], limit, forest)
    start_of, size_of = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    rows = np.flatnonzero(home & (size_of <= SMALL) & (size_of > 1))
    for i in range(0, len(rows), 1 << 16):
        part = rows[i : i + (1 << 16)]
        n = size_of[part]
        a = np.repeat(part, n)
        b = np.repeat(start_of[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(a))
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= limit) & (a != b)
        for x, y in zip(fp[a[near]].view(np.int64).tolist(), fp[b[near]].view(np.int64).tolist(), strict=True):
            forest.join(x, y)


def links(distinct: DataFrame, count: int, threshold: int = NEAR) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints (column fp) just as all links of
    at most ``threshold`` bits do; ``count`` is about how many there are."""
    segments = covering(count, threshold)
    fields = [T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())]

    def placed(at_home: bool) -> DataFrame:
        def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, rows_, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for i, segment in enumerate(segments):
                for rows, anchor, home in segment.anchors(fp):
                    if at_home:
                        rows, anchor, home = rows[home], anchor[home], home[home]
                    keys.append(((anchor * np.uint64(len(segments)) + np.uint64(i)) << np.uint64(KEY_BITS)).view(np.int64))
                    rows_.append(rows)
                    homes.append(home)
            columns = [pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows_)].view(np.int64)), pa.array(np.concatenate(homes))]
            return pa.RecordBatch.from_arrays(columns, names=["key", "fp", "home"])

        return map_arrow(distinct.select("fp"), replicate, T.StructType(fields))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        forest = _Forest()
        for batch in batches:
            k, f, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held = [np.concatenate(x) for x in zip(held, (k, f.view(np.uint64), h), strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # keys are sorted; the last one may go on
            if last:
                _compare(*(x[:last] for x in held), threshold, forest)
                held = [x[last:] for x in held]
            if len(held[0]) > CHUNK:  # its homes came first and stay for what follows
                _compare(*held, threshold, forest)
                held = [x[held[2]] for x in held]
            if len(forest.up) > 200_000:
                yield forest.batch()
        if len(held[0]):
            _compare(*held, threshold, forest)
        if forest.up:
            yield forest.batch()

    places = placed(False)
    crowded = placed(True).groupBy("key").agg(F.count("*").alias("n")).where(f"n > {HOMES}")
    crowded = written(crowded.select("key", F.expr(f"cast(ceil(n / {float(HOMES)}) as int)").alias("blocks")), "simhash-crowded")
    n = crowded.count()
    if n:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = places.join(F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        places = dealt.select((F.col("key") + F.col("block")).alias("key"), "fp", (F.col("home") & F.coalesce(mine == F.col("block"), F.lit(True))).alias("home"))
    near = places.repartition("key").sortWithinPartitions("key", F.desc("home"))
    return map_arrow_stream(near, compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]), 50_000)


def near_duplicates(df: DataFrame, words: int = 4, threshold: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links."""
    rows = written(fingerprint(df, words, id_col, text_col), "simhash-fp")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    groups = components(links(distinct, distinct.count(), threshold)).withColumnRenamed("node", "fp")
    # Only fingerprints that have links, and of each group its root, take part in the join.
    linked = written(groups.join(distinct, "fp").select("fp", "root", "least"), "simhash-linked")
    of_root = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    named = linked.join(F.broadcast(of_root) if of_root.count() <= BROADCAST_ROWS else of_root, "root").select("fp", "component_id")
    of_fp = written(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return rows.join(of_fp, "fp").select("id", "fp", "component_id")


def deduplicate(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest id. Near copies
    are texts whose sets of word shingles have that Jaccard similarity at least, decided by
    the sets themselves (``jaccard``), as fingerprints alone can't tell 0.8 from 0.6.

    Rows that share that id (repeated rows) are told apart by their place; one stays. Rows
    with a null id belong to groups by text and stay only if their whole group has no id.
    Extra columns pass through, whatever their names.
    """
    columns, row = df.columns, fresh(df, "__row")
    df = numbered(df, "simhash-docs", row)
    keyed = df.select(F.struct(column(id_col).isNull().alias("none"), column(id_col).alias("id"), F.col(row).alias("row")).alias("id"), column(text_col).alias("text"))
    rows, kept = jaccard.kept_rows(df.select(F.col(row).alias("row"), column(text_col).alias("text")), keyed, words, similarity)
    kept = written(kept.select(F.col("id.row").alias("row")), "simhash-kept")
    gone = written(rows.select(F.col("id.row").alias("row")).join(kept, "row", "left_anti"), "simhash-gone")
    return without(df, gone, row).select(*map(column, columns))
