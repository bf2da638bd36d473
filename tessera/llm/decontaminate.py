"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one window). A
window's elements are its word shingles of ``SHINGLE`` words (all words, if it has fewer).

1. One pass over the whole texts marks the places of shingles that some item has too, by a
   Bloom filter of bounded size; each maximal run of marked words is kept with its place.
   A window that occurs lies within one run, for all of its shingles are marked.
2. Shingles are ordered by rarity: the number of runs of all documents that hold them.
   Exact containment needs one prefix element only: each window's rarest shingle.
3. Runs join windows on that shingle (Spark picks the join by the sides' sizes), behind a
   length filter (the run has the window's words) and a positional filter (the window
   starts and ends within the run), and are verified word by word.
4. Hit words are the union of the verified places, items those that have such a window.

Equal windows of many items are one window in the join; items are added per document.

Edge cases: null or empty texts have no words and are never hit; a very long text is read
whole, what is kept of it are its runs of marked words; null ids are kept for
documents; items with null id count as hits without being named, their texts' windows
still hit words; repeated item ids count once; repeated document rows each get their
result; empty tables give no rows or no hits. Extra columns are ignored, or passed through
by ``clean``, whatever their names; ties don't arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import column, fresh, map_arrow, map_arrow_stream, numbered, texts, without, written

#: Words in a shingle; bits of the Bloom filter at most (16 MB, whatever the benchmark).
SHINGLE, MAX_BITS = 5, 1 << 27

#: A-Z becomes a-z, other ASCII that is no word character a space; bytes from 0x80 stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class _Seen(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Hasher:
    """64-bit hashes of word shingles; remembers words."""

    def __init__(self) -> None:
        self.seen = _Seen()

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > 200_000:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def shingles(h: np.ndarray, k: int) -> np.ndarray:
        """A hash for each place where k words begin; k is part of the hash."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + n]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
        return out


def _flat(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, text, size, k, at, hash): each item's windows and their shingles, exploded."""
    rows = items.select(column(id_col).alias("item"), column(text_col).alias("text"))
    shingle = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("hash", T.LongType())])
    piece = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("shingles", T.ArrayType(shingle))])
    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType), T.StructField("windows", T.ArrayType(piece))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher, out = Hasher(), []
        for text in texts(batch, "text"):
            words, found = words_of(text), {}
            h = hasher.words(words)
            size = min(window, len(words))
            for s in range(len(words) - size + 1 if words else 0):
                k = min(SHINGLE, size)
                found[b" ".join(words[s : s + size])] = (size, k, [{"at": i, "hash": x} for i, x in enumerate(Hasher.shingles(h[s : s + size], k).view(np.int64).tolist())])
            out.append([{"text": t.decode(), "size": a, "k": b, "shingles": c} for t, (a, b, c) in found.items()])
        inner = pa.struct([("text", pa.string()), ("size", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())])))])
        return pa.RecordBatch.from_arrays([batch.column(0), _flat(out, inner)], names=["item", "windows"])

    found = map_arrow(rows, run, schema).select("item", F.explode("windows").alias("w")).select("item", "w.*")
    return found.select("item", "text", "size", "k", F.explode("shingles").alias("s")).select("item", "text", "size", "k", "s.at", "s.hash")


def bloom(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits of a filter over column ``hash``; its size follows ``count`` up to a bound.
    Partitions send their set bits combined; the driver holds one filter."""
    bits = 1 << 16
    while bits < MAX_BITS and bits < 64 * count:
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for x in _places(h, bits):
                np.bitwise_or.at(local, x >> np.uint64(3), np.left_shift(np.uint8(1), (x & np.uint64(7)).astype(np.uint8)))
        if local.any():
            yield pa.RecordBatch.from_arrays([pa.array([local.tobytes()], pa.binary())], names=["bits"])

    for row in map_arrow_stream(hashes.select("hash").coalesce(8), run, T.StructType([T.StructField("bits", T.BinaryType())]), 100_000).toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]


def runs_of(docs: DataFrame, filter_bits: np.ndarray, sizes: list[int], shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, runs): whole texts, and the runs of marked words in them."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    entry = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("hash", T.LongType())])
    piece = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("shingles", T.ArrayType(entry))])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(piece))])
    inner = pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())])))])
    broadcast = rows.sparkSession.sparkContext.broadcast(filter_bits)  # at most MAX_BITS bits
    bits = len(filter_bits) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), broadcast.value
        for batch in batches:
            counts, out = [], []
            for text in texts(batch, "text"):
                words = words_of(text)
                counts.append(len(words))
                h = hasher.words(words)
                cover, marked = np.zeros(len(words) + 1, np.int32), []
                for k in sizes:
                    s = Hasher.shingles(h, k)
                    if not len(s):
                        continue
                    hit = np.ones(len(s), bool)
                    for x in _places(s, bits):
                        hit &= (table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at = np.flatnonzero(hit)
                    if len(at):
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + k, -1)
                        marked.append((k, at, s[at].view(np.int64)))
                found = []
                if marked:
                    on = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                    edges = np.flatnonzero(on[1:] != on[:-1])
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        if b - a >= shortest:
                            inside = []
                            for k, at, values in marked:
                                lo, hi = np.searchsorted(at, (a, b))
                                inside += [{"k": k, "at": i - a, "hash": x} for i, x in zip(at[lo:hi].tolist(), values[lo:hi].tolist(), strict=True)]
                            found.append({"start": a, "words": [w.decode() for w in words[a:b]], "shingles": inside})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.list_(inner))], names=["id", "n_words", "runs"])

    return map_arrow_stream(rows, run, schema).withColumn("row", F.monotonically_increasing_id())


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items): one row per document row; items are sorted strings."""
    shingles = written(windows_of(items, window, item_col, item_text_col), "decontam-windows")
    kinds = shingles.agg(F.countDistinct("hash").alias("n"), F.collect_set("k").alias("ks"), F.min("size").alias("least")).first()  # ks: at most SHINGLE values
    table = bloom(shingles.select("hash").distinct(), kinds["n"])
    rows = written(runs_of(docs, table, sorted(kinds["ks"]), kinds["least"] or 1, id_col, text_col), "decontam-runs")

    runs = rows.select("row", F.posexplode("runs").alias("run", "r")).select("row", "run", "r.start", "r.words")
    places = rows.select("row", F.posexplode("runs").alias("run", "r")).select("row", "run", F.explode("r.shingles").alias("s")).select("row", "run", "s.k", "s.at", "s.hash")
    seen = places.groupBy("hash").agg(F.count("*").alias("seen"))
    pieces = shingles.select("text", "size", "k", "at", "hash").distinct().join(seen, "hash")
    rarest = pieces.groupBy("text", "size", "k").agg(F.min(F.struct("seen", "at", "hash")).alias("rare"))
    prefix = written(rarest.select("text", "size", "k", F.col("rare.at").alias("offset"), F.col("rare.hash").alias("hash")), "decontam-prefix")

    near = places.join(prefix, ["hash", "k"]).select("row", "run", "at", "offset", "text", "size")
    fits = (F.size("words") >= F.col("size")) & (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("size") <= F.size("words"))
    found = near.join(runs, ["row", "run"]).where(fits).where(F.expr("concat_ws(' ', slice(words, at - offset + 1, size)) = text"))
    hits = written(found.select("row", (F.col("start") + F.col("at") - F.col("offset")).alias("a"), (F.col("start") + F.col("at") - F.col("offset") + F.col("size")).alias("b"), "text"), "decontam-hits")

    # The union of a document's places: at most one (start, end) per word and window length.
    spans = hits.select("row", "a", "b").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    spans = spans.select("row", F.expr("aggregate(spans, struct(0L as n, 0 as upto), (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.upto)) as n, greatest(s.upto, x.b) as upto)).n").alias("n_hit"))
    of_window = shingles.select("text", F.col("item").cast("string").alias("item")).where("item is not null").distinct()
    named = hits.select("row", "text").distinct().join(of_window, "text").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.select("row", "id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    return out.select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    row = fresh(docs, "__row")
    marked = numbered(docs, "decontam-docs", row)
    found = contamination(marked, items, window, row, text_col, item_col, item_text_col)
    gone = written(found.where("n_hit > 0").select(F.col("id").alias("row")), "decontam-gone")
    return without(marked, gone, row).select(*map(column, docs.columns))
