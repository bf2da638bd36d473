"""Substring dedup: words of recurring passages, found by sharded Aho-Corasick automata.

A window is ``window`` consecutive words of a text; a word goes if a window that covers it
occurs anywhere else too. Rows are known by their place in the files (``_common.numbered``).

1. *Candidates.* Each window has an anchor, its phrase of ``PHRASE`` words of least hash (the
   first of equals), so equal windows have equal anchors, and about 8 % of all places are
   anchors. One pass counts anchors; those that recur go to a Bloom filter of bounded size.
2. *Confirmed passages.* A second pass sends the hash of each window whose anchor may recur;
   hashes are counted before and after the shuffle. Recurring windows are put together to the
   longest phrases all of whose windows occur together always: two neighbouring windows do if
   they occur equally often and the xor of the (hashed) places before the one's occurrences
   is that of the other's. A phrase is cut to ``LONGEST`` windows, and read from the text of
   the first document that has it. Every occurrence of a recurring window then lies in an
   occurrence of its phrase, and each recurring window is in one phrase only.
3. *Automata.* Phrases are dealt to shards by the anchor of their first window; a shard of
   many words is split, so that an automaton has about ``SHARD_WORDS`` nodes at most. A third
   pass sends the parts of texts that may hold a phrase of a shard to it: the surroundings of
   such anchors, far enough for the longest phrase. A shard with parts of many documents is
   dealt to several tasks, each with the automaton. A task compiles a shard's phrases, a word
   being one letter of pyahocorasick's, and streams the parts through it.
4. A phrase that is located once only is a chance agreement of hashes and is dropped, so the
   result rests on words alone. What is left is covered words; they are removed.

Nothing but the filters (16 MB at most), one-row totals and places of ``BROADCAST_ROWS`` rows
is broadcast; no task holds more than one shard's automaton and a batch of texts.

Edge cases: null texts have no words and stay empty; texts shorter than a window are never hit;
very long texts are read whole, in a batch of their own; repeated rows are copies of one
another, so all of their windows recur; overlapping occurrences within a text count; null and
repeated ids stay; an empty table gives no rows. Columns besides id and text are ignored,
whatever their names. Ties don't arise: which occurrence a phrase is read from changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_ROWS, column, map_arrow, map_arrow_stream, numbered, texts, without, written
from .decontaminate import _places, bloom

#: Words of an anchor at most, windows of a phrase at most, words of an automaton and
#: documents of a task about.
PHRASE, LONGEST, SHARD_WORDS, TASK_DOCS = 12, 64, 200_000, 2_000
#: Rows of a batch that is sent, texts that are hashed together (their bytes take 24 each then).
SENT, TEXTS = 1 << 16, 250
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of values: differences of one running sum of values times powers
    of an odd number, brought to the same power. Equal stretches have equal hashes wherever
    they lie; different ones may have, which costs work but no right result."""
    n = len(values)
    up, down = np.full(n, _ODD, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumprod(up, out=up)
    np.multiply(up, values, out=up)
    np.cumsum(up, out=sums[1:])
    x = sums[ends] - sums[starts]
    x *= np.cumprod(down, out=down)[starts]
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window, of its words' hashes."""
    at = np.arange(max(0, len(h) - window + 1))
    return _stretches(h, at, at + window)


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the phrases at each place, place of each window's anchor): the least by the
    upper half of its hash, the first of equals."""
    size = min(PHRASE, window)
    phrases, span = window_hashes(h, size), window - size + 1
    if len(phrases) < span:
        return phrases, np.zeros(0, np.int64)
    half, width = np.uint64(32), 1
    least = (phrases >> half << half) | np.arange(len(phrases), dtype=np.uint64)
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(phrases) - span + 1], least[span - width :])
    return phrases, (least & np.uint64(2**32 - 1)).astype(np.int64)


class _Batch:
    """The texts of a batch, one after another: where their words are, the words' hashes and
    the windows' anchors. Windows that cross texts are not ``inside``."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.bytes = b"\n".join([*texts, b""])
        values = np.frombuffer(self.bytes or b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[values], [True])).view(np.int8)))
        self.begin, self.end = edges[::2], edges[1::2]
        offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.starts = np.concatenate((np.zeros(1, np.int64), np.searchsorted(self.begin, offsets)))
        self.h = _stretches(values, self.begin, self.end)
        self.phrases, self.anchor = anchors(self.h, window)
        n = len(self.anchor)
        self.inside = np.arange(n) + window <= np.repeat(self.starts[1:], np.diff(self.starts))[:n]
        self.used = np.zeros(len(self.phrases), bool)
        self.used[self.anchor[self.inside]] = True

    def cut(self, first: int, last: int) -> bytes:
        """The words from ``first`` to before ``last`` as they stand in the text."""
        return self.bytes[self.begin[first] : self.end[last - 1]]

    def marked(self, table: np.ndarray) -> np.ndarray:
        """Places of anchors that may be in the filter."""
        at = np.flatnonzero(self.used)
        return at[maybe_in(self.phrases[at], table)]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def maybe_in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    hit = np.ones(len(h), bool)
    for x in _places(h, len(table) * 8):
        hit &= (table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _placed(docs: DataFrame, row: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"{row}.file").alias("file"), F.col(f"{row}.at").alias("at"), column(text_col).alias("text"))


def _recurring_anchors(rows: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(texts(batch, "text"), window)
            hashes, counts = np.unique(own.phrases[own.used], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=schema.names)

    return map_arrow_stream(rows.select("text"), run, schema, TEXTS).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")


def _recurring_windows(rows: DataFrame, window: int, bits: np.ndarray) -> DataFrame:
    """(file, at, pos, n, docs, x, y) of each recurring window: where its first document has it
    first, how often it occurs and in how many documents, and the xor of its places (x) and
    of the places after them (y)."""
    names = ("hash", "doc", "file", "at", "pos", "x", "y")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])
    table = rows.sparkSession.sparkContext.broadcast(bits)
    keyed = rows.withColumn("doc", F.xxhash64("file", "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(texts(batch, "text"), window)
            wanted = np.zeros(len(own.phrases), bool)
            wanted[own.marked(table.value)] = True
            pos = np.flatnonzero(own.inside & wanted[own.anchor])
            file, at, doc = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("file", "at", "doc"))
            mark = (file.view(np.uint64) * _ODD ^ at.view(np.uint64)) * _MIX
            hashes, of = window_hashes(own.h, window)[pos].view(np.int64), own.text_of(pos)
            order = np.argsort(hashes, kind="stable")
            first = np.ones(len(pos), bool)
            first[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            local = (pos - own.starts[of]).astype(np.uint64)
            for a in range(0, len(pos), SENT):
                c, k = slice(a, a + SENT), of[a : a + SENT]
                x, y = (_place_hash(mark[k], local[c] + np.uint64(i)) for i in (0, 1))
                values = (hashes[c], pa.array(doc[k], mask=~first[c]), file[k], at[k], local[c].view(np.int64), x, y)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=list(names))

    owner = [F.min_by(c, "doc").alias(c) for c in ("file", "at", "pos")]  # of numbers only, so Spark keeps the groups in a hash table
    found = map_arrow_stream(keyed, run, schema, TEXTS).groupBy("hash").agg(F.count("*").alias("n"), F.count("doc").alias("docs"), *owner, F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return found.where("n > 1").drop("hash")


def _place_hash(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = (mark ^ at) * _MIX
    return ((x ^ (x >> np.uint64(32))) * _ODD).view(np.int64)


def _phrases(rows: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(id, anchor, text, n_words, docs): phrases of windows that occur together always."""
    along = Window.partitionBy("file", "at").orderBy("pos")
    same = (F.lag("pos").over(along) == F.col("pos") - 1) & (F.lag("n").over(along) == F.col("n")) & (F.lag("y").over(along) == F.col("x"))
    begun = windows.select("file", "at", "pos", "docs", F.when(same, 0).otherwise(1).alias("new"))
    told = begun.withColumn("phrase", F.sum("new").over(along))
    whole = told.groupBy("file", "at", "phrase").agg(F.min("pos").alias("start"), F.count("*").alias("n"), F.max("docs").alias("docs"))
    cut = whole.select("file", "at", "n", "start", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(LONGEST).cast("long"))).alias("off"))
    piece = F.struct((F.col("start") + F.col("off")).alias("start"), F.least(F.lit(LONGEST).cast("long"), F.col("n") - F.col("off")).alias("n"), "docs")
    owned = written(cut.groupBy("file", "at").agg(F.collect_list(piece).alias("pieces")), "passages-owned")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(texts(batch, "text"), window)
            pieces = batch.column("pieces")
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(pieces).to_numpy())
            start, n, docs = (pieces.flatten().field(c).to_numpy() for c in ("start", "n", "docs"))
            at = own.starts[of] + start
            kept = [own.cut(a, b) for a, b in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)]
            anchor = own.phrases[own.anchor[at]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(window_hashes(own.h, window)[at].view(np.int64)), pa.array(anchor), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n + window - 1), pa.array(docs)], names=schema.names)

    return map_arrow_stream(_with(rows, owned, ["file", "at"]), run, schema, TEXTS)


def _with(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join; texts of rows that ``table`` hasn't stay where they are while its keys
    are few enough to be broadcast."""
    if table.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(table.select(*keys)), keys, "left_semi")
    return rows.join(table, keys)


def _parts(rows: DataFrame, window: int, bits: np.ndarray, shards: int) -> DataFrame:
    """(file, at, shard, offset, text): the surroundings of anchors that a phrase of the shard
    may begin with, the overlapping ones joined."""
    back, on = window - min(PHRASE, window), LONGEST + window - 1
    names = ("file", "at", "shard", "offset", "text")
    schema = T.StructType([T.StructField(c, T.StringType() if c == "text" else T.LongType()) for c in names])
    table = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(texts(batch, "text"), window)
            file, at = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "at"))
            hit = own.marked(table.value)
            shard, of = own.phrases[hit].view(np.int64) % shards, own.text_of(hit)
            order = np.lexsort((hit, shard, of))
            hit, shard, of = hit[order], shard[order], of[order]
            ends = np.flatnonzero((np.diff(of) != 0) | (np.diff(shard) != 0) | (np.diff(hit) > back + on)) if len(hit) else hit
            firsts, lasts = (np.concatenate((x, y)).astype(np.int64)[: len(hit)] for x, y in (([0], ends + 1), (ends, [len(hit) - 1])))
            of, shard, low = of[firsts], shard[firsts], own.starts[of[firsts]]
            begin, end = np.maximum(hit[firsts] - back, low), np.minimum(hit[lasts] + on, own.starts[of + 1])
            out: list[tuple] = []
            size = 0
            for k, s, a, b, c in zip(*(x.tolist() for x in (of, shard, begin, end, begin - low)), strict=True):
                part = own.cut(a, b)
                out.append((file[k], at[k], s, c, part.decode()))
                size += len(part)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=list(names))
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=list(names))

    return map_arrow_stream(rows, run, schema, TEXTS)


class _Automaton:
    """A shard's phrases: words are letters, so a phrase is a text of pyahocorasick's."""

    def __init__(self) -> None:
        self.letters: dict[bytes, str] = {}
        self.tree = ahocorasick.Automaton()
        self.ready = False

    def add(self, key: int, text: bytes) -> None:
        phrase = [self.letters.get(w) or self.letters.setdefault(w, self.letter(len(self.letters))) for w in text.split()]
        self.tree.add_word("".join(phrase), (key, len(phrase)))

    @staticmethod
    def letter(k: int) -> str:
        return chr(k + 2 if k + 2 < 0xD800 else k + 2 + 0x800)

    def places(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(key, start, words) of every occurrence."""
        if not self.ready:
            self.tree.make_automaton()
            self.ready = True
        if self.letters:
            get = self.letters.get
            for end, (key, n) in self.tree.iter("".join([get(w, "\1") for w in text.split()])):
                yield key, end - n + 1, n


def _located(phrases: DataFrame, parts: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, file, at, start, n_words): each occurrence of each phrase in the parts."""
    keys = ["shard", "sub", "salt"]
    none = {c: F.lit(None).cast("long").alias(c) for c in ("id", "file", "at", "offset")}
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    kept = phrases.join(plan, "shard").select("shard", F.pmod(F.xxhash64("text"), F.col("subs")).alias("sub"), spread(F.col("salts")).alias("salt"), F.lit(0).alias("kind"), "id", none["file"], none["at"], none["offset"], "text")
    seen = parts.join(plan, "shard").select("shard", spread(F.col("subs")).alias("sub"), F.pmod(F.xxhash64("file", "at"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), none["id"], "file", "at", "offset", "text")
    rows = kept.unionByName(seen).repartition(*keys).sortWithinPartitions(*keys, "kind")
    names = ("id", "file", "at", "start", "n_words")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton = None, _Automaton()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "kind", "id", "file", "at", "offset")]
            for shard, sub, salt, kind, key, file, at, offset, text in zip(*columns, texts(batch, "text"), strict=True):
                if own != (shard, sub, salt):
                    own, automaton = (shard, sub, salt), _Automaton()
                if kind == 0:
                    automaton.add(key, text)
                else:
                    out += [(k, file, at, offset + start, n) for k, start, n in automaton.places(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=list(names))

    return map_arrow_stream(rows, run, schema)


def occurrences(docs: DataFrame, window: int = 35, text_col: str = "text", row: str = "__row") -> DataFrame:
    """(file, at, spans) of the rows of ``docs`` (numbered in column ``row``) that hold a
    recurring window; spans are (start, end) in words, ordered, and may overlap."""
    rows = _placed(docs, row, text_col)
    recurring = written(_recurring_anchors(rows, window), "passages-anchors")
    windows = _recurring_windows(rows, window, bloom(recurring, recurring.count()))
    phrases = written(_phrases(rows, windows, window), "passages-phrases")
    total = phrases.agg(F.sum("n_words").alias("words"), F.count("*").alias("n")).first()
    shards = max(1, math.ceil(2 * (total["words"] or 0) / SHARD_WORDS))
    told = phrases.withColumn("shard", F.pmod(F.col("anchor"), F.lit(shards).cast("long")))
    plan = told.groupBy("shard").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).alias("subs"), F.ceil(F.sum("docs") / TASK_DOCS).alias("salts"))
    bits = bloom(phrases.select(F.col("anchor").alias("hash")).distinct(), total["n"])
    hits = written(_located(told, _parts(rows, window, bits, shards), written(plan, "passages-plan")), "passages-hits")
    chance = hits.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    real = without(hits, written(chance, "passages-chance"), "id")
    return real.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))).alias("spans"))


def deduplicate(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): each row's text without the words of recurring windows;
    words joined by one space."""
    marked = numbered(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), "passages-docs")
    spans = written(occurrences(marked, window), "passages-spans").withColumn("__row", F.struct("file", "at")).select("__row", "spans")
    schema = T.StructType([T.StructField("id", marked.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, removed, kept = [], [], []
        for text, covered in zip(texts(batch, "text"), batch.column("spans").to_pylist(), strict=True):
            own = text.split()
            stay, upto = [], 0
            for s in covered or ():
                stay += own[upto : s["start"]] if s["start"] > upto else []
                upto = max(upto, s["end"])
            stay += own[upto:]
            words.append(len(own))
            removed.append(len(own) - len(stay))
            kept.append(b" ".join(stay))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    hit = spans.select("__row")
    if spans.count() <= BROADCAST_ROWS:  # texts without recurring words stay where they are
        joined = _with(marked, spans, ["__row"]).select("id", "text", "spans").unionByName(without(marked, hit, "__row").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    else:
        joined = marked.join(spans, "__row", "left").select("id", "text", "spans")
    return map_arrow(joined, run, schema)
