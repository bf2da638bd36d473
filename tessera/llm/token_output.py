"""Token ids as Parquet list columns that can be read in parts.

``encode`` orders documents by id (range partitions, sorted within), encodes each whole text
with a tokenizer file, appends the end id, and writes one Parquet file per partition:
``doc_id`` and ``local_start`` delta-encoded, ``token_ids`` a dictionary- or plain-encoded
list column (``ids="dictionary"``/``"delta"``), with row groups of ``row_group_bytes``,
pages of ``page_bytes`` and the page indexes that let a reader fetch the metadata columns
or single documents without the rest. A document's start in the whole sequence is its
file's base plus its local start; bases are a prefix sum over one small row per file.

What the tokenizers library gave for a piece of text is remembered in bounded memory, as
running text repeats its words; pieces end where the splitting before merging ends for
certain (``Encoder``). Texts that hold the string of a special token go to the library
whole, which makes it that token's id; with ``special_as_text`` it is text like any other.

The tokenizer's file is read once, by the driver; its content is broadcast (1.5 MB here).

Edge cases: null and empty texts give the end id alone; a very long text is encoded whole,
in one task; ids order as their type does, null first; rows with equal ids order by text;
repeated rows are documents of their own; an empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import column, map_arrow, map_arrow_stream, new_path, written

#: Pieces one Python worker remembers; files whose token counts one task sums up; files whose
#: bases may be broadcast (beyond, they are joined).
REMEMBERED, FILES_A_GROUP, BROADCAST_FILES = 800_000, 1024, 1_000_000
#: Kinds of bytes: line break, space, end of a text, letter, digit, sign, anything else. The
#: splitting's contractions begin with an apostrophe; white space beyond line break and space,
#: and characters whose class may differ between versions of Unicode, are something else too.
_BREAK, _SPACE, _END, _LETTER, _DIGIT, _SIGN, _OTHER = range(7)
_KINDS = np.array([_END if c == 0 else _BREAK if c == 10 else _SPACE if c == 32 else _LETTER if chr(c).isalpha() and c < 128 or 0x80 <= c < 0xC0 or 0xC3 <= c <= 0xC8 else _DIGIT if 48 <= c <= 57 else _OTHER if c < 32 or c == 39 or c >= 127 else _SIGN for c in range(256)], np.uint8)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_CUT = re.compile(r"(?<=\S) (?=\S)")

_workers: dict[tuple[str, bool], "Encoder"] = {}


class Table:
    """Token ids by short pieces, in arrays: exact, and small enough to hold millions.

    A piece of at most 24 bytes is known by its length and three words of 8 bytes, which
    cover it; an open-addressed table leads to its entry.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 22, -1, np.int32)
        self.entries = np.zeros((1 << 16, 4), np.uint64)  # three words; length and count of ids
        self.offsets = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    @staticmethod
    def keys(window: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(pieces x 4): the words that tell pieces apart."""
        out = np.empty((len(starts), 4), np.uint64)
        out[:, 0] = window[starts] & _MASKS[np.minimum(lengths, 8)]
        out[:, 1] = np.where(lengths > 8, window[starts + np.maximum(lengths, 8) - 8], np.uint64(0))
        out[:, 2] = np.where(lengths > 16, window[np.minimum(starts + 8, len(window) - 1)], np.uint64(0))
        out[:, 3] = lengths
        return out

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= (h >> np.uint64(29)) ^ keys[:, 1] * np.uint64(0xBF58476D1CE4E5B9)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= (h >> np.uint64(32)) ^ keys[:, 2] * np.uint64(0xD6E8FEB86659FD93) ^ keys[:, 3]
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h >> np.uint64(34)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each piece's entry, -1 if it has none."""
        slots = hashes.astype(np.int64) & (len(self.slots) - 1)
        found = self.slots[slots]
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            at = self.entries[found[open_]]
            at[:, 3] &= np.uint64(0xFF)
            open_ = open_[(at != keys[open_]).any(axis=1)]
            slots[open_] = (slots[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[slots[open_]]
            open_ = open_[found[open_] >= 0]
        return found

    def add(self, keys: np.ndarray, hashes: np.ndarray, ids: list[bytes]) -> None:
        """New pieces, each once."""
        n, counts = len(keys), np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.n + n > len(self.entries):
            self.entries = np.concatenate([self.entries, np.zeros_like(self.entries)])
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.entries[self.n : self.n + n] = keys
        self.entries[self.n : self.n + n, 3] |= counts.astype(np.uint64) << np.uint64(8)
        self.offsets[self.n : self.n + n] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(flat)] = flat
        slots, which = hashes.astype(np.int64) & (len(self.slots) - 1), np.arange(self.n, self.n + n, dtype=np.int32)
        self.n, self.used = self.n + n, self.used + len(flat)
        while len(which):
            free = self.slots[slots] < 0
            self.slots[slots[free]] = which[free]  # of several for a slot, the last stays
            lost = self.slots[slots] != which
            slots, which = (slots[lost] + 1) & (len(self.slots) - 1), which[lost]

    def ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in order, and how many each has."""
        counts = (self.entries[found, 3] >> np.uint64(8)).astype(np.int64)
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.offsets[found] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers.

    Regular texts are letters (up to U+024F), digits, signs, and single spaces or line breaks
    between them. There GPT-2's splitting is where the kind of character changes, a space
    going with what follows, so it is done for all texts of a batch at once, and a piece's ids
    are looked up (``Table``). New pieces are encoded by the library many at a time, as lines
    of one text. Texts with anything else are cut at single spaces and go to the library in
    pieces that are remembered too.
    """

    def __init__(self, content: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = special_as_text
        self.lines = Tokenizer.from_str(content)  # pieces, one a line, need no further splitting
        self.lines.encode_special_tokens = True
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = [t for t in json.loads(content).get("added_tokens") or () if not (special_as_text and t.get("special"))]
        self.whole = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        line = self._encode(["\n", "a\nb", "a\n b"])
        self.line = line[0] if len(line[0]) == 4 and all(x.count(line[0]) == 1 for x in line) else None
        self.table, self.seen = Table(), {}

    @classmethod
    def of(cls, digest: str, special_as_text: bool, content: Callable[[], str]) -> "Encoder":
        """One per Python worker, kept over its tasks; ``content`` is asked for it once."""
        key = (digest, special_as_text)
        if key not in _workers:
            _workers[key] = cls(content(), special_as_text)
        return _workers[key]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line breaks that the splitting keeps whole."""
        out = []
        mark = int(np.frombuffer(self.line, "<u4")[0])
        groups = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        for group, e in zip(groups, self.lines.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == mark).tolist(), len(ids)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the tokenizer doesn't keep lines apart")
            out += [ids[a + 1 : b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _regular(self, data: list[bytes]) -> list[bytes | None]:
        """Ids of the regular texts among UTF-8 ``data``; None for the others."""
        joined = b"\0".join(data) + b"\0" * 9
        raw = np.frombuffer(joined, np.uint8)[: len(joined) - 8]
        window = np.ndarray((len(raw),), "<u8", joined, 0, (1,))
        kind = _KINDS[raw]
        bounds = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))  # each ends with a 0
        before = np.concatenate(([_END], kind[:-1])).astype(np.uint8)
        # Irregular: other characters, and white space beside white space or an end.
        odd = (kind == _OTHER) | ((kind <= _END) & (before <= _SPACE)) | ((kind <= _SPACE) & (before == _END))
        odd |= (raw == 0xC3) & ((window >> np.uint64(8) & np.uint64(0xDF)) == 0x97)  # the signs at U+00D7 and U+00F7
        bad = np.zeros(len(data), bool)
        bad[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        bad |= np.array([not d or b"\0" in d for d in data])
        starts = np.flatnonzero(((kind != before) & (before != _SPACE)) | (kind <= _SPACE))
        lengths = np.diff(np.concatenate((starts, [len(raw)])))
        text = np.searchsorted(bounds, starts, "right") - 1
        keep = (kind[starts] != _END) & ~bad[text]
        starts, lengths, text = starts[keep], lengths[keep], text[keep]
        bad[text[lengths > 24]] = True
        keep = ~bad[text]
        starts, lengths, text = starts[keep], lengths[keep], text[keep]
        keys = Table.keys(window, starts, lengths)
        hashes = Table.hashes(keys)
        found = self.table.find(keys, hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.table.n + len(new) > REMEMBERED:
                self.table.clear()
                new = np.arange(len(found))
            _, first = np.unique(np.ascontiguousarray(keys[new]).view("V32").ravel(), return_index=True)
            first = new[first]
            pieces = [joined[a : a + n].decode() for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
            breaks = [i for i, p in enumerate(pieces) if p == "\n"]
            ids = self._pieces(["x" if p == "\n" else p for p in pieces])
            for i in breaks:
                ids[i] = self.line
            self.table.add(keys[first], hashes[first], ids)
            found[new] = self.table.find(keys[new], hashes[new])
        flat, counts = self.table.ids(found)
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = ends[np.searchsorted(text, np.arange(len(data) + 1))]
        flat = flat.astype("<u4", copy=False)
        return [None if bad[i] else flat[a:b].tobytes() for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]

    def _others(self, texts: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > REMEMBERED // 8:
            seen.clear()
        firsts, parts = [], []
        for t in texts:
            first, *rest = _CUT.split(t)
            firsts.append(first)
            parts.append(rest)
        new = list(set().union(*parts).difference(seen))
        seen.update(zip(new, self._encode([" " + p for p in new]), strict=True))
        return [first + b"".join(map(seen.__getitem__, rest)) for first, rest in zip(self._encode(firsts), parts, strict=True)]

    def encode_all(self, batch: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(batch)
        if self.whole is not None and any(map(self.whole.search, batch)):
            held = [self.whole.search(t) is not None for t in batch]
            alone = iter(self._encode([t for t, h in zip(batch, held, strict=True) if h]))
            others = iter(self.encode_all([t for t, h in zip(batch, held, strict=True) if not h]))
            return [next(alone if h else others) for h in held]
        if self.line is not None:
            # Some MB at a time: what lies between is several times the text.
            data, at = [t.encode() for t in batch], 0
            while at < len(batch):
                upto, size = at, 0
                while upto < len(batch) and (upto == at or size < 1 << 20):
                    size += len(data[upto])
                    upto += 1
                out[at:upto] = self._regular(data[at:upto])
                at = upto
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._others([batch[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def _lists(chunks: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(chunks), "<i4")
    offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in chunks]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, special_as_text: bool = False) -> str:
    """Write the token files of ``docs``; the folder's path. ``tokenizer`` is a file's path on
    the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    digest, shared = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)
    path = path or new_path(spark, "token-ids")
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text")).withColumn("part", F.spark_partition_id())
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = Encoder.of(digest, special_as_text, lambda: shared.value), 0
        for batch in batches:
            found = [x + end for x in encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in found], np.int64)
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(before), pa.array(n), _lists(found)], names=["doc_id", "part", "local_start", "n_tokens", "token_ids"])

    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": 1000, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#token_ids.list.element": str(ids == "dictionary").lower()}
    writer = map_arrow_stream(ordered, run, schema, 500).write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return path


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of the files, read without their token column."""
    meta = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _started(meta).select("doc_id", "start", "n_tokens")


def _started(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, by a prefix sum over files in two steps: within groups of
    ``FILES_A_GROUP`` files, and over the groups' sums (10^9 files are 10^6 of them)."""
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("band", F.expr(f"part div {FILES_A_GROUP}"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = files.groupBy("band").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.withColumn("within", before).join(bands.select("band", ahead.alias("ahead")), "band").select("part", (F.col("within") + F.col("ahead")).alias("base"))
    bases = written(bases, "token-bases")
    few = bases.count() <= BROADCAST_FILES  # 12 bytes each
    return rows.join(F.broadcast(bases) if few else bases, "part").withColumn("start", F.col("base") + F.col("local_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of the files."""
    return _started(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "token_ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read`` with the crc32 of their ids in place of the ids."""
    slim = rows.select("doc_id", "start", "n_tokens", "token_ids")
    schema = T.StructType([*slim.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(3)
        values, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), column.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=schema.names)

    return map_arrow(slim, run, schema)
