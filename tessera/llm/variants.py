"""Spelling variants: words one edit apart, by blocked Gram matrices.

1. One Arrow pass takes runs of letters from whole texts and counts them; tasks send sums.
2. A word's letters are counted in ``GROUPS`` of the alphabet: words with the same counts are
   a block (so all of one length). One edit changes the counts of two groups by one at most,
   so near words lie in the same block, in one of the 28 blocks of their length that a letter
   traded between two groups leads to (and back), or in one of the 8 a letter longer.
3. Blocks are packed into rows of about ``BLOCK`` words each. A plain join brings every packed
   row to the packed rows of its own block and of half its neighbours (each two blocks meet
   once), so a hot block is many rows on both sides, which Spark spreads, and no task holds
   more than two packed rows.
4. In a joined row NumPy multiplies the letter counts X of the one by those Y of the other:
   |x|^2 + |y|^2 - 2 X Y' are all squared distances. Exactly one edit leaves 1 (lengths differ)
   or 2 (equal lengths); the pairs that have it are verified letter by letter.
5. Pairs are summed per word on DataFrames; forms are followed by pointer jumping.

Edge cases: null and empty texts have no words; a null id is the empty text to ``edit``; very
long texts are read whole; words may be of any length (products are exact up to counts of 2^26);
ties go to the smallest word in code-point order; repeated rows count again; empty tables give
no rows. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import column, map_arrow_stream, texts, written

#: Words in a packed row, about; distinct words a task counts before it sends sums.
BLOCK, COUNTED = 1024, 200_000
#: The groups of letters, of about equal shares of running text. The letters
#: from U+00C0 to U+00FF are dealt to them in turn.
GROUPS = tuple(plain + "".join(chr(0xC0 + k) for k in range(i, 64, 8)) for i, plain in enumerate(("e", "tdqz", "acj", "ouk", "ilw", "nmvy", "spfgx", "hrb")))
#: Steps to the blocks a word is compared in: its own, a letter more, a letter traded.
_STEPS = [[0] * 8] + [[int(k == i) for k in range(8)] for i in range(8)] + [[int(k == i) - int(k == j) for k in range(8)] for i in range(8) for j in range(i + 1, 8)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PAIRS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, edit: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``least_length`` letters and
    ``least_count`` occurrences. ``edit(id, run)`` gives what a document's run is read as
    (never longer than the run); it is asked once per distinct run of a document."""
    rows = docs.select(column(id_col).cast("string").alias("id"), column(text_col).alias("text"))
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                found = pattern.findall(text.translate(_LOWER).decode())
                if edit is None:
                    counts.update(found)
                    continue
                for word, n in Counter(found).items():
                    word = edit(key or "", word)
                    if len(word) >= least_length:
                        counts[word] += n
            if len(counts) > COUNTED:
                yield sent(counts)
                counts = Counter()
        yield sent(counts)

    return map_arrow_stream(rows, run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _block(word: Column) -> Column:
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS])


def _letters(words: list[str]) -> np.ndarray:
    """Code points, a row for each word; the words of a block have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _counts(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    at = np.searchsorted(letters, points) + np.arange(len(points))[:, None] * len(letters)
    return np.bincount(at.ravel(), minlength=len(points) * len(letters)).reshape(len(points), -1).astype(np.float64 if points.shape[1] > 1000 else np.float32)


def near_pairs(left: list[str], right: list[str], own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words one edit apart; the words of each list have one length, and those
    of ``left`` are as long as the others or a letter longer. ``own``: both are the same list,
    and each pair counts once."""
    a, b = _letters(left), _letters(right)
    letters = np.unique(np.concatenate((np.unique(a), np.unique(b))))
    x, y = _counts(a, letters), _counts(b, letters)
    wanted = 2 if a.shape[1] == b.shape[1] else 1
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squared == wanted)
    if own:
        i, j = i[i < j], j[i < j]
    p, q = a[i], b[j]
    if wanted == 2:
        right_ones = (p != q).sum(1) == 1
    else:  # what begins alike and what ends alike make up the shorter word
        head = np.logical_and.accumulate(p[:, :-1] == q, axis=1).sum(1)
        tail = np.logical_and.accumulate((p[:, 1:] == q)[:, ::-1], axis=1).sum(1)
        right_ones = head + tail >= q.shape[1]
    return i[right_ones], j[right_ones]


def pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of a written table (word, n) of distinct words."""
    keyed = words.withColumn("block", F.array_join(_block(F.col("word")), ","))
    sizes = keyed.groupBy("block").agg(F.count("*").alias("size"))
    dealt = keyed.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / BLOCK)))
    packed = written(dealt.groupBy("block", "part").agg(F.collect_list(F.struct("word", "n")).alias("held")), "variants-blocks")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _STEPS])
    counts = F.split("block", ",").cast("array<int>")
    goes_to = F.transform(steps, lambda s: F.array_join(F.zip_with(counts, s, lambda c, d: c + d), ","))
    visits = packed.select(F.posexplode(goes_to).alias("step", "block"), F.col("part").alias("visitor"), F.col("held").alias("guests"))
    met = packed.join(visits, "block").where("step > 0 or visitor <= part")
    rows = met.select(F.col("held.word").alias("left"), F.col("held.n").alias("left_n"), F.col("guests.word").alias("right"), F.col("guests.n").alias("right_n"), ((F.col("step") == 0) & (F.col("visitor") == F.col("part"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for left, left_n, right, right_n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, j in zip(*(x.tolist() for x in near_pairs(left, right, own)), strict=True):
                    for values, value in zip(out, ((left[i], right[j]), (left_n[i], right_n[j]), (right[j], left[i]), (right_n[j], left_n[i])), strict=True):
                        values.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=_PAIRS.names)

    return map_arrow_stream(rows, run, _PAIRS, 256)


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words. ``form``:
    the near word of largest n, if that is at least ``ratio`` times the word's own."""
    words = written(words.select("word", "n"), "variants-words")
    best = pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    formed = written(formed, "variants-forms")
    roots = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "variants-roots")
    while True:  # n grows tenfold along a chain, and each round halves the chains
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        jumped = written(roots.join(beyond, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "variants-roots")
        roots = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
