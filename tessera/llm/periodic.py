"""Periodic runs of words in whole texts, by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``exponent`` times q long, that
can't be extended. All runs of a batch of texts are found together: texts are joined to one
sequence of word numbers, each followed by a number that occurs nowhere else.

1. Small periods (up to 3) are read off where words equal those 1, 2 or 3 places on.
2. At each scale t = 4, 8, 16, ... every place has a hash of its t words, made from two of the
   scale before. A place i is *synchronising* if the least hash of the places i to i + t is
   that of i or of i + t. Whether it is depends on the 2t words from i alone, so equal passages
   choose equal places. Places whose t words lie in a found run of a period up to t / 4 don't
   take part: such highly periodic regions would choose too many, and their periods, which
   this scale would miss, have been supplied by the scales before.
3. A run of period q, t <= q < 2t, has a synchronising place among its first t words (its own
   words can't be highly periodic at this scale), and the next place with the same 2t words
   is q further on: synchronising places are sorted by the hash of these words, and equal
   neighbours t to 2t - 1 apart propose their distance as a period.
4. A proposal is extended to both sides by comparing words, so nothing rests on hashes; one
   within a stretch that is known for its period is skipped.

About 2n / t places are chosen of n words, so a scale costs little more than its hashes, and
all scales n log n or so. Texts too short for a scale leave it.

Edge cases: a null or empty text has no words and no runs; very long texts are read whole, in
a batch of their own; runs don't cross texts; equal stretches of several periods can't be, as
the smallest counts; ties of start are ordered by period; repeated rows get their result each;
null ids stay; an empty table gives no rows. Columns besides id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import column, map_arrow, texts

#: Periods read off directly.
SMALL = 3
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_NONE = np.uint64(2**64 - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements are equal."""
    n, size, most = 0, 64, min(len(a), len(b))
    while n < most:
        differ = a[n : min(most, n + size)] != b[n : min(most, n + size)]
        if differ.any():
            return n + int(differ.argmax())
        n, size = min(most, n + size), size * 2
    return most


def _smallest(codes: np.ndarray, start: int, q: int) -> bool:
    """Whether the stretch of period ``q`` at ``start`` has no period that divides ``q``."""
    word, rest, f = codes[start : start + q], q, 2
    while rest > 1:
        if rest % f == 0:
            if (word[: q - q // f] == word[q // f :]).all():
                return False
            rest //= f
        else:
            f = f + 1 if f * f <= rest else rest
    return True


def synchronising(hashes: np.ndarray, scale: int, outside: np.ndarray) -> np.ndarray:
    """Synchronising places, of the hashes of ``scale`` (a power of two) words at each place;
    places ``outside`` take no part."""
    ids = np.where(outside, _NONE, hashes)
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least, width = ids, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], ids[scale:])
    return np.flatnonzero((least != _NONE) & ((least == ids[:-scale]) | (least == ids[scale:])))


def runs(codes: np.ndarray, lengths: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``codes``: the words of
    all texts, each text followed by a code of its own; ``lengths``: their words without it."""
    if exponent < 4:
        raise ValueError("the exponent must be 4 at least: shorter runs need not hold two equal contexts")
    found: list[tuple[int, int, int]] = []
    for q in range(1, SMALL + 1):
        if len(codes) > q:
            a, b = _stretches(codes[:-q] == codes[q:])
            long = b - a + q >= max(least, exponent * q)
            found += [(s, e - s + q, q) for s, e in zip(a[long].tolist(), b[long].tolist(), strict=True) if _smallest(codes, s, q)]
    back, room = codes[::-1], np.repeat(lengths, lengths + 1)
    place = np.flatnonzero(room >= exponent * (SMALL + 1))
    h = codes.view(np.uint64)[place]
    h = _mixed(h, h)
    half = 1
    while len(place):
        if half < SMALL + 1:  # hashes of 2, then 4 words
            h, place, half = _mixed(h[:-half], h[half:]), place[:-half], half * 2
            continue
        scale = half
        outside = np.zeros(len(h) + 1, np.int32)
        for s, n, q in found:
            if q <= scale // 4 and n >= scale:
                at = int(np.searchsorted(place, s))
                if at < len(place) and place[at] == s:
                    outside[at] += 1
                    outside[min(len(h), at + n - scale + 1)] -= 1
        chosen = synchronising(h, scale, np.cumsum(outside[:-1]) > 0)
        doubled = _mixed(h[:-scale], h[scale:])
        context = doubled[chosen]
        order = np.argsort(context, kind="stable")
        at, context = chosen[order], context[order]
        period = at[1:] - at[:-1]
        good = np.flatnonzero((context[1:] == context[:-1]) & (period >= scale) & (period < 2 * scale))
        known: dict[int, tuple[int, int]] = {}
        for g in good[np.argsort(at[good], kind="stable")].tolist():
            s, q = int(place[at[g]]), int(period[g])
            low, high = known.get(q, (0, 0))
            if low <= s and s + q + 2 * scale <= high:
                continue
            right = s + q + _alike(codes[s:], codes[s + q :])
            left = s - _alike(back[len(codes) - s :], back[len(codes) - s - q :])
            known[q] = (left, right)
            if right - left >= max(least, exponent * q) and _smallest(codes, left, q):
                found.append((left, right - left, q))
        enough = room[place[: len(doubled)]] >= exponent * 2 * scale
        h, place, half = doubled[enough], place[: len(doubled)][enough], scale * 2
    return np.array(sorted(set(found), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, text): each row's runs by start and period, and its text without
    the words that lie in a run beyond the run's first period, words joined by one space."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in texts(batch, "text")]
        seen: dict[bytes, int] = {}
        codes: list[int] = []
        for k, of_text in enumerate(words):
            codes += [seen.setdefault(w, len(seen)) for w in of_text]
            codes.append(-1 - k)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = runs(np.array(codes, np.int64), lengths, least, exponent)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        of_row = np.searchsorted(starts, found[:, 0], "right") - 1
        offsets = np.searchsorted(of_row, np.arange(len(words) + 1)).astype(np.int32)
        found[:, 0] -= starts[of_row]
        kept = []
        for k, of_text in enumerate(words):
            gone = bytearray(len(of_text))
            for s, n, q in found[offsets[k] : offsets[k + 1]].tolist():
                gone[s + q : s + n] = b"\x01" * (n - q)
            kept.append(b" ".join([w for w, x in zip(of_text, gone, strict=True) if not x] if any(gone) else of_text))
        made = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], names=_RUN.names)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), made), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return map_arrow(rows, run, schema)
