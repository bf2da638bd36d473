"""Mixing sources to target weights by subset-sum budget fitting.

1. Each document's exact token length is counted once; each source's sum is its size.
2. Targets: sources ordered by code point (null last) take turns with the given weights and
   share ``share`` of all sizes; a target stops at ``max_repeat`` times its source's size
   and the excess goes to the others by weight until none is above.
3. A source is taken whole as often as its target holds it; the budget that remains is
   fitted from its count of documents by length: all but a window of it is dealt to the
   lengths by their share (which keeps the source's mixture of lengths), what rounding leaves
   goes to the longest that fit, and the window is what bounded-knapsack dynamic programming
   fills as closely as the lengths left allow. The window is ``DP_BUDGET`` tokens or eight
   times the longest document, the more. If the budget isn't met, documents are given back
   and what they leave is filled by sums of all choices, while these take 64 MB at most.
4. So many documents of each (source, length) are taken by a hash of seed, id and text, so
   the same seed takes the same documents wherever their files lie: those up to the last one
   taken. To find that one, a group is cut into ranges of the hash by its count and only the
   range where the number is reached is ranked, so a group with a third of all rows is never
   gathered, and texts never move: a row's copies follow from the table of (source, length).

A source's lengths differ by one at least, so their number is at most the square root of
twice its size: that histogram is all that one task ever gathers.

Edge cases: null text has length 0; a very long text is one document of its length;
documents of length 0 are taken as often as their source is whole; null sources are one
source, the last; repeated rows are documents of their own; ties of the hash rank by id,
text's hash and place, so of equal rows any may be taken; an empty table gives no rows;
negative sizes can't arise. Extra columns pass through ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import column, fresh, numbered, written

#: Tokens that are left to dynamic programming at least, documents of a range of the hash.
DP_BUDGET, BUCKET = 1 << 16, 16
#: Memory for the sums of documents given back, where that leaves a budget unmet.
REFIT_BYTES = 1 << 26


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take: their sum comes near ``budget`` and never
    exceeds it. Lengths are distinct and positive."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    window = max(DP_BUDGET, 8 * int(lengths.max()))
    take = np.array([c * max(0, budget - window) // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable").tolist()
    for i in order:  # the longest that fit, while the budget is beyond the table below
        if left <= window:
            break
        n = min(int(counts[i] - take[i]), max(0, left - window // 2) // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    for i in order:
        if left <= window:
            break
        n = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    left = min(left, window)
    # Bounded knapsack: bit s of `reached` says that some choice sums to s.
    full, reached = (1 << (left + 1)) - 1, 1
    item, times = np.zeros(left + 1, np.int32), np.zeros(left + 1, np.int32)
    for i in sorted(i for i in order if lengths[i] <= left):
        spare, size = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while spare > 0 and not reached >> left & 1:
            n = min(size, spare)
            shift = n * int(lengths[i])
            new = (reached << shift) & full & ~reached
            if new:
                reached |= new
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes((left >> 3) + 1, "little"), np.uint8), bitorder="little"))
                item[bits], times[bits] = i, n
            spare -= n
            size *= 2
        if reached >> left & 1:
            break
    s = reached.bit_length() - 1
    while s:
        take[item[s]] += times[s]
        s -= int(times[s]) * int(lengths[item[s]])
    return _refit(lengths, counts, budget, take)


def _refit(lengths: np.ndarray, counts: np.ndarray, budget: int, take: np.ndarray) -> np.ndarray:
    """``take`` or a choice that comes nearer to ``budget``: documents are given back, a few
    of each length and then all, and what they leave is filled anew as closely as can be."""
    for back in (1, 4, 16, None):
        gap = budget - int((lengths * take).sum())
        if not gap:
            break
        given = take if back is None else np.minimum(take, back)
        spare = counts - take + given if back is None else np.minimum(counts - take, back) + given
        room = gap + int((lengths * given).sum())
        parts = []  # binary parts of what can be taken
        for i in np.flatnonzero((spare > 0) & (lengths <= room)).tolist():
            left, size = min(int(spare[i]), room // int(lengths[i])), 1
            while left > 0:
                parts.append((i, min(size, left)))
                left, size = left - size, size * 2
            if len(parts) * (room >> 3) > REFIT_BYTES:
                return take
        full, sums = (1 << (room + 1)) - 1, [1]
        for i, n in parts:
            sums.append((sums[-1] | sums[-1] << n * int(lengths[i])) & full)
        s = sums[-1].bit_length() - 1
        if s <= room - gap:
            continue
        take = take - given
        for (i, n), before in zip(reversed(parts), reversed(sums[:-1]), strict=True):
            if not before >> s & 1:
                take[i] += n
                s -= n * int(lengths[i])
    return take


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row per source."""
    ranged = written(sources.repartitionByRange(8, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    sizes = {r["part"]: r for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()}  # 8 rows at most
    start, before = F.lit(0).cast("long"), 0
    for part in sorted(sizes):
        start = F.when(F.col("part") == part, F.lit(before) - F.lit(sizes[part]["least"])).otherwise(start)
        before += sizes[part]["n"]
    turn = F.pmod(start + F.col("place"), F.lit(len(weights)))
    ranked = written(ranged.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1).alias("weight")), "mix-weights")
    cap = F.col("source_size") * F.lit(float(max_repeat))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, max_repeat) * total
    rate = 0.0
    while total:  # sources at their cap leave; the others' rate rises until none is above
        sums = ranked.agg(F.sum(F.when(cap <= F.col("weight") * rate, F.col("source_size")).otherwise(0)).alias("capped"), F.sum(F.when(cap > F.col("weight") * rate, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not sums["open"]:
            break
        new = (budget - max_repeat * sums["capped"]) / sums["open"]
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def plan(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of (row, source, size): the sources with their targets, and for each (source, size)
    how many documents there are (n), how often all are taken and how many once more."""
    histogram = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    wanted = written(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_repeat), "mix-targets")
    both = histogram.join(wanted, histogram["source"].eqNullSafe(wanted["source"])).select(histogram["source"], "size", "n", "source_size", "target")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(int(target // size), max_repeat) if size else 0
        budget = int(round(target - whole * size)) if whole < max_repeat else 0
        pdf = pdf.sort_values("size")
        some = pdf["size"].to_numpy() > 0
        extra = np.zeros(len(pdf), np.int64)
        extra[some] = fit_budget(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
        return pd.DataFrame({"source": pdf["source"].to_numpy(), "size": pdf["size"].to_numpy(), "n": pdf["n"].to_numpy(), "whole": whole, "extra": extra})

    chosen = both.groupBy("source").applyInPandas(fit, f"source {dict(both.dtypes)['source']}, size long, n long, whole long, extra long")
    return wanted, written(chosen, "mix-chosen")


def _place(seed: int) -> Column:
    """Where a row stands in its group: columns id, mark (the text's hash) and row."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.col("mark")), 1)
    return F.struct(h.alias("h"), F.col("id").alias("id"), F.col("mark").alias("mark"), F.col("row").alias("row"))


def choose(sizes: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """``chosen`` with ``last``: the place of the last row that is taken once more, of
    ``sizes`` (id, row, source, size, mark); null where all are or none is."""
    part = chosen.where("extra > 0 and extra < n").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "n", "extra")
    rows = sizes.join(part, sizes["source"].eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).withColumn("place", _place(seed))
    rows = rows.select("c_source", "c_size", "extra", "place", F.expr(f"cast(cast(place.h as double) * {2.0**-63!r}D * (n div {BUCKET} + 1) as long)").alias("bucket"))
    rows = written(rows, "mix-rows")
    counts = rows.groupBy("c_source", "c_size", "bucket", "extra").agg(F.count("*").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy("c_source", "c_size").orderBy("bucket"))
    edge = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("in_bucket") < F.col("extra")))
    edge = written(edge.select(F.col("c_source").alias("e_source"), F.col("c_size").alias("e_size"), F.col("bucket").alias("e_bucket"), (F.col("extra") - F.col("upto") + F.col("in_bucket")).alias("need")), "mix-edge")
    at_edge = rows.join(edge, rows["c_source"].eqNullSafe(F.col("e_source")) & (F.col("c_size") == F.col("e_size")) & (F.col("bucket") == F.col("e_bucket")))
    rank = F.row_number().over(Window.partitionBy("e_source", "e_size").orderBy("place"))
    last = at_edge.withColumn("rank", rank).where("rank = need").select("e_source", "e_size", F.col("place").alias("last"))
    both = chosen.join(last, chosen["source"].eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")), "left")
    return written(both.select("source", "size", "n", "whole", "extra", "last"), "mix-last")


def _copies(seed: int) -> Column:
    more = F.when(F.col("extra") >= F.col("n"), True).when(F.col("extra") <= 0, False).otherwise(_place(seed) <= F.col("last"))
    return F.col("whole") + more.cast("long")


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, row: Column | None = None) -> DataFrame:
    """(id, row, source, size, source_size, target, copies, taken), one row per row of
    ``docs``; ``row`` is its monotonically increasing id if none is given, ``taken`` its
    tokens taken."""
    sizes, table = _decided(docs, weights, share, max_repeat, seed, id_col, text_col, source_col, size, row)
    t = table.withColumnsRenamed({"source": "t_source", "size": "t_size"})
    out = sizes.join(t, sizes["source"].eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size"))).withColumn("copies", _copies(seed))
    return out.select("id", "row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _decided(docs: DataFrame, weights: Sequence[float], share: float, max_repeat: int, seed: int, id_col: str, text_col: str, source_col: str, size: Column | None, row: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes, and what is taken of each (source, size)."""
    base = docs.select(column(id_col).alias("id"), column(source_col).alias("source"), (word_count(column(text_col)) if size is None else size).alias("size"), (F.monotonically_increasing_id() if row is None else row).alias("row"), F.xxhash64(column(text_col)).alias("mark"))
    sizes = written(base, "mix-sizes")
    wanted, chosen = plan(sizes, weights, share, max_repeat)
    w = wanted.withColumnRenamed("source", "w_source")
    table = choose(sizes, chosen, seed)
    return sizes, written(table.join(w, table["source"].eqNullSafe(F.col("w_source"))).drop("w_source"), "mix-table")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows left out are gone, repeated rows come twice. Texts
    meet the table of (source, size) where they lie while that is small enough to broadcast."""
    row, copy = fresh(docs, "__row"), fresh(docs, "__copy")
    marked = numbered(docs, "mix-docs", row)
    _, table = _decided(marked, weights, share, max_repeat, seed, id_col, text_col, source_col, None, F.col(row))
    doc = F.struct(*[column(c).alias(c) for c in docs.columns]).alias("doc")
    rows = marked.select(doc, column(id_col).alias("id"), column(source_col).alias("t_source"), word_count(column(text_col)).alias("t_size"), F.xxhash64(column(text_col)).alias("mark"), F.col(row).alias("row"))
    found = rows.join(table, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")))
    taken = found.select("doc", F.explode(F.array_repeat(F.lit(0), _copies(seed).cast("int"))).alias(copy))
    return taken.select("doc.*")
