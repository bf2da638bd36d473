"""Shapes that are data: their order, and one target for all arrays of a table.

``common_target`` is a reduction: tasks send the different shapes they see with counts, so
however many arrays a table has, what travels is its shapes. The target is the largest of
them, and every other is held against it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import nd_dimensions, product
from ..functions.schema import check_nd, free_name, quoted
from .broadcast import offset_in, repeats_of


def compare_dims(a: Column, b: Column) -> Column:
    """-1, 0 or 1 if ``a`` is part of, equal to or contains ``b`` (``array<struct<name, size>>``);
    null if they don't compare. Only scalars and single dimensions are parts of others."""
    def part(low: Column, high: Column) -> Column:
        return (F.size(low) == 0) | ((F.size(low) == 1) & F.array_contains(high, F.get(low, F.lit(0))))

    shorter = F.when(F.size(a) < F.size(b), F.when(part(a, b), -1)).when(F.size(b) < F.size(a), F.when(part(b, a), 1))
    return F.when(a == b, 0).otherwise(shorter)


def single_repeats_of(dims: Column, target: Column) -> Column:
    """``repeats_of`` for equal shapes, scalars and single dimensions only, else null."""
    return F.when((F.size(dims) < 2) | (dims == target), repeats_of(dims, target))


def shapes_of(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dims, arrays): the different shapes of the table's arrays and how many have each;
    null arrays have none. Only names and sizes are read."""
    for c in columns:
        check_nd(df.schema[c].dataType, c)
    dims = free_name(keys, "dims")
    each = df.select(*map(quoted, keys), F.explode(F.array(*[nd_dimensions(quoted(c)) for c in columns])).alias(dims)).where(F.col(dims).isNotNull())
    return each.groupBy(*map(quoted, [*keys, dims])).agg(F.count("*").alias(free_name([*keys, dims], "arrays")))


def common_target(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, target, shapes, arrays, offending): one row for each key, or for the table.

    ``target`` is the shape of most dimensions (then of most cells, then the last by name and
    size); ``offending`` the least shape that doesn't lie in it, null if all arrays can be
    expanded to it. A key without arrays has no row, a table without any one of nulls."""
    found = shapes_of(df, columns, keys)
    dims, arrays = found.columns[-2:]
    rank = F.struct(F.size(dims).alias("rank"), product(F.transform(dims, lambda d: d["size"])).alias("cells"), F.col(dims).alias("dims"))
    ranked = found.select(*map(quoted, keys), rank.alias("__shape"), F.col(arrays).alias("__arrays"))
    best = ranked.groupBy(*map(quoted, keys)).agg(F.max("__shape").alias("__best"), F.count("*").alias("__shapes"), F.sum("__arrays").alias("__total"))
    both = best.join(ranked, list(keys), "left") if keys else F.broadcast(best).join(ranked, how="left")  # without keys: one row
    misfit = offset_in(F.col("__shape.dims"), F.col("__best.dims")).isNull()
    told = both.groupBy(*map(quoted, keys), "__best", "__shapes", "__total").agg(F.min(F.when(misfit, F.col("__shape"))).alias("__off"))
    return told.select(*map(quoted, keys), F.col("__best.dims").alias("target"), F.col("__shapes").alias("shapes"), F.col("__total").alias("arrays"), F.col("__off.dims").alias("offending"))
