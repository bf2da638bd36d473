"""Arrays as columns: constructors, accessors, encode, decode, cast.

An array is ``struct<dimension_names, dimension_sizes, values>`` with values in row-major
order. Two levels of null are kept apart: a null struct is a null array, a null in
``values`` a null cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionSizeMismatch, NoDimensionNames, NoDimensionSizes, NoValues, NullDimension, ShapeAndLengthMismatch
from ..plans.dims import Dimension, dimensions
from .schema import METADATA_KEY, NAMES, SIZES, VALUES, check_marked, check_nd, free_name, marked, nd_type, quoted


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _names(names: Column | Sequence[str]) -> Column:
    return names if isinstance(names, Column) else F.expr(f"cast(array({', '.join(map(_text, names))}) as array<string>)")


def _sizes(sizes: Column | Sequence[int | Column]) -> Column:
    if isinstance(sizes, Column):
        return sizes.cast("array<bigint>")
    if any(isinstance(s, Column) for s in sizes):
        return F.array(*[s if isinstance(s, Column) else F.lit(s) for s in sizes]).cast("array<bigint>")
    return F.expr(f"cast(array({', '.join(f'{int(s)}L' for s in sizes)}) as array<bigint>)")


# Constructors


def nd_array(values: Column, names: Column | Sequence[str], sizes: Column | Sequence[int | Column], validate: bool = True) -> Column:
    """An array; null values make a null array. Validation raises when a row is wrong; where
    names and sizes are known to the planner, only the number of values is left to check."""
    known = not isinstance(names, Column) and not isinstance(sizes, Column) and not any(isinstance(s, Column) for s in sizes)

    def built(v: Column) -> Column:
        return F.struct(_names(names).alias(NAMES), _sizes(sizes).alias(SIZES), v.alias(VALUES))

    if validate and known and len(names) == len(sizes) and None not in names and all(s >= 0 for s in sizes):
        n = math.prod(sizes)
        wrong = F.raise_error(F.concat(F.lit(f"{ShapeAndLengthMismatch.code}: {n} cells, "), F.size(values).cast("string"), F.lit(" values")))
        return let(values, lambda v: F.when(v.isNull(), None).when(F.size(v) == n, built(v)).otherwise(wrong))
    made = F.when(values.isNotNull(), built(values))
    return nd_decode(made) if validate else made


def nd_array_sql(values: str, names: Sequence[str], sizes: Sequence[int | str]) -> str:
    """SQL text of an array whose values and sizes are SQL text (or numbers); not validated.
    A query of many arrays is planned faster from text than from columns."""
    named, sized = ", ".join(map(_text, names)), ", ".join(f"cast({s} as bigint)" for s in sizes)
    made = f"named_struct('{NAMES}', cast(array({named}) as array<string>), '{SIZES}', cast(array({sized}) as array<bigint>), '{VALUES}', {values})"
    return f"if(({values}) is null, null, {made})"


def nd_scalar(value: Column) -> Column:
    """An array without dimensions and with one value, which may be null."""
    return F.struct(_names([]).alias(NAMES), _sizes([]).alias(SIZES), F.array(value).alias(VALUES))


def timestamp_of(value: Column, unit: str, zoned: bool = False) -> Column:
    """A timestamp from its count of s, ms, us or ns since 1970 (ns are cut to us)."""
    made = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros, "ns": lambda v: F.timestamp_micros(F.call_function("div", v - F.pmod(v, F.lit(1000)), F.lit(1000).cast("long")))}[unit](value)
    return made if zoned else F.to_utc_timestamp(made, F.current_timezone()).cast("timestamp_ntz")


def nd_scalar_timestamp(value: Column, unit: str, zoned: bool = False) -> Column:
    return nd_scalar(timestamp_of(value, unit, zoned))


def nd_timestamps(values: Column, unit: str, names: Column | Sequence[str], sizes: Column | Sequence[int | Column], zoned: bool = False) -> Column:
    return nd_array(F.transform(values, lambda v: timestamp_of(v, unit, zoned)), names, sizes)


def nd_null(element: T.DataType | str) -> Column:
    return F.lit(None).cast(nd_type(element))


def nd_batch(df: DataFrame, **columns: Column) -> DataFrame:
    """One batch per row of ``df``: the given arrays, in order, marked as encoded."""
    return marked(df.select(*[c.alias(n) for n, c in columns.items()]))


def nd_from_table(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], dim: str, max_cells: int | None = None, origin: str = "origin", folder: str | None = None) -> DataFrame:
    """One batch per key: each value column as an array over ``dim``, ordered by ``order``.

    A key's rows meet in one row of the result. Where they may be too many for that,
    ``max_cells`` cuts each key into batches of so many cells, told apart by column
    ``origin``, the place of their first cell. Ranks then come from a window per key, which
    spills but is one task's; with ``folder``, a new one that all executors share, they come
    from ``ranked``, and a key with a third of all rows is no hot task."""
    if max_cells is not None:
        rank = free_name([*df.columns, origin], "__rank")
        if folder is None:
            along = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order))
            df = df.withColumn(rank, F.row_number().over(along).cast("long") - 1)
        else:
            df = ranked(df, keys, order, folder, rank)
        df = df.withColumn(origin, F.col(rank) - F.col(rank) % max_cells)
        keys, order = [*keys, origin], [rank]
    cells = F.array_sort(F.collect_list(F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)], *[quoted(c).alias(f"v{i}") for i, c in enumerate(values)])))
    held = free_name(df.columns, "__cells")
    packed = df.groupBy(*map(quoted, keys)).agg(cells.alias(held))
    arrays = [nd_array(F.col(f"{held}.v{i}"), [dim], [F.size(held)], validate=False).alias(c) for i, c in enumerate(values)]
    return marked(packed.select(*map(quoted, keys), *arrays), list(values))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, rank: str = "rank") -> DataFrame:
    """``df`` with each row's place among those of its key, from 0, by a prefix sum: rows are
    laid out in ranges of (key, order) in ``folder``, so that a key of many rows is many
    ranges; a row's place is that within its range plus the rows of its key in the ranges
    before. Rows alike in key and order are in one range, in any order."""
    part = free_name([*df.columns, rank], "__part")
    by = [*map(quoted, keys), *map(quoted, order)]
    df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()).write.parquet(folder)
    laid = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(folder)
    n, before = (free_name([*laid.columns, rank], x) for x in ("__n", "__before"))
    ahead = Window.partitionBy(*map(quoted, keys)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = laid.groupBy(*map(quoted, keys), part).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0)))
    sides = [(quoted(k), free_name([*laid.columns, rank, n, before], f"__k{i}")) for i, k in enumerate(keys)]
    counts = counts.select(*[k.alias(name) for k, name in sides], F.col(part).alias(n), before)
    met = laid.join(counts, [laid[part] == counts[n], *[k.eqNullSafe(F.col(name)) for k, name in sides]])
    within = F.row_number().over(Window.partitionBy(part, *map(quoted, keys)).orderBy(*map(quoted, order))) - 1
    return met.select(*map(quoted, df.columns), (F.col(before) + within).cast("long").alias(rank))


# Accessors


def nd_shape(a: Column) -> Column:
    return a[SIZES]


def nd_names(a: Column) -> Column:
    return a[NAMES]


def nd_values(a: Column) -> Column:
    return a[VALUES]


def nd_dimensions(a: Column) -> Column:
    """``array<struct<name, size>>``."""
    return F.zip_with(a[NAMES], a[SIZES], lambda n, s: F.struct(n.alias("name"), s.alias("size")))


def nd_is_null(a: Column) -> Column:
    return a.isNull()


def nd_rank(a: Column) -> Column:
    return F.size(a[SIZES])


def nd_is_scalar(a: Column) -> Column:
    return F.size(a[SIZES]) == 0


def nd_flat_size(a: Column) -> Column:
    return product(a[SIZES])


def literal_dimensions(dims: Sequence[Dimension]) -> Column:
    dims = dimensions(dims)
    made = F.array(*[F.struct(F.lit(d.name).alias("name"), F.lit(d.size).cast("long").alias("size")) for d in dims]) if dims else F.array()
    return made.cast("array<struct<name:string,size:bigint>>")


# Validation, encode, decode


def nd_error_code(a: Column) -> Column:
    """Null if the array is right (or null), else the first error's code."""
    cells = product(a[SIZES])
    return (
        F.when(a.isNull(), None)
        .when(a[NAMES].isNull(), NoDimensionNames.code)
        .when(a[SIZES].isNull(), NoDimensionSizes.code)
        .when(a[VALUES].isNull(), NoValues.code)
        .when(F.exists(a[NAMES], lambda x: x.isNull()) | F.exists(a[SIZES], lambda x: x.isNull()), NullDimension.code)
        .when(F.size(a[NAMES]) != F.size(a[SIZES]), DimensionSizeMismatch.code)
        .when(F.exists(a[SIZES], lambda x: x < 0) | (cells != F.size(a[VALUES])), ShapeAndLengthMismatch.code)
    )


def nd_decode(a: Column) -> Column:
    """The array itself; a row that is wrong fails the job with its error's code."""

    def decided(x: Column, code: Column) -> Column:
        said = F.to_json(F.struct(x[NAMES].alias(NAMES), x[SIZES].alias(SIZES), F.size(x[VALUES]).alias("values")))
        return F.when(x.isNull() | code.isNull(), x).otherwise(F.raise_error(F.concat(code, F.lit(": "), said)))

    return let(a, lambda x: let(nd_error_code(x), lambda code: decided(x, code)))


def encode_batches(df: DataFrame, columns: Sequence[str] | None = None, key: str = METADATA_KEY) -> DataFrame:
    """``df`` with its arrays validated and marked: ready for any Spark writer."""
    columns = list(columns) if columns is not None else df.columns
    for c in columns:
        check_nd(df.schema[c].dataType, c)
    return marked(df.withColumns({c: nd_decode(quoted(c)) for c in columns}), columns, key)


def decode_batches(df: DataFrame, columns: Sequence[str] | None = None, need_metadata: bool = True, key: str = METADATA_KEY) -> DataFrame:
    """Read-side of ``encode_batches``: checks metadata (unless told not to), types and rows."""
    columns = list(columns) if columns is not None else df.columns
    if need_metadata:
        check_marked(df, columns, key)
    return encode_batches(df, columns, key)


# Cast


def nd_cast(a: Column, element: str, strict: bool = False) -> Column:
    """Cells cast to the type, shape kept; what can't be cast is null, or fails if strict."""

    def cast(x: Column) -> Column:
        cells = F.transform(x[VALUES], lambda v: v.cast(element) if strict else v.try_cast(element))
        return F.when(x.isNotNull(), F.struct(x[NAMES].alias(NAMES), x[SIZES].alias(SIZES), cells.alias(VALUES)))

    return let(a, cast)
