"""Views: arrays that are expanded, sliced and cut without touching their values.

A view is ``struct<dimension_names, dimension_sizes, strides, offset, values>``: the cell at
(i, j, ...) is ``values[offset + i * strides[0] + j * strides[1] + ...]``. A dimension that the
source hasn't has stride 0, so an expansion costs as much as its source, whatever its
target's size; a slice moves the offset. The first two fields are those of an array, so the
accessors of shapes (``nd_shape``, ``nd_rank``, ``nd_flat_size``, ``nd_dimensions``, ...) take
views too. A null view is a null array; nulls among cells are read like other cells.

Cells are formed where they are asked for: by ``view_table`` as rows, by ``view_array`` as an
array again. Both take the rank, where the planner knows it, to keep the arithmetic of
places in generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkShapeMismatch, InvalidShapes
from ..functions.arrays import let, nd_dimensions, nd_flat_size, product
from ..functions.schema import NAMES, SIZES, VALUES, free_name, quoted
from ..plans.dims import check_chunk_shape
from .broadcast import offset_in
from .chunk import grid

#: The fields a view has besides an array's.
STRIDES, OFFSET = "strides", "offset"


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _view(names: Column, sizes: Column, strides: Column, offset: Column, values: Column) -> Column:
    return F.struct(names.alias(NAMES), sizes.alias(SIZES), strides.alias(STRIDES), offset.cast("long").alias(OFFSET), values.alias(VALUES))


def row_major(sizes: Column) -> Column:
    """Strides of an array of these sizes."""
    return F.transform(sizes, lambda _, i: product(F.slice(sizes, i + 2, F.size(sizes))))


def nd_view(a: Column) -> Column:
    """The whole array as a view."""
    return F.when(a.isNotNull(), _view(a[NAMES], a[SIZES], row_major(a[SIZES]), _long(0), a[VALUES]))


def nd_broadcast_view(a: Column, target: Column) -> Column:
    """``a`` in the shape ``target`` (``array<struct<name, size>>``): the dimensions before and
    after its own get stride 0. An array that doesn't lie in the target fails the job; a null
    array stays null."""
    wrong = F.raise_error(F.concat(F.lit(f"{InvalidShapes.code}: "), F.to_json(nd_dimensions(a)), F.lit(" can't be expanded to "), F.to_json(target)))
    own = row_major(a[SIZES])

    def placed(at: Column) -> Column:
        strides = F.transform(target, lambda _, i: F.when((i >= at) & (i < at + F.size(own)), F.get(own, i - at)).otherwise(_long(0)))
        made = _view(F.transform(target, lambda d: d["name"]), F.transform(target, lambda d: d["size"]), strides, _long(0), a[VALUES])
        return F.when(at.isNotNull(), made).otherwise(F.when(F.lit(True), wrong))

    return F.when(a.isNotNull(), let(offset_in(nd_dimensions(a), target), placed))


def slice_view(v: Column, origin: Column | Sequence[int], extent: Column | Sequence[int]) -> Column:
    """The part of a view from ``origin`` on, of ``extent`` cells along each dimension."""
    origin, extent = (x if isinstance(x, Column) else F.array(*map(F.lit, x)).cast("array<bigint>") for x in (origin, extent))
    offset = v[OFFSET] + F.aggregate(F.zip_with(origin, v[STRIDES], lambda o, s: o * s), _long(0), lambda n, x: n + x)
    return F.when(v.isNotNull(), _view(v[NAMES], extent, v[STRIDES], offset, v[VALUES]))


def trim_view(v: Column) -> Column:
    """The same cells over no more of the values than lie between the first and the last of
    them: what a slice should carry before it is shuffled or written."""
    reach = F.aggregate(F.zip_with(v[SIZES], v[STRIDES], lambda n, s: (n - 1) * s), _long(1), lambda n, x: n + x)
    span = F.when(nd_flat_size(v) == 0, _long(0)).otherwise(reach)
    return F.when(v.isNotNull(), _view(v[NAMES], v[SIZES], v[STRIDES], _long(0), F.slice(v[VALUES], (v[OFFSET] + 1).cast("int"), span.cast("int"))))


def view_cell(v: Column, at: Column, rank: int | None = None) -> Column:
    """The cell at a row-major position; null beyond the last."""
    if rank is None:
        def step(acc: Column, d: Column) -> Column:
            size, stride = F.greatest(F.get(v[SIZES], d), _long(1)), F.get(v[STRIDES], d)
            return F.struct(F.call_function("div", acc["k"], size).alias("k"), (acc["at"] + acc["k"] % size * stride).alias("at"))

        last_first = F.reverse(F.transform(v[SIZES], lambda _, i: i))
        place = F.aggregate(last_first, F.struct(at.cast("long").alias("k"), v[OFFSET].alias("at")), step)["at"]
        return F.get(v[VALUES], F.when(at < nd_flat_size(v), place).cast("int"))
    place, rest = v[OFFSET], at.cast("long")
    for d in reversed(range(rank)):
        size = F.greatest(F.get(v[SIZES], F.lit(d)), _long(1))
        place, rest = place + rest % size * F.get(v[STRIDES], F.lit(d)), F.call_function("div", rest, size)
    return F.get(v[VALUES], place.cast("int"))


def view_array(v: Column, rank: int | None = None) -> Column:
    """The view as an array, its cells formed."""
    def formed(x: Column) -> Column:
        cells = F.when(nd_flat_size(x) > 0, F.transform(F.sequence(_long(0), nd_flat_size(x) - 1), lambda k: view_cell(x, k, rank))).otherwise(F.slice(x[VALUES], 1, 0))
        return F.when(x.isNotNull(), F.struct(x[NAMES].alias(NAMES), x[SIZES].alias(SIZES), cells.alias(VALUES)))

    return let(v, formed)


def view_chunks(v: Column, chunk_shape: Sequence[int]) -> Column:
    """``array<struct<chunk_ordinal, chunk_indices, view>>``: a trimmed view per chunk of the
    grid, those at the edge smaller. Nothing is expanded: a chunk of an expanded vector
    carries its part of the vector."""
    shape = check_chunk_shape(chunk_shape)
    n = len(shape)

    def piece(origin: Column, ordinal: Column) -> Column:
        extent = F.array(*[F.least(_long(c), F.element_at(v[SIZES], d + 1) - F.element_at(origin, d + 1)) for d, c in enumerate(shape)]) if n else F.array()
        return F.struct(ordinal.cast("long").alias("chunk_ordinal"), origin.alias("chunk_indices"), trim_view(slice_view(v, origin, extent.cast("array<bigint>"))).alias("view"))

    wrong = F.raise_error(F.concat(F.lit(f"{ChunkShapeMismatch.code}: rank "), F.size(v[SIZES]).cast("string"), F.lit(f" and chunk shape {shape}")))
    return F.when(v.isNull(), None).when(F.size(v[SIZES]) == n, F.transform(grid(v[SIZES], shape), piece)).otherwise(F.when(F.lit(True), wrong))


def view_table(df: DataFrame, columns: Mapping[str, int | None] | Sequence[str], keep: Sequence[str] = (), coordinates: Sequence[str] = ()) -> DataFrame:
    """One row per cell of each row's views, which have one shape in a row; ``columns`` gives
    their ranks where the planner knows them. ``coordinates`` name a column for each
    dimension. A null view has null cells; a row whose views are all null has no cells."""
    ranks = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns)
    at, total = free_name([*df.columns, *coordinates], "__pos"), free_name([*df.columns, *coordinates], "__cells")
    counts = F.coalesce(*[nd_flat_size(quoted(c)) for c in ranks])
    sizes = F.coalesce(*[quoted(c)[SIZES] for c in ranks])
    shape = free_name([*df.columns, *coordinates], "__shape")
    rows = df.select(*map(quoted, [*keep, *ranks]), counts.alias(total), *([sizes.alias(shape)] if coordinates else []))
    cells = rows.withColumn(at, F.explode(F.when(F.col(total) > 0, F.sequence(_long(0), F.col(total) - 1))))
    where, rest = [], F.col(at)
    for d in reversed(range(len(coordinates))):
        size = F.greatest(F.get(shape, F.lit(d)), _long(1))
        where.insert(0, (rest % size).alias(coordinates[d]))
        rest = F.call_function("div", rest, size)
    return cells.select(*map(quoted, keep), *where, *[view_cell(quoted(c), F.col(at), rank).alias(c) for c, rank in ranks.items()])
