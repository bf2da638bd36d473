"""Arrays as grids of chunks.

``nd_chunks`` cuts an array within its row (no shuffle, fit for streams);
``chunk_table`` builds chunks from a table of cells with one shuffle on the chunk's origin,
so an array of any size is spread over the cluster; ``unchunk`` turns chunks into cells.
Chunk origins are scalar columns in tables: Parquet statistics can skip chunks by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkShapeMismatch
from ..functions.arrays import let, nd_rank, product
from ..functions.schema import SIZES, VALUES, check_nd
from ..plans.dims import check_chunk_shape


def starts(size: Column, chunk: int) -> Column:
    """0, chunk, 2 chunk, ... below ``size``; nothing for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(chunk).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def grid(sizes: Column, chunk_shape: Sequence[int]) -> Column:
    """Origins of all chunks, the last dimension fastest."""
    origins = F.array(F.array().cast("array<bigint>"))
    for d, chunk in enumerate(chunk_shape):
        along = starts(F.element_at(sizes, d + 1), chunk)
        origins = F.flatten(F.transform(origins, lambda o: F.transform(along, lambda s: F.concat(o, F.array(s)))))  # noqa: B023
    return origins


def nd_chunks(a: Column, chunk_shape: Sequence[int]) -> Column:
    """``array<struct<chunk_ordinal, chunk_indices, shape, slices, values>>`` of an array.

    ``chunk_indices`` is the origin in elements. Chunks at the edge are smaller; a scalar is
    one chunk without dimensions; a null array has null chunks; nulls among cells stay.
    """
    shape = check_chunk_shape(chunk_shape)
    n = len(shape)
    sizes = a[SIZES]

    def piece(origin: Column, ordinal: Column) -> Column:
        o = [F.element_at(origin, d + 1) for d in range(n)]
        s = F.array(*[F.least(F.lit(c).cast("long"), F.element_at(sizes, d + 1) - o[d]) for d, c in enumerate(shape)]) if n else F.array()

        def filled(extent: Column) -> Column:
            e = [F.element_at(extent, d + 1) for d in range(n)]
            at = F.lit(0).cast("long")

            def source(k: Column) -> Column:
                flat, inner = at, F.lit(1).cast("long")
                stride = F.lit(1).cast("long")
                for d in reversed(range(n)):
                    flat = flat + (o[d] + F.call_function("div", k, inner) % e[d]) * stride
                    inner, stride = inner * e[d], stride * F.element_at(sizes, d + 1)
                return F.get(a[VALUES], flat.cast("int"))

            return F.struct(
                ordinal.cast("long").alias("chunk_ordinal"),
                origin.alias("chunk_indices"),
                extent.alias("shape"),
                F.zip_with(origin, extent, lambda x, y: F.struct(x.alias("start"), (x + y).alias("end"))).alias("slices"),
                F.transform(F.sequence(F.lit(0).cast("long"), product(extent) - 1), source).alias("values"),
            )

        return let(s.cast("array<bigint>"), filled)

    made = F.transform(grid(sizes, shape), piece)
    wrong = F.raise_error(F.concat(F.lit(f"{ChunkShapeMismatch.code}: rank "), nd_rank(a).cast("string"), F.lit(f" and chunk shape {shape}")))
    return F.when(a.isNull(), None).when(nd_rank(a) == n, made).otherwise(F.when(F.lit(True), wrong))


def chunk_batches(df: DataFrame, column: str, chunk_shape: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """One row per chunk of each row's array: stateless, also over streams."""
    check_nd(df.schema[column].dataType, column)
    pieces = df.select(*keep, F.explode(nd_chunks(F.col(column), chunk_shape)).alias("c"))
    return pieces.select(*keep, "c.*")


def chunk_table(cells: DataFrame, dims: Sequence[str], sizes: Sequence[int], chunk_shape: Sequence[int], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Chunks of the array whose cells are rows: keys, o0.., s0.., values.

    One shuffle, on keys and origin; a chunk's cells meet in one task, and the chunk shape
    bounds how many they are.
    """
    shape = check_chunk_shape(chunk_shape)
    if not len(shape) == len(dims) == len(sizes):
        raise ChunkShapeMismatch(f"CHUNK_SHAPE_MISMATCH: rank {len(dims)} and chunk shape {shape}")
    origin = [F.expr(f"(`{d}` div {c}) * {c}").cast("long").alias(f"o{i}") for i, (d, c) in enumerate(zip(dims, shape, strict=True))]
    within = F.lit(0).cast("long")
    for i, (d, c) in enumerate(zip(dims, shape, strict=True)):  # row-major within the chunk
        within = within * F.least(F.lit(c).cast("long"), F.lit(sizes[i]) - F.col(f"o{i}")) + F.col(d) % c
    placed = cells.select(*keys, *dims, *origin, F.col(value).alias("__value")).select(*keys, *[f"o{i}" for i in range(len(dims))], F.struct(within.alias("pos"), F.col("__value").alias("v")).alias("cell"))
    packed = placed.groupBy(*keys, *[f"o{i}" for i in range(len(dims))]).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    extent = [F.least(F.lit(c).cast("long"), F.lit(sizes[i]) - F.col(f"o{i}")).alias(f"s{i}") for i, c in enumerate(shape)]
    return packed.select(*keys, *[f"o{i}" for i in range(len(dims))], *extent, F.col("cells.v").alias("values"))


def chunk_rows(rows: DataFrame, outer: Sequence[str], sizes: Sequence[int], chunk_shape: Sequence[int], column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``chunk_table`` for tables with a row per line of the last dimension: ``column`` is the
    line, ``outer`` the other coordinates. Lines are cut before the shuffle, so it moves
    slices, not cells."""
    shape = check_chunk_shape(chunk_shape)
    n = len(shape)
    if not n == len(outer) + 1 == len(sizes):
        raise ChunkShapeMismatch(f"CHUNK_SHAPE_MISMATCH: rank {len(outer) + 1} and chunk shape {shape}")
    width = shape[-1]
    cut = F.transform(starts(F.lit(sizes[-1]).cast("long"), width), lambda o: F.struct(o.alias("o"), F.slice(column, o.cast("int") + 1, width).alias("part")))
    pieces = rows.select(*keys, *outer, F.explode(cut).alias("__c"))
    origin = [F.expr(f"(`{d}` div {c}) * {c}").cast("long").alias(f"o{i}") for i, (d, c) in enumerate(zip(outer, shape[:-1], strict=True))]
    line = F.lit(0).cast("long")
    for i, (d, c) in enumerate(zip(outer, shape[:-1], strict=True)):
        line = line * F.least(F.lit(c).cast("long"), F.lit(sizes[i]) - F.col(f"o{i}")) + F.col(d) % c
    by = [*keys, *[f"o{i}" for i in range(n)]]
    placed = pieces.select(*keys, *outer, *origin, F.col("__c.o").alias(f"o{n - 1}"), F.col("__c.part").alias("part")).select(*by, F.struct(line.alias("pos"), "part").alias("cell"))
    packed = placed.groupBy(*by).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    extent = [F.least(F.lit(c).cast("long"), F.lit(sizes[i]) - F.col(f"o{i}")).alias(f"s{i}") for i, c in enumerate(shape)]
    return packed.select(*by, *extent, F.flatten("cells.part").alias("values"))


def unchunk(chunks: DataFrame, dims: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of chunks: keys, coordinates and value. Narrow: no shuffle."""
    n = len(dims)
    rows = chunks.select(*keys, *[f"o{i}" for i in range(n)], *[f"s{i}" for i in range(n)], F.posexplode("values").alias("pos", value))
    at, inner = [], "1"
    for i in reversed(range(n)):
        at.insert(0, F.expr(f"o{i} + (pos div ({inner})) % s{i}").cast("long").alias(dims[i]))
        inner += f" * s{i}"
    return rows.select(*keys, *at, value)
