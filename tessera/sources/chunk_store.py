"""Chunk stores: chunked arrays as Parquet, planned from the data and read by region.

``measure`` takes the sizes of dimensions from a table, in one pass over its coordinates;
``plan_grids`` gives grids for several arrays, aligned where they share a dimension;
``write_store`` lays chunks out by origin, so that the statistics of row groups tell which
boxes they hold; ``read_region`` asks for a box, sends its bounds to the scan, and trims the
chunks at its edge. A store carries its dimensions, their sizes and the chunk shape in the
metadata of its ``values``, so a reader needs nothing but the path.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ChunkShapeMismatch, InvalidShapes
from ..functions.schema import quoted
from ..operators.grid import cut_region, extents, origins
from ..plans.dims import Dimension, aligned_chunks, check_chunk_shape, dimensions

#: Metadata key of a store's grid; rows of a row group at most.
GRID_KEY, GROUP_BYTES = "nd-chunk-grid", 16 << 20


class Grid(NamedTuple):
    dims: tuple[Dimension, ...]
    chunk_shape: tuple[int, ...]
    keys: tuple[str, ...] = ()


def measure(df: DataFrame, coordinates: Sequence[str]) -> tuple[Dimension, ...]:
    """Dimensions as long as the largest coordinate asks for, counted from 0; of an empty table
    they have size 0. One aggregate, which reads the coordinates' columns only; a negative
    coordinate is an error."""
    found = df.agg(*[F.min(quoted(c)).alias(f"low{i}") for i, c in enumerate(coordinates)], *[F.max(quoted(c)).alias(f"high{i}") for i, c in enumerate(coordinates)]).first()
    below = [c for i, c in enumerate(coordinates) if (found[f"low{i}"] or 0) < 0]
    if below:
        raise InvalidShapes(f"{InvalidShapes.code}: negative coordinates in {below}")
    return tuple(Dimension(c, 0 if found[f"high{i}"] is None else int(found[f"high{i}"]) + 1) for i, c in enumerate(coordinates))


def plan_grids(arrays: Mapping[str, Sequence[Dimension]], target: int) -> dict[str, Grid]:
    """A grid for each array, with chunks near ``target`` elements (see ``aligned_chunks``);
    a dimension that several have is cut at the same places in all."""
    found = aligned_chunks([dimensions(d) for d in arrays.values()], target)
    return {name: Grid(dimensions(dims), tuple(c.size for c in chunks)) for (name, dims), chunks in zip(arrays.items(), found, strict=True)}


def write_store(chunks: DataFrame, path: str, grid: Grid, mode: str = "error", group_bytes: int = GROUP_BYTES) -> None:
    """Chunks (keys, o0.., s0.., values) to Parquet, clustered by keys and origin: ranges of
    them in files, in order within files, so a box is few row groups. Ranges are split by
    a sample of origins; a key of many chunks is many ranges."""
    n = len(grid.dims)
    if len(check_chunk_shape(grid.chunk_shape)) != n:
        raise ChunkShapeMismatch(f"{ChunkShapeMismatch.code}: rank {n} and chunk shape {list(grid.chunk_shape)}")
    note = {GRID_KEY: json.dumps({"dims": [list(d) for d in grid.dims], "chunk_shape": list(grid.chunk_shape), "keys": list(grid.keys)})}
    by = [*map(quoted, grid.keys), *map(F.col, origins(n))]
    laid = chunks.repartitionByRange(*by).sortWithinPartitions(*by) if by else chunks
    noted = laid.select(*map(quoted, grid.keys), *origins(n), *extents(n), F.col("values").alias("values", metadata=note))
    noted.write.option("parquet.block.size", str(group_bytes)).mode(mode).parquet(path)


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """A store's chunks and grid."""
    df = spark.read.parquet(path)
    note = df.schema["values"].metadata.get(GRID_KEY) if "values" in df.columns else None
    if note is None:
        raise ChunkShapeMismatch(f"{ChunkShapeMismatch.code}: {path} is no chunk store")
    told = json.loads(note)
    return df, Grid(dimensions(told["dims"]), tuple(told["chunk_shape"]), tuple(told["keys"]))


def read_region(spark: SparkSession, path: str, region: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Chunks of the box ``region`` (from, to by dimension; the others whole), trimmed to it;
    origins are still those of the whole array. Bounds are compared with origins alone, so
    the scan skips row groups (and pages) without chunks of the box."""
    df, grid = open_store(spark, path)
    names = [d.name for d in grid.dims]
    unknown = set(region) - set(names)
    if unknown:
        raise InvalidShapes(f"{InvalidShapes.code}: the array has no dimension {sorted(unknown)}")
    box = [(max(0, region[d.name][0]), min(d.size, region[d.name][1])) if d.name in region else (0, d.size) for d in grid.dims]
    for i, ((a, b), c) in enumerate(zip(box, grid.chunk_shape, strict=True)):
        if names[i] in region:
            df = df.where((F.col(f"o{i}") >= a // c * c) & (F.col(f"o{i}") < max(a, b)))
    return cut_region(df, box, grid.keys)
