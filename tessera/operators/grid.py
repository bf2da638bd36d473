"""Operations on chunked arrays: tables with a row per chunk, as ``chunk_table`` makes them
(key columns, origins o0.., extents s0.., ``values``).

* ``broadcast_chunks`` brings the chunks of a smaller array to those of a larger one on an
  aligned grid, by a join on the origins they share; cells are formed within chunk pairs.
* ``rechunk`` moves an array to another grid: chunks are cut where the grids' lines meet, and
  the slices are put together, line by line.
* ``reduce_chunks`` sums up one dimension, first within chunks, then over them.
* ``cut_region`` trims chunks to a box.

No cell is a row anywhere here but in ``chunk_cells``, whose result they are. A join and a
grouping shuffle by keys and origin, so a chunk's shape bounds what meets in a task. Column
names of keys may be any; o0.., s0.. and ``values`` are the chunks' own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkShapeMismatch, InvalidShapes
from ..functions.schema import free_name, quoted
from ..plans.dims import Dimension, check_chunk_shape, dimensions


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else _long(b))


def origins(n: int) -> list[str]:
    return [f"o{i}" for i in range(n)]


def extents(n: int) -> list[str]:
    return [f"s{i}" for i in range(n)]


def broadcast_chunks(target: DataFrame, dims: Sequence[str], others: Mapping[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str] = ()) -> DataFrame:
    """``target`` with a column for each other array: the values of its chunk that lies along.

    ``dims`` are the target's dimensions; ``others`` gives, by the new column's name, another
    array's chunks and its dimensions, a subset of the target's in any order, cut at the same
    places. Each target chunk has one partner, so rows are as many as before; a chunk without
    a partner gets a null, a partner of another extent is an error. An array without
    dimensions is one row (for each key). ``expand`` and ``chunk_cells`` form the cells.
    """
    out = target
    for name, (chunks, own) in others.items():
        missing = [d for d in own if d not in dims]
        if missing:
            raise InvalidShapes(f"{InvalidShapes.code}: the target has no dimension {missing}")
        at = [list(dims).index(d) for d in own]
        held = {x: free_name([*out.columns, *keys], f"__{x}") for x in ("extent", "values")}
        side = chunks.select(*map(quoted, keys), *[F.col(f"o{i}").alias(f"o{t}") for i, t in enumerate(at)], F.array(*map(F.col, extents(len(at)))).cast("array<bigint>").alias(held["extent"]), F.col("values").alias(held["values"]))
        by = [*keys, *[f"o{t}" for t in at]]
        if by:
            met = out.join(side, by, "left")
        else:  # one row, which is checked
            one = side.agg(F.first(held["extent"]).alias(held["extent"]), F.first(held["values"]).alias(held["values"]), F.count("*").alias("__n"))
            wrong = F.raise_error(F.lit(f"{InvalidShapes.code}: an array without dimensions is one chunk"))
            one = one.select(held["extent"], F.when(F.col("__n") <= 1, F.col(held["values"])).otherwise(wrong).alias(held["values"]))
            met = out.crossJoin(F.broadcast(one))  # an aggregate without keys: one row
        fits = F.col(held["extent"]).isNull() | (F.col(held["extent"]) == F.array(*[F.col(f"s{t}") for t in at]).cast("array<bigint>"))
        wrong = F.raise_error(F.concat(F.lit(f"{ChunkShapeMismatch.code}: {name} is cut otherwise: "), F.to_json(held["extent"])))
        out = met.select(*map(quoted, out.columns), F.when(fits, F.col(held["values"])).otherwise(wrong).alias(name))
    return out


def _place(at: Column, dims: Sequence[str], own: Sequence[str]) -> Column:
    """Where the cell at position ``at`` of a chunk over ``dims`` is among the values of a
    chunk over ``own``."""
    coordinate, rest = {}, at
    for d in reversed(range(len(dims))):
        coordinate[dims[d]], rest = rest % F.col(f"s{d}"), _div(rest, F.col(f"s{d}"))
    place = _long(0)
    for d in own:
        place = place * F.col(f"s{list(dims).index(d)}") + coordinate[d]
    return place.cast("int")


def _cells(n: int) -> Column:
    size = _long(1)
    for s in extents(n):
        size = size * F.col(s)
    return size


def expand(chunks: DataFrame, dims: Sequence[str], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each of ``columns`` (with its dimensions) in the shape of its chunk; a null stays null."""
    def formed(name: str, own: Sequence[str]) -> Column:
        cells = F.when(_cells(len(dims)) > 0, F.transform(F.sequence(_long(0), _cells(len(dims)) - 1), lambda k: F.get(quoted(name), _place(k, dims, own)))).otherwise(F.slice(quoted(name), 1, 0))
        return F.when(quoted(name).isNotNull(), cells)

    return chunks.withColumns({name: formed(name, own) for name, own in columns.items()})


def chunk_cells(chunks: DataFrame, dims: Sequence[str], columns: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Cells of chunks with several arrays: keys, coordinates (named as the dimensions) and a
    value of each array, read at its own place. Narrow."""
    n, at = len(dims), free_name([*chunks.columns, *dims, *columns], "__pos")
    rows = chunks.withColumn(at, F.explode(F.when(_cells(n) > 0, F.sequence(_long(0), _cells(n) - 1))))
    where, rest = [], F.col(at)
    for d in reversed(range(n)):
        where.insert(0, (F.col(f"o{d}") + rest % F.col(f"s{d}")).alias(dims[d]))
        rest = _div(rest, F.col(f"s{d}"))
    return rows.select(*map(quoted, keys), *where, *[F.get(quoted(c), _place(F.col(at), dims, own)).alias(c) for c, own in columns.items()])


def _lines(low: Sequence[Column], high: Sequence[Column], within: Sequence[Column], column: Column) -> Column:
    """``array<struct<line, col, part>>``: the lines of the box from ``low`` to ``high`` of a
    chunk, numbered by their place in a chunk of extents ``within`` that begins at ``column``'s
    origins; one slice of ``values`` each."""
    n = len(low)
    count = _long(1)
    for d in range(n - 1):
        count = count * (high[d] - low[d])
    # Never negative: filters that Spark infers from what follows may ask for chunks outside, too.
    width = F.greatest(high[-1] - low[-1], _long(0)).cast("int")

    def line(k: Column) -> Column:
        rest, coordinate = k, [None] * (n - 1)
        for d in reversed(range(n - 1)):
            extent = F.greatest(high[d] - low[d], _long(1))
            coordinate[d], rest = low[d] + rest % extent, _div(rest, extent)
        source, number = _long(0), _long(0)
        for d in range(n - 1):
            source = source * F.col(f"s{d}") + (coordinate[d] - F.col(f"o{d}"))
            number = number * within[d] + (coordinate[d] - F.get(column, F.lit(d)))
        start = source * F.col(f"s{n - 1}") + low[-1] - F.col(f"o{n - 1}")
        return F.struct(number.alias("line"), (low[-1] - F.get(column, F.lit(n - 1))).alias("col"), F.slice("values", F.greatest(start + 1, _long(1)).cast("int"), width).alias("part"))

    return F.transform(F.sequence(_long(0), count - 1), line)


def rechunk(chunks: DataFrame, sizes: Sequence[int], chunk_shape: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """The same array on the grid of ``chunk_shape``: keys, o0.., s0.., values.

    Each chunk is cut where it meets chunks of the new grid; slices of its lines travel, with
    one shuffle on the new origin, and are put in order there. Chunks may be of any shapes, as
    long as they fill the array without overlap. An array without dimensions has one chunk
    and stays as it is."""
    shape = check_chunk_shape(chunk_shape)
    n = len(shape)
    if n != len(sizes):
        raise ChunkShapeMismatch(f"{ChunkShapeMismatch.code}: rank {len(sizes)} and chunk shape {shape}")
    if not n:
        return chunks
    meets = F.array(F.array().cast("array<bigint>"))
    for d, c in enumerate(shape):
        first, last = _div(F.col(f"o{d}"), c) * c, _div(F.col(f"o{d}") + F.col(f"s{d}") - 1, c) * c
        along = F.when(F.col(f"s{d}") > 0, F.sequence(first, last, _long(c))).otherwise(F.array().cast("array<bigint>"))
        meets = F.flatten(F.transform(meets, lambda o: F.transform(along, lambda s: F.concat(o, F.array(s)))))  # noqa: B023

    goes, pieces = free_name([*chunks.columns, *keys], "__to"), free_name([*chunks.columns, *keys], "__lines")
    to = [F.get(goes, F.lit(d)) for d in range(n)]
    low = [F.greatest(F.col(f"o{d}"), to[d]) for d in range(n)]
    high = [F.least(F.col(f"o{d}") + F.col(f"s{d}"), to[d] + c) for d, c in enumerate(shape)]
    extent = [F.least(_long(c), _long(sizes[d]) - to[d]) for d, c in enumerate(shape)]
    cut = chunks.withColumn(goes, F.explode(meets)).select(*map(quoted, keys), *[t.alias(f"__o{d}") for d, t in enumerate(to)], _lines(low, high, extent, F.col(goes)).alias(pieces))
    by = [*keys, *[f"__o{d}" for d in range(n)]]
    whole = cut.groupBy(*map(quoted, by)).agg(F.array_sort(F.flatten(F.collect_list(pieces))).alias(pieces))
    origin = [F.col(f"__o{d}").alias(f"o{d}") for d in range(n)]
    size = [F.least(_long(c), _long(sizes[d]) - F.col(f"__o{d}")).alias(f"s{d}") for d, c in enumerate(shape)]
    return whole.select(*map(quoted, keys), *origin, *size, F.flatten(F.col(pieces)["part"]).alias("values"))


def cut_region(chunks: DataFrame, region: Sequence[tuple[int, int]], keys: Sequence[str] = ()) -> DataFrame:
    """The part of each chunk within a box, given as (from, to) for each dimension; chunks
    outside are left out. Narrow; lines are sliced, cells aren't touched."""
    n = len(region)
    inside = F.lit(True)
    for d, (a, b) in enumerate(region):
        inside = inside & F.lit(a < b) & (F.col(f"o{d}") < b) & (F.col(f"o{d}") + F.col(f"s{d}") > a)
    low = [F.greatest(F.col(f"o{d}"), _long(a)) for d, (a, _) in enumerate(region)]
    high = [F.least(F.col(f"o{d}") + F.col(f"s{d}"), _long(b)) for d, (_, b) in enumerate(region)]
    if not n:
        return chunks
    whole = F.lit(True)
    for d in range(n):
        whole = whole & (low[d] == F.col(f"o{d}")) & (high[d] == F.col(f"o{d}") + F.col(f"s{d}"))
    lines = _lines(low, high, [high[d] - low[d] for d in range(n)], F.array(*low))
    values = F.when(whole, F.col("values")).otherwise(F.flatten(F.transform(lines, lambda x: x["part"])))
    # Under other names first: a name of the source that the same projection gives anew is taken for the new one.
    cut = chunks.where(inside).select(*map(quoted, keys), *[a.alias(f"__o{d}") for d, a in enumerate(low)], *[(high[d] - low[d]).alias(f"__s{d}") for d in range(n)], values.alias("__values"))
    return cut.select(*map(quoted, keys), *[F.col(f"__{c}").alias(c) for c in [*origins(n), *extents(n), "values"]])


def reduce_chunks(chunks: DataFrame, rank: int, axis: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over dimension ``axis``: chunks of the remaining dimensions (o0.., s0..) with arrays
    ``n`` (cells that aren't null), ``nulls``, ``sum``, ``least`` and ``most``.

    A chunk gives its own sums, one for each cell of the result; these are added up over the
    chunks along the axis, before the shuffle and after it, and packed again. Cells of the
    source are never rows. A place with nulls only has n = 0 and a null sum."""
    if not 0 <= axis < rank:
        raise InvalidShapes(f"{InvalidShapes.code}: no dimension {axis} of {rank}")
    rest = [d for d in range(rank) if d != axis]
    kind = chunks.schema["values"].dataType.elementType.simpleString()
    total = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double" if kind in ("float", "double") else kind
    # The strides of the chunk, and the place of a result's cell at axis 0.
    after = " * ".join([*[f"s{d}" for d in range(axis + 1, rank)], "1L"])
    base = f"(k div ({after})) * ({after}) * s{axis} + k % ({after})"
    cell = f"get(values, cast({base} + i * ({after}) as int))"
    merged = f"named_struct('n', a.n + if(x is null, 0L, 1L), 'sum', if(x is null, a.sum, coalesce(a.sum, cast(0 as {total})) + cast(x as {total})), 'least', least(a.least, x), 'most', greatest(a.most, x))"
    one = f"aggregate(transform(sequence(0L, s{axis} - 1), i -> {cell}), named_struct('n', 0L, 'sum', cast(null as {total}), 'least', cast(null as {kind}), 'most', cast(null as {kind})), (a, x) -> {merged})"
    cells = " * ".join([*[f"s{d}" for d in rest], "1L"])
    own = chunks.where(" and ".join(f"s{d} > 0" for d in range(rank)))
    sums = own.select(*map(quoted, keys), *[F.col(f"o{d}").alias(f"o{i}") for i, d in enumerate(rest)], *[F.col(f"s{d}").alias(f"s{i}") for i, d in enumerate(rest)], F.col(f"s{axis}").alias("__along"), F.posexplode(F.expr(f"transform(sequence(0L, {cells} - 1), k -> {one})")).alias("__pos", "__sum"))
    by = [*keys, *origins(len(rest)), *extents(len(rest))]
    added = sums.groupBy(*map(quoted, by), "__pos").agg(F.sum("__sum.n").alias("n"), (F.sum("__along") - F.sum("__sum.n")).alias("nulls"), F.sum("__sum.sum").alias("sum"), F.min("__sum.least").alias("least"), F.max("__sum.most").alias("most"))
    names = ("n", "nulls", "sum", "least", "most")
    packed = added.groupBy(*map(quoted, by)).agg(F.array_sort(F.collect_list(F.struct("__pos", *names))).alias("__cells"))
    return packed.select(*map(quoted, by), *[F.col("__cells")[c].alias(c) for c in names])


def grid_of(dims: Sequence[Dimension], chunk_shape: Sequence[int]) -> int:
    """How many chunks an array has."""
    count = 1
    for d, c in zip(dimensions(dims), check_chunk_shape(chunk_shape), strict=True):
        count *= -(-d.size // c)
    return count
