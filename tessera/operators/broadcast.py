"""Expansion of arrays to common dimensions, and flattening of batches to tables.

Three ways give the same cells:

* static: dimensions known to the planner; repeat counts are literals;
* dynamic: dimensions are data and may differ by row;
* relational: cells are rows, arrays meet by a join on the dimensions they share. Nothing
  is repeated in memory and a join is spread over the cluster.

A table is made by exploding positions and reading every array at its own place of the
position, so no array is expanded in memory; only ``nd_broadcast``, whose result is an
array, does that (``nd_broadcast_view`` gives a view instead). A row whose target is larger
than ``PACKED_CELLS`` is cut into slabs of so many cells. Where the planner knows the target,
slabs are sliced off before they are dealt over the cluster: arrays whose cells follow the
target's leading dimensions move once, in parts, the others (vectors along trailing
dimensions) with each slab. Where dimensions are data, ``spread`` does the same; without it
slabs bound the positions a task holds, but a row stays in its task. ``largest_target`` tells
how many cells that is, from names and sizes alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidShapes, NoBroadcastShape
from ..functions.arrays import let, literal_dimensions, nd_dimensions, product
from ..functions.schema import NAMES, SIZES, VALUES, check_nd, free_name, quoted
from ..plans.dims import Dimension, broadcast_target, dimensions, flat_size, repeats_or_raise, strides

#: Cells of a row's target that one task turns into rows; beyond, the row is cut into slabs.
PACKED_CELLS = 10_000_000


def repeat_cells(values: Column, whole: int | Column, each: int | Column) -> Column:
    """Each cell ``each`` times, and all of that ``whole`` times."""
    if not (isinstance(each, int) and each == 1):
        count = each if isinstance(each, int) else each.cast("int")
        values = F.flatten(F.transform(values, lambda x: F.array_repeat(x, count)))
    if not (isinstance(whole, int) and whole == 1):
        values = F.flatten(F.array_repeat(values, whole if isinstance(whole, int) else whole.cast("int")))
    return values


def broadcast_static(a: Column, dims: Sequence[Dimension], target: Sequence[Dimension], element: str) -> Column:
    """Cells of ``a`` in the target's shape; a null array gives null cells."""
    dims, target = dimensions(dims), dimensions(target)
    how = repeats_or_raise(dims, target)
    n = flat_size(target)
    if dims == () and target != ():
        cells = F.array_repeat(F.element_at(a[VALUES], 1), n)
    else:
        cells = repeat_cells(a[VALUES], how.whole, how.each)
    return F.when(a.isNull(), F.array_repeat(F.lit(None).cast(element), n)).otherwise(cells)


def offset_in(dims: Column, target: Column) -> Column:
    """Where ``dims`` first lie in ``target`` without gaps; null if they don't."""
    spare = F.size(target) - F.size(dims)
    places = F.filter(F.sequence(F.lit(0), F.greatest(spare, F.lit(0))), lambda i: F.slice(target, i + 1, F.size(dims)) == dims)
    return F.when(dims == target, 0).when(spare < 0, None).when(F.size(dims) == 0, 0).otherwise(F.get(places, 0))


def repeats_of(dims: Column, target: Column) -> Column:
    """``struct<whole, each>``, null if ``dims`` can't be expanded to ``target``."""
    sizes = F.transform(target, lambda x: x["size"])

    def factors(at: Column) -> Column:
        # Slices of no length are taken as such: a slice's start must be within reach.
        whole = product(F.slice(sizes, 1, at))
        each = product(F.slice(sizes, at + F.size(dims) + 1, F.size(target)))
        return F.when(at.isNotNull(), F.struct(whole.alias("whole"), each.alias("each")))

    equal = F.struct(F.lit(1).cast("long").alias("whole"), F.lit(1).cast("long").alias("each"))
    return F.when(dims == target, equal).otherwise(let(offset_in(dims, target), factors))


def broadcast_dynamic(a: Column, target: Column, element: str) -> Column:
    """Cells of ``a`` in the shape ``target`` (``array<struct<name, size>>``) of its row."""
    wrong = F.raise_error(F.concat(F.lit(f"{InvalidShapes.code}: "), F.to_json(nd_dimensions(a)), F.lit(" can't be expanded to "), F.to_json(target)))
    nulls = F.array_repeat(F.lit(None).cast(element), product(F.transform(target, lambda x: x["size"])).cast("int"))
    cells = let(repeats_of(nd_dimensions(a), target), lambda r: F.when(r.isNull(), F.when(F.lit(True), wrong).cast(f"array<{element}>")).otherwise(repeat_cells(a[VALUES], r["whole"], r["each"])))
    return F.when(a.isNull(), nulls).otherwise(cells)


def nd_broadcast(a: Column, target: Column, element: str) -> Column:
    """``a`` expanded to the dimensions ``target``, as an array again."""
    cells = broadcast_dynamic(a, target, element)
    return F.struct(F.transform(target, lambda x: x["name"]).alias(NAMES), F.transform(target, lambda x: x["size"]).alias(SIZES), cells.alias(VALUES))


def target_of(arrays: Sequence[Column]) -> Column:
    """The longest dimensions among a row's arrays, the first of equals; null arrays have none."""
    if not arrays:
        raise NoBroadcastShape("NO_BROADCAST_SHAPE: there are no columns")
    dims = [F.coalesce(nd_dimensions(a), literal_dimensions(())) for a in arrays]
    best = dims[0]
    for d in dims[1:]:
        best = F.when(F.size(d) > F.size(best), d).otherwise(best)
    return best


def largest_target(df: DataFrame, columns: Sequence[str]) -> int:
    """Cells of the largest target among the rows: what ``spread`` is decided by. Reads names
    and sizes, not values (of Parquet, only their columns)."""
    cells = product(F.transform(target_of([quoted(c) for c in columns]), lambda d: d["size"]))
    return df.agg(F.max(cells)).first()[0] or 0


def broadcast_to_table(df: DataFrame, columns: Sequence[str] | None = None, dims: Mapping[str, Sequence[Dimension]] | None = None, keep: Sequence[str] = (), coordinates: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Flatten each row's batch to a table: one row per cell of the target shape.

    ``dims`` gives every array's dimensions if all rows share them (static); without it they
    are read from each row. ``keep`` columns are repeated as they are. ``coordinates`` names
    a position column and one column for each target dimension (static only), since rows of
    a table have no order. ``spread`` deals the slabs of large rows over the cluster though
    dimensions are data (static targets are, by their size).
    """
    columns = [c for c in (columns if columns is not None else df.columns) if c not in keep]
    if not columns:
        raise NoBroadcastShape("NO_BROADCAST_SHAPE: there are no columns")
    for c in columns:
        check_nd(df.schema[c].dataType, c)
    taken = {c.lower() for c in df.columns} | {c.lower() for c in coordinates}

    def own(name: str) -> str:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        return name

    at, part = own("__pos"), own("__slab")
    if dims is not None:
        known = {c: dimensions(dims[c]) for c in columns}
        target = broadcast_target(list(known.values()))
        n = flat_size(target)
        how = {c: repeats_or_raise(known[c], target) for c in columns}
        each = {c: how[c].each for c in columns}
        rows = df.select(*map(quoted, keep), *[quoted(c)[VALUES].alias(c) for c in columns])
        first, begins = F.lit(0).cast("long"), dict.fromkeys(columns, F.lit(0).cast("long"))
        count = F.lit(n).cast("long")
        if n > PACKED_CELLS:
            first = F.col(part)
            count = F.least(F.lit(PACKED_CELLS).cast("long"), F.lit(n) - first)
            begins = {c: _whole_div(first, each[c]) if known[c] and how[c].whole == 1 else begins[c] for c in columns}
            last = {c: _whole_div(first + count - 1, each[c]) for c in columns}
            own = {c: F.slice(quoted(c), (begins[c] + 1).cast("int"), (last[c] - begins[c] + 1).cast("int")) if known[c] and how[c].whole == 1 else quoted(c) for c in columns}
            slabs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(PACKED_CELLS).cast("long"))).alias(part)
            # Sliced in the projection below the exchange; round robin, as few rows make many slabs.
            rows = rows.select("*", slabs).select(*map(quoted, keep), *[own[c].alias(c) for c in columns], part).hint("rebalance")
        cells = rows.withColumn(at, F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))))
        place = F.col(at) + first

        def cell(c: str) -> Column:
            if not known[c]:
                return F.get(quoted(c), F.lit(0))
            if known[c] == target:
                return F.get(quoted(c), F.col(at).cast("int"))
            if how[c].whole == 1:
                return F.get(quoted(c), (_whole_div(place, each[c]) - begins[c]).cast("int"))
            return F.get(quoted(c), _div(place, each[c], flat_size(known[c])))

        names, sizes = list(coordinates), [d.size for d in target]
        where = [place.cast("long").alias(name) for name in names[:1]] + [_div(place, step, size).cast("long").alias(name) for name, step, size in zip(names[1:], strides(sizes), sizes, strict=False)]
        return cells.select(*map(quoted, keep), *where, *[cell(c).alias(c) for c in columns])
    if coordinates:
        raise ValueError("coordinates need static dimensions")
    # SQL text, as these expressions are long and every row's dimensions are asked for often.
    best, total, top = own("__target"), own("__cells"), own("__rank")
    shapes, steps = {c: own(f"__dims_{i}") for i, c in enumerate(columns)}, {c: own(f"__each_{i}") for i, c in enumerate(columns)}
    own_dims = [f"zip_with({_quoted(c)}.{NAMES}, {_quoted(c)}.{SIZES}, (n, s) -> named_struct('name', n, 'size', cast(s as bigint))) as {shapes[c]}" for c in columns]
    kept = [_quoted(k) for k in keep]
    held = df.selectExpr(*kept, *map(_quoted, columns), *own_dims)
    largest = ", ".join(f"coalesce(size({d}), 0)" for d in shapes.values())
    first = " ".join(f"when coalesce(size({d}), 0) = {top} then {d}" for d in shapes.values())
    held = held.selectExpr("*", f"greatest({largest}, 0) as {top}").selectExpr("*", f"coalesce(case {first} end, cast(array() as array<struct<name: string, size: bigint>>)) as {best}")
    held = held.selectExpr(*kept, f"aggregate({best}, 1L, (n, d) -> n * d.size) as {total}", *[f"{_each_sql(_quoted(c), shapes[c], best)} as {steps[c]}" for c in columns], *[f"{_quoted(c)} as {shapes[c]}" for c in columns])
    held = held.selectExpr(*kept, total, *steps.values(), *[f"{shapes[c]}.{VALUES} as {_quoted(c)}" for c in columns])
    # Errors of a row must show though it has no cells: its counts are asked for first.
    asked = " + ".join(steps.values())
    whole = {c: own(f"__size_{i}") for i, c in enumerate(columns)}
    slabs = held.selectExpr("*", f"explode(case when {total} > 0 then sequence(0L, {total} - 1, {PACKED_CELLS}L) when {asked} < 0 then array(0L) end) as {part}")
    count = f"least({PACKED_CELLS}L, {total} - {part})"
    begins = dict.fromkeys(columns, "0L")
    if spread:  # an array along the leading dimensions goes with its part for the slab
        leads = {c: f"{steps[c]} * size({_quoted(c)}) = {total}" for c in columns}
        moved = {c: own(f"__from_{i}") for i, c in enumerate(columns)}
        slabs = slabs.selectExpr(*kept, total, part, *steps.values(), *[f"size({_quoted(c)}) as {whole[c]}" for c in columns], *[f"if({leads[c]}, {part} div {steps[c]}, 0L) as {moved[c]}" for c in columns], *[f"if({leads[c]}, slice({_quoted(c)}, cast({part} div {steps[c]} as int) + 1, cast(({part} + {count} - 1) div {steps[c]} - {part} div {steps[c]} as int) + 1), {_quoted(c)}) as {_quoted(c)}" for c in columns]).hint("rebalance")
        begins, sizes = moved, whole
    else:
        sizes = {c: f"size({_quoted(c)})" for c in columns}
    cells = slabs.withColumn(at, F.expr(f"explode(sequence({part}, {part} + {count} - 1))"))
    return cells.selectExpr(*kept, *[f"get({_quoted(c)}, cast({at} div {steps[c]} % {sizes[c]} - {begins[c]} as int)) as {_quoted(c)}" for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _each_sql(a: str, dims: str, target: str) -> str:
    """How often each cell of ``a`` is repeated in the shape ``target``; 1 for a null array,
    an error where ``a`` can't be expanded to it."""
    wrong = f"raise_error(concat('{InvalidShapes.code}: ', to_json({dims}), ' can\\'t be expanded to ', to_json({target})))"
    start = f"get(filter(sequence(0, greatest(size({target}) - size({dims}), 0)), i -> slice({target}, i + 1, size({dims})) = {dims}), 0)"
    each = f"aggregate(slice({target}, {start} + size({dims}) + 1, size({target})), 1L, (n, d) -> n * d.size)"
    return f"case when {a} is null or {dims} = {target} then 1L when size({dims}) = 0 then greatest(1L, aggregate({target}, 1L, (n, d) -> n * d.size)) when size({dims}) > size({target}) or {start} is null then cast({wrong} as bigint) else greatest(1L, {each}) end"


def _whole_div(place: Column, step: int) -> Column:
    return F.call_function("div", place, F.lit(max(1, step)).cast("long"))


def _div(place: Column, step: int, size: int) -> Column:
    """``place div step % size``, as an index."""
    return (F.call_function("div", place, F.lit(max(1, step)).cast("long")) % F.lit(max(1, size))).cast("int")


def broadcast_tables(target: DataFrame, *others: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """The relational way: ``target`` has a row per cell and its coordinates as columns; each
    other table is given with the coordinates it has. One without any must be a single row.
    Spark chooses each join by the sides' sizes; a missing cell of the other table is null."""
    out = target
    for table, shared in others:
        missing = [c for c in shared if c not in target.columns]
        if missing:
            raise InvalidShapes(f"INVALID_SHAPES: the target has no dimension {missing}")
        if shared:
            out = out.join(table, list(shared), "left")
        else:
            rows = free_name(table.columns, "__n")
            single = table.agg(*[F.first(quoted(c)).alias(c) for c in table.columns], F.count("*").alias(rows))
            single = single.select(*[F.when(F.col(rows) == 1, quoted(c)).otherwise(F.raise_error(F.lit(f"{InvalidShapes.code}: a scalar table has one row"))).alias(c) for c in table.columns])
            out = out.crossJoin(F.broadcast(single))  # an aggregate without keys: one row
    return out
