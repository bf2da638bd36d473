"""Chunked arrays, views and stores against NumPy."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import arrays as nd
from tessera.operators import broadcast as bc
from tessera.operators import chunk as ch
from tessera.operators import grid as gr
from tessera.operators import view as vw
from tessera.plans.dims import Dimension
from tessera.sources import chunk_store as store


def chunks_of(spark, array, shape, key=None):
    rows = []
    for origin in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, shape)]):
        o = [i * c for i, c in zip(origin, shape)]
        part = array[tuple(slice(a, a + c) for a, c in zip(o, shape))]
        rows.append(([key] if key is not None else []) + o + list(part.shape) + [[None if x == -1 else int(x) for x in part.ravel()]])
    n = array.ndim
    return spark.createDataFrame(rows, ", ".join([*(["`k.x` string"] if key is not None else []), *[f"o{i} long" for i in range(n)], *[f"s{i} long" for i in range(n)], "values array<int>"]))


def array_of(rows, shape, value="values"):
    out = np.full(shape, -2)
    for r in rows:
        o, s = [r[f"o{i}"] for i in range(len(shape))], [r[f"s{i}"] for i in range(len(shape))]
        out[tuple(slice(a, a + n) for a, n in zip(o, s))] = np.array([-1 if x is None else x for x in r[value]]).reshape(s)
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes, old, new", [((7,), (3,), (2,)), ((10, 9), (4, 5), (3, 2)), ((10, 9), (3, 2), (10, 9)), ((5, 6, 7), (2, 6, 3), (3, 4, 2)), ((4, 4), (4, 4), (9, 9))])
def test_rechunk(spark, sizes, old, new):
    a = np.arange(np.prod(sizes)).reshape(sizes)
    a.ravel()[3] = -1
    moved = gr.rechunk(chunks_of(spark, a, old, "key"), sizes, new, ["k.x"]).collect()
    assert (array_of(moved, sizes) == a).all() and {r["k.x"] for r in moved} == {"key"}
    want = {r[1:-1] for r in map(tuple, chunks_of(spark, a, new, "key").collect())}
    assert {tuple(r)[1:-1] for r in moved} == want and len(moved) == len(want)


def test_rechunk_moves_slices(spark):
    a = np.arange(64 * 48).reshape(64, 48)
    moved = gr.rechunk(chunks_of(spark, a, (10, 12)), (64, 48), (16, 8))
    assert moved.count() == 24 and plan_of(moved).count("Exchange") == 1
    assert "explode(values" not in plan_of(moved)
    with pytest.raises(errors.ChunkShapeMismatch):
        gr.rechunk(moved, (64, 48), (16,))


@pytest.mark.parametrize("region", [((0, 10), (0, 9)), ((3, 8), (2, 7)), ((4, 5), (8, 9)), ((2, 2), (0, 9))])
def test_cut_region(spark, region):
    a = np.arange(90).reshape(10, 9)
    rows = gr.cut_region(chunks_of(spark, a, (4, 5)), region).collect()
    want = np.full((10, 9), -2)
    box = tuple(slice(*r) for r in region)
    want[box] = a[box]
    assert (array_of(rows, (10, 9)) == want).all()


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_reduce_chunks(spark, axis):
    a = np.arange(5 * 6 * 7).reshape(5, 6, 7)
    a[1, 2, :], a[:, 3, 4], a[0, :, 0] = -1, -1, -1
    rows = gr.reduce_chunks(chunks_of(spark, a, (2, 4, 3), "key"), 3, axis, ["k.x"]).collect()
    held = np.ma.masked_equal(a, -1)
    shape = tuple(n for d, n in enumerate(a.shape) if d != axis)
    assert (array_of(rows, shape, "n") == held.count(axis)).all()
    assert (array_of(rows, shape, "nulls") == a.shape[axis] - held.count(axis)).all()
    for name, want in (("sum", held.sum(axis)), ("least", held.min(axis)), ("most", held.max(axis))):
        assert (array_of(rows, shape, name) == want.filled(-1)).all()


def test_broadcast_chunks(spark):
    a, b, c = np.arange(90).reshape(10, 9), np.arange(100, 110), np.arange(18).reshape(9, 2)[:, 0]
    met = gr.broadcast_chunks(chunks_of(spark, a, (4, 5)), ["x", "y"], {"b": (chunks_of(spark, b, (4,)), ["x"]), "c": (chunks_of(spark, c, (5,)), ["y"]), "t": (chunks_of(spark, a.T.copy(), (5, 4)), ["y", "x"]), "one": (spark.sql("select array(7) as values"), [])})
    own = {"values": ["x", "y"], "b": ["x"], "c": ["y"], "t": ["y", "x"], "one": []}
    cells = gr.chunk_cells(met, ["x", "y"], own).collect()
    assert len(cells) == 90 and all((r["values"], r.b, r.c, r.t, r.one) == (a[r.x, r.y], b[r.x], c[r.y], a[r.x, r.y], 7) for r in cells)
    whole = gr.expand(met, ["x", "y"], {n: d for n, d in own.items() if n != "values"}).collect()
    assert (array_of(whole, (10, 9), "b") == b[:, None] + 0 * a).all() and (array_of(whole, (10, 9), "t") == a).all() and len(whole) == 6
    assert "explode" not in plan_of(met).lower()


def test_broadcast_chunks_of_other_grids(spark):
    a = chunks_of(spark, np.arange(20).reshape(4, 5), (2, 5))
    with pytest.raises(errors.InvalidShapes):
        gr.broadcast_chunks(a, ["x", "y"], {"b": (a, ["x", "z"])})
    with pytest.raises(PySparkException, match="CHUNK_SHAPE_MISMATCH"):
        gr.broadcast_chunks(a, ["x", "y"], {"b": (chunks_of(spark, np.arange(4), (4,)), ["x"])}).collect()
    lone = gr.broadcast_chunks(a, ["x", "y"], {"b": (chunks_of(spark, np.arange(2), (2,)), ["x"])}).collect()
    assert sorted((r.o0, r.b) for r in lone) == [(0, [0, 1]), (2, None)]


# Views


def dims(text):
    return [Dimension(p[0], int(p[1:])) for p in text.split()]


def array_column(name, values, own):
    return nd.nd_array(F.array(*map(F.lit, values)).cast("array<int>"), [d.name for d in own], [d.size for d in own]).alias(name)


@pytest.mark.parametrize("own, target", [("", "x2 y3"), ("x2", "x2 y3"), ("y3", "x2 y3 z4"), ("y3 z4", "x2 y3 z4"), ("x2 y3", "x2 y3"), ("", ""), ("x2", "e0 x2")])
@pytest.mark.parametrize("known", [True, False])
def test_views_have_the_cells_of_an_expansion(spark, own, target, known):
    own, target = dims(own), dims(target)
    n = int(np.prod([d.size for d in own]))
    df = spark.range(1).select(array_column("a", range(10, 10 + n), own))
    view = vw.nd_broadcast_view(F.col("a"), nd.literal_dimensions(target))
    rank = len(target) if known else None
    got = df.select(vw.view_array(view, rank).alias("v"), bc.nd_broadcast(F.col("a"), nd.literal_dimensions(target), "int").alias("w"), view.alias("held"))
    row = got.first()
    assert row.v == row.w and list(row.held["values"]) == list(range(10, 10 + n))
    cells = vw.view_table(got, {"held": rank}, coordinates=[d.name for d in target]).collect()
    want = np.array(row.w["values"]).reshape([d.size for d in target])
    assert len(cells) == want.size and all(r.held == want[tuple(r[d.name] for d in target)] for r in cells)
    assert "array_repeat" not in plan_of(got.select("held"))


def test_views_are_sliced_and_cut(spark):
    a = np.arange(60).reshape(3, 4, 5)
    df = spark.range(1).select(array_column("a", a.ravel().tolist(), dims("x3 y4 z5")), array_column("b", range(4), dims("y4")))
    part = df.select(vw.view_array(vw.slice_view(vw.nd_view(F.col("a")), [1, 1, 2], [2, 2, 3]), 3).alias("p"), vw.trim_view(vw.slice_view(vw.nd_view(F.col("a")), [1, 1, 2], [1, 2, 3])).alias("t")).first()
    assert part.p["values"] == a[1:3, 1:3, 2:5].ravel().tolist() and part.p["dimension_sizes"] == [2, 2, 3]
    assert part.t["values"] == a.ravel()[27:35].tolist() and part.t["offset"] == 0
    view = vw.nd_broadcast_view(F.col("b"), nd.nd_dimensions(F.col("a")))
    cut = df.select(F.explode(vw.view_chunks(view, [2, 3, 5])).alias("c")).select("c.chunk_ordinal", "c.chunk_indices", vw.view_array(F.col("c.view")).alias("v"), F.size("c.view.values").alias("held"), F.col("c.view").alias("w")).collect()
    whole = np.broadcast_to(np.arange(4)[None, :, None], (3, 4, 5))
    assert [r.chunk_ordinal for r in cut] == [0, 1, 2, 3] and [r.held for r in cut] == [3, 1, 3, 1]
    for r in cut:
        box = tuple(slice(o, o + c) for o, c in zip(r.chunk_indices, (2, 3, 5)))
        assert r.v["values"] == whole[box].ravel().tolist() and r.v["dimension_sizes"] == list(whole[box].shape)


def test_views_that_are_null_or_wrong(spark):
    df = spark.range(1).select(array_column("a", [1, 2], dims("x2")), nd.nd_null("int").alias("none"), nd.nd_array(F.array(F.lit(None).cast("int"), F.lit(3)), ["x"], [2]).alias("holes"))
    target = nd.literal_dimensions(dims("x2 y2"))
    views = df.select(*[vw.nd_broadcast_view(F.col(c), target).alias(c) for c in ("a", "none", "holes")])
    assert sorted(map(tuple, vw.view_table(views, ["a", "none", "holes"], coordinates=["x", "y"]).collect())) == [(0, 0, 1, None, None), (0, 1, 1, None, None), (1, 0, 2, None, 3), (1, 1, 2, None, 3)]
    assert views.first().none is None
    with pytest.raises(PySparkException, match="INVALID_SHAPES"):
        df.select(vw.nd_broadcast_view(F.col("a"), nd.literal_dimensions(dims("x3")))).collect()
    with pytest.raises(PySparkException, match="CHUNK_SHAPE_MISMATCH"):
        views.select(vw.view_chunks(F.col("a"), [2])).collect()


# Stores


def scan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan


@pytest.fixture()
def stored(spark, tmp_path):
    """48 x 40 chunks of 4 x 10 cells, in row groups of a few chunks."""
    a = np.arange(192 * 400).reshape(192, 400)
    lines = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "x long, v array<int>")
    sizes = store.measure(lines.select("x", (F.size("v") - 1).alias("y")), ["x", "y"])
    assert sizes == (Dimension("x", 192), Dimension("y", 400))
    grid = store.Grid(sizes, (4, 10))
    store.write_store(ch.chunk_rows(lines, ["x"], [192, 400], (4, 10), "v"), f"{tmp_path}/s", grid, group_bytes=1 << 12)
    return a, f"{tmp_path}/s"


def test_store_round_trip(spark, stored):
    a, path = stored
    chunks, grid = store.open_store(spark, path)
    assert grid == store.Grid((Dimension("x", 192), Dimension("y", 400)), (4, 10)) and gr.grid_of(grid.dims, grid.chunk_shape) == chunks.count() == 1920
    assert (array_of(chunks.collect(), a.shape) == a).all()


def test_region_reads_few_row_groups(spark, stored):
    a, path = stored
    for region in ({"x": (30, 50), "y": (95, 131)}, {"x": (0, 1)}, {"y": (399, 900)}, {"x": (-5, 3), "y": (7, 8)}, {"x": (9, 9)}, {}):
        part = store.read_region(spark, path, region)
        box = tuple(slice(max(0, region.get(d, (0, n))[0]), min(n, region.get(d, (0, n))[1])) for d, n in (("x", 192), ("y", 400)))
        want = np.full(a.shape, -2)
        want[box] = a[box]
        assert (array_of(part.collect(), a.shape) == want).all()
    few = store.read_region(spark, path, {"x": (30, 34), "y": (95, 131)})
    pushed = scan(few).metadata().apply("PushedFilters")
    assert all(x in pushed for x in ("GreaterThanOrEqual(o0,28)", "LessThan(o0,34)", "GreaterThanOrEqual(o1,90)", "LessThan(o1,131)"))
    assert scan(few).metrics().apply("numOutputRows").value() < 1920 / 8  # rows left when row groups and pages are skipped
    with pytest.raises(errors.InvalidShapes):
        store.read_region(spark, path, {"z": (0, 1)})
    with pytest.raises(errors.ChunkShapeMismatch):
        spark.range(3).write.parquet(path + "x")
        store.open_store(spark, path + "x")


def test_filters_inferred_from_what_follows_do_no_harm(spark, stored):
    """Exploding a region's values makes Spark ask for the values of chunks outside it, too."""
    a, path = stored
    cells = ch.unchunk(store.read_region(spark, path, {"x": (101, 103), "y": (395, 399)}), ["x", "y"], "v").collect()
    assert sorted(map(tuple, cells)) == [(x, y, int(a[x, y])) for x in (101, 102) for y in range(395, 399)]


def test_plans_from_tables(spark):
    empty = store.measure(spark.createDataFrame([], "a long, `b.c` long"), ["a", "b.c"])
    assert empty == (Dimension("a", 0), Dimension("b.c", 0))
    with pytest.raises(errors.InvalidShapes):
        store.measure(spark.createDataFrame([(-1,)], "a long"), ["a"])
    profiles, levels = Dimension("N_PROF", 44452), Dimension("N_LEVELS", 3660)
    plans = store.plan_grids({"t": [profiles, levels], "p": [profiles]}, 128 * 1024)
    assert plans["t"].chunk_shape == (1261, 103) and plans["p"].chunk_shape == (1261,)
    assert json.loads(json.dumps(plans["t"].dims)) == [["N_PROF", 44452], ["N_LEVELS", 3660]]


# Slabs


def shuffled(df):
    """Bytes of the rows that exchanges took, of a plan that has run."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            p = p.executedPlan()
            name = p.nodeName()
        if "QueryStage" in name:
            p = p.plan()
            name = p.nodeName()
        if name == "Exchange":
            total += p.metrics().apply("dataSize").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert total > 0
    return total


@pytest.mark.parametrize("static", [True, False])
def test_slabs_move_an_array_once(spark, monkeypatch, static):
    """A 445 x 366 array with a vector along each dimension, in 17 slabs."""
    own = {"a": [("x", 445), ("y", 366)], "b": [("x", 445)], "c": [("y", 366)], "d": []}
    n = 445 * 366
    ramp = lambda k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i.cast("double"))
    rows = spark.range(1).select(F.lit("k").alias("k.x"), *[nd.nd_array(ramp(int(np.prod([s for _, s in d]))), [x for x, _ in d], [s for _, s in d]).alias(c) for c, d in own.items()])
    whole = bc.broadcast_to_table(rows, list(own), own, keep=["k.x"])
    monkeypatch.setattr(bc, "PACKED_CELLS", n // 16)
    assert bc.largest_target(rows, list(own)) == n
    cut = bc.broadcast_to_table(rows, list(own), own, keep=["k.x"], coordinates=["at", "x", "y"]) if static else bc.broadcast_to_table(rows, list(own), keep=["k.x"], spread=True)
    plan = plan_of(cut)
    assert plan.index("Exchange") < plan.rindex("slice(")  # the slice is below the exchange
    assert whole.exceptAll(cut.select(*[f"`{c}`" for c in whole.columns])).count() == 0 and cut.count() == n
    assert cut.where("d <> 0").count() == 0
    cut.collect()
    assert shuffled(cut) <= 1.2 * 8 * (n + 445 + 17 * 366 + 17)
    if static:
        assert cut.where("a <> at or b <> x or c <> y").count() == 0


def test_slabs_of_a_row_stay_bounded_without_spread(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0] * 12, [2.0] * 3), (2, [3.0] * 4, [4.0])], "i int, a array<double>, b array<double>").select("i", nd.nd_array(F.col("a"), ["x", "y"], [F.expr("cast(size(a) / size(b) as bigint)"), F.size("b")]).alias("a"), nd.nd_array(F.col("b"), ["y"], [F.size("b")]).alias("b"))
    want = sorted(map(tuple, bc.broadcast_to_table(rows, ["a", "b"], keep=["i"]).collect()))
    monkeypatch.setattr(bc, "PACKED_CELLS", 5)
    for spread in (False, True):
        assert sorted(map(tuple, bc.broadcast_to_table(rows, ["a", "b"], keep=["i"], spread=spread).collect())) == want
    assert bc.largest_target(rows, ["a", "b"]) == 12
