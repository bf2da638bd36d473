"""Shapes of tables, routing, Arrow files and arriving parts."""

import json
import random

import pyarrow as pa
import pyarrow.ipc
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import arrays as nd
from tessera.operators import shapes as sh
from tessera.plans import dims as plan
from tessera.plans.dims import Dimension
from tessera.sources import arrow_files as af
from tessera.sources import routing
from tessera.streaming import chunks as streaming
from tessera.streaming import parts as arriving

ARRAY = "struct<dimension_names array<string>, dimension_sizes array<bigint>, values array<double>>"


def dims(text):
    return tuple(Dimension(p[0], int(p[1:])) for p in text.split())


def row_of(text):
    d = dims(text)
    return {"dimension_names": [x.name for x in d], "dimension_sizes": [x.size for x in d], "values": [1.0] * plan.flat_size(d)}


SHAPES = ["", "x2", "y3", "x3", "x2 y3", "y3 x2", "x2 y3 z4", "y3 z4", "e0", "e0 x2"]


def test_shapes_compare_as_the_planner_has_it(spark):
    rows = spark.createDataFrame([(a, b, row_of(a), row_of(b)) for a in SHAPES for b in SHAPES], f"s string, t string, a {ARRAY}, b {ARRAY}")
    a, b = nd.nd_dimensions(F.col("a")), nd.nd_dimensions(F.col("b"))
    for r in rows.select("s", "t", sh.compare_dims(a, b).alias("c"), sh.single_repeats_of(a, b).alias("r")).collect():
        assert r.c == plan.compare(dims(r.s), dims(r.t)), (r.s, r.t)
        want = plan.single_repeats(dims(r.s), dims(r.t))
        assert (r.r and tuple(r.r)) == (want and tuple(want)), (r.s, r.t)


def target_rows(df):
    text = lambda d: None if d is None else " ".join(f"{x.name}{x.size}" for x in d)
    return {r[0]: (text(r.target), r.shapes, r.arrays, text(r.offending)) for r in df.collect()}


def test_one_target_for_a_table(spark):
    given = [("fits", "x2 y3 z4", "y3"), ("fits", "y3 z4", ""), ("fits", "x2 y3 z4", None), ("not", "x2 y3", "y3 x2"), ("not", "x2", "y3"), ("none", None, None), (None, "x2", "x2")]
    rows = spark.createDataFrame([(k, a and row_of(a), None if b is None else row_of(b)) for k, a, b in given], f"`k.x` string, a {ARRAY}, b {ARRAY}")
    got = target_rows(sh.common_target(rows, ["a", "b"], ["k.x"]).where("`k.x` is not null"))
    assert got == {"fits": ("x2 y3 z4", 4, 5, None), "not": ("y3 x2", 4, 4, "x2 y3")}
    whole = sh.common_target(rows.where("`k.x` = 'fits'"), ["a", "b"]).collect()
    assert len(whole) == 1 and whole[0].arrays == 5 and whole[0].offending is None
    nothing = sh.common_target(rows.limit(0), ["a"]).collect()
    assert len(nothing) == 1 and nothing[0].target is None
    with pytest.raises(errors.StructExpected):
        sh.common_target(rows, ["k.x"])


# Routing


def test_rows_are_routed(spark, tmp_path):
    bad = {"dimension_names": ["x", None], "dimension_sizes": [1, 1], "values": [1.0]}
    short = {"dimension_names": ["x"], "dimension_sizes": [2], "values": [1.0]}
    negative = {"dimension_names": ["x", "y"], "dimension_sizes": [1, -1], "values": []}
    lone = {"dimension_names": ["x"], "dimension_sizes": [1, 1], "values": [1.0]}
    rows = [(1, row_of("x2"), None), (2, bad, short), (3, row_of(""), short), (4, negative, None), (5, lone, row_of("x2")), (6, None, None)]
    df = spark.createDataFrame(rows, f"`i.d` int, a {ARRAY}, `b c` {ARRAY}").withColumnRenamed("b c", "valid")
    good, rejected = routing.route(df, f"{tmp_path}/r", ["a", "valid"])
    assert sorted(r["i.d"] for r in good.collect()) == [1, 6] and good.columns == df.columns
    assert nd.decode_batches(good, ["a", "valid"]).count() == 2
    assert sorted((r["i.d"], r.wrong_column, r.error_code, r.wrong_dimension) for r in rejected.collect()) == [(2, "a", "NULL_DIMENSION", 1), (3, "valid", "SHAPE_AND_LENGTH_MISMATCH", None), (4, "a", "SHAPE_AND_LENGTH_MISMATCH", 1), (5, "a", "DIMENSION_SIZE_MISMATCH", 1)]
    assert rejected.columns == [*df.columns, routing.WHERE, routing.CODE, routing.DIMENSION]
    plan_text = rejected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan_text and "valid" in plan_text.split("PartitionFilters")[1][:80]
    none, all_wrong = routing.route(df.where("`i.d` = 2"), f"{tmp_path}/s", ["a"])
    assert none.count() == 0 and all_wrong.count() == 1
    with pytest.raises(ValueError):
        routing.checked(df.withColumn("Error_Code", F.lit(1)), ["a"])


# Arrow files


@pytest.fixture()
def written(spark, tmp_path):
    e = spark.range(1000).select((F.col("id") % 50).alias("k"), "id", (F.col("id") * 1.5).alias("v"))
    b = nd.nd_from_table(e, ["k"], ["id"], ["id", "v"], "event").select(nd.nd_scalar(F.col("k")).alias("k.x"), "id", "v")
    path = f"{tmp_path}/arrow"
    af.write_arrow(b.repartition(3), path)
    return b, path


def values(df):
    return sorted(map(str, df.collect()))


def test_arrow_files_round_trip(spark, written):
    b, path = written
    back = af.read_arrow(spark, path)
    assert values(back) == values(b) and back.columns == b.columns
    assert values(af.read_arrow(spark, path, ["v"])) == values(b.select("v"))
    parts = [af.read_arrow(spark, path, ["k.x"], rows=r) for r in ((0, 20), (20, 50), (50, 99), (7, 7))]
    assert [p.count() for p in parts] == [20, 30, 0, 0]
    assert values(parts[0].union(parts[1])) == values(b.select("`k.x`"))
    file = next(p for p in __import__("pathlib").Path(path).glob("*.arrow"))
    there = pa.ipc.open_file(str(file)).schema
    assert there.field("id").type.field("dimension_sizes").type.value_type == pa.uint32() and there.metadata == {b"nd-array-schema": b"0.1.0"}


def test_arrow_commits(spark, written):
    b, path = written
    af.write_arrow(b, path)
    assert af.read_arrow(spark, path).count() == 100
    af.write_arrow(b.limit(1), path, mode="overwrite")
    assert af.read_arrow(spark, path).count() == 1
    __import__("pathlib").Path(path, "half-written.arrow").write_bytes(b"torn")
    assert af.read_arrow(spark, path).count() == 1
    with pytest.raises(errors.MissingEncodingMetadata):
        af.read_arrow(spark, path, key="another")
    assert af.read_arrow(spark, path, key="another", need_metadata=False).count() == 1


def test_arrow_files_of_other_producers(spark, tmp_path):
    kind = pa.struct([("dimension_names", pa.list_(pa.string())), ("dimension_sizes", pa.list_(pa.uint32())), ("values", pa.list_(pa.uint16()))])
    for i in range(2):
        batch = pa.record_batch([pa.array([{"dimension_names": ["x"], "dimension_sizes": [2], "values": [i, 65535]}, None], kind)], names=["a"])
        with pa.ipc.new_file(f"{tmp_path}/{i}.arrow", batch.schema) as f:
            f.write_batch(batch)
            f.write_batch(batch)
    got = af.read_arrow(spark, str(tmp_path), need_metadata=False)
    assert got.schema["a"].dataType.simpleString().endswith("values:array<int>>") and got.count() == 8
    assert sorted(r.a["values"] for r in got.where("a is not null").collect()) == [[0, 65535]] * 2 + [[1, 65535]] * 2
    assert af.read_arrow(spark, str(tmp_path), rows=(3, 5), need_metadata=False).count() == 2


def test_arrow_sizes_are_checked(spark, tmp_path):
    huge = spark.createDataFrame([({"dimension_names": ["x", "y"], "dimension_sizes": [2**33, 0], "values": []},)], f"a {ARRAY}")
    with pytest.raises(PySparkException, match="SIZE_OUT_OF_RANGE"):
        af.write_arrow(huge, f"{tmp_path}/a")


# Arriving parts


def streamed(spark, folder, steps, **how):
    """Each step's lines (key, part, of, second, cells) as a file of its own, in order."""
    schema = "key string, part int, of int, time timestamp, cells array<int>"
    for i, lines in enumerate(steps):
        df = spark.createDataFrame([(k, p, n, t, c) for k, p, n, t, c in lines], "key string, part int, of int, t long, cells array<int>")
        df.select("key", "part", "of", F.timestamp_seconds(F.col("t") + 1_000_000).alias("time"), "cells").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        out = arriving.assemble(stream, ["key"], "part", "of", "time", "cells", **how)
        streaming.write_available(out, f"{folder}/out", f"{folder}/state").awaitTermination()
        got = spark.read.schema(out.schema).parquet(f"{folder}/out")
        yield sorted((r.key, r.complete, list(r.parts), list(r["values"])) for r in got.collect())


def test_parts_make_arrays(spark, tmp_path):
    steps = [
        [("a", 1, 2, 0, [3, 4]), ("b", 0, 3, 0, [1]), ("c", 0, 1, 0, [None])],
        [("a", 0, 2, 5, [1, 2]), ("b", 2, 3, 10, [3]), ("b", 2, 3, 10, [9]), ("c", 0, 1, 6, [7])],
        [("d", 0, 1, 1000, [5])],  # the watermark passes b
        [("b", 1, 3, 20, [2]), ("d", 0, 1, 1001, [5])],  # b's last part is late
    ]
    got = list(streamed(spark, tmp_path, steps, patience="100 seconds", delay="50 seconds"))
    a, c, d = ("a", True, [0, 1], [1, 2, 3, 4]), ("c", True, [0], [None]), ("d", True, [0], [5])
    assert got[0] == [c] and got[1] == [a, c]
    assert got[3] == [a, ("b", False, [0, 2], [1, 3]), c, d]


def test_any_order_of_parts_gives_the_batch_answer(spark, tmp_path):
    rng = random.Random(3)
    lines = [(f"k{k}", p, 4, k, [10 * k + p]) for k in range(5) for p in range(4)]
    rng.shuffle(lines)
    lines += lines[:6]
    *_, got = streamed(spark, tmp_path, [lines[:9], lines[9:17], lines[17:]], patience="1 day", delay="1 day")
    assert got == [(f"k{k}", True, [0, 1, 2, 3], [10 * k + p for p in range(4)]) for k in range(5)]
    assert json.dumps(got)


# Batches of a hot key


def test_a_hot_key_is_ranked_in_ranges(spark, tmp_path):
    """Half of the rows have one key; ties, nulls and odd names."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(400) or None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "`k.x` string, `__n` int, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = nd.ranked(df, ["k.x"], ["__n", "v"], f"{tmp_path}/r", "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in ("hot", "a", "b", None):
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] or 0, r[2]))):
            want[r] = i
    assert {tuple(r)[:3]: r["rank"] for r in got.collect()} == want
    assert len({p.name for p in (tmp_path / "r").glob("part-*")}) > 1
    cut = nd.nd_from_table(df, ["k.x"], ["__n", "v"], ["v"], "i", max_cells=70, folder=f"{tmp_path}/s")
    whole = nd.nd_from_table(df, ["k.x"], ["__n", "v"], ["v"], "i", max_cells=70)
    assert values(cut) == values(whole) and max(len(r.v["values"]) for r in cut.collect()) == 70
