"""Arrays against a plain row-major model, and the engine's error surface."""

import datetime
import itertools
import math

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import errors
from tessera.functions import arrays as nd
from tessera.functions import schema as nds
from tessera.operators import broadcast as bc
from tessera.operators import chunk as ch
from tessera.plans import dims as plan
from tessera.plans.dims import Dimension
from tessera.sources import arrow as src
from tessera.streaming import chunks as streaming


def dims(text):
    return tuple(Dimension(p[0], int(p[1:])) for p in text.split())


def model_broadcast(values, own, target):
    """Cells of the target by coordinates; None if ``own`` doesn't lie in it."""
    if own == target:
        at = 0
    else:
        at = 0 if not own else next((i for i in range(len(target) - len(own) + 1) if target[i : i + len(own)] == own), None)
    if at is None or len(own) > len(target):
        return None
    out = []
    for where in itertools.product(*(range(d.size) for d in target)):
        k = 0
        for d, i in zip(own, where[at : at + len(own)]):
            k = k * d.size + i
        out.append(values[k])
    return out


def model_chunks(values, sizes, shape):
    steps = plan.strides(sizes)
    out = []
    for origin in itertools.product(*(range(0, s, c) for s, c in zip(sizes, shape))):
        extent = [min(c, s - o) for c, s, o in zip(shape, sizes, origin)]
        cells = [values[sum((o + i) * k for o, i, k in zip(origin, at, steps))] for at in itertools.product(*map(range, extent))]
        out.append((list(origin), extent, cells))
    return out


def array_row(values, own):
    return {"dimension_names": [d.name for d in own], "dimension_sizes": [d.size for d in own], "values": values}


def table(spark, rows, columns, kind="int"):
    t = "struct<dimension_names array<string>, dimension_sizes array<bigint>, values array<%s>>"
    kinds = kind if isinstance(kind, (list, tuple)) else [kind] * len(columns)
    return spark.createDataFrame(rows, ", ".join(f"{c} {t % k}" for c, k in zip(columns, kinds)))


# Planner


COMPARED = [("", "", 0), ("", "x2", -1), ("x2", "", 1), ("x2", "x2 y3", -1), ("x2 y3", "y3", 1), ("x2 y3", "x2 y3 z4", None), ("x2", "y3", None), ("x2", "x3 y3", None), ("x2 y3", "y3 x2", None)]
TARGETS = [("", "", "", ""), ("x2", "", "y3", "x2"), ("x2", "x2 y3", "", "x2 y3"), ("x2 y3", "y3 z4", "x2", "x2 y3"), ("", "x2", "x2 y3 z4", "x2 y3 z4")]
RESHAPES = [("", "", 1, 1), ("", "x2 y3", 1, 6), ("x2", "x2 y3", 1, 3), ("y3", "x2 y3", 2, 1), ("y3", "x2 y3 z4", 2, 4), ("x2 y3", "x2 y3 z4", 1, 4), ("y3 z4", "x2 y3 z4", 2, 1), ("x2 z4", "x2 y3 z4", None, None), ("y3 x2", "x2 y3", None, None), ("y2", "x2 y3", None, None), ("x2 y3", "x2", None, None), ("x2", "y3", None, None), ("x2", "e0 x2", 0, 1), ("", "e0", 1, 0), ("x2", "x2", 1, 1), ("e0", "e0 x2", 1, 2), ("x2", "x2 y3 x2", 1, 6)]
AUTO = [(131072, (44452, 3660)), (131072, (1_000_000, 2)), (4096, (100_000, 3, 3, 3)), (4096, (50, 40)), (4096, (4096, 4096, 4096)), (1000, (7,)), (1000, (99_999,))]


def test_reshape_cases():
    for a, b, whole, each in RESHAPES:
        found = plan.repeats(dims(a), dims(b))
        assert (found is None) if whole is None else tuple(found) == (whole, each)
    for a, b, c, best in TARGETS:
        assert plan.broadcast_target([dims(a), dims(b), dims(c)]) == dims(best)
    for a, b, relation in COMPARED:
        assert plan.compare(dims(a), dims(b)) == relation


def test_rows_choose_targets_and_repeats_as_the_planner_does(spark):
    def array(c):
        parts = F.filter(F.split(c, " "), lambda p: p != "")
        return F.struct(F.transform(parts, lambda p: p.substr(1, 1)).alias("dimension_names"), F.transform(parts, lambda p: p.substr(2, 9).cast("long")).alias("dimension_sizes"), F.array(F.lit(1)).alias("values"))

    rows = spark.createDataFrame(TARGETS, "a string, b string, c string, best string")
    for r in rows.select("best", bc.target_of([array(c) for c in "abc"]).alias("t")).collect():
        assert [tuple(d) for d in r.t] == list(map(tuple, dims(r.best)))
    rows = spark.createDataFrame(RESHAPES, "source string, target string, whole long, each long")
    for r in rows.select("whole", "each", bc.repeats_of(nd.nd_dimensions(array("source")), nd.nd_dimensions(array("target"))).alias("r")).collect():
        assert (r.r is None) if r.whole is None else tuple(r.r) == (r.whole, r.each)


@pytest.mark.parametrize("target, sizes", AUTO)
def test_planned_chunks_against_sql(target, sizes):
    import duckdb

    rows = ", ".join(f"({i}, {n})" for i, n in enumerate(sizes))
    want = duckdb.sql(f"""with p as (select *, size::double / greatest(1, max(size) over ()) as ratio from (values {rows}) t(i, size)),
    s as (select power({target} / product(ratio), 1.0::double / count(*)) as scale from p),
    c as (select i, size, greatest(1, least(floor(ratio * scale), size)) as once, greatest(1, least(floor(ratio * scale * 2), size)) as twice from p, s),
    t as (select product(once) as p1, product(twice) as p2 from c)
    select (case when p1 >= {target} // 2 then once when p2 >= {target} // 2 then twice else size end)::bigint from c, t order by i""").fetchall()
    found = plan.aligned_chunks([plan.dimensions([(f"d{i}", n) for i, n in enumerate(sizes)])], target)[0]
    assert [d.size for d in found] == [r[0] for r in want]


def test_repeats_of_single_dimensions():
    assert plan.single_repeats(dims("y3"), dims("x2 y3 z4")) == (2, 4)
    assert plan.single_repeats(dims(""), dims("x2 y3")) == (1, 6)
    assert plan.single_repeats(dims("x2 y3"), dims("x2 y3 z4")) is None


def test_chunk_sizes():
    profile = [dims_ for dims_ in ([Dimension("N_PROF", 44452), Dimension("N_LEVELS", 3660)], [Dimension("N_PROF", 44452)])]
    assert plan.aligned_chunks(profile, 131072) == [(("N_PROF", 1261), ("N_LEVELS", 103)), (("N_PROF", 1261),)]
    assert plan.aligned_chunks([[Dimension("a", 1_000_000), Dimension("b", 2)]], 131072) == [(("a", 256_000), ("b", 1))]
    assert plan.aligned_chunks([[("a", 100_000), ("b", 3), ("c", 3), ("d", 3)]], 4096) == [(("a", 19735), ("b", 1), ("c", 1), ("d", 1))]
    assert plan.aligned_chunks([[]], 100) == [()]
    assert plan.aligned_chunks([[("a", 0)]], 100) == [(("a", 1),)]
    assert plan.aligned_chunks([[("a", 50)], [("a", 4000), ("b", 10)]], 100)[0] == (("a", 50),)


def test_no_columns_have_no_target():
    with pytest.raises(errors.NoBroadcastShape):
        plan.broadcast_target([])
    with pytest.raises(errors.NoBroadcastShape):
        bc.target_of([])


# Constructors, accessors, validation


def test_constructors_of_each_type(spark):
    made = {
        "boolean": F.array(F.lit(True), F.lit(None)), "tinyint": F.array(F.lit(1).cast("tinyint"), F.lit(None)), "smallint": F.array(F.lit(1).cast("smallint"), F.lit(2).cast("smallint")),
        "int": F.array(F.lit(1), F.lit(2)), "bigint": F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), "float": F.array(F.lit(1.5).cast("float"), F.lit(2).cast("float")),
        "double": F.array(F.lit(1.5), F.lit(float("nan"))), "string": F.array(F.lit("a"), F.lit("é")), "binary": F.array(F.lit(b"a"), F.lit(b"\x00")),
        "timestamp": F.array(F.lit(datetime.datetime(2020, 1, 1)).cast("timestamp"), F.lit(None)), "timestamp_ntz": F.array(F.lit("2020-01-01").cast("timestamp_ntz"), F.lit(None)),
        "decimal(20,0)": F.array(F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(None)),
    }
    for kind, values in made.items():
        df = spark.range(1).select(nd.nd_array(values, ["x"], [2]).alias("a"), nd.nd_array(F.sequence(F.lit(1), F.lit(6)), ["x", "y"], [2, 3]).alias("b"))
        assert nds.element_type(df, "a").simpleString() == kind
        nds.nd_type(nds.element_type(df, "a"), strict=True)
        got = [r.a for r in bc.broadcast_to_table(df).collect()]
        plain = df.select("a.values").first()[0]
        assert repr(got) == repr([plain[i // 3] for i in range(6)])
        pieces = ch.chunk_batches(df, "a", (1,)).orderBy("chunk_ordinal").collect()
        assert repr([p["values"][0] for p in pieces]) == repr(plain)
    null = spark.range(1).select(nd.nd_scalar(F.lit(None)).alias("a"), nd.nd_array(F.array(F.lit(1), F.lit(2)), ["x"], [2]).alias("b"))
    assert [r.a for r in bc.broadcast_to_table(null).collect()] == [None, None]
    for kind in ("date", "array<int>", "map<string,int>", "struct<a:int>", "decimal(5,2)"):
        with pytest.raises(errors.UnsupportedType):
            nds.check_element_type(spark.range(1).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType)


def test_scalars_and_accessors(spark):
    df = spark.range(1).select(nd.nd_scalar(F.lit(42)).alias("a"), nd.nd_null("int").alias("n"), nd.nd_array(F.lit(None).cast("array<int>"), ["x"], [1]).alias("m"), nd.nd_array(F.array(*map(F.lit, [1, 2, 3, 4])), ["x", "y"], [2, 2]).alias("b"))
    r = df.select(nd.nd_shape(F.col("a")), nd.nd_rank(F.col("a")), nd.nd_is_scalar(F.col("a")), nd.nd_flat_size(F.col("a")), nd.nd_is_null(F.col("n")), nd.nd_is_null(F.col("m")), nd.nd_shape(F.col("b")), nd.nd_names(F.col("b")), nd.nd_values(F.col("b")), nd.nd_flat_size(F.col("b"))).first()
    assert tuple(r) == ([], 0, True, 1, True, True, [2, 2], ["x", "y"], [1, 2, 3, 4], 4)
    assert [tuple(d) for d in df.select(nd.nd_dimensions(F.col("b"))).first()[0]] == [("x", 2), ("y", 2)]
    assert nds.nd_columns(df) == ["a", "n", "m", "b"]


def test_timestamps_of_each_unit(spark):
    at = datetime.datetime(2021, 3, 4, 5, 6, 7)
    base = int(at.replace(tzinfo=datetime.timezone.utc).timestamp())
    for unit, factor in (("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)):
        df = spark.range(1).select(nd.nd_scalar_timestamp(F.lit(base * factor), unit).alias("a"), nd.nd_timestamps(F.array(F.lit(base * factor), F.lit(None).cast("long")), unit, ["x"], [2]).alias("b"))
        assert df.select("a.values").first()[0] == [at] and df.select("b.values").first()[0] == [at, None]
        assert nds.element_type(df, "a") == T.TimestampNTZType()


def test_wrong_lengths_fail(spark):
    with pytest.raises(PySparkException, match="SHAPE_AND_LENGTH_MISMATCH"):
        spark.range(1).select(nd.nd_array(F.array(F.lit(1), F.lit(2)), ["x", "y"], [2, 2])).collect()
    with pytest.raises(PySparkException, match="DIMENSION_SIZE_MISMATCH"):
        spark.range(1).select(nd.nd_array(F.array(F.lit(1), F.lit(2)), ["x"], [2, 1])).collect()


def test_types_are_checked_before_running(spark):
    good = nds.nd_type("int")
    for field, error in (("dimension_names", errors.NoDimensionNames), ("dimension_sizes", errors.NoDimensionSizes), ("values", errors.NoValues)):
        with pytest.raises(error):
            nds.check_nd(T.StructType([f for f in good.fields if f.name != field]))
        with pytest.raises(errors.ListExpected):
            nds.check_nd(T.StructType([T.StructField(f.name, T.IntegerType()) if f.name == field else f for f in good.fields]))
    with pytest.raises(errors.StructExpected):
        nds.check_nd(T.IntegerType())
    assert not nds.is_nd(T.StringType()) and nds.is_nd(good)


# Schemas, metadata, encode and decode


def test_schema_round_trip():
    plain = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType(), True)])
    there = nds.to_nd_schema(plain)
    assert nds.to_plain_schema(there) == plain
    assert not there["a"].nullable and not there["a"].dataType["values"].dataType.containsNull
    mixed = T.StructType([*there.fields, T.StructField("c", T.IntegerType())])
    assert nds.to_plain_schema(mixed) == plain
    with pytest.raises(errors.StructExpected):
        nds.to_plain_schema(mixed, strict=True)


def test_metadata_and_round_trip(spark, tmp_path):
    own = dims("x2 y2")
    df = table(spark, [(array_row([1, 2, 3, 4], own), array_row([1.1, 2.2, 3.3, 4.4], own)), (None, array_row([5.0], ()))], ["a", "b"], ["int", "double"])
    with pytest.raises(errors.MissingEncodingMetadata):
        nd.decode_batches(df)
    encoded = nd.encode_batches(df)
    assert encoded.schema["a"].metadata[nds.METADATA_KEY]
    src.write_parquet(df, f"{tmp_path}/p")
    back = src.read_parquet(spark, f"{tmp_path}/p")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    narrow = src.read_parquet(spark, f"{tmp_path}/p", validate=False).select("a.values")
    assert "ReadSchema: struct<a:struct<values:array<int>>>" in narrow._jdf.queryExecution().executedPlan().toString()
    future = encoded.withMetadata("a", {"nd-array-schema": "?"})
    with pytest.raises(errors.UnsupportedEncodingVersion):
        nd.decode_batches(future)
    other = df.select(F.col("a").alias("a")).withMetadata("a", {"another-producers-key": "0.4.2"})
    with pytest.raises(errors.MissingEncodingMetadata):
        nd.decode_batches(other)
    assert nd.decode_batches(other, key="another-producers-key").count() == 2
    assert nd.decode_batches(df, need_metadata=False).count() == 2


def test_large_targets_are_cut_into_slabs(spark, monkeypatch):
    monkeypatch.setattr(bc, "PACKED_CELLS", 7)
    df = table(spark, [(array_row(list(range(12)), dims("x4 y3")), array_row([5, 6, 7], dims("y3")), array_row([9], ()), None), (array_row(list(range(100, 112)), dims("x4 y3")), array_row([1, None, 3], dims("y3")), array_row([8], ()), None)], ["a", "b", "c", "d"])
    shapes = {"a": dims("x4 y3"), "b": dims("y3"), "c": (), "d": dims("x4")}
    rows = bc.broadcast_to_table(df, list("abcd"), shapes, coordinates=["at", "x", "y"])
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted((i, i // 3, i % 3, base + i, b[i % 3], c, None) for base, b, c in ((0, [5, 6, 7], 9), (100, [1, None, 3], 8)) for i in range(12))


def test_columns_named_like_our_own(spark):
    df = table(spark, [(array_row([1, 2], dims("x2")), array_row([3], ()))], ["__pos", "__target"]).withColumn("__cells", F.lit("k")).withColumn("__each_0", F.lit(1))
    for given in (None, {"__pos": dims("x2"), "__target": ()}):
        got = bc.broadcast_to_table(df, ["__pos", "__target"], given, keep=["__cells", "__each_0"]).collect()
        assert sorted(tuple(r) for r in got) == [("k", 1, 1, 3), ("k", 1, 2, 3)]


def test_moments_before_the_epoch(spark):
    got = spark.range(1).select(*[nd.timestamp_of(F.lit(v).cast("long"), u).alias(f"{u}{i}") for i, (v, u) in enumerate([(-1, "ns"), (-1_000, "ns"), (1_700_000_000_123_456_789, "ns"), (-1, "us")])]).first()
    assert [x.isoformat() for x in got] == ["1969-12-31T23:59:59.999999", "1969-12-31T23:59:59.999999", "2023-11-14T22:13:20.123456", "1969-12-31T23:59:59.999999"]


def test_arrow_tables_carry_the_readers_key(spark):
    df = table(spark, [(array_row([1, 2], dims("x2")),)], ["a"])
    out = src.to_arrow(df, key="their-key")
    assert list(out.schema.metadata) == [b"their-key"]
    assert src.from_arrow(spark, out, key="their-key").count() == 1
    with pytest.raises(errors.MissingEncodingMetadata):
        src.from_arrow(spark, out)


def test_arrow_tables_in_and_out(spark):
    own = dims("x2")
    df = table(spark, [(array_row([1, None], own),), (array_row([7], ()),), (None,)], ["a"])
    out = src.to_arrow(df)
    assert out.schema.field("a").type.field("dimension_sizes").type == pa.list_(pa.uint32())
    assert [tuple(r) for r in src.from_arrow(spark, out).collect()] == [tuple(r) for r in df.collect()]
    foreign = pa.table({"u": pa.array([{"dimension_names": ["x"], "dimension_sizes": [2], "values": [2**64 - 1, None]}], pa.struct([("dimension_names", pa.list_(pa.string())), ("dimension_sizes", pa.list_(pa.uint32())), ("values", pa.list_(pa.uint64()))])), "t": pa.array([{"dimension_names": [], "dimension_sizes": [], "values": [1_500]}], pa.struct([("dimension_names", pa.list_(pa.string())), ("dimension_sizes", pa.list_(pa.uint32())), ("values", pa.list_(pa.timestamp("ns")))]))})
    got = src.from_arrow(spark, foreign, need_metadata=False)
    assert nds.element_type(got, "u").simpleString() == "decimal(20,0)"
    assert int(got.first().u["values"][0]) == 2**64 - 1
    big = table(spark, [({"dimension_names": ["x", "e"], "dimension_sizes": [2**33, 0], "values": []},)], ["a"])
    with pytest.raises(errors.SizeOutOfRange):
        src.to_arrow(big)
    assert src.from_arrow(spark, src.to_arrow(df.where("false"))).count() == 0


# Broadcasting

SHAPES = st.lists(st.tuples(st.sampled_from("xyze"), st.integers(0, 3)), max_size=3).map(lambda d: tuple(Dimension(n, s) for n, s in d))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_broadcast_equals_the_model(spark, data):
    cases = []
    for _ in range(25):
        target = data.draw(SHAPES)
        lo = data.draw(st.integers(0, len(target)))
        own = target[lo : data.draw(st.integers(lo, len(target)))] if data.draw(st.booleans()) else data.draw(SHAPES)
        values = [None if k % 5 == 3 else k for k in range(math.prod(d.size for d in own))]
        cases.append((values, own, target))
    rows = [(array_row(v, own), array_row([0] * math.prod(d.size for d in t), t)) for v, own, t in cases if model_broadcast(v, own, t) is not None]
    wanted = [model_broadcast(v, own, t) for v, own, t in cases if model_broadcast(v, own, t) is not None]
    if rows:
        df = table(spark, rows, ["a", "b"]).coalesce(1)
        got = [r[0] for r in df.select(bc.broadcast_dynamic(F.col("a"), nd.nd_dimensions(F.col("b")), "int")).collect()]
        assert got == wanted
    for v, own, t in cases[:3]:
        one = table(spark, [(array_row(v, own),)], ["a"])
        want = model_broadcast(v, own, t)
        if want is None:
            with pytest.raises(errors.InvalidShapes):
                bc.broadcast_static(F.col("a"), own, t, "int")
        else:
            assert one.select(bc.broadcast_static(F.col("a"), own, t, "int")).first()[0] == want


def test_batch_of_three_ranks(spark):
    rows = [(array_row([1, 2, 3, 4], dims("a2 b2")), array_row([3.3, 4.4], dims("b2")), array_row([0.1], ()))]
    df = table(spark, rows, ["f1", "f2", "f3"], ["int", "double", "double"])
    want = [(1, 3.3, 0.1), (2, 4.4, 0.1), (3, 3.3, 0.1), (4, 4.4, 0.1)]
    assert [tuple(r) for r in bc.broadcast_to_table(df).collect()] == want
    static = bc.broadcast_to_table(df, dims={"f1": dims("a2 b2"), "f2": dims("b2"), "f3": ()}, coordinates=["pos", "a", "b"])
    assert [tuple(r) for r in static.collect()] == [(i, i // 2, i % 2, *w) for i, w in enumerate(want)]
    cells = static.select("a", "b", "f1")
    other = spark.createDataFrame([(0, 3.3), (1, 4.4)], "b long, f2 double")
    by_join = bc.broadcast_tables(cells, (other, ["b"]), (spark.createDataFrame([(0.1,)], "f3 double"), []))
    assert sorted(tuple(r) for r in by_join.select("f1", "f2", "f3").collect()) == want


def test_broadcast_errors_and_nulls(spark):
    two = table(spark, [(array_row([1, 2], dims("x2")), array_row([1, 2, 3], dims("y3")))], ["a", "b"])
    with pytest.raises(PySparkException, match="INVALID_SHAPES"):
        bc.broadcast_to_table(two).collect()
    with pytest.raises(errors.InvalidShapes):
        bc.broadcast_to_table(two, dims={"a": dims("x2"), "b": dims("y3")})
    with pytest.raises(errors.StructExpected):
        bc.broadcast_to_table(spark.range(1))
    with pytest.raises(errors.NoBroadcastShape):
        bc.broadcast_to_table(two, [])
    null = table(spark, [(None, array_row([1, 2], dims("x2"))), (None, array_row([5], ())), (None, None)], ["a", "b"])
    assert [tuple(r) for r in bc.broadcast_to_table(null).collect()] == [(None, 1), (None, 2), (None, 5), (None, None)]
    assert bc.broadcast_to_table(table(spark, [(array_row([], dims("e0")), array_row([1], ()))], ["a", "b"])).count() == 0
    with pytest.raises(PySparkException, match="INVALID_SHAPES"):
        bc.broadcast_tables(spark.range(3), (spark.range(2).withColumnRenamed("id", "k"), [])).collect()
    with pytest.raises(errors.InvalidShapes):
        bc.broadcast_tables(spark.range(3), (spark.range(2), ["nowhere"]))


def test_nd_broadcast_returns_an_array(spark):
    df = table(spark, [(array_row([1, 2], dims("x2")),)], ["a"])
    got = df.select(bc.nd_broadcast(F.col("a"), nd.literal_dimensions(dims("x2 y2")), "int").alias("a"))
    assert got.first().a.asDict() == array_row([1, 1, 2, 2], dims("x2 y2"))
    assert got.select(nd.nd_error_code(F.col("a"))).first()[0] is None


def test_packed_and_relational_flagship_agree(spark):
    from tessera.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    columns = ["vec_id", "comp", "label", "value", "weight"]
    a, b = (QUERIES[q](spark, sf).select(*columns) for q in ("nd_broadcast_batch", "nd_broadcast_batch_relational"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    plan_text = QUERIES["nd_broadcast_scalar"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "Python" not in plan_text


# Cast


def test_casts(spark):
    df = table(spark, [(array_row([3.9, -3.9, 1e20, None], dims("x4")),), (None,)], ["a"], "double")
    assert [r.a and r.a["values"] for r in df.select(nd.nd_cast(F.col("a"), "int").alias("a")).collect()] == [[3, -3, None, None], None]
    text = table(spark, [(array_row(["1.5", " 7 ", "x", "300"], dims("x4")),)], ["a"], "string")
    assert text.select(nd.nd_cast(F.col("a"), "int").alias("a")).first().a["values"] == [None, 7, None, 300]
    assert text.select(nd.nd_cast(F.col("a"), "tinyint").alias("a")).first().a["values"] == [None, 7, None, None]
    with pytest.raises(PySparkException):
        text.select(nd.nd_cast(F.col("a"), "int", strict=True)).collect()


# Chunks


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 5), min_size=1, max_size=3), st.data())
def test_chunks_equal_the_model(spark, sizes, data):
    shape = [data.draw(st.integers(1, 6)) for _ in sizes]
    values = [None if k % 4 == 1 else k for k in range(math.prod(sizes))]
    own = tuple(Dimension("xyz"[i], s) for i, s in enumerate(sizes))
    df = table(spark, [(array_row(values, own),)], ["a"])
    got = [(r.chunk_indices, r["shape"], r["values"]) for r in ch.chunk_batches(df, "a", shape).orderBy("chunk_ordinal").collect()]
    want = model_chunks(values, sizes, shape)
    assert got == want
    cells = [(*at, v) for at, v in zip(itertools.product(*map(range, sizes)), values)]
    names = list("xyz"[: len(sizes)])
    rows = spark.createDataFrame(cells, ", ".join(f"{n} long" for n in names) + ", v int")
    made = ch.chunk_table(rows, names, sizes, shape, "v")
    n = len(names)
    assert sorted(([r[f"o{i}"] for i in range(n)], [r[f"s{i}"] for i in range(n)], repr(r["values"])) for r in made.collect()) == sorted((o, s, repr(v)) for o, s, v in want)
    assert sorted(map(repr, map(tuple, ch.unchunk(made, names, "v").collect()))) == sorted(map(repr, cells))
    lines = [(*at, values[sum(i * k for i, k in zip(at, plan.strides(sizes))) :][: sizes[-1]]) for at in itertools.product(*map(range, sizes[:-1]))]
    by_line = ch.chunk_rows(spark.createDataFrame(lines, ", ".join([f"{n} long" for n in names[:-1]] + ["line array<int>"])), names[:-1], sizes, shape, "line")
    assert sorted(map(repr, by_line.collect())) == sorted(map(repr, made.collect()))


def test_chunk_slices_and_errors(spark):
    df = table(spark, [(array_row([1, 2, 3, 4, 5, 6], dims("x2 y3")),), (None,)], ["a"])
    got = ch.chunk_batches(df, "a", (2, 2)).orderBy("chunk_ordinal").collect()
    assert [([tuple(s) for s in r.slices], r["values"]) for r in got] == [([(0, 2), (0, 2)], [1, 2, 4, 5]), ([(0, 2), (2, 3)], [3, 6])]
    with pytest.raises(PySparkException, match="CHUNK_SHAPE_MISMATCH"):
        ch.chunk_batches(df, "a", (2,)).collect()
    with pytest.raises(errors.ChunkShapeMismatch):
        ch.nd_chunks(F.col("a"), (0, 2))
    with pytest.raises(errors.ChunkShapeMismatch):
        ch.chunk_table(df, ["x"], [2], (1, 1), "v")
    one = ch.chunk_batches(table(spark, [(array_row([9], ()),)], ["a"]), "a", ()).collect()
    assert [(r.chunk_indices, r["shape"], r["values"]) for r in one] == [([], [], [9])]
    assert ch.chunk_batches(table(spark, [(array_row([], dims("x0 y3")),)], ["a"]), "a", (2, 2)).count() == 0


def test_chunks_of_a_stream(spark, tmp_path):
    path = f"{tmp_path}/in"
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", nd.nd_array(F.col("embedding"), ["comp"], [64]).alias("a"))
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = streaming.write_available(streaming.stream_chunks(stream, "a", (24,), keep=["vec_id"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r[0][0], r[1], r[2]) for r in got.groupBy("chunk_indices", F.size("values").alias("n")).count().collect()) == [(0, 24, 500), (24, 24, 500), (48, 16, 500)]
