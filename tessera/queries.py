"""Queries over the sample tables, one or more per operator, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import UnsupportedEncodingVersion
from .functions import arrays as nd
from .functions import schema as nds
from .operators import broadcast as bc
from .operators import chunk as ch
from .operators import grid as gr
from .operators import shapes as sh
from .operators import view as vw
from .plans import dims as plan
from .plans.dims import Dimension
from .sources import arrow_files as af
from .sources import chunk_store as store
from .sources import routing
from .streaming import chunks as streaming
from .streaming import parts as arriving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vectors in a batch of the embeddings, components of a vector.
BLOCK, COMPONENTS = 256, 64
STATUSES, PRIORITIES, YEARS = ("F", "O", "P"), 5, 7
CUBE = (Dimension("status", 3), Dimension("priority", 5), Dimension("year", 7))
NATIONS = (Dimension("nation", 25), Dimension("segment", 5))
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENTS = (Dimension("event_type", 5), Dimension("day", 30), Dimension("hour", 24))


def query(oracle: str | None):
    """Register a query under its name, with the SQL that DuckDB runs beside it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Batches the queries start from


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per 256 vectors: two-dimensional, one-dimensional and scalar arrays."""
    rows = _table(spark, sf_dir, "embeddings").selectExpr(f"vec_id div {BLOCK} as block", "struct(vec_id, label, embedding) as line")
    packed = rows.groupBy("block").agg(F.expr("array_sort(collect_list(line)) as c"))
    arrays = {
        "value": nd.nd_array_sql("flatten(c.embedding)", ["vec", "comp"], ["size(c)", COMPONENTS]),
        "vec_id": nd.nd_array_sql("c.vec_id", ["vec"], ["size(c)"]),
        "label": nd.nd_array_sql("c.label", ["vec"], ["size(c)"]),
        "comp": nd.nd_array_sql(f"sequence(0L, {COMPONENTS - 1}L)", ["comp"], [COMPONENTS]),
        "weight": nd.nd_array_sql("array(0.5D)", [], []),
    }
    return packed.selectExpr("block", *[f"{sql} as {name}" for name, sql in arrays.items()])


def vector_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per vector: no shuffle at all."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", nd.nd_array(F.col("embedding"), ["comp"], [COMPONENTS]).alias("value"), nd.nd_scalar(F.col("label")).alias("label"), nd.nd_array(F.sequence(F.lit(0).cast("long"), F.lit(COMPONENTS - 1).cast("long")), ["comp"], [COMPONENTS], validate=False).alias("comp"), nd.nd_scalar(F.lit(0.5)).alias("weight"))


def _filled(spark: SparkSession, cells: DataFrame, shape: Sequence[Dimension], value: str) -> DataFrame:
    """One row: the array of ``shape`` from (pos, value) rows; places without a row are null.
    The shape is a constant of the query, so one row holds it."""
    n = plan.flat_size(shape)
    grid = spark.range(n).withColumnRenamed("id", "pos")
    packed = grid.join(cells, "pos", "left").agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("c"))
    return packed.select(nd.nd_array(F.col(f"c.{value}"), [d.name for d in shape], [d.size for d in shape]).alias(value))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    status = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("o_orderstatus")) - 1
    priority, year = F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.year("o_orderdate") - 1995
    cells = o.groupBy((status * 35 + priority * 7 + year).cast("long").alias("pos")).agg(F.count("*").alias("orders"))
    by_year = o.groupBy((priority * 7 + year).cast("long").alias("pos")).agg(F.count("*").alias("of_year"))
    names = o.select((priority).cast("long").alias("pos"), "o_orderpriority").groupBy("pos").agg(F.min("o_orderpriority").alias("name"))
    one = _filled(spark, cells, CUBE, "orders").crossJoin(_filled(spark, by_year, CUBE[1:], "of_year")).crossJoin(_filled(spark, names, CUBE[1:2], "name"))  # one row each
    return one


CUBE_DIMS = {"orders": CUBE, "of_year": CUBE[1:], "name": CUBE[1:2]}

_CUBE_SQL = """
with o as (select case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as status, substr(o_orderpriority, 1, 1)::int - 1 as priority,
  year(o_orderdate) - 1995 as year, o_orderpriority from orders),
grid as (select s.status::bigint as status, p.priority::bigint as priority, y.year::bigint as year from range(3) s(status), range(5) p(priority), range(7) y(year)),
cube as (select status, priority, year, count(*) as orders from o group by all),
by_year as (select priority, year, count(*) as of_year from o group by all),
names as (select priority, min(o_orderpriority) as name from o group by all)
"""


def nation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    counts = c.groupBy((F.col("c_nationkey") * 5 + segment).cast("long").alias("pos")).agg(F.count("*").alias("customers"))
    keyed = n.select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_regionkey") == 1).alias("flag"), F.timestamp_seconds(F.col("n_nationkey").cast("long") * 86400).cast("timestamp_ntz").alias("since"), F.encode("n_name", "UTF-8").alias("code"))
    out = _filled(spark, counts, NATIONS, "customers")
    for column in ("flag", "since", "code"):
        out = out.crossJoin(_filled(spark, keyed.select("pos", column), NATIONS[:1], column))  # one row each
    return out.withColumn("segment", nd.nd_array(F.array(*map(F.lit, SEGMENTS)), ["segment"], [5]))


NATION_DIMS = {"customers": NATIONS, "flag": NATIONS[:1], "since": NATIONS[:1], "code": NATIONS[:1], "segment": NATIONS[1:]}

_NATION_SQL = f"""
with grid as (select n.i as nation, s.i as segment_no, ['{"', '".join(SEGMENTS)}'][s.i + 1] as segment from range(25) n(i), range(5) s(i)),
counts as (select c_nationkey as nation, c_mktsegment as segment, count(*) as customers from customer group by all)
"""


def user_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return nd.nd_from_table(e, ["user_id"], ["ts", "event_id"], ["value", "event_type", "ts"], "event")


# Broadcast


@query("select e.vec_id, c.i as comp, e.label, e.embedding[c.i + 1] as value, 0.5::double as weight from embeddings e, range(64) c(i)")
def nd_broadcast_batch(spark, sf_dir):
    """The flagship: two-dimensional arrays over (vec, comp) of many vectors, one-dimensional
    ones over vec and over comp, and a scalar, dimensions read from each batch."""
    return bc.broadcast_to_table(embedding_batches(spark, sf_dir), ["value", "vec_id", "label", "comp", "weight"]).select("vec_id", "comp", "label", "value", "weight")


@query(ORACLES["nd_broadcast_batch"])
def nd_broadcast_block(spark, sf_dir):
    """The same cells from batches cut to one vector each, dimensions known to the planner:
    narrow from scan to result."""
    dims = {"value": [("comp", COMPONENTS)], "label": [], "comp": [("comp", COMPONENTS)], "weight": []}
    return bc.broadcast_to_table(vector_batches(spark, sf_dir), list(dims), dims, keep=["vec_id"]).select("vec_id", "comp", "label", "value", "weight")


@query("select e.vec_id, e.embedding[c.i + 1] as value, 0.5::double as weight from embeddings e, range(64) c(i)")
def nd_broadcast_scalar(spark, sf_dir):
    dims = {"value": [("comp", COMPONENTS)], "weight": []}
    return bc.broadcast_to_table(vector_batches(spark, sf_dir), ["value", "weight"], dims, keep=["vec_id"])


@query("select vec_id // 256 as block, label, embedding[c.i + 1] as value from embeddings, range(64) c(i)")
def nd_broadcast_leading(spark, sf_dir):
    return bc.broadcast_to_table(embedding_batches(spark, sf_dir), ["label", "value"], keep=["block"])


@query("select vec_id // 256 as block, c.i as comp, embedding[c.i + 1] as value from embeddings, range(64) c(i)")
def nd_broadcast_trailing(spark, sf_dir):
    return bc.broadcast_to_table(embedding_batches(spark, sf_dir), ["comp", "value"], keep=["block"])


@query(_CUBE_SQL + "select (status * 35 + g.priority * 7 + year)::int as pos, status, g.priority, year, name from grid g left join names n on n.priority = g.priority")
def nd_broadcast_middle(spark, sf_dir):
    rows = bc.broadcast_to_table(order_cube(spark, sf_dir), ["orders", "name"], CUBE_DIMS, coordinates=["pos", "status", "priority", "year"])
    return rows.select(F.col("pos").cast("int").alias("pos"), "status", "priority", "year", "name")


@query(_CUBE_SQL + "select g.status, g.priority, g.year, orders, of_year from grid g left join cube c on (g.status, g.priority, g.year) = (c.status, c.priority, c.year) left join by_year b on (g.priority, g.year) = (b.priority, b.year)")
def nd_broadcast_subslice(spark, sf_dir):
    return bc.broadcast_to_table(order_cube(spark, sf_dir), ["orders", "of_year"], CUBE_DIMS, coordinates=["pos", "status", "priority", "year"]).drop("pos")


def _nation_query(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        return bc.broadcast_to_table(nation_batch(spark, sf_dir), ["customers", name], NATION_DIMS, coordinates=["pos", "nation", "segment_no"]).drop("pos")

    run.__name__ = {"segment": "nd_broadcast_string", "flag": "nd_broadcast_bool", "since": "nd_broadcast_ts", "code": "nd_broadcast_binary"}[name]
    query(_NATION_SQL + f"select g.nation, g.segment_no, customers, {sql} as {name} from grid g left join counts c on c.nation = g.nation and c.segment = g.segment left join nation n on n.n_nationkey = g.nation")(run)


_nation_query("segment", "g.segment")
_nation_query("flag", "n_regionkey = 1")
_nation_query("since", "timestamp '1970-01-01' + to_days(n_nationkey::int)")
_nation_query("code", "encode(n_name)")

_EVENT_SQL = """
with kinds as (select event_type, row_number() over (order by event_type) - 1 as k from (select distinct event_type from events)),
base as (select min(date_trunc('day', ts)) as d0 from events),
cells as (select k, date_diff('day', d0, ts) as day, hour(ts) as hour, count(*) as n from events join kinds using (event_type), base group by all)
"""


@query(_EVENT_SQL + "select x.k as event_type, d.day, h.hour, nullif(n, 1) as n, case when d.day % 7 = 0 then null else d.day end as day_no from range(5) x(k), range(30) d(day), range(24) h(hour) left join cells c on c.k = x.k and c.day = d.day and c.hour = h.hour")
def nd_broadcast_nulls(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a dimension's labels
    day = F.datediff("ts", F.lit(e.agg(F.min("ts").cast("date")).first()[0]))
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1
    cells = e.groupBy((kind * 720 + day * 24 + F.hour("ts")).cast("long").alias("pos")).agg(F.count("*").alias("n")).select("pos", F.nullif("n", F.lit(1)).alias("n"))
    days = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")), lambda d: F.when(d % 7 != 0, d))
    batch = _filled(spark, cells, EVENTS, "n").withColumn("day_no", nd.nd_array(days, ["day"], [30]))
    return bc.broadcast_to_table(batch, ["n", "day_no"], {"n": EVENTS, "day_no": EVENTS[1:2]}, coordinates=["pos", "event_type", "day", "hour"]).drop("pos")


@query("select vec_id, embedding[c.i + 1] as value, null::double as missing from embeddings, range(64) c(i)")
def nd_broadcast_null_array(spark, sf_dir):
    batch = vector_batches(spark, sf_dir).withColumn("missing", nd.nd_null("double"))
    return bc.broadcast_to_table(batch, ["value", "missing"], keep=["vec_id"])


@query("select count(*) as regions, min(r_name) as first_name, null::bigint as missing from region")
def nd_all_scalars(spark, sf_dir):
    one = _table(spark, sf_dir, "region").agg(F.count("*").alias("n"), F.min("r_name").alias("m"))
    batch = nd.nd_batch(one, regions=nd.nd_scalar(F.col("n")), first_name=nd.nd_scalar(F.col("m")), missing=nd.nd_null("bigint"))
    return bc.broadcast_to_table(batch)


@query("select l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderpriority, 0.05::double as rate from lineitem left join orders on l_orderkey = o_orderkey")
def nd_broadcast_relational(spark, sf_dir):
    """The dimension is the order; the larger array has a row per line."""
    cells = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), "o_custkey", "o_orderpriority")
    rate = spark.range(1).select(F.lit(0.05).alias("rate"))
    return bc.broadcast_tables(cells, (orders, ["order"]), (rate, [])).withColumnRenamed("order", "l_orderkey")


@query("select vec_id, c.i as comp, embedding[c.i + 1] as value, label, 0.5::double as weight from embeddings, range(64) c(i)")
def nd_broadcast_batch_relational(spark, sf_dir):
    """The flagship's cells by joins on coordinates."""
    e = _table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("comp", "value")).withColumn("comp", F.col("comp").cast("long"))
    return bc.broadcast_tables(cells, (e.select("vec_id", "label"), ["vec_id"]), (spark.range(1).select(F.lit(0.5).alias("weight")), []))


# Constructors of moments and bytes


@query("select event_id, ts as chrono, ts as micros, date_trunc('milliseconds', ts) as millis, date_trunc('second', ts) as seconds, ts as nanos, encode(event_type) as bytes, date_trunc('second', ts) as pair_0, date_trunc('second', ts) + interval 1 second as pair_1 from events")
def nd_moments(spark, sf_dir):
    """Scalars of a moment, of its counts in each unit, and of bytes; a vector of counts."""
    e = _table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) + F.expr("unix_micros(cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp)) * -1")
    s = F.call_function("div", us, F.lit(1_000_000).cast("long"))
    batch = e.select(
        "event_id",
        nd.nd_scalar(F.col("ts")).alias("chrono"),
        nd.nd_scalar_timestamp(us, "us").alias("micros"),
        nd.nd_scalar_timestamp(F.call_function("div", us, F.lit(1000).cast("long")), "ms").alias("millis"),
        nd.nd_scalar_timestamp(s, "s").alias("seconds"),
        nd.nd_scalar_timestamp(us * 1000 + 999, "ns").alias("nanos"),
        nd.nd_scalar(F.encode("event_type", "UTF-8")).alias("bytes"),
        nd.nd_timestamps(F.array(s, s + 1), "s", ["moment"], [2]).alias("pair"),
    )
    first = lambda c: F.element_at(F.col(f"{c}.values"), 1).alias(c)
    return batch.select("event_id", *map(first, ("chrono", "micros", "millis", "seconds", "nanos", "bytes")), *[F.element_at("pair.values", i + 1).alias(f"pair_{i}") for i in (0, 1)])


@query("select o_orderkey, trunc(o_totalprice)::bigint as price, substr(o_orderpriority, 1, 1)::int as priority from orders")
def nd_cast_strict(spark, sf_dir):
    """What can't be cast would fail the job (see tests); here everything can."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", nd.nd_cast(nd.nd_scalar(F.col("o_totalprice")), "bigint", strict=True).alias("p"), nd.nd_cast(nd.nd_scalar(F.substring("o_orderpriority", 1, 1)), "int", strict=True).alias("q"))
    return o.select("o_orderkey", F.element_at("p.values", 1).alias("price"), F.element_at("q.values", 1).alias("priority"))


@query("select c_custkey, c_acctbal, c_name from customer")
def nd_decode_unmarked(spark, sf_dir):
    """Arrays of a producer that leaves no metadata: types and rows are checked all the same."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", nd.nd_scalar(F.col("c_acctbal")).alias("c_acctbal"), nd.nd_scalar(F.col("c_name")).alias("c_name"))
    decoded = nd.decode_batches(c, ["c_acctbal", "c_name"], need_metadata=False)
    return bc.broadcast_to_table(decoded, ["c_acctbal", "c_name"], keep=["c_custkey"])


@query("select r_regionkey, list_contains(['0.1.0', '1.2', '10', '2.0.0-rc1'], v) as known, v as version from region, (values ('0.1.0'), ('1.2'), ('10'), ('2.0.0-rc1'), ('?'), (''), ('a.1')) t(v)")
def nd_versions(spark, sf_dir):
    """Whether a batch marked with a version is decoded."""
    r = _table(spark, sf_dir, "region")
    out = None
    for v in ("0.1.0", "1.2", "10", "2.0.0-rc1", "?", "", "a.1"):
        marked = nds.marked(r.select(nd.nd_scalar(F.col("r_regionkey")).alias("r_regionkey")), ["r_regionkey"], version=v)
        try:
            rows, known = nd.decode_batches(marked), True
        except UnsupportedEncodingVersion:
            rows, known = marked, False
        rows = rows.select(F.element_at("r_regionkey.values", 1).alias("r_regionkey"), F.lit(known).alias("known"), F.lit(v).alias("version"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select row_number() over ()::int - 1 as pos, column_name as name, 'nd-array-schema' as key, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end as element from (describe events)")
def nd_encoded_schema(spark, sf_dir):
    """The encoded schema with its metadata, from a schema alone."""
    there = nds.encoded_schema(_table(spark, sf_dir, "events").schema)
    rows = [(i, f.name, *f.metadata, nds.plain_field(f.name, f.dataType).dataType.simpleString()) for i, f in enumerate(there.fields)]
    return spark.createDataFrame(rows, "pos int, name string, key string, element string")


@query("select user_id, (r // 50) * 50 as origin, count(*) as cells, min(event_id) as first_event from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as r from events) group by all")
def nd_from_table_in_parts(spark, sf_dir):
    """A key's rows in batches of bounded size."""
    b = nd.nd_from_table(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id"], "event", max_cells=50, folder=f"{streaming.shared_folder(spark)}/ranges")
    return b.select("user_id", "origin", nd.nd_flat_size(F.col("event_id")).alias("cells"), F.array_min("event_id.values").alias("first_event"))


# Accessors and shape algebra


@query("select vec_id // 256 as block, count(*) as n_vec, 64::bigint as n_comp, 2 as rank, false as scalar, true as weight_scalar, count(*) * 64 as cells, 1::bigint as weight_cells from embeddings group by all")
def nd_shape(spark, sf_dir):
    a, w = F.col("value"), F.col("weight")
    return embedding_batches(spark, sf_dir).select("block", F.element_at(nd.nd_shape(a), 1).alias("n_vec"), F.element_at(nd.nd_shape(a), 2).alias("n_comp"), nd.nd_rank(a).alias("rank"), nd.nd_is_scalar(a).alias("scalar"), nd.nd_is_scalar(w).alias("weight_scalar"), nd.nd_flat_size(a).alias("cells"), nd.nd_flat_size(w).alias("weight_cells"))


@query("select user_id, 'event' as name, count(*) as size, false as missing from events group by user_id")
def nd_dimensions(spark, sf_dir):
    b = user_batches(spark, sf_dir)
    return b.select("user_id", F.explode(nd.nd_dimensions(F.col("value"))).alias("d"), nd.nd_is_null(F.col("value")).alias("missing")).select("user_id", "d.name", "d.size", "missing")


SHAPED = ("value", "vec_id", "label", "comp", "weight")
#: A shape that one block of vectors has, and whose dimensions others share in part.
FULL = (Dimension("vec", BLOCK), Dimension("comp", COMPONENTS))
#: Shapes of a block of n vectors, as text: two dimensions, one, one, one, none.
_SHAPED_SQL = f"""with blocks as (select vec_id // {BLOCK} as block, count(*) as n from embeddings group by all),
shapes as (select block, name, case name when 'value' then 'vec' || n || ' comp{COMPONENTS}' when 'comp' then 'comp{COMPONENTS}' when 'weight' then '' else 'vec' || n end as dims, case name when 'value' then 2 when 'weight' then 0 else 1 end as rank, n from blocks, (values ('value'), ('vec_id'), ('label'), ('comp'), ('weight')) t(name))"""


def _text(dims):
    return F.array_join(F.transform(dims, lambda d: F.concat(d["name"], d["size"].cast("string"))), " ")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, name, dims) of each array of the embeddings' batches."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), nd.nd_dimensions(F.col(c)).alias("dims")) for c in SHAPED])
    return embedding_batches(spark, sf_dir).select("block", F.explode(each).alias("x")).select("block", "x.name", "x.dims")


@query(_SHAPED_SQL + f"select block, name, dims, case when dims = 'vec{BLOCK} comp{COMPONENTS}' then 0 when rank = 0 or (rank = 1 and dims in ('vec{BLOCK}', 'comp{COMPONENTS}')) then -1 end as to_full, case when dims = 'vec' || n then 0 when rank = 0 then -1 when rank = 2 then 1 end as to_vector from shapes")
def nd_compare_shapes(spark, sf_dir):
    """Every array's shape against that of a full block, and against its own block's vectors."""
    vectors = _shapes(spark, sf_dir).where("name = 'label'").select("block", F.col("dims").alias("own"))
    rows = _shapes(spark, sf_dir).join(vectors, "block")
    return rows.select("block", "name", _text(F.col("dims")).alias("dims"), sh.compare_dims(F.col("dims"), nd.literal_dimensions(FULL)).alias("to_full"), sh.compare_dims(F.col("dims"), F.col("own")).alias("to_vector"))


@query(_SHAPED_SQL + "select block, max(case when block % 2 = 0 then case name when 'value' then dims end else case name when 'label' then dims end end) as target from shapes group by block")
def nd_find_target(spark, sf_dir):
    """Each row's target; the two-dimensional array is null in every other row."""
    b = embedding_batches(spark, sf_dir).withColumn("value", F.when(F.col("block") % 2 == 0, F.col("value")))
    return b.select("block", _text(bc.target_of([F.col(c) for c in ("weight", "label", "value", "comp")])).alias("target"))


@query(_SHAPED_SQL + f"select s.block, name, turned, case when turned then case when rank = 0 then 1 when name = 'comp' then 1 when name = 'value' then null else {COMPONENTS} end else case when name = 'comp' then s.n else 1 end end::bigint as whole, case when turned then case when rank = 0 then s.n * {COMPONENTS} when name = 'comp' then s.n when name = 'value' then null else 1 end else case when rank = 0 then s.n * {COMPONENTS} when name in ('value', 'comp') then 1 else {COMPONENTS} end end::bigint as each from shapes s, (values (false), (true)) t(turned)")
def nd_reshape_args(spark, sf_dir):
    """Repeat counts of every array in its block's shape, and in that with dimensions turned,
    where the two-dimensional one doesn't lie."""
    whole = _shapes(spark, sf_dir).where("name = 'value'").select("block", F.explode(F.array(F.struct(F.lit(False).alias("turned"), F.col("dims").alias("target")), F.struct(F.lit(True).alias("turned"), F.reverse("dims").alias("target")))).alias("t"))
    rows = _shapes(spark, sf_dir).join(whole, "block")
    r = bc.repeats_of(F.col("dims"), F.col("t.target"))
    return rows.select("block", "name", "t.turned", r["whole"].alias("whole"), r["each"].alias("each"))


@query(_SHAPED_SQL + f"select block, name, case name when 'comp' then {BLOCK} when 'weight' then 1 else case when n = {BLOCK} then 1 end end::bigint as whole, case name when 'weight' then {BLOCK * COMPONENTS} when 'comp' then 1 when 'value' then case when n = {BLOCK} then 1 end else case when n = {BLOCK} then {COMPONENTS} end end::bigint as each from shapes")
def nd_single_repeats(spark, sf_dir):
    """Repeat counts in a full block's shape: shapes of more dimensions must equal it."""
    r = sh.single_repeats_of(F.col("dims"), nd.literal_dimensions(FULL))
    return _shapes(spark, sf_dir).select("block", "name", r["whole"].alias("whole"), r["each"].alias("each"))


@query("""with u as (select user_id, count(*) as n from events group by all), k as (select n % 3 as k, n, count(*) as users from u group by all)
select k, 'event' || max(n) as target, count(*) as shapes, sum(users)::bigint * 2 as arrays, case when min(n) < max(n) then 'event' || min(n) end as offending from k group by k
union all select null, 'event' || max(n), count(*), sum(users)::bigint * 2, case when min(n) < max(n) then 'event' || min(n) end from k
union all select -1, any_value(target), count(distinct dims), count(*), null from (select max(case when name = 'value' then dims end) over (partition by block) as target, dims from shapes where block = 0)""".replace("with u as", _SHAPED_SQL + ", u as", 1))
def nd_table_target(spark, sf_dir):
    """One target for all arrays of a table or of a key, or the shape that stands against it."""
    users = user_batches(spark, sf_dir).withColumn("k", nd.nd_flat_size(F.col("value")) % 3)
    by_key = sh.common_target(users, ["value", "ts"], ["k"])
    whole = sh.common_target(users, ["value", "ts"]).withColumn("k", F.lit(None).cast("long"))
    fitting = sh.common_target(embedding_batches(spark, sf_dir).where("block = 0"), SHAPED).withColumn("k", F.lit(-1).cast("long"))
    rows = by_key.unionByName(whole).unionByName(fitting)
    return rows.select("k", _text(F.col("target")).alias("target"), "shapes", "arrays", _text(F.col("offending")).alias("offending"))


# Encode, decode, validation, schemas

#: What is wrong with the array of an event, by its id: names, sizes and values as SQL, of both
#: engines; {a} and {b} are the event's value and its double.
FAULTS = (
    ("array('x', 'y')", "array(1L, 2L)", "array({a}, {b})"), ("array('x')", "array(1L, 2L)", "array({a}, {b})"), ("array('x')", "array(3L)", "array({a}, {b})"),
    ("null", "array(1L)", "array({a})"), ("array('x')", "null", "array({a})"), ("array('x')", "array(1L)", "null"),
    ("array('x', null)", "array(1L, 1L)", "array({a})"), ("array('x', 'y')", "array(null, 1L)", "array({a})"), ("array()", "array()", "array({a})"),
    ("array()", "array()", "array({a}, {b})"), ("array('e')", "array(0L)", "array()"), ("array('x', 'y')", "array(-1L, -1L)", "array({a})"), ("array('x')", "array(1L)", "array(null)"),
)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an array each, one in 13 right in its way; every 14th array is null."""
    pick = lambda i, kind: "case event_id % 13 " + " ".join(f"when {k} then cast({f[i].format(a='value', b='value * 2')} as {kind})" for k, f in enumerate(FAULTS)) + " end"
    made = f"named_struct('dimension_names', {pick(0, 'array<string>')}, 'dimension_sizes', {pick(1, 'array<bigint>')}, 'values', {pick(2, 'array<double>')})"
    return _table(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"if(event_id % 14 = 0, null, {made}) as a")


_CODES_SQL = """select event_id, event_type, case when event_id % 14 = 0 then null else case event_id % 13 when 1 then 'DIMENSION_SIZE_MISMATCH' when 2 then 'SHAPE_AND_LENGTH_MISMATCH' when 3 then 'NO_DIMENSION_NAMES' when 4 then 'NO_DIMENSION_SIZES' when 5 then 'NO_VALUES'
  when 6 then 'NULL_DIMENSION' when 7 then 'NULL_DIMENSION' when 9 then 'SHAPE_AND_LENGTH_MISMATCH' when 11 then 'SHAPE_AND_LENGTH_MISMATCH' end end as code,
  case when event_id % 14 = 0 then null else case event_id % 13 when 1 then 1 when 6 then 1 when 7 then 0 when 11 then 0 end end as dimension from events"""


@query(f"select event_id, code from ({_CODES_SQL})")
def nd_validate_codes(spark, sf_dir):
    return _faulty(spark, sf_dir).select("event_id", nd.nd_error_code(F.col("a")).alias("code"))


@query(f"select event_type, code is null as valid, case when code is not null then 'a' end as wrong_column, code, dimension, count(*) as events from ({_CODES_SQL}) group by all")
def nd_route(spark, sf_dir):
    """Right and wrong arrays written apart in one pass; what is in either place."""
    valid, rejected = routing.route(_faulty(spark, sf_dir), f"{streaming.shared_folder(spark)}/routed", ["a"])
    told = nd.decode_batches(valid, ["a"]).select("event_type", F.lit(True).alias("valid"), *[F.lit(None).cast(k).alias(c) for c, k in (("wrong_column", "string"), ("code", "string"), ("dimension", "int"))])
    wrong = rejected.select("event_type", F.lit(False).alias("valid"), "wrong_column", F.col("error_code").alias("code"), F.col("wrong_dimension").alias("dimension"))
    return told.unionByName(wrong).groupBy("event_type", "valid", "wrong_column", "code", "dimension").agg(F.count("*").alias("events"))


@query("select user_id, value, event_type, ts from events")
def nd_encode_decode(spark, sf_dir):
    """Encoded batches with their metadata, decoded with all checks, flattened again."""
    encoded = nd.encode_batches(user_batches(spark, sf_dir), ["value", "event_type", "ts"])
    decoded = nd.decode_batches(encoded, ["value", "event_type", "ts"])
    return bc.broadcast_to_table(decoded, ["value", "event_type", "ts"], keep=["user_id"])


def _arrow_orders(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Arrow files: a batch of orders for each customer."""
    batches = nd.nd_from_table(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderdate"], "order")
    path = f"{streaming.shared_folder(spark)}/arrow"
    af.write_arrow(batches.select(nd.nd_scalar(F.col("o_custkey")).alias("o_custkey"), "o_orderkey", "o_totalprice", "o_orderdate"), path)
    return path


@query("select o_custkey, o_orderkey, o_totalprice, o_orderdate from orders")
def nd_wire_round_trip(spark, sf_dir):
    """Through Arrow files in the wire types: executors write and read them."""
    return bc.broadcast_to_table(af.read_arrow(spark, _arrow_orders(spark, sf_dir)))


@query("select o_custkey, count(*) as orders, sum(o_orderkey)::bigint as keys from orders group by all")
def nd_wire_columns(spark, sf_dir):
    """Two of the columns; the others aren't read."""
    held = af.read_arrow(spark, _arrow_orders(spark, sf_dir), ["o_custkey", "o_orderkey"])
    return bc.broadcast_to_table(held).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


@query("select ordinal_position::int - 1 as pos, column_name as name, 'struct<dimension_names:array<string>,dimension_sizes:array<bigint>,values:array<' || case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end || '>>' as type, false as nullable from (select row_number() over () as ordinal_position, column_name, column_type as data_type from (describe lineitem))")
def nd_schema_to_nd(spark, sf_dir):
    return spark.createDataFrame(nds.schema_rows(nds.to_nd_schema(_table(spark, sf_dir, "lineitem").schema)), "pos int, name string, type string, nullable boolean")


@query("select row_number() over ()::int - 1 as pos, column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end as type, true as nullable from (describe orders)")
def nd_schema_from_nd(spark, sf_dir):
    there = nds.to_nd_schema(_table(spark, sf_dir, "orders").schema)
    return spark.createDataFrame(nds.schema_rows(nds.to_plain_schema(there)), "pos int, name string, type string, nullable boolean")


@query("select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos, value from events")
def nd_from_table_by_group(spark, sf_dir):
    return user_batches(spark, sf_dir).select("user_id", F.posexplode(nd.nd_values(F.col("value"))).alias("pos", "value"))


@query("select o_orderkey, case when regexp_matches(substr(o_orderpriority, 1, 1), '^[0-9]$') then substr(o_orderpriority, 1, 1)::int end as digit, null::int as word from orders")
def nd_cast_safe(spark, sf_dir):
    """Text to number: what is no number becomes a null cell."""
    a = nd.nd_array(F.array(F.substring("o_orderpriority", 1, 1), F.substring("o_orderpriority", 3, 9)), ["part"], [2])
    cast = _table(spark, sf_dir, "orders").select("o_orderkey", nd.nd_cast(a, "int").alias("a"))
    return cast.select("o_orderkey", F.element_at("a.values", 1).alias("digit"), F.element_at("a.values", 2).alias("word"))


@query("select l_orderkey, l_linenumber, trunc(l_extendedprice)::int as price, trunc(-l_extendedprice)::int as negative from lineitem")
def nd_cast_trunc(spark, sf_dir):
    a = nd.nd_array(F.array("l_extendedprice", -F.col("l_extendedprice")), ["sign"], [2])
    cast = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nd.nd_cast(a, "int").alias("a"))
    return cast.select("l_orderkey", "l_linenumber", F.element_at("a.values", 1).alias("price"), F.element_at("a.values", 2).alias("negative"))


# Chunks

_CELLS_SQL = "select vec_id as i, c.i as j, embedding[c.i + 1] as v from embeddings, range(64) c(i)"


def _embedding_chunks(spark: SparkSession, sf_dir: str, shape: Sequence[int]) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return ch.chunk_rows(e, ["vec_id"], [e.count(), COMPONENTS], shape, "embedding")


def _cell_chunks(spark: SparkSession, sf_dir: str, shape: Sequence[int]) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("comp", "value")).withColumn("comp", F.col("comp").cast("long"))
    return ch.chunk_table(cells, ["vec_id", "comp"], [e.count(), COMPONENTS], shape, "value")


@query(f"with c as ({_CELLS_SQL}), n as (select count(*) as n from embeddings) select (i // 70) * 70 as o0, (j // 24) * 24 as o1, min(least(70, n - (i // 70) * 70)) as s0, min(least(24, 64 - (j // 24) * 24))::bigint as s1, count(*) as cells from c, n group by all")
def nd_chunk_meta(spark, sf_dir):
    return _embedding_chunks(spark, sf_dir, (70, 24)).select("o0", "o1", "s0", "s1", F.size("values").cast("long").alias("cells"))


@query(f"with c as ({_CELLS_SQL}) select (i // 64) * 64 as o0, (j // 16) * 16 as o1, (row_number() over (partition by i // 64, j // 16 order by i, j) - 1)::int as pos, v as value from c")
def nd_chunk_values(spark, sf_dir):
    return _embedding_chunks(spark, sf_dir, (64, 16)).select("o0", "o1", F.posexplode("values").alias("pos", "value"))


@query("select vec_id, c.i as comp, embedding[c.i + 1] as value from embeddings, range(64) c(i)")
def nd_chunk_round_trip(spark, sf_dir):
    """Rows of lines to chunks and back to cells."""
    return ch.unchunk(_embedding_chunks(spark, sf_dir, (70, 24)), ["vec_id", "comp"], "value")


@query(f"with c as ({_CELLS_SQL}) select (i // 64) * 64 as o0, (j // 16) * 16 as o1, (row_number() over (partition by i // 64, j // 16 order by i, j) - 1)::int as pos, v as value from c")
def nd_chunk_cells(spark, sf_dir):
    """The same chunks from a row per cell."""
    return _cell_chunks(spark, sf_dir, (64, 16)).select("o0", "o1", F.posexplode("values").alias("pos", "value"))


@query(f"with c as ({_CELLS_SQL}), b as (select *, i // 256 as block, i % 256 as r from c), n as (select block, count(distinct i) as n from b group by block) select b.block, (r // 100) * 4 + j // 20 as chunk_ordinal, (r // 100) * 100 as o0, (j // 20) * 20 as o1, min(least(n, (r // 100) * 100 + 100)) as end0, min(least(64, (j // 20) * 20 + 20))::bigint as end1, count(*) as cells, min(v) as least, max(v) as most from b join n on n.block = b.block group by all")
def nd_chunk_in_row(spark, sf_dir):
    """Two-dimensional arrays cut within their rows, edges smaller."""
    c = ch.chunk_batches(embedding_batches(spark, sf_dir), "value", (100, 20), keep=["block"])
    return c.select("block", "chunk_ordinal", F.element_at("chunk_indices", 1).alias("o0"), F.element_at("chunk_indices", 2).alias("o1"), F.element_at("slices", 1)["end"].alias("end0"), F.element_at("slices", 2)["end"].alias("end1"), F.size("values").cast("long").alias("cells"), F.array_min("values").alias("least"), F.array_max("values").alias("most"))


@query(f"select i as vec_id, (j // 24) * 24 as origin, (j % 24)::int as pos, v as value from ({_CELLS_SQL})")
def nd_chunk_stream(spark, sf_dir):
    """A stream over the table's files, each arriving micro-batch of arrays cut on its own,
    written exactly once until all that is there is read; the result is what was written."""
    fields = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    e = spark.readStream.schema(fields).parquet(f"{sf_dir}/embeddings.parque[t]")  # a pattern may name a file or a folder
    arrays = e.select("vec_id", nd.nd_array(F.col("embedding"), ["comp"], [COMPONENTS]).alias("value"))
    folder = streaming.shared_folder(spark)
    cut = streaming.stream_chunks(arrays, "value", (24,), keep=["vec_id"])
    streaming.write_available(cut, f"{folder}/chunks", f"{folder}/state").awaitTermination()
    c = spark.read.schema(cut.schema).parquet(f"{folder}/chunks")
    return c.select("vec_id", F.element_at("chunk_indices", 1).alias("origin"), F.posexplode("values").alias("pos", "value"))


def _typed_chunks(name: str, cell: tuple[str, str]) -> None:
    """Chunks of arrays of one type, with null cells; cut within rows."""

    def run(spark, sf_dir):
        e = _table(spark, sf_dir, "events")
        packed = nd.nd_from_table(e.select("user_id", "event_id", F.expr(cell[0]).alias("v")), ["user_id"], ["event_id"], ["v"], "event")
        c = ch.chunk_batches(packed, "v", (16,), keep=["user_id"])
        return c.select("user_id", F.element_at("chunk_indices", 1).alias("origin"), F.posexplode("values").alias("pos", "v"))

    run.__name__ = f"nd_chunk_{name}"
    query(f"select user_id, (r // 16) * 16 as origin, (r % 16)::int as pos, v from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as r, {cell[1]} as v from events)")(run)


for _name, _cell in {
    "boolean": ("if(event_id % 5 = 0, null, value > 50)", "case when event_id % 5 = 0 then null else value > 50 end"),
    "string": ("if(event_id % 5 = 0, null, event_type)", "case when event_id % 5 = 0 then null else event_type end"),
    "binary": ("if(event_id % 5 = 0, null, encode(event_type, 'UTF-8'))", "case when event_id % 5 = 0 then null else encode(event_type) end"),
    "timestamp": ("if(event_id % 5 = 0, null, ts)", "case when event_id % 5 = 0 then null else ts end"),
}.items():
    _typed_chunks(_name, _cell)


@query("select user_id, (r // 16) * 16 as origin, (r % 16)::int as pos, true as missing from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as r from events)")
def nd_chunk_null(spark, sf_dir):
    """Arrays whose elements have no type: nulls only."""
    packed = nd.nd_from_table(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_id"], "event")
    void = packed.select("user_id", F.struct(F.col("event_id.dimension_names"), F.col("event_id.dimension_sizes"), F.transform("event_id.values", lambda _: F.lit(None)).alias("values")).alias("v"))
    c = ch.chunk_batches(void, "v", (16,), keep=["user_id"])
    return c.select("user_id", F.element_at("chunk_indices", 1).alias("origin"), F.posexplode("values").alias("pos", "v")).select("user_id", "origin", "pos", F.col("v").isNull().alias("missing"))


@query("select event_type, day, true as complete, (row_number() over (partition by event_type, day order by ts, event_id) - 1)::int as pos, value from (select *, date_trunc('day', ts)::date as day from events)")
def nd_arriving_parts(spark, sf_dir):
    """A day's events of a type are an array whose cells arrive one by one, in files out of
    order: each array is emitted when its last cell is there."""
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    along = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    lines = e.select("event_type", "day", (F.row_number().over(along) - 1).alias("part"), F.count("*").over(Window.partitionBy("event_type", "day")).alias("of"), F.to_timestamp("day").alias("time"), F.array("value").alias("cells"))
    folder = streaming.shared_folder(spark)
    lines.repartition(6, "part").write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/lines")
    whole = arriving.assemble(stream, ["event_type", "day"], "part", "of", "time", "cells", patience="60 days", delay="60 days")
    streaming.write_available(whole, f"{folder}/arrays", f"{folder}/state").awaitTermination()
    arrays = spark.read.schema(whole.schema).parquet(f"{folder}/arrays")
    return arrays.select("event_type", "day", "complete", F.posexplode("values").alias("pos", "value"))


# Chunks meet chunks: nothing below makes a row of a cell before its result does

VEC_COMP = ("vec", "comp")
#: Elements of a chunk, about, where grids are planned from the data.
CHUNK_CELLS = 4096
#: A box of the embeddings: vectors and components from, to.
REGION = {"vec": (100, 300), "comp": (10, 50)}


@query("select vec_id as vec, c.i as comp, embedding[c.i + 1] as value, label, 2 * c.i as twice, 0.5::double as weight from embeddings e, range(64) c(i)")
def nd_chunk_broadcast(spark, sf_dir):
    """The flagship's cells, all arrays chunked on aligned grids: chunks meet by their origins."""
    e = _table(spark, sf_dir, "embeddings")
    n = e.count()
    labels = ch.chunk_table(e, ["vec_id"], [n], (64,), "label")
    twice = ch.chunk_table(spark.range(COMPONENTS).select("id", (2 * F.col("id")).alias("twice")), ["id"], [COMPONENTS], (16,), "twice")
    weight = spark.range(1).select(F.array(F.lit(0.5)).alias("values"))
    met = gr.broadcast_chunks(_embedding_chunks(spark, sf_dir, (64, 16)), VEC_COMP, {"label": (labels, ["vec"]), "twice": (twice, ["comp"]), "weight": (weight, [])})
    return gr.chunk_cells(met, VEC_COMP, {"values": VEC_COMP, "label": ["vec"], "twice": ["comp"], "weight": []}).withColumnRenamed("values", "value")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's batches, each array a view in the batch's common shape."""
    b = embedding_batches(spark, sf_dir)
    target = nd.nd_dimensions(F.col("value"))
    return b.select("block", vw.nd_view(F.col("value")).alias("value"), *[vw.nd_broadcast_view(F.col(c), target).alias(c) for c in ("vec_id", "label", "comp", "weight")])


@query("select vec_id // 256 as block, vec_id % 256 as row, c.i as col, embedding[c.i + 1] as value, vec_id, label, c.i as comp, 0.5::double as weight from embeddings e, range(64) c(i)")
def nd_view_table(spark, sf_dir):
    """Views of the common shape, flattened: cells are read through strides."""
    columns = dict.fromkeys(("value", "vec_id", "label", "comp", "weight"), 2)
    return vw.view_table(_views(spark, sf_dir), columns, keep=["block"], coordinates=["row", "col"])


@query("""with b as (select vec_id // 256 as block, count(*) as n from embeddings group by all),
g as (select b.block, n, r.i as o0, c.i as o1, row_number() over (partition by b.block order by r.i, c.i) - 1 as chunk_ordinal from b, range(0, 256, 100) r(i), range(0, 64, 20) c(i) where r.i < n)
select block, chunk_ordinal, o0, o1, least(100, n - o0) as s0, least(20, 64 - o1) as s1, least(100, n - o0)::int as held, r.i as row, c.i as col, label
from g, range(100) r(i), range(20) c(i), embeddings e where r.i < least(100, n - o0) and c.i < least(20, 64 - o1) and e.vec_id = block * 256 + o0 + r.i""")
def nd_view_chunks(spark, sf_dir):
    """A vector expanded to two dimensions and cut to chunks as a view: a chunk carries its part
    of the vector (``held`` values), not its cells."""
    cut = _views(spark, sf_dir).select("block", F.explode(vw.view_chunks(F.col("label"), (100, 20))).alias("c"))
    at = F.col("c.chunk_indices")
    told = cut.select("block", F.col("c.chunk_ordinal").alias("chunk_ordinal"), F.get(at, F.lit(0)).alias("o0"), F.get(at, F.lit(1)).alias("o1"), F.get("c.view.dimension_sizes", F.lit(0)).alias("s0"), F.get("c.view.dimension_sizes", F.lit(1)).alias("s1"), F.size("c.view.values").alias("held"), F.col("c.view").alias("label"))
    return vw.view_table(told, {"label": 2}, keep=["block", "chunk_ordinal", "o0", "o1", "s0", "s1", "held"], coordinates=["row", "col"])


@query("select vec_id as vec, c.i as comp, label, embedding[c.i + 1] as value from embeddings e, range(64) c(i)")
def nd_view_array(spark, sf_dir):
    """Views as arrays again."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", nd.nd_array(F.col("embedding"), ["comp"], [COMPONENTS]).alias("value"), nd.nd_scalar(F.col("label")).alias("label"))
    label = vw.view_array(vw.nd_broadcast_view(F.col("label"), nd.nd_dimensions(F.col("value"))), 1)
    cells = e.select("vec_id", F.posexplode(F.arrays_zip(label["values"].alias("label"), F.col("value.values").alias("value"))).alias("comp", "x"))
    return cells.select(F.col("vec_id").alias("vec"), F.col("comp").cast("long").alias("comp"), "x.label", "x.value")


def _chunk_store(spark: SparkSession, sf_dir: str, target: int = CHUNK_CELLS) -> dict[str, str]:
    """Stores of the embeddings and their labels, on grids planned from the table; their paths."""
    e = _table(spark, sf_dir, "embeddings")
    vec, comp = store.measure(e.select(F.col("vec_id").alias("vec"), (F.size("embedding") - 1).alias("comp")), VEC_COMP)
    grids = store.plan_grids({"value": [vec, comp], "label": [vec]}, target)
    folder = streaming.shared_folder(spark)
    value = ch.chunk_rows(e, ["vec_id"], [vec.size, comp.size], grids["value"].chunk_shape, "embedding")
    label = ch.chunk_table(e, ["vec_id"], [vec.size], grids["label"].chunk_shape, "label")
    for name, chunks in (("value", value), ("label", label)):
        store.write_store(chunks, f"{folder}/{name}", grids[name])
    return {name: f"{folder}/{name}" for name in grids}


_PLAN_SQL = f"""with n as (select max(vec_id) + 1 as n_vec, max(len(embedding))::bigint as n_comp from embeddings),
d as (select n_vec, n_comp, greatest(n_vec, n_comp) as largest from n),
s as (select *, power({CHUNK_CELLS}::double / ((n_vec / largest) * (n_comp / largest)), 0.5::double) as scale from d),
c as (select *, greatest(1, least(floor(n_vec / largest * scale), n_vec)) as v1, greatest(1, least(floor(n_comp / largest * scale), n_comp)) as c1, greatest(1, least(floor(n_vec / largest * scale * 2), n_vec)) as v2, greatest(1, least(floor(n_comp / largest * scale * 2), n_comp)) as c2 from s),
p as (select n_vec, n_comp, (case when v1 * c1 >= {CHUNK_CELLS // 2} then v1 when v2 * c2 >= {CHUNK_CELLS // 2} then v2 else n_vec end)::bigint as own_vec, (case when v1 * c1 >= {CHUNK_CELLS // 2} then c1 when v2 * c2 >= {CHUNK_CELLS // 2} then c2 else n_comp end)::bigint as chunk_comp from c),
plan as (select *, least(own_vec, n_vec, {CHUNK_CELLS}) as chunk_vec from p)
"""


@query(_PLAN_SQL + "select v.i as o0, c.i as o1, least(chunk_vec, n_vec - v.i) as s0, least(chunk_comp, n_comp - c.i) as s1, least(chunk_vec, n_vec - v.i) * least(chunk_comp, n_comp - c.i) as cells from plan, range(1000000) v(i), range(64) c(i) where v.i < n_vec and v.i % chunk_vec = 0 and c.i < n_comp and c.i % chunk_comp = 0")
def nd_auto_chunk(spark, sf_dir):
    """Dimensions measured in the table, a grid planned for them, chunks stored and read back."""
    chunks, _ = store.open_store(spark, _chunk_store(spark, sf_dir)["value"])
    return chunks.select("o0", "o1", "s0", "s1", F.size("values").cast("long").alias("cells"))


@query(_PLAN_SQL + "select 'value' as name, v.i as o0, least(chunk_vec, n_vec - v.i) as s0, (n_comp + chunk_comp - 1) // chunk_comp as chunks, n_comp * least(chunk_vec, n_vec - v.i) as cells from plan, range(1000000) v(i) where v.i < n_vec and v.i % chunk_vec = 0 union all select 'label', v.i, least(chunk_vec, n_vec - v.i), 1, least(chunk_vec, n_vec - v.i) from plan, range(1000000) v(i) where v.i < n_vec and v.i % chunk_vec = 0")
def nd_auto_chunk_aligned(spark, sf_dir):
    """Arrays that share a dimension are cut at the same places along it."""
    out = None
    for name, path in _chunk_store(spark, sf_dir).items():
        chunks, _ = store.open_store(spark, path)
        told = chunks.groupBy("o0", "s0").agg(F.count("*").alias("chunks"), F.sum(F.size("values")).alias("cells")).select(F.lit(name).alias("name"), "o0", "s0", "chunks", "cells")
        out = told if out is None else out.unionByName(told)
    return out


@query("select vec_id as vec, c.i as comp, embedding[c.i + 1] as value, label from embeddings e, range(64) c(i)")
def nd_auto_chunk_broadcast(spark, sf_dir):
    """Stores on aligned grids, broadcast chunk to chunk."""
    paths = _chunk_store(spark, sf_dir)
    (value, _), (label, _) = (store.open_store(spark, paths[c]) for c in ("value", "label"))
    met = gr.broadcast_chunks(value, VEC_COMP, {"label": (label, ["vec"])})
    return gr.chunk_cells(met, VEC_COMP, {"values": VEC_COMP, "label": ["vec"]}).withColumnRenamed("values", "value")


@query("select vec_id as vec, c.i as comp, embedding[c.i + 1] as value from embeddings e, range(64) c(i) where " + " and ".join(f"{c} >= {a} and {c} < {b}" for c, (a, b) in zip(("vec_id", "c.i"), REGION.values(), strict=True)))
def nd_chunk_region(spark, sf_dir):
    """A box of a stored array; row groups without it aren't read, chunks at its edge trimmed."""
    part = store.read_region(spark, _chunk_store(spark, sf_dir)["value"], REGION)
    return ch.unchunk(part, VEC_COMP, "value")


@query(ORACLES["nd_chunk_values"])
def nd_rechunk(spark, sf_dir):
    """From the grid (70, 24) to (64, 16): slices of lines move."""
    e = _table(spark, sf_dir, "embeddings")
    moved = gr.rechunk(_embedding_chunks(spark, sf_dir, (70, 24)), [e.count(), COMPONENTS], (64, 16))
    return moved.select("o0", "o1", F.posexplode("values").alias("pos", "value"))


_MILLIONTHS = "select vec_id as i, c.i as j, case when vec_id % 7 = 0 and c.i % 5 = 0 then null else floor(embedding[c.i + 1]::double * 1000000)::bigint end as v from embeddings, range(64) c(i)"


@query(f"select j as comp, count(v) as n, count(*) - count(v) as nulls, sum(v)::bigint as total, min(v) as least, max(v) as most, sum(v)::double / count(v) as mean from ({_MILLIONTHS}) group by j")
def nd_chunk_mean(spark, sf_dir):
    """Sums over the vectors for each component: within chunks, then over them."""
    e = _table(spark, sf_dir, "embeddings")
    cells = F.transform("embedding", lambda v, j: F.when((F.col("vec_id") % 7 == 0) & (j % 5 == 0), None).otherwise(F.floor(v.cast("double") * 1000000)))
    chunks = ch.chunk_rows(e.select("vec_id", cells.alias("v")), ["vec_id"], [e.count(), COMPONENTS], (64, 16), "v")
    summed = gr.reduce_chunks(chunks, 2, 0)
    places = summed.select("o0", F.posexplode(F.arrays_zip("n", "nulls", "sum", "least", "most")).alias("pos", "x"))
    return places.select((F.col("o0") + F.col("pos")).alias("comp"), "x.n", "x.nulls", F.col("x.sum").alias("total"), "x.least", "x.most", (F.col("x.sum").cast("double") / F.col("x.n")).alias("mean"))
