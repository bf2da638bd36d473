"""Shared plumbing: the cluster's shared folder, written intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes a function sees at once: Spark's Arrow batches are cut to these inside the
#: function. A batch itself is at most ``BATCH_BYTES``, where the session sets no bound of its
#: own: Spark's 64 MB, doubled while they are filled, took 400 MB of an executor of two cores.
ARROW_ROWS, ARROW_BYTES, BATCH_BYTES = 1000, 4 << 20, 8 << 20
#: Rows (a place in a file, some 100 bytes in memory) that may be broadcast.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's own.

    Only where neither is set (tests on one machine) a temporary folder is made.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediates. Results not yet written read from them, so
    call it when the work is done; token files and archives without a path go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors then cost a reread of files, never a recomputation of the past.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is files, projected and filtered: rows have a place of their own."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.children().size():
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def column(name: str) -> Column:
    """The column called so, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str, column: str = "__row") -> DataFrame:
    """``df`` with ``column`` (see ``fresh``), the same however often and on whatever
    executors it is read: the row's file and place in it. What isn't read from files is
    written first."""
    if not _plain_scan(df):
        df = written(df, name)
    return df.withColumn(column, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has: one value, whatever runs."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        if step >= batch.num_rows:
            yield batch
        else:
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()


def without(df: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``df`` without the rows whose ``row`` is in ``gone`` (a written table of one column):
    it is broadcast while it has at most ``BROADCAST_ROWS`` rows, so texts stay where they
    are, else joined."""
    gone = gone.toDF(row)
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, row, "left_anti")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``fn`` over each batch of at most ``ARROW_ROWS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return map_arrow_stream(df, run, schema)


def map_arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` over batches of the size the operators here count on."""
    bound_batches(df.sparkSession)
    names = df.columns
    if any("." in c or "`" in c for c in names):  # which mapInArrow takes for parts of columns
        df = df.toDF(*[f"c{i}" for i in range(len(names))])
        return df.mapInArrow(lambda batches: fn(slices((b.rename_columns(names) for b in batches), rows)), schema)
    return df.mapInArrow(lambda batches: fn(slices(batches, rows)), schema)


def appended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """``df``'s schema with ``fields`` at its end, replacing columns of the same name."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + list(fields))


def with_columns(batch: pa.RecordBatch, schema: T.StructType, **values: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns, in the order of ``schema``."""
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) if f.name in values else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in fields], schema=fields)


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A column's texts as UTF-8; null is the empty text."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]
