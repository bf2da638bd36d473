"""Arrow tables and Parquet files of encoded batches.

Arrow producers of the format store sizes as unsigned 32-bit integers and may use unsigned
or nanosecond values, which Spark has no types for; they are cast on the way in (unsigned to
the next signed type, 64 bits to decimal(20, 0), nanoseconds to microseconds) and sizes are
range-checked on the way out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..errors import SizeOutOfRange
from ..functions.arrays import decode_batches, encode_batches
from ..functions.schema import METADATA_KEY, NAMES, SIZES, VALUES, check_marked, marked, nd_columns

_SIGNED = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def spark_type(kind: pa.DataType) -> pa.DataType:
    """The nearest Arrow type that Spark reads."""
    if kind in _SIGNED:
        return _SIGNED[kind]
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(spark_type(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, spark_type(f.type), True) for f in kind])
    if pa.types.is_large_string(kind):
        return pa.string()
    return kind


def converted(array: pa.Array, kind: pa.DataType) -> pa.Array:
    """``array`` as the type that Spark reads."""
    if array.type == kind:
        return array
    if pa.types.is_struct(array.type):
        fields = [converted(array.field(i), kind.field(i).type) for i in range(array.type.num_fields)]
        return pa.StructArray.from_arrays(fields, fields=[kind.field(i) for i in range(kind.num_fields)], mask=pc.is_null(array))
    if pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
        start = array.offsets[0].as_py() if len(array) else 0
        values = array.values.slice(start, (array.offsets[-1].as_py() - start) if len(array) else 0)
        offsets = pc.subtract(array.offsets, pa.scalar(start, array.offsets.type)).cast(pa.int32())
        return pa.ListArray.from_arrays(offsets, converted(values, kind.value_type), mask=pc.is_null(array))
    if pa.types.is_timestamp(array.type):
        return array.cast(kind, safe=False)
    if array.type == pa.uint64():
        return pa.array([x.as_py() for x in array], kind)
    return array.cast(kind)


def from_arrow(spark: SparkSession, table: pa.Table, need_metadata: bool = True, key: str = METADATA_KEY) -> DataFrame:
    """Encoded batches of an Arrow table. The value its schema has under ``key`` becomes the
    columns' metadata; give the key that the table's producer writes."""
    columns = []
    for field, column in zip(table.schema, table.columns, strict=True):
        kind = spark_type(field.type)
        columns.append(pa.chunked_array([converted(c, kind) for c in column.chunks], kind))
    df = spark.createDataFrame(pa.table(columns, names=table.schema.names))
    version = (table.schema.metadata or {}).get(key.encode())
    if version is not None:
        df = marked(df, nd_columns(df), key, version.decode())
    return decode_batches(df, need_metadata=need_metadata, key=key)


def to_arrow(df: DataFrame, columns: Sequence[str] | None = None, key: str = METADATA_KEY) -> pa.Table:
    """An Arrow table in the format's wire types, marked under ``key`` (the one its readers
    look for). For results the size of one machine; larger ones go through ``write_parquet``."""
    table = encode_batches(df, columns, key).toArrow()
    columns_out, fields = [], []
    for name, column in zip(table.schema.names, table.columns, strict=True):
        array = column.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
        if pa.types.is_struct(array.type) and {NAMES, SIZES, VALUES} <= {f.name for f in array.type}:
            sizes = array.field(SIZES)
            if len(sizes.values) and pc.min_max(sizes.values)["max"].as_py() is not None and not (0 <= pc.min_max(sizes.values)["min"].as_py() and pc.min_max(sizes.values)["max"].as_py() < 2**32):
                raise SizeOutOfRange("SIZE_OUT_OF_RANGE: dimension sizes are unsigned 32-bit integers in Arrow")
            array = pa.StructArray.from_arrays([array.field(NAMES), sizes.cast(pa.list_(pa.uint32())), array.field(VALUES)], names=[NAMES, SIZES, VALUES], mask=pc.is_null(array))
        columns_out.append(array)
        fields.append(pa.field(name, array.type))
    return pa.Table.from_arrays(columns_out, schema=pa.schema(fields, {key: __version__}))


def write_parquet(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error", key: str = METADATA_KEY) -> None:
    """Validated batches as Parquet; metadata travels with the fields."""
    encode_batches(df, columns, key).write.mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, need_metadata: bool = True, validate: bool = True, key: str = METADATA_KEY) -> DataFrame:
    """Batches back from Parquet. Validation reads whole arrays; without it a query that asks
    for one field of an array reads only that field."""
    df = spark.read.parquet(path)
    if validate:
        return decode_batches(df, columns, need_metadata, key)
    if need_metadata:
        check_marked(df, columns, key)
    return df
