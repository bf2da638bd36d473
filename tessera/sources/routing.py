"""Valid and invalid batches, told apart in one pass and kept in two places.

A row with a wrong array needn't fail a job: ``checked`` says of each row which of its arrays is
wrong first, why, and in which dimension; ``route`` writes a table once, as ``valid=true`` and
``valid=false``, and gives both parts back. Valid rows carry encoding metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionSizeMismatch, NullDimension, ShapeAndLengthMismatch
from ..functions.arrays import let, nd_error_code
from ..functions.schema import METADATA_KEY, NAMES, SIZES, check_nd, free_name, marked, quoted

#: The columns of a rejected row that say what is wrong.
WHERE, CODE, DIMENSION = "wrong_column", "error_code", "wrong_dimension"


def nd_error_dimension(a: Column) -> Column:
    """The first dimension that an array's error is about, from 0: the first with a null name
    or size, the first that has no partner, the first of negative size. Null for right arrays
    and for errors that no single dimension makes."""
    def first(bad: Column) -> Column:
        at = F.array_position(bad, True)
        return F.when(at > 0, (at - 1).cast("int"))

    nulls = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a[NAMES]), F.size(a[SIZES]), F.lit(1)) - 1), lambda i: ((i < F.size(a[NAMES])) & F.get(a[NAMES], i).isNull()) | ((i < F.size(a[SIZES])) & F.get(a[SIZES], i).isNull()))
    code = nd_error_code(a)
    return (
        F.when(code == NullDimension.code, first(nulls))
        .when(code == DimensionSizeMismatch.code, F.least(F.size(a[NAMES]), F.size(a[SIZES])))
        .when(code == ShapeAndLengthMismatch.code, first(F.transform(a[SIZES], lambda s: s < 0)))
    )


def checked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with three columns at its end: the first wrong array's column, its code and its
    dimension; all null where every array is right (or null)."""
    for c in columns:
        check_nd(df.schema[c].dataType, c)
    taken = [c for c in (WHERE, CODE, DIMENSION) if c.lower() in {x.lower() for x in df.columns}]
    if taken:
        raise ValueError(f"the table has columns {taken}")
    wrong = free_name(df.columns, "__wrong")
    each = F.array(*[F.struct(F.lit(c).alias("c"), nd_error_code(quoted(c)).alias("code"), nd_error_dimension(quoted(c)).alias("d")) for c in columns])
    told = df.withColumn(wrong, let(each, lambda x: F.get(F.filter(x, lambda e: e["code"].isNotNull()), F.lit(0))))
    return told.select(*map(quoted, df.columns), F.col(f"{wrong}.c").alias(WHERE), F.col(f"{wrong}.code").alias(CODE), F.col(f"{wrong}.d").alias(DIMENSION))


def route(df: DataFrame, path: str, columns: Sequence[str], key: str = METADATA_KEY, mode: str = "error") -> tuple[DataFrame, DataFrame]:
    """Writes ``df`` once, rows with wrong arrays apart, and reads both parts: (valid, rejected).

    Valid rows have the columns of ``df``, marked as encoded; rejected ones the three columns of
    ``checked`` too, to be looked at, mended or counted. The parts are folders, so reading
    one doesn't touch the other."""
    part = free_name([*df.columns, WHERE, CODE, DIMENSION], "valid")
    told = checked(df, columns)
    told.withColumn(part, F.col(CODE).isNull()).write.partitionBy(part).mode(mode).parquet(path)
    back = df.sparkSession.read.schema(T.StructType([*told.schema.fields, T.StructField(part, T.BooleanType())])).parquet(path)
    valid = back.where(F.col(part)).select(*map(quoted, df.columns))
    return marked(valid, list(columns), key), back.where(~F.col(part)).select(*map(quoted, told.columns))
