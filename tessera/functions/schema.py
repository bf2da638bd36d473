"""Types: the struct of an encoded array, schema translation, encoding metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..errors import DimensionSizeMismatch, ListExpected, MissingEncodingMetadata, NoDimensionNames, NoDimensionSizes, NoValues, StructExpected, UnsupportedEncodingVersion, UnsupportedType

#: The fields of an encoded array.
NAMES, SIZES, VALUES = "dimension_names", "dimension_sizes", "values"
#: Metadata key that marks a field as encoded. Other producers use keys of their own: every
#: function that reads or writes metadata takes the key as a parameter.
METADATA_KEY = "nd-array-schema"

#: Element types other engines of the format support; Spark's others are accepted unless strict.
STRICT_TYPES = (T.NullType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)


def quoted(name: str) -> Column:
    """The column called so, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, or it with underscores before it until none of ``taken`` is called so."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def check_element_type(kind: T.DataType) -> None:
    unsigned = isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0)  # 64 bits without sign
    if not isinstance(kind, STRICT_TYPES) and not unsigned:
        raise UnsupportedType(f"UNSUPPORTED_TYPE: {kind.simpleString()}")


def nd_type(element: T.DataType | str, contains_null: bool = True, strict: bool = False) -> T.StructType:
    """The type of an encoded array."""
    kind = T._parse_datatype_string(element) if isinstance(element, str) else element
    if isinstance(kind, T.StructType) and isinstance(element, str) and len(kind) == 1 and kind.fieldNames() == ["value"]:
        kind = kind[0].dataType
    if strict:
        check_element_type(kind)
    return T.StructType([T.StructField(NAMES, T.ArrayType(T.StringType(), True), True), T.StructField(SIZES, T.ArrayType(T.LongType(), True), True), T.StructField(VALUES, T.ArrayType(kind, contains_null), True)])


def is_nd(kind: T.DataType) -> bool:
    try:
        check_nd(kind)
    except (DimensionSizeMismatch, ListExpected, NoDimensionNames, NoDimensionSizes, NoValues, StructExpected):
        return False
    return True


def check_nd(kind: T.DataType, name: str = "column") -> T.StructType:
    """``kind`` if it can hold encoded arrays, else the error that says what is missing."""
    if not isinstance(kind, T.StructType):
        raise StructExpected(f"STRUCT_EXPECTED: {name} is {kind.simpleString()}")
    fields = {f.name: f.dataType for f in kind.fields}
    for field, error in ((NAMES, NoDimensionNames), (SIZES, NoDimensionSizes), (VALUES, NoValues)):
        if field not in fields:
            raise error(f"{error.code}: {name} has no field {field}")
        if not isinstance(fields[field], T.ArrayType):
            raise ListExpected(f"LIST_EXPECTED: {name}.{field} is {fields[field].simpleString()}")
    if not isinstance(fields[NAMES].elementType, T.StringType):
        raise NoDimensionNames(f"NO_DIMENSION_NAMES: {name}.{NAMES} holds {fields[NAMES].elementType.simpleString()}")
    if not isinstance(fields[SIZES].elementType, T.IntegralType):
        raise NoDimensionSizes(f"NO_DIMENSION_SIZES: {name}.{SIZES} holds {fields[SIZES].elementType.simpleString()}")
    return kind


def element_type(df: DataFrame, column: str) -> T.DataType:
    return check_nd(df.schema[column].dataType, column)[VALUES].dataType.elementType


def nd_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_nd(f.dataType)]


def to_nd_schema(schema: T.StructType) -> T.StructType:
    """Each plain field becomes an encoded one; its nullability becomes the elements'."""
    return T.StructType([T.StructField(f.name, nd_type(f.dataType, f.nullable), False) for f in schema.fields])


def plain_field(name: str, kind: T.DataType) -> T.StructField:
    """The plain field of an encoded one: its elements' type and nullability."""
    values = check_nd(kind, name)[VALUES].dataType
    return T.StructField(name, values.elementType, values.containsNull)


def encoded_schema(schema: T.StructType, key: str = METADATA_KEY, version: str = __version__) -> T.StructType:
    """``to_nd_schema`` with the metadata that encoded batches carry; no data is needed."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {key: version}) for f in to_nd_schema(schema).fields])


def to_plain_schema(schema: T.StructType, strict: bool = False) -> T.StructType:
    """The inverse; fields that aren't encoded arrays are left out, or an error if strict."""
    out = []
    for f in schema.fields:
        values = next((x.dataType for x in f.dataType.fields if x.name == VALUES), None) if isinstance(f.dataType, T.StructType) else None
        if isinstance(values, T.ArrayType):
            out.append(T.StructField(f.name, values.elementType, values.containsNull))
        elif strict:
            check_nd(f.dataType, f.name)
    return T.StructType(out)


def compatible_version(version: str) -> bool:
    """Any version with numbers in it: the format has had one form so far."""
    return bool(re.fullmatch(r"\d+(\.\d+)*([-+.\w]*)", str(version)))


def marked(df: DataFrame, columns: Sequence[str] | None = None, key: str = METADATA_KEY, version: str = __version__) -> DataFrame:
    """``df`` with encoding metadata on its array columns."""
    schema = df.schema
    chosen = set(columns if columns is not None else [f.name for f in schema.fields if is_nd(f.dataType)])
    for c in chosen:
        check_nd(schema[c].dataType, c)
    return df.select(*[quoted(f.name).alias(f.name, metadata=(f.metadata or {}) | {key: version}) if f.name in chosen else quoted(f.name) for f in schema.fields])


def check_marked(df: DataFrame, columns: Sequence[str] | None = None, key: str = METADATA_KEY) -> list[str]:
    """The array columns, all of which must carry encoding metadata of a known version."""
    found = list(columns) if columns is not None else df.columns
    for c in found:
        version = (df.schema[c].metadata or {}).get(key)
        if version is None:
            raise MissingEncodingMetadata(f"MISSING_ENCODING_METADATA: {c} has no {key}")
        if not compatible_version(version):
            raise UnsupportedEncodingVersion(f"UNSUPPORTED_ENCODING_VERSION: {version}")
    return found


def schema_rows(df_or_schema: DataFrame | T.StructType) -> list[tuple[int, str, str, bool]]:
    """(position, name, type, nullable) of each field."""
    schema = df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema
    return [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
