"""Errors of the array engine. Data-dependent ones carry their code in the message."""

from __future__ import annotations


class NdError(ValueError):
    code = "ND_ERROR"


class InvalidShapes(NdError):
    code = "INVALID_SHAPES"


class NoBroadcastShape(NdError):
    code = "NO_BROADCAST_SHAPE"


class UnsupportedType(NdError):
    code = "UNSUPPORTED_TYPE"


class NoDimensionNames(NdError):
    code = "NO_DIMENSION_NAMES"


class NoDimensionSizes(NdError):
    code = "NO_DIMENSION_SIZES"


class NoValues(NdError):
    code = "NO_VALUES"


class NullDimension(NdError):
    code = "NULL_DIMENSION"


class DimensionSizeMismatch(NdError):
    code = "DIMENSION_SIZE_MISMATCH"


class ShapeAndLengthMismatch(NdError):
    code = "SHAPE_AND_LENGTH_MISMATCH"


class ListExpected(NdError):
    code = "LIST_EXPECTED"


class StructExpected(NdError):
    code = "STRUCT_EXPECTED"


class MissingEncodingMetadata(NdError):
    code = "MISSING_ENCODING_METADATA"


class UnsupportedEncodingVersion(NdError):
    code = "UNSUPPORTED_ENCODING_VERSION"


class ChunkShapeMismatch(NdError):
    code = "CHUNK_SHAPE_MISMATCH"


class SizeOutOfRange(NdError):
    code = "SIZE_OUT_OF_RANGE"
