"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector is padded to ``bits`` dimensions and rotated by a seeded random orthogonal
matrix; its code is the sign bits of the result. With o' the code's corner (entries
±1/sqrt(bits)) and o the rotated vector, ``<o', q> / <o', o>`` estimates ``<o, q>`` without
bias, and its error is at most ``EPSILON * sqrt((1 - <o',o>^2) / <o',o>^2) / sqrt(bits - 1)``
but for rare exceptions. Stored per vector: the packed bits, and as correction scalars
``1 / <o', o>`` and that error.

Search compares blocks of queries with blocks of vectors. In a pair of blocks the estimates
come from the packed bits alone; the best few are computed exactly, and every vector whose
upper bound reaches the k-th best exact value is reranked by the exact measure on the
original vectors, which travel with their codes (fetching survivors by another join would
move more: here some 2 % of the vectors reach the bound). Each pair of blocks returns at most
k per query, which merge into the result. Blocks have a bounded size, so memory is bounded at
every scale; every vector is coded and compared, nothing is sampled or left out.

Edge cases: null vectors, vectors of another length than most, zero vectors and those with
null or non-finite components take no part; null ids take no part; repeated ids are
candidates of their own, but never of a query of the same id, and are asked once per row;
ties go to the smaller id; with fewer candidates than k all are returned; components from
1e-300 to 1e300 don't overflow; a very long vector has a code as long; an empty table gives
no rows. Extra columns are ignored, whatever their names (texts play no part).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, written

#: Length of a code at least (vectors are padded), rows of a block, the bounds' width. A vector
#: is sent once for each block of queries, so these are large; a block's codes are unpacked
#: once, to a byte a bit, and multiplied ``CHUNK`` vectors at a time.
MIN_BITS, BASE_BLOCK, QUERY_BLOCK, CHUNK, EPSILON, SEED = 256, 8192, 8192, 1024, 2.2, 20240

_rotations: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(dim x bits): the first rows of a random orthogonal matrix."""
    key = (dim, bits, seed)
    if key not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
        _rotations[key] = (q * np.sign(np.diag(r)))[:dim].astype(np.float32)
    return _rotations[key]


def code_length(dim: int) -> int:
    return max(MIN_BITS, -(-dim // 64) * 64)


def codes(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, 1 / <o', o> and the error bound of unit vectors."""
    o = unit.astype(np.float32) @ rotation(unit.shape[1], bits)
    align = np.abs(o).sum(1) / np.sqrt(np.float32(bits))
    align = np.clip(align, 1e-6, 1)
    error = EPSILON * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(np.float32(bits - 1))
    return np.packbits(o > 0, axis=1), 1 / align, error


def signs_of(packed: np.ndarray) -> np.ndarray:
    """Codes as rows of 1 and -1."""
    return np.unpackbits(packed, axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def estimates(query: np.ndarray, signs: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(queries x vectors) estimated inner products of rotated unit queries with codes."""
    return (query @ signs.T.astype(np.float32)) * (scale.astype(np.float32) / np.sqrt(np.float32(signs.shape[1])))


def _scaled(v: np.ndarray) -> np.ndarray:
    """``v`` in doubles, times powers of two that keep squares finite and change no cosine."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for equal vectors wherever they stand."""
    q, v = _scaled(query), _scaled(vectors)
    top, lengths = (v * q).sum(1), (v * v).sum(1)
    return top / (np.sqrt(lengths) * np.sqrt((q * q).sum()))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def index(df: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, code, scale, error) of every usable vector of length ``dim``."""
    rows = usable(df, id_col, vector_col).where(F.size("v") == dim)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("scale", T.FloatType()), T.StructField("error", T.FloatType())])
    bits = code_length(dim)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column(1), dim).astype(np.float64)
        v = _scaled(v) if len(v) else v
        packed, scale, error = codes(v / np.sqrt((v * v).sum(1, keepdims=True)), bits)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(error.astype(np.float32))], names=schema.names)

    return map_arrow(rows, run, schema)


def nearest(df: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest by cosine of each row that the SQL
    predicate ``is_query`` (over column ``id``) selects, among all rows of other ids."""
    lengths = usable(df, id_col, vector_col).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    bits = code_length(dim)
    coded = written(index(df, dim, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ann-codes")
    counts = coded.agg(F.count("*"), F.sum(F.expr(f"cast({is_query} as int)"))).first()
    n, m = -(-(counts[0] or 0) // BASE_BLOCK) or 1, -(-(counts[1] or 0) // QUERY_BLOCK) or 1

    # Pairs of blocks: each vector meets each query block once, each query each vector block.
    block = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    base = coded.select("id", "v", "code", "scale", "error", block(n).alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb"))
    asked = coded.where(is_query).select(F.col("id").alias("q_id"), F.col("row").alias("q_row"), F.col("v").alias("q_v"), block(m).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bb"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q_id, q_row = right["q_id"].to_numpy(), right["q_row"].to_numpy()
            raw_q = _matrix(right["q_v"].combine_chunks(), dim)
            order = np.argsort(left["id"].to_numpy(), kind="stable")
            ids = left["id"].to_numpy()[order]
            v = _matrix(left["v"].combine_chunks(), dim)[order]
            packed = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(order), bits // 8)[order]
            scale, error = left["scale"].to_numpy()[order], left["error"].to_numpy()[order]
            signs, big = signs_of(packed), _scaled(raw_q)
            unit = (big / np.sqrt((big * big).sum(1, keepdims=True))).astype(np.float32) @ rotation(dim, bits)
            est = np.empty((128, len(ids)), np.float32)
            for lo in range(0, len(q_id), 128):
                part = unit[lo : lo + 128]
                for c in range(0, len(ids), CHUNK):
                    est[: len(part), c : c + CHUNK] = estimates(part, signs[c : c + CHUNK], scale[c : c + CHUNK])
                for i in range(len(part)):
                    row, q = est[i], lo + i
                    row[ids == q_id[q]] = -np.inf
                    first = np.argpartition(-row, min(4 * k, len(row) - 1))[: 4 * k]
                    score = exact(raw_q[q], v[first])
                    score[ids[first] == q_id[q]] = -np.inf
                    worst = np.sort(score)[-k] if len(score) >= k else -np.inf
                    near = np.flatnonzero((row + error >= worst - 1e-6) & (row > -np.inf))
                    near = np.union1d(near, first[score > -np.inf])
                    score = exact(raw_q[q], v[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    out += [(int(q_id[q]), int(q_row[q]), int(ids[near[j]]), float(score[j])) for j in best]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "q_row": pa.array(columns[1], pa.int64()), "id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

    found = base.groupBy("bb", "qb").cogroup(asked.groupBy("bb", "qb")).applyInArrow(pair, "query_id long, q_row long, id long, score double")
    order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
