"""Vector maths and clustering-feature maths.

Two forms of the same thing: Column expressions (stay in the JVM; right for
one row per topic) and Arrow kernels (one numpy call per batch; right for one
row per response, where interpreted array lambdas would dominate).

A clustering feature (CF) of a group of points is (n, ls, ss): the count, the
sum of the vectors and the sum of the squared norms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Column expressions ---------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def vec_divide(a: Column, divisor: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), divisor.cast("double")))


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, vec_divide(a, length)).otherwise(
        F.transform(a, lambda x: F.lit(0.0))
    )


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


# ---- vector aggregates (map-side combined in the JVM) ----------------------


def vec_sum(a: Column) -> Column:
    """Element-wise sum over the rows of a group; `a` must not be NULL."""
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(a))))


def vec_mean(a: Column) -> Column:
    """Element-wise mean over the rows of a group; `a` must not be NULL."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(a))))


def group_features(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The CF of every group: the keys with n, ls, ss.

    One aggregate buffer per group in the JVM, combined before the shuffle, so
    a group holding most of the rows still crosses the network as one row per
    input partition. `ss` comes from the per-dimension L2 norms of that buffer.
    """
    summary = Summarizer.metrics("count", "sum", "normL2").summary(
        array_to_vector(doubles(F.col(vector)))
    )
    norms = vector_to_array(F.col("s.normL2"))
    return (
        df.where(F.col(vector).isNotNull())
        .groupBy(*keys)
        .agg(summary.alias("s"))
        .select(
            *keys,
            F.col("s.count").alias("n"),
            vector_to_array(F.col("s.sum")).alias("ls"),
            F.aggregate(norms, F.lit(0.0), lambda acc, x: acc + x * x).alias("ss"),
        )
    )


# ---- clustering features ---------------------------------------------------


def cf_from_point(p: Column) -> Column:
    return F.struct(F.lit(1).cast("bigint").alias("n"), doubles(p).alias("ls"), dot(p, p).alias("ss"))


def cf_centroid(n: Column, ls: Column) -> Column:
    return vec_divide(ls, n)


def cf_radius(n: Column, ls_sq: Column, ss: Column) -> Column:
    """Radius from the count, the squared length of `ls`, and `ss`."""
    count = n.cast("double")
    return F.sqrt(
        F.greatest(F.lit(0.0), F.try_divide(ss, count) - F.try_divide(ls_sq, count * count))
    )


def cf_would_absorb(n: Column, ls: Column, ss: Column, p: Column, threshold: float) -> Column:
    """Would the radius stay within `threshold` (inclusive) after adding `p`?"""
    p_sq = dot(p, p)
    grown = dot(ls, ls) + 2 * dot(ls, p) + p_sq
    return cf_radius(n + 1, grown, ss + p_sq) <= F.lit(float(threshold))


def cf_absorb(n: Column, ls: Column, ss: Column, p: Column) -> Column:
    return F.struct(
        (n + 1).alias("n"), vec_add(ls, doubles(p)).alias("ls"), (ss + dot(p, p)).alias("ss")
    )


# ---- Arrow kernels ---------------------------------------------------------


def as_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array as (rows x dims float64, valid-row mask); NULL rows are zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    valid = ~np.asarray(vectors.is_null()) if vectors.null_count else np.ones(rows, dtype=bool)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    present = int(valid.sum())
    if present == 0:
        return np.zeros((rows, 0)), valid
    if flat.size % present or np.any(
        np.asarray(vectors.value_lengths().drop_null()) != flat.size // present
    ):
        raise ValueError("vectors of one column must all have the same dimension")
    matrix = flat.reshape(present, -1)
    if present < rows:
        full = np.zeros((rows, matrix.shape[1]))
        full[valid] = matrix
        matrix = full
    return matrix, valid


def as_list_array(matrix: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    rows, dims = matrix.shape
    offsets = np.arange(0, (rows + 1) * dims, dims, dtype=np.int32) if dims else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel(), type=kind)
    )


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 (zero rows stay zero), and the row lengths."""
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    safe = np.where(lengths > 0, lengths, 1.0)
    return matrix / safe[:, None], lengths


def once(kernel):
    """Marks a costly kernel so that the optimizer never evaluates it twice
    (as it would to push a filter on its result, or one inferred from an explode)."""
    return kernel.asNondeterministic()


@F.arrow_udf(T.DoubleType())
def sq_norm_kernel(v: pa.Array) -> pa.Array:
    matrix, valid = as_matrix(v)
    return pa.array(np.einsum("ij,ij->i", matrix, matrix), mask=~valid)


@F.arrow_udf(T.DoubleType())
def dot_kernel(a: pa.Array, b: pa.Array) -> pa.Array:
    left, left_ok = as_matrix(a)
    right, right_ok = as_matrix(b)
    if left.shape[1] == 0 or right.shape[1] == 0:
        return pa.nulls(len(a), pa.float64())
    return pa.array(np.einsum("ij,ij->i", left, right), mask=~(left_ok & right_ok))


@F.arrow_udf(T.DoubleType())
def cosine_kernel(a: pa.Array, b: pa.Array) -> pa.Array:
    left, left_ok = as_matrix(a)
    right, right_ok = as_matrix(b)
    if left.shape[1] == 0 or right.shape[1] == 0:
        return pa.nulls(len(a), pa.float64())
    left, _ = unit_rows(left)
    right, _ = unit_rows(right)
    return pa.array(np.einsum("ij,ij->i", left, right), mask=~(left_ok & right_ok))


@F.arrow_udf(T.DoubleType())
def along_kernel(v: pa.Array, direction: pa.Array) -> pa.Array:
    """Inner product of `v`, scaled to length 1, with `direction`."""
    rows, rows_ok = as_matrix(v)
    right, right_ok = as_matrix(direction)
    if rows.shape[1] == 0 or right.shape[1] == 0:
        return pa.nulls(len(v), pa.float64())
    rows, _ = unit_rows(rows)
    return pa.array(np.einsum("ij,ij->i", rows, right), mask=~(rows_ok & right_ok))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unit_kernel(v: pa.Array) -> pa.Array:
    matrix, valid = as_matrix(v)
    scaled, _ = unit_rows(matrix)
    out = as_list_array(scaled)
    if not valid.all():
        out = pa.compute.if_else(pa.array(valid), out, pa.scalar(None, out.type))
    return out
