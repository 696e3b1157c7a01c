"""Vector helpers on ARRAY<DOUBLE> columns.

Short element-wise work stays in the JVM; products with a small dense matrix go through Arrow as one
numpy call for each batch. Sums and means of vectors use the ml Summarizer, which combines map-side.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def to_numpy(arr: pa.Array) -> np.ndarray:
    """Rows of one Arrow list column as a 2-D array (all rows have the same width)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    flat = np.asarray(arr.flatten(), dtype=np.float64)
    return flat.reshape(len(arr), -1) if len(arr) else flat.reshape(0, 0)


def to_arrow(mat: np.ndarray) -> pa.Array:
    """A 2-D array as one Arrow list column."""
    mat = np.ascontiguousarray(mat, dtype=np.float64)
    offsets = np.arange(0, mat.size + 1, mat.shape[1], dtype=np.int32) if mat.size else np.zeros(len(mat) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(mat.ravel()))


def row_map(fn):
    """Arrow function column -> column from a numpy function of row blocks."""
    @F.arrow_udf("array<double>")
    def apply(vec: pa.Array) -> pa.Array:
        return to_arrow(fn(to_numpy(vec))) if len(vec) else pa.array([], pa.list_(pa.float64()))
    return apply


def row_map2(fn):
    """As row_map, for a function of two row blocks."""
    @F.arrow_udf("array<double>")
    def apply(left: pa.Array, right: pa.Array) -> pa.Array:
        return to_arrow(fn(to_numpy(left), to_numpy(right))) if len(left) else pa.array([], pa.list_(pa.float64()))
    return apply


def times(col, matrix: np.ndarray) -> Column:
    """Row vector times a small dense matrix."""
    return row_map(lambda x: x @ matrix)(col)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; zero rows stay zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a) -> Column:
    """Divide by the l2 norm; a zero vector stays zero."""
    a = F.col(a) if isinstance(a, str) else a
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def cosine(a, b) -> Column:
    """0 when a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sum_vectors(col, weight=None) -> Column:
    vec = array_to_vector(col)
    return vector_to_array(Summarizer.sum(vec, weight) if weight is not None else Summarizer.sum(vec))


def mean_vectors(col, weight=None) -> Column:
    vec = array_to_vector(col)
    return vector_to_array(Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec))


def max_vectors(col) -> Column:
    return vector_to_array(Summarizer.max(array_to_vector(col)))


def width(df, col) -> int:
    """The one vector width of the column; an error when rows disagree."""
    row = df.agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if row.lo is None:
        raise ValueError(f"{col}: no rows")
    if row.lo != row.hi:
        raise ValueError(f"{col}: widths from {row.lo} to {row.hi}")
    return row.lo
