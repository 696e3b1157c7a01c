"""Decompositions in which only width-by-width matrices reach the driver.

The rows stay in Spark. What is collected is a Gram matrix, a mean or a triangular factor, whose
size depends on the number of columns and never on the number of rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..functions.hashing import draw
from ..plans.lineage import cut
from ..plans.skew import lookup
from .cells import cell_blocks, multiply_blocks

#: Up to this many columns the whole Gram matrix is summed up; wider rows go through block Lanczos steps.
GRAM_COLUMNS = 1024
#: These go on until the residual of each axis is below this part of the largest value; after so many passes without that they raise an error.
TOLERANCE, PASSES = 1e-7, 80
_TILE = 1 << 16


def matrix_sums(df: DataFrame, columns: list[str], fn, shapes: list[tuple], raw: tuple = ()) -> list[np.ndarray]:
    """Sum over all rows of the small matrices fn(*blocks) returns for a block of rows.

    `columns` are array columns, which reach fn as 2-D blocks, and as Arrow columns where named in `raw`. Each task sends one sum.
    """
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = np.concatenate([np.asarray(m, float).ravel() for m in fn(*[c if n in raw else V.to_numpy(c) for n, c in zip(columns, batch.columns)])])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([V.to_arrow(total[None, :])], names=["s"])

    # long sums are cut into tiles, so that no task adds up whole ones of many tasks; the driver gets every tile once
    whole = sum(int(np.prod(s)) for s in shapes)
    tiles = F.sequence(F.lit(0), F.lit(max(whole - 1, 0)), F.lit(_TILE))
    parts = df.select(*columns).mapInArrow(partial, "s array<double>")
    pieces = parts.select(F.explode(F.transform(tiles, lambda t: F.struct(t.alias("t"), F.slice("s", t + 1, F.lit(_TILE)).alias("s")))).alias("p"))
    sums = pieces.groupBy("p.t").agg(V.sum_vectors("p.s").alias("s")).orderBy("t").collect() if whole else []
    flat = np.concatenate([np.array(r.s) for r in sums]) if sums else np.zeros(whole)
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def gram(df: DataFrame, left: str, right: str | None = None) -> np.ndarray:
    """Sum of outer products of the two vectors of a row."""
    right = right or left
    shape = (V.width(df, left), V.width(df, right))
    return matrix_sums(df, [left, right], lambda a, b: [a.T @ b], [shape])[0]


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive, so that results can be repeated."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _axes(matrix: np.ndarray, k: int):
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values)[:k]
    return np.maximum(values[order], 0.0), _fixed_signs(vectors[:, order])


def _checked_width(df: DataFrame, column: str, k: int) -> int:
    cols = V.width(df, column)
    if k > cols:
        raise ValueError(f"{k} components wanted from {cols} columns")
    return cols


def _wide_axes(attrs: DataFrame, column: str, cols: int, k: int, mean: np.ndarray, oversample: int = 20, seed: int = 0, tolerance: float | None = None, passes: int | None = None):
    """Squared singular values and right vectors of the rows less `mean`, by block Lanczos steps with restarts.

    A pass multiplies the columns-by-columns product with a block of vectors: sum of x (x Q) over the rows, a columns-by-(k + oversample) sum.
    The block joins a basis of at most eight, whose best axes are known with their residuals |A v - value v|; the next block is made of these
    residuals. When the basis is full, its best axes alone go on.
    """
    tolerance, passes = TOLERANCE if tolerance is None else tolerance, passes or PASSES
    width = min(k + oversample, cols)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((cols, width)))[0]
    basis, image, worst = np.zeros((cols, 0)), np.zeros((cols, 0)), np.inf
    for _ in range(passes):
        product = matrix_sums(attrs, [column], lambda x, q=q: [(x - mean).T @ ((x - mean) @ q)], [(cols, q.shape[1])])[0]
        basis, image = np.hstack([basis, q]), np.hstack([image, product])
        small = basis.T @ image
        found, mix = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found)[:width]
        axes, moved, values = basis @ mix[:, order], image @ mix[:, order], found[order]
        rest = moved - axes * values
        worst = np.linalg.norm(rest[:, :k], axis=0).max() / max(values[0], 1e-300)
        if worst <= tolerance or values[0] <= 0:
            return np.maximum(values[:k], 0.0), _fixed_signs(axes[:, :k])
        if basis.shape[1] + width > min(8 * width, cols):
            basis, image = axes, moved
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        q, size = np.linalg.qr(rest)
        q = q[:, np.abs(np.diag(size)) > 1e-13 * values[0]]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    raise ValueError(f"{passes} passes leave a residual of {worst:.1e} of the largest value; {tolerance:.1e} is wanted")


def truncated_svd(attrs: DataFrame, k: int, column: str = "features") -> tuple[DataFrame, np.ndarray]:
    """(id, vector = U*S) with k components, not centred, and the singular values."""
    cols = _checked_width(attrs, column, k)
    values, axes = _axes(gram(attrs, column), k) if cols <= GRAM_COLUMNS else _wide_axes(attrs, column, cols, k, np.zeros(cols))
    return attrs.select("id", V.times(F.col(column), axes).alias("vector")), np.sqrt(values)


def pca(attrs: DataFrame, k: int, column: str = "features") -> DataFrame:
    """(id, vector): centred rows on the k axes of largest variance."""
    cols = _checked_width(attrs, column, k)
    if cols <= GRAM_COLUMNS:
        total, outer, n = matrix_sums(attrs, [column], lambda x: [x.sum(0), x.T @ x, np.array([len(x)])], [(cols,), (cols, cols), (1,)])
        mean = total / n[0]
        _, axes = _axes(outer - n[0] * np.outer(mean, mean), k)
    else:
        total, n = matrix_sums(attrs, [column], lambda x: [x.sum(0), np.array([len(x)])], [(cols,), (1,)])
        mean = total / n[0]
        _, axes = _wide_axes(attrs, column, cols, k, mean)
    return attrs.select("id", V.row_map(lambda x: (x - mean) @ axes)(F.col(column)).alias("vector"))


def dim_reduction(attrs: DataFrame, dim: int, method: str = "pca", column: str = "features") -> DataFrame:
    if method == "pca":
        return pca(attrs, dim, column)
    if method == "svd":
        return truncated_svd(attrs, dim, column)[0]
    raise ValueError("method is pca or svd")


def svd_features(attrs: DataFrame, limit: int = 200, column: str = "features") -> DataFrame:
    """Features as they are up to `limit` columns, else U*S with `limit` components."""
    if V.width(attrs, column) <= limit:
        return attrs.select("id", F.col(column).alias("features"))
    return truncated_svd(attrs, limit, column)[0].withColumnRenamed("vector", "features")


def hash_uniform(keys: np.ndarray, dim: int) -> np.ndarray:
    """Values in (0, 1) from integer keys; the same key gives the same row everywhere."""
    with np.errstate(over="ignore"):
        x = (keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
             + np.arange(1, dim + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def hash_normal(keys: np.ndarray, dim: int) -> np.ndarray:
    """Standard normal values, by the Box-Muller transform."""
    u = hash_uniform(keys, 2 * dim)
    return np.sqrt(-2.0 * np.log(u[:, :dim])) * np.cos(2.0 * np.pi * u[:, dim:])


def random_vectors(ids: DataFrame, dim: int, seed, scale: float = 1.0, uniform: bool = False, key: str = "id") -> DataFrame:
    """(id, vector) with repeatable normal values, or values that are uniform in (-1, 1), times scale."""
    @F.arrow_udf("array<double>")
    def make(h: pa.Array) -> pa.Array:
        keys = np.asarray(h, dtype=np.int64)
        if not len(keys):
            return pa.array([], pa.list_(pa.float64()))
        return V.to_arrow((2.0 * hash_uniform(keys, dim) - 1.0 if uniform else hash_normal(keys, dim)) * scale)
    return ids.select(F.col(key).alias("id"), make(draw(key, seed=seed)).alias("vector"))


def multiply(cells: DataFrame, vectors: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(id, vector) = sum over a row's cells of value * vector of the column, of either sign.

    Rows without a cell other than 0 are left out.
    """
    rows = lookup(cells.filter("value <> 0"), "col", vectors, "id", {"vector": "vector"}, ["row"], counts=counts)
    scaled = F.transform("vector", lambda x: x * F.col("value"))
    return rows.groupBy(F.col("row").alias("id")).agg(V.sum_vectors(scaled).alias("vector"))


def flipped(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def _orthonormal(rows: DataFrame, name: str) -> DataFrame:
    """Rows times the inverse Cholesky factor of their Gram matrix (through its eigenvectors)."""
    rows = cut(rows, name)
    values, axes = np.linalg.eigh(gram(rows, "vector"))
    keep = values > values.max() * 1e-12
    factor = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    mix = axes * factor
    return rows.select("id", V.times(F.col("vector"), mix).alias("vector"))


def svd_cells(cells: DataFrame, k: int, power: float = 1.0, iterations: int = 2, oversample: int = 10,
              seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, vector = U * S^power) of a sparse matrix, and S.

    Randomised subspace iteration: in each pass packed blocks of the cells meet a narrow vector table.
    Rows without cells are left out (their vector is zero).
    """
    cells = cut(cells.select("row", "col", "value").filter("value <> 0"), "cells")
    cols = cut(cells.select("col").distinct(), "cols")
    n_cols, n_rows = cols.count(), cells.select("row").distinct().count()
    width = min(k + oversample, n_cols, n_rows)
    if k > width:
        raise ValueError(f"{k} components wanted from a matrix of rank at most {width}")
    blocks = cell_blocks(cells, cells.count(), max(n_cols, n_rows))
    back = blocks.flipped()
    side = random_vectors(cols, width, f"{seed}|svd", key="col")
    for _ in range(iterations):
        rows = _orthonormal(multiply_blocks(blocks, side), "svd")
        side = _orthonormal(multiply_blocks(back, rows), "svd")
    rows = cut(_orthonormal(multiply_blocks(blocks, side), "svd"), "svd")
    values, mix = _axes(gram(multiply_blocks(back, rows), "vector"), k)
    scale = np.sqrt(values)
    out = rows.select("id", V.times(F.col("vector"), mix * np.power(scale, power)).alias("vector"))
    return out, scale


def svd_scaled(cells: DataFrame, k: int, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """U * S^alpha with l2-normalised rows."""
    out, _ = svd_cells(cells, k, alpha, seed=seed)
    return out.withColumn("vector", V.unit_vector("vector"))


def zero_filled(ids: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """Every id with its vector, or zeros."""
    return ids.select("id").join(emb, "id", "left").withColumn(
        "vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)))
