"""Products of sparse matrices on a grid of blocks.

The left matrix is dealt to buckets by row, the right one by column, and a task has one bucket of each, packed: it makes all cells of its
rows and columns. So the cells of the factors are shuffled, the left ones once for each bucket of columns and the right ones for each bucket of rows, and no
product is: these are as many as an inner index has cells on one side times those on the other, summed over all. A row and a column are in one task each,
but no task has more than its share of the cells of a hub's row or column on the other side, and an inner index is spread over all tasks.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .cells import PIECE_CELLS, PIECES, _bucket, _packer
from .steps import keys_apart

TASK_CELLS = 4_000_000  # cells of one side that a task is meant to have
LEAST_CELLS = 50_000  # cells of the left side below which a task isn't split for the sake of a free core
BUFFER = 4_000_000  # cells that are summed at once, and products that are made at once
SENT = 100_000  # cells of a batch
DENSE = 50  # a product by gathered cells takes as long as so many by whole rows
CELL = "row string, col string, value double"


def _joined(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of all lists, and for each list the places of its values."""
    every = pa.concat_arrays(lists).unique()
    return every, [np.asarray(pc.index_in(x, every), np.int64) for x in lists]


def _cells(pieces: list[tuple], places: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, value) of packed pieces, with the places of their ids."""
    return (np.concatenate([at[p[2]] for p, at in zip(pieces, places)]), np.concatenate([at[p[3]] for p, at in zip(pieces, others)]),
            np.concatenate([p[4] for p in pieces]))


def _starts(sorted_: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_, np.arange(n + 1))


def _gathered(r, mid, x, start, col, y, n_rows: int, n_cols: int):
    """(place, value) of the product's cells by groups of rows, place = row * n_cols + column; r is in order, y by `start` of its inner index."""
    rows = max(1, BUFFER // n_cols)
    total, some = np.zeros(rows * n_cols), np.zeros(rows * n_cols, bool)
    for first in range(0, n_rows, rows):
        low, high = np.searchsorted(r, [first, first + rows])
        times = np.diff(start)[mid[low:high]]
        ends = np.cumsum(times)
        at = 0
        while at < len(times):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BUFFER // 4, "right")))
            n, here = times[at:to], slice(low + at, low + to)
            cell = np.arange(n.sum()) + np.repeat(start[mid[here]] - (np.cumsum(n) - n), n)
            place = np.repeat((r[here] - first) * n_cols, n) + col[cell]
            np.add.at(total, place, np.repeat(x[here], n) * y[cell])
            some[place] = True
            at = to
        found = np.flatnonzero(some)
        yield found + first * n_cols, total[found]
        total[found], some[found] = 0.0, False


def _whole(r, mid, x, start, inner, y, n_rows: int, n_cols: int, n_mid: int):
    """The same by whole rows of the left side; y is by `start` of its column, and inner is its inner index."""
    rows = max(1, min(512, BUFFER // max(n_cols, n_mid)))
    sure = min(x.min(initial=1.0), y.min(initial=1.0)) > 1e-150  # else a cell may be there and 0
    for first in range(0, n_rows, rows):
        low, high = np.searchsorted(r, [first, first + rows])
        left = np.zeros((n_mid, rows))
        np.add.at(left, (mid[low:high], r[low:high] - first), x[low:high])
        out = np.zeros((n_cols, rows))
        some = None if sure else np.zeros((n_cols, rows), bool)
        if not sure:
            has = np.zeros((n_mid, rows), bool)
            has[mid[low:high], r[low:high] - first] = True
        for j in range(n_cols):
            here = inner[start[j]:start[j + 1]]
            out[j] = y[start[j]:start[j + 1]] @ left[here]
            if not sure:
                some[j] = has[here].any(0)
        out = np.ascontiguousarray(out.T).ravel()
        found = np.flatnonzero(out > 0 if sure else np.ascontiguousarray(some.T).ravel())
        yield found + first * n_cols, out[found]


def _multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [], []
    for batch in batches:
        for i in range(batch.num_rows):
            rows, cols = (batch.column(n).slice(i, 1).flatten() for n in ("rows", "cols"))
            r, c = (np.frombuffer(batch.column(n)[i].as_buffer(), np.int32) for n in ("r", "c"))
            sides[batch.column("_bu")[i].as_py()].append((rows, cols, r, c, np.frombuffer(batch.column("x")[i].as_buffer(), np.float64)))
    if not all(sides):
        return
    left, right = sides
    rows, row_at = _joined([p[0] for p in left])
    cols, col_at = _joined([p[1] for p in right])
    mids, mid_at = _joined([p[0] for p in right])
    b_mid, b_col, y = _cells(right, mid_at, col_at)
    known = mids.drop_null()
    a_at = [np.asarray(pc.fill_null(pc.index_in(p[1], mids, skip_nulls=True), -1), np.int64) for p in left]
    r, mid, x = _cells(left, row_at, a_at)
    kept = mid >= 0
    r, mid, x = r[kept], mid[kept], x[kept]
    if not len(r) or not len(known):
        return
    order = np.argsort(r, kind="stable")
    r, mid, x = r[order], mid[order], x[order]
    times = np.bincount(b_mid, minlength=len(mids))
    if times[mid].sum() * DENSE > len(rows) * len(y) and np.isfinite(y).all():
        order = np.argsort(b_col, kind="stable")
        made = _whole(r, mid, x, _starts(b_col[order], len(cols)), b_mid[order], y[order], len(rows), len(cols), len(mids))
    else:
        order = np.argsort(b_mid, kind="stable")
        made = _gathered(r, mid, x, _starts(b_mid[order], len(mids)), b_col[order], y[order], len(rows), len(cols))
    for place, value in made:
        for at in range(0, len(place), SENT):
            row, col = np.divmod(place[at:at + SENT], len(cols))
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(row)), cols.take(pa.array(col)), pa.array(value[at:at + SENT])], names=["row", "col", "value"])


def grid(a: int, b: int, cores: int) -> tuple[int, int]:
    """Buckets of rows and of columns for factors with so many cells."""
    rows, cols = max(1, math.ceil(a / TASK_CELLS)), max(1, math.ceil(b / TASK_CELLS))
    return max(rows, min(math.ceil(cores / cols), a // LEAST_CELLS)), cols


def block_product(a: DataFrame, b: DataFrame, a_cells: int, b_cells: int) -> DataFrame:
    """(row, col, value) of the product of cells without null values; the ids of a's rows and b's columns keep their types."""
    spark = a.sparkSession
    rows, cols = grid(a_cells, b_cells, spark.sparkContext.defaultParallelism)
    keys = F.lit(keys_apart(spark, rows * cols)).cast("array<int>")

    def packed(cells: DataFrame, side: int, by: str, parts: int) -> DataFrame:
        dealt = cells.select(F.lit(side).alias("_bu"), _bucket(by, parts).alias("_bv"), *[F.col(c).cast("string").alias(c) for c in ("row", "col")],
                             F.col("value").cast("double").alias("value"))
        return dealt.groupBy("_bu", "_bv").applyInArrow(_packer(PIECE_CELLS), PIECES)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed(a, 0, "row", rows).withColumn("_other", every(cols)).withColumn("_task", F.col("_bv") * cols + F.col("_other"))
    right = packed(b, 1, "col", cols).withColumn("_other", every(rows)).withColumn("_task", F.col("_other") * cols + F.col("_bv"))
    met = left.unionByName(right).withColumn("_task", F.element_at(keys, F.col("_task") + 1)).repartition(rows * cols, "_task")
    made = met.groupBy("_task").applyInArrow(_multiply, CELL)
    return made.select(F.col("row").cast(a.schema["row"].dataType), F.col("col").cast(b.schema["col"].dataType), "value")
