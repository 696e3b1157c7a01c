"""Sparse cells in packed blocks, which meet vectors of their rows and columns: a vector is copied for blocks, not for cells.

Rows and columns are dealt to `parts` buckets by a hash, cells to blocks by both. The blocks are written once, dealt by their
numbers, so that a pass shuffles the vectors and a partial sum for each row of a block, never the cells.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..plans.lineage import bucketed

BLOCK_CELLS, BLOCK_IDS = 4_000_000, 100_000  # cells and ids of one side that a block is meant to have
FEW_CELLS = 250_000  # more than these are dealt to four blocks at least
PIECE_CELLS = 1_000_000  # a block is packed in pieces of about so many cells
CHUNK = 65_536  # cells whose vectors are in hand at once
PIECES = "_bu int, _bv int, rows array<string>, cols array<string>, r binary, c binary, x binary"


@dataclass(frozen=True)
class CellBlocks:
    """Cells other than 0, packed; `flipped` is the transpose of the same table."""

    table: DataFrame
    parts: int
    turned: bool = False

    def flipped(self) -> "CellBlocks":
        return CellBlocks(self.table, self.parts, not self.turned)


def _bucket(column, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.asarray(coded.indices, np.int32), coded.dictionary


def _pack(key, batches, most):
    held, size = [], 0

    def piece():
        t = pa.Table.from_batches(held)
        (r, rows), (c, cols) = _codes(t.column("row")), _codes(t.column("col"))
        order = np.argsort(r, kind="stable")
        x = np.asarray(t.column("value"), np.float64)
        values = [key[0].as_py(), key[1].as_py(), rows.to_pylist(), cols.to_pylist(), r[order].tobytes(), c[order].tobytes(), x[order].tobytes()]
        types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["_bu", "_bv", "rows", "cols", "r", "c", "x"])
    for batch in batches:
        held.append(batch.select(["row", "col", "value"]))
        size += batch.num_rows
        if size >= most:
            yield piece()
            held, size = [], 0
    if size:
        yield piece()


def _packer(most: int):
    """_pack as Spark calls it: the type hints say that a group comes in batches."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(key, batches, most)
    return run


def cell_blocks(cells: DataFrame, size: int, ids: int) -> CellBlocks:
    """The cells (row, col, value) other than 0 as blocks; `size` is the number of cells and `ids` that of rows or columns, whichever are more."""
    parts = max(1 if size <= FEW_CELLS else 2, math.ceil(math.sqrt(size / BLOCK_CELLS)), math.ceil(ids / BLOCK_IDS))
    dealt = cells.filter("value <> 0").select(_bucket("row", parts).alias("_bu"), _bucket("col", parts).alias("_bv"), "row", "col", F.col("value").cast("double").alias("value"))
    packed = dealt.groupBy("_bu", "_bv").applyInArrow(_packer(PIECE_CELLS), PIECES)
    return CellBlocks(bucketed(packed, ["_bu", "_bv"], "cells"), parts)


def _found(ids: pa.Array, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id the number of its vectors and where these begin in the third array, of their places."""
    code = pc.index_in(known.column("_id").combine_chunks(), ids)
    hit = np.flatnonzero(np.asarray(pc.is_valid(code)))
    code = np.asarray(pc.fill_null(code, 0))[hit]
    times = np.bincount(code, minlength=len(ids))
    return times, np.cumsum(times) - times, hit[np.argsort(code, kind="stable")]


def _met(codes: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(places in codes, places of the vectors) of all that meet."""
    times, start, places = found
    n = times[codes]
    cell = np.repeat(np.arange(len(codes)), n)
    within = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
    return cell, places[start[codes[cell]] + within]


def cell_sums(blocks: CellBlocks, cols: DataFrame, fn, rows: DataFrame | None = None) -> DataFrame:
    """(id, vector): for each row the sum of fn(value, row vectors or None, column vectors) over its cells; fn returns a matrix with a row for each cell.

    `rows` and `cols` are (id, vector). Cells whose column, or row where `rows` is given, has no vector don't count, and rows without
    a cell that counts are left out.
    """
    turned, parts, paired = blocks.turned, blocks.parts, rows is not None
    own, other = ("_bv", "_bu") if turned else ("_bu", "_bv")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def side(vectors, number, at, across):
        return vectors.filter("id IS NOT NULL").select(F.lit(number).alias("_side"), _bucket("id", parts).alias(at), every.alias(across), F.col("id").alias("_id"), F.col("vector").alias("_vec"))
    sides = side(cols, 1, other, own)
    if paired:
        sides = sides.unionByName(side(rows, 0, own, other))

    def add(pieces: pa.Table, vectors: pa.Table) -> pa.Table:
        near, far = (vectors.filter(pc.equal(vectors.column("_side"), k)) for k in (0, 1))
        xs, ys = V.to_numpy(near.column("_vec")), V.to_numpy(far.column("_vec"))
        ids, sums = [], []
        for p in pieces.to_batches(max_chunksize=1):
            row_ids, col_ids = (p.column(n).flatten() for n in (("cols", "rows") if turned else ("rows", "cols")))
            r, c = (np.frombuffer(p.column(n)[0].as_buffer(), np.int32) for n in (("c", "r") if turned else ("r", "c")))
            value = np.frombuffer(p.column("x")[0].as_buffer(), np.float64)
            cell, y = _met(c, _found(col_ids, far))
            if paired:
                again, x = _met(r[cell], _found(row_ids, near))
                cell, y = cell[again], y[again]
            r = r[cell]
            order = np.argsort(r, kind="stable")
            total = None
            for at in range(0, len(order), CHUNK):
                here = order[at:at + CHUNK]
                got = fn(value[cell[here]], xs[x[here]] if paired else None, ys[y[here]])
                total = np.zeros((len(row_ids), got.shape[1])) if total is None else total
                first = np.flatnonzero(np.r_[True, np.diff(r[here]) != 0])
                total[r[here][first]] += np.add.reduceat(got, first, axis=0)
            if total is not None:
                used = np.unique(r)
                ids.append(row_ids.take(pa.array(used)))
                sums.append(total[used])
        if not ids:
            return pa.table({"id": pa.array([], pa.string()), "vector": pa.array([], pa.list_(pa.float64()))})
        return pa.table({"id": pa.concat_arrays(ids), "vector": V.to_arrow(np.vstack(sums))})
    parts_of = blocks.table.groupBy("_bu", "_bv").cogroup(sides.groupBy("_bu", "_bv")).applyInArrow(add, "id string, vector array<double>")
    return parts_of.groupBy("id").agg(V.sum_vectors("vector").alias("vector"))


def multiply_blocks(blocks: CellBlocks, vectors: DataFrame) -> DataFrame:
    """(id, vector) = sum over a row's cells of value * vector of the column, of either sign."""
    return cell_sums(blocks, vectors, lambda x, _, far: x[:, None] * far)
