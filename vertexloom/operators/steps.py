"""Step tables in packed blocks, which walkers meet: a step reads some bytes for an edge and neither decodes nor sorts rows.

A node's line of moves is dealt to blocks by (node, CHUNK slots), so a hub's walkers meet as many blocks as it has chunks. The blocks
are written once, dealt by their number: a step shuffles the walkers only. A block's walkers are one task's work and are not split: use this where
they are bounded. Uniform walks from every node of an undirected graph have as many on a node as rounds times its degree at most, on average.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import bucketed

CHUNK = 4096  # slots of a node that are in one block
BLOCK_ROWS, LEAST_ROWS = 1_000_000, 50_000  # rows of a block; smaller ones are made until each core has one
LZ4 = pa.ipc.IpcWriteOptions(compression="lz4")


def block_keys(spark: SparkSession, rows: int) -> list[int]:
    """Numbers of the blocks, for keys_apart."""
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, math.ceil(rows / BLOCK_ROWS), min(cores, rows // LEAST_ROWS))
    return keys_apart(spark, parts if parts < cores else cores * math.ceil(parts / cores))


def keys_apart(spark: SparkSession, parts: int) -> list[int]:
    """As many numbers as parts. Dealt by their hash into so many partitions, each goes to one of its own."""
    keys: dict[int, int] = {}
    size = 64
    while len(keys) < parts:
        size *= 2
        dealt = spark.range(size * parts).select(F.col("id").cast("int").alias("k"))
        keys = dict(dealt.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("part")).agg(F.min("k")).collect())
    return [keys[p] for p in range(parts)]


def _written(**columns) -> bytes:
    batch = pa.record_batch({name: x if isinstance(x, pa.Array) else pa.array(x) for name, x in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=LZ4) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(cell: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(cell.as_buffer()).read_next_batch()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.asarray(coded.indices, np.int64), coded.dictionary


def _found(ids: pa.Array, asked: pa.ChunkedArray) -> np.ndarray:
    """The place of each asked id among `ids`, -1 without one; null is never found."""
    return np.asarray(pc.fill_null(pc.index_in(asked.combine_chunks(), ids, skip_nulls=True), -1), np.int64)


def _of(hash_: Column, keys: list[int]) -> Column:
    """The block of a row, by a hash."""
    return F.element_at(F.lit(keys).cast("array<int>"), (F.pmod(hash_, F.lit(len(keys))) + 1).cast("int"))


def _chunk(slot) -> Column:
    return F.floor(F.col(slot) / F.lit(CHUNK)).cast("bigint")


def last_at_most(sorted_: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the last place in [low, high) of `sorted_` that is at most the value, or low."""
    while (wide := high - low > 1).any():
        mid = (low + high) // 2
        up = sorted_[mid] <= value
        low, high = np.where(wide & up, mid, low), np.where(wide & ~up, mid, high)
    return low


@dataclass(frozen=True)
class Steps:
    """Packed moves; `ends` are the columns that come with the node a move leads to."""

    table: DataFrame
    blocks: list[int]
    ends: StructType


def pack_steps(steps: DataFrame, rows: int) -> Steps:
    """Moves (src, slot, dst, lo, hi, next_*) as blocks. next_* depend on dst alone; `rows` says about how many moves there are."""
    blocks = block_keys(steps.sparkSession, rows)
    ends = [c for c in steps.columns if c.startswith("next_")]

    def pack(key: tuple, moves: pa.Table) -> pa.Table:
        node, keys = _codes(moves.column("src"))
        chunk, lo = (np.asarray(moves.column(c), np.int64) for c in ("_chunk", "lo"))
        order = np.lexsort((lo, chunk, node))
        at = np.column_stack([node, chunk, lo])[order]
        order = order[np.r_[True, (np.diff(at, axis=0) != 0).any(1)]]  # a move of several slots came for each of them
        node, chunk, moves = node[order], chunk[order], moves.take(order)
        first = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(chunk) != 0)])
        code, names = _codes(moves.column("dst"))
        one = np.unique(code, return_index=True)[1]
        known = {c: moves.column(c).take(one).combine_chunks() for c in ends}
        return pa.table({
            "_block": pa.array([key[0].as_py()], pa.int32()),
            "keys": [_written(key=keys)], "places": [_written(node=node[first], chunk=chunk[first], first=first)],
            "ends": [_written(dst=names, **known)],
            "moves": [_written(code=code.astype(np.int32), lo=lo[order])]})

    dealt = steps.filter("src IS NOT NULL AND dst IS NOT NULL").withColumn("_chunk", _chunk("slot"))
    dealt = dealt.select(_of(F.xxhash64("src", "_chunk"), blocks).alias("_block"), "src", "_chunk", "dst", "lo", *ends)
    packed = dealt.groupBy("_block").applyInArrow(pack, "_block int, keys binary, places binary, ends binary, moves binary")
    return Steps(bucketed(packed, ["_block"], "steps", len(blocks)), blocks, steps.select(*ends).schema)


def meet_steps(asked: DataFrame, steps: Steps) -> DataFrame:
    """Rows that ask by (_at_key, _at_slot, _t) with the move whose part of the line holds _t: adds dst and next_*, null without a move."""
    rest = [f for f in asked.schema if f.name not in ("_at_key", "_at_slot")]
    schema = StructType([*[f for f in rest if f.name != "_t"], *StructType().add("dst", "string"), *steps.ends])
    names, ends_of = [f.name for f in rest if f.name != "_t"], ["dst", *steps.ends.names]

    def move(walkers: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not walkers.num_rows:
            kinds = {f.name: {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()] for f in schema[len(names):]}
            return pa.table({**{c: walkers.column(c) for c in names}, **{c: pa.nulls(walkers.num_rows, k) for c, k in kinds.items()}})
        keys, places, ends, moves = (_read(block.column(c)[0]) for c in ("keys", "places", "ends", "moves"))
        node = _found(keys.column("key"), walkers.column("_at_key"))
        first = np.r_[np.asarray(places.column("first")), moves.num_rows]
        chunk = np.asarray(walkers.column("_chunk"), np.int64)
        known = (np.asarray(places.column("node")) << 32) + np.asarray(places.column("chunk"))
        want = (node << 32) + chunk
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = (node >= 0) & (chunk >= 0) & (known[at] == want)
        point = np.asarray(pc.fill_null(walkers.column("_t"), -1), np.int64)
        at = last_at_most(np.asarray(moves.column("lo")), first[at], first[at + 1], point)
        row = pa.array(at, mask=~(hit & (point >= 0)))
        code = moves.column("code").take(row)
        return pa.table({**{c: walkers.column(c) for c in names}, **{c: ends.column(c).take(code) for c in ends_of}})

    chunk = _chunk("_at_slot")
    sent = asked.select(*[f.name for f in rest], "_at_key", chunk.alias("_chunk"), _of(F.xxhash64("_at_key", chunk), steps.blocks).alias("_block"))
    return sent.repartition(len(steps.blocks), "_block").groupBy("_block").cogroup(steps.table.groupBy("_block")).applyInArrow(move, schema)
