"""Counts of the pairs that walks hold, with packed pairs in the shuffle.

A pair of places counts for both of its orders, so one is shuffled: the one whose centre comes first among the names. A task counts the pairs of
some HELD of its own first; they leave it sorted, by buckets of their centres, as steps of two bytes from one pair to the next. A bucket's pairs
are counted by one task: PAIRS about, however often they were seen. All pairs within the window are counted.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .steps import _read, _written, keys_apart

HELD = 8_000_000  # pairs that a task counts before it hands them on
PAIRS = 8_000_000  # pairs of a bucket as they are seen, at most about
SENT = 100_000  # rows of a batch


def _names(lists: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of the lists in order, null last, and the places of each list's values."""
    every = pa.concat_arrays(lists).unique()
    every = every.take(pc.sort_indices(every, null_placement="at_end"))
    return every, [np.asarray(pc.index_in(x, every), np.int64) for x in lists]


def _short(x: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of at least 0 as small ones, and those that are too large for that."""
    top = np.iinfo(kind).max
    return np.minimum(x, top).astype(kind), x[x >= top]


def _long(x: np.ndarray, over: np.ndarray) -> np.ndarray:
    out = x.astype(np.int64)
    out[x == np.iinfo(x.dtype).max] = over
    return out


def _summed(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each comes (or the sum of its n)."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if n is None:
        key = np.sort(key)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.diff(np.r_[first, len(key)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _counting(window: int, keys: list[int]):
    def pieces(held: list) -> Iterator[pa.RecordBatch]:
        names, at = _names([x for x, _ in held])
        size, found = len(names), []
        for (_, sizes), code in zip(held, at):
            walk = np.repeat(np.arange(len(sizes)), sizes)
            for d in range(1, min(window, max(0, int(sizes.max(initial=0)) - 1)) + 1):
                same = walk[d:] == walk[:-d]
                a, b = code[:-d][same], code[d:][same]
                found.append(np.minimum(a, b) * size + np.maximum(a, b))
        if not found:
            return
        key, n = _summed(np.concatenate(found), None)
        found.clear()
        centre = key // size
        bucket = np.array([zlib.crc32(x.encode()) % len(keys) if x is not None else 0 for x in names.to_pylist()], np.int64)
        order = np.argsort(bucket[centre], kind="stable")
        key, n, centre = key[order], n[order], centre[order]
        edge = np.searchsorted(bucket[centre], np.arange(len(keys) + 1))
        for k in range(len(keys)):
            here = slice(edge[k], edge[k + 1])
            if edge[k] == edge[k + 1]:
                continue
            mine = np.flatnonzero(bucket == k)
            local = np.searchsorted(mine, centre[here]) * size + key[here] % size
            step, far = _short(np.diff(local, prepend=0), np.uint16)
            count, many = _short(n[here], np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([keys[k]], pa.int32()), *[pa.array([x], pa.binary()) for x in (
                _written(name=names), _written(centre=mine.astype(np.int32)), _written(step=step, count=count), _written(far=far), _written(many=many))]],
                names=["_task", "names", "centres", "pairs", "far", "many"])

    def run(batches):
        held, seen = [], 0
        for batch in batches:
            paths = batch.column("path")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(paths), 0), np.int64)
            ends, low = np.cumsum(sizes) * window, 0
            while low < len(sizes):  # a batch of long walks is held in parts
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD - seen, "right")))
                part = paths.slice(low, high - low)
                held.append((part.flatten(), sizes[low:high]))
                seen += int(sizes[low:high].sum()) * window
                low = high
                if seen >= HELD or low < len(sizes):
                    yield from pieces(held)
                    held, seen = [], 0
        if held:
            yield from pieces(held)

    return run


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [tuple(_read(batch.column(c)[i]) for c in ("names", "centres", "pairs", "far", "many")) for batch in batches for i in range(batch.num_rows)]
    names, places = _names([p[0].column("name") for p in parts])
    pairs, counts = [], []
    for (own, centres, p, far, many), at in zip(parts, places):
        local = np.cumsum(_long(np.asarray(p.column("step")), np.asarray(far.column("far"))))
        size = own.num_rows
        a, b = at[np.asarray(centres.column("centre"))[local // size]], at[local % size]
        pairs.append(a * len(names) + b)
        counts.append(_long(np.asarray(p.column("count")), np.asarray(many.column("many"))))
    pairs, n = _summed(np.concatenate(pairs), np.concatenate(counts))
    a, b = np.divmod(pairs, len(names))
    for at in range(0, len(a), SENT):
        x, y, m = a[at:at + SENT], b[at:at + SENT], n[at:at + SENT]
        other = x != y
        centre, context = np.concatenate([x, y[other]]), np.concatenate([y, x[other]])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(centre)).cast(pa.string()), names.take(pa.array(context)).cast(pa.string()),
                                          pa.array(np.concatenate([np.where(other, m, 2 * m), m[other]]))], names=["centre", "context", "n"])


def pair_counts(walks: DataFrame, window: int = 10) -> DataFrame:
    """(centre, context, n): how often two places of a walk that are at most `window` apart hold these nodes; a node may be its own context.

    The walks are read twice.
    """
    spark = walks.sparkSession
    places = walks.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(places * window / PAIRS), min(spark.sparkContext.defaultParallelism, places * window // 100_000))
    keys = keys_apart(spark, parts)
    packed = walks.select("path").mapInArrow(_counting(window, keys), "_task int, names binary, centres binary, pairs binary, far binary, many binary")
    return packed.repartition(parts, "_task").groupBy("_task").applyInArrow(_merged, "centre string, context string, n bigint")
