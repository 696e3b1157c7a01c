"""Walks in tasks that hold the whole step table: no shuffle for a step.

Where the lines of all nodes fit into a task, they are packed once, every task gets a copy, and the walkers are dealt to the tasks, which make all
steps of theirs. What is shuffled is the packed table times the tasks, whatever the length of a walk. Tables above CARRIED bytes are met step by
step (`walks.py`). Draws are those of `hashing.unit`, so the walks are the same.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import SPAN
from .steps import _of, _read, _written, keys_apart, last_at_most

CARRIED = 160_000_000  # bytes of the arrays of a task
UNIFORM, WEIGHTED, SECOND, NODE = 4, 12, 28, 40  # bytes for a move, by the kind of walk, and for a node
PACK_ROWS = 500_000  # moves of a packed block
WALKERS, PLACES = 20_000, 20_000_000  # walkers that move together, and places of all walks of a task
LEAST_WALKERS = 1_000  # walkers below which no further task is made
KINDS = MOVES, LINKS, EVEN, INDEX, WALK = range(5)
PIECE = "kind int, keys binary, rows binary"


def fits(moves: int, nodes: int, each: int) -> bool:
    return moves * each + nodes * NODE <= CARRIED


def units(heads: list[bytes], tails: list[bytes] | bytes) -> np.ndarray:
    """The draws in [0, 1) of the joined keys head + tail; one tail stands for all."""
    if isinstance(tails, bytes):
        digests = b"".join([hashlib.md5(h + tails).digest()[:8] for h in heads])
    else:
        digests = b"".join([hashlib.md5(h + t).digest()[:8] for h, t in zip(heads, tails)])
    return (np.frombuffer(digests, ">u8") >> np.uint64(12)).astype(np.float64) / float(SPAN)


def _pack(kind: int, key: str, columns: list[str]):
    """Rows with an id `key` and numbers or ids as a packed piece, sorted by the id and `lo`; a null id is -1."""
    def coded(column):
        column = column.combine_chunks()
        known = column.unique().drop_null().cast(pa.string())
        return np.asarray(pc.fill_null(pc.index_in(column, known, skip_nulls=True), -1), np.int32), known

    def run(group: tuple, table: pa.Table) -> pa.Table:
        code, names = coded(table.column(key))
        made = {}
        for c in columns:
            if pa.types.is_string(table.schema.field(c).type):
                made[c], made[f"{c}_names"] = coded(table.column(c))
            else:
                made[c] = np.asarray(table.column(c).combine_chunks())
        order = np.lexsort((made["lo"], code)) if "lo" in made else np.argsort(code, kind="stable")
        rows = {c: x[order] for c, x in made.items() if not c.endswith("_names")}
        rows = {"key": code[order], **rows}
        keys = _written(id=pa.concat_arrays([names, *[made[f"{c}_names"] for c in columns if f"{c}_names" in made]]))
        return pa.table({"kind": pa.array([kind], pa.int32()), "keys": pa.array([keys]), "rows": pa.array([_written(**rows, base=np.full(len(order), len(names), np.int32))])})
    return run


def packed(rows: DataFrame, kind: int, key: str, columns: list[str], count: int) -> DataFrame:
    """The rows as pieces: all of an id are in one."""
    parts = max(1, math.ceil(count / PACK_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part"), key, *columns)
    return dealt.groupBy("_part").applyInArrow(_pack(kind, key, columns), PIECE)


class Table:
    """The step table in a task: line i is the moves ptr[i] to ptr[i + 1] of node i, by where they begin."""

    def __init__(self, pieces: list[tuple], spread: int):
        lists = [_read(keys).column("id") for _, keys, _ in pieces]
        every = pa.concat_arrays([x.drop_null() for x in lists]).unique() if lists else pa.array([], pa.string())
        self.names, n = every, len(every)
        places = [np.append(np.asarray(pc.fill_null(pc.index_in(x, every, skip_nulls=True), -1), np.int64), -1) for x in lists]
        count, self.total, self.even = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for (kind, _, rows), at in zip(pieces, places):
            if kind == MOVES:
                count += np.bincount(at[np.asarray(rows_of(rows, "key"))], minlength=n)
        self.ptr = np.r_[0, np.cumsum(count)]
        m = int(self.ptr[-1])
        self.dst, self.lo, self.index = np.empty(m, np.int32), None, np.full(spread, -1, np.int64)
        links = []
        for (kind, _, rows), at in zip(pieces, places):
            t = _read(rows)
            key = at[np.asarray(t.column("key"))]
            if kind in (MOVES, LINKS):
                code = np.asarray(t.column("dst"))
                dst = np.where(code < 0, -1, at[np.where(code < 0, -1, code + np.asarray(t.column("base")))])
            if kind == MOVES:
                first = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
                size = np.diff(np.r_[first, len(key)])
                place = np.repeat(self.ptr[key[first]], size) + np.arange(len(key)) - np.repeat(first, size)
                self.dst[place] = dst
                if "hi" in t.schema.names:
                    self.lo = np.empty(m, np.int64) if self.lo is None else self.lo
                    self.lo[place] = np.asarray(t.column("lo"))
                    self.total[key[first]] = np.asarray(t.column("hi"))[first + size - 1]
                else:
                    self.total[key[first]] = size
            elif kind == LINKS:
                links.append((key, dst))
            elif kind == EVEN:
                self.even[key] = np.asarray(t.column("even"))
            elif kind == INDEX:
                self.index[np.asarray(t.column("idx"))] = key
        self.links = links

    def find(self, at: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The places of the moves that hold the points of the nodes' lines; all of these have moves."""
        if self.lo is None:
            return self.ptr[at] + point
        return last_at_most(self.lo, self.ptr[at], self.ptr[at + 1], point)

    def by_ends(self):
        """Sorts what has_edge and back need: all edges by both ends, and the place of each in the lines, -1 for those of no weight."""
        src = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        key, place = src * (len(self.names) + 1) + self.dst, np.arange(len(self.dst))
        for a, b in self.links:
            good = (a >= 0) & (b >= 0)
            key, place = np.r_[key, a[good] * (len(self.names) + 1) + b[good]], np.r_[place, np.full(good.sum(), -1)]
        order = np.argsort(key, kind="stable")
        self.edge_key, self.edge_place = key[order], place[order]

    def edge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is an edge from a to b, and its place in the line of a, or -1."""
        want = a * (len(self.names) + 1) + b
        if not len(self.edge_key):
            return np.zeros(len(want), bool), np.full(len(want), -1)
        at = np.minimum(np.searchsorted(self.edge_key, want), len(self.edge_key) - 1)
        hit = self.edge_key[at] == want
        return hit, np.where(hit, self.edge_place[at], -1)


def rows_of(packed_rows, column: str):
    return _read(packed_rows).column(column)


def _heads(rounds: np.ndarray, starts: list) -> list[bytes]:
    """What the keys of all draws of a walk begin with; a null id is left out of them."""
    return [f"{r}|".encode() if s is None else f"{r}|{s}|".encode() for r, s in zip(rounds.tolist(), starts)]


def first_order(table: Table, at: np.ndarray, heads: list[bytes], length: int, seed) -> tuple[np.ndarray, np.ndarray]:
    """(paths, steps): the nodes that the walkers come to after their starts, -1 after the end, and the number of the step of each."""
    path = np.full((len(at), max(0, length - 1)), -1, np.int32)
    live = np.flatnonzero(at >= 0)
    cur = at.copy()
    live = live[(table.total[cur[live]] > 0) | (table.even[cur[live]] > 0)]
    for step in range(1, length):
        if not len(live):
            break
        here, mine = cur[live], [heads[i] for i in live.tolist()]
        to = np.full(len(live), -1, np.int64)
        total = table.total[here]
        anywhere = np.zeros(len(live), bool)
        some = np.flatnonzero(table.even[here] > 0)
        if len(some):
            theirs = [mine[i] for i in some.tolist()]
            anywhere[some] = units(theirs, f"{step}|even|{seed}".encode()) < table.even[here[some]]
            some = np.flatnonzero(anywhere)
            node = np.floor(units([mine[i] for i in some.tolist()], f"{step}|node|{seed}".encode()) * len(table.index)).astype(np.int64)
            to[some] = table.index[node] if len(table.index) else -1
        line = np.flatnonzero(~anywhere & (total > 0))
        if len(line):
            u = units(mine if len(line) == len(mine) else [mine[i] for i in line.tolist()], f"{step}|{seed}".encode())
            to[line] = table.dst[table.find(here[line], np.floor(u * total[line]).astype(np.int64))]
        good = to >= 0
        live, to = live[good], to[good]
        path[live, step - 1] = to
        cur[live] = to
        live = live[(table.total[to] > 0) | (table.even[to] > 0)]
    return path, np.broadcast_to(np.arange(1, max(1, length)), path.shape)


def second_order(table: Table, at: np.ndarray, heads: list[bytes], length: int, seed, p: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for second-order walks, with the number of the pass of each; see `walks.node2vec_walks`."""
    path, when = (np.full((len(at), max(0, length - 1)), -1, np.int32) for _ in range(2))
    n, top = len(at), max(1.0, 1.0 / q)
    cur, prev = at.copy(), np.full(n, -1, np.int64)
    step, attempt, b_lo, b_hi = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(at >= 0)
    live = live[table.total[cur[live]] > 0] if length > 1 else live[:0]
    end, passes = table.total, 0
    while len(live):
        passes += 1
        here = cur[live]
        mine = [heads[i] + b"%d|%d|" % (s, a) for i, s, a in zip(live.tolist(), step[live].tolist(), attempt[live].tolist())]
        total, low = end[here], b_lo[live]
        gap = b_hi[live] - low
        rest, mass = total - gap, gap / float(p)
        returns = (gap > 0) & (rest <= 0)
        ask = np.flatnonzero((gap > 0) & (rest > 0))
        returns[ask] = units([mine[i] for i in ask.tolist()], f"back|{seed}".encode()) * (mass[ask] + rest[ask] * top) < mass[ask]
        drawn = np.floor(units(mine, str(seed).encode()) * rest).astype(np.int64)
        point = np.where(returns, low, np.where((gap > 0) & (drawn >= low), drawn + gap, drawn))
        to = table.dst[table.find(here, point)].astype(np.int64)
        whole = to >= 0  # an edge to a null id leads nowhere
        if not whole.all():
            live, here, mine, to, returns = live[whole], here[whole], [m for m, w in zip(mine, whole.tolist()) if w], to[whole], returns[whole]
        ok = returns | (prev[live] < 0)
        ask = np.flatnonzero(~ok)
        linked = table.edge(to[ask], prev[live[ask]])[0]
        ok[ask] = units([mine[i] for i in ask.tolist()], f"accept|{seed}".encode()) * top < np.where(linked, 1.0, 1.0 / q)
        attempt[live[~ok]] += 1
        moved, to, here = live[ok], to[ok], here[ok]
        path[moved, step[moved] - 1], when[moved, step[moved] - 1] = to, passes
        _, place = table.edge(to, here)
        has = place >= 0
        last = np.where(has, place + 1 == table.ptr[to + 1], False)
        b_lo[moved] = np.where(has, table.lo[place], 0)
        b_hi[moved] = np.where(has, np.where(last, end[to], table.lo[np.minimum(place + 1, len(table.lo) - 1)]), 0)
        step[moved] += 1
        attempt[moved], prev[moved], cur[moved] = 0, here, to
        live = live[(step[live] < length) & (table.total[cur[live]] > 0)]
    return path, when


def _repeated(start, path: list, when: list, times: int, segment: int, last: int) -> list:
    """The path of a start that comes several times: its segments, each as often."""
    out, now, before = [], [start], 0
    for mark in sorted({*range(segment, max(when, default=0) + segment, segment), last}):
        out += (now + [x for x, w in zip(path, when) if before < w <= mark]) * times
        now, before = [], mark
    return out


def carried_walks(nodes: DataFrame, pieces: DataFrame, num_walks: int, walk_length: int, seed, segment: int, spread: int = 0, second: tuple | None = None) -> DataFrame:
    """(round, start, path) of the walks from all nodes over packed pieces; `spread` is the number of nodes of the index, `second` is (p, q).

    A start that comes several times has one walk, whose segments are repeated as often, or, where there is one segment, as many rows.
    """
    spark = nodes.sparkSession
    starts = nodes.groupBy(F.col("id").alias("start")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    walkers = nodes.count() * num_walks
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(cores, walkers // LEAST_WALKERS), math.ceil(walkers * walk_length / PLACES))
    keys = keys_apart(spark, tasks)
    walking = (starts.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
               .select(_of(F.xxhash64("round", "start"), keys).alias("_task"), F.lit(WALK).alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("rows"), "round", "start", "times"))
    held = pieces.withColumn("_task", F.explode(F.lit(keys).cast("array<int>"))).select(
        "_task", "kind", "keys", "rows", F.lit(None).cast("int").alias("round"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("int").alias("times"))
    marked = second is not None or walk_length - 1 > segment

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mine = [], []
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            for i in np.flatnonzero(kind != WALK).tolist():
                parts.append((int(kind[i]), batch.column("keys")[i], batch.column("rows")[i]))
            mine.append(batch.select(["round", "start", "times"]).filter(pa.array(kind == WALK)))
        if not sum(b.num_rows for b in mine):
            return
        table = Table(parts, spread)
        if second:
            table.by_ends()
        mine = pa.Table.from_batches(mine).combine_chunks()
        for low in range(0, mine.num_rows, WALKERS):
            here = mine.slice(low, WALKERS)
            start, times = here.column("start").combine_chunks(), np.asarray(here.column("times"))
            at = np.asarray(pc.fill_null(pc.index_in(start, table.names, skip_nulls=True), -1), np.int64)
            heads = _heads(np.asarray(here.column("round")), start.to_pylist())
            path, when = second_order(table, at, heads, walk_length, seed, *second) if second else first_order(table, at, heads, walk_length, seed)
            size = (path >= 0).sum(1)
            flat = np.full((len(at), path.shape[1] + 1), -1, np.int64)
            flat[:, 1:] = path
            flat[:, 0] = np.arange(len(at)) + len(table.names)
            known = pa.concat_arrays([table.names.cast(pa.string()), start.cast(pa.string())])
            values = known.take(pa.array(flat[np.arange(flat.shape[1])[None, :] <= size[:, None]]))
            paths = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size + 1)].astype(np.int32)), values)
            out = pa.table({"round": here.column("round"), "start": here.column("start"), "path": paths})
            again = np.flatnonzero(times > 1)
            if len(again):
                if marked:
                    whole = paths.to_pylist()
                    for i in again.tolist():
                        whole[i] = _repeated(whole[i][0], whole[i][1:], when[i][:size[i]].tolist(), int(times[i]), segment, walk_length - 1)
                    out = out.set_column(2, "path", pa.array(whole, pa.list_(pa.string())))
                else:
                    out = out.take(pa.array(np.repeat(np.arange(len(at)), times)))
            yield from out.combine_chunks().to_batches()

    met = walking.unionByName(held).repartition(tasks, "_task")
    return met.groupBy("_task").applyInArrow(walk, "round int, start string, path array<string>")
