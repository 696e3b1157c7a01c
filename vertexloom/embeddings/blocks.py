"""Mini-batch training of vertex tables on blocks of their pairs.

Nodes are dealt to buckets by a hash. A task holds one bucket of the left table, one of the right table and the pairs
between them, and makes ordinary mini-batch steps on these. In a round each bucket takes part once, so tasks share no row
of it; after as many rounds as there are buckets all pairs were used. A vector moves once a round and not once a pair. A
block with very many pairs (a hub's, say) is used in several rounds, so that the pairs of a task are bounded as its nodes are.

Negatives come from all nodes: a round draws a pool of POOL nodes, and every task gets these with their vectors. A batch
draws its negatives from the pool and, against negatives by weight, from the rows of its own buckets as well. Those of the task's own buckets are the rows themselves; of the others the task changes a copy, and
the changes that the tasks of a round made to a node are added to it after the round: their sum, as each comes from pairs of its own, but where
that is longer than a part REACH of the row (many tasks pushed it the same way) no more than that or their mean.

Steps are row-wise Adagrad: each row has one number, the sum of its mean squared gradients. When both ends share one
table, the rounds pair the buckets off as in a tournament, with one more round for the pairs within a bucket.
"""

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..plans.lineage import cut, discard, scratch_path

#: Nodes of a bucket and pairs of a task, about.
NODES, PAIRS = 20_000, 1_000_000
#: Draws of a round's pool of negatives, which every task gets.
POOL = 2048
REACH = 0.25
SCHEMA = "g bigint, kind int, id string, other string, bucket bigint, w double, x array<double>"
LEFT, RIGHT, PAIR, LOSS, MATRIX, MOVED = range(6)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def logistic_batch(a, b, negatives, w):
    """Loss and gradients of log-sigmoid scores for rows a with positives b and (rows, k) negatives: loss, da, db, dnegatives."""
    s, t = np.einsum("rd,rd->r", a, b), np.einsum("rd,rkd->rk", a, negatives)
    ds, dt = -w * sigmoid(-s), w[:, None] * sigmoid(t)
    loss = (w * (softplus(-s) + softplus(t).sum(1))).sum()
    return loss, ds[:, None] * b + np.einsum("rk,rkd->rd", dt, negatives), ds[:, None] * a, dt[:, :, None] * a[:, None, :]


def softmax_batch(a, b, classes, w, expected_true, expected, hit):
    """Sampled softmax of the true class against shared ones, each less the log of its expected count; hit marks shared classes that
    are a row's true one, which don't count against it. Returns loss, da, db, dclasses."""
    s = np.einsum("rd,rd->r", a, b) - np.log(expected_true)
    t = np.where(hit, -np.inf, a @ classes.T - np.log(expected)[None, :])
    z = np.column_stack([s, t])
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    prob = e / e.sum(1, keepdims=True)
    loss = (w * (np.log(e.sum(1)) + top[:, 0] - s)).sum()
    ds, dt = w * (prob[:, 0] - 1.0), w[:, None] * prob[:, 1:]
    return loss, ds[:, None] * b + dt @ classes, ds[:, None] * a, dt.T @ a


def path_batch(a, nodes, sign, w):
    """Loss and gradients for rows a against the (rows, steps, d) vectors on their way down a tree; sign is 1 or -1 by the turn, 0 past the end."""
    s = np.einsum("rd,rkd->rk", a, nodes)
    loss = (w[:, None] * np.abs(sign) * softplus(-sign * s)).sum()
    ds = -w[:, None] * sign * sigmoid(-sign * s)
    return loss, np.einsum("rk,rkd->rd", ds, nodes), ds[:, :, None] * a[:, None, :]


def huffman(weights: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """For each leaf the inner nodes from the root (len(weights) - 2) on, and the turn, 1 or -1, at each."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above, turn = [0] * (2 * n), [0] * (2 * n)
    for inner in range(n, 2 * n - 1):
        (w, a), (x, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = inner
        turn[a], turn[b] = 1, -1
        heapq.heappush(heap, (w + x, inner))
    paths, turns = [[]] * (2 * n), [[]] * (2 * n)
    for node in range(2 * n - 3, -1, -1):  # a node comes after what is below it
        paths[node], turns[node] = paths[above[node]] + [above[node] - n], turns[above[node]] + [turn[node]]
    return paths[:n], turns[:n]


def expected_count(classes, n: int, tries: int) -> np.ndarray:
    p = np.log((classes + 2.0) / (classes + 1.0)) / np.log(n + 1.0)
    return -np.expm1(tries * np.log1p(-np.minimum(p, 1 - 1e-12)))


def adagrad(rows: np.ndarray, state: np.ndarray, at: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """One step on the rows `at`, which may repeat: their gradients are summed first."""
    unique, place = np.unique(at, return_inverse=True)
    total = np.zeros((len(unique), grads.shape[1]))
    np.add.at(total, place, grads)
    state[unique] += (total * total).mean(1)
    rows[unique] -= rate * total / (np.sqrt(state[unique])[:, None] + 1e-10)


def buckets_for(n_nodes: int, n_pairs: int, nodes: int = NODES) -> int:
    """An even number of buckets, two at least."""
    return max(2, 2 * -(-n_nodes // (2 * nodes)), 2 * -(-int((n_pairs / PAIRS / 64) ** 0.5) // 2))


def bucket(node: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets))


def pair_round(bu: Column, bv: Column, buckets: int, shared: bool) -> Column:
    """The round in which the buckets of a pair meet."""
    if not shared:
        return F.pmod(bv - bu, F.lit(buckets))
    last = buckets - 1
    free = F.when(bu == last, 2 * bv).when(bv == last, 2 * bu).otherwise(bu + bv)
    return F.when(bu == bv, F.lit(last)).otherwise(F.pmod(free, F.lit(last)))


def group_of(b: Column, side: int, r: int, buckets: int, shared: bool) -> Column:
    """The task of a bucket's rows in round r."""
    if not shared:
        return b if side == LEFT else F.pmod(b - r, F.lit(buckets))
    last = buckets - 1
    if r == last:
        return b
    single = (r * pow(2, -1, last)) % last if last > 1 else 0  # meets the last bucket
    partner = F.when(b == last, F.lit(single)).when(b == single, F.lit(last)).otherwise(F.pmod(r - b, F.lit(last)))
    return F.least(b, partner)


class Blocks:
    """Pairs (u, v, w) by round, on disk."""

    def __init__(self, pairs: DataFrame, n_nodes: int, shared: bool, nodes: int = NODES, seed=0):
        n, mean = pairs.agg(F.count(F.lit(1)), F.avg(F.col("w").cast("double"))).first()
        self.mean = mean or 1.0  # weights are used as multiples of it
        self.shared, self.buckets = shared, buckets_for(n_nodes, n, nodes)
        bu, bv = bucket("u", self.buckets), bucket("v", self.buckets)
        placed = pairs.select("u", "v", F.col("w").cast("double").alias("w"), bu.alias("bu"), bv.alias("bv")).withColumn(
            "round", pair_round(F.col("bu"), F.col("bv"), self.buckets, shared))
        g = F.least("bu", "bv") if shared else F.col("bu")
        largest = placed.groupBy("round", g.alias("g")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        self.parts = max(1, -(-largest // PAIRS))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("u", "v", F.lit(str(seed))), F.lit(self.parts)))
        path = scratch_path(pairs.sparkSession, "blocks")
        placed.select("u", "v", "w", g.alias("g"), "round", "part").repartition("round", "part", "g").write.partitionBy("round", "part").parquet(path)
        self.table = pairs.sparkSession.read.parquet(path)
        self.table._scratch = path
        self.rounds = [(r, p) for r in range(self.buckets) for p in range(self.parts)]

    def of(self, r: int, part: int) -> DataFrame:
        return self.table.filter((F.col("round") == r) & (F.col("part") == part)).select(
            "g", F.lit(PAIR).alias("kind"), F.col("u").alias("id"), F.col("v").alias("other"), F.lit(None).cast("bigint").alias("bucket"), "w", F.lit(None).cast("array<double>").alias("x"))


def side_rows(table: DataFrame, kind: int, buckets: int) -> DataFrame:
    """(kind, id, bucket, w, x) from (id, w, x): w is the weight as a negative, x the vector with its state and what else belongs to it."""
    return table.select(F.lit(kind).alias("kind"), "id", F.lit(None).cast("string").alias("other"), bucket("id", buckets).alias("bucket"), F.col("w").cast("double").alias("w"), "x")


@dataclass
class Task:
    """What a task works on. left and right are (x, w) of its rows, changed in place, and the same in shared mode; u and v number the rows of the pairs.

    pool numbers the rows of right that negatives are drawn from; rows of right from `own` on are copies of other buckets' rows.
    """
    left: tuple
    right: tuple
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    rng: np.random.Generator
    matrix: np.ndarray | None
    pool: np.ndarray
    own: int
    bucket: int


class Pool:
    """Draws nodes for each round: draw(size, seed) gives a table with the ids, which may repeat."""

    def __init__(self, draw, size: int = POOL):
        self.draw, self.size = draw, size

    def of(self, state: DataFrame, kind: int, seed) -> tuple:
        """(ids, times drawn, w, x) of a round, in the order of the ids."""
        times = self.draw(self.size, seed).groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
        got = state.filter(F.col("kind") == kind).join(F.broadcast(times), "id").select("id", "_times", "w", "x").orderBy("id").toArrow().combine_chunks()
        return got.column("id").to_numpy().astype(str), got.column("_times").to_numpy(), got.column("w").to_numpy().copy(), V.to_numpy(got.column("x"))


def settled(state: DataFrame, kind: int) -> DataFrame:
    """The rows of both tables, those of `kind` with what the tasks of the last round did to their copies."""
    moved = state.filter(F.col("kind") == MOVED).groupBy("id").agg(V.sum_vectors("x").alias("_by"), F.count(F.lit(1)).alias("_tasks"))
    rows = state.filter(F.col("kind") <= RIGHT).join(F.broadcast(moved), "id", "left")  # at most POOL ids
    part = F.least(F.lit(1.0), F.greatest(1.0 / F.col("_tasks"), REACH * V.norm(F.col("x")) / F.greatest(V.norm(F.col("_by")), F.lit(1e-300))))
    added = F.zip_with("x", F.transform("_by", lambda b: b * F.col("_part")), lambda a, b: a + b)
    change = F.when((F.col("kind") == kind) & F.col("_by").isNotNull(), added).otherwise(F.col("x"))
    return rows.withColumn("_part", part).select("kind", "id", "other", "bucket", "w", change.alias("x"))


def run_blocks(state: DataFrame, blocks: Blocks, visits: int, work, seed, matrix: np.ndarray | None = None, pool: Pool | None = None, on_visit=None):
    """Calls work(task) for each task; returns the last table, the loss of each visit for one pair, the matrix.

    work returns (loss, pairs, matrix or None). Matrices of a round are averaged by their pairs. on_visit(visit, table, loss) may read
    the table after each visit; it stays when on_visit returns true.
    """
    state = cut(state, "state")
    history, kind, kept = [], LEFT if blocks.shared else RIGHT, False
    for visit in range(1, visits + 1):
        loss, count = 0.0, 0.0
        for r, part in blocks.rounds:
            tag = f"{seed}|{visit}|{r}|{part}"
            sides = settled(state, kind) if "g" in state.columns and pool else state.filter(F.col("kind") <= RIGHT)
            drawn = pool.of(sides, kind, tag) if pool else None
            g = F.when(F.col("kind") == LEFT, group_of(F.col("bucket"), LEFT, r, blocks.buckets, blocks.shared)).otherwise(
                group_of(F.col("bucket"), RIGHT, r, blocks.buckets, blocks.shared))
            rows = sides.select(g.alias("g"), "kind", "id", "other", "bucket", "w", "x").unionByName(blocks.of(r, part))
            made = cut(rows.groupBy("g").applyInArrow(_task(work, blocks.shared, blocks.mean, tag, matrix, drawn), SCHEMA), "state")
            if not kept:
                discard(state)
            state, kept = made, False
            sums = state.filter(F.col("kind") == LOSS).agg(F.sum("w"), F.sum(F.col("x")[0])).first()
            loss, count = loss + (sums[0] or 0.0), count + (sums[1] or 0.0)
            if matrix is not None and sums[1]:
                flat = state.filter((F.col("kind") == MATRIX) & (F.col("w") > 0)).agg(V.mean_vectors("x", F.col("w")).alias("x")).first().x
                matrix = np.array(flat).reshape(matrix.shape)
        history.append((visit, loss / max(count, 1.0)))
        if on_visit:
            kept = bool(on_visit(visit, settled(state, kind) if pool else state, history[-1][1]))
    discard(blocks.table)
    return settled(state, kind) if pool else state, history, matrix


def _task(work, shared: bool, mean: float, seed: str, matrix, drawn):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind, g = table.column("kind").to_numpy(), table.column("g")[0].as_py()
        order = np.argsort(table.column("id").to_numpy(zero_copy_only=False).astype(str), kind="stable")  # the same order however rows arrive
        sides, places, numbers = [], [], []
        for k in (LEFT,) if shared else (LEFT, RIGHT):
            mine = order[kind[order] == k]
            part = table.take(pa.array(mine)) if len(mine) else table.slice(0, 0)
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(str)
            sides.append((V.to_numpy(part.column("x")).copy(), part.column("w").to_numpy().copy()))
            places.append(part)
            numbers.append(ids)
        own, pool, copies = len(numbers[-1]), np.arange(len(numbers[-1])), None
        if drawn is not None and own:
            ids, times, w, x = drawn
            at = np.minimum(np.searchsorted(numbers[-1], ids), own - 1)
            here = numbers[-1][at] == ids
            place = np.where(here, at, own + np.cumsum(~here) - 1)
            pool, copies = np.repeat(place, times), (ids[~here], x[~here])
            if len(copies[0]):
                sides[-1] = np.vstack([sides[-1][0], copies[1]]), np.concatenate([sides[-1][1], w[~here]])
        if shared:
            sides, numbers = sides * 2, numbers * 2
        pairs = table.filter(pa.array(kind == PAIR))
        u = pairs.column("id").to_numpy(zero_copy_only=False).astype(str)
        v = pairs.column("other").to_numpy(zero_copy_only=False).astype(str)
        w = pairs.column("w").to_numpy()
        order = np.lexsort((v, u))
        u, v, w = u[order], v[order], w[order] / mean
        loss, n, made = 0.0, 0.0, None
        if len(u):
            rng = np.random.default_rng([ord(c) for c in f"{seed}|{g}"])
            bucket = places[-1].column("bucket")[0].as_py()
            loss, n, made = work(Task(sides[0], sides[1], np.searchsorted(numbers[0], u), np.searchsorted(numbers[1], v), w, rng, matrix, pool, own, bucket))
        kept = [s[0][:len(p)] for p, s in zip(places, sides if not shared else sides[:1])]
        out = [p.set_column(p.schema.get_field_index("x"), "x", V.to_arrow(x) if len(x) else pa.array([], pa.list_(pa.float64()))) for p, x in zip(places, kept)]
        out.append(_row(table.schema, g, LOSS, loss, [n]))
        if made is not None:
            out.append(_row(table.schema, g, MATRIX, float(n), made.ravel().tolist()))
        if n and copies is not None and len(copies[0]):
            k, none = len(copies[0]), pa.nulls(len(copies[0]))
            change = sides[1][0][own:] - copies[1]
            columns = {"g": pa.array(np.full(k, g)), "kind": pa.array(np.full(k, MOVED)), "id": pa.array(copies[0].tolist(), pa.string()), "other": none, "bucket": none,
                       "w": pa.array(np.full(k, float(n))), "x": V.to_arrow(change)}
            out.append(pa.table({c: columns[c] for c in table.schema.names}))
        return pa.concat_tables([t.cast(table.schema) for t in out])

    return run


def _row(schema, g, kind, w, x) -> pa.Table:
    return pa.Table.from_pylist([{"g": g, "kind": kind, "id": None, "other": None, "bucket": None, "w": w, "x": x}], schema=schema)


def table_of(state: DataFrame, kind: int, width: int, start: int = 1) -> DataFrame:
    """(id, vector): part of the rows of one table."""
    return state.filter(F.col("kind") == kind).select("id", F.slice("x", start, width).alias("vector"))
