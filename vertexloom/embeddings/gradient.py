"""Gradient-trained embeddings on vertex tables.

LINE, skip-gram (against negatives or down a Huffman tree) and the attributed model make mini-batch steps on blocks of their pairs (see blocks).
`pair_gradients` joins the pairs of a batch with the vectors of both ends and sums the gradients by node, inside each Arrow batch first, then
map-side, then across the cluster.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..functions.hashing import unit
from ..operators.graph import Graph, node_index, weighted_out_degree
from ..operators.linalg import random_vectors
from ..operators.sampling import negative_sample_loguniform, pick_table, slot_of
from ..plans.lineage import cut, discard
from ..plans.skew import counted, lookup
from . import blocks
from .blocks import sigmoid, softplus
from .result import Embedding


def logistic(a, b, w, shared, shared_ids, v, neg_weight, bias):
    """Loss and gradients of log-sigmoid scores with shared negatives (weight neg_weight in all)."""
    if bias:
        a1 = np.column_stack([a, np.ones(len(a))])
    else:
        a1 = a
    s, t = np.sum(a1 * b, axis=1), a1 @ shared.T
    loss = w * (softplus(-s) + neg_weight * softplus(t).mean(1))
    ds, dt = -w * sigmoid(-s), (w * neg_weight / len(shared))[:, None] * sigmoid(t)
    ga = ds[:, None] * b + dt @ shared
    return (ga[:, :-1] if bias else ga), ds[:, None] * a1, dt.T @ a1, loss


def _by_id(ids: np.ndarray, grads: np.ndarray):
    """Sum the gradient rows of equal ids."""
    names, place = np.unique(ids.astype(str), return_inverse=True)
    out = np.zeros((len(names), grads.shape[1]))
    np.add.at(out, place, grads)
    return names, out


def pair_gradients(pairs: DataFrame, left: DataFrame, right: DataFrame, shared_ids: list, shared: np.ndarray, neg_weight: float,
                   step, bias: bool, counts: tuple) -> DataFrame:
    """(side, id, g, loss): summed gradients for the u side (0) and the v side (1) of pairs (u, v, w)."""
    rows = lookup(pairs, "u", left, "id", {"vector": "_a"}, ["v"], counts=counts[0])
    rows = lookup(rows, "v", right, "id", {"vector": "_b"}, ["u"], counts=counts[1])

    def grads(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ga, gb, gn, loss = step(V.to_numpy(batch.column(3)), V.to_numpy(batch.column(4)), batch.column(2).to_numpy(zero_copy_only=False),
                                    shared, shared_ids, v, neg_weight, bias)
            ids_a, sum_a = _by_id(u, ga)
            ids_b, sum_b = _by_id(np.concatenate([v, np.array(shared_ids, dtype=object)]), np.vstack([gb, gn]))
            part = np.zeros(len(ids_a))
            part[0] = loss.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids_a), np.int32)), pa.array(ids_a), V.to_arrow(sum_a), pa.array(part)], names=["side", "id", "g", "loss"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids_b), np.int32)), pa.array(ids_b), V.to_arrow(sum_b), pa.array(np.zeros(len(ids_b)))], names=["side", "id", "g", "loss"])

    parts = rows.select("u", "v", "w", "_a", "_b").mapInArrow(grads, "side int, id string, g array<double>, loss double")
    return parts.groupBy("side", "id").agg(V.sum_vectors("g").alias("g"), F.sum("loss").alias("loss"))


def adam_matrix(x, m, v, g, step, lr):
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return x - lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8), m, v


def _drawn(table: DataFrame, size, count: int, seed) -> DataFrame:
    """Ids of `count` negatives from a guide table."""
    draws = table.sparkSession.range(count).select(F.floor(unit("id", seed=seed) * F.lit(size.total)).cast("bigint").alias("_t"))
    draws = draws.withColumn("slot", slot_of(F.col("_t"), F.lit(size.total), F.lit(size.slots)))
    return draws.join(table, "slot").filter("lo <= _t AND _t < hi").select(F.col("node").alias("id"))


def collect_rows(ids: DataFrame, table: DataFrame) -> tuple[list, np.ndarray]:
    """The vectors of a few ids (repeats kept), in id order."""
    got = sorted(ids.join(table.select("id", "vector"), "id").collect(), key=lambda r: r.id)
    return [r.id for r in got], np.array([r.vector for r in got])


def _ends(pairs: DataFrame) -> tuple:
    return counted(pairs, "u"), counted(pairs, "v")


def _started(nodes: DataFrame, dim: int, seed, scale: float, degree: DataFrame, power: float, bias: bool = False) -> DataFrame:
    """(id, w, x): vectors with the state 0 behind them, and degree^power as weight; scale 0 starts from 0."""
    start = random_vectors(nodes, dim, seed, scale)
    x = F.concat("vector", F.array(F.lit(0.0))) if not bias else F.concat("vector", F.array(F.lit(0.0), F.lit(0.0)))
    known = start.join(degree.select("id", F.pow(F.greatest(F.col("degree").cast("double"), F.lit(0.0)), F.lit(power)).alias("w")), "id", "left")
    return known.select("id", F.coalesce("w", F.lit(0.0)).alias("w"), x.alias("x"))


def pool_by_weight(weights: DataFrame) -> blocks.Pool:
    """Negatives in proportion to w of (id, w); uniform ones if there is no weight."""
    if weights.filter("w > 0").isEmpty():
        weights = weights.withColumn("w", F.lit(1.0))
    guide, totals = pick_table(weights.select(F.lit(0).alias("all"), F.col("id").alias("node"), "w"), ["all"], ["node"], "w")
    guide, size = cut(guide.drop("all"), "guide"), totals.first()
    return blocks.Pool(lambda count, seed: _drawn(guide, size, count, seed))


def _batches(t: blocks.Task, batch_size: int | None, passes: int):
    """Pairs of a step, in a new order for each pass; without a size some 64 steps a pass, of 64 to 1,024 pairs."""
    size = batch_size or min(1024, max(64, len(t.u) // 64))
    for _ in range(passes):
        mixed = t.rng.permutation(len(t.u))
        for start in range(0, len(t.u), size):
            yield mixed[start:start + size]


def _negatives(t: blocks.Task) -> np.ndarray:
    """Rows of right to draw negatives from: as many draws by weight as the task has rows of its own, and the pool. So a row of the pool is drawn as often
    as one of the task's own of the same weight, however many pairs the task has: a pool alone is pushed away from all, and the other nodes from none."""
    weight = t.right[1][:t.own]
    total = weight.sum()
    return np.concatenate([t.rng.choice(t.own, t.own, p=weight / total if total > 0 else None), t.pool])


def _logistic_work(dim: int, width: int, negatives: int, rate: float, batch_size: int | None, passes: int):
    """Mini-batches of logistic_batch on the rows of a task; width - dim is 1 with a bias."""
    def work(t):
        h, c = t.left[0], t.right[0]
        alone = h is c
        hx, hs, cx, cs = h[:, :dim], h[:, dim], c[:, :width], c[:, width]
        total, known = 0.0, _negatives(t)
        for at in _batches(t, batch_size, passes):
            a, b = hx[t.u[at]], cx[t.v[at]]
            a = np.column_stack([a, np.ones(len(a))]) if width > dim else a
            drawn = known[t.rng.integers(0, len(known), (len(at), negatives))]
            loss, da, db, dn = blocks.logistic_batch(a, b, cx[drawn], t.w[at])
            total += loss
            away, there = np.concatenate([t.v[at], drawn.ravel()]), np.vstack([db, dn.reshape(-1, width)])
            if alone:
                blocks.adagrad(hx, hs, np.concatenate([t.u[at], away]), np.vstack([da[:, :dim], there]), rate)
            else:
                blocks.adagrad(hx, hs, t.u[at], da[:, :dim], rate)
                blocks.adagrad(cx, cs, away, there, rate)
        return total, float(len(t.u) * passes), None

    return work


def _padded(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _tree_work(dim: int, rate: float, batch_size: int | None, passes: int, top: tuple):
    """Mini-batches of path_batch. Right row j of a bucket is inner node j of the bucket's own tree over its nodes' visits; `top` has for each bucket its
    way down the tree over the buckets, whose inner nodes are the rows of the matrix."""
    def work(t):
        (h, _), (c, visits) = t.left, t.right
        hx, hs, upper = h[:, :dim], h[:, dim], len(t.matrix)
        table, state = np.vstack([t.matrix[:, :dim], c[:, :dim]]), np.concatenate([t.matrix[:, dim], c[:, dim]])
        paths, turns = blocks.huffman(visits)
        first, turned = (x[t.bucket] for x in top)
        paths = _padded([first + [upper + p for p in path] for path in paths])
        turns = _padded([turned + turn for turn in turns])
        total = 0.0
        for at in _batches(t, batch_size, passes):
            way, sign = paths[t.v[at]], turns[t.v[at]].astype(float)
            loss, da, dn = blocks.path_batch(hx[t.u[at]], table[way], sign, t.w[at])
            total += loss
            blocks.adagrad(hx, hs, t.u[at], da, rate)
            on = sign != 0
            blocks.adagrad(table, state, way[on], dn[on], rate)
        c[:, :dim], c[:, dim] = table[upper:], state[upper:]
        return total, float(len(t.u) * passes), np.column_stack([table[:upper], state[:upper]])

    return work


def _visits(epochs: int, passes: int) -> tuple[int, int]:
    """Rounds over all blocks and passes of each visit; together `epochs` passes over the pairs, or one round more."""
    passes = max(1, min(passes, epochs))
    return -(-epochs // passes), passes


def train_pairs(nodes: DataFrame, pairs: DataFrame, degree: DataFrame, dim: int, epochs: int, negatives: float, lr: float,
                batch_size: int | None = 128, passes: int = 5, shared_table: bool = False, bias: bool = False, seed: int = 0,
                power: float = 0.75, scale: float | None = None, context_scale: float | None = None, hs: bool = False, bucket_nodes: int = blocks.NODES, on_visit=None) -> Embedding:
    """Log-sigmoid training on weighted pairs (u, v, w), each against `negatives` nodes drawn by degree^power from all nodes for each batch.

    shared_table: both ends use the same vectors; otherwise v has a context table (with a bias if asked). A block is used
    `passes` times whenever its buckets meet; the history has the loss of one pair for each visit to all blocks. hs: v is told by its way down a Huffman
    tree over `degree`, one tree in each bucket and one over the buckets, in place of negatives.
    on_visit(visit, vectors, loss) may read the vectors after each visit.
    """
    scale = 1.0 / np.sqrt(dim) if scale is None else scale
    context_scale = scale if context_scale is None else context_scale
    if hs and (shared_table or bias):
        raise ValueError("a tree has neither shared vectors nor biases")
    nodes = cut(nodes.select("id"), "nodes")
    laid = blocks.Blocks(pairs, nodes.count(), shared_table, bucket_nodes, seed=seed)
    width = dim + (1 if bias else 0)
    left = cut(_started(nodes, dim, f"{seed}|h", scale, degree, 1.0 if hs else power), "start")
    state = blocks.side_rows(left, blocks.LEFT, laid.buckets)
    if not shared_table:
        right = left.select("id", "w", F.array_repeat(F.lit(0.0), width + 1).alias("x")) if hs or not context_scale else _started(nodes, dim, f"{seed}|c", context_scale, degree, power, bias)
        state = state.unionByName(blocks.side_rows(right, blocks.RIGHT, laid.buckets))
    visits, passes = _visits(epochs, passes)
    watch = (lambda visit, table, loss: on_visit(visit, blocks.table_of(table, blocks.LEFT, dim), loss)) if on_visit else None
    if hs:
        sums = {r.bucket: r.w for r in state.filter(F.col("kind") == blocks.LEFT).groupBy("bucket").agg(F.sum("w").alias("w")).collect()}  # a row for each bucket
        top = blocks.huffman(np.array([sums.get(b, 0.0) for b in range(laid.buckets)]))
        work, matrix, pool = _tree_work(dim, lr, batch_size, passes, top), np.zeros((laid.buckets - 1, dim + 1)), None
    else:
        work, matrix, pool = _logistic_work(dim, width, max(1, round(negatives)), lr, batch_size, passes), None, pool_by_weight(left.select("id", "w"))
    state, history, _ = blocks.run_blocks(state, laid, visits, work, seed, matrix, pool, watch)
    return Embedding(blocks.table_of(state, blocks.LEFT, dim), history)


def line(graph: Graph, dim: int = 128, order: int = 3, epochs: int = 100, negative_ratio: int = 5, learning_rate: float = 0.05,
         batch_size: int = 128, passes: int = 5, seed: int = 0, labels: DataFrame | None = None, clf_ratio: float = 0.5, best: str = "micro") -> Embedding:
    """Order 1: linked nodes have like vectors; order 2: like contexts; order 3: both, half the width each.

    With `labels` (off by default) a classifier is scored after each visit to all pairs, on `clf_ratio` of the labelled nodes, and the
    vectors of the visit with the best `best` F1 are the result. The vectors of each visit are written once, as training goes on.
    """
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    made = {}
    pairs = graph.adj.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("w"))
    degree = weighted_out_degree(graph).select("id", F.col("out_weight").alias("degree"))
    halves = {1: (1,), 2: (2,), 3: (1, 2)}[order]
    for which in halves:
        def keep(visit, vectors, loss, which=which):
            made[visit, which] = cut(vectors, "visit")
        out = train_pairs(graph.nodes, pairs, degree, dim // len(halves), epochs, negative_ratio, learning_rate, batch_size, passes, shared_table=which == 1,
                          seed=f"{seed}|2" if order == 3 and which == 2 else seed, on_visit=keep if labels is not None else None)
        made["last", which], made["history", which] = out.vectors, out.history

    def joined(visit):
        parts = [made[visit, which] for which in halves]
        if len(parts) == 1:
            return parts[0]
        return parts[0].join(parts[1].withColumnRenamed("vector", "_b"), "id").select("id", F.concat("vector", "_b").alias("vector"))

    history = [(steps[0][0], sum(x for _, x in steps)) for steps in zip(*(made["history", which] for which in halves))]
    if labels is None:
        return Embedding(joined("last"), history)
    from ..operators.evaluate import best_epoch, nc_evaluate

    scored = [("line", visit, float(nc_evaluate(joined(visit), labels, clf_ratio, seed).first()[best])) for visit, _ in history]
    table = graph.nodes.sparkSession.createDataFrame(scored, "run string, epoch bigint, metric double")
    chosen = best_epoch(table, lower_is_better=False).first().epoch
    for visit, _ in history:
        for which in halves:
            if visit != chosen:
                discard(made[visit, which])
    return Embedding(joined(chosen), history)


def sgns_pairs(nodes: DataFrame, pairs: DataFrame, degree: DataFrame, dim: int = 128, epochs: int = 10, negatives: float = 20.0,
               learning_rate: float = 0.05, batch_size: int = 128, passes: int = 5, seed: int = 0) -> Embedding:
    """Skip-gram on node pairs (src, dst[, n]) with a context table and a context bias."""
    weight = F.col("n") if "n" in pairs.columns else F.lit(1.0)
    grouped = pairs.groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.sum(weight).alias("w"))
    return train_pairs(nodes, grouped, degree, dim, epochs, negatives, learning_rate, batch_size, passes, bias=True, seed=seed)


def _softmax_work(half: int, dim: int, m: int, alpha: float, samples: int, rate: float, batch_size: int, passes: int, n: int):
    """Mini-batches of softmax_batch; a left row is its own vector, its state and its attributes, the matrix maps attributes, and the weight of a
    right row is its number among all n classes."""
    def work(t):
        (h, _), (c, number) = t.left, t.right
        own, state, attrs = h[:, :half], h[:, half], h[:, half + 1:half + 1 + m]
        out, out_state = c[:, :dim + 1], c[:, dim + 1]
        p, p_state, total, kinds = t.matrix.copy(), np.zeros(m), 0.0, len(np.unique(t.pool))
        for at in _batches(t, batch_size, passes):
            u, v, w = t.u[at], t.v[at], t.w[at]
            x = attrs[u]
            a = np.column_stack([own[u], alpha * (x @ p), np.ones(len(at))])
            tries, classes = 0, np.zeros(0, np.int64)
            while len(classes) < min(samples, kinds):
                tries += samples
                classes = np.unique(np.concatenate([classes, t.pool[t.rng.integers(0, len(t.pool), samples)]]))
            loss, da, db, dc = blocks.softmax_batch(a, out[v], out[classes], w, blocks.expected_count(number[v], n, tries),
                                                    blocks.expected_count(number[classes], n, tries), v[:, None] == classes[None, :])
            total += loss
            blocks.adagrad(p, p_state, np.arange(m), alpha * x.T @ da[:, half:dim], rate)
            blocks.adagrad(own, state, u, da[:, :half], rate)
            blocks.adagrad(out, out_state, np.concatenate([v, classes]), np.vstack([db, dc]), rate)
        return total, float(len(t.u) * passes), p

    return work


def asne(graph: Graph, attrs: DataFrame, dim: int = 128, alpha: float = 1.0, epochs: int = 100, n_neg_samples: int = 10,
         learning_rate: float = 0.05, batch_size: int = 128, passes: int = 5, seed: int = 0) -> Embedding:
    """[own vector, alpha * attributes.P] of a node predicts its neighbours by sampled softmax among all nodes, log-uniform by their number.

    The result adds the output vector of each node to its input side, matched by id. The tasks of a round start from one P, and
    their results are averaged.
    """
    half = dim // 2
    feats = cut(attrs.select("id", F.col("features").cast("array<double>").alias("features")), "features")
    m = V.width(feats, "features")
    both = graph.edges.select("src", "dst")
    pairs = both.union(both.select("dst", "src")).distinct().select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    index = cut(node_index(graph.nodes), "index")
    n = index.count()
    laid = blocks.Blocks(pairs, n, False, seed=seed)
    zero = F.array(F.lit(0.0))
    own = random_vectors(graph.nodes, half, f"{seed}|in", uniform=True).join(feats, "id").select(
        "id", F.lit(0.0).alias("w"), F.concat("vector", zero, "features").alias("x"))
    out = random_vectors(graph.nodes, dim, f"{seed}|out", 1.0 / np.sqrt(dim)).join(index, "id").select("id", F.col("idx").cast("double").alias("w"), F.concat("vector", zero, zero).alias("x"))
    state = blocks.side_rows(own, blocks.LEFT, laid.buckets).unionByName(blocks.side_rows(out, blocks.RIGHT, laid.buckets))
    p = np.random.default_rng(seed).uniform(-1, 1, (m, half))
    visits, passes = _visits(epochs, passes)
    work = _softmax_work(half, dim, m, alpha, n_neg_samples, learning_rate, batch_size, passes, n)
    pool = blocks.Pool(lambda count, key: negative_sample_loguniform(graph.nodes.sparkSession.range(count).withColumnRenamed("id", "i"), n, ["i"], key).join(
        index, F.col("class") == F.col("idx")).select("id"))
    state, history, p = blocks.run_blocks(state, laid, visits, work, seed, p, pool)
    side = blocks.table_of(state, blocks.LEFT, half).join(feats, "id").select("id", F.concat("vector", V.times(F.col("features"), alpha * p)).alias("vector"))
    there = blocks.table_of(state, blocks.RIGHT, dim).withColumnRenamed("vector", "_out")
    vectors = side.join(there, "id").select("id", F.zip_with("vector", "_out", lambda a, b: a + b).alias("vector"))
    return Embedding(vectors, history)
