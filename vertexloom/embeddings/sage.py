"""Two-layer sampled-neighbourhood model, trained on mini-batches of edges with their sampled support.

The means over the second hop's features don't depend on the weights: each epoch makes them once, as joins, for its own samples. A batch of edges is then
a small graph that fits one task: the ends and its own negatives, their k sampled neighbours, and for each of these nodes its features beside the
mean over its own sample. An epoch's batches are dealt to tasks of STEPS batches; a task takes them one after another, each a step of Adam,
and holds one at a time. TASKS tasks make a round: they start from the same weights, and what they end with is averaged by their edges. So the work of an epoch
grows with its edges times the size of a sample, never with nodes times edges, and only weights pass the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators.aggregate import infer_embeddings, make_weights, over_neighbors, relu
from ..operators.graph import Graph, drop_isolated_edges, edge_train_mask, node_split, train_degree
from ..operators.matrix import standard_scale
from ..operators.sampling import minibatches, negative_sample, negative_table, neighbor_sample, neighbor_subsample, subset
from ..plans.lineage import cut, discard
from ..plans.skew import lookup
from .gradient import adam_matrix, logistic
from .result import Embedding

#: Batches that a task takes one after another, and tasks of a round.
STEPS, TASKS = 16, 64
#: Rows of a batch in the order they come: edges, negatives, sampled neighbours, and features of the batch's nodes and of their neighbours.
EDGE, NEGATIVE, NEAR, ROOT, LEAF = range(5)
ROWS = "task bigint, batch_id bigint, kind int, a string, b string, slot bigint, x array<double>"


def combine(own, mean, w, k):
    """Input of the activation from a node's own vector and the mean of its k sampled neighbours."""
    if "all" in w:
        return (own + k * mean) / (k + 1.0) @ w["all"]
    return np.hstack([own @ w["self"], mean @ w["neigh"]])


def combine_back(own, mean, w, k, grad):
    """Gradients of combine: for the weights (one array for each), own and mean."""
    if "all" in w:
        inner = grad @ w["all"].T / (k + 1.0)
        return [((own + k * mean) / (k + 1.0)).T @ grad], inner, k * inner
    half = w["self"].shape[1]
    a, b = grad[:, :half], grad[:, half:]
    return [own.T @ a, mean.T @ b], a @ w["self"].T, b @ w["neigh"].T


def _names(w):
    return ["all"] if "all" in w else ["self", "neigh"]


class Support:
    """A batch as arrays: the features of its nodes and of their neighbours, and the places of edges, negatives and neighbours among them."""

    def __init__(self, rows: pa.Table, k: int):
        kind = rows.column("kind").to_numpy()
        a, b = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))

        def part(which):
            at = np.flatnonzero(kind == which)
            return at[np.argsort(a[at].astype(str), kind="stable")]
        root, leaf = part(ROOT), part(LEAF)
        ids, leaves = a[root].astype(str), a[leaf].astype(str)
        column = rows.column("x").combine_chunks() if isinstance(rows.column("x"), pa.ChunkedArray) else rows.column("x")
        self.roots, self.leaves = V.to_numpy(column.take(pa.array(root))), V.to_numpy(column.take(pa.array(leaf)))
        self.leaves = self.leaves if len(leaf) else np.zeros((0, self.roots.shape[1]))
        edges, away, near = (np.flatnonzero(kind == which) for which in (EDGE, NEGATIVE, NEAR))
        edges = edges[np.lexsort((b[edges].astype(str), a[edges].astype(str)))]
        slot = rows.column("slot").to_numpy(zero_copy_only=False)
        self.u, self.v = np.searchsorted(ids, a[edges].astype(str)), np.searchsorted(ids, b[edges].astype(str))
        self.negatives = np.searchsorted(ids, a[away[np.argsort(slot[away].astype(np.int64), kind="stable")]].astype(str))
        self.near = np.full((len(ids), k), -1, np.int64)
        self.near[np.searchsorted(ids, a[near].astype(str)), slot[near].astype(np.int64)] = np.searchsorted(leaves, b[near].astype(str))


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, at, rows)
    return out


def support_step(s: Support, weights: list[dict], k_far: int, neg_weight: float, rng=None, dropout: float = 0.0, back: bool = True):
    """Loss of a batch, summed over its edges, and the gradients of both layers' weights."""
    w0, w1, k = weights[0], weights[1], s.near.shape[1]
    m = s.roots.shape[1] // 2

    def dropped(x):
        keep = (rng.random(x.shape) < 1.0 - dropout) / (1.0 - dropout) if dropout else 1.0
        return x * keep, keep
    (x, _), (mean_x, _) = dropped(s.roots[:, :m]), dropped(s.roots[:, m:])
    (y, _), (mean_y, _) = dropped(s.leaves[:, :m]), dropped(s.leaves[:, m:])
    h0, h1 = relu(combine(x, mean_x, w0, k)), relu(combine(y, mean_y, w0, k_far))
    has = s.near >= 0  # a node without neighbours has none in any slot
    mean = np.einsum("rkd->rd", np.where(has[:, :, None], h1[np.maximum(s.near, 0)], 0.0)) / k if len(h1) else np.zeros_like(h0)
    (own, keep_own), (near, keep_near) = dropped(h0), dropped(mean)
    z = combine(own, near, w1, k)
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    out = z / size
    ga, gb, gn, loss = logistic(out[s.u], out[s.v], np.ones(len(s.u)), out[s.negatives], None, None, neg_weight, False)
    if not back:
        return loss.sum(), None
    g = _sums(np.concatenate([s.u, s.v, s.negatives]), np.vstack([ga, gb, gn]), len(out))
    dz = (g - out * np.sum(out * g, axis=1, keepdims=True)) / size
    top, d_own, d_near = combine_back(own, near, w1, k, dz)
    d0 = d_own * keep_own * (h0 > 0)
    bottom = combine_back(x, mean_x, w0, k, d0)[0]
    if len(h1):
        row, slot = np.nonzero(has)
        d1 = _sums(s.near[row, slot], (d_near * keep_near)[row] / k, len(h1)) * (h1 > 0)
        bottom = [p + q for p, q in zip(bottom, combine_back(y, mean_y, w0, k_far, d1)[0])]
    return loss.sum(), [dict(zip(_names(w0), bottom)), dict(zip(_names(w1), top))]


def _flat(weights, moments) -> np.ndarray:
    return np.concatenate([x.ravel() for w, mo in zip(weights, moments) for n in _names(w) for x in (w[n], *mo[n])])


def _unflat(flat: np.ndarray, like) -> tuple[list, list]:
    weights, moments, at = [], [], 0
    for w in like:
        got = {}
        for n in _names(w):
            size = w[n].size
            got[n] = [flat[at + i * size:at + (i + 1) * size].reshape(w[n].shape) for i in range(3)]
            at += 3 * size
        weights.append({n: x[0] for n, x in got.items()})
        moments.append({n: (x[1], x[2]) for n, x in got.items()})
    return weights, moments


def _batches_of(batches):
    """(task, batch, rows) of a stream in this order."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        task, number = batch.column("task").to_numpy(), batch.column("batch_id").to_numpy()
        bounds = np.flatnonzero(np.diff(task, prepend=-1) | np.diff(number, prepend=-1))
        for lo, hi in zip(bounds, np.append(bounds[1:], len(task))):
            now = (int(task[lo]), int(number[lo]))
            if held and now != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _training(weights, moments, step: int, k: int, k_far: int, neg_weight: float, rate: float, decay: float, dropout: float, seed, back: bool):
    """A row for each task: loss, edges, steps and, after training, the weights with their moments."""
    def run(batches):
        task, now, mo, sums = None, weights, moments, [0.0, 0, 0]

        def row():
            x = _flat(now, mo) if back else np.zeros(1)
            return pa.RecordBatch.from_arrays([pa.array([sums[0]]), pa.array([float(sums[1])]), pa.array([sums[2]], pa.int64()), V.to_arrow(x[None, :])], names=["loss", "n", "steps", "x"])

        for (t, number), rows in _batches_of(batches):
            if t != task:
                if task is not None:
                    yield row()
                task, now, mo, sums = t, weights, moments, [0.0, 0, 0]
            s = Support(rows, k)
            rng = np.random.default_rng([ord(c) for c in f"{seed}|{number}"])
            loss, grads = support_step(s, now, k_far, neg_weight, rng, dropout, back)
            sums = [sums[0] + loss, sums[1] + len(s.u), sums[2] + 1]
            if not back:
                continue
            moved, moments_now = [], []
            for w, g, m in zip(now, grads, mo):
                new = {n: adam_matrix(w[n], *m[n], np.clip((g[n] + decay * w[n]) / max(len(s.u), 1), -5.0, 5.0), step + sums[2], rate) for n in _names(w)}
                moved.append({n: x[0] for n, x in new.items()})
                moments_now.append({n: x[1:] for n, x in new.items()})
            now, mo = moved, moments_now
        if task is not None:
            yield row()

    return run


class Samples:
    """An epoch's samples: k neighbours of each node, and for each node its features beside the means over k and over k_far neighbours.

    With `keep`, when an epoch has several rounds, the features are written once.
    """

    def __init__(self, feats: DataFrame, sampled: DataFrame, samples: tuple, seed, keep: bool):
        self.near = cut(neighbor_subsample(sampled, samples[1], f"{seed}|0"), "near")
        far = neighbor_subsample(sampled, samples[0], f"{seed}|1")
        zeros = F.array_repeat(F.lit(0.0), V.width(feats, "vector"))

        def beside(near):
            mean = over_neighbors(feats, near, V.mean_vectors).withColumnRenamed("vector", "_mean")
            made = feats.join(mean, "id", "left").select("id", F.concat("vector", F.coalesce("_mean", zeros)).alias("x"))
            return cut(made, "features") if keep else made
        self.root, self.leaf = beside(self.near), beside(far)

    def support(self, batches: DataFrame, negatives: DataFrame) -> DataFrame:
        """Rows of ROWS from edges (batch_id, u, v) and draws (batch_id, slot, id)."""
        task = F.floor(F.col("batch_id") / STEPS).alias("task")
        nodes = batches.select("batch_id", F.col("u").alias("id")).union(batches.select("batch_id", F.col("v").alias("id"))).union(negatives.select("batch_id", "id")).distinct()
        met = nodes.withColumnRenamed("id", "src").join(self.near, "src").select("batch_id", "src", "slot", "dst")  # k rows for a node of a batch
        leaves = met.select("batch_id", F.col("dst").alias("id")).distinct()
        none, no_x, no_slot = F.lit(None).cast("string"), F.lit(None).cast("array<double>"), F.lit(None).cast("bigint")
        parts = [
            batches.select(task, "batch_id", F.lit(EDGE).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), no_slot.alias("slot"), no_x.alias("x")),
            negatives.select(task, "batch_id", F.lit(NEGATIVE).alias("kind"), F.col("id").alias("a"), none.alias("b"), "slot", no_x.alias("x")),
            met.select(task, "batch_id", F.lit(NEAR).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "slot", no_x.alias("x")),
            *[lookup(ids, "id", table, "id", {"x": "x"}, ["batch_id"]).select(task, "batch_id", F.lit(kind).alias("kind"), F.col("id").alias("a"), none.alias("b"), no_slot.alias("slot"), "x")
              for ids, table, kind in ((nodes, self.root, ROOT), (leaves, self.leaf, LEAF))]]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.repartition("task").sortWithinPartitions("task", "batch_id", "kind", "a", "slot")

    def drop(self) -> None:
        for table in (self.near, self.root, self.leaf):
            discard(table)


def sage(graph: Graph, attrs: DataFrame, kind: str = "mean", dim: int = 128, samples: tuple = (25, 10), max_degree: int = 100,
         epochs: int = 10, learning_rate: float = 0.01, dropout: float = 0.0, weight_decay: float = 1e-6, neg_sample_size: int = 20,
         val_perc: float = 0.1, batch_size: int = 512, validate_batch_size: int | None = None, seed: int = 0) -> Embedding:
    """kind mean: own and neighbour parts side by side; kind gcn: one mean over both.

    An epoch deals the training edges in a new order into batches of `batch_size`, and each makes one step against `neg_sample_size` negatives of its own.
    The validation edges (an end is a validation node) choose the epoch whose weights make the result.
    `history` has (epoch, training loss); the validation losses are in `val_history`.
    """
    concat = kind == "mean"
    layer = dim // 2 if concat else dim
    flags = cut(node_split(graph.nodes, 0.0, val_perc, seed), "flags")
    fit_on = flags.filter(~F.col("test") & ~F.col("val"))
    feats = cut(standard_scale(attrs, fit_on).select("id", F.col("features").alias("vector")), "features")
    masked = cut(edge_train_mask(graph, flags), "edges")
    kept = graph.with_edges(masked.filter(~F.col("train_removed")).drop("train_removed"))
    degree = cut(train_degree(graph, flags), "degree")
    train_edges = cut(drop_isolated_edges(graph.edges.select("src", "dst"), flags, degree)[0].select(F.col("src").alias("u"), F.col("dst").alias("v")), "pairs")
    val_edges = masked.filter("train_removed").select("src", "dst")
    if validate_batch_size:
        val_edges = subset(val_edges, ["src", "dst"], validate_batch_size, seed)
    val_edges = cut(val_edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "pairs")
    n_train, n_val = train_edges.count(), val_edges.count()
    if not n_train:
        raise ValueError("no training edge")
    guide, totals = negative_table(degree)
    table = cut(guide, "guide"), cut(totals, "totals")
    sampled = cut(neighbor_sample(kept.adj, max_degree, seed), "sampled")
    full = cut(neighbor_sample(graph.adj, max_degree, f"{seed}|full"), "sampled")
    weights = make_weights(kind, [V.width(feats, "vector"), layer, layer], concat, seed=seed)
    moments = [{n: (np.zeros_like(w[n]), np.zeros_like(w[n])) for n in _names(w)} for w in weights]
    k, k_far, neg_weight = samples[1], samples[0], float(neg_sample_size)

    def dealt(edges, n, epoch, key):
        """(batches, draws): edges with their batch, negatives with theirs."""
        rows = minibatches(edges, ["u", "v"], batch_size, epoch, seed).select("batch_id", "u", "v")
        slots = rows.sparkSession.range(-(-n // batch_size)).select(F.col("id").alias("batch_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(neg_sample_size - 1).cast("bigint"))).alias("number"))
        return rows, negative_sample(slots, degree, ["batch_id", "number"], f"{seed}|{key}", table=table).select("batch_id", F.col("number").alias("slot"), F.col("node").alias("id"))

    def passed(rows, back, step=0, key=""):
        run = _training(weights, moments, step, k, k_far, neg_weight, learning_rate, weight_decay, dropout if back else 0.0, f"{seed}|{key}", back)
        made = rows.mapInArrow(run, "loss double, n double, steps bigint, x array<double>")
        return made.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"), F.max("steps").alias("steps"), V.mean_vectors("x", F.col("n")).alias("x")).first()

    check = None
    if n_val:
        held = Samples(feats, full, samples, f"{seed}|val", False)
        check = cut(held.support(*dealt(val_edges, n_val, 0, "val")), "validation").repartition("task").sortWithinPartitions("task", "batch_id", "kind", "a", "slot")
        held.drop()
    history, val_history, best, best_weights, step = [], [], np.inf, weights, 0
    n_batches, each = -(-n_train // batch_size), STEPS * TASKS
    for epoch in range(1, epochs + 1):
        drawn = Samples(feats, sampled, samples, f"{seed}|{epoch}", n_batches > each)
        edges, negatives = dealt(train_edges, n_train, epoch, epoch)
        loss = 0.0
        for first in range(0, n_batches, each):
            part = F.col("batch_id").between(first, first + each - 1)
            got = passed(drawn.support(edges.filter(part), negatives.filter(part)), True, step, epoch)
            weights, moments = _unflat(np.array(got.x), weights)
            loss, step = loss + got.loss, step + got.steps
        drawn.drop()
        history.append((epoch, loss / n_train))
        score = history[-1][1]
        if check is not None:
            score = passed(check, False).loss / n_val
            val_history.append((epoch, score))
        if score < best:
            best, best_weights = score, weights
    out = Embedding(cut(infer_embeddings(feats, full, best_weights, list(samples), kind, concat, f"{seed}|out"), "sage"), history)
    out.val_history = val_history
    out.weights = best_weights
    return out


def sagemean(graph: Graph, attrs: DataFrame, **options) -> Embedding:
    return sage(graph, attrs, "mean", **options)


def sagegcn(graph: Graph, attrs: DataFrame, **options) -> Embedding:
    return sage(graph, attrs, "gcn", **options)
