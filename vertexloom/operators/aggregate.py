"""Neighbourhood aggregation over sampled neighbours (src, slot, dst).

A node's own vector is multiplied by the small weight matrices before anything is shuffled, so a join
moves vectors of the output width. A node without neighbours sees zeros, as a dummy node would give.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..plans.skew import lookup
from .sampling import neighbor_subsample


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def glorot(rows: int, cols: int, rng: np.random.Generator) -> np.ndarray:
    limit = np.sqrt(6.0 / (rows + cols))
    return rng.uniform(-limit, limit, (rows, cols))


def over_neighbors(values: DataFrame, sampled: DataFrame, how, counts=None) -> DataFrame:
    """(id, vector): `how` (a vector aggregate) over the vectors of the sampled neighbours."""
    rows = lookup(sampled, "dst", values, "id", {"vector": "vector"}, ["src", "slot"], counts=counts)
    return rows.groupBy(F.col("src").alias("id")).agg(how("vector").alias("vector"))


def _finish(own: DataFrame, near: DataFrame, empty: np.ndarray, weights: np.ndarray | None, concat: bool, act: bool) -> DataFrame:
    def join_parts(a, b):
        b = b if weights is None else b @ weights
        out = np.concatenate([a, b], axis=1) if concat else a + b
        return relu(out) if act else out
    filler = F.array(*[F.lit(float(x)) for x in empty])
    rows = own.withColumnRenamed("vector", "_own").join(near, "id", "left")
    return rows.select("id", V.row_map2(join_parts)("_own", F.coalesce("vector", filler)).alias("vector"))


def agg_mean(hidden: DataFrame, sampled: DataFrame, weights: dict, concat: bool = True, act: bool = True,
             self_hidden: DataFrame | None = None) -> DataFrame:
    """relu([x.self, mean(neighbours).neigh]), side by side or added."""
    own = (self_hidden or hidden).select("id", V.times(F.col("vector"), weights["self"]).alias("vector"))
    sent = hidden.select("id", V.times(F.col("vector"), weights["neigh"]).alias("vector"))
    near = over_neighbors(sent, sampled, V.mean_vectors)
    return _finish(own, near, np.zeros(weights["neigh"].shape[1]), None, concat, act)


def agg_gcn(hidden: DataFrame, sampled: DataFrame, weights: dict, num_samples: int, act: bool = True,
            self_hidden: DataFrame | None = None) -> DataFrame:
    """relu(mean(neighbours and self).all)."""
    matrix = weights["all"] / (num_samples + 1.0)
    own = (self_hidden or hidden).select("id", V.times(F.col("vector"), matrix).alias("vector"))
    sent = hidden.select("id", V.times(F.col("vector"), matrix).alias("vector"))
    near = over_neighbors(sent, sampled, V.sum_vectors)
    return _finish(own, near, np.zeros(matrix.shape[1]), None, False, act)


def _dense(x: np.ndarray, layers: list) -> np.ndarray:
    for matrix, bias in layers:
        x = relu(x @ matrix + bias)
    return x


def agg_pool(hidden: DataFrame, sampled: DataFrame, weights: dict, pool: str = "max", concat: bool = True, act: bool = True,
             self_hidden: DataFrame | None = None) -> DataFrame:
    """Max or mean over dense layers of the neighbours, then as agg_mean. `weights['mlp']` lists the layers.

    The dense layers are applied once for each node, not once for each edge.
    """
    layers = weights["mlp"]
    own = (self_hidden or hidden).select("id", V.times(F.col("vector"), weights["self"]).alias("vector"))
    sent = hidden.select("id", V.row_map(lambda x: _dense(x, layers))(F.col("vector")).alias("vector"))
    near = over_neighbors(sent, sampled, V.max_vectors if pool == "max" else V.mean_vectors)
    empty = _dense(np.zeros((1, layers[0][0].shape[0])), layers)[0]
    return _finish(own, near, empty, weights["neigh"], concat, act)


def agg_maxpool(hidden, sampled, weights, concat=True, act=True, self_hidden=None) -> DataFrame:
    return agg_pool(hidden, sampled, weights, "max", concat, act, self_hidden)


def agg_meanpool(hidden, sampled, weights, concat=True, act=True, self_hidden=None) -> DataFrame:
    return agg_pool(hidden, sampled, weights, "mean", concat, act, self_hidden)


def agg_maxpool2(hidden, sampled, weights, concat=True, act=True, self_hidden=None) -> DataFrame:
    """agg_maxpool with two dense layers."""
    if len(weights["mlp"]) != 2:
        raise ValueError("two dense layers expected")
    return agg_pool(hidden, sampled, weights, "max", concat, act, self_hidden)


def make_weights(kind: str, dims: list[int], concat: bool = True, hidden: tuple = (512,), seed: int = 0) -> list[dict]:
    """Glorot weights for each layer; dims are the input width and the width of each layer."""
    rng = np.random.default_rng(seed)
    out = []
    for layer, (width_in, width_out) in enumerate(zip(dims, dims[1:])):
        rows = width_in * (2 if concat and layer and kind != "gcn" else 1)
        if kind == "gcn":
            out.append({"all": glorot(rows, width_out, rng)})
            continue
        made = {"self": glorot(rows, width_out, rng)}
        if kind == "mean":
            made["neigh"] = glorot(rows, width_out, rng)
        else:
            sizes = [rows, *hidden]
            made["mlp"] = [(glorot(a, b, rng), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
            made["neigh"] = glorot(sizes[-1], width_out, rng)
        out.append(made)
    return out


def propagate(features: DataFrame, sampled: DataFrame, weights: list[dict], num_samples: list[int], kind: str = "mean",
              concat: bool = True, seed: int = 0) -> DataFrame:
    """Apply an aggregator for each layer, for all nodes at once; the last layer has no relu.

    Hop h of a node looks at num_samples[last - h] of its sampled neighbours. `features` has (id, vector).
    """
    last = len(weights) - 1
    hops = [neighbor_subsample(sampled, num_samples[last - h], f"{seed}|{h}") for h in range(len(weights))]
    hidden = [features] * (len(weights) + 1)
    for layer, w in enumerate(weights):
        act = layer < last
        step = []
        for hop in range(len(weights) - layer):
            if kind == "gcn":
                got = agg_gcn(hidden[hop + 1], hops[hop], w, num_samples[last - hop], act, hidden[hop])
            elif kind == "mean":
                got = agg_mean(hidden[hop + 1], hops[hop], w, concat, act, hidden[hop])
            else:
                got = agg_pool(hidden[hop + 1], hops[hop], w, "mean" if kind == "meanpool" else "max", concat, act, hidden[hop])
            step.append(got)
        hidden = step
    return hidden[0]


def infer_embeddings(features: DataFrame, sampled: DataFrame, weights: list[dict], num_samples: list[int],
                     kind: str = "mean", concat: bool = True, seed: int = 0) -> DataFrame:
    """One l2-normalised vector for every node; `sampled` comes from the full adjacency."""
    out = propagate(features, sampled, weights, num_samples, kind, concat, seed)
    return out.withColumn("vector", V.unit_vector("vector"))
