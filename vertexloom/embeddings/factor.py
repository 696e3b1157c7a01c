"""Joint factorisations of structure and attributes."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators.cells import cell_blocks, cell_sums, multiply_blocks
from ..operators.graph import Graph
from ..operators.linalg import matrix_sums, svd_cells, svd_features, truncated_svd, zero_filled
from ..operators.matrix import row_probdist
from ..plans.lineage import cut
from ..plans.skew import counted, lookup
from .result import Embedding


def tadw(graph: Graph, attrs: DataFrame, dim: int = 128, lamb: float = 0.2, maxiter: int = 10, seed: int = 0,
         transposed_h_step: bool = False) -> Embedding:
    """Fit M = (A + A^2)/2 by W'HT with T the attributes (at most 200 columns) and ridge lamb.

    With F = MT' (two passes over the edges), G = TT' and Q = F'F, both steps need only matrices of the
    attribute width: W = (2HGH' + lamb)^-1 2HF' for every node, and H from a system that the
    eigenvectors of WW' and G make diagonal. The nodes are read again only for the result, which has 2*dim
    values. `transposed_h_step` uses M' where the gradient of the loss has M.
    """
    feats = cut(svd_features(attrs), "features")
    m = V.width(feats, "features")
    cells, _ = row_probdist(graph.adj.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")))
    cells = cut(cells, "cells")
    blocks = cell_blocks(cells, cells.count(), graph.nodes.count())

    def twice(c, name):
        """id -> (c + c^2)/2 times the features."""
        base = feats.select("id", F.col("features").alias("vector"))
        once = cut(zero_filled(graph.nodes, multiply_blocks(c, base), m), name)
        again = multiply_blocks(c, once).withColumnRenamed("vector", "_again")
        mean = F.zip_with("vector", F.coalesce("_again", F.array_repeat(F.lit(0.0), m)), lambda x, y: (x + y) / 2.0)
        return once.join(again, "id", "left").select("id", mean.alias(name))

    rows = feats.join(twice(blocks, "f"), "id")
    rows = rows.join(twice(blocks.flipped(), "ft"), "id") if transposed_h_step else rows.withColumn("ft", F.col("f"))
    rows = cut(rows, "products")
    g, q, qt = matrix_sums(rows, ["features", "f", "ft"], lambda x, f, ft: [x.T @ x, f.T @ f, f.T @ ft], [(m, m)] * 3)
    h = np.random.default_rng(seed).standard_normal((dim, m))
    gamma, right = np.linalg.eigh((g + g.T) / 2)
    history, eye = [], np.eye(dim)
    for step in range(maxiter):
        w_map = np.linalg.solve(2 * h @ g @ h.T + lamb * eye, 2 * h)  # W = w_map F'
        ww, wf = w_map @ q @ w_map.T, w_map @ qt
        lam, left = np.linalg.eigh((ww + ww.T) / 2)
        h = left @ ((left.T @ wf @ right) / (np.maximum(lam, 0)[:, None] * np.maximum(gamma, 0)[None, :] + lamb)) @ right.T
        # the loss without the constant |M|^2
        history.append((step + 1, np.trace(ww @ h @ g @ h.T) - 2 * np.trace(h @ (w_map @ q).T) + lamb / 2 * np.trace(ww) + lamb * np.sum(h * h)))
    both = V.row_map2(lambda f, x: np.hstack([V.unit_rows(f @ w_map.T), V.unit_rows(x @ h.T)]))
    return Embedding(rows.select("id", both("f", "features").alias("vector")), history)


def _attribute_axes(attrs: DataFrame, dim: int, seed) -> DataFrame:
    """(id, vector): left singular vectors of at most 10 dim columns of the attributes."""
    m = V.width(attrs, "features")
    columns = sorted(np.random.default_rng(seed).permutation(m)[:10 * dim].tolist())
    part = attrs.select("id", V.row_map(lambda x: x[:, columns])(F.col("features").cast("array<double>")).alias("features"))
    scaled, values = truncated_svd(part, min(dim, len(columns)))
    return scaled.select("id", V.row_map(lambda x: x / np.where(values > 0, values, 1.0))("vector").alias("vector"))


def aane(graph: Graph, attrs: DataFrame | None, dim: int = 128, lambd: float = 0.05, rho: float = 5.0, maxiter: int = 10,
         mode: str = "comb", start: str = "structure", seed: int = 0) -> Embedding:
    """ADMM on |S - HZ'|^2 + lambd * sum a_ij |h_i - z_j| with S the cosine similarity of the attributes.

    S is never formed: SZ = X(X'Z) with unit rows X. A node's update needs its own row, sums over its
    neighbours and dim x dim matrices, and (2Z'Z + c)^-1 for every c follows from one eigen
    decomposition. Mode pure takes the rows of the adjacency matrix as attributes. The vectors start from the left singular vectors of the 10 dim
    columns of the adjacency matrix with the largest sums, or (start "attributes") of 10 dim columns of the attributes, chosen by seed.
    """
    if start not in ("structure", "attributes") or (start == "attributes" and mode == "pure"):
        raise ValueError("start is structure, or attributes where there are some")
    cells = graph.adj.filter("src <> dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))
    cells = cut(cells, "cells")
    nodes = graph.nodes.count()
    blocks = cell_blocks(cells, cells.count(), nodes)
    if start == "attributes":
        first = _attribute_axes(attrs, dim, seed)
    else:
        best = (cells.groupBy("col").agg(F.sum("value").alias("s")).orderBy(F.col("s").desc(), "col").limit(10 * dim).select("col"))
        first, _ = svd_cells(cells.join(F.broadcast(best), "col", "left_semi"), dim, power=0.0, seed=seed)
    state = zero_filled(graph.nodes, first, dim).select("id", F.col("vector").alias("h"), F.col("vector").alias("z"),
                                                        F.array_repeat(F.lit(0.0), dim).alias("u"))
    if mode == "pure":
        norms = cells.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_len"))
        unit_cells = cut(lookup(cells, "row", norms, "row", {"_len": "_len"}, ["col"], counts=counted(cells, "row"))
                         .select("row", "col", (F.col("value") / F.col("_len")).alias("value")), "unit")
        unit_blocks = cell_blocks(unit_cells, unit_cells.count(), nodes)
        state = state.withColumn("x", F.array().cast("array<double>"))
    else:
        state = state.join(attrs.select("id", V.unit_vector("features").alias("x")), "id")
    state = cut(state, "state")
    m = 0 if mode == "pure" else V.width(state, "x")
    history = []

    def pull(value, here, there):
        """Weights of the cells whose ends differ, and the far ends times these."""
        gap = np.sqrt(np.square(here - there).sum(1))
        w = np.where(gap > 0, lambd * value / np.where(gap > 0, gap, 1.0), 0.0)[:, None]
        return np.hstack([w, w * there])

    def update(state: DataFrame, own: str, other: str, sign: float) -> DataFrame:
        """New value of column `own` from column `other`; sign -1 is the step for H, +1 the step for Z."""
        shapes = [(dim, dim)] + ([] if mode == "pure" else [(m, dim)])
        sums = matrix_sums(state, [other] + ([] if mode == "pure" else ["x"]),
                           (lambda z: [z.T @ z]) if mode == "pure" else (lambda z, x: [z.T @ z, x.T @ z]), shapes)
        values, axes = np.linalg.eigh((sums[0] + sums[0].T) / 2)
        if mode == "pure":
            back = multiply_blocks(unit_blocks.flipped(), state.select("id", F.col(other).alias("vector")))
            similar = multiply_blocks(unit_blocks, back).withColumnRenamed("vector", "s")
        else:
            mix = sums[1]
            similar = state.select("id", V.times(F.col("x"), mix).alias("s"))
        near = cell_sums(blocks, state.select("id", F.col(other).alias("vector")), pull, state.select("id", F.col(own).alias("vector")))
        near = near.select("id", F.col("vector")[0].alias("c"), F.slice("vector", 2, dim).alias("wz"))
        zeros = F.array_repeat(F.lit(0.0), dim)

        def solve(block):
            s, wz, z, u, c = block[:, :dim], block[:, dim:2 * dim], block[:, 2 * dim:3 * dim], block[:, 3 * dim:4 * dim], block[:, -1:]
            rhs = 2 * s + wz + rho * (z + sign * u)
            return (rhs @ axes) / (2 * np.maximum(values, 0)[None, :] + rho + c) @ axes.T
        rows = state.join(similar, "id", "left").join(near, "id", "left")
        packed = F.concat(F.coalesce("s", zeros), F.coalesce("wz", zeros), other, "u", F.array(F.coalesce("c", F.lit(0.0))))
        new = rows.withColumn("_new", V.row_map(solve)(packed))
        keep = [F.col("_new").alias(c) if c == own else F.col(c) for c in ("id", "h", "z", "u", "x")]
        return new.select(*keep)

    state = cut(update(state, "h", "z", -1.0), "state")
    for step in range(maxiter):
        state = update(state, "z", "h", 1.0)
        moved = F.transform(F.arrays_zip("u", "h", "z"), lambda e: e["u"] + e["h"] - e["z"])
        state = cut(state.withColumn("u", moved), "state")
        state = cut(update(state, "h", "z", -1.0), "state")
        gap = state.agg(F.sum(F.aggregate(F.zip_with("h", "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).first()[0]
        history.append((step + 1, gap))
    return Embedding(state.select("id", F.col("h").alias("vector")), history)
