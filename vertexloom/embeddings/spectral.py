"""Embeddings from decompositions."""

import math

from pyspark.sql import DataFrame, functions as F

from ..operators.graph import Graph
from ..operators.linalg import dim_reduction, svd_scaled, zero_filled
from ..operators.matrix import log_ppmi, matmul, row_probdist, top_cells
from ..plans.lineage import cut
from .result import Embedding

EVEN = "\u0000even"  # row that stands for all nodes without neighbours


def attrpure(attrs: DataFrame, dim: int = 128, mode: str = "pca") -> Embedding:
    """Reduced attributes; the structure is not used."""
    return Embedding(dim_reduction(attrs, dim, mode))


def _with_dead_ends(moved: DataFrame, before: DataFrame, empty: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Adds what rows held on nodes without successor, which goes to all nodes alike: such a row has n cells from then on.

    Rows and nodes meet by blocks of nodes, so a row's cells are made in as many tasks as there are blocks.
    """
    held = before.join(empty.withColumnRenamed("row", "col"), "col", "left_semi").groupBy("row").agg(F.sum("value").alias("_held"))
    blocks = max(1, n // 10_000)
    spread = held.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = nodes.select(F.col("id").alias("col"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block"))
    even = spread.join(placed, "_block").select("row", "col", (F.col("_held") / n).alias("value"))
    return moved.unionByName(even).groupBy("row", "col").agg(F.sum("value").alias("value"))


def grarep(graph: Graph, dim: int = 128, kstep: int = 4, seed: int = 0, top_per_row: int | None = None) -> Embedding:
    """For k = 1..kstep: positive log of the k-step transition matrix, its SVD, unit rows; side by side.

    A node without neighbours has 1/n in every cell of its row. All such rows are equal in every power,
    so one row stands for them; counted n0 times it scales by sqrt(n0), which the unit length removes.
    """
    if dim % kstep:
        raise ValueError("dim is a multiple of kstep")
    part = dim // kstep
    n = graph.nodes.count()
    one, empty = row_probdist(graph.adj.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")),
                              graph.nodes.select(F.col("id").alias("row")))
    one, empty = cut(one, "step"), cut(empty, "empty")
    n0 = empty.count()
    power = one
    even = graph.nodes.select(F.col("id").alias("col"), F.lit(1.0 / n).alias("value")) if n0 else None
    out = None
    for k in range(1, kstep + 1):
        if k > 1:
            power = _with_dead_ends(matmul(power, one), power, empty, graph.nodes, n) if n0 and graph.directed else matmul(power, one)
            power = cut(power, "power")
            if top_per_row:
                power = cut(top_cells(power, top_per_row), "power")
            if n0:
                held = even.join(empty.withColumnRenamed("row", "col"), "col", "left_semi").agg(F.sum("value")).first()[0] or 0.0
                moved = matmul(even.withColumn("row", F.lit(EVEN)), one).select("col", F.col("value").alias("_moved"))
                even = cut(graph.nodes.select(F.col("id").alias("col")).join(moved, "col", "left")
                           .select("col", (F.coalesce("_moved", F.lit(0.0)) + held / n).alias("value")), "even")
        cells, sums = power, power.groupBy("col").agg(F.sum("value").alias("_sum"))
        if n0:
            cells = cells.unionByName(even.select(F.lit(EVEN).alias("row"), "col", "value"))
            sums = cells.groupBy("col").agg(F.sum(F.when(F.col("row") == EVEN, n0 * F.col("value")).otherwise(F.col("value"))).alias("_sum"))
        score = log_ppmi(cells, n, sums)
        if n0:
            score = score.withColumn("value", F.when(F.col("row") == EVEN, math.sqrt(n0) * F.col("value")).otherwise(F.col("value")))
        rows = cut(svd_scaled(score, part, 0.5, seed=f"{seed}|{k}"), "rows")
        if n0:
            shared = rows.filter(F.col("id") == EVEN).select("vector")
            if not shared.isEmpty():
                vec = F.array(*[F.lit(float(x)) for x in shared.first().vector])
                rows = rows.filter(F.col("id") != EVEN).unionByName(empty.select(F.col("row").alias("id"), vec.alias("vector")))
        rows = zero_filled(graph.nodes, rows, part).withColumnRenamed("vector", f"_v{k}")
        out = rows if out is None else out.join(rows, "id")
    return Embedding(cut(out.select("id", F.concat(*[f"_v{k}" for k in range(1, kstep + 1)]).alias("vector")), "grarep"))
