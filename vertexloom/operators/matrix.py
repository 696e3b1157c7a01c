"""Matrices as tables: sparse ones are (row, col, value) cells, dense ones have a vector for each row."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..plans.lineage import cut
from ..plans.skew import lookup, salted_join
from .graph import Graph, avg_degree, degrees
from .products import block_product

HOT_PRODUCTS = 100_000_000
BLOCK_PAIRS, BLOCK_VECTORS = 2_000_000, 100_000  # pairs and vectors of one side that a block of pairs is meant to have


def row_probdist(cells: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Divide each cell by its row sum (a zero sum leaves the row as it is).

    With the table of all row ids, the second result lists the rows that sum to zero. Where a strict
    distribution is wanted these stand for 1/n in every column; they are kept as a list, not as n cells.
    """
    sums = cells.groupBy("row").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("n"))
    scaled = (lookup(cells, "row", sums, "row", {"_sum": "_sum"}, ["col"], counts=sums.select("row", "n"))
              .select("row", "col", F.when(F.col("_sum") != 0, F.col("value") / F.col("_sum")).otherwise(F.col("value")).alias("value")))
    if rows is None:
        return scaled, None
    return scaled, rows.select("row").join(sums.filter("_sum <> 0"), "row", "left_anti")


def _match(a, b):
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return same / F.size(a)


def _set(a, b):
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    some = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(some > 0, both / some).otherwise(F.lit(0.0))


def _minkowski(power):
    def score(a, b):
        total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y) ** power), F.lit(0.0), lambda s, x: s + x)
        return -(total ** (1.0 / power))
    return score


METRICS = {"cosine": V.cosine, "jaccard_match": _match, "jaccard_set": _set,
           "euclidean": _minkowski(2), "manhattan": _minkowski(1), "dot": V.dot}


def with_pair_vectors(pairs: DataFrame, vectors: DataFrame, column: str, u: str = "u", v: str = "v") -> DataFrame:
    """Pairs with the vectors of both ends as `_a` and `_b`; hot ends are spread."""
    rows = lookup(pairs, u, vectors, "id", {column: "_a"}, [v])
    return lookup(rows, v, vectors, "id", {column: "_b"}, [u])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


#: The metrics on rows of two matrices. What a null makes null is null, but a cosine is 0 where a norm is not above 0.
ROW_METRICS = {"dot": _dots, "euclidean": lambda a, b: -np.sqrt(_dots(a - b, a - b)), "manhattan": lambda a, b: -np.abs(a - b).sum(1),
               "cosine": lambda a, b: _dots(a, b) / (np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b)))}


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of an Arrow list column, shorter ones filled up, their widths, and which have no null."""
    width = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    flat = vectors.flatten()
    gaps = np.asarray(pc.is_null(flat))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
    rows = np.repeat(np.arange(len(width)), width)
    out = np.zeros((len(width), width.max(initial=0)))
    out[rows, place] = np.asarray(pc.fill_null(flat, 0.0), np.float64)
    whole = np.asarray(pc.is_valid(vectors))
    whole[rows[gaps]] = False
    return out, width, whole


def _met(asked, ids) -> tuple[np.ndarray, np.ndarray]:
    """(places in asked, places in ids) of all equal values."""
    known = ids.unique()
    code, want = np.asarray(pc.index_in(ids, known)), pc.index_in(asked, known)
    order, found = np.argsort(code, kind="stable"), np.flatnonzero(np.asarray(pc.is_valid(want)) & np.asarray(pc.is_valid(asked)))
    want = np.asarray(pc.fill_null(want, 0))[found]
    start = np.searchsorted(code[order], np.arange(len(known) + 1))
    times = start[want + 1] - start[want]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(found, times), order[np.repeat(start[want], times) + within]


def _scorer(metric: str, u: str, v: str, columns: list[str]):
    def score(pairs: pa.Table, sides: pa.Table) -> pa.Table:
        left, right = (sides.filter(pc.equal(sides.column("_side"), k)) for k in (0, 1))
        rows, a = _met(pairs.column(u).combine_chunks(), left.column("_id").combine_chunks())
        again, b = _met(pairs.column(v).combine_chunks().take(pa.array(rows)), right.column("_id").combine_chunks())
        rows, a = rows[again], a[again]
        (x, wx, ox), (y, wy, oy) = (_matrix(t.column("_vec").combine_chunks()) for t in (left, right))
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        sim, fits = np.zeros(len(rows)), ox[a] & oy[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in range(0, len(rows), 16_384):
                here = slice(at, at + 16_384)
                sim[here] = ROW_METRICS[metric](x[a[here]], y[b[here]])
        same = wx[a] == wy[b]
        if metric == "cosine":
            some = fits & ((_dots(x, x) != 0)[a] & (_dots(y, y) != 0)[b])
            sim, null = np.where(some, sim, 0.0), some & ~same
        else:
            null = ~(fits & same)
        out = pairs.select(columns).take(pa.array(rows))
        return out.append_column("sim", pa.array(sim, mask=null))
    return score


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, metric: str, rows: int | None = None, u: str = "u", v: str = "v") -> DataFrame:
    """Pairs and the column `sim`, one of ROW_METRICS of the vectors (id, vec) of both ends.

    Where there are many pairs for a vector these are dealt into blocks by both ends, and a vector goes to each block of its row or column: it is
    copied for blocks, not for pairs. `rows` is the number of pairs, counted where it is not known.
    """
    n = max(left.count(), right.count())
    m = pairs.count() if rows is None else rows
    parts = max(2, math.ceil(math.sqrt(m / BLOCK_PAIRS)), math.ceil(n / BLOCK_VECTORS))
    if parts * n >= m:
        left, right = (side.withColumn("vec", F.col("vec").cast("array<double>")) for side in (left, right))
        met = lookup(lookup(pairs, u, left, "id", {"vec": "_a"}, [v]), v, right, "id", {"vec": "_b"}, [u])
        return met.select(*pairs.columns, METRICS[metric](F.col("_a"), F.col("_b")).alias("sim"))
    where = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sides = (left.select(F.lit(0).alias("_side"), where("id").alias("_bu"), every.alias("_bv"), F.col("id").alias("_id"), F.col("vec").alias("_vec"))
             .unionByName(right.select(F.lit(1).alias("_side"), where("id").alias("_bv"), every.alias("_bu"), F.col("id").alias("_id"), F.col("vec").alias("_vec"))))
    dealt = pairs.withColumns({"_bu": where(u), "_bv": where(v)})
    schema = pairs.schema.simpleString()[7:-1] + ",sim:double"
    return dealt.groupBy("_bu", "_bv").cogroup(sides.groupBy("_bu", "_bv")).applyInArrow(_scorer(metric, u, v, pairs.columns), schema)


def pair_similarity(pairs: DataFrame, attrs: DataFrame, metric: str = "cosine", column: str = "features", rows: int | None = None) -> DataFrame:
    """Similarity of the given pairs: cosine, jaccard_match, jaccard_set, euclidean, manhattan or dot.

    The two distances are negated, so that larger is always more alike. `rows`: the number of pairs, if it is known.
    """
    if metric in ROW_METRICS:
        vectors = attrs.select("id", F.col(column).alias("vec"))
        return pair_scores(pairs, vectors, vectors, metric, rows)
    return with_pair_vectors(pairs, attrs, column).withColumn("sim", METRICS[metric](F.col("_a"), F.col("_b"))).drop("_a", "_b")


def pair_affinity(pairs: DataFrame, emb: DataFrame, bilinear: np.ndarray | None = None) -> DataFrame:
    """u.v, or u'Av with a small matrix A, which meets each vector once."""
    left = emb.select("id", F.col("vector").alias("vec"))
    right = left if bilinear is None else left.withColumn("vec", V.times(F.col("vec"), np.asarray(bilinear).T))
    return pair_scores(pairs, left, right, "dot").withColumnRenamed("sim", "affinity")


def deg2beta(degree: Column, alpha: float) -> Column:
    """Degree 0..inf to beta 1..0."""
    return F.pow(1.0 + F.pow(degree.cast("double"), F.lit(float(alpha))), F.lit(-1.0 / alpha))


def biased_transition(graph: Graph, attr_sim: DataFrame, mode: int = 1, beta: float = 0.2,
                      alpha: float = 2.71828) -> tuple[DataFrame, DataFrame]:
    """T = (1-b) T_A + b T_X from the graph and the top-k attribute similarities (row, col, sim).

    Returns the cells of T and, for the rows whose T_X is 1/n everywhere, (row, mass = b): the part
    of the row that is spread evenly over all nodes.
    """
    if mode not in (1, 2, 3):
        raise ValueError("mode is 1, 2 or 3")
    if graph.directed and mode != 1:
        raise ValueError("modes 2 and 3 need an undirected graph")
    ids = graph.nodes.select(F.col("id").alias("row"))
    t_a, _ = row_probdist(graph.adj.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value")))
    t_x, even = row_probdist(attr_sim.select("row", "col", F.col("sim").alias("value")), ids)
    if mode == 3:
        share = degrees(graph).select(F.col("id").alias("row"), deg2beta(2 * F.col("degree"), alpha).alias("b"))
    else:
        if mode == 2:
            beta_col = deg2beta(F.lit(avg_degree(graph).first().avg_degree), alpha)
        else:
            beta_col = F.lit(float(beta))
        linked = graph.out_counts.select(F.col("src").alias("row"), F.lit(True).alias("_linked"))
        share = ids.join(linked, "row", "left").select("row", F.when(F.col("_linked"), beta_col).otherwise(1.0).alias("b"))
    struct_part = (lookup(t_a, "row", share, "row", {"b": "b"}, ["col"])
                   .select("row", "col", ((1.0 - F.col("b")) * F.col("value")).alias("value")))
    attr_part = t_x.join(share, "row").select("row", "col", (F.col("b") * F.col("value")).alias("value"))
    cells = (struct_part.unionByName(attr_part).groupBy("row", "col").agg(F.sum("value").alias("value"))
             .filter(F.col("value") != 0))
    return cells, even.join(share, "row").select("row", F.col("b").alias("mass")).filter("mass > 0")


def _packs(a: DataFrame, b: DataFrame) -> tuple[int, int] | None:
    """The cells of both factors, if block_product can take them: doubles without null."""
    if any(dict(x.dtypes)["value"] != "double" for x in (a, b)) or dict(a.dtypes)["col"] != dict(b.dtypes)["row"]:
        return None
    if any(dict(x.dtypes)[c] not in ("string", "int", "bigint") for x in (a, b) for c in ("row", "col")):
        return None
    counts = [x.agg(F.count(F.lit(1)), F.count("value")).first() for x in ((a,) if a is b else (a, b))]
    return None if any(n != known for n, known in counts) else (counts[0][0], counts[-1][0])


def matmul(a: DataFrame, b: DataFrame, hot_products: int = HOT_PRODUCTS) -> DataFrame:
    """Sparse product on a grid of blocks. Cells with null or other values than doubles meet by a join, where an inner index with very many products
    is split over several tasks."""
    if cells := _packs(a, b):
        return block_product(a, b, *cells)
    left = a.select("row", F.col("col").alias("mid"), F.col("value").alias("_x"))
    right = b.select(F.col("row").alias("mid"), "col", F.col("value").alias("_y"))
    work = (left.groupBy("mid").agg(F.count(F.lit(1)).alias("_n"))
            .join(right.groupBy("mid").agg(F.count(F.lit(1)).alias("_m")), "mid")
            .select("mid", (F.col("_n") * F.col("_m")).alias("n")))
    return (salted_join(left, right, ["mid"], ["row"], counts=work, hot_rows=hot_products)
            .groupBy("row", "col").agg(F.sum(F.col("_x") * F.col("_y")).alias("value")))


def top_cells(cells: DataFrame, k: int) -> DataFrame:
    """The k largest cells of each row, lower column first on ties."""
    best = Window.partitionBy("row").orderBy(F.col("value").desc(), "col")
    return cells.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def matpow(cells: DataFrame, k: int, top_per_row: int | None = None) -> DataFrame:
    """k-step product; `top_per_row` (off unless asked for) keeps only the largest cells of each row."""
    cells = cut(cells, "cells")
    out = cells
    for step in range(k - 1):
        out = matmul(out if step == 0 else cut(out, "power"), cells)
        if top_per_row:
            out = top_cells(out, top_per_row)
    return out


def log_ppmi(cells: DataFrame, n: int, col_sums: DataFrame | None = None) -> DataFrame:
    """max(0, log(value / column sum) - log(1/n)) for the non-zero cells; every other cell is 0."""
    cells = cells if col_sums is not None else cut(cells, "cells")
    sums = col_sums if col_sums is not None else cells.groupBy("col").agg(F.sum("value").alias("_sum"))
    score = F.log(F.col("value") / F.col("_sum")) - F.log(F.lit(1.0 / n))
    return (lookup(cells, "col", sums, "col", {"_sum": "_sum"}, ["row"]).filter("value > 0")
            .select("row", "col", F.greatest(score, F.lit(0.0)).alias("value")))


def log_ppmi_of_power(cells: DataFrame, k: int, n: int) -> DataFrame:
    """log_ppmi(matpow(cells, k), n) for cells that are not negative, with no power written but those before the last.

    The column sums of the power come from k passes of one row of sums over the cells, and the columns of the last factor are divided by them, so the
    cells of the power are neither stored nor joined with their sums.
    """
    cells = cut(cells, "cells")
    sums = cut(cells.groupBy("col").agg(F.sum("value").alias("_sum")), "sums")
    for _ in range(k - 1):
        passed = lookup(cells, "row", sums, "col", {"_sum": "_sum"}, ["col"])
        sums = cut(passed.groupBy("col").agg(F.sum(F.col("value") * F.col("_sum")).alias("_sum")), "sums")
    last = lookup(cells, "col", sums.filter("_sum > 0"), "col", {"_sum": "_sum"}, ["row"]).select("row", "col", (F.col("value") / F.col("_sum")).alias("value"))
    share = last if k == 1 else matmul(matpow(cells, k - 1), last)
    score = F.log("value") - F.log(F.lit(1.0 / n))
    return share.filter("value > 0").select("row", "col", F.greatest(score, F.lit(0.0)).alias("value"))


def l2_normalize(emb: DataFrame, column: str = "vector") -> DataFrame:
    return emb.withColumn(column, V.unit_vector(column))


def standard_scale(attrs: DataFrame, fit_on: DataFrame, column: str = "features") -> DataFrame:
    """Centre and divide by the population deviation of the fitted rows; a constant column keeps its scale."""
    got = (attrs.join(fit_on.select("id"), "id", "left_semi")
           .select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.col(column))).alias("s"))
           .select("s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var")).first())
    mean = np.array(got["mean"])
    std = np.sqrt(np.array(got["var"]) * (got["count"] - 1) / max(got["count"], 1))
    std[std == 0] = 1.0
    return attrs.withColumn(column, V.row_map(lambda x: (x - mean) / std)(F.col(column)))


def combine_vectors(left: DataFrame, right: DataFrame, mode: str = "concat") -> DataFrame:
    """Join two embeddings by id: concat, elementwise-mean or elementwise-max."""
    both = left.select("id", F.col("vector").alias("_a")).join(right.select("id", F.col("vector").alias("_b")), "id")
    if mode == "concat":
        out = F.concat("_a", "_b")
    elif mode == "elementwise-mean":
        out = F.zip_with("_a", "_b", lambda x, y: (x + y) / 2.0)
    elif mode == "elementwise-max":
        out = F.zip_with("_a", "_b", lambda x, y: F.greatest(x, y))
    else:
        raise ValueError("mode is concat, elementwise-mean or elementwise-max")
    return both.select("id", out.alias("vector"))
