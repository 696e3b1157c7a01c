"""Top-k attribute neighbours without comparing every pair.

Equal vectors are handled once: all copies share one ranking, and only the k lowest ids of a vector
can ever be ranked, so a vector with very many copies costs no more than any other. The distinct
vectors are put into cells around about sqrt(n) pivots and the cells into blocks of bounded size. A query visits a cell only when the triangle inequality allows a point there to be among its k
nearest (exact), or only its nearest cells (approximate): `probes` of them, or as many as a sample of queries needs for
`recall`. Each task compares one block of queries with one block of candidates, cell by cell. There are some 16 blocks of queries and 4 of
candidates up to half a million vectors, so a vector is shuffled 20 times at most; beyond that blocks stay as they are and their number grows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from ..functions.hashing import draw
from ..plans.lineage import cut
from ..plans.ranks import first_k
from ..plans.skew import salted_join

MAX_PIVOTS = 1024
BLOCK_ROWS = 2048  # the least rows of a block of queries, where there are so many
QUERY_BLOCKS = 16  # blocks of queries: a vector is copied for few blocks, however many there are
BLOCKS_TOGETHER = 4  # of these, in a block of candidates
MAX_BLOCK_ROWS = 32_768
CELLS_AT_ONCE = 4_000_000  # similarities that a task holds
STRIDE = 32
RECALL_SAMPLE = 500  # queries whose exact neighbours tell how many cells a recall needs
DIGITS = 9  # similarities that agree to this many digits are ties, broken by id


def _shown():
    """The similarity to DIGITS digits; one that would be 0 by that is given as it is."""
    return F.when(F.col("sim") == 0, F.col("raw")).otherwise(F.col("sim"))


def _hits(mask: np.ndarray) -> pa.Array:
    """The columns that are true in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)), pa.array(np.nonzero(mask)[1].astype(np.int32)))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * x @ pivots.T, 0.0))


def _best(raw: np.ndarray, order: np.ndarray, k: int, ties: bool):
    """For each row the places of its k best columns (similarity to DIGITS digits down, then id order up); with ties, of all that may be. Columns at -inf are left out.

    Of long rows only what reaches the k-th of the maxima of STRIDE columns each is looked at: so many columns are at least as large.
    """
    n = raw.shape[1]
    if n > k:
        groups = n // STRIDE
        few = raw[:, :groups * STRIDE].reshape(len(raw), STRIDE, groups).max(1) if groups >= 4 * k else raw
        kth = -np.partition(-few, k - 1, axis=1)[:, k - 1:k]
        rows, cols = np.nonzero((raw >= kth - 2 * 10.0 ** -DIGITS) & (raw > -np.inf))
    else:
        rows, cols = np.nonzero(raw > -np.inf)
    if ties:
        return rows, cols
    rank = np.lexsort((order[cols], -np.round(raw[rows, cols], DIGITS), rows))
    rows, cols = rows[rank], cols[rank]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], cols[place < k]


def _points(attrs: DataFrame, column: str):
    """Unit vectors (id, vec) of the nodes with attributes, made once, and the ids of those with none."""
    values = attrs.select("id", F.col(column).cast("array<double>").alias("vec"))
    zero = V.norm(F.col("vec")) == 0
    return cut(values.filter(~zero).withColumn("vec", V.unit_vector("vec")), "unit"), values.filter(zero).select("id")


def probes_for(points: DataFrame, pivots: np.ndarray, used: np.ndarray, k: int, recall: float, seed: int) -> int:
    """The least number of cells that finds `recall` of the k nearest of a sample of queries, two standard errors of the sample added.

    points: (g, vec, cell). The sample has RECALL_SAMPLE distinct vectors, or all if there are no more; it is compared with every point.
    """
    keyed = points.withColumn("_h", draw("g", seed=f"{seed}|recall"))
    picked = sorted(keyed.filter(first_k(keyed, RECALL_SAMPLE, "_h", ["g"])).select("g", "vec").collect(), key=lambda r: r.g)
    names, asked = [r.g for r in picked], np.array([r.vec for r in picked])

    def nearest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = asked @ V.to_numpy(batch.column("vec")).T
            g = batch.column("g").to_numpy(zero_copy_only=False).astype(str)
            rows, cols = _best(raw, g.argsort().argsort(), k, False)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(g[cols]), pa.array(np.round(raw[rows, cols], DIGITS)),
                                              batch.column("cell").take(pa.array(cols))], names=["q", "g", "sim", "cell"])

    found = points.select("g", "vec", "cell").mapInArrow(nearest, "q int, g string, sim double, cell int")
    best = Window.partitionBy("q").orderBy(F.col("sim").desc(), "g")
    found = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select("q", "g", "cell").collect()
    found = [r for r in found if r.g != names[r.q]]  # every query finds itself
    d = np.where(used, _distances(asked, pivots), np.inf)
    need, query = np.array([1 + (d[r.q] < d[r.q, r.cell]).sum() for r in found], int), np.array([r.q for r in found], int)
    sizes, most = np.maximum(np.bincount(query, minlength=len(asked)), 1), int(used.sum())
    for probes in range(1, most):
        share = np.bincount(query, need <= probes, len(asked)) / sizes
        spread = 2.0 * share.std() / np.sqrt(len(share)) if len(share) == RECALL_SAMPLE else 0.0
        if share.mean() - spread >= recall:
            return probes
    return most


def _nearest_groups(distinct: DataFrame, k: int, probes: int | None, ties: bool, block_rows: int, seed: int,
                    max_pivots: int, recall: float | None = None) -> DataFrame:
    """(qg, cg, sim, raw): for each distinct vector the k most similar distinct vectors, itself among them; sim is raw to DIGITS digits, and ranks."""
    distinct = cut(distinct, "distinct")
    n = distinct.count()
    keyed = distinct.withColumn("_h", draw("g", seed=seed))
    want = int(min(max(max_pivots, n ** 0.5), max(1, n // (8 * k))))
    pivots = np.array([r.vec for r in keyed.filter(first_k(keyed, want, "_h", ["g"])).select("vec").collect()])
    if not len(pivots):
        return distinct.select(F.col("g").alias("qg"), F.col("g").alias("cg"), F.lit(1.0).alias("sim"), F.lit(1.0).alias("raw"))

    def place(x):
        d = _distances(x, pivots)
        near = d.argmin(1)
        return np.column_stack([near, d[np.arange(len(x)), near]])

    placed = distinct.withColumn("_p", V.row_map(place)("vec")).select(
        "g", "vec", F.col("_p")[0].cast("int").alias("cell"), F.col("_p")[1].alias("dist"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    rows = min(max(block_rows, -(-n // QUERY_BLOCKS)), MAX_BLOCK_ROWS)
    subs = {s.cell: -(-s.n // rows) for s in stats}
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for s in stats:
        lo[s.cell], hi[s.cell] = s.lo, s.hi
    used = np.isfinite(hi)
    # parts of cells one after another fill blocks of queries; some of these together are a block of candidates
    parts, block, filled = [], 0, 0.0
    for s in sorted(stats, key=lambda s: s.cell):
        for sub in range(subs[s.cell]):
            size = s.n / subs[s.cell]
            if filled and filled + size > rows:
                block, filled = block + 1, 0.0
            parts.append((s.cell, sub, block, block // BLOCKS_TOGETHER))
            filled += size
    held = np.zeros((len(pivots), block // BLOCKS_TOGETHER + 1), np.float32)
    for cell, _, _, there in parts:
        held[cell, there] = 1.0
    spark = distinct.sparkSession
    split = F.broadcast(spark.createDataFrame(list(subs.items()), "cell int, subs int"))
    dealt = F.broadcast(spark.createDataFrame(parts, "cell int, sub int, qblock int, cblock int"))
    points = cut(placed.join(split, "cell").withColumn("sub", F.pmod(F.xxhash64("g"), F.col("subs")).cast("int")).drop("subs").join(dealt, ["cell", "sub"]), "points")

    if recall is not None:
        probes = probes_for(points, pivots, used, k, recall, seed)
    exact = probes is None
    if exact:
        def radius(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["vec"].to_numpy())
            reach = np.full(len(x), np.inf)
            if len(x) >= k:
                step = max(1, CELLS_AT_ONCE // len(x))
                reach = np.concatenate([np.partition(_distances(x[a:a + step], x), k - 1, axis=1)[:, k - 1] for a in range(0, len(x), step)])
            return pdf.assign(reach=reach)

        queries = points.groupBy("cell", "sub").applyInPandas(radius, points.schema.simpleString()[7:-1] + ",reach:double")
        between = _distances(pivots, pivots)

        def visits(x, own):
            d = _distances(x, pivots)
            cell, reach = own[:, 0].astype(int), own[:, 1][:, None]
            near = d[np.arange(len(x)), cell][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[cell] > 0, (d * d - near * near) / (2 * between[cell]), 0.0)
            least = np.maximum(np.maximum(d - hi, lo - d), plane)
            return (least <= reach + 1e-6) & used
    else:
        queries = points.withColumn("reach", F.lit(0.0))

        def visits(x, own):
            d = np.where(used, _distances(x, pivots), np.inf)
            return d <= np.sort(d, axis=1)[:, [min(probes, int(used.sum())) - 1]]

    @F.arrow_udf("array<int>")
    def blocks(vec: pa.Array, own: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], pa.list_(pa.int32()))
        x, own = V.to_numpy(vec), V.to_numpy(own)
        return _hits(np.concatenate([visits(x[a:a + 4096], own[a:a + 4096]).astype(np.float32) @ held > 0 for a in range(0, len(x), 4096)]))

    queries = cut(queries.select(F.col("g").alias("qg"), F.col("vec").alias("q"), F.array(F.col("cell").cast("double"), F.col("reach")).alias("own"), "qblock",
                                 blocks("vec", F.array(F.col("cell").cast("double"), F.col("reach"))).alias("to")), "queries")
    visited = queries.withColumn("cblock", F.explode("to")).drop("to")
    tasks = cut(queries.groupBy("qblock").agg(F.array_distinct(F.flatten(F.collect_set("to"))).alias("to")).select(
        F.col("qblock").alias("kq"), F.explode("to").alias("cblock")), "tasks")  # as many rows as there are pairs of blocks
    candidates = points.select("cblock", F.col("cell").alias("ccell"), F.col("g").alias("cg"), F.col("vec").alias("c")).join(F.broadcast(tasks), "cblock")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({"qg": pa.array([], pa.string()), "cg": pa.array([], pa.string()), "sim": pa.array([], pa.float64()), "raw": pa.array([], pa.float64())})]
        if not left.num_rows or not right.num_rows:
            return found[0]
        q, own, c, cell = V.to_numpy(left.column("q")), V.to_numpy(left.column("own")), V.to_numpy(right.column("c")), right.column("ccell").to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        c, cell, cg = c[by_cell], cell[by_cell], right.column("cg").combine_chunks().take(pa.array(by_cell))
        qg, names = left.column("qg").combine_chunks(), cg.to_numpy(zero_copy_only=False).astype(str)
        order, whole = names.argsort(kind="stable").argsort(), np.arange(len(c))
        asked = np.argsort(own[:, 0], kind="stable")
        for group in np.split(asked, np.flatnonzero(np.diff(own[asked, 0])) + 1):
            for a in range(0, len(group), 1024):
                part = group[a:a + 1024]
                need = visits(q[part], own[part])
                cols = np.flatnonzero(need.any(0)[cell])
                cols = whole if 2 * len(cols) > len(c) else cols
                near, at = c if cols is whole else c[cols], cell[cols]
                step = max(1, CELLS_AT_ONCE // max(len(cols), 1))
                for b in range(0, len(part) if len(cols) else 0, step):
                    raw = q[part[b:b + step]] @ near.T
                    if not exact:
                        raw[~need[b:b + step][:, at]] = -np.inf
                    row, col = _best(raw, order[cols], k, ties)
                    value = raw[row, col]
                    found.append(pa.table({"qg": qg.take(pa.array(part[b + row])), "cg": cg.take(pa.array(cols[col])), "sim": np.round(value, DIGITS), "raw": value}))
        return pa.concat_tables(found)

    found = visited.groupBy("qblock", "cblock").cogroup(candidates.groupBy("kq", "cblock")).applyInArrow(compare, "qg string, cg string, sim double, raw double")
    best = Window.partitionBy("qg").orderBy(F.col("sim").desc(), *([] if ties else ["cg"]))
    rank = F.rank() if ties else F.row_number()
    return found.withColumn("_r", rank.over(best)).filter(F.col("_r") <= k).drop("_r")


def _grouped(points: DataFrame):
    """Distinct vectors (g = lowest id, vec) and the members (id, g)."""
    keyed = points.withColumns({"_a": F.xxhash64("vec"), "_b": F.xxhash64(F.reverse("vec"), F.lit(1))})  # 128 bits stand for the vector
    groups = keyed.groupBy("_a", "_b").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("n"))
    members = cut(salted_join(keyed.select("id", "_a", "_b"), groups.select("_a", "_b", "g"), ["_a", "_b"], ["id"], counts=groups.select("_a", "_b", "n")).select("id", "g"), "members")
    sizes = groups.select("g", "n")
    return points.join(sizes, points["id"] == sizes["g"]).select("vec", "g", "n"), members


def attr_knn(attrs: DataFrame, k: int, probes: int | None = None, column: str = "features",
             block_rows: int = BLOCK_ROWS, seed: int = 0, max_pivots: int = MAX_PIVOTS, recall: float | None = None) -> DataFrame:
    """(row, col, sim): cosine similarity to the k nearest nodes, the node itself counted but left out.

    Exact by default. `probes` searches so many cells and promises no recall; `recall` finds the number of cells by probes_for.
    A node without attributes lies at distance 1 of every other, that is at similarity 0.5, and takes
    its place in the ranking, but has no row and no column in the result.
    """
    points, none = _points(attrs, column)
    groups, members = _grouped(points)
    near = _nearest_groups(groups.select("g", "vec"), k, probes, False, block_rows, seed, max_pivots, recall)
    in_group = Window.partitionBy("g").orderBy("id")
    low = members.withColumn("_r", F.row_number().over(in_group)).filter(F.col("_r") <= k).select(F.col("g").alias("cg"), F.col("id").alias("col"))
    none_ids = [r.id for r in none.orderBy("id").limit(k).collect()]
    skipped = F.lit(0)
    if none_ids:
        before = sum((F.lit(z) < F.col("col")).cast("int") for z in none_ids)
        skipped = F.when(F.col("sim") < 0.5, len(none_ids)).when(F.col("sim") == 0.5, before).otherwise(0)
    ranked = (near.join(low, "cg")
              .withColumn("_r", F.row_number().over(Window.partitionBy("qg").orderBy(F.col("sim").desc(), "col")))
              .filter(F.col("_r") <= k).filter(F.col("_r") + skipped <= k).select("qg", "col", _shown().alias("sim"), (F.col("raw") != 0).alias("near")))
    return (salted_join(members.select(F.col("id").alias("row"), F.col("g").alias("qg")), ranked, ["qg"], ["row"])
            .filter((F.col("row") != F.col("col")) & F.col("near")).select("row", "col", "sim"))


def attr_topk_cutoff(attrs: DataFrame, k: int, column: str = "features", block_rows: int = BLOCK_ROWS,
                     seed: int = 0, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """As attr_knn, but keeps every similarity that reaches the k-th largest of its row (all ties)."""
    points, none = _points(attrs, column)
    groups, members = _grouped(points)
    groups = cut(groups, "groups")
    near = _nearest_groups(groups.select("g", "vec"), k, None, True, block_rows, seed, max_pivots)
    near = near.join(groups.select(F.col("g").alias("cg"), F.col("n").alias("copies")), "cg")
    blanks = none.count()
    if blanks:  # nodes without attributes have similarity 0 to all and can hold the k-th place
        near = near.unionByName(groups.select(F.col("g").alias("qg"), F.lit(None).cast("string").alias("cg"),
                                              F.lit(0.0).alias("sim"), F.lit(0.0).alias("raw"), F.lit(blanks).cast("bigint").alias("copies")))
    above = Window.partitionBy("qg").orderBy(F.col("sim").desc()).rangeBetween(Window.unboundedPreceding, 0)
    kept = (near.withColumn("_before", F.sum("copies").over(above) - F.sum("copies").over(Window.partitionBy("qg", "sim")))
            .filter((F.col("_before") < k) & (F.col("raw") != 0)).select("qg", "cg", _shown().alias("sim")))
    cols = salted_join(kept, members.select(F.col("g").alias("cg"), F.col("id").alias("col")), ["cg"], ["qg"])
    return (salted_join(members.select(F.col("id").alias("row"), F.col("g").alias("qg")), cols.select("qg", "col", "sim"), ["qg"], ["row"])
            .filter("row <> col").select("row", "col", "sim"))
