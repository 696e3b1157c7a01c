"""Matrix tables, similarities and decompositions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as VV
from ..operators import graph as G, knn, linalg, matrix as M
from ..plans.lineage import cut
from .base import P, V, X, exploded, purchases, query, rounded, table, u, vector_attrs, vector_emb, vectors

CELLS = "v_cells AS (SELECT src AS \"row\", dst AS col, weight AS value FROM v_adj)"
TA = f"""{CELLS}, t_a AS (SELECT "row", col, value / sum(value) OVER (PARTITION BY "row") AS value FROM v_cells)"""


def cells_of(g):
    return g.adj.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))


def transition(g):
    return M.row_probdist(cells_of(g))[0]


def hash_matrix(name: str, rows: int, cols: int, scale: float = 1.0) -> np.ndarray:
    """A fixed small matrix with entries from the portable draw, in (-scale/2, scale/2)."""
    def entry(i, j):
        return int(hashlib.md5(f"{name}|{i}|{j}|7".encode()).hexdigest()[:13], 16) / 4503599627370496.0 - 0.5
    return np.array([[entry(i, j) for j in range(cols)] for i in range(rows)]) * scale


def hash_matrix_sql(name: str, rows: int, cols: int, scale: float = 1.0) -> str:
    cell = u(f"'{name}'", "i", "j", seed=7)
    return (f"(SELECT i, j, ({cell} - 0.5::DOUBLE) * {scale}::DOUBLE AS w FROM (SELECT unnest(range(0, {rows})) AS i), "
            f"(SELECT unnest(range(0, {cols})) AS j))")


@query("row_probdist", f"""WITH {P}, sums AS (SELECT src, sum(weight) AS s FROM p_adj GROUP BY 1)
SELECT src AS "row", dst AS col, weight / s AS value FROM p_adj JOIN sums USING (src)
UNION ALL SELECT id, NULL, 1.0::DOUBLE / (SELECT count(*) FROM p_nodes) FROM p_nodes WHERE id NOT IN (SELECT src FROM sums)""")
def row_probdist(spark, sf):
    """Cells of the transition matrix; a row that is 1/n everywhere appears once, without a column."""
    g = purchases(spark, sf)
    n = g.nodes.count()
    cells, even = M.row_probdist(cells_of(g), g.nodes.select(F.col("id").alias("row")))
    return cells.union(even.select("row", F.lit(None).cast("string"), F.lit(1.0 / n)))


def _edge_similarity(metric):
    def run(spark, sf):
        g = vectors(spark, sf)
        pairs = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        attrs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("features"))
        return rounded(M.pair_similarity(pairs, attrs, metric), "sim")
    return run


PAIRS = f"{V}, {X}, pv AS (SELECT e.src AS u, e.dst AS v, a.v AS a, b.v AS b FROM v_edges e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst)"
_norm = "(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
query("sim_cosine", f"WITH {PAIRS} SELECT u, v, round(list_dot_product(a, b) / {_norm}, 6) AS sim FROM pv")(_edge_similarity("cosine"))
query("sim_euclidean", f"WITH {PAIRS} SELECT u, v, round(-list_distance(a, b), 6) AS sim FROM pv")(_edge_similarity("euclidean"))
query("sim_manhattan", f"""WITH {PAIRS}, parts AS (SELECT u, v, unnest(a) AS p, unnest(b) AS q FROM pv)
SELECT u, v, round(-sum(abs(p - q)), 6) AS sim FROM parts GROUP BY 1, 2""")(_edge_similarity("manhattan"))


@query("sim_jaccard", f"""WITH {PAIRS}, parts AS (SELECT u, v, unnest(a) > 0 AS p, unnest(b) > 0 AS q FROM pv)
SELECT u, v, round(avg(CASE WHEN p = q THEN 1.0 ELSE 0.0 END), 6) AS matching,
       round(sum(CASE WHEN p AND q THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN p OR q THEN 1 ELSE 0 END), 6) AS overlap
FROM parts GROUP BY 1, 2""")
def sim_jaccard(spark, sf):
    """Both readings of the measure, on the signs of the attributes."""
    pairs = vectors(spark, sf).edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    signs = vector_attrs(spark, sf).withColumn("features", F.transform("features", lambda x: (x > 0).cast("double")))
    rows = M.with_pair_vectors(pairs, signs, "features")
    return rows.select("u", "v", F.round(M.METRICS["jaccard_match"](F.col("_a"), F.col("_b")), 6).alias("matching"),
                       F.round(M.METRICS["jaccard_set"](F.col("_a"), F.col("_b")), 6).alias("overlap"))


SIMS = f"""{X}, ux AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM x),
sims AS (SELECT a.id AS "row", b.id AS col, round(list_dot_product(a.v, b.v), 9) AS sim FROM ux a, ux b)"""
KNN = f"""{SIMS}, knn AS (SELECT "row", col, sim FROM
  (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY sim DESC, col) AS r FROM sims) WHERE r <= 30 AND "row" <> col AND sim <> 0)"""


@query("attr_knn", f"""WITH {KNN} SELECT "row", col, round(sim, 6) AS sim FROM knn""")
def attr_knn(spark, sf):
    return rounded(knn.attr_knn(vector_attrs(spark, sf), 30), "sim")


@query("attr_topk_cutoff", f"""WITH {SIMS} SELECT "row", col, round(sim, 6) AS sim FROM
  (SELECT *, rank() OVER (PARTITION BY "row" ORDER BY sim DESC) AS r FROM sims) WHERE r <= 10 AND "row" <> col AND sim <> 0""")
def attr_topk_cutoff(spark, sf):
    return rounded(knn.attr_topk_cutoff(vector_attrs(spark, sf), 10), "sim")


@query("attr_knn_lsh", """SELECT count(*) AS n, true AS full_rows, true AS recall_holds FROM embeddings""")
def attr_knn_lsh(spark, sf):
    """Approximate top-k, as many cells searched as a sample needs for a recall of 0.9: every row gets its neighbours, and at least
    nine in ten are the exact ones."""
    attrs = vector_attrs(spark, sf)
    found, exact = cut(knn.attr_knn(attrs, 10, recall=0.9), "near"), knn.attr_knn(attrs, 10).select("row", "col", F.lit(1).alias("right"))
    rows = found.join(exact, ["row", "col"], "left").groupBy("row").agg(F.count(F.lit(1)).alias("k"), F.count("right").alias("right"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.min("k") == 9).alias("full_rows"), (F.sum("right") >= 0.9 * F.sum("k")).alias("recall_holds"))


@query("deg2beta", f"""WITH {P} SELECT id, round(pow(1 + pow(count(src)::DOUBLE, 2.71828), -1 / 2.71828), 6) AS beta
FROM p_nodes LEFT JOIN p_adj ON src = id GROUP BY id""")
def deg2beta(spark, sf):
    return G.degrees(purchases(spark, sf)).select("id", F.round(M.deg2beta(F.col("degree"), 2.71828), 6).alias("beta"))


def biased_sql(beta: str) -> str:
    """CTEs of the mixed transition matrix; every node has attributes here, so no row is spread evenly."""
    return f"""{V}, {TA}, {KNN},
t_x AS (SELECT "row", col, sim / sum(sim) OVER (PARTITION BY "row") AS value FROM knn),
deg AS (SELECT id, count(src)::DOUBLE AS degree FROM v_nodes LEFT JOIN v_adj ON src = id GROUP BY id),
share AS (SELECT id, CASE WHEN degree = 0 THEN 1.0::DOUBLE ELSE {beta} END AS b FROM deg),
t AS (SELECT "row", col, sum(value) AS value FROM (
  SELECT "row", col, (1 - b) * value AS value FROM t_a JOIN share ON id = "row"
  UNION ALL SELECT "row", col, b * value FROM t_x JOIN share ON id = "row") GROUP BY 1, 2)"""


BETAS = {1: "0.2::DOUBLE", 2: "pow(1 + pow(2.0::DOUBLE * (SELECT count(*) FROM v_edges) / (SELECT count(*) FROM v_nodes), 2.71828), -1 / 2.71828)",
         3: "pow(1 + pow(2 * degree, 2.71828), -1 / 2.71828)"}


def biased(spark, sf, mode):
    sims = cut(knn.attr_knn(vector_attrs(spark, sf), 30), "sims")
    return M.biased_transition(vectors(spark, sf), sims, mode)


def _biased_query(mode):
    def run(spark, sf):
        return rounded(biased(spark, sf, mode)[0], "value")
    return run


for _mode in (1, 2, 3):
    query("biased_transition" + ("" if _mode == 1 else f"_mode{_mode}"),
          f"""WITH {biased_sql(BETAS[_mode])} SELECT "row", col, round(value, 6) AS value FROM t WHERE value <> 0""")(_biased_query(_mode))

A2 = f"""{TA}, a2 AS (SELECT a."row", b.col, sum(a.value * b.value) AS value FROM t_a a JOIN t_a b ON a.col = b."row" GROUP BY 1, 2)"""


@query("matpow", f"""WITH {V}, {A2} SELECT "row", col, round(value, 6) AS value FROM a2""")
def matpow(spark, sf):
    return rounded(M.matpow(transition(vectors(spark, sf)), 2), "value")


@query("log_ppmi", f"""WITH {V}, {A2}, cs AS (SELECT col, sum(value) AS s FROM a2 GROUP BY 1)
SELECT "row", col, round(greatest(0.0, ln(value / s) - ln(1.0::DOUBLE / (SELECT count(*) FROM v_nodes))), 6) AS value
FROM a2 JOIN cs USING (col)""")
def log_ppmi(spark, sf):
    g = vectors(spark, sf)
    return rounded(M.log_ppmi_of_power(transition(g), 2, g.nodes.count()), "value")


AXES = "SELECT unnest(range(0, 64)) AS i, true AS orthogonal, true AS ordered, (SELECT round(sum(value * value), 4) FROM {0}) AS total"


def _axes(spark, vectors, width: int):
    """Whether the columns of the result are orthogonal, fall in length and hold the whole sum of squares: a row for each column."""
    g = linalg.gram(cut(vectors, "axes"), "vector")
    size = np.diag(g)
    off = np.abs(g - np.diag(size)).max(1)
    return spark.createDataFrame([(i, bool(off[i] < 1e-6 * max(size[0], 1.0)), bool(i == 0 or size[i] <= size[i - 1] * (1 + 1e-9)), round(float(size.sum()), 4)) for i in range(width)],
                                 "i bigint, orthogonal boolean, ordered boolean, total double")


@query("truncated_svd", f"WITH {X} {AXES.format('xe')}")
def truncated_svd(spark, sf):
    return _axes(spark, linalg.truncated_svd(vector_attrs(spark, sf), 64)[0], 64)


@query("pca", f"""WITH {X}, mean AS (SELECT i, avg(value) AS m FROM xe GROUP BY 1), ce AS (SELECT value - m AS value FROM xe JOIN mean USING (i)) {AXES.format('ce')}""")
def pca(spark, sf):
    return _axes(spark, linalg.pca(vector_attrs(spark, sf), 64), 64)


@query("truncated_svd_norms", f"WITH {X} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM x")
def truncated_svd_norms(spark, sf):
    """With all components the rows keep their length."""
    return cut(linalg.truncated_svd(vector_attrs(spark, sf), 64)[0], "svd").select("id", F.round(VV.norm(F.col("vector")), 6).alias("norm"))


@query("pca_norms", f"""WITH {X}, mean AS (SELECT i, avg(value) AS m FROM xe GROUP BY 1)
SELECT id, round(sqrt(sum((value - m) * (value - m))), 6) AS norm FROM xe JOIN mean USING (i) GROUP BY 1""")
def pca_norms(spark, sf):
    """With all components the rows keep their distance from the mean."""
    return cut(linalg.pca(vector_attrs(spark, sf), 64), "pca").select("id", F.round(VV.norm(F.col("vector")), 6).alias("norm"))


@query("svd_scaled", f"WITH {V} SELECT DISTINCT src AS id, 16 AS width, true AS unit FROM v_adj")
def svd_scaled(spark, sf):
    """A row of unit length for each node with neighbours."""
    out = cut(linalg.svd_scaled(transition(vectors(spark, sf)), 16), "scaled")
    return out.select("id", F.size("vector").alias("width"), (F.abs(VV.norm(F.col("vector")) - 1) < 1e-9).alias("unit"))


@query("svd_features", f"WITH {X} SELECT 'as they are' AS kind, id, i, round(value, 6) AS value FROM xe UNION ALL SELECT 'shorter', id, 20, 1 FROM x")
def svd_features(spark, sf):
    """With the usual limit of 200 the attributes are used as they are; with 20, each row has 20 values and is no longer than it was."""
    attrs = vector_attrs(spark, sf)
    short = cut(linalg.svd_features(attrs, 20), "short").join(attrs.select("id", VV.norm(F.col("features")).alias("n")), "id")
    short = short.select(F.lit("shorter").alias("kind"), "id", F.size("features").cast("bigint").alias("i"), (VV.norm(F.col("features")) <= F.col("n") + 1e-9).cast("double").alias("value"))
    return exploded(linalg.svd_features(attrs), "features").select(F.lit("as they are").alias("kind"), "id", "i", "value").unionByName(short)


@query("l2_normalize", f"WITH {X} SELECT id, i, round(value / norm, 6) AS value FROM (SELECT id, sqrt(list_dot_product(v, v)) AS norm FROM x) JOIN xe USING (id)")
def l2_normalize(spark, sf):
    return exploded(M.l2_normalize(vector_emb(spark, sf)))


TRAIN = f"""train AS (SELECT id FROM x WHERE {u('id', seed=21)} < 0.7)"""


@query("standard_scale", f"""WITH {X}, {TRAIN},
fitted AS (SELECT i, avg(value) AS m, stddev_pop(value) AS s FROM xe WHERE id IN (SELECT id FROM train) GROUP BY 1)
SELECT id, i, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM xe JOIN fitted USING (i)""")
def standard_scale(spark, sf):
    from ..functions.hashing import unit
    attrs = vector_attrs(spark, sf)
    return exploded(M.standard_scale(attrs, attrs.filter(unit("id", seed=21) < 0.7)), "features")


@query("combine_vectors", f"""WITH {X}, pair AS (SELECT id, i, value AS a, -2 * value AS b FROM xe)
SELECT 'concat' AS mode, id, i, round(a, 6) AS value FROM pair UNION ALL SELECT 'concat', id, i + 64, round(b, 6) FROM pair
UNION ALL SELECT 'elementwise-mean', id, i, round((a + b) / 2, 6) FROM pair
UNION ALL SELECT 'elementwise-max', id, i, round(greatest(a, b), 6) FROM pair""")
def combine_vectors(spark, sf):
    left = vector_emb(spark, sf)
    right = left.withColumn("vector", F.transform("vector", lambda x: -2.0 * x))
    out = [exploded(M.combine_vectors(left, right, m)).withColumn("mode", F.lit(m)) for m in ("concat", "elementwise-mean", "elementwise-max")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("pair_cosine", f"WITH {PAIRS} SELECT u, v, round(list_dot_product(a, b) / {_norm}, 6) AS cosine FROM pv")
def pair_cosine(spark, sf):
    pairs = vectors(spark, sf).edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return M.pair_similarity(pairs, vector_emb(spark, sf), "cosine", "vector").select("u", "v", F.round("sim", 6).alias("cosine"))


@query("pair_affinity", f"""WITH {PAIRS}, w AS {hash_matrix_sql('affinity', 64, 64)},
bw AS (SELECT b.id, w.i, sum(w.w * b.value) AS value FROM xe b JOIN w ON w.j = b.i GROUP BY 1, 2),
bl AS (SELECT e.src AS u, e.dst AS v, sum(a.value * bw.value) AS bilinear
       FROM v_edges e JOIN bw ON bw.id = e.dst JOIN xe a ON a.id = e.src AND a.i = bw.i GROUP BY 1, 2)
SELECT u, v, round(list_dot_product(a, b), 6) AS plain, round(bilinear, 6) AS bilinear FROM pv JOIN bl USING (u, v)""")
def pair_affinity(spark, sf):
    pairs = vectors(spark, sf).edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    plain = cut(M.pair_affinity(pairs, vector_emb(spark, sf)).withColumnRenamed("affinity", "plain"), "plain")
    bilinear = M.pair_affinity(plain, vector_emb(spark, sf), hash_matrix("affinity", 64, 64)).withColumnRenamed("affinity", "bilinear")
    return rounded(bilinear, "plain", "bilinear")
