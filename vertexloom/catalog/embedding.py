"""Embedding methods end to end.

The walk methods, grarep, aane, sagemean and sagegcn run at the operators' defaults (10 walks of 80 steps, window 10, K = 4, 10 iterations, samples of 25 and 10); the width
is the SQL's, 16 in place of 128. line and asne make 10 epochs of 100. A tenth of the edges of a graph of communities is held out; the vectors are learned on the
rest and must tell the held-out edges from as many pairs that are none. A query gives a row for each node: the width of its vector, whether
all values are finite, and whether the AUC is at least LEARNED (vectors that don't tell, and random ones, have 0.5); the vectors themselves
can't be stated in SQL.
"""

from pyspark.sql import functions as F

from ..embeddings import experiment as X, gradient
from ..operators.evaluate import lp_auc, lp_score, lp_test_set
from ..operators.graph import degrees, node_index, node_split
from ..operators.walks import walk_pairs
from ..plans.lineage import cut
from .base import V, X as VECTORS, communities, h, query, rounded, vector_attrs, vector_labels, vectors
from .sampling import non_edge_sql

OPTIONS = {
    "attrpure": {}, "deepwalk": {}, "node2vec": {}, "abrw": {}, "attrcomb": {}, "grarep": {}, "tadw": {"maxiter": 10},
    "aane": {}, "line": {"epochs": 10}, "asne": {"epochs": 10}, "sagemean": {}, "sagegcn": {},
}
LEARNED = 0.65


def _stated(emb, auc: float):
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return emb.select("id", F.size("vector").alias("width"), finite.alias("finite"), F.lit(auc >= LEARNED).alias("learned"))


def _rows(width: int) -> str:
    return f"SELECT vec_id::VARCHAR AS id, {width} AS width, true AS finite, true AS learned FROM embeddings"


def _method(name):
    def run(spark, sf):
        g, attrs = communities(spark, sf)
        out = X.run_experiment(g, name, attrs, task="lp", link_remove=0.1, dim=16, **OPTIONS[name])
        return _stated(out.vectors, out.metrics.first().auc)
    return run


def trained(name: str):
    """The vectors alone, without a hold-out and its score, on the graph of the orders: what bench.py times."""
    def run(spark, sf):
        return X.embed(name, vectors(spark, sf), vector_attrs(spark, sf), dim=16, **OPTIONS[name]).vectors
    return run


for _name in OPTIONS:
    query(_name, _rows(32 if _name == "tadw" else 16))(_method(_name))


@query("sgns_pairs", _rows(16))
def sgns_pairs(spark, sf):
    """Skip-gram on the walk pairs of the training subgraph."""
    g, _ = communities(spark, sf)
    g, held = lp_test_set(g, cut(node_index(g.nodes), "index"), 0.1, 0)
    g, held = g.with_edges(cut(g.edges, "edges")), cut(held, "pairs")
    pairs = walk_pairs(g, node_split(g.nodes, 0.0, 0.1, seed=1), 10, 5, seed=1)
    emb = cut(gradient.sgns_pairs(g.nodes, pairs, degrees(g), dim=16, epochs=10).vectors, "vectors")
    return _stated(emb, lp_auc(lp_score(held, emb)).first().auc)


def _auc_sql(ratio: float) -> str:
    """The AUC of the attributes' cosines on the held-out edges: with all components, their SVD has the same."""
    return f"""WITH {V}, {VECTORS}, order_of AS (SELECT src, dst, row_number() OVER (ORDER BY {h('src', 'dst', seed=0)}, src, dst) AS r, count(*) OVER () AS m FROM v_edges),
removed AS (SELECT src, dst FROM order_of WHERE r <= floor({ratio}::DOUBLE * m)), rest AS (SELECT src, dst FROM order_of WHERE r > floor({ratio}::DOUBLE * m)),
taken AS (SELECT floor(least(count(*), count(*) / {ratio}::DOUBLE * 0.2::DOUBLE))::BIGINT AS k FROM removed),
chosen AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY {h('src', 'dst', seed='0|test')}, src, dst) AS r FROM removed), taken WHERE r <= k),
{non_edge_sql('v_nodes', 'v_edges', '(SELECT k FROM taken)', 0)},
test_set AS (SELECT src AS u, dst AS v, 1 AS label FROM chosen UNION ALL SELECT src, dst, 0 FROM non_edges),
scored AS (SELECT t.label, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM test_set t JOIN x a ON a.id = t.u JOIN x b ON b.id = t.v),
ranks AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM scored),
auc AS (SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
  (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS raw FROM ranks)
SELECT 'attrpure' AS method, positives, negatives, round(greatest(raw, 1 - raw), 6) AS auc, (SELECT count(*) FROM rest) AS edges, (SELECT count(*) FROM v_nodes) AS nodes,
  (SELECT count(*) FROM v_nodes WHERE id NOT IN (SELECT src FROM rest UNION SELECT dst FROM rest)) AS isolates"""


@query("run_experiment", _auc_sql(0.2) + ", false AS is_directed, true AS f1_valid FROM auc")
def run_experiment(spark, sf):
    """Link prediction and node classification with all components of the attributes; F1 scores lie in (0, 1]."""
    out = X.run_experiment(vectors(spark, sf), "attrpure", vector_attrs(spark, sf), vector_labels(spark, sf), dim=64, mode="svd").metrics
    valid = F.lit(True)
    for c in ("micro", "macro", "samples", "weighted"):
        valid = valid & (F.col(c) > 0) & (F.col(c) <= 1)
    return rounded(out.select("method", "positives", "negatives", "auc", "edges", "nodes", "isolates", "is_directed", valid.alias("f1_valid")), "auc")


@query("lp_experiment", _auc_sql(0.1) + " FROM auc")
def lp_experiment(spark, sf):
    out = X.run_experiment(vectors(spark, sf), "attrpure", vector_attrs(spark, sf), task="lp", link_remove=0.1, dim=64, mode="svd")
    return rounded(out.metrics.select("method", "positives", "negatives", "auc", "edges", "nodes", "isolates"), "auc")
