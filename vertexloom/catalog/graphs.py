"""Graph tables."""

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import P, V, X, exploded, h, node_flags, purchases, query, rounded, table, vector_attrs, vectors

INDEX = "node_idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM {n})"


@query("node_mapping", f"WITH {P}, {INDEX.format(n='p_nodes')} SELECT id, idx FROM node_idx")
def node_mapping(spark, sf):
    return G.node_index(purchases(spark, sf, store=False).nodes)


@query("add_edge_weight", f"WITH {P} SELECT src, dst, 2.5::DOUBLE AS weight FROM p_edges")
def add_edge_weight(spark, sf):
    return G.add_edge_weight(purchases(spark, sf, store=False), 2.5).edges


REMOVED = f"""ranked AS (SELECT src, dst, row_number() OVER (ORDER BY {h('src', 'dst', seed=5)}, src, dst) AS r, count(*) OVER () AS m FROM p_edges)"""


@query("remove_edges", f"WITH {P}, {REMOVED} SELECT src, dst, r <= floor(0.1::DOUBLE * m) AS removed FROM ranked")
def remove_edges(spark, sf):
    rest, removed = G.remove_edges(purchases(spark, sf), 0.1, seed=5)
    return (rest.edges.select("src", "dst", F.lit(False).alias("removed"))
            .union(removed.select("src", "dst", F.lit(True))))


@query("adj_matrix", f"""WITH {P}, {INDEX.format(n='p_nodes')}
SELECT a.idx AS "row", b.idx AS col, weight AS value FROM p_adj JOIN node_idx a ON a.id = src JOIN node_idx b ON b.id = dst""")
def adj_matrix(spark, sf):
    g = purchases(spark, sf)
    return G.adj_matrix(g, G.node_index(g.nodes))


@query("attr_matrix", f"""WITH {X}, {INDEX.format(n='x')}
SELECT idx AS id, i, round(value, 6) AS value FROM xe JOIN node_idx USING (id)""")
def attr_matrix(spark, sf):
    attrs = vector_attrs(spark, sf)
    return exploded(G.attr_matrix(attrs, G.node_index(attrs)).withColumnRenamed("row", "id"), "features")


@query("graph_counts", f"WITH {P} SELECT 'nodes' AS name, count(*) AS value FROM p_nodes UNION ALL SELECT 'edges', count(*) FROM p_edges")
def graph_counts(spark, sf):
    return G.graph_counts(purchases(spark, sf, store=False))


@query("graph_density", f"""WITH {P}, {V}, nm AS (SELECT (SELECT count(*) FROM p_nodes) AS n, (SELECT count(*) FROM p_edges) AS m),
dm AS (SELECT (SELECT count(*) FROM v_nodes) AS n, (SELECT count(*) FROM d_edges) AS m)
SELECT 'undirected' AS kind, round(2.0::DOUBLE * m / (n * (n - 1)), 9) AS density FROM nm
UNION ALL SELECT 'directed', round(1.0::DOUBLE * m / (n * (n - 1)), 9) FROM dm""")
def graph_density(spark, sf):
    both = G.graph_density(purchases(spark, sf)).withColumn("kind", F.lit("undirected")).unionByName(
        G.graph_density(vectors(spark, sf, directed=True)).withColumn("kind", F.lit("directed")))
    return both.select("kind", F.round("density", 9).alias("density"))


@query("isolates", f"WITH {P} SELECT id FROM p_nodes WHERE id NOT IN (SELECT src FROM p_adj)")
def isolates(spark, sf):
    return G.isolates(purchases(spark, sf))


@query("graph_flags", """SELECT 'purchases' AS graph, false AS is_directed, true AS is_weighted
UNION ALL SELECT 'orders', true, false""")
def graph_flags(spark, sf):
    plain = vectors(spark, sf, directed=True)
    plain = plain.with_edges(plain.edges.withColumn("weight", F.lit(None).cast("double")))
    return (G.graph_flags(purchases(spark, sf)).select(F.lit("purchases").alias("graph"), "is_directed", "is_weighted")
            .union(G.graph_flags(plain).select(F.lit("orders"), "is_directed", "is_weighted")))


@query("neighbors", f"WITH {P} SELECT src AS id, dst AS neighbor FROM p_adj")
def neighbors(spark, sf):
    return G.neighbors(purchases(spark, sf))


@query("common_neighbors", f"""WITH {V}
SELECT e.src AS u, e.dst AS v, a.dst AS neighbor FROM v_edges e JOIN v_adj a ON a.src = e.src JOIN v_adj b ON b.src = e.dst AND b.dst = a.dst
WHERE a.dst <> e.src AND a.dst <> e.dst""")
def common_neighbors(spark, sf):
    g = vectors(spark, sf)
    return G.common_neighbors(g, g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query("degrees", f"WITH {P} SELECT id, count(src) AS degree FROM p_nodes LEFT JOIN p_adj ON src = id GROUP BY id")
def degrees(spark, sf):
    return G.degrees(purchases(spark, sf))


@query("avg_degree", f"WITH {P} SELECT round(2.0::DOUBLE * (SELECT count(*) FROM p_edges) / (SELECT count(*) FROM p_nodes), 6) AS avg_degree")
def avg_degree(spark, sf):
    return rounded(G.avg_degree(purchases(spark, sf, store=False)), "avg_degree")


@query("weighted_out_degree", f"""WITH {P}
SELECT id, coalesce(a.w, 0) AS both_ends, coalesce(b.w, 0) AS first_end FROM p_nodes
LEFT JOIN (SELECT src, sum(weight) AS w FROM p_adj GROUP BY 1) a ON a.src = id
LEFT JOIN (SELECT src, sum(weight) AS w FROM p_edges GROUP BY 1) b ON b.src = id""")
def weighted_out_degree(spark, sf):
    g = purchases(spark, sf)
    return (G.weighted_out_degree(g).withColumnRenamed("out_weight", "both_ends")
            .join(G.weighted_out_degree(g, both_ends=False).withColumnRenamed("out_weight", "first_end"), "id"))


@query("double_edges", f"""WITH {V}, {X}, twice AS (SELECT src, dst FROM d_edges UNION SELECT dst, src FROM d_edges)
SELECT src, dst, len(v) AS dim, round(list_sum(v), 6) AS total FROM twice JOIN x ON id = src""")
def double_edges(spark, sf):
    rows = G.double_edges(vectors(spark, sf, directed=True), vector_attrs(spark, sf))
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return rows.select("src", "dst", F.size("features").cast("bigint").alias("dim"), F.round(total, 6).alias("total"))


FLAGS = node_flags(0.1, 0.2, 11)


def flags_of(spark, sf, g):
    return G.node_split(g.nodes, 0.1, 0.2, seed=11)


@query("node_split", f"WITH {V}, {FLAGS} SELECT id, test, val FROM flags")
def node_split(spark, sf):
    return flags_of(spark, sf, vectors(spark, sf, store=False))


@query("induced_subgraph", f"""WITH {V}, {FLAGS}, keep AS (SELECT id FROM flags WHERE NOT test AND NOT val)
SELECT src, dst, weight FROM v_edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""")
def induced_subgraph(spark, sf):
    g = vectors(spark, sf)
    return G.induced_subgraph(g, flags_of(spark, sf, g).filter("NOT test AND NOT val")).edges


MASK = "masked AS (SELECT e.*, s.test OR s.val OR d.test OR d.val AS train_removed FROM v_edges e JOIN flags s ON s.id = src JOIN flags d ON d.id = dst)"


@query("edge_train_mask", f"WITH {V}, {FLAGS}, {MASK} SELECT src, dst, weight, train_removed FROM masked")
def edge_train_mask(spark, sf):
    g = vectors(spark, sf)
    return G.edge_train_mask(g, flags_of(spark, sf, g))


DEG = """deg AS (SELECT f.id, count(k.src) AS degree FROM flags f LEFT JOIN
 (SELECT src FROM masked WHERE NOT train_removed UNION ALL SELECT dst FROM masked WHERE NOT train_removed) k ON k.src = f.id GROUP BY 1)"""

HALF = node_flags(0.3, 0.6, 11, "p_nodes")
PMASK = MASK.replace("v_edges", "p_edges")


def _half(spark, sf):
    g = purchases(spark, sf)
    return g, G.node_split(g.nodes, 0.3, 0.6, seed=11)


@query("train_degree", f"WITH {V}, {FLAGS}, {MASK}, {DEG} SELECT id, degree FROM deg")
def train_degree(spark, sf):
    g = vectors(spark, sf)
    return G.train_degree(g, flags_of(spark, sf, g))


@query("drop_isolated_edges", f"""WITH {P}, {HALF}, {PMASK}, {DEG},
m AS (SELECT f.id, degree = 0 AS alone, NOT test OR val AS strict FROM flags f JOIN deg USING (id))
SELECT src, dst FROM p_edges JOIN m s ON s.id = src JOIN m d ON d.id = dst
WHERE NOT ((s.alone OR d.alone) AND s.strict AND d.strict)""")
def drop_isolated_edges(spark, sf):
    g, flags = _half(spark, sf)
    return G.drop_isolated_edges(g.edges.select("src", "dst"), flags, G.train_degree(g, flags))[0]


@query("prune_pairs", f"WITH {V}, {FLAGS} SELECT src, dst FROM v_adj WHERE dst NOT IN (SELECT id FROM flags WHERE test OR val)")
def prune_pairs(spark, sf):
    g = vectors(spark, sf)
    return G.prune_pairs(g.adj.select("src", "dst"), flags_of(spark, sf, g))


@query("train_nodes", f"WITH {P}, {HALF}, {PMASK}, {DEG} SELECT id FROM flags JOIN deg USING (id) WHERE NOT test AND NOT val AND degree > 0")
def train_nodes(spark, sf):
    g, flags = _half(spark, sf)
    return G.train_nodes(flags, G.train_degree(g, flags))


@query("label_onehot", """SELECT vec_id::VARCHAR AS id, i, CASE WHEN label = i THEN 1 ELSE 0 END::DOUBLE AS value
FROM embeddings, (SELECT unnest(range(0, 10)) AS i)""")
def label_onehot(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    return exploded(G.label_onehot(labels, 10))
