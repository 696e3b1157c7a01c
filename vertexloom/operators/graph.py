"""Graph tables: nodes(id), edges(src, dst, weight) and what is counted, cut and joined on them."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import draw
from ..plans.lineage import cut
from ..plans.ranks import first_k, with_row_index
from ..plans.skew import lookup, salted_join


def canonical(edges: DataFrame, directed: bool) -> DataFrame:
    """Undirected edges with the smaller id first."""
    if directed:
        return edges
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


@dataclass(frozen=True)
class Graph:
    """Each edge is stored once; an undirected one has src <= dst. A null weight means unweighted."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @cached_property
    def adj(self) -> DataFrame:
        """Edges as seen from src: for an undirected graph both directions (a self loop once)."""
        own = self.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        if self.directed:
            return own
        back = own.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return own.unionByName(back)

    @cached_property
    def out_counts(self) -> DataFrame:
        """(src, n): rows of adj for each node that has any. Written once: a join with an aggregate of the same stage can't be split at a hub."""
        return cut(self.adj.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "counts")

    def with_edges(self, edges: DataFrame) -> "Graph":
        return Graph(self.nodes, edges, self.directed)


def validate_attrs(graph: Graph, attrs: DataFrame) -> DataFrame:
    """Ids that break the one-attribute-row-for-each-node rule, with the reason."""
    missing = graph.nodes.join(attrs, "id", "left_anti").select("id", F.lit("node without attributes").alias("problem"))
    unknown = attrs.join(graph.nodes, "id", "left_anti").select("id", F.lit("attributes of unknown node").alias("problem"))
    return missing.unionByName(unknown)


def node_index(nodes: DataFrame) -> DataFrame:
    """(id, idx) with idx 0..n-1 in id order."""
    return with_row_index(nodes.select("id"), ["id"])


def add_edge_weight(graph: Graph, equal_weight: float = 1.0) -> Graph:
    return graph.with_edges(graph.edges.withColumn("weight", F.lit(float(equal_weight))))


def remove_edges(graph: Graph, ratio: float, seed: int = 0) -> tuple[Graph, DataFrame]:
    """Take exactly int(ratio * E) edges out; returns the rest of the graph and the removed edges."""
    keyed = graph.edges.withColumn("_h", draw("src", "dst", seed=seed))
    out = first_k(keyed, int(ratio * graph.edges.count()), "_h", ["src", "dst"])
    return graph.with_edges(keyed.filter(~out).drop("_h")), keyed.filter(out).drop("_h")


def adj_matrix(graph: Graph, index: DataFrame) -> DataFrame:
    """Adjacency matrix as (row, col, value) in index order."""
    into = graph.adj.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    rows = lookup(graph.adj, "src", index, "id", {"idx": "row"}, ["dst"], counts=graph.out_counts)
    return (lookup(rows, "dst", index, "id", {"idx": "col"}, ["src"], counts=into)
            .select("row", "col", F.col("weight").alias("value")))


def attr_matrix(attrs: DataFrame, index: DataFrame) -> DataFrame:
    """Attribute rows in index order as (row, features)."""
    return attrs.join(index, "id").select(F.col("idx").alias("row"), "features")


def graph_counts(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count(F.lit(1)).alias("value")).select(F.lit("nodes").alias("name"), "value")
    return n.unionByName(graph.edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges").alias("name"), "value"))


def _sizes(graph: Graph) -> DataFrame:
    """One row (n, m)."""
    return graph_counts(graph).agg(F.max(F.when(F.col("name") == "nodes", F.col("value"))).alias("n"),
                                   F.max(F.when(F.col("name") == "edges", F.col("value"))).alias("m"))


def graph_density(graph: Graph) -> DataFrame:
    """2m/(n(n-1)), without the 2 when directed; 0 without edges or with one node."""
    factor = 1.0 if graph.directed else 2.0
    full = F.col("n") * (F.col("n") - 1)
    return _sizes(graph).select(F.when((F.col("n") > 1) & (F.col("m") > 0), factor * F.col("m") / full)
                                .otherwise(F.lit(0.0)).alias("density"))


def avg_degree(graph: Graph) -> DataFrame:
    return _sizes(graph).select((2.0 * F.col("m") / F.col("n")).alias("avg_degree"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))


def isolates(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").join(endpoints(graph.edges).distinct(), "id", "left_anti")


def graph_flags(graph: Graph) -> DataFrame:
    """Directed or not; weighted when there are edges and each has a weight."""
    return graph.edges.agg(F.lit(graph.directed).alias("is_directed"),
                           F.coalesce(F.bool_and(F.col("weight").isNotNull()), F.lit(False)).alias("is_weighted"))


def neighbors(graph: Graph, node: str | None = None) -> DataFrame:
    """(id, neighbor): of one node, or of all."""
    rows = graph.adj if node is None else graph.adj.filter(F.col("src") == node)
    return rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) for every node; a self loop counts twice."""
    found = endpoints(graph.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(found, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def common_neighbors(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, neighbor) for pairs (u, v), the two ends left out.

    Each pair lists the neighbours of its end of lower degree and looks them up at the other end, so
    a hub's list is only walked when both ends are hubs.
    """
    deg = graph.out_counts
    sized = lookup(pairs.select("u", "v"), "u", deg, "src", {"n": "_nu"}, ["v"])
    sized = lookup(sized, "v", deg, "src", {"n": "_nv"}, ["u"])
    few_u = F.col("_nu") <= F.col("_nv")
    sides = sized.select("u", "v", F.when(few_u, F.col("u")).otherwise(F.col("v")).alias("few"),
                         F.when(few_u, F.col("v")).otherwise(F.col("u")).alias("many"))
    listed = salted_join(sides, graph.adj.select(F.col("src").alias("few"), F.col("dst").alias("neighbor")), ["few"], ["many"])
    there = graph.adj.select(F.col("src").alias("many"), F.col("dst").alias("neighbor"))
    return (listed.join(there, ["many", "neighbor"], "left_semi")
            .filter((F.col("neighbor") != F.col("u")) & (F.col("neighbor") != F.col("v"))).select("u", "v", "neighbor"))


def weighted_out_degree(graph: Graph, both_ends: bool = True) -> DataFrame:
    """Sum of weights by node: over all its edges, or (both_ends off) only where it is the stored first end."""
    rows = graph.adj if both_ends else graph.edges.select("src", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    found = rows.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_weight"))
    return graph.nodes.select("id").join(found, "id", "left").withColumn("out_weight", F.coalesce("out_weight", F.lit(0.0)))


def double_edges(graph: Graph, attrs: DataFrame) -> DataFrame:
    """Training rows (src, dst, features of src) with every edge in both directions."""
    pairs = graph.edges.select("src", "dst")
    both = pairs.union(pairs.select("dst", "src")).distinct()
    return lookup(both, "src", attrs, "id", {"features": "features"}, ["dst"])


def induced_subgraph(graph: Graph, keep: DataFrame) -> Graph:
    """Edges with both ends in the node set."""
    ids = keep.select("id")
    edges = salted_join(graph.edges, ids.withColumnRenamed("id", "src"), ["src"], ["dst"], "left_semi")
    edges = salted_join(edges, ids.withColumnRenamed("id", "dst"), ["dst"], ["src"], "left_semi").select(*graph.edges.columns)
    return Graph(ids, edges, graph.directed)


def node_split(nodes: DataFrame, test_perc: float, val_perc: float, seed: int = 0) -> DataFrame:
    """(id, test, val): two independent samples of exact size; a node in both is test."""
    n = nodes.count()
    keyed = (nodes.select("id").withColumn("_t", draw("id", F.lit("test"), seed=seed))
             .withColumn("_v", draw("id", F.lit("val"), seed=seed)))
    test = first_k(keyed, int(n * test_perc), "_t", ["id"])
    val = first_k(keyed, int(n * val_perc), "_v", ["id"])
    return keyed.select("id", test.alias("test"), (val & ~test).alias("val"))


def edge_train_mask(graph: Graph, flags: DataFrame) -> DataFrame:
    """Edges with train_removed: an end is a test or validation node."""
    held = flags.select("id", (F.col("test") | F.col("val")).alias("held"))
    rows = lookup(graph.edges, "src", held, "id", {"held": "_s"}, ["dst"])
    rows = lookup(rows, "dst", held, "id", {"held": "_d"}, ["src"])
    return rows.withColumn("train_removed", F.col("_s") | F.col("_d")).select(*graph.edges.columns, "train_removed")


def train_degree(graph: Graph, flags: DataFrame) -> DataFrame:
    """(id, degree) over edges not train_removed; 0 for test and validation nodes."""
    kept = edge_train_mask(graph, flags).filter(~F.col("train_removed")).drop("train_removed")
    found = graph.with_edges(kept).out_counts.select(F.col("src").alias("id"), F.col("n").alias("degree"))
    return flags.select("id").join(found, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def drop_isolated_edges(pairs: DataFrame, flags: DataFrame, train_deg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs without those that touch a node of training degree 0 (unless an end is a pure test node).

    Also returns one row with the number of pairs that name an unknown node.
    """
    marks = (flags.join(train_deg, "id")
             .select("id", F.struct((F.col("degree") == 0).alias("alone"), (~F.col("test") | F.col("val")).alias("strict")).alias("m")))
    rows = lookup(pairs, "src", marks, "id", {"m": "_s"}, ["dst"], "left")
    rows = lookup(rows, "dst", marks, "id", {"m": "_d"}, ["src"], "left")
    unknown = F.col("_s").isNull() | F.col("_d").isNull()
    drop = (F.col("_s.alone") | F.col("_d.alone")) & F.col("_s.strict") & F.col("_d.strict")
    missing = rows.filter(unknown).agg(F.count(F.lit(1)).alias("missing"))
    return rows.filter(~unknown & ~drop).select(*pairs.columns), missing


def prune_pairs(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """Pairs whose second node is neither test nor validation."""
    held = flags.filter(F.col("test") | F.col("val")).select(F.col("id").alias("dst"))
    return salted_join(pairs, held, ["dst"], ["src"], "left_anti").select(*pairs.columns)


def train_nodes(flags: DataFrame, train_deg: DataFrame) -> DataFrame:
    """Training nodes with a training edge."""
    return (flags.filter(~F.col("test") & ~F.col("val")).select("id")
            .join(train_deg.filter(F.col("degree") > 0), "id", "left_semi"))


def label_onehot(labels: DataFrame, num_classes: int) -> DataFrame:
    """(id, label) with an int class -> (id, vector of 0/1); a list is taken as it is."""
    if dict(labels.dtypes)["label"].startswith("array"):
        return labels.select("id", F.col("label").alias("vector"))
    ones = F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: (i == F.col("label")).cast("int"))
    return labels.select("id", ones.alias("vector"))
