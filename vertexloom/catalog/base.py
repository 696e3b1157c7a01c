"""Registry of named queries, and the graphs they run on.

Two graphs are made from the given tables:
* purchases: customers and parts, an edge for each part a customer ordered, weight = quantity in all;
* vectors: the embedding rows as nodes with attributes and a label; each order links the row its
  customer number falls on with the row its order number falls on, weight = number of orders.
The edges are written once, as a user would have them on disk, where a query reads them several times. Random choices are md5 draws, so each query can be stated in SQL as well.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.graph import Graph
from ..plans.lineage import cut

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def purchases(spark: SparkSession, sf: str, store: bool = True) -> Graph:
    customer = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    part = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    edges = lines.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(
        F.sum("l_quantity").alias("weight"))
    return Graph(customer.union(part), cut(edges, "edges") if store else edges)


def vectors(spark: SparkSession, sf: str, directed: bool = False, store: bool = True) -> Graph:
    n = table(spark, sf, "embeddings").count()
    ends = table(spark, sf, "orders").select((F.col("o_custkey") % n).cast("string").alias("a"), (F.col("o_orderkey") % n).cast("string").alias("b"))
    src, dst = ("a", "b") if directed else (F.least("a", "b"), F.greatest("a", "b"))
    src = F.col(src) if isinstance(src, str) else src
    dst = F.col(dst) if isinstance(dst, str) else dst
    edges = ends.filter("a <> b").groupBy(src.alias("src"), dst.alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return Graph(nodes, cut(edges, "edges") if store else edges, directed)


def communities(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """(graph, attributes): a graph that methods can learn from. An order links the row its customer number falls on with the row its own number falls on
    among those with the same label, and one order in ten with the row it falls on among all. Attributes have 0.5 more in the place of the label."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    placed = cut(rows.select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("place"),
                             F.count(F.lit(1)).over(Window.partitionBy("label")).alias("size")), "placed")
    ends = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % n).alias("a"))
    astray = F.xxhash64("o_orderkey") % 10 == 0
    mine = ends.join(placed.select(F.col("vec_id").alias("a"), "label", "size"), "a")
    near = mine.filter(~astray).select("a", "label", (F.col("o_orderkey") % F.col("size")).alias("place")).join(placed.select("label", "place", F.col("vec_id").alias("b")), ["label", "place"]).select("a", "b")
    pairs = near.union(mine.filter(astray).select("a", (F.col("o_orderkey") % n).alias("b"))).filter("a <> b")
    src, dst = F.col("a").cast("string"), F.col("b").cast("string")
    edges = pairs.groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    attrs = rows.select(F.col("vec_id").cast("string").alias("id"), F.transform("v", lambda x, i: x + F.when(i == F.col("label"), 0.5).otherwise(0.0)).alias("features"))
    return Graph(rows.select(F.col("vec_id").cast("string").alias("id")), cut(edges, "edges")), attrs


def vector_attrs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def vector_emb(spark: SparkSession, sf: str) -> DataFrame:
    return vector_attrs(spark, sf).withColumnRenamed("features", "vector")


def vector_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array(F.col("label").cast("string")).alias("labels"))


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two labels for a node: the type and the brand of the part."""
    return table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.array("p_type", "p_brand").alias("labels"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def exploded(df: DataFrame, column: str = "vector") -> DataFrame:
    """(id, i, value) rows of a vector column."""
    return (df.select("id", F.posexplode(column).alias("i", "value"))
            .select("id", F.col("i").cast("bigint").alias("i"), F.round(F.col("value").cast("double"), 6).alias("value")))


# ---- the same graphs in SQL


def h(*keys, seed) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(str(k) for k in keys)}, '{seed}')), 1, 13))::BIGINT"


def u(*keys, seed) -> str:
    return f"({h(*keys, seed=seed)} / 4503599627370496.0::DOUBLE)"


P = """p_nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part),
p_edges AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS weight
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p_adj AS (SELECT src, dst, weight FROM p_edges UNION ALL SELECT dst, src, weight FROM p_edges)"""

V = """v_ends AS (SELECT (o_custkey % n)::VARCHAR AS a, (o_orderkey % n)::VARCHAR AS b
           FROM orders, (SELECT count(*) AS n FROM embeddings)),
v_nodes AS (SELECT vec_id::VARCHAR AS id FROM embeddings),
v_edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*)::DOUBLE AS weight FROM v_ends WHERE a <> b GROUP BY 1, 2),
v_adj AS (SELECT src, dst, weight FROM v_edges UNION ALL SELECT dst, src, weight FROM v_edges),
d_edges AS (SELECT a AS src, b AS dst, count(*)::DOUBLE AS weight FROM v_ends WHERE a <> b GROUP BY 1, 2)"""

X = """x AS (SELECT vec_id::VARCHAR AS id, list_transform(embedding, lambda e: e::DOUBLE) AS v, label FROM embeddings),
xe AS (SELECT id, unnest(range(0, len(v))) AS i, unnest(v) AS value FROM x)"""


def node_flags(test: float, val: float, seed, nodes: str = "v_nodes") -> str:
    """CTE `flags` (id, test, val): exact-size samples by draw."""
    return f"""flags AS (
  SELECT id, rt <= floor({test}::DOUBLE * n) AS test, rv <= floor({val}::DOUBLE * n) AND NOT rt <= floor({test}::DOUBLE * n) AS val
  FROM (SELECT id, row_number() OVER (ORDER BY {h('id', "'test'", seed=seed)}, id) AS rt,
               row_number() OVER (ORDER BY {h('id', "'val'", seed=seed)}, id) AS rv, count(*) OVER () AS n FROM {nodes}))"""
