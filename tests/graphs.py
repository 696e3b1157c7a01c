"""Hand-made graphs with known answers."""

from vertexloom.operators.graph import Graph, canonical

PATH4 = [("a", "b"), ("b", "c"), ("c", "d")]
STAR5 = [("h", "a"), ("h", "b"), ("h", "c"), ("h", "d")]
TRIANGLE = [("a", "b"), ("b", "c"), ("a", "c")]


def graph(spark, edges, lone=(), directed=False) -> Graph:
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 else None) for e in edges]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    names = sorted({x for e in edges for x in e[:2]} | set(lone))
    return Graph(spark.createDataFrame([(n,) for n in names], "id string"), canonical(df, directed), directed)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def by_id(df, value):
    return {r["id"]: r[value] for r in df.collect()}
