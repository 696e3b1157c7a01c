import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.operators import graph as G, matrix as M, sampling as S
from vertexloom.plans import ranks, skew
from vertexloom.sources import readers as R, writers as W

from .graphs import PATH4, STAR5, TRIANGLE, by_id, graph, pairs


def test_path(spark):
    g = graph(spark, PATH4)
    assert by_id(G.degrees(g), "degree") == {"a": 1, "b": 2, "c": 2, "d": 1}
    assert G.graph_density(g).first().density == 0.5
    assert G.avg_degree(g).first().avg_degree == 1.5
    assert pairs(G.neighbors(g, "b"), "neighbor") == [("a",), ("c",)]


def test_triangle_and_lone_node(spark):
    g = graph(spark, TRIANGLE, lone=["d"])
    assert pairs(G.isolates(g), "id") == [("d",)]
    uv = spark.createDataFrame([("a", "b")], "u string, v string")
    assert pairs(G.common_neighbors(g, uv), "neighbor") == [("c",)]
    cells, even = M.row_probdist(g.adj.selectExpr("src AS row", "dst AS col", "weight AS value"), g.nodes.withColumnRenamed("id", "row"))
    assert pairs(even, "row") == [("d",)]
    assert all(r.value == 0.5 for r in cells.collect())


def test_self_loop_counts_twice(spark):
    g = graph(spark, [("a", "a"), ("a", "b")])
    assert by_id(G.degrees(g), "degree") == {"a": 3, "b": 1}
    assert g.adj.count() == 3


def test_directed(spark):
    g = graph(spark, [("a", "b"), ("b", "c")], directed=True)
    assert pairs(G.neighbors(g, "b"), "neighbor") == [("c",)]
    assert G.graph_density(g).first().density == pytest.approx(2 / 6)
    with pytest.raises(ValueError):
        M.biased_transition(g, g.adj.selectExpr("src AS row", "dst AS col", "weight AS sim"), mode=2)


def test_split_sizes(spark):
    nodes = spark.range(103).selectExpr("CAST(id AS string) AS id")
    flags = G.node_split(nodes, 0.1, 0.25, seed=1).collect()
    assert sum(f.test for f in flags) == 10 and not any(f.test and f.val for f in flags)
    assert 25 - 10 <= sum(f.val for f in flags) <= 25


def test_remove_edges_is_exact(spark):
    g = graph(spark, [(f"n{i}", f"n{j}") for i in range(15) for j in range(i)])
    rest, removed = G.remove_edges(g, 0.33, seed=2)
    assert removed.count() == int(0.33 * 105) and rest.edges.count() == 105 - int(0.33 * 105)
    assert rest.edges.join(removed, ["src", "dst"]).isEmpty()


def test_drop_isolated_counts_unknown_ids(spark):
    g = graph(spark, PATH4)
    flags = G.node_split(g.nodes, 0.0, 0.0)
    more = g.edges.select("src", "dst").union(spark.createDataFrame([("a", "zz")], "src string, dst string"))
    kept, missing = G.drop_isolated_edges(more, flags, G.train_degree(g, flags))
    assert kept.count() == 3 and missing.first().missing == 1


def test_validate(spark):
    g = graph(spark, PATH4)
    attrs = spark.createDataFrame([(x, [1.0]) for x in "abcz"], "id string, features array<double>")
    assert pairs(G.validate_attrs(g, attrs), "id") == [("d",), ("z",)]


def test_salted_join_equals_plain_join(spark):
    left = spark.range(1000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS string)) AS k", "id AS x")
    right = left.select("k").distinct().selectExpr("k", "length(k) AS y")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.salted_join(left, right, ["k"], ["x"], counts=counts, hot_rows=20)
    assert pairs(got, "k", "x", "y") == pairs(left.join(right, "k"), "k", "x", "y")
    hot = skew.hot_keys(left.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], 20).collect()
    assert [(h.k, h._parts) for h in hot] == [("hot", 17)]
    outer = skew.salted_join(left, right.filter("k <> 'hot'"), ["k"], ["x"], "left", counts=counts, hot_rows=20)
    assert outer.count() == 1000 and outer.filter("y IS NULL").count() == 334
    many = skew.salted_join(left, left.selectExpr("k", "x AS z"), ["k"], ["x"], counts=counts, hot_rows=20)
    assert many.count() == left.join(left.selectExpr("k", "x AS z"), "k").count()


def test_order_helpers(spark):
    df = spark.range(1000).selectExpr("id", "CAST(pmod(id * 7919, 1000) AS bigint) AS r").repartition(7)
    rows = ranks.with_row_index(df, ["r"]).collect()
    assert all(x.idx == x.r for x in rows) and len(rows) == 1000
    sums = ranks.running_sum(df, ["r"], "r", "s").collect()
    assert all(x.s == x.r * (x.r + 1) // 2 for x in sums)
    for k in (0, 1, 17, 1000, 2000):
        assert df.filter(ranks.first_k(df, k, "r", ["id"], span=1000)).count() == min(k, 1000)
    ties = spark.range(50).selectExpr("id", "CAST(3 AS bigint) AS r")
    assert pairs(ties.filter(ranks.first_k(ties, 7, "r", ["id"], span=10)), "id") == [(i,) for i in range(7)]


def test_sparse_power_with_a_hub(spark):
    g = graph(spark, STAR5)
    cells = g.adj.selectExpr("src AS row", "dst AS col", "weight AS value")
    plain = M.matmul(cells, cells)
    split = M.matmul(cells, cells, hot_products=2)
    assert pairs(plain, "row", "col", "value") == pairs(split, "row", "col", "value")
    assert {(r.row, r.col): r.value for r in plain.collect()}[("h", "h")] == 4.0
    assert M.matpow(cells, 2, top_per_row=1).count() == 5


def test_text_round_trips(spark, tmp_path):
    path = tmp_path / "adj.txt"
    path.write_text("# graph\na b c\nb a # again\n\nd\n")
    g = R.read_adjlist(spark, str(path))
    assert pairs(g.edges, "src", "dst") == [("a", "b"), ("a", "c")] and pairs(g.nodes, "id") == [(x,) for x in "abcd"]
    assert not G.graph_flags(g).first().is_weighted
    path.write_text("b a 2.5\na c\na b 3\n")
    g = R.read_edgelist(spark, str(path), weighted=True)
    assert pairs(g.edges, "src", "dst", "weight") == [("a", "b", 3.0), ("a", "c", 1.0)]
    path.write_text("2 3\nx 1 2 3\ny 4 5 6\n")
    assert by_id(R.read_embeddings(spark, str(path)), "vector") == {"x": [1.0, 2.0, 3.0], "y": [4.0, 5.0, 6.0]}
    log = tmp_path / "cora-abrw-1.log"
    log.write_text("STEP3: end learning embeddings; time cost: 12.50s\nroc= 0.900000000\n{'micro': 0.8, 'macro': 0.7, 'samples': 0.8, 'weighted': 0.8}\n")
    (tmp_path / "broken.log").write_text("nothing")
    means, bad = R.read_logs(spark, str(tmp_path))
    row = means.first()
    assert (row.dataset, row.method, row.samples, row.auc, row.seconds) == ("cora", "abrw", 1, 0.9, 12.5)
    assert bad.count() == 1


def test_node_link_document(spark, tmp_path):
    path = tmp_path / "x-G.json"
    path.write_text('{"nodes":[{"id":"1","val":false,"test":false},{"id":"2","val":true,"test":false},\n{"id":"3"}],'
                    '"links":[{"source":"2","target":"1"},{"source":"1","target":"3"}]}')
    nodes, edges = R.read_node_link_json(spark, str(path))
    assert pairs(nodes, "id") == [("1",), ("2",)]
    assert pairs(edges, "src", "dst", "train_removed") == [("1", "2", True)]
    (tmp_path / "map.json").write_text('{"1": 0, "2": 1}')
    assert by_id(R.read_id_map(spark, str(tmp_path / "map.json")), "value") == {"1": "0", "2": "1"}


def test_export_needs_equal_ids(spark, tmp_path):
    emb = spark.createDataFrame([("1", [1.0])], "id string, vector array<double>")
    labels = spark.createDataFrame([("2", ["x"])], "id string, labels array<string>")
    with pytest.raises(ValueError):
        W.export_tsv(emb, labels, str(tmp_path / "v"), str(tmp_path / "l"))


def test_non_edges(spark):
    g = graph(spark, PATH4)
    index = G.node_index(g.nodes)
    assert pairs(S.sample_non_edges(g, index, 3, seed=1), "src", "dst") == [("a", "c"), ("a", "d"), ("b", "d")]
    with pytest.raises(ValueError):
        S.sample_non_edges(g, index, 4, seed=1)


def test_one_large_document(spark, tmp_path, monkeypatch):
    """A document of several ranges is read in as many tasks and equals json.load; braces in strings and nested objects send it to one task."""
    rng = random.Random(3)
    n = 20_000
    doc = {"directed": False, "graph": {}, "nodes": [{"test": i % 7 == 0, "id": i, "val": i % 5 == 0} if i % 50 else {"id": i} for i in range(n)],
           "links": [{"source": rng.randrange(n), "target": rng.randrange(n)} for _ in range(n)], "multigraph": False}
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        for k, indent in enumerate((None, 1)):
            path = str(tmp_path / f"{k}-G.json")
            with open(path, "w") as f:
                json.dump({x: v for x, v in doc.items() if x != "multigraph"}, f, indent=indent)
            assert R._flat_objects(spark, path).rdd.getNumPartitions() > 3
            nodes, edges = R.read_node_link_json(spark, path)
            want = {(str(x["id"]), x["val"], x["test"]) for x in doc["nodes"] if "val" in x}
            assert {tuple(r) for r in nodes.collect()} == want
            marks = {i: v or t for i, v, t in want}
            pairs = {tuple(sorted((str(x["source"]), str(x["target"])))) for x in doc["links"]}
            mine = {(r.src, r.dst): r.train_removed for r in edges.collect()}
            assert all(mine[p] == (marks[p[0]] or marks[p[1]]) for p in pairs if p in mine and p[0] in marks and p[1] in marks) and set(mine) <= pairs
        numbers, lists = {str(i): i * 2 for i in range(9000)}, {str(i): [i % 2, 1, 0] for i in range(9000)}
        for k, value in enumerate((numbers, lists)):
            for compact in (None, (",", ":")):
                path = str(tmp_path / f"map{k}.json")
                with open(path, "w") as f:
                    json.dump(value, f, separators=compact)
                assert {r.id: json.loads(r.value) for r in R.read_id_map(spark, path).collect()} == value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    odd = {"nodes": [{"id": "a}b", "val": True, "test": False}, {"id": "c", "val": False, "test": False, "more": {"x": 1}}], "links": [{"source": "a}b", "target": "c"}]}
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    assert R._flat_objects(spark, str(tmp_path / "odd.json")) is None
    nodes, edges = R.read_node_link_json(spark, str(tmp_path / "odd.json"))
    assert {r.id for r in nodes.collect()} == {"a}b", "c"} and edges.count() == 1
    (tmp_path / "odd-map.json").write_text(json.dumps({"a,b": 1, "c": 2}))
    assert {(r.id, r.value) for r in R.read_id_map(spark, str(tmp_path / "odd-map.json")).collect()} == {("a,b", "1"), ("c", "2")}


def test_graph_data_as_one(spark, tmp_path):
    """Graph, classes, scaled features by the id map, and walks; nodes without marks are left out."""
    doc = {"nodes": [{"id": i, "val": i == 3, "test": i == 4} for i in range(5)] + [{"id": 9}], "links": [{"source": 0, "target": 1}, {"source": 1, "target": 3}]}
    files = {"G": doc, "id_map": {str(i): 4 - i for i in range(5)} | {"9": 5}, "class_map": {str(i): [0, 1, i % 2] for i in range(5)} | {"9": [1, 0, 0]}}
    for name, value in files.items():
        (tmp_path / f"g-{name}.json").write_text(json.dumps(value))
    (tmp_path / "g-walks.txt").write_text("0\t1\n1\t0\n")
    feats = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "place bigint, features array<double>")
    got = R.read_graph_data(spark, str(tmp_path / "g"), feats, walks=True)
    assert {r.id: r.labels for r in got.labels.collect()} == {str(i): ["1", "2"] if i % 2 else ["1"] for i in range(5)}
    x = np.array([[4.0 - i, 1.0] for i in range(5)])
    fit = x[:3]
    want = (x - fit.mean(0)) / np.where(fit.std(0) == 0, 1, fit.std(0))
    rows = {r.id: r.features for r in got.features.collect()}
    assert np.allclose([rows[str(i)] for i in range(5)], want)
    assert got.walks.count() == 2 and {(r.src, r.dst, r.train_removed) for r in got.edges.collect()} == {("0", "1", False), ("1", "3", True)}
