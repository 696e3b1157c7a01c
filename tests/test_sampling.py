from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.hashing import unit
from vertexloom.operators import graph as G, sampling as S, steps, walks as K

from .graphs import PATH4, STAR5, TRIANGLE, graph, pairs


def chi2(counts, shares):
    total = sum(counts.values())
    return sum((counts.get(k, 0) - p * total) ** 2 / (p * total) for k, p in shares.items())


@pytest.fixture
def tiny_buckets(monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    monkeypatch.setattr(S, "SLOT_BLOCK", 2)


def test_positions_in_small_buckets(spark, tiny_buckets):
    df = spark.range(100).selectExpr("CAST(id % 3 AS string) AS g", "id AS item")
    rows = S.positions(df, ["g"], ["g", "item"], 1).collect()
    for g in "012":
        assert sorted(r.pos for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_weighted_choice_shares(spark, tiny_buckets):
    weights = {"a": 1.0, "b": 2.0, "c": 0.5, "d": 400.0, "e": 0.0, **{f"x{i}": 0.01 for i in range(40)}}
    df = spark.createDataFrame([("g", k, w) for k, w in weights.items()], "grp string, item string, w double")
    table, totals = S.pick_table(df, ["grp"], ["item"], "w")
    assert totals.first().slots == 44
    draws = spark.range(20000).select(F.lit("g").alias("grp"), "id")
    got = Counter(r.item for r in S.weighted_choice(draws, table, totals, ["grp"], unit("id", seed=1)).collect())
    total = sum(weights.values())
    assert sum(got.values()) == 20000 and "e" not in got
    groups = Counter()
    for k, n in got.items():
        groups["x" if k.startswith("x") else k] += n
    shares = {"a": 1 / total, "b": 2 / total, "c": 0.5 / total, "d": 400 / total, "x": 0.4 / total}
    assert chi2(groups, shares) < 25


def test_neighbor_sample(spark):
    g = graph(spark, STAR5, lone=["z"])
    rows = S.neighbor_sample(g.adj, 3, seed=1).collect()
    hub = [r.dst for r in rows if r.src == "h"]
    assert len(set(hub)) == 3 and all([r.dst for r in rows if r.src == x] == ["h"] * 3 for x in "abcd")
    assert not [r for r in rows if r.src == "z"]


def test_negative_sample_follows_degree(spark):
    g = graph(spark, STAR5)
    draws = spark.range(10000).withColumnRenamed("id", "i")
    got = Counter(r.node for r in S.negative_sample(draws, G.degrees(g), ["i"], 3).collect())
    total = 4 ** 0.75 + 4
    assert chi2(got, {"h": 4 ** 0.75 / total, **{x: 1 / total for x in "abcd"}}) < 20


def test_loguniform(spark):
    got = Counter(r["class"] for r in S.negative_sample_loguniform(spark.range(20000), 6, ["id"], 1).collect())
    assert chi2(got, {c: np.log((c + 2) / (c + 1)) / np.log(7) for c in range(6)}) < 22


def test_minibatches(spark):
    rows = S.minibatches(spark.range(100), ["id"], 32).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in rows} == {0: 32, 1: 32, 2: 32, 3: 4}


def legal(walks, edges):
    allowed = {tuple(sorted(e[:2])) for e in edges}
    return all(tuple(sorted(s)) in allowed for w in walks for s in zip(w, w[1:]))


def test_uniform_walks(spark, tiny_buckets):
    g = graph(spark, PATH4 + TRIANGLE, lone=["z"])
    walks = {(r.round, r.start): r.path for r in K.deepwalk_walks(g, 3, 20, seed=1).collect()}
    assert len(walks) == 15 and legal(walks.values(), PATH4 + TRIANGLE)
    assert all(len(p) == (1 if s == "z" else 20) and p[0] == s for (_, s), p in walks.items())


def test_walks_stop_at_sinks(spark):
    g = graph(spark, [("a", "b"), ("b", "c")], directed=True)
    got = {r.start: r.path for r in K.deepwalk_walks(g, 1, 30).collect()}
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c"], "c": ["c"]}
    assert {r.start: r.path for r in K.node2vec_walks(g, 1, 1, 1, 30).collect()} == got


def test_node2vec_bias(spark):
    """From a over b: back to a with weight 1/p, to c (linked to a) 1, to d 1/q."""
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("b", "d")]
    walks = [r.path for r in K.node2vec_walks(graph(spark, edges), 0.25, 2.0, 3000, 3, seed=1).collect()]
    assert legal(walks, edges) and all(len(w) == 3 for w in walks)
    got = Counter(w[2] for w in walks if w[:2] == ["a", "b"])
    assert chi2(got, {"a": 4 / 5.5, "c": 1 / 5.5, "d": 0.5 / 5.5}) < 16


def test_star_return_bias(spark):
    walks = [r.path for r in K.node2vec_walks(graph(spark, STAR5), 0.01, 1.0, 200, 3, seed=1).collect()]
    back = [w[0] == w[2] for w in walks if w[0] != "h"]
    assert sum(back) / len(back) > 0.95


def test_evenly_spread_rows(spark):
    """A row without cells goes anywhere; a row with both does so by its mass."""
    cells = spark.createDataFrame([("a", "b", 1.0)], "row string, col string, value double")
    even = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "row string, mass double")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    walks = K.weighted_walks(nodes, cells, even, G.node_index(nodes), 2000, 2, seed=1).collect()
    assert all(len(r.path) == 2 for r in walks)
    got = Counter(tuple(r.path) for r in walks)
    assert chi2({k: v for k, v in got.items() if k[0] == "a"}, {("a", "a"): 0.25, ("a", "b"): 0.75}) < 11
    assert chi2({k: v for k, v in got.items() if k[0] == "b"}, {("b", "a"): 0.5, ("b", "b"): 0.5}) < 11


def test_skipgram_window(spark):
    walks = spark.createDataFrame([(["a", "b", "c", "d"],)], "path array<string>")
    assert pairs(K.skipgram_pairs(walks, 1), "centre", "context") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")]
    assert K.skipgram_pairs(walks, 10).count() == 12


def test_returns_in_bounded_passes(spark, monkeypatch):
    """With p = 0.001 nearly every step goes back, and no proposal is refused for that; with p = 1000 the way back isn't proposed again and again."""
    passes = []
    real = K._moves
    monkeypatch.setattr(K, "_nowhere", lambda f=K._nowhere: passes.append(1) or f())
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("d", "e")]
    for p in (0.001, 1000.0):
        passes.clear()
        walks = [r.path for r in K.node2vec_walks(graph(spark, edges), p, 1.0, 20, 12, seed=2).collect()]
        assert legal(walks, edges) and all(len(w) == 12 for w in walks) and len(passes) <= 3 * 12
        back = sum(w[i] == w[i - 2] for w in walks for i in range(2, 12)) / sum(10 for _ in walks)
        assert back > 0.95 if p < 1 else back < 0.3  # e has no other way
    assert real is K._moves


def test_a_step_shuffles_the_walkers_only(spark):
    """No exchange stands between the step table's scan and a join, with joins that can't be broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = graph(spark, [(str(i), str((i * 7 + k) % 60)) for i in range(60) for k in (1, 2, 5) if i != (i * 7 + k) % 60])
        walks = K.deepwalk_walks(g, 2, 6, seed=1)
        steps, totals = K.uniform_steps(g.adj)
        moves = K._moves(K._with_next(steps, totals, K._arrivals(g.adj)))
        asked = g.nodes.select(F.col("id").alias("_at_key"), F.length("id").cast("bigint").alias("_at_slot"), F.length("id").cast("bigint").alias("_t"))
        plan = asked.join(moves, F.expr(K.MEETS), "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert walks.count() == 2 * g.nodes.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_packed_steps_walk_the_same(spark, monkeypatch):
    """Packed blocks, each node's moves in chunks of three slots, and joined step rows give equal walks."""
    ends = {tuple(sorted((str(i), str((i * 7 + k) % 40)))) for i in range(40) for k in (1, 2, 5) if i != (i * 7 + k) % 40}
    g = graph(spark, sorted(ends) + [("hub", str(i)) for i in range(0, 40, 2)], lone=["z"])
    joined = sorted(map(tuple, K.deepwalk_walks(g, 2, 10, seed=1).collect()))
    monkeypatch.setattr(K, "PACKED_ROWS", 0)
    monkeypatch.setattr(steps, "CHUNK", 3)
    monkeypatch.setattr(steps, "LEAST_ROWS", 20)
    assert sorted(map(tuple, K.deepwalk_walks(g, 2, 10, seed=1).collect())) == joined


def test_large_step_tables_are_packed(spark, monkeypatch):
    """A step over many moves reads packed blocks and shuffles the walkers only: step rows were read and sorted again for each step."""
    monkeypatch.setattr(K, "PACKED_ROWS", 0)
    g = graph(spark, PATH4 + TRIANGLE)
    table, totals = K.uniform_steps(g.adj)
    meet = K._meeting(K._with_next(table, totals, None), totals, True)
    asked = g.nodes.select("id", F.col("id").alias("_at_key"), F.lit(0).cast("bigint").alias("_at_slot"), F.lit(0).cast("bigint").alias("_t"))
    met = meet(asked)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan and "Bucketed: true" in plan
    ends = {(r.src, r.dst) for r in g.adj.collect()}
    assert all((r.id, r.dst) in ends for r in met.collect())


@pytest.mark.parametrize("kind", ["uniform", "second", "even"])
def test_walks_in_tasks_that_hold_the_table(spark, monkeypatch, kind):
    """The same rows as step by step, with starts that come several times, null and lone ones, edges of no weight and a loop; and no join for a step."""
    from vertexloom.operators import carried
    rng = np.random.default_rng(1)
    ids = [f"n{k}" for k in range(16)]
    ends = sorted({tuple(sorted(rng.choice(14, 2, replace=False).tolist())) for _ in range(40)})
    edges = spark.createDataFrame([(ids[a], ids[b], [0.0, 1.0, 2.5, None][k % 4]) for k, (a, b) in enumerate(ends)] + [("n1", "n1", 3.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*ids, "n3", "n15", "n3", None]], "id string")
    even = spark.createDataFrame([("n5", 0.5), ("n15", 1.0)], "row string, mass double")
    g = G.Graph(nodes, edges)
    cells = g.adj.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))

    def made():
        if kind == "even":
            return K.weighted_walks(nodes, cells, even, G.node_index(nodes), 2, 12, 6)
        return K.node2vec_walks(g, 0.5, 0.8, 2, 12, 4) if kind == "second" else K.deepwalk_walks(g, 2, 12, 5)

    def rows(df):
        return sorted((r["round"], r.start or "", [x or "" for x in r.path]) for r in df.collect())
    held = made()
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    got = rows(held)
    monkeypatch.setattr(carried, "CARRIED", -1)
    assert got == rows(made()) and len(got) == 34


@pytest.mark.parametrize("held", [40, 10 ** 6])
def test_pair_counts(spark, monkeypatch, held):
    """As many as the pairs listed one by one; walks of one and no place, null nodes, nodes that repeat; pairs leave a task packed."""
    from vertexloom.operators import pair_counts as P
    monkeypatch.setattr(P, "HELD", held)
    rng = np.random.default_rng(5)
    paths = [[f"n{x}" if x else None for x in rng.integers(0, 9, size)] for size in (0, 1, 2, 12, 30, 30, 400)] + [None, ["a"] * 600]
    walks = spark.createDataFrame([(p,) for p in paths], "path array<string>").repartition(3)
    for window in (1, 3, 10):
        want = Counter((r.centre, r.context) for r in K.skipgram_pairs(walks, window).collect())
        made = P.pair_counts(walks, window)
        got = [(r.centre, r.context, r.n) for r in made.collect()]
        assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_masses_of_a_guide_table_are_deleted(spark):
    """What the lines were made from isn't kept, and totals and slots agree with the lines."""
    import glob
    from vertexloom.plans.lineage import scratch_dir
    before = set(glob.glob(f"{scratch_dir(spark)}/vertexloom-masses-*"))
    rows = spark.createDataFrame([("a", f"x{k}", float(k % 4)) for k in range(30)] + [("b", "y", 2.0), (None, "z", 1.0), ("c", "y", 0.0)], "g string, x string, w double")
    table, totals = S.pick_table(rows, ["g"], ["x"], "w")
    ends = {r.g: (r.hi, r.slots) for r in table.groupBy("g").agg(F.max("hi").alias("hi"), (F.max("slot") + 1).alias("slots")).collect()}
    assert ends == {r.g: (r.total, r.slots) for r in totals.collect() if r.g is not None} and set(ends) == {"a", "b"}
    assert set(glob.glob(f"{scratch_dir(spark)}/vertexloom-masses-*")) == before
