"""Gradients by finite differences, objectives, and quality on planted communities."""

import inspect

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.catalog.embedding import OPTIONS
from vertexloom.embeddings import blocks, experiment as X, factor, gradient, sage, spectral, walked
from vertexloom.functions.hashing import unit
from vertexloom.operators import aggregate as A, evaluate as E
from vertexloom.operators.graph import Graph, node_index
from vertexloom.operators.walks import deepwalk_walks, skipgram_pairs
from vertexloom.plans.lineage import cut

from .graphs import by_id, graph


@pytest.fixture(scope="module")
def planted(spark):
    """Nodes in 6 groups; links, attributes and labels follow the group."""
    nodes = spark.range(120).selectExpr("CAST(id AS string) AS id", "id % 6 AS grp")
    a, b = nodes.toDF("src", "ga"), nodes.toDF("dst", "gb")
    edges = (a.join(b, F.col("src") < F.col("dst"))
             .filter(unit("src", "dst", seed=42) < F.when(F.col("ga") == F.col("gb"), 0.45).otherwise(0.012))
             .select("src", "dst", F.lit(None).cast("double").alias("weight")))
    noise = F.transform(F.sequence(F.lit(0), F.lit(11)),
                        lambda i: F.when(i % 6 == F.col("grp"), 1.2).otherwise(0.0) + unit("id", i, seed=5))
    attrs = cut(nodes.select("id", noise.alias("features")))
    labels = cut(nodes.select("id", F.array(F.col("grp").cast("string")).alias("labels")))
    return Graph(cut(nodes.select("id")), cut(edges)), attrs, labels


WALKS = {"num_walks": 4, "walk_length": 12, "window": 3, "epochs": 10}
SETTINGS = {
    "attrpure": {"dim": 8}, "grarep": {"dim": 16, "kstep": 2}, "tadw": {"dim": 8}, "aane": {"dim": 8, "maxiter": 2},
    "deepwalk": {"dim": 16, **WALKS}, "node2vec": {"dim": 16, **WALKS}, "abrw": {"dim": 16, "topk": 8, **WALKS}, "attrcomb": {"dim": 16, **WALKS},
    "line": {"dim": 16, "epochs": 40, "passes": 20}, "asne": {"dim": 16, "epochs": 40, "passes": 20},
    "sagemean": {"dim": 16, "epochs": 4, "samples": (8, 5), "learning_rate": 0.03},
    "sagegcn": {"dim": 16, "epochs": 4, "samples": (8, 5), "learning_rate": 0.03},
}


@pytest.mark.parametrize("method", X.METHODS)
def test_better_than_chance(spark, planted, method):
    g, attrs, labels = planted
    run = X.run_experiment(g, method, attrs, labels, link_remove=0.15, label_reserved=0.5, **SETTINGS[method])
    row = run.metrics.first()
    assert run.vectors.count() == 120
    assert row.auc > (0.8 if method in ("deepwalk", "node2vec", "abrw", "line", "asne", "sagemean", "sagegcn") else 0.6) and row.micro > 0.35, (row.auc, row.micro)
    widths = {len(r.vector) for r in run.vectors.collect()}
    assert widths == {SETTINGS[method]["dim"] * (2 if method == "tadw" else 1)}


@pytest.mark.parametrize("method", ["deepwalk", "node2vec", "abrw", "attrcomb", "grarep", "aane"])
def test_registered_at_the_defaults(method):
    """The queries take nothing off the operators' own walks, windows, steps and iterations."""
    usual = inspect.signature({**X.STRUCTURE, **X.WITH_ATTRIBUTES}[method]).parameters
    train = inspect.signature(walked.skipgram).parameters
    assert all(value == (usual.get(k) or train[k]).default for k, value in OPTIONS[method].items())


def test_losses_go_down(spark, planted):
    g, attrs, _ = planted
    for out in (factor.tadw(g, attrs, 8, maxiter=6), gradient.line(g, 8, 1, epochs=6, passes=2), gradient.line(g, 8, 2, epochs=6, passes=2), gradient.asne(g, attrs, 8, epochs=6, passes=2)):
        losses = [x for _, x in out.history]
        assert losses[-1] < losses[0]
    tadw = [x for _, x in factor.tadw(g, attrs, 8, maxiter=6).history]
    assert all(b <= a + 1e-9 for a, b in zip(tadw, tadw[1:]))
    gaps = [x for _, x in factor.aane(g, attrs, 4, maxiter=4).history]
    assert gaps[-1] < gaps[0]
    pure = factor.aane(g, None, 4, maxiter=1, mode="pure")
    assert pure.vectors.count() == 120


def test_tadw_against_dense_algebra(spark):
    rng = np.random.default_rng(0)
    names = "abcdef"
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")]
    g = graph(spark, edges, lone="f")
    x = rng.normal(size=(6, 3))
    attrs = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x)], "id string, features array<double>")
    adj = np.zeros((6, 6))
    for u, v in edges:
        adj[names.index(u), names.index(v)] = adj[names.index(v), names.index(u)] = 1
    adj = adj / np.maximum(adj.sum(1, keepdims=True), 1)
    m, t, lamb, h = (adj + adj @ adj) / 2, x.T, 0.2, np.random.default_rng(0).standard_normal((2, 3))
    for _ in range(3):
        b = h @ t
        w = np.linalg.solve(2 * b @ b.T + lamb * np.eye(2), 2 * b @ m.T)
        left = np.kron(t @ t.T, w @ w.T) + lamb * np.eye(6)
        h = np.linalg.solve(left, (w @ m @ t.T).T.ravel()).reshape(3, 2).T
    want = np.hstack([w.T / np.maximum(np.linalg.norm(w.T, axis=1, keepdims=True), 1e-300), (t.T @ h.T) / np.linalg.norm(t.T @ h.T, axis=1, keepdims=True)])
    got = by_id(factor.tadw(g, attrs, 2, lamb, 3).vectors, "vector")
    # the last W step uses the H before it
    assert np.allclose(np.array([got[n] for n in names])[:, 2:], want[:, 2:], atol=1e-8)
    assert np.allclose(np.array([got[n] for n in names])[:5, :2], want[:5, :2], atol=1e-8)


def test_aane_step_against_dense_algebra(spark):
    rng = np.random.default_rng(1)
    names = "abcde"
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0), ("c", "d", 1.5), ("d", "e", 0.5)]
    g = graph(spark, edges)
    x = rng.random((5, 3))
    attrs = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x)], "id string, features array<double>")
    adj = np.zeros((5, 5))
    for u, v, weight in edges:
        adj[names.index(u), names.index(v)] = adj[names.index(v), names.index(u)] = weight
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, lamb, rho = xn @ xn.T, 0.05, 5.0

    values, axes = np.linalg.eigh(adj @ adj.T)
    h = axes[:, np.argsort(-values)[:1]]

    def update(own, other, sign, dual):
        out = own.copy()
        for i in range(5):
            near = np.nonzero(adj[i])[0]
            gap = np.linalg.norm(other[near] - own[i], axis=1)
            ok = gap != 0
            w = lamb * adj[i][near][ok] / gap[ok]
            a = 2 * other.T @ other + rho * np.eye(1) + w.sum() * np.eye(1)
            z = other[i] + sign * dual[i]
            out[i] = np.linalg.solve(a, 2 * (s @ other)[i] + (other[near][ok] * w[:, None]).sum(0) + rho * z)
        return out
    z, dual = h.copy(), np.zeros_like(h)
    h = update(h, z, -1, dual)
    z = update(z, h, 1, dual)
    dual = dual + h - z
    h = update(h, z, -1, dual)
    got = by_id(factor.aane(g, attrs, 1, maxiter=1).vectors, "vector")
    got = np.array([got[n] for n in names])
    assert np.allclose(got @ got.T, h @ h.T, atol=1e-5)  # the sign of the start is free


def test_grarep_of_lone_nodes(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], lone=["x", "y"])
    got = by_id(spectral.grarep(g, 4, 2).vectors, "vector")
    names = sorted(got)
    adj = np.zeros((6, 6))
    for u, v in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]:
        adj[names.index(u), names.index(v)] = adj[names.index(v), names.index(u)] = 1
    adj[4:] = 1.0
    adj = adj / adj.sum(1, keepdims=True)
    power, parts = np.eye(6), []
    for _ in range(2):
        power = power @ adj
        with np.errstate(divide="ignore"):
            p = np.log(power / power.sum(0)) - np.log(1 / 6)
        p[~(p > 0)] = 0
        u, s, _ = np.linalg.svd(p)
        r = u[:, :2] * np.sqrt(s[:2])
        parts.append(r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300))
    mat = np.array([got[n] for n in names])
    for k in range(2):
        a, b = mat[:, 2 * k:2 * k + 2], parts[k]
        assert np.allclose(a @ a.T, b @ b.T, atol=1e-6)


def test_grarep_of_directed_dead_ends(spark):
    edges = [("a", "c"), ("a", "e"), ("a", "g"), ("b", "d"), ("b", "e"), ("c", "b"), ("c", "h"), ("d", "b"), ("d", "c"), ("d", "g"), ("e", "d"), ("e", "g"), ("e", "h"),
             ("f", "b"), ("f", "c"), ("f", "e")]
    g = graph(spark, edges, directed=True)
    got = by_id(spectral.grarep(g, 4, 2).vectors, "vector")
    names = sorted(got)
    adj = np.zeros((8, 8))
    for u, v in edges:
        adj[names.index(u), names.index(v)] = 1
    adj[adj.sum(1) == 0] = 1.0
    adj = adj / adj.sum(1, keepdims=True)
    power, mat = np.eye(8), np.array([got[n] for n in names])
    for k in range(2):
        power = power @ adj
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.log(power / power.sum(0)) - np.log(1 / 8)
        p[~(p > 0)] = 0
        u, s, _ = np.linalg.svd(p)
        assert s[1] > s[2] * 1.05
        r = u[:, :2] * np.sqrt(s[:2])
        b = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300)
        part = mat[:, 2 * k:2 * k + 2]
        assert np.allclose(part @ part.T, b @ b.T, atol=1e-5)


def numeric(f, x, eps=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        y = x.copy()
        y[i] += eps
        hi = f(y)
        y[i] -= 2 * eps
        out[i] = (hi - f(y)) / (2 * eps)
    return out


def test_pair_gradients_by_differences():
    rng = np.random.default_rng(0)
    a, w = rng.normal(size=(4, 3)), rng.random(4) + 0.5
    for bias in (False, True):
        b, n = rng.normal(size=(4, 3 + bias)), rng.normal(size=(2, 3 + bias))
        run = lambda a, b, n: gradient.logistic(a, b, w, n, ["p", "q"], ["r", "p", "s", "t"], 5.0, bias)
        ga, gb, gn, _ = run(a, b, n)
        assert np.allclose(ga, numeric(lambda x: run(x, b, n)[3].sum(), a), atol=1e-6)
        assert np.allclose(gb, numeric(lambda x: run(a, x, n)[3].sum(), b), atol=1e-6)
        assert np.allclose(gn, numeric(lambda x: run(a, b, x)[3].sum(), n), atol=1e-6)
    b, n = rng.normal(size=(4, 3)), rng.normal(size=(4, 2, 3))
    hit = np.array([[False, True], [False, False], [True, False], [False, False]])
    for run, n in ((lambda a, b, n: blocks.logistic_batch(a, b, n, w), n),
                   (lambda a, b, n: blocks.softmax_batch(a, b, n, w, np.array([0.2, 0.3, 0.1, 0.5]), np.array([0.4, 0.6]), hit), rng.normal(size=(2, 3)))):
        _, ga, gb, gn = run(a, b, n)
        assert np.allclose(ga, numeric(lambda x: run(x, b, n)[0], a), atol=1e-6)
        assert np.allclose(gb, numeric(lambda x: run(a, x, n)[0], b), atol=1e-6)
        assert np.allclose(gn, numeric(lambda x: run(a, b, x)[0], n), atol=1e-6)


@pytest.mark.parametrize("shared", [False, True])
def test_every_pair_is_used_once_a_visit(spark, monkeypatch, shared):
    """Six buckets and small tasks: all pairs meet, no table row is in two tasks of a round."""
    monkeypatch.setattr(blocks, "PAIRS", 40)
    nodes = spark.range(60).selectExpr("CAST(id AS string) AS id")
    pairs = spark.range(900).selectExpr("CAST(id % 60 AS string) AS u", "CAST(id * 7 % 59 AS string) AS v", "1.0D AS w").distinct()
    laid = blocks.Blocks(pairs, 60, shared, nodes=10)
    assert laid.buckets >= 6 and laid.parts > 1
    table = nodes.select("id", F.lit(1.0).alias("w"), F.array(F.lit(0.0), F.lit(0.0)).alias("x"))
    state = blocks.side_rows(table, blocks.LEFT, laid.buckets)
    if not shared:
        state = state.unionByName(blocks.side_rows(table, blocks.RIGHT, laid.buckets))

    def work(left, right, u, v, w, rng, matrix):
        np.add.at(left[0][:, 0], u, 1.0)
        np.add.at(right[0][:, 1], v, 1.0)
        return 0.0, len(u), None
    out, history, _ = blocks.run_blocks(state, laid, 1, work, 0)
    used = {k: by_id(out.filter(F.col("kind") == k), "x") for k in (0, 1)}
    rows = [(r.u, r.v) for r in pairs.collect()]
    for name in {u for u, _ in rows}:
        assert used[0][name][0] == sum(u == name for u, _ in rows)
        assert used[0 if shared else 1][name][1] == sum(v == name for _, v in rows)


def test_trees():
    """Huffman's lengths, and gradients of the way down by differences."""
    paths, turns = blocks.huffman(np.array([8.0, 4.0, 2.0, 1.0, 1.0]))
    assert [len(p) for p in paths] == [1, 2, 3, 4, 4] and len({tuple(t) for t in turns}) == 5 and all(p[0] == 3 for p in paths)
    assert blocks.huffman(np.array([1.0])) == ([[]], [[]])
    rng = np.random.default_rng(0)
    a, nodes, w = rng.normal(size=(4, 3)), rng.normal(size=(4, 5, 3)), rng.random(4) + 0.5
    sign = rng.choice([1.0, -1.0, 0.0], size=(4, 5))
    _, ga, gn = blocks.path_batch(a, nodes, sign, w)
    assert np.allclose(ga, numeric(lambda x: blocks.path_batch(x, nodes, sign, w)[0], a), atol=1e-6)
    assert np.allclose(gn, numeric(lambda x: blocks.path_batch(a, x, sign, w)[0], nodes), atol=1e-6)


@pytest.mark.parametrize("hs", [False, True])
def test_many_buckets_learn_as_two(spark, planted, hs):
    """With 16 buckets most negatives are nodes of other buckets, and most of a way down a tree lies above a bucket's own; the AUC stays."""
    g, _, _ = planted
    kept, held = E.lp_test_set(g, cut(node_index(g.nodes)), 0.15, 0)
    kept, held = kept.with_edges(cut(kept.edges)), cut(held)
    walks = cut(deepwalk_walks(kept, 4, 12, 1))
    pairs = cut(skipgram_pairs(walks, 3).groupBy(F.col("centre").alias("u"), F.col("context").alias("v")).agg(F.count(F.lit(1)).alias("w")))
    seen = walks.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    auc = []
    for nodes in (60, 8):
        emb = gradient.train_pairs(g.nodes, pairs, seen, 16, 10, 5.0, 0.05, None, 5, scale=0.5 / 16, context_scale=0.0, hs=hs, bucket_nodes=nodes)
        auc.append(E.lp_auc(E.lp_score(held, cut(emb.vectors))).first().auc)
    assert auc[0] > 0.8 and auc[1] > auc[0] - 0.05, auc


def test_negatives_come_from_the_rows_of_a_task_too():
    """A pool that is small beside the task's nodes: each node is drawn in proportion to its weight."""
    weight = np.arange(1.0, 3001.0)
    for own in (3000, 2000):  # all nodes are the task's own, or a third are copies that only the pool knows
        rng = np.random.default_rng(5)
        pool = rng.choice(3000, 64, p=weight / weight.sum())
        t = blocks.Task((None, None), (None, weight), None, None, None, rng, None, pool, own, 0)
        known = gradient._negatives(t)
        counts = np.bincount(known, minlength=3000)
        assert len(known) == own + 64 and (counts > 0).sum() > own // 2 and counts.max() < 16
        assert abs(np.average(known[:own] < own / 2) - 0.25) < 0.05


@pytest.mark.parametrize("shared", [False, True])
def test_a_task_of_many_nodes_learns_with_a_small_pool(shared):
    """A thousand nodes in ten communities and pools of 100: with negatives from the pool alone the AUC was 0.55 and less."""
    rng, n = np.random.default_rng(0), 1000
    a = rng.integers(0, n, 50_000)
    b = np.where(rng.random(50_000) < 0.1, rng.integers(0, n, 50_000), rng.integers(0, n // 10, 50_000) * 10 + a % 10)
    edges = np.unique(np.sort(np.column_stack([a, b])[a != b], 1), axis=0)
    rng.shuffle(edges)
    held, edges, away = edges[:4000], edges[4000:], rng.integers(0, n, (4000, 2))
    u, v = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.bincount(u, minlength=n) ** 0.75
    start = lambda: np.column_stack([rng.normal(size=(n, 8)) / np.sqrt(8), np.zeros(n)])
    x = start()
    c = x if shared else start()
    for r in range(4):
        part = np.arange(len(u)) % 2 == r % 2
        pool = rng.choice(n, 100, p=weight / weight.sum())
        gradient._logistic_work(8, 8, 5, 0.05, 128, 5)(blocks.Task((x, weight), (c, weight), u[part], v[part], np.ones(part.sum()), rng, None, pool, n, 0))
    z = x[:, :8] / np.linalg.norm(x[:, :8], axis=1, keepdims=True)
    rank = np.concatenate([(z[p[:, 0]] * z[p[:, 1]]).sum(1) for p in (held, away)]).argsort().argsort()
    assert (rank[:4000].sum() - 4000 * 3999 / 2) / 4000 ** 2 > 0.8


def test_line_by_labels(spark, planted):
    g, _, labels = planted
    plain, picked = gradient.line(g, 8, 2, epochs=4, passes=2), gradient.line(g, 8, 2, epochs=4, passes=2, labels=labels)
    scores = [E.nc_evaluate(x.vectors, labels, 0.5).first().micro for x in (plain, picked)]
    assert scores[1] >= scores[0]


def support_rows(edges, negatives, near, feats, means, leaf_means):
    """Rows of one batch as a task gets them."""
    schema = pa.schema([("task", pa.int64()), ("batch_id", pa.int64()), ("kind", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("slot", pa.int64()), ("x", pa.list_(pa.float64()))])
    rows = [(sage.EDGE, u, v, None, None) for u, v in edges] + [(sage.NEGATIVE, n, None, i, None) for i, n in enumerate(negatives)]
    rows += [(sage.NEAR, a, b, i, None) for a, bs in near.items() for i, b in enumerate(bs)]
    rows += [(sage.ROOT, a, None, None, [*feats[a], *means[a]]) for a in feats] + [(sage.LEAF, b, None, None, [*feats[b], *leaf_means[b]]) for b in {b for bs in near.values() for b in bs}]
    return pa.Table.from_pylist([dict(zip(schema.names, (0, 0, *r))) for r in rows], schema=schema)


@pytest.mark.parametrize("kind,dropout", [("mean", 0.0), ("gcn", 0.3)])
def test_sage_gradients_by_differences(kind, dropout):
    rng = np.random.default_rng(3)
    names = "abcdef"
    feats, means, leaf_means = ({n: rng.normal(size=4) for n in names} for _ in range(3))
    near = {"a": "bcb", "b": "aac", "c": "dab", "d": "ccc", "e": "aba"}  # f has no neighbours
    s = sage.Support(support_rows(["ab", "bc", "cf", "ab"], ["e", "a"], near, feats, means, leaf_means), 3)
    weights = A.make_weights(kind, [4, 3, 3], kind == "mean", seed=2)
    run = lambda w, back=False: sage.support_step(s, w, 5, 2.0, np.random.default_rng(7), dropout, back)
    _, got = run(weights, True)
    for layer in (0, 1):
        for name in sage._names(weights[layer]):
            for at in np.ndindex(weights[layer][name].shape):
                ends = []
                for eps in (1e-5, -1e-5):
                    moved = [dict(w) for w in weights]
                    moved[layer][name] = moved[layer][name].copy()
                    moved[layer][name][at] += eps
                    ends.append(run(moved)[0])
                assert got[layer][name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-5)


def test_sage_support_of_a_batch(spark, planted, monkeypatch):
    """Each edge is in one batch; a batch has its ends, its negatives, their k neighbours and the features of all of these, and no more."""
    g, attrs, _ = planted
    seen = []
    real = sage.Samples.support
    monkeypatch.setattr(sage.Samples, "support", lambda self, edges, negatives: seen.append((edges.collect(), negatives.collect(), real(self, edges, negatives).collect())) or real(self, edges, negatives))
    sage.sage(g, attrs, dim=4, epochs=1, samples=(4, 3), val_perc=0.0, batch_size=50, neg_sample_size=6)
    (edges, negatives, rows), n = seen[0], g.edges.count()
    assert len(edges) == n and len({r.batch_id for r in edges}) == -(-n // 50) and len(negatives) == 6 * -(-n // 50)
    assert len({r.id for r in negatives}) > 10
    for batch in {r.batch_id for r in edges}:
        mine = [r for r in rows if r.batch_id == batch]
        ends = {x for r in edges if r.batch_id == batch for x in (r.u, r.v)} | {r.id for r in negatives if r.batch_id == batch}
        near = [r for r in mine if r.kind == sage.NEAR]
        assert {r.a for r in mine if r.kind == sage.ROOT} == ends and {r.a for r in near} <= ends and {r.slot for r in near} == {0, 1, 2}
        assert {r.a for r in mine if r.kind == sage.LEAF} == {r.b for r in near} and all(r.task == batch // sage.STEPS for r in mine)
        assert len([r for r in mine if r.kind == sage.ROOT]) == len(ends)
    assert OPTIONS["sagemean"] == OPTIONS["sagegcn"] == {}


def test_f1_of_the_perfect_embedding(spark, planted):
    _, attrs, labels = planted
    emb = E.binarize_labels(labels).select("id", F.col("vector").cast("array<double>").alias("vector"))
    assert E.nc_evaluate(emb, labels, 0.5).first().micro == 1.0
