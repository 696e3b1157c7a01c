import numpy as np
import pytest

from vertexloom.functions import vectors as V
from vertexloom.operators import knn, linalg as L, matrix as M

from .graphs import by_id, graph


def attr_table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id string, features array<double>")


def brute_knn(rows, k, cutoff=False):
    ids = sorted(i for i, _ in rows)
    vec = {i: np.array(v, float) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) if np.linalg.norm(v) else v for i, v in vec.items()}
    zero = {i for i in ids if not vec[i].any()}
    out = {}
    for r in ids:
        if r in zero:
            continue
        blank = 0.0 if cutoff else 0.5
        sims = {c: blank if c in zero else round(float(unit[r] @ unit[c]), 9) for c in ids}
        order = sorted(ids, key=lambda c: (-sims[c], c))
        keep = [c for c in ids if sims[c] >= sims[order[min(k, len(order)) - 1]]] if cutoff else order[:k]
        out.update({(r, c): sims[c] for c in keep if c != r and c not in zero and sims[c] != 0})
    return out


def cases():
    rng = np.random.default_rng(1)
    rows = [(f"n{i:03d}", rng.normal(size=5).round(1)) for i in range(150)]
    copies = rng.normal(size=5)
    rows += [(f"c{i:02d}", copies) for i in range(75)]  # a third of the nodes are copies of one vector
    rows += [(f"m{i:02d}", copies * (i + 2)) for i in range(5)]
    rows += [(f"z{i}", np.zeros(5)) for i in range(4)]
    centre = rng.normal(size=(6, 5)) * 5
    rows += [(f"g{i:02d}", centre[i % 6] + rng.normal(size=5) * 0.1) for i in range(90)]
    return rows


@pytest.mark.parametrize("k", [3, 9])
def test_knn_equals_brute_force(spark, k):
    rows = cases()
    got = knn.attr_knn(attr_table(spark, rows), k, block_rows=16, max_pivots=12)
    got = {(r.row, r.col): r.sim for r in got.collect()}
    want = brute_knn(rows, k)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-9 for p in want)


def test_cutoff_keeps_ties(spark):
    rows = cases()
    got = {(r.row, r.col) for r in knn.attr_topk_cutoff(attr_table(spark, rows), 4, block_rows=16, max_pivots=12).collect()}
    assert got == set(brute_knn(rows, 4, cutoff=True))


def test_cutoff_with_nodes_without_attributes(spark):
    rows = [("a", [1, 0]), ("b", [-1, 0.1]), ("c", [-1, 0]), ("z", [0, 0])]
    got = {(r.row, r.col) for r in knn.attr_topk_cutoff(attr_table(spark, rows), 3).collect()}
    assert got == set(brute_knn(rows, 3, cutoff=True))


def test_approximate_recall(spark):
    rows = cases()
    want = brute_knn(rows, 5)
    got = {(r.row, r.col) for r in knn.attr_knn(attr_table(spark, rows), 5, probes=2, max_pivots=4).collect()}
    assert len(got & set(want)) / len(want) > 0.6


def test_recall_of_nine_tenths_without_clusters(spark):
    """The number of cells follows from the recall, where a fixed few lose neighbours."""
    rows = [(f"n{i}", list(map(float, v))) for i, v in enumerate(np.random.default_rng(3).normal(size=(300, 8)))]
    attrs = attr_table(spark, rows)
    want = set(brute_knn(rows, 5))
    shares = [len({(r.row, r.col) for r in knn.attr_knn(attrs, 5, **how).collect()} & want) / len(want) for how in ({"probes": 1}, {"recall": 0.9})]
    assert shares[0] < 0.9 <= shares[1], shares


def test_knn_copies_a_vector_for_few_blocks(spark, monkeypatch):
    """However many cells there are, a vector goes to a block of candidates once, and blocks are few."""
    rows = [(f"n{i}", list(map(float, v))) for i, v in enumerate(np.random.default_rng(5).normal(size=(600, 8)))]
    seen, kept = {}, knn.cut
    monkeypatch.setattr(knn, "cut", lambda df, name="cut": seen.__setitem__(name, kept(df, name)) or seen[name])
    got = {(r.row, r.col) for r in knn.attr_knn(attr_table(spark, rows), 2, block_rows=16).collect()}
    assert got == set(brute_knn(rows, 2))
    assert seen["points"].select("cell").distinct().count() > 30
    assert seen["queries"].selectExpr("max(size(to))").first()[0] <= 8
    assert seen["tasks"].count() <= 32 * 8  # with a task for two cells there were over 900


def test_beta_of_lone_and_blank_nodes(spark):
    g = graph(spark, [("a", "b")], lone=["c", "d"])
    sims = knn.attr_knn(attr_table(spark, [("a", [1, 0]), ("b", [1, 1]), ("c", [0, 1]), ("d", [0, 0])]), 4)
    cells, even = M.biased_transition(g, sims, beta=0.2)
    rows = {}
    for r in cells.collect():
        rows.setdefault(r.row, {})[r.col] = r.value
    assert {r.row: r.mass for r in even.collect()} == {"d": 1.0}
    assert all(abs(sum(c.values()) - 1) < 1e-12 for c in rows.values()) and set(rows) == {"a", "b", "c"}
    assert "a" not in rows["c"] or rows["c"]["a"] > 0
    assert rows["a"]["b"] == pytest.approx(1.0)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot"])
def test_many_pairs_in_blocks_score_as_joined_rows(spark, metric, monkeypatch):
    """Pairs with a null end, vectors that come twice, are null, blank, shorter or have a null: as the joins and the column functions give."""
    monkeypatch.setattr(M, "BLOCK_PAIRS", 40)
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", rng.normal(size=4).tolist()) for i in range(12)] + [("n3", [1.0, 2.0, 3.0, 4.0]), ("z", [0.0] * 4), ("gap", [1.0, None, 1.0, 1.0]), ("none", None), ("short", [1.0]), (None, [1.0] * 4)]
    attrs = spark.createDataFrame(rows, "id string, features array<double>")
    names = [r[0] for r in rows] + ["away"]
    pairs = spark.createDataFrame([(a, b, k) for a in names for b in names for k in range(3)], "u string, v string, k int")
    got = M.pair_similarity(pairs, attrs, metric)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()  # no join of pairs with vectors
    want = M.with_pair_vectors(pairs, attrs, "features").select("u", "v", "k", M.METRICS[metric](M.F.col("_a"), M.F.col("_b")).alias("sim"))
    key = lambda r: (r.u, r.v, r.k, r.sim is None, r.sim or 0.0)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 900
    assert all(a.sim == b.sim if a.sim is None or b.sim is None else abs(a.sim - b.sim) < 1e-12 for a, b in zip(got, want))


def test_projections(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) * np.array([5, 4, 3, 1, 1, 0.5]) + 2
    attrs = attr_table(spark, [(f"{i:02d}", r) for i, r in enumerate(x)])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    emb, values = L.truncated_svd(attrs, 3)
    got = np.array([v for _, v in sorted(by_id(emb, "vector").items())])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3])) and np.allclose(values, s[:3])
    xc = x - x.mean(0)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    got = np.array([v for _, v in sorted(by_id(L.pca(attrs, 2), "vector").items())])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert V.width(L.svd_features(attrs, 4), "features") == 4 and V.width(L.svd_features(attrs), "features") == 6


def test_svd_of_cells(spark):
    rng = np.random.default_rng(0)
    a = rng.random((30, 4)) @ rng.random((4, 25)) + (rng.random((30, 25)) < 0.02) * 0.05
    cells = spark.createDataFrame([(f"r{i:02d}", f"c{j:02d}", float(a[i, j])) for i in range(30) for j in range(25)], "row string, col string, value double")
    emb, s = L.svd_cells(cells, 4, 1.0)
    u, want, _ = np.linalg.svd(a)
    got = np.array([v for _, v in sorted(by_id(emb, "vector").items())])
    assert np.allclose(s, want[:4], rtol=1e-6)
    assert np.allclose(got @ got.T, (u[:, :4] * want[:4] ** 2) @ u[:, :4].T, atol=1e-4)


def test_scaling_keeps_constant_columns(spark):
    attrs = attr_table(spark, [("a", [1, 7]), ("b", [3, 7]), ("c", [9, 8])])
    got = by_id(M.standard_scale(attrs, attrs.filter("id <> 'c'")), "features")
    assert got == {"a": [-1.0, 0.0], "b": [1.0, 0.0], "c": [7.0, 1.0]}


def test_width_is_checked(spark):
    with pytest.raises(ValueError):
        V.width(attr_table(spark, [("a", [1]), ("b", [1, 2])]), "features")


def test_weighted_vector_sum(spark):
    df = spark.createDataFrame([(0, [1.0, -2.0], 2.0), (0, [3.0, 5.0], 0.5)], "k int, v array<double>, w double")
    assert df.groupBy("k").agg(V.sum_vectors("v", df.w).alias("s")).first().s == pytest.approx([3.5, -1.5])


def test_cells_meet_vectors_in_blocks(spark, monkeypatch):
    """Sums over the cells of a row, and over those of a column, agree with the joins: repeated ids, ids without a vector, nulls and zeros too."""
    from vertexloom.operators import cells as C, linalg
    monkeypatch.setattr(C, "FEW_CELLS", 10)
    monkeypatch.setattr(C, "PIECE_CELLS", 20)
    rng = np.random.default_rng(3)
    rows = [(f"r{a}", f"c{b}", float(x)) for a, b, x in zip(rng.integers(0, 25, 300), rng.integers(0, 20, 300), rng.normal(size=300))]
    rows += [("r1", "c1", 0.0), (None, "c2", 2.0), ("r2", None, 3.0), ("lone", "c19", 1.0)]
    cells = spark.createDataFrame(rows, "row string, col string, value double")
    far = spark.createDataFrame([(f"c{i}", [float(v) for v in rng.normal(size=3)]) for i in [*range(19), 4]], "id string, vector array<double>")
    near = spark.createDataFrame([(f"r{i}", [float(v) for v in rng.normal(size=3)]) for i in [*range(24), 7]], "id string, vector array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    blocks = C.cell_blocks(cells, len(rows), 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert blocks.parts == 2 and blocks.table.count() > 4
    for got, want in ((C.multiply_blocks(blocks, far), linalg.multiply(cells, far)), (C.multiply_blocks(blocks.flipped(), near), linalg.multiply(linalg.flipped(cells), near))):
        got, want = ({r.id: np.array(r.vector) for r in d.collect()} for d in (got, want))
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    got = {r.id: r.vector for r in C.cell_sums(blocks, far, lambda v, x, y: (v * np.abs(x - y).sum(1))[:, None], near).collect()}
    both = cells.join(near.toDF("row", "a"), "row").join(far.toDF("col", "b"), "col").collect()
    want = {}
    for r in both:
        want[r.row] = want.get(r.row, 0.0) + r.value * np.abs(np.array(r.a) - np.array(r.b)).sum()
    assert set(got) == {k for k in want} and all(np.isclose(got[k][0], want[k]) for k in want)


def test_a_pass_shuffles_no_cells(spark):
    """The packed cells are dealt as a block needs them: the vectors and the partial sums are what is shuffled."""
    from vertexloom.operators import cells as C
    cells = spark.createDataFrame([(str(i), str(j), 1.0) for i in range(9) for j in range(9)], "row string, col string, value double")
    vectors = cells.select("row").distinct().selectExpr("row AS id", "array(1.0D) AS vector")
    plan = C.multiply_blocks(C.cell_blocks(cells, 81, 9), vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(_bu") == 1


def test_float_vectors_are_shuffled_as_floats(spark):
    """Blocks of pairs get the vectors as they are and widen them in the task: the scores are those of doubles."""
    rng = np.random.default_rng(5)
    vectors = [(f"n{i}", [float(v) for v in rng.normal(size=4).astype(np.float32)]) for i in range(12)]
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(12) for j in range(12) if i != j], "u string, v string")
    short = spark.createDataFrame(vectors, "id string, features array<float>")
    wide = spark.createDataFrame(vectors, "id string, features array<double>")
    for metric in ("cosine", "euclidean", "manhattan", "dot"):
        got, want = (M.pair_similarity(pairs, a, metric) for a in (short, wide))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "array<double>" not in plan
        one, two = ({(r.u, r.v): r.sim for r in d.collect()} for d in (got, want))
        assert one == two and len(one) == 132


def test_log_ppmi_of_a_power_writes_no_power(spark, monkeypatch):
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((20, 20)) < 0.2, rng.random((20, 20)), 0.0)
    cells = spark.createDataFrame([(str(i), str(j), float(dense[i, j])) for i, j in zip(*dense.nonzero())], "row string, col string, value double")
    written, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df, *a: written.append(cut(df, *a)) or written[-1])
    for k in (1, 2, 3):
        want = {(r.row, r.col): r.value for r in M.log_ppmi(M.matpow(cells, k), 20).collect()}
        written.clear()
        got = {(r.row, r.col): r.value for r in M.log_ppmi_of_power(cells, k, 20).collect()}
        assert set(got) == set(want) and all(np.isclose(got[c], want[c], atol=1e-12) for c in want)
        if k == 2:
            assert len(want) > cells.count() and max(d.count() for d in written) <= cells.count()


def test_blocks_of_a_product(spark, monkeypatch):
    """Repeated cells, null ids, zeros and sums of 0, on a grid of several tasks; products aren't shuffled: no join, no sum by cells."""
    from vertexloom.operators import products
    monkeypatch.setattr(products, "TASK_CELLS", 40)
    rng = np.random.default_rng(3)
    ids = [None, *[f"n{k}" for k in range(14)]]
    a = [(ids[i], ids[j], float(x)) for i, j, x in zip(rng.integers(0, 15, 150), rng.integers(0, 15, 150), rng.integers(-2, 3, 150))]
    b = [(ids[i], ids[j], float(x)) for i, j, x in zip(rng.integers(0, 15, 90), rng.integers(0, 15, 90), rng.integers(-2, 3, 90))]
    want = {}
    for i, m, x in a:
        for n, j, y in b:
            if m is not None and m == n:
                want[i, j] = want.get((i, j), 0.0) + x * y
    left, right = (spark.createDataFrame(x, "row string, col string, value double") for x in (a, b))
    made = M.matmul(left, right)
    assert {(r.row, r.col): r.value for r in made.collect()} == want and made.count() == len(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan
    assert M.matmul(left.limit(0), right).count() == M.matmul(left, right.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_ways_to_sum_products(dense, monkeypatch):
    """Both ways of a task's product against a dense one, in several groups of rows, with negative values."""
    from vertexloom.operators import products
    monkeypatch.setattr(products, "BUFFER", 60)
    rng = np.random.default_rng(4)
    a, b = (np.where(rng.random((17, 17)) < 0.4, rng.normal(size=(17, 17)), 0.0) for _ in range(2))
    (r, m), (n, c) = np.nonzero(a), np.nonzero(b)
    if dense:
        order = np.argsort(c, kind="stable")
        made = products._whole(r, m, a[r, m], products._starts(c[order], 17), n[order], b[n, c][order], 17, 17, 17)
    else:
        made = products._gathered(r, m, a[r, m], products._starts(n, 17), c, b[n, c], 17, 17)
    place, value = (np.concatenate(x) for x in zip(*made))
    assert sorted(place.tolist()) == np.flatnonzero(((a != 0).astype(int) @ (b != 0).astype(int)).ravel()).tolist()
    assert np.allclose((a @ b).ravel()[place], value)
