import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import components, exact_dedup, near_dedup, repeats
from vertexloom.llm.fuse_filter import FuseFilter

from . import brute

WORDS = "the of and to in is it was for on are as with his they at be this from have or by one had not but".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "yz"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, chains of near copies, shared passages, very long and very short texts, nulls and periodic texts."""
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([1, 2, 5, 40, 150])) for _ in range(120)]
    for base in (texts[3], prose(rng, 200), prose(rng, 90)):
        words = base.split()
        for k in range(12):  # a chain: each differs from the one before
            words[(k * 17) % len(words)] = f"new{k}"
            texts.append(" ".join(words))
    passage = prose(rng, 110)
    texts += [prose(rng, 30) + " " + passage[k:] + " " + prose(rng, 30) for k in range(25)]
    texts += [texts[130]] * 7 + [texts[130].replace(" ", " \t\n")] * 3 + [texts[0].upper()]
    texts += [None, "", " \n ", "one", "ONE", "one two", "a" * 1500, "a" * 700, "ab" * 400, "é" * 500, prose(rng, 4000), None, ""]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)


def table(spark, docs, tmp_path, schema="doc_id bigint, text string"):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(spark, corpus, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(frame(spark, corpus), width=width).collect()}
    assert got == brute.near_groups(corpus, width)


@pytest.mark.parametrize("small", [32, 2])
def test_near_groups_where_buckets_hold_strangers(spark, corpus, monkeypatch, small):
    """One row a band puts documents of little similarity into one bucket; all links between groups are found nevertheless."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 20)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(frame(spark, corpus), width=2, bands=30, rows=1).collect()}
    assert got == brute.near_groups(corpus, 2)


def test_near_groups_edge_rows(spark):
    docs = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (2, "a b c"), (2, "x y z"), (9, "x y z"), (5, None), (6, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_dedup.near_groups(frame(spark, docs), width=2).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (2, 2, True), (4, 2, False), (5, 5, True), (6, 6, True), (9, 2, False)]
    assert near_dedup.near_groups(frame(spark, []), width=2).count() == 0


def test_superminhash_agrees_with_similarity():
    rng = np.random.default_rng(1)
    union = rng.integers(0, 2**62, 1000).astype(np.uint64)
    a, b = union[:900], union[100:]
    got = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, 900, 1800]), 1000)
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.05


def test_components(spark):
    links = [(1, 2), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5), (6, 6), *((100, x) for x in range(101, 140)), *((x, x + 1) for x in range(200, 260))]
    got = {r.b: r.a for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 7, 8: 7, **{x: 100 for x in range(101, 140)}, **{x: 200 for x in range(201, 261)}}


def test_exact_groups(spark, corpus, tmp_path):
    docs = corpus + [(3, corpus[3][1]), (None, "one"), (None, "lone")]
    rows = exact_dedup.exact_groups(table(spark, docs, tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows))) == sorted(map(str, brute.exact_groups(docs)))
    assert sum(r.kept for r in rows) == len({h for *_, h in brute.exact_groups(docs)})
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_equal_digests_of_different_texts(spark, corpus, tmp_path):
    """With a digest of one byte nearly all texts collide; the byte checks part them again."""
    docs = table(spark, corpus, tmp_path)
    rows = exact_dedup.classify(docs, digest=lambda t: F.substring(exact_dedup.sha256(t), 1, 1)).collect()
    assert {(r.id, r["first"]["id"], r.n) for r in rows} == {(i, k, n) for i, k, n, _ in brute.exact_groups(corpus)}


def test_one_row_of_each_text_stays(spark, corpus, tmp_path):
    docs = [(i, t, "x") for i, t in corpus + corpus[:20]]
    kept = exact_dedup.drop_copies(table(spark, docs, tmp_path, "doc_id bigint, text string, tag string"))
    assert kept.columns == ["doc_id", "text", "tag"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in brute.exact_groups(corpus)})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = FuseFilter.build(np.concatenate([keys, keys[:5]]))
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 2**63, 100_000).astype(np.uint64)).mean() < 0.001
    assert n < 1000 or f.cells.nbytes * 8 < 24 * n


@pytest.mark.parametrize("many", [2000, 3])
def test_repeats(spark, corpus, tmp_path, monkeypatch, many):
    """With a limit of 3 spans, the digits of the larger groups take the way for hot ones."""
    monkeypatch.setattr(repeats, "LOCAL_SPANS", many)
    got = {r.doc_id: (r.n_bytes, len(r.removed) // 2, bytes(r.kept)) for r in repeats.remove_repeats(table(spark, corpus, tmp_path), width=200).collect()}
    assert got == {i: want for (i, _), want in zip(corpus, brute.remove_repeats([t for _, t in corpus], 200))}


def test_repeats_without_rows_or_ids(spark, tmp_path):
    assert repeats.remove_repeats(frame(spark, []), width=200).count() == 0
    docs = [(None, "x" * 150 + "y" * 150), (None, "x" * 150 + "y" * 150), (None, None)]
    assert sorted((r.n_bytes, len(r.kept)) for r in repeats.remove_repeats(table(spark, docs, tmp_path), width=200).collect()) == [(0, 0), (300, 0), (300, 0)]


def plain_sharers(texts, passage):
    """Numbers of the texts with a run of words that another text has."""
    seen, runs = {}, []
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        runs.append({b" ".join(w[k:k + passage]) for k in range(len(w) - passage + 1)})
        for r in runs[-1]:
            seen.setdefault(r, set()).add(i)
    return {i for i, mine in enumerate(runs) if any(len(seen[r]) > 1 for r in mine)}


@pytest.mark.parametrize("many", [repeats.LOCAL_SPANS, 3])
def test_shared_passages(spark, tmp_path, monkeypatch, many):
    """Short words, so that passages are far below the bytes of a removed string; repeats within one text don't count, one word less doesn't either."""
    monkeypatch.setattr(repeats, "LOCAL_SPANS", many)
    rng = random.Random(8)
    words = ["a", "b", "cc", "é", "日", "de"]
    said = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    common, short = said(51), said(50)
    texts = [said(rng.randrange(0, 150)) for _ in range(60)]
    for i in range(0, 30, 3):
        texts[i] = f"{texts[i]} {common}\t\n{said(rng.randrange(3))}"
        texts[i + 1] = f"{said(5)} {short} x{i} {said(60)}"
    lines = said(60)
    texts += [f"{lines} {lines} {lines}", None, "", said(3), "w " * 40, "v " * 51, "v  " * 60, "y " * 300_000, "z " * 400_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "t"))
    got = repeats.remove_repeats(spark.read.parquet(str(tmp_path / "t"))).filter("shares_passage").collect()
    assert {r.doc_id for r in got} == plain_sharers(texts, 51)
