import random

import pytest

from vertexloom.llm import decontaminate

from . import brute


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["É", "été", "Straße", "THE", "the"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 9, 10, 11, 40])) if k > 3 or True)) for k in range(12)]
    items = [(k, t if len(t.split()) > 1 else "solo" + str(k)) for k, t in items] + [(3, "again w1 w2 w3 w4"), (None, "nameless one two three"), (50, ""), (51, None), (52, "!?"), (7, items[2][1])]
    docs = []
    for k in range(150):
        t = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 300]))]
        if k % 4 == 0:
            item = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(t) + 1)
            t[a:a] = item if k % 8 else item[:6]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(t)))
    return docs + [(3, docs[3][1]), (None, items[0][1]), (200, None), (201, "the " * 5000 + items[4][1].upper())], items


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"))


def key(row):
    return [str(x) for x in row]


@pytest.mark.parametrize("width", [10, 3])
def test_contamination(spark, tables, width):
    docs, items = frames(spark, *tables)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, items, width).collect()), key=key)
    assert got == sorted(brute.contamination(*tables, width), key=key)


def test_several_blocks_of_phrases(spark, tables):
    docs, items = frames(spark, *tables)
    index = decontaminate.build_index(docs)
    wanted = decontaminate.phrases(items, 10)
    one, many = (decontaminate.search(index, wanted, block_phrases=n).select("id", "n_words", "ranges", "items").collect() for n in (10**6, 40))
    assert sorted(one, key=key) == sorted(many, key=key)


def test_proximity(spark):
    docs, items = frames(spark, [(1, "a x b c"), (2, "a b c"), (3, "a x y b c"), (4, "b a c d e f"), (5, "c")], [(1, "a b c")])
    index = decontaminate.build_index(docs)
    found = {s: {r.id for r in decontaminate.search(index, decontaminate.phrases(items, 3), slop=s).filter("size(items) > 0").collect()} for s in (0, 1, 2)}
    assert found == {0: {2}, 1: {1, 2}, 2: {1, 2, 3, 4}}


def test_no_rows(spark, tables):
    docs, items = frames(spark, *tables)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_drop_contaminated(spark, tables):
    docs, items = frames(spark, *tables)
    clean = sorted(str(i) for i, _, hit, _ in brute.contamination(*tables, 10) if not hit)
    from pyspark.sql import functions as F
    kept = decontaminate.drop_contaminated(docs.withColumn("_key", F.lit(1)).withColumn("items", F.lit("x")), items)
    assert kept.columns == ["doc_id", "text", "_key", "items"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean
