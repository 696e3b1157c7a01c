"""Pieces, token counts, chat windows and shards."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vertexloom.llm import chat, pieces, sharding, token_counts
from vertexloom.llm.buffers import mix
from vertexloom.llm.queries import sharding_sql, op4

from . import brute

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "   ", "a", " lead and trail  ", "tab\tand\nlines\r\n", "日本語のテキスト", "🎉🎉 party🎉", "\x00\x01", " " * 200, "a" * 3000, "ab" * 90 + " " * 70 + "z",
       "<s> </s> <unk> <0x41>", "naïve café", "don't it's we'll", "x<|endoftext|>y <|endoftext|> z", "  <|endoftext|>", "a \u3000\xa0 b", "a\x1c b\x85c", "word " * 500]
TEXT = st.text(st.one_of(st.sampled_from(" \t\n\xa0\u3000▁'abzÉ漢🎉1.<|"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def rows(ids, first):
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_pieces_without_dropout_are_the_librarys(vocabulary):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert rows(*pieces.Encoder(vocabulary, 0.0, 1).encode(ODD, np.arange(len(ODD)))) == library.encode(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_pieces_decode_without_loss(texts, rate):
    vocabulary = pieces.vocabulary(MODEL)
    ids, first = pieces.Encoder(vocabulary, rate, 3).encode(texts, np.arange(len(texts)))
    assert pieces.decode(vocabulary, ids, first) == texts


def test_dropout_is_that_of_the_agenda(vocabulary):
    texts, keys = ODD + ["literal ▁ mark▁▁ x▁"], np.arange(len(ODD) + 1) * 7
    for rate in (0.1, 0.6):
        encoder = pieces.Encoder(vocabulary, rate, 5)
        got = rows(*encoder.encode(texts, keys))
        for text, key, mine in zip(texts, keys, got):
            parts = pieces.segments(text)
            places = mix(mix(np.array([key], np.int64).view(np.uint64), 5) + np.arange(len(parts), dtype=np.uint64)).tolist()
            assert mine == [i for p, place in zip(parts, places) for i in encoder.pieces(p, place)]
    assert len(got[-2]) > len(pieces.Encoder(vocabulary, 0.0, 5).encode(texts[-2:-1], keys[-2:-1])[0])


def test_dropout_varies_and_repeats(spark):
    docs = spark.createDataFrame([(k, "internationally recognised standards") for k in range(40)] + [(5, None), (None, "internationally recognised standards")], "doc_id bigint, text string")
    coded = docs.withColumn("ids", pieces.encoded("text", "doc_id", MODEL, rate=0.3)).withColumn("back", pieces.decoded("ids", MODEL))
    got = coded.collect()
    assert all(r.back == r.text for r in got) and got[40].ids is None
    assert len({tuple(r.ids) for r in got if r.ids}) > 10
    assert sorted(map(str, got)) == sorted(map(str, coded.repartition(5).collect()))


def test_ids_that_the_model_does_not_have(spark):
    got = spark.sql("select array(-1, 999999, null, 0) as ids union all select array() union all select null").select(pieces.decoded("ids", MODEL).alias("t")).collect()
    assert [r.t for r in got] == ["⁇ " + " ⁇ " * 3, "", None]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_token_counts_of_stretches(texts):
    counter = token_counts.counter(JSON)
    assert counter.safe and counter.count(texts) == counter.batched(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(ODD)]
    else:
        from tokenizers import Tokenizer
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in ODD]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(99, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", token_counts.token_count("text", path).alias("n")).collect()}
    assert got == {**dict(enumerate(want)), 99: 0}


def test_batches_are_balanced():
    sizes = [sum(map(len, b)) for b in token_counts.balanced(["a" * (k % 90) for k in range(5000)] + ["b" * 5000], 1000)]
    assert sum(sizes) == sum(k % 90 for k in range(5000)) + 5000 and sorted(sizes)[-2] <= 1000 and sorted(sizes)[2] > 800


@given(st.text(), st.text())
def test_template_is_reversible(role, text):
    assert chat.read_turns(chat.turn_text(role, text) * 2) == [(role, text)] * 2


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice(["one", "two|", "<|end|>\n", "\\", "|end|\n", "café", "\\p"]) for _ in range(n))
    out = []
    for c in range(30):
        if c % 3 == 0:
            out.append((c, 0, "system", said(5)))
        for t in range(1, rng.choice([2, 5, 40])):
            out.append((c, t, "user" if t % 2 else "assistant", said(rng.choice([0, 3, 60]))))
    out += [(100, t, "system" if t == 0 else "assistant" if t % 2 else "user", said(12)) for t in range(1500)]
    out += [(101, t, "assistant", said(9)) for t in range(700)]
    out += [(102, 1, "user", said(900)), (102, 2, "assistant", said(2000)), (103, None, None, None), (103, 1, "assistant", None), (103, 1, "assistant", None), (None, 1, "assistant", "x")]
    rng.shuffle(out)
    return out


def test_windows(spark, conversations):
    turns = spark.createDataFrame(conversations, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    made = chat.windows(turns, JSON, budget=120, history=40)
    got = {r.conv_id: r[1:6] for r in chat.read_back(made).collect()}
    want = {}
    for c in {x[0] for x in conversations}:
        mine = sorted(((t is not None, t, r or "", x or "") for i, t, r, x in conversations if i == c))
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        want[c] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: g[:4] for c, g in got.items()} == want
    rows = made.collect()
    counter = token_counts.counter(JSON)
    system = {c: x for c, t, r, x in conversations if t == 0 and r == "system"}
    for r in rows:
        said = chat.read_turns(r.formatted)
        assert len(said) == r.n_repeated + r.n_new and r.n_new > 0
        assert r.n_tokens <= 120 or r.n_new == 1
        assert r.conv_id not in system or said[0] == ("system", system[r.conv_id])
        assert len(r.loss) == sum(role == "assistant" for role, _ in said[r.n_repeated:])
        assert r.n_tokens == sum(counter.count([chat.turn_text(*x) for x in said]))
    assert any(r.n_repeated > 2 for r in rows)


def test_windows_without_rows(spark, conversations):
    turns = spark.createDataFrame(conversations[:3], "conv_id bigint, turn bigint, role string, text string").limit(0)
    assert chat.read_back(chat.windows(turns, JSON)).count() == 0


@pytest.mark.parametrize("limit", [1, 300, 5000, 10**9])
def test_shards(spark, limit, tmp_path):
    rng = random.Random(limit)
    docs = [(k, rng.choice(["hot", "hot", f"s{k % 5}", None]), "x" * rng.choice([0, 1, 30, 400])) for k in range(300)] + [(7, "hot", "dup"), (7, "hot", "dup"), (400, None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    placed = sharding.assign(frame, ["source"], limit, apart=["doc_id"])
    known = frame.select("doc_id", "source", F.lpad(F.bin(sharding.address(["source"], ["doc_id"])), 60, "0").alias("a"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    want = brute.shards([(n, r.a, r.n) for n, r in enumerate(known)], limit)
    got = sorted((r.row.doc_id, r.row.source or "", r.n_bytes, r.shard) for r in placed.collect())
    assert got == sorted((r.doc_id, r.source or "", r.n, want[n]) for n, r in enumerate(known))
    for r in placed.select("shard", "depth", "shard_bytes", "shard_rows", "oversized").distinct().collect():
        mine = [g for g in got if g[3] == r.shard]
        assert (sum(g[2] for g in mine), len(mine), len(r.shard)) == (r.shard_bytes, r.shard_rows, r.depth)
        assert r.shard_bytes <= limit or r.oversized
    if limit == 5000:
        sharding.write_shards(frame, str(tmp_path / "out"), ["source"], limit, apart=["doc_id"])
        back = spark.read.parquet(str(tmp_path / "out"))
        assert back.count() == len(docs) and back.select("shard").distinct().count() == len({g[3] for g in got})


def test_shards_without_rows(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string"), ["doc_id"], 10).count() == 0


def test_shards_in_sql(spark):
    """The query's SQL with a limit at which the small tables have many shards."""
    from tests.oracle import compare, connect
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), lambda s, d: op4(s, d, limit=30_000), sharding_sql(30_000), sf) is None


def test_rows_with_pieces(spark):
    """Columns of any name are kept, nulls stay null, a very long text is whole, no rows give none."""
    rows = [(1, None, "t", 5), (2, "", "u", None), (3, "ab cd " * 400_000, None, 7), (3, "twice", "v", 8), (3, "twice", "v", 8), (None, "日本▁x\U0001f600", "w", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, body string, text string, key int")
    got = pieces.with_pieces(docs, MODEL, ["doc_id", "text", "key", "body"], "body").collect()
    assert [(r.doc_id, r.body, r.text, r.key) for r in sorted(got, key=lambda r: r.key or 6)] == [(r[0], r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: r[3] or 6)]
    assert all(r.lossless and (r.ids is None) == (r.body is None) and (r.body != "" or r.ids == []) for r in got)
    want = {r.k: r.ids for r in docs.filter("body = 'twice'").select(F.col("key").alias("k"), pieces.encoded("body", "doc_id", MODEL).alias("ids")).collect()}
    assert [r.ids for r in got if r.key == 8] == [want[8]] * 2
    assert pieces.with_pieces(docs.limit(0), MODEL, ["doc_id"], "body").count() == 0
    with pytest.raises(ValueError):
        pieces.with_pieces(docs.withColumn("ids", F.lit(1)), MODEL, ["ids"], "body")
