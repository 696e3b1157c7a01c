"""Hard negatives, conversation repair and lattice scores against plain versions."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import conversation_repair as C, hard_negatives as H, lattice, lattice_lm as L
from vertexloom.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- hard negatives

def plain_negatives(rows, k=5, m=5, low=80, high=100):
    """rows: (id, label, integer vector)."""
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        score = lambda v: sum(int(x) * int(y) for x, y in zip(va, v))
        ranked = sorted(((-score(v), i, l) for i, l, v in rows if i != a))
        for s, p, _ in [r for r in ranked if r[2] == la][:k]:
            fits = [(i, -t) for t, i, l in ranked if l != la and low * -s <= 100 * -t <= high * -s][:m]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(fits, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, cell int"


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 10))
    rows = [(i, [float(v) for v in centres[i % 6] + 0.4 * rng.normal(size=10)], int(rng.integers(0, 4))) for i in range(n)]
    return [(i, rows[7][1] if i < copies else v, l) for i, v, l in rows]


def floors(rows):
    return [(i, str(l), [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows]


@pytest.mark.parametrize("copies", [0, 300])
def test_negatives_in_rounds(spark, monkeypatch, copies):
    """Small blocks, groups and rounds, so that cells are split and searches go on; a third of the rows are one vector."""
    for name, value in (("BLOCK", 32), ("GROUP", 4), ("FIRST", 40), ("GROWTH", 3), ("SAMPLE", 200)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(900, copies=copies)
    table = spark.createDataFrame([(i, v, l, "x", 0, 0) for i, v, l in rows], SCHEMA)
    got = found(H.mine(H.prepared(table), F.col("id") % 100 == 0))
    assert got == plain_negatives(floors(rows)) and got


def test_asks_leave_a_task_in_slices(spark, monkeypatch):
    """Anchors that ask for every cell go to a bundle once each, and no batch holds more than about SLICE numbers."""
    import pyarrow as pa
    for name, value in (("BLOCK", 4), ("BUNDLE_BITS", 5), ("SLICE", 200), ("SAMPLE", 100)):
        monkeypatch.setattr(H, name, value)
    rows = floors(clustered(600, 3))
    index = H.Index(spark.createDataFrame([(i, l, v) for i, l, v in rows], "id long, label string, x array<long>"))
    blocks = {(r.bundle, r.block) for r in index.rows.collect()}
    wants = pa.array([[{"want": 0, "kth": None}]] * 40, pa.list_(pa.struct([("want", pa.int64()), ("kth", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows[:40]]), pa.array([str(l) for _, l, _ in rows[:40]]), pa.array([v for _, _, v in rows[:40]]), wants, pa.array([0] * 40)],
                                       names=["anchor", "label", "x", "wants", "visited"])
    made = list(H._asking(index.searcher(), 10 ** 9, 0, True)([batch]))
    assert len(made) > 40 and max(sum(len(b or []) + len(x) for b, x in zip(m.column("blocks").to_pylist(), m.column("x").to_pylist())) for m in made) < 400
    asked = [(a, g, b) for m in made for a, g, b in zip(*(m.column(c).to_pylist() for c in ("anchor", "bundle", "blocks")))]
    assert len({(a, g) for a, g, _ in asked}) == len(asked)
    for anchor, _, _ in rows[:40]:
        assert {(g, b) for a, g, bs in asked if a == anchor and g >= 0 for b in bs} >= blocks  # a part of a cell may have no rows


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [1.0, 0.5], 2), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [1.0, None], 2), (8, [1.0, 0.4], None),
            (9, [2.0], 1), (10, [], 2), (None, [1.0, 0.5], 2), (100, [-1.0, 0.1], 1), (200, [3e6, 1e3], 2), (11, [1e4, 0.0], 3)]
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    table = spark.createDataFrame([(i, v, l, "x", 0, 0) for i, v, l in rows], SCHEMA)
    got = found(H.mine(H.prepared(table), F.col("id") % 100 == 0))
    assert got == plain_negatives(floors(good)) and {r[0] for r in got} >= {0}
    empty = H.mine(H.prepared(table.limit(0)), F.col("id") % 100 == 0)
    assert empty.count() == 0
    big = spark.createDataFrame([(0, [1e18], 1), (1, [1e18], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="range of a long"):
        H.mine(H.prepared(big), F.lit(True)).collect()


def test_cells_in_order_of_bounds(spark):
    """Bounds hold for every row of a cell, cells come greatest bound first, and none is left out."""
    rows = floors(clustered(400, 3))
    index = H.Index(spark.createDataFrame([(i, l, v) for i, l, v in rows], "id long, label string, x array<long>"))
    cells = defaultdict(list)
    for r in index.rows.collect():
        cells[r.block >> 32].append(r.x)
    order = list(index.order(np.array(rows[0][2], float)))
    assert [u for u, _, _ in order] == sorted((u for u, _, _ in order), reverse=True) and {c for _, _, c in order} == set(cells)
    for upper, lower, cell in order:
        for x in cells[cell]:
            assert lower <= sum(p * q for p, q in zip(rows[0][2], x)) <= upper


# ---- conversation repair

def plain_repair(roles, must, extra):
    """Least (cost, audit) over all edit sequences."""
    heap, seen = [(0, "", 0, "")], set()
    fits = lambda c, out: (c == "s" and out == "") or (c == "u" and out[-1:] in ("", "s", "a")) or (c == "a" and out[-1:] == "u")
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(roles) and out[-1:] in ("", "a"):
            return cost, audit
        if (i, out) in seen:
            continue
        seen.add((i, out))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if not must[i] and fits(roles[i], out):
                heapq.heappush(heap, (cost + extra[i], audit + "K", i + 1, roles[i]))
            for c in "ua":
                if not must[i] and fits(c, out):
                    heapq.heappush(heap, (cost + 2 + extra[i], audit + "R", i + 1, c))
        for c in "ua":
            if fits(c, out):
                heapq.heappush(heap, (cost + 2, audit + "I", i, c))


def test_alignments_agree():
    r = random.Random(1)
    for _ in range(1500):
        n = r.randrange(0, 9)
        roles = "".join(r.choice("uauasx ") if r.random() < 0.5 else "ua"[j % 2] for j in range(n))
        must = [r.random() < 0.15 for _ in range(n)]
        extra = [0 if m else int(r.random() < 0.3) for m in must]
        want = plain_repair(roles, must, extra)
        assert C.align(roles, must, extra) == want == C.align_states(roles, must, extra), (roles, must, extra)
    roles = "".join("ua"[j % 2] if r.random() < 0.9 else r.choice("uas") for j in range(900))
    must, extra = [r.random() < 0.05 for _ in roles], [0] * 900
    assert C.align(roles, must, extra, cells=1 << 30) == C.align_states(roles, must, extra)


def plain_report(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: the report's other columns}."""
    word = lambda x: " " if x is None else str(x)
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, k = word(role), word(text), zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        told[conv] += [] if k == 0 else [(turn, "user" if k == 4 else role, "" if k == 1 else "".join(c for c in text if k != 2 or c not in ".!?"))] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in told.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            shown = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t[0] for t in turns if t[0] is not None]
        roles = "".join(t[1][:1] or " " for t in turns)
        cost, audit = plain_repair(roles, [f in ("blank", "duplicate") for f in faults], [int(f == "truncated") for f in faults])
        lines, i, last = [], 0, ""
        for edit in audit:
            flipped = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{flipped}:")
                last = flipped[0]
            else:
                if edit != "D":
                    role = turns[i][1] if edit == "K" else flipped
                    lines.append(f"{role}:{turns[i][2]}")
                    last = role[0]
                i += 1
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_report(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_report(got) == plain_report(rows)


def test_repair_of_odd_rows(spark):
    rows = [(1, t, r, x) for t in range(12) for r, x in (("user", "same."), ("user", "same."), ("tool", "é "))] + [
        (None, None, None, None), (None, 3, "user", "a"), (2, None, "assistant", "b!"), (2, None, "user", "\t\n"), (3, 0, "", ""), (3, 9, "system", "x" * 300_000 + "?"), (4, 0, "user", "end ")]
    rows += [(5, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]
    table = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int")
    assert as_report(C.repair_report(C.damaged(table))) == plain_report([r for r in rows])
    assert C.repair_report(C.damaged(table.limit(0))).count() == 0
    dropped = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = spark.createDataFrame([(dropped, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert as_report(C.repair_report(C.damaged(alone))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    turns = C.repaired(C.whole(alone), C.diagnosed(C.whole(alone))).orderBy("place").collect()
    assert [(t.edit, t.role, t.text) for t in turns] in ([("K", "user", "gone"), ("I", "assistant", "")], [])


# ---- lattice scores

def plain_paths(pieces, word: bytes, weight) -> float:
    """Summed probability of all spellings of a word in pieces, one path after another."""
    known = {n: i for i, n in enumerate(pieces.names)}
    text, mark = lattice.SPACE + word, lattice.SPACE

    def rest(at):
        if at == len(text):
            return 1.0
        size = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
        own = text[at:at + size]
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if part in known and (at == 0 or not part.startswith(mark)):
                total += weight[known[part]] * rest(end)
        if own not in known or (at and own == mark):
            spelled = math.prod(weight[len(pieces.names) + b] for b in own)
            total += spelled * rest(at + size)
        return total

    return rest(0)


def test_lattice_against_all_paths():
    pieces = lattice.Pieces(MODEL)
    rng = np.random.default_rng(0)
    weight = rng.random(pieces.size)
    words = [w.encode() for w in ("the", "ofthe", "a", "ñandú", "日本語", "x▁y", "\U0001f600", "zzqx", "\u0001", "running")]
    _, data, first, length = next(L._laid(words))
    start, end, piece = pieces.arcs(data, first)
    _, total = lattice.forward(start, end, np.log(weight)[piece], first, length)
    assert np.allclose(np.exp(total), [plain_paths(pieces, w, weight) for w in words])
    times = rng.random(len(words))
    counts, likelihood = lattice.expected(start, end, piece, np.log(weight)[piece], first, length, times, pieces.size)
    assert np.isclose(likelihood, total @ times)
    for p in rng.choice(np.flatnonzero(counts), 12, replace=False):  # the expected count is the derivative by the log weight
        step = np.log(weight)
        step[p] += 1e-6
        assert np.isclose((lattice.forward(start, end, step[piece], first, length)[1] @ times - likelihood) / 1e-6, counts[p], atol=1e-4)


def plain_tokens(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split() + [L.END]


def check_scores(docs, got, model, pieces, held):
    """Base scores from counts; scores from the model's weights and plain recursions over all paths."""
    c = Counter(w for i, t, _ in docs if not held(i) for w in plain_tokens(t))
    n, v = sum(c.values()), len(c)
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
    by = [Counter() for _ in model.tokens]
    for i, t, lang in docs:
        if not held(i):
            by[model.kept.index(lang) if lang in model.kept else len(model.kept)].update(plain_tokens(t))
    ends, cache = L.end_logs(model), {}
    for i, t, _ in docs:
        r = rows[i].pop()
        words = plain_tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(c[w] > 0 for w in words), n)
        assert np.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rtol=1e-10)
        logs = []
        for k, counts in enumerate(by):
            total = math.log10(max(model.ends[k], 1e-9) / max(model.ends.sum(), 1e-9)) + ends[k]
            for w in words[:-1]:
                if (w, k) not in cache:
                    spelled = plain_paths(pieces, w, np.exp(model.weights[k])) if len(w) <= 12 else math.exp(L._word_logs(model)([w], np.zeros((1, len(by))))[0][k] * math.log(10)) / (
                        model.discount[k] * model.kinds[k] / model.tokens[k] if model.tokens[k] else 1.0)
                    whole = max(counts[w] - model.discount[k], 0.0)
                    cache[w, k] = math.log10((whole + model.discount[k] * model.kinds[k] * spelled) / model.tokens[k] if model.tokens[k] else spelled)
                total += cache[w, k]
            logs.append(total)
        want = max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs))
        assert np.isclose(r.score, want, rtol=1e-8), (i, r.score, want)


@pytest.mark.parametrize("frequent", [1 << 16, 3])
def test_scores_against_plain_ones(spark, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "PART", 200)
    r = random.Random(2)
    words = {"en": "The of and cat sat MAT on".split(), "fr": "le la chat été".split(), None: ["日本", "x▁", "||"]}
    docs = [(i, " ".join(r.choice(words[l]) + r.choice(["", "", ".", "s"]) for _ in range(r.randrange(0, 30))), l) for i in range(60) for l in [r.choice(["en", "en", "fr", None])]]
    docs += [(100, None, "en"), (101, "", "fr"), (102, " \n\t ", None), (103, "cat " * 2000 + "hapax", "en"), (7, docs[7][1], docs[7][2])]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, word string, n int")
    train = ~L.is_held_out()
    model = L.fit(table, train, MODEL)
    got = L.scored(table, model, train).collect()
    assert len(got) == len(docs)
    check_scores(docs, got, model, lattice.Pieces(MODEL), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)


def test_scores_without_training_or_rows(spark):
    table = spark.createDataFrame([(1, "some words", "en"), (2, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.lm_scores(table, F.lit(False), MODEL).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0.0 and -math.inf < got[1].score < got[2].score < 0
    assert L.lm_scores(table.limit(0), F.lit(True), MODEL).count() == 0


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    """Enough text: the model beats the add-one counts of words on texts it hasn't seen, and is little better on those it has."""
    got = QUERIES["op13_lm_scoring"](spark, "/root/testdata/sf0.1").groupBy("held_out").agg(
        (F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base"))
    by = {r.held_out: r for r in got.collect()}
    assert by[True].score > by[True].base
