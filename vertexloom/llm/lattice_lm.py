"""Language-model scores from subword lattices: the marginal probability of a text over all its segmentations.

The units are the pieces of an existing vocabulary. A word's lattice holds every way to spell it in pieces; the forward recursion sums their
probabilities in logarithms (see lattice). The vocabulary file is a byte-pair one and has ranks as scores, so the pieces start with weights
1 / rank, and ROUNDS rounds of expectation-maximisation over the counts of all training words turn these into probabilities. A word seen in
training is one more arc from the start to the end of its lattice, with its discounted count as weight; the mass that the discount frees goes
to the pieces. Training texts of one language make one such model each (at most CLASSES - 1 of the commonest, the rest together), and a text's
probability is the sum over the models, each weighted by its share of texts: the language of the text that is scored is not read.

Words are counted and scored once for each different word, in a table that is spread over the cluster. Of these, the FREQUENT words with most
training tokens go to every task; the other tokens of the texts are joined with the table. So no frequent word is a key of a join.

Defined cases: a null text is empty and an empty one is its end alone; without training texts the pieces have their first weights and the end
that of the rarest piece; a null language is a class like others; repeated rows get a row each; columns but id, text and language are not read.
"""

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut
from .buffers import as_binary, slices
from .lattice import SPACE, Pieces, expected, forward

ROUNDS = 2
CLASSES = 12
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
#: Bytes of text whose words are handled at once, bytes of different words whose lattices are, and different words of a task before its counts move on.
PART, LATTICE_BYTES, HELD = 1 << 20, 1 << 17, 200_000
SMOOTH = 0.01
END = b"\n"  # no word
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile(rb"[ \t\n\v\f\r]")
_loaded: dict = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Pieces(path)
    return _loaded[path]


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2 if isinstance(doc_id, str) else doc_id


def _parts(text: bytes):
    """A text in parts of about PART bytes that end between words."""
    start = 0
    while len(text) - start > PART:
        stop = _BREAK.search(text, start + PART)
        if stop is None:
            break
        yield text[start:stop.start()]
        start = stop.start()
    yield text[start:] if start else text


def _count(batches, path_free=None):
    """(word, class, n) from (text, class, train); words of texts that aren't trained on count 0."""
    held, size = {}, 0

    def rows():
        for cls, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(np.full(len(counts), cls, np.int32)), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "class", "n"])

    for batch in slices(batches, "text", PART):
        for text, cls, train in zip(as_binary(batch.column("text")).to_pylist(), batch.column("class").to_pylist(), batch.column("train").to_pylist()):
            for part in _parts(text.translate(_LOWER)):
                if train:
                    held.setdefault(cls, Counter()).update(part.split())
                else:
                    held.setdefault(-1, Counter()).update(dict.fromkeys(part.split(), 0))
        size = sum(map(len, held.values()))
        if size > HELD:
            yield from rows()
            held = {}
    yield from rows()


class Model:
    """What scoring needs: path of the vocabulary, log weights of the pieces by class, totals by class and over all."""

    def __init__(self, path: str, kept: list, words: DataFrame, totals: dict):
        self.path, self.kept, self.words = path, kept, words
        self.__dict__.update(totals)
        self.weights = None


def _class_of(kept: list, column: str) -> Column:
    out = F.lit(len(kept))
    for i, name in enumerate(kept):
        out = F.when(F.col(column).eqNullSafe(F.lit(name)), F.lit(i)).otherwise(out)
    return out.cast("int")


def fit(docs: DataFrame, train: Column, path: str, text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows where `train` is true; the words of the other rows get their place in the table with a count of 0."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.coalesce(train, F.lit(False)).alias("train"))
    sizes = rows.groupBy("lang").agg(F.sum(F.col("train").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"))
    common = sizes.orderBy(F.desc("n"), F.col("lang").asc_nulls_first()).limit(CLASSES - 1).collect()
    kept = [r.lang for r in common if r.n]
    all_docs = rows.agg(F.sum(F.col("train").cast("long"))).first()[0] or 0
    texts = [r.n for r in common if r.n]
    if sum(texts) < all_docs or not texts:
        texts.append(all_docs - sum(texts))
    k = len(texts)
    counted = rows.select("text", _class_of(kept, "lang").alias("class"), "train").mapInArrow(_count, "word string, class int, n long")
    words = cut(counted.groupBy("word").agg(F.array(*[F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)) for i in range(k)]).alias("counts")), "words")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    by_class = [f(F.col("counts")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (
        ("n", F.sum), ("v", lambda c: F.sum((c > 0).cast("long"))), ("one", lambda c: F.sum((c == 1).cast("long"))), ("two", lambda c: F.sum((c == 2).cast("long"))))]
    sums = {n: x or 0 for n, x in words.agg(*by_class, F.sum((total > 0).cast("long")).alias("known")).first().asDict().items()}
    ends = np.array(texts, float)
    tokens = np.array([sums[f"n{i}"] for i in range(k)], float) + ends
    kinds = np.array([sums[f"v{i}"] for i in range(k)], float) + (ends > 0)
    once, twice = (np.array([sums[f"{n}{i}"] for i in range(k)], float) for n in ("one", "two"))
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1.0), 0.5), 0.1, 0.9)
    model = Model(path, kept, words, {"tokens": tokens, "kinds": kinds, "discount": discount, "ends": ends, "n_train": int(tokens.sum()), "n_kinds": int(sums["known"]) + (all_docs > 0)})
    model.weights = _trained(model)
    return model


def _laid(words: list[bytes]):
    """Runs of words as one buffer with a space mark before each: (which, data, first, length)."""
    start = 0
    while start < len(words):
        stop, size = start, 0
        while stop < len(words) and (size < LATTICE_BYTES or stop == start):
            size, stop = size + len(words[stop]) + len(SPACE), stop + 1
        length = np.array([len(w) + len(SPACE) for w in words[start:stop]], np.int64)
        yield slice(start, stop), np.frombuffer(b"".join(x for w in words[start:stop] for x in (SPACE, w)), np.uint8), np.cumsum(length) - length, length
        start = stop


def _matrix(column: pa.ListArray, k: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), k)


def _trained(model: Model) -> np.ndarray:
    """Log weights (classes, pieces): the expected counts of the round before, and the end beside them."""
    pieces, k = _pieces(model.path), len(model.tokens)
    weights = np.tile(-np.log(np.arange(1.0, pieces.size + 1)), (k, 1))
    weights -= np.log(np.exp(weights).sum(1, keepdims=True))
    for _ in range(ROUNDS):
        found = model.words.filter(F.exists("counts", lambda c: c > 0)).mapInArrow(_expecting(model.path, weights), "class int, piece int, n double")
        got = found.groupBy("class", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full((k, pieces.size), SMOOTH)
        np.add.at(counts, (got.column("class").to_numpy(), got.column("piece").to_numpy()), got.column("n").to_numpy())
        if got.num_rows:
            weights = np.log(counts / (counts.sum(1) + model.ends)[:, None])
    return weights


def _expecting(path: str, weights: np.ndarray):
    k, size = weights.shape

    def run(batches):
        pieces, sums = _pieces(path), np.zeros(k * size)
        for batch in batches:
            words, counts = as_binary(batch.column("word")).to_pylist(), _matrix(batch.column("counts"), k)
            for which, data, first, length in _laid(words):
                start, end, piece = pieces.arcs(data, first)
                word, times = np.searchsorted(first, start, "right") - 1, counts[which]
                for c in np.flatnonzero(times.any(0)):
                    used = times[:, c] > 0
                    mine = used[word]
                    sums[c * size:(c + 1) * size] += expected(start[mine], end[mine], piece[mine], weights[c][piece[mine]], first[used], length[used], times[used, c].astype(float), size)[0]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(sums[at])], names=["class", "piece", "n"])

    return run


def _word_logs(model: Model):
    """log10 probability by class of the words of a batch."""
    path, weights, tokens, kinds, discount = model.path, model.weights, model.tokens, model.kinds, model.discount
    k = len(tokens)

    def logs(words: list[bytes], counts: np.ndarray) -> np.ndarray:
        pieces, spelled = _pieces(path), np.zeros((len(words), k))
        for which, data, first, length in _laid(words):
            start, end, piece = pieces.arcs(data, first)
            for c in range(k):
                spelled[which, c] = forward(start, end, weights[c][piece], first, length)[1]
        return blend(spelled, counts, tokens, kinds, discount)

    return logs


def blend(spelled: np.ndarray, counts: np.ndarray, tokens, kinds, discount) -> np.ndarray:
    """log10 of the whole word's arc and its spellings together: (words, classes)."""
    with np.errstate(divide="ignore"):
        n = np.maximum(tokens, 1.0)
        whole = np.log(np.maximum(counts - discount, 0.0) / n)
        share = np.where(tokens > 0, np.log(np.maximum(discount * kinds, 1e-300) / n), 0.0)
    return np.logaddexp(whole, share + spelled) / math.log(10.0)


def end_logs(model: Model) -> np.ndarray:
    """log10 probability of the end of a text by class: the pieces' own end against the pieces that open a word."""
    opens = np.array([n.startswith(SPACE) for n in _pieces(model.path).names] + [False] * 256)
    first = np.exp(model.weights[:, opens]).sum(1)
    end = np.maximum(1.0 - np.exp(model.weights).sum(1), np.exp(model.weights.min(1)))
    return blend(np.log(end / (first + end))[None, :], model.ends[None, :], model.tokens, model.kinds, model.discount)[0]


def _known_words(model: Model) -> DataFrame:
    """(word, n, logs) of every different word of the texts."""
    logs, k = _word_logs(model), len(model.tokens)

    def run(batches):
        for batch in batches:
            counts = _matrix(batch.column("counts"), k)
            made = logs(as_binary(batch.column("word")).to_pylist(), counts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * k), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(counts.sum(1)), lists], names=["word", "n", "logs"])

    return cut(model.words.mapInArrow(run, "word string, n long, logs array<double>"), "scored-words")


def _usual(words: DataFrame) -> DataFrame:
    """The words with n training tokens or more, for the least n (a power of 2 ** (1 / 8)) that leaves at most FREQUENT of them: no sort is needed."""
    words = words.filter((F.col("n") > 0) & (F.octet_length("word") <= FREQUENT_BYTES))
    step = F.floor(8 * F.log2("n")).cast("long")
    bars, total = [], 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # some 300 rows at most
        total += r["count"]
        if total > FREQUENT:
            break
        bars.append(r.step)
    return words.filter(step >= bars[-1]) if bars else words.limit(0)


def _reading(frequent, k: int, base_of):
    """A task's texts: what their frequent words add, and the other words with their numbers."""
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        names, n, logs = frequent.value
        place = dict(zip(names, range(len(names))))
        base, tag = base_of(n), (task.partitionId() if task else 0) << 33
        logs = np.vstack([logs, np.zeros((1, k))])
        base, known = np.append(base, 0.0), np.append(n > 0, False)
        for batch in slices(batches, "text", PART):
            tokens, sums, bases, hits, rare, numbers, first = [], [], [], [], [], [], [0]
            for text in as_binary(batch.column("text")).to_pylist():
                total, row, row_base, row_hit, rest = 0, np.zeros(k), 0.0, 0, Counter()
                for part in _parts(text.translate(_LOWER)):
                    words = part.split()
                    at = np.fromiter(map(place.get, words, repeat(len(names))), np.int64, len(words))
                    total, row, row_base, row_hit = total + len(words), row + logs[at].sum(0), row_base + base[at].sum(), row_hit + int(known[at].sum())
                    rest.update(words[i] for i in np.flatnonzero(at == len(names)).tolist())
                tokens.append(total)
                sums.append(row)
                bases.append(row_base)
                hits.append(row_hit)
                rare += rest.keys()
                numbers += rest.values()
                first.append(len(rare))
            rows, offsets = batch.num_rows, pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(tag + np.arange(rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(bases, pa.float64()),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(np.concatenate(sums))),
                pa.ListArray.from_arrays(offsets, pa.array(rare, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int64()))],
                names=["tag", "doc_id", "held_out", "tokens", "hits", "base", "sums", "rare", "numbers"])
            tag += rows

    return run


def scored(docs: DataFrame, model: Model, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): scores are log10 of probabilities."""
    k, divisor = len(model.tokens), float(model.n_train + model.n_kinds + 1)
    words = _known_words(model)
    usual = _usual(words).toArrow().combine_chunks()
    names = as_binary(usual.column("word")).to_pylist()
    frequent = docs.sparkSession.sparkContext.broadcast((names, usual.column("n").to_numpy(), _matrix(usual.column("logs"), k) if names else np.zeros((0, k))))
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(~train, F.lit(True)).alias("held_out"), F.col(text).alias("text")).mapInArrow(
        _reading(frequent, k, lambda n: np.log10((n + 1.0) / divisor)),
        f"tag long, doc_id {kind}, held_out boolean, tokens long, hits long, base double, sums array<double>, rare array<string>, numbers array<long>")
    read = cut(read, "read")
    rare = read.select("tag", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("numbers").alias("times"))).alias("x")).select("tag", "x.word", "x.times")
    met = rare.join(words, "word")
    more = met.groupBy("tag").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_hits"),
                                  F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(divisor))).alias("_base"),
                                  F.array(*[F.sum(F.col("times") * F.col("logs")[i]) for i in range(k)]).alias("_sums"))
    all_of = read.drop("rare", "numbers").join(more, "tag", "left")
    ends, prior = end_logs(model), np.log10(np.maximum(model.ends, 1e-9) / max(model.ends.sum(), 1e-9))
    by_class = F.array(*[F.lit(float(prior[i] + ends[i])) + F.col("sums")[i] + F.coalesce(F.col("_sums")[i], F.lit(0.0)) for i in range(k)])
    all_docs = int(model.ends.sum())
    return all_of.select(
        "doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("hits") + F.coalesce("_hits", F.lit(0)) + (1 if all_docs else 0)).alias("n_known"),
        F.lit(model.n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0)) + math.log10((all_docs + 1) / divisor)).alias("base_score"),
        by_class.alias("_by")).withColumn("_top", F.array_max("_by")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        (F.col("_top") + F.log10(F.aggregate("_by", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("_top"))))).alias("score"))


def lm_scores(docs: DataFrame, train: Column, path: str) -> DataFrame:
    return scored(docs, fit(docs, train, path), train)
