"""Toxicity by a weighted finite-state grammar over clauses.

A clause is a sequence of word classes: insult, threat, target, negation, report, other. Three transducers are composed:
negation turns the insults and threats of the next words into negated ones, reported speech turns those after it into
reported ones, and the last remembers the clause's strongest match and whether a target was named. Its final states
are the kinds of matched clauses. A text's score is a logistic function of the logarithms of its clauses' weights by kind and of its number of words:
a word counts through the clause it stands in, and nothing goes round the grammar.

What is learned, from labelled texts: the insult and threat acceptors, word beginnings (or whole words) in the training
texts that toxic ones use in many contexts and others hardly ever, so that other forms of a word match as well; a beginning is a threat when most
of its contexts in toxic texts are words of intent (FRAMES), else an insult. The THREATS weigh what they tell in the sample, and at least LEAST. Then
the weights of the kinds. The word lists of the other classes are fixed. Fitting takes a sample of at most SAMPLE labelled
rows, in expectation, of each label, chosen by a hash of the id; equal texts count once in it. Scores read every whole text.

Null and empty texts have no clauses and get the score of a text without matches. Rows without a label, or with a null
one, aren't learned from. With labels of one kind only, all scores are the share of that kind, smoothed. Each row of the input
gives one row; a table without rows gives none. Columns but the id, the text and the label aren't read, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut
from .buffers import WORD, RangeHash, flat, row_of, slices, words

#: Labelled rows for fitting: toxic, others.
SAMPLE = {1: 6000, 0: 12000}
#: What a word beginning needs: the log odds ratio of its contexts (distinct words before it), the chance of an accident, characters. A shorter word counts as a whole.
MIN_ODDS, CHANCE, SHORTEST = 3.0, 0.02, 3
#: What a word of THREATS weighs at least.
LEAST = 0.5
THRESHOLD = 0.7

# Words of the classes that aren't learned, in English, German, French and Spanish.
TARGETS = "you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch euer sie er tu te toi ton ta vous votre vos il elle ils elles usted ustedes tú ti vosotros él ella ellos ellas".split()
NEGATIONS = "not no never neither nor without don doesn didn isn aren wasn weren won nicht kein keine keinen niemals nie ohne ne pas jamais aucun aucune sans nunca jamás tampoco sin ningún ninguna".split()
REPORTS = "said says say saying told tells wrote writes quoted quotes called calls claimed claims reported reportedly allegedly sagte sagt schrieb nannte behauptet angeblich dit disait écrit appelé selon dijo dice escribió llamó según".split()
FRAMES = "will would gonna shall ll d going should must werde wird werden würde soll muss vais va allons vas ira doit voy va vamos vas debe i ich je yo te vous dich euch".split()
THREATS = "kill kills murder hurt harm destroy beat strangle shoot stab töten umbringen verletzen zerstören schlagen tuer frapper détruire blesser matar golpear destruir herir".split()

CLASSES = "oITNRY"  # other, insult, threat, negation, report, target
KINDS = ["insult", "insult_at", "threat", "threat_at", "negated", "reported"]
_STRENGTH = ["", "t", "i", "U", "J", "T", "I"]
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;:,\n")] = True


class Transducer:
    """Complete and deterministic: step[state, symbol] = (state, output)."""

    def __init__(self, start, step: dict):
        self.start, self.step = start, step

    def __or__(self, other: "Transducer") -> "Transducer":
        """What comes out of this one goes into the other; only states that can be reached."""
        start, step = (self.start, other.start), {}
        symbols = {s for _, s in self.step}
        todo = [start]
        while todo:
            a, b = state = todo.pop()
            for s in symbols:
                if (state, s) not in step:
                    to_a, between = self.step[a, s]
                    to_b, out = other.step[b, between]
                    step[state, s] = (to_a, to_b), out
                    todo.append((to_a, to_b))
        return Transducer(start, step)

    def end(self, symbols: str):
        state = self.start
        for s in symbols:
            state, _ = self.step[state, s]
        return state


def negation(scope: int = 3) -> Transducer:
    """I and T within `scope` words after N come out as i and t."""
    step = {}
    for left in range(scope + 1):
        for s in CLASSES:
            step[left, s] = (scope if s == "N" else max(left - 1, 0), s.lower() if left and s in "IT" else s)
    return Transducer(0, step)


def reported() -> Transducer:
    """Insults and threats after R come out as J and U."""
    step = {}
    for inside in (False, True):
        for s in CLASSES + "it":
            step[inside, s] = (inside or s == "R", {"I": "J", "i": "J", "T": "U", "t": "U"}.get(s, s) if inside else s)
    return Transducer(False, step)


def matched() -> Transducer:
    """Remembers the strongest match and whether a target was named."""
    step = {}
    for best in _STRENGTH:
        for target in (False, True):
            for s in CLASSES + "itJU":
                step[(best, target), s] = (max(best, s if s in _STRENGTH else "", key=_STRENGTH.index), target or s == "Y"), s
    return Transducer(("", False), step)


GRAMMAR = negation() | reported() | matched()


def kind(clause: str) -> str | None:
    """The kind of a clause, given as word classes; None without a match."""
    _, (best, target) = GRAMMAR.end(clause)
    if best in ("I", "T"):
        return ("insult" if best == "I" else "threat") + ("_at" if target else "")
    return {"i": "negated", "t": "negated", "J": "reported", "U": "reported"}.get(best)


def _lowered(column: pa.Array):
    """Bytes of the texts in lower case, row bounds, words."""
    data, bounds = flat(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    return data, bounds, *words(data, bounds, WORD)


class Lexicon:
    """Word classes by hash; insults and threats are beginnings of words, or whole words where they end in '$', with their weights."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        self.by_length: dict[tuple[int, bool], list] = {}
        for code, learned in ((1, insults), (2, threats)):
            for stem, weight in learned.items():
                self._add(stem.rstrip("$"), stem.endswith("$"), code, weight)
        for code, listed in ((3, NEGATIONS), (4, REPORTS), (5, TARGETS)):
            for w in listed:
                self._add(w, True, code, 1.0)

    def _add(self, word: str, whole: bool, code: int, weight: float) -> None:
        self.by_length.setdefault((len(word.encode()), whole), []).append((word.encode(), code, weight))

    def classes(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Class number and weight of each word; an insult goes before the others, and a smaller number before a larger one."""
        code, weight = np.zeros(len(start), np.uint8), np.zeros(len(start))
        hashes = RangeHash(data)
        for (length, whole), listed in sorted(self.by_length.items()):
            at = np.flatnonzero(end - start == length if whole else end - start >= length)
            begin = np.arange(len(listed)) * length
            keys = RangeHash(np.frombuffer(b"".join(w for w, _, _ in listed), np.uint8))(begin, begin + length)
            codes, weights = np.array([c for _, c, _ in listed], np.uint8), np.array([w for _, _, w in listed])
            order = np.lexsort((codes, keys))
            keys, first = np.unique(keys[order], return_index=True)
            codes, weights = codes[order][first], weights[order][first]
            mine = hashes(start[at], start[at] + length)
            found = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            known = keys[found] == mine
            at, found = at[known], found[known]
            better = (code[at] == 0) | (codes[found] < code[at])
            code[at[better]], weight[at[better]] = codes[found[better]], weights[found[better]]
        return code, weight

    def features(self, column: pa.Array) -> np.ndarray:
        """(rows, kinds + 1): log of 1 and the weight of the clauses of each kind, and of 1 and the number of words."""
        data, bounds, start, end, first = _lowered(column)
        out = np.zeros((len(bounds) - 1, len(KINDS) + 1))
        if len(start):
            (code, weight), row = self.classes(data, start, end), row_of(first)
            breaks = np.cumsum(_BREAK[data])[start]
            new = np.ones(len(start), bool)
            new[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
            clause = np.cumsum(new) - 1
            begins = np.append(np.flatnonzero(new), len(start))
            symbols = np.frombuffer(CLASSES.encode(), np.uint8)[code].tobytes().decode()
            for c in np.unique(clause[(code == 1) | (code == 2)]).tolist():
                a, b = begins[c], begins[c + 1]
                found = kind(symbols[a:b])
                of = 2 if found.startswith("threat") or 1 not in code[a:b] else 1
                out[row[a], KINDS.index(found)] += weight[a:b][code[a:b] == of].sum()
        out[:, -1] = np.diff(first)
        return np.log1p(out)


class Model:
    def __init__(self, insults: dict[str, float], threats: dict[str, float], weights: np.ndarray, bias: float):
        self.insults, self.threats, self.weights, self.bias = insults, threats, weights, bias
        self.lexicon = Lexicon(insults, threats)

    def __reduce__(self):
        return Model, (self.insults, self.threats, self.weights, self.bias)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.lexicon.features(column) @ self.weights + self.bias, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): distinct texts of a bounded number of labelled rows. The ids that are broadcast have the bound of SAMPLE."""
    sizes = dict(labels.filter("toxic in (0, 1)").groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for value, most in SAMPLE.items():
        share = F.when(F.col("toxic") == value, F.lit(min(1.0, most / max(1, sizes.get(value, 0))))).otherwise(share)
    chosen = labels.filter("toxic in (0, 1)").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("id", "toxic").distinct()
    return docs.join(F.broadcast(chosen), "id").select("text", "toxic").dropDuplicates()


def _contexts(texts: DataFrame) -> DataFrame:
    """(word, before, toxic): the different words before each word, by label. Near copies of a text add nothing to it."""
    def seen(batches):
        for part in slices(batches, "text"):
            data, bounds, start, end, first = _lowered(part.column("text"))
            raw, toxic, out = data.tobytes(), part.column("toxic").to_pylist(), set()
            for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                mine = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
                out.update(zip(mine, ["", *mine], [toxic[r]] * len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int32()))],
                                             names=["word", "before", "toxic"])

    return texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(seen, "word string, before string, toxic int").distinct()


def _stems(words: DataFrame) -> DataFrame:
    """The rows of each word once for each of its beginnings, and for the whole word, which ends in '$'."""
    size = F.length("word")
    sizes = F.when(size >= SHORTEST, F.sequence(F.lit(SHORTEST), F.greatest(size, F.lit(SHORTEST)))).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.transform(sizes, lambda k: F.substring("word", F.lit(1), k)), F.array(F.concat("word", F.lit("$"))))
    return words.select("*", F.explode(ends).alias("stem"))


def learn_words(texts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(insults, threats): beginnings of words that tell toxic texts, with their log odds; of a chain of beginnings the longest that keeps nearly all contexts.

    A beginning counts when toxic texts have it in at least exp(MIN_ODDS) times their share of all contexts, and so often that
    by chance (a Chernoff bound, for all beginnings together) this would happen with probability CHANCE. It is a threat if it stands after FRAMES more often than not.
    """
    pairs = cut(_contexts(texts), "contexts")
    total = dict(pairs.groupBy("toxic").count().collect())
    seeds = {w + "$": LEAST for w in THREATS}
    if not total.get(1) or not total.get(0):
        return {}, seeds
    counted = pairs.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    stems = cut(_stems(counted).groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "stems")
    share, needed = total[1] / (total[1] + total[0]), math.log(max(1, stems.count()) / CHANCE)
    odds = F.log((F.col("t") + 0.5) / total[1]) - F.log((F.col("c") + 0.5) / total[0])
    mine = F.col("t") / (F.col("t") + F.col("c"))
    surprise = F.col("t") * F.log(mine / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - mine) / (1 - share))).otherwise(0.0)
    likely = stems.filter("t > 0").filter(odds >= MIN_ODDS).filter(surprise >= needed).select("stem", "c")
    # the words of a stem may share their contexts; those of the few likely stems are counted once each
    once = _stems(pairs.filter("toxic = 1")).join(likely, "stem").groupBy("stem").agg(
        F.count_distinct("before").alias("t"), F.first("c").alias("c"), F.count_distinct(F.when(F.col("before").isin(FRAMES), F.col("before"))).alias("framed"))
    # at most (contexts in the sample's toxic texts) / (the least count that is surprising) of each length, and the sample is bounded
    found = {r["stem"]: r for r in once.filter(surprise >= needed).select("stem", "t", "framed", odds.alias("odds")).collect()}
    chosen = {stem: found[stem] for stem in _longest({stem: r["t"] for stem, r in found.items()})}
    told = {r["stem"]: max(LEAST, r["odds"]) for r in stems.filter(F.col("stem").isin(list(seeds))).select("stem", odds.alias("odds")).collect()}
    threats = {stem: r["odds"] for stem, r in chosen.items() if 2 * r["framed"] > r["t"]}
    return {stem: r["odds"] for stem, r in chosen.items() if stem not in threats}, {**seeds, **told, **threats}


def _longest(pure: dict[str, int]) -> list[str]:
    following: dict[str, list[str]] = {}
    for stem in pure:
        following.setdefault(stem[:-1], []).append(stem)
    out = []
    for stem in sorted(s for s in pure if s[:-1] not in pure):
        while longer := [s for s in following.get(stem, ()) if pure[s] >= 0.95 * pure[stem]]:
            stem = max(longer, key=lambda s: (pure[s], s))
        out.append(stem)
    return sorted(set(out))


def _weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method with halved steps."""
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6) * len(y) / 100

    def loss(w):
        z = x1 @ w
        return (np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        slope = x1.T @ (p - y) + penalty * w
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows given; `labels` has id_col and label_col (0 or 1)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = sample(rows, labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")))
    insults, threats = learn_words(texts)
    lexicon = Lexicon(insults, threats)

    def measured(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(lexicon.features(part.column("text")).tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    # one row of a few numbers for each text of the sample, which is bounded
    rows = sorted((r["toxic"], tuple(r["x"])) for r in texts.select("text", "toxic").mapInArrow(measured, "toxic int, x array<double>").collect())
    y = np.array([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(insults, threats, np.zeros(len(KINDS) + 1), float(np.log(share / (1 - share))))
    return Model(insults, threats, *_weights(np.array([r[1] for r in rows]), y))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, score."""
    def score(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(part.column("text")))], names=["id", "score"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return made.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores less than the threshold, all columns."""
    kept = docs.schema

    def keep(batches):
        for part in slices(batches, text_col):
            yield part.filter(pa.array(model.scores(part.column(text_col)) < threshold))

    return docs.mapInArrow(keep, kept)


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
