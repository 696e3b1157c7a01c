"""Benchmark decontamination with a positional inverted index of the training texts.

The index is a table of segments, one for each few MB of whole texts: the words' hashes in order, the
places of each word in the segment (byte planes of the gaps, which compress well), and where each text
begins. A search takes the test phrases in blocks of bounded size and reads the segments once for each
block; a segment starts from the rarest word of a phrase, moves its places by the word's offset in the
phrase and keeps those at which the next rarest words stand as well. Phrases with a word that the
segment doesn't have cost one lookup. Nothing is shuffled but, with several blocks, the texts that were hit.

Words: A-Z in lower case, then runs of digits, a-z and characters beyond ASCII. Words are compared by
64-bit hashes, a phrase by all its words' hashes.

Empty cases: null and empty texts have no words and no hits; an item without words has no phrase; an item
without an id is listed as ''; items that share an id are one item; rows of texts are never merged, so
repeated rows and null ids give a row each; a table without rows gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.lineage import cut
from .buffers import WORD, RangeHash, flat, lower, row_of, runs, slices, words

SEGMENT_BYTES = 1 << 20
#: Phrases that one search pass sends to the executors; more are searched in several passes.
BLOCK_PHRASES = 200_000


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and the number of each row's first word."""
    data, bounds = flat(column)
    data = lower(data)
    start, end, first = words(data, bounds, WORD)
    return RangeHash(data)(start, end), first


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of all texts: ids, first (place of each text's first word, and the end), terms, counts, gaps."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("first", T.ArrayType(T.IntegerType())),
                           T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("gaps", T.BinaryType())])

    def index(batches):
        for part in slices(batches, "text", SEGMENT_BYTES):
            hashes, first = _tokens(part.column("text"))
            order = np.argsort(hashes, kind="stable")
            terms, starts, counts = np.unique(hashes[order], return_index=True, return_counts=True)
            gaps = np.diff(order, prepend=0)
            gaps[starts] = order[starts]  # a word's first place is told from the segment's start
            ids = part.column("id")
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([first.tolist()], pa.list_(pa.int32())),
                pa.array([terms.tobytes()], pa.binary()), pa.array([_planes(counts)], pa.binary()), pa.array([_planes(gaps)], pa.binary())],
                names=["ids", "first", "terms", "counts", "gaps"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(index, schema)


def phrases(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): every run of `width` consecutive words of an item, or all words of a shorter one."""
    def cut_up(batches):
        for part in slices(batches, "text"):
            hashes, first = _tokens(part.column("text"))
            names, rows, out = part.column("item").to_pylist(), [], []
            for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
                for s in range(a, max(a + (b > a), b - width + 1)):
                    rows.append(names[r])
                    out.append(hashes[s : min(s + width, b)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(out, pa.list_(pa.int64()))], names=["item", "words"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(cut_up, "item string, words array<bigint>").distinct()


class _Block:
    """Phrases as numbers of words of their own vocabulary; sent to the tasks as it is."""

    def __init__(self, rows):
        by_words: dict = {}
        for item, terms in rows:
            by_words.setdefault(tuple(terms), set()).add(item)
        self.lengths = np.array([len(w) for w in by_words], np.int64)
        self.items = [sorted(x) for x in by_words.values()]
        every = np.array([t for w in by_words for t in w], np.int64).view(np.uint64)
        self.vocabulary, numbers = np.unique(every, return_inverse=True)
        self.numbers = np.zeros((len(by_words), max(self.lengths, default=0)), np.int64)
        self.numbers[row_of(np.concatenate([[0], np.cumsum(self.lengths)])), runs(self.lengths)] = numbers

    def find(self, terms, counts, places, first, slop):
        """(phrase, low, end) of every occurrence: the places of its first word and after its last."""
        starts = np.concatenate([[0], np.cumsum(counts)])
        if not len(self.vocabulary) or not len(terms):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        known = terms[at] == self.vocabulary
        here = np.where(known, counts[at], 0)
        used = np.arange(self.numbers.shape[1]) < self.lengths[:, None]
        often = np.where(used, here[self.numbers], np.iinfo(np.int64).max)
        alive = np.flatnonzero(often.min(1) > 0)
        order = np.argsort(often[alive], 1, kind="stable")
        rarest = at[self.numbers[alive, order[:, 0]]]
        phrase = np.repeat(alive, counts[rarest])
        rank = np.repeat(order, counts[rarest], 0)
        start = places[np.repeat(starts[rarest], counts[rarest]) + runs(counts[rarest])] - rank[:, 0]
        keys = (np.repeat(np.arange(len(terms)), counts) << 32) | places  # in order, as places are within a word
        row = np.searchsorted(first, start + rank[:, 0], "right") - 1
        low = start + rank[:, 0]
        high = low
        for k in range(1, self.numbers.shape[1]):
            need = self.lengths[phrase] > k
            place = start + rank[:, k]
            term = at[self.numbers[phrase, rank[:, k]]] << 32
            want = term | np.maximum(place - slop, first[row])
            found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)]
            ok = ~need | ((found >= want) & (found <= (term | np.minimum(place + slop, first[row + 1] - 1))))
            there = np.where(need, found - term, low)
            low, high = np.minimum(low, there), np.maximum(high, there)
            phrase, start, rank, row, low, high = phrase[ok], start[ok], rank[ok], row[ok], low[ok], high[ok]
        return phrase, low, high + 1


def _search(index: DataFrame, block: _Block, slop: int, all_rows: bool) -> DataFrame:
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("ranges", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[r].as_py(), np.uint64)
                counts, gaps = _values(batch.column("counts")[r].as_py()), _values(batch.column("gaps")[r].as_py())
                ends = np.cumsum(counts)
                total = np.concatenate([[0], np.cumsum(gaps)])
                places = total[1:] - np.repeat(total[ends - counts], counts)
                first = batch.column("first")[r].values.to_numpy().astype(np.int64)
                phrase, start, end = block.find(terms, counts, places, first, slop)
                row = np.searchsorted(first, start, "right") - 1
                order = np.lexsort((start, row))
                ranges: dict[int, list[int]] = {}
                items: dict[int, set[str]] = {}
                for p, s, e, d in zip(phrase[order].tolist(), start[order].tolist(), end[order].tolist(), row[order].tolist()):
                    mine, a, b = ranges.setdefault(d, []), s - int(first[d]), e - int(first[d])
                    if mine and a <= mine[-1]:
                        mine[-1] = max(mine[-1], b)
                    else:
                        mine += [a, b]
                    items.setdefault(d, set()).update(block.items[p])
                rows = range(len(first) - 1) if all_rows else sorted(ranges)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("segment")[r].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int32()),
                    batch.column("ids")[r].values.take(pa.array(rows, pa.int64())), pa.array([int(first[d + 1] - first[d]) for d in rows], pa.int64()),
                    pa.array([ranges.get(d, []) for d in rows], pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string()))],
                    names=["segment", "row", "id", "n_words", "ranges", "items"])

    return index.withColumn("segment", F.monotonically_increasing_id()).mapInArrow(search, schema)


def search(index: DataFrame, wanted: DataFrame, slop: int = 0, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """One row for each indexed text: segment, row, id, n_words, ranges (begin, end, begin, end .. of words that
    are hit, merged and in order) and items (the names of items with a phrase in the text, in order).

    `wanted` has the phrases. With slop 0 they have to stand word for word; with more, each word may stand up to
    `slop` places from where it should, counted from the phrase's rarest word in the segment, and a hit is the
    stretch from the first to the last of the words found. Phrases are read `block_phrases` at a time.
    """
    wanted = cut(wanted, "phrases")
    blocks = max(1, -(-wanted.count() // block_phrases))
    parts = []
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        parts.append(_search(index, _Block(rows), slop, b == 0))
    if blocks == 1:
        return parts[0]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)

    @F.udf("array<int>")
    def merged(lists):
        out: list[int] = []
        for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return union.groupBy("segment", "row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), merged(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def n_hit(ranges):
    """Number of words in merged ranges: the ends less the begins."""
    return F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", slop: int = 0) -> DataFrame:
    """One row for each text: id_col, n_words, n_hit, n_items, items (names in order), contaminated."""
    index = cut(build_index(docs, id_col, text_col), "index")
    found = search(index, phrases(items, width, item_col, item_text), slop)
    return found.select(F.col("id").alias(id_col), "n_words", n_hit("ranges").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        "items", (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has no phrase of an item. Rows without an id, which cannot be
    told apart by it, go by their text."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), key.alias("_key"))
    hit = contamination(docs.select(key.alias("_key"), F.col(text_col).alias("text")), items, width, "_key", "text", item_col, item_text)
    dirty = cut(hit.filter("contaminated").select("_key").distinct(), "dirty")
    return keyed.join(dirty, "_key", "left_anti").select("_all.*")
