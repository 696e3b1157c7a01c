"""Hard negatives from an inverted multi-index.

Each half of the vectors has a codebook, fitted on a sample of at most SAMPLE rows; a row's cell is its pair of nearest codewords, and every row is
in the index. A codeword's radius is the greatest distance of a half from it, over all rows. For an anchor with halves a1, a2 no row of
cell (i, j) scores more than (a1.c_i + |a1| r_i) + (a2.c_j + |a2| r_j): a sum of two half scores. A heap visits the cells by this sum,
greatest first, as in a multi-sequence merge of the two sorted lists of half scores. A search goes on until what it found is certain: the last of
the first k rows scores more than the bound of the next cell, or the next bound lies under the window. So results are exact; the codebooks only
decide how many cells are visited. In rounds, an anchor asks for the next cells, FIRST rows in the first round and GROWTH times as many in each later one.

First each anchor's positives are searched (first k of the same label), then for each of their scores p the first k rows of other labels with
low * p <= 100 * score <= high * p. Cells whose lower bound lies above the greatest p are skipped.

Cells are kept in blocks of at most about BLOCK rows, blocks in bundles (BUNDLE_BITS), and anchors in groups of about GROUP; a task meets one bundle with the
anchors of one group that ask for blocks of it. An anchor goes to a bundle once, with the numbers of the blocks that it asks for: not once for each block, which may
have a few rows only. A cell of very many equal vectors is so many blocks, and each hands on k rows for an anchor at most.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; of vectors of different length, missing components are 0; an id is
a key (a row with the anchor's id is never its partner); components and scores (an anchor's with itself included) that leave the range of a long raise an error; equal scores go by the smaller id; anchors
without a positive or a row in a window give no rows, an empty table gives none; columns but id, label and vector are not read.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut, discard

SAMPLE, CODEWORDS, STEPS = 20_000, 256, 8
BLOCK, GROUP = 512, 2048
BUNDLE_BITS = 13  # a bundle has about 2 ** 13 rows, and in small tables fewer: 64 bundles are made until they have 2 ** 9
ANCHORS, SLICE = 64, 65_536  # anchors read at once, and blocks asked for that leave a task in one batch, about
FIRST, GROWTH = 2048, 8
POSITIVES, NEGATIVES = 5, 5
_SLACK = 1e-9
_EXACT = 2.0 ** 53


def prepared(rows: DataFrame, label: Column | str = "label", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, label, x): the rows that take part, with x = floor(256 * component)."""
    label = F.col(label) if isinstance(label, str) else label
    v = F.col(vector).cast("array<double>")
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fits)
    return kept.select("id", "label", F.transform("v", lambda x: F.floor(
        F.when(F.abs(x) < 2.0 ** 54, x * 256.0).otherwise(F.raise_error(F.lit("a component leaves the range of a long")).cast("double")))).alias("x"))


def _padded(column, width: int) -> np.ndarray:
    """Rows of integers as a matrix of `width` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs of rows: in doubles where these are exact, else in Python's numbers."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < _EXACT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises where a score is no long


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Lloyd's steps from evenly spread rows; codewords that lose all rows stay where they are."""
    x = np.unique(x, axis=0)
    words = x[np.unique(np.linspace(0, len(x) - 1, min(size, len(x))).astype(int))] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(STEPS):
        near = nearest(x, words)[0]
        count = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest codeword, and the distance from it."""
    near = np.argmin((words * words).sum(1)[None, :] - 2.0 * x @ words.T, axis=1)
    return near, np.sqrt(((x - words[near]) ** 2).sum(1))


class Index:
    """Codebooks, radii and the rows of each cell (at most CODEWORDS ** 2), and the table (bundle, block, id, label, x) of all rows.

    A block's number is its cell * 2 ** 32 and its number in the cell; `before` counts the rows of the cells before a cell and tells the bundle of a block.
    """

    def __init__(self, rows: DataFrame):
        rows = cut(rows, "vectors")
        n, self.width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        self.n, width, half = n, self.width, self.width // 2
        size = max(1, min(CODEWORDS, math.ceil((n / (BLOCK // 2)) ** 0.5)))
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < SAMPLE) if n > SAMPLE else rows
        sample = _padded(part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow().column("x"), width).astype(float)
        self.words = codebook(sample[:, :half], size), codebook(sample[:, half:], size)
        words = self.words
        k = len(words[1])

        def placed(batches):
            for batch in batches:
                x = _padded(batch.column("x"), width).astype(float)
                (i, r), (j, s) = nearest(x[:, :half], words[0]), nearest(x[:, half:], words[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * k + j, pa.int64()), pa.array(r), pa.array(s)], names=[*batch.schema.names, "cell", "r1", "r2"])

        at = cut(rows.mapInArrow(placed, "id long, label string, x array<bigint>, cell long, r1 double, r2 double"), "cells")
        cells = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()
        discard(rows)
        self.radii = np.zeros(len(words[0])), np.zeros(k)
        cell, self.size = cells.column("cell").to_numpy(), np.zeros(len(words[0]) * k, np.int64)
        self.size[cell] = cells.column("n").to_numpy()
        np.maximum.at(self.radii[0], cell // k, cells.column("r1").to_numpy())
        np.maximum.at(self.radii[1], cell % k, cells.column("r2").to_numpy())
        self.block, self.bits = BLOCK, min(BUNDLE_BITS, max(9, (n // 64).bit_length() - 1))
        parts = -(-self.size // BLOCK)
        self.before = np.cumsum(self.size) - self.size
        known = at.sparkSession.createDataFrame(pa.table({"cell": np.arange(len(self.size)), "_parts": parts, "_before": self.before})).filter("_parts > 0")
        split = at.join(F.broadcast(known), "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))  # CODEWORDS ** 2 rows at most
        self.rows = cut(split.select(F.shiftright(F.col("_before") + F.col("_part") * BLOCK, self.bits).alias("bundle"), (F.col("cell") * (1 << 32) + F.col("_part")).alias("block"),
                                     "id", "label", "x"), "index")
        discard(at)

    def blocks_of(self, cells: list[int]):
        """(bundle, its blocks) of the blocks of the given cells."""
        cells = np.array(cells, np.int64)
        parts = -(-self.size[cells] // self.block)
        cells, part = np.repeat(cells, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        blocks = np.sort((cells << 32) + part)
        # blocks are numbered in the order of their rows, and so are bundles
        bundles = np.sort((self.before[cells] + part * self.block) >> self.bits)
        starts = np.flatnonzero(np.r_[True, np.diff(bundles) != 0]) if len(bundles) else np.zeros(0, np.int64)
        yield from zip(bundles[starts].tolist(), np.split(blocks, starts[1:]))

    def order(self, x: np.ndarray):
        """(upper, lower, cell) of the cells that have rows, greatest upper bound first."""
        half = self.width // 2
        k, highs, lows, ranks = len(self.words[1]), [], [], []
        for a, words, radii in ((x[:half], self.words[0], self.radii[0]), (x[half:], self.words[1], self.radii[1])):
            mid, reach = words @ a, np.linalg.norm(a) * radii
            slack = _SLACK * (1.0 + np.abs(mid) + reach)
            by = np.argsort(-(mid + reach), kind="stable")
            ranks.append(by)
            highs.append((mid + reach + slack)[by].tolist())
            lows.append((mid - reach - slack)[by].tolist())
        heap = [(-(highs[0][0] + highs[1][0]), 0, 0)]
        while heap:
            upper, i, j = heapq.heappop(heap)
            if j + 1 < len(highs[1]):
                heapq.heappush(heap, (-(highs[0][i] + highs[1][j + 1]), i, j + 1))
            if not j and i + 1 < len(highs[0]):
                heapq.heappush(heap, (-(highs[0][i + 1] + highs[1][0]), i + 1, 0))
            cell = int(ranks[0][i] * k + ranks[1][j])
            if self.size[cell]:
                yield -upper, lows[0][i] + lows[1][j], cell

    def searcher(self):
        """The same without the table, for the tasks."""
        out = object.__new__(Index)
        out.width, out.words, out.radii, out.size, out.before, out.block, out.bits = self.width, self.words, self.radii, self.size, self.before, self.block, self.bits
        return out


#: An anchor on its way: what it looks for, each with the score of the k-th row that it has so far, how many cells it has been to, and the bound of the next one.
STATE = "anchor long, label string, x array<bigint>, wants array<struct<want:bigint,kth:bigint>>, visited long, next double"


def _asking(index: Index, rows: int, low: int, same: bool):
    """From anchors on their way to the bundles whose blocks are asked for, and the state after these.

    The state is a row with bundle -1; `next` is the bound of the first cell that wasn't asked for, or null when there is none. Rows leave by slices, as an
    anchor may ask for every block.
    """
    names = ("bundle", "blocks", "anchor", "label", "x", "wants", "visited", "next")

    def slices(batch):
        out, held = {n: [] for n in names}, 0
        kinds = {"bundle": pa.int64(), "blocks": pa.list_(pa.int64()), "visited": pa.int64(), "next": pa.float64(), **{n: batch.schema.field(n).type for n in ("anchor", "label", "x", "wants")}}

        def put(*row):
            for column, value in zip(out.values(), row):
                column.append(value)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(column, kinds[n]) for n, column in out.items()], names=list(names))

        for anchor, label, x, wants, visited in zip(*(batch.column(n).to_pylist() for n in ("anchor", "label", "x", "wants", "visited"))):
            full = np.zeros(index.width)
            full[:len(x)] = x
            floors = [-math.inf if same else low * p["want"] / 100.0 for p in wants]
            least = min(f if p["kth"] is None else max(f, p["kth"]) for f, p in zip(floors, wants))
            most = math.inf if same else max(p["want"] for p in wants)
            taken, seen, after, cells = 0, 0, None, []
            for upper, lower, cell in index.order(full):
                seen += 1
                if seen <= visited:
                    continue
                if upper < least:
                    break
                if taken >= rows:
                    after = upper
                    break
                visited = seen
                if lower > most:
                    continue
                taken += int(index.size[cell])
                cells.append(cell)
            for bundle, blocks in index.blocks_of(cells):
                put(bundle, blocks, anchor, label, x, wants, None, None)
                held += len(blocks) + len(x)
                if held >= SLICE:
                    yield made()
                    out, held = {n: [] for n in names}, 0
            put(-1, None, anchor, label, x, wants, visited, after)
            held += 1 + len(x)
        yield made()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                yield from slices(batch.slice(at, ANCHORS))

    return run


FOUND = "anchor long, want long, id long, score long"


def _met(asked: pa.Table, rows: pa.Table, width: int, k: int, low: int, high: int, same: bool) -> list:
    """(anchor, want, id, score) of the first k rows of a block, which come by id, for each want of each anchor."""
    out = []
    ids, anchors = rows.column("id").to_numpy(), asked.column("anchor").to_numpy()
    scores = products(_padded(asked.column("x"), width), _padded(rows.column("x"), width))
    names, codes = np.unique(np.concatenate([rows.column("label").to_numpy(zero_copy_only=False).astype(str), asked.column("label").to_numpy(zero_copy_only=False).astype(str)]), return_inverse=True)
    alike = codes[len(ids):, None] == codes[None, :len(ids)]
    fits = (alike if same else ~alike) & (anchors[:, None] != ids[None, :])
    wants = asked.column("wants").to_pylist()
    order = np.argsort(-scores, axis=1, kind="stable")  # rows go by id, so equal scores do
    ranked, open_ = np.take_along_axis(scores, order, 1), np.take_along_axis(fits, order, 1)
    for w in range(max(map(len, wants))):
        p = [v[w]["want"] if w < len(v) else -1 for v in wants]
        has = [w < len(v) for v in wants]
        least = np.array([v[w]["kth"] if h and v[w]["kth"] is not None else np.iinfo(np.int64).min for v, h in zip(wants, has)], np.int64)
        good = open_ & np.array(has)[:, None] & (ranked >= least[:, None])
        if not same:
            floor = np.array([-(-low * v // 100) if h else 0 for v, h in zip(p, has)], np.int64)
            ceil = np.array([high * v // 100 if h else 0 for v, h in zip(p, has)], np.int64)
            good &= (ranked >= floor[:, None]) & (ranked <= ceil[:, None])
        a, b = np.nonzero(good & (np.cumsum(good, axis=1) <= k))
        out.append((anchors[a], np.array(p, np.int64)[a], ids[order[a, b]], ranked[a, b]))
    return out


def _best(out: list, k: int) -> list:
    """Of rows (anchor, want, id, score) the first k for each anchor and want."""
    anchor, want, ids, score = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((ids, -score, want, anchor))
    anchor, want, ids, score = anchor[order], want[order], ids[order], score[order]
    first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(want) != 0)]) if len(anchor) else np.zeros(0, np.int64)
    rank = np.arange(len(anchor)) - np.repeat(first, np.diff(np.r_[first, len(anchor)]))
    return [(anchor[rank < k], want[rank < k], ids[rank < k], score[rank < k])]


def _meeting(width: int, k: int, low: int, high: int, same: bool):
    """The first k rows of a bundle for each want of each anchor, among the blocks that it asks for, but for rows that score less than the k-th it has."""
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = asked.combine_chunks(), rows.combine_chunks()
        out, held = [(np.zeros(0, np.int64),) * 4], 0
        if asked.num_rows and rows.num_rows:
            rows = rows.take(pa.array(np.lexsort((rows.column("id").to_numpy(), rows.column("block").to_numpy()))))
            block = rows.column("block").to_numpy()
            lists = asked.column("blocks").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            wanted = lists.flatten().to_numpy()
            who = np.repeat(np.arange(asked.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(wanted, kind="stable")
            wanted, who, asked = wanted[order], who[order], asked.drop_columns("blocks")
            starts = np.flatnonzero(np.r_[True, np.diff(wanted) != 0])
            for start, end in zip(starts, np.r_[starts[1:], len(wanted)]):
                a, b = np.searchsorted(block, wanted[start]), np.searchsorted(block, wanted[start], "right")
                if a == b:
                    continue
                out += _met(asked.take(pa.array(who[start:end])), rows.slice(a, b - a), width, k, low, high, same)
                held += len(out[-1][0])
                if held >= SLICE:
                    out = _best(out, k)
                    held = 0
            out = _best(out, k)
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table(dict(zip(("anchor", "want", "id", "score"), map(pa.array, columns))))

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(index: Index, anchors: DataFrame, k: int, low: int = 0, high: int = 100, same: bool = True) -> DataFrame:
    """(anchor, want, id, score, rank) for anchors (anchor, label, x, wants): for each want p the first k rows of the same label, whatever p is, or
    of other labels with low * p <= 100 * score <= high * p."""
    spark, rows = anchors.sparkSession, FIRST
    state = anchors.withColumn("wants", F.transform("wants", lambda w: F.struct(w.alias("want"), F.lit(None).cast("long").alias("kth")))).withColumn("visited", F.lit(0).cast("long"))
    found = spark.createDataFrame([], FOUND + ", rank int")
    searcher, groups = index.searcher(), None
    while True:
        asked = cut(state.repartition(F.col("anchor")).mapInArrow(_asking(searcher, rows, low, same), f"bundle long, blocks array<bigint>, {STATE}"), "asked")
        if groups is None:
            groups = max(1, -(-asked.filter("bundle = -1").count() // GROUP))
        asking = asked.filter("bundle >= 0").select("bundle", "blocks", F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("_group"), "anchor", "label", "x", "wants")
        members = index.rows.select("bundle", "block", "id", "label", "x")
        if groups == 1:
            members = members.withColumn("_group", F.lit(0).cast("long"))
        else:
            members = members.join(cut(asking.select("bundle", F.col("_group")).distinct(), "asked-bundles"), "bundle")
        met = asking.groupBy("bundle", "_group").cogroup(members.groupBy("bundle", "_group")).applyInArrow(_meeting(index.width, k, low, high, same), FOUND)
        found = cut(_first(found.drop("rank").unionByName(met), k), "found")
        ends = asked.filter("bundle = -1 AND next IS NOT NULL").select("anchor", "label", "x", F.explode("wants.want").alias("want"), "visited", "next")
        last = found.filter(F.col("rank") == k).select("anchor", "want", F.col("score").alias("kth"))
        # a want goes on until its k-th row is above all that is left, or all that is left is below its window
        left = ends.join(last, ["anchor", "want"], "left").filter(F.col("kth").isNull() | (F.col("kth") <= F.col("next")))
        if not same:
            left = left.filter(F.col("next") * 100 >= F.col("want") * low)
        state = cut(left.groupBy("anchor").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.sort_array(F.collect_list(F.struct("want", "kth"))).alias("wants"), F.first("visited").alias("visited")), "going-on")
        if state.isEmpty():
            return found
        rows *= GROWTH


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from `prepared` rows; `anchor` chooses the anchors among them."""
    index = Index(rows)
    chosen = cut(index.rows.filter(anchor).select(F.col("id").alias("anchor"), "label", "x"), "anchors")
    near = search(index, chosen.withColumn("wants", F.array(F.lit(0).cast("long"))), positives)
    pairs = cut(near.select("anchor", F.col("id").alias("positive"), F.col("score").alias("want")), "positives")
    windows = pairs.filter(F.col("want") * low <= F.col("want") * high)  # below 0 there is none
    wants = windows.groupBy("anchor").agg(F.collect_set("want").alias("wants"))
    hard = search(index, chosen.join(wants, "anchor"), negatives, low, high, same=False)
    return pairs.join(hard, ["anchor", "want"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("want").alias("positive_score"), F.col("score").alias("negative_score"))
