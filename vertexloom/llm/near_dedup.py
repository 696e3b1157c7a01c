"""Near-duplicate documents: SuperMinHash signatures, banding, verification on the full sets, union of the links.

A document is the set of its distinct runs of `width` words (A-Z in lower case, words parted by ASCII white space;
with fewer words the whole text is one run). Two documents are linked when 100 * intersection >= similarity * union.

SuperMinHash: on level j each element takes one place of its own permutation of the signature, with the value
j + uniform; a place keeps its least value. As a value of level j is less than j + 1, a document is finished at
the first level after which no place is empty, which for long documents is one of the first few. The places of a
signature are drawn without replacement, so their agreement varies less than that of independent hashes.

Documents with equal sets are one class, and only a class's document with the smallest id goes on. A bucket is what
agrees on a band. Its pairs are never listed; links are confirmed on the full sets in three rounds, and each round leaves
out what the rounds before have joined:
1. each document with the first document of one of its buckets;
2. in buckets that still hold several groups, each document with the bucket's first one and with one that is picked by a hash,
   where the two are in different groups. In a group of near copies, hardly any document is left alone after that;
3. the exact rest. Of buckets up to SMALL documents, all pairs that are in different groups. Larger buckets are put
   together where they share documents; those outside the largest group of such a cluster are looked up, in blocks, in an
   inverted index by all documents of the cluster, and only links come out.
So every pair that shares a bucket is confirmed or in one group. With the default 40 bands of 5 rows, a pair of similarity 0.8
shares no bucket with probability (1 - 0.8^5)^40 = 1.3e-7; more similar pairs still more rarely.

Null and empty texts and texts of white space only have no words and are linked with nothing. Rows with a null id
are returned with a null group and stay. Rows that share an id count as one document. No rows give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut
from .buffers import NON_SPACE, RangeHash, flat, list_array, lower, mix, row_of, runs as runs_of, slices, words
from .components import components

WIDTH, SIMILARITY, BANDS, ROWS = 5, 80, 40, 5
#: Buckets up to this size list their pairs in the last round; documents of a part in which one is picked; of the blocks of a cluster.
SMALL, PART, QUERY_BLOCK, MEMBER_BLOCK = 32, 64, 500, 2000
_U = np.uint64
EMPTY = _U(2**64 - 1)


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the rows' word runs, in order within a row, and the number of each row's first."""
    data, bounds = flat(column)
    data = lower(data)
    start, end, first = words(data, bounds, NON_SPACE)
    word, n = RangeHash(data)(start, end), np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    at = np.repeat(first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    stop = np.repeat(first[1:], count)
    runs = word[at]
    for t in range(1, width):
        inside = at + t < stop
        runs = np.where(inside, mix(runs * _U(0x9E3779B97F4A7C15) + word[np.minimum(at + t, max(len(word) - 1, 0))]), runs) if len(runs) else runs
    ends = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        runs[a:b].sort()
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    new[ends[:-1][count > 0]] = True
    return runs[new], np.concatenate([[0], np.cumsum(new)])[ends]


def superminhash(elements: np.ndarray, first: np.ndarray, places: int, seed: int = 0) -> np.ndarray:
    """(rows, places) of uint64: level in the high half, the uniform value in the low half. Rows without elements stay empty."""
    rows = len(first) - 1
    signature = np.full(rows * places, EMPTY, np.uint64)
    row = row_of(first)
    base, earlier = mix(elements, seed), []
    for level in range(places):
        if not len(row):
            break
        draw = mix(base, level + 1)
        chosen = level + (((draw & _U(0xFFFFFFFF)) * _U(places - level)) >> _U(32)).astype(np.int32)
        place = chosen
        for i in range(level - 1, -1, -1):  # undo the swaps of the earlier levels
            place = np.where(earlier[i] == place, i, place)
        at = row * places + place
        free = signature[at] == EMPTY
        np.minimum.at(signature, at[free], (_U(level) << _U(32)) | (draw[free] >> _U(32)))
        unfinished = (signature.reshape(rows, places) == EMPTY).any(1)[row]
        earlier.append(chosen)
        if not unfinished.all():
            row, base, earlier = row[unfinished], base[unfinished], [x[unfinished] for x in earlier]
    return signature.reshape(rows, places)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) of uint64: equal for documents that agree on a band."""
    parts = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for r in range(parts.shape[2]):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r], 7)
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n, set_a, set_b, bands): size and 128-bit digest of each document's set, and its bands' keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        for part in slices(batches, "text"):
            runs, first = shingles(part.column("text"), width)
            n = np.diff(first)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(runs, s))]) for s in (1, 2)]
            keys = band_keys(superminhash(runs, first, bands * rows), bands)
            has = np.where(n > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), *(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums),
                 list_array(np.concatenate([[0], np.cumsum(has)]), np.ascontiguousarray(keys[n > 0]).ravel().view(np.int64), pa.int64())],
                names=["id", "n", "set_a", "set_b", "bands"])

    return docs.mapInArrow(sign, f"id {kind}, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, elements) of the full sets, as packed and ordered 64-bit hashes."""
    def full(batches):
        for part in slices(batches, "text"):
            runs, first = shingles(part.column("text"), width)
            packed = [runs[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], names=["id", "elements"])

    return docs.mapInArrow(full, f"id {docs.schema['id'].dataType.simpleString()}, elements binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= similarity * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(compare, f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id (the smallest id that can be reached over links), kept."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, width, bands, rows), "signed")
    classes = cut(signed.filter("n > 0 and id is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.withColumnRenamed("rep", "id"), ["set_a", "set_b", "id"])
    entries = reps.select(F.explode("bands").alias("key"), "id", "n")
    # aggregates are written before they are joined on their key, so that the join can be split at a bucket with very many members
    firsts = cut(entries.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "firsts")
    buckets = cut(entries.join(firsts, "key").distinct(), "buckets")
    sizes = cut(buckets.select("id", "n").distinct(), "sizes")
    sets = cut(_sets(docs.join(sizes, "id", "left_semi"), width).dropDuplicates(["id"]), "sets")
    close = F.expr(f"100 * least(n, m) >= {similarity} * greatest(n, m)")

    first = buckets.filter("id <> head").groupBy(F.col("id").alias("b")).agg(F.min("head").alias("a"), F.first("n").alias("n"))
    first = cut(first.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m")), "a").filter(close).select("a", "b"), "first")
    groups = components(_confirmed(first, sets, similarity))

    held = _still_apart(buckets, groups, 1)
    chief = cut(held.groupBy("key", "part").agg(F.min(F.struct(F.xxhash64("id", "key"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("up").alias("a_up"))).alias("c")).select("key", "part", "c.a", "c.m", "c.a_up"), "chief")
    heads = held.filter("id = head").select("key", F.col("id").alias("a"), F.col("n").alias("m"), F.col("up").alias("a_up"))
    met = held.join(chief, ["key", "part"]).select("id", "n", "up", "a", "m", "a_up").union(held.join(heads, "key").select("id", "n", "up", "a", "m", "a_up"))
    second = met.filter("up <> a_up").filter(close).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    groups = _with_links(groups, _confirmed(second.join(first, ["a", "b"], "left_anti"), sets, similarity))

    held = _still_apart(buckets, groups, 2)
    few = held.filter(F.col("size") <= SMALL)
    other = few.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("up").alias("b_up"))
    third = few.join(other, (few["key"] == other["key"]) & F.expr("id < b and up <> b_up") & close).select(F.col("id").alias("a"), "b").distinct()
    groups = _with_links(groups, _confirmed(third, sets, similarity).union(_clustered(held.filter(F.col("size") > SMALL), sets, similarity)))

    of_set = signed.select("id", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    found = of_set.join(groups.select(F.col("b").alias("rep"), F.col("a").alias("up")), "rep", "left")
    group = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("up", "rep")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"),
                        F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def _still_apart(buckets: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(key, head, size, id, n, up, part) of the buckets of more than `least` members that hold several groups; up is a member's group."""
    member = buckets.join(groups.select(F.col("b").alias("id"), F.col("a").alias("up")), "id", "left").withColumn("up", F.coalesce("up", "id"))
    several = cut(member.groupBy("key").agg(F.min("up").alias("low"), F.max("up").alias("high")).filter("low <> high").select("key"), "several")
    parts = F.ceil(F.col("size") / PART).cast("int")
    return cut(member.filter(F.col("size") > least).join(several, "key").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")), "apart")


def _with_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    links = cut(links, "links")
    return groups if links.isEmpty() else components(groups.select("a", "b").union(links))


def _clustered(held: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The links (a, b) between different groups among documents that large buckets put together."""
    kind = sets.schema["id"].dataType.simpleString()
    if held.isEmpty():
        return sets.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    together = components(held.select(F.col("head").alias("a"), F.col("id").alias("b")))
    member = held.select("id", "up").distinct().join(together.select(F.col("b").alias("id"), F.col("a").alias("cluster")), "id", "left")
    member = cut(member.withColumn("cluster", F.coalesce("cluster", "id")), "clusters")
    counts = member.groupBy("cluster", "up").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("c", "up")).alias("top"), F.sum("c").alias("all")).select(
        "cluster", F.col("top.up").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / QUERY_BLOCK).cast("int").alias("q"), F.ceil(F.col("all") / MEMBER_BLOCK).cast("int").alias("p"))
    rows = member.join(largest, "cluster").join(sets, "id")
    spot = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    asked = rows.filter("up <> main").withColumns({"asked": F.lit(1), "q": spot(F.col("q"))}).withColumn("p", every(F.col("p")))
    asking = rows.filter("q > 0").withColumns({"asked": F.lit(0), "p": spot(F.col("p"))}).withColumn("q", every(F.col("q")))
    dealt = asked.unionByName(asking).select("cluster", "q", "p", "asked", "id", "up", "elements").repartition("cluster", "q", "p")

    def look_up(batches):
        key, index, block = None, None, []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                mine, own = (row["cluster"], row["q"], row["p"]), np.frombuffer(row["elements"], np.uint64)
                if mine != key:
                    key, index, block = mine, None, []
                if row["asked"]:  # these come first
                    block.append((row["id"], row["up"], own))
                    continue
                if not block:
                    continue
                index = index or _inverted(block)
                elements, owner, size = index
                low, high = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
                same = np.bincount(owner[np.repeat(low, high - low) + runs_of(high - low)], minlength=len(block))
                for i in np.flatnonzero(100 * same >= similarity * (len(own) + size - same)).tolist():
                    if block[i][1] != row["up"]:
                        found.append((row["id"], block[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found) if found else [[], []], (batch.column("id"),) * 2)], names=["a", "b"])

    return dealt.sortWithinPartitions("cluster", "q", "p", F.col("asked").desc()).mapInArrow(look_up, f"a {kind}, b {kind}")


def _inverted(block):
    """Elements in order with the place in the block of the document that has each, and the documents' sizes."""
    sizes = np.array([len(x) for _, _, x in block])
    elements = np.concatenate([x for _, _, x in block])
    order = np.argsort(elements, kind="stable")
    return elements[order], np.repeat(np.arange(len(block)), sizes)[order], sizes


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of each group's first document and of documents without a group, all columns."""
    gone = cut(near_groups(docs, id_col, text_col, **options).filter("not kept").select(F.col(id_col).alias("_id")).distinct(), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("all"), F.col(id_col).alias("_id"))
    return keyed.join(gone, "_id", "left_anti").select("all.*")
