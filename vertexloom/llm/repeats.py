"""Repeated byte strings: every byte that a string of `width` bytes covers which also starts anywhere else goes.

The suffixes are sorted by most-significant-digit passes, only to a depth of `width` bytes, and a suffix that is
alone after a pass is dropped; the groups that are left after the last pass are exactly the repeated windows.

* First digit. A window is known by its anchor, the least hash among its 64-byte grams (the leftmost, if several), and
  by the offset of its start from there. Neighbouring windows share their anchor, so the digit (the bytes that are common
  to all windows of a block of offsets, at least 232) is stated once for a run of up to 169 windows: about 9 rows
  for 1,000 bytes of text. Equal windows have equal anchors, offsets and digits.
* Runs whose digit and whole span are equal elsewhere are repeated as they are. The others, and one run of each such
  class, send the bytes of their span to the task of their digit.
* Further digits. There the windows are sorted by four digits of a quarter of the width each. A digit with very many
  different spans is not sorted in one task: its windows become rows with a 128-bit hash, counted before the shuffle.

`passage_sharers` runs the same passes on texts whose words are written as 32 bits each, to find documents that share a run of words with another one: there a group
counts only if it has windows of two documents, and only windows that begin with a word.

Bytes are compared by hashes of 128 bits in all. Null and empty texts, and texts shorter than `width`, keep all
their bytes; repeated rows (also with null ids) repeat each other's bytes; no rows give no rows. Each row of the
input gives one row. `docs` has to be a table or another plan that gives its rows in the same partitions each time.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.lineage import cut, discard
from .buffers import NON_SPACE, RangeHash, as_binary, flat, mix, runs, slices, words

WIDTH, GRAM = 400, 64
#: Words of a passage, and the bytes that a word is written in.
PASSAGE, CODE = 51, 4
#: Different spans of one digit that are sorted in one task.
LOCAL_SPANS = 2000
_PLACE = 28  # bits for the place of a gram in a slice of texts
_U = np.uint64


def _blocks(width: int) -> list[tuple[int, int]]:
    """Offsets of a window's start from its anchor, in two ranges."""
    last = width - GRAM
    return [(0, last // 2), (last // 2 + 1, last)]


def _anchored(data: np.ndarray, bounds: np.ndarray, width: int, hashes: RangeHash):
    """(anchor, lowest start, highest start) of every run of windows with one anchor."""
    n = len(data) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    reach = width - GRAM + 1
    grams = hashes.fixed(GRAM)
    keys = (grams >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keys) // reach) * reach, 2**64 - 1, np.uint64)
    padded[: len(keys)] = keys
    square = padded.reshape(-1, reach)
    to_here = np.minimum.accumulate(square, 1).ravel()
    from_here = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(from_here[:n], to_here[reach - 1 : reach - 1 + n]) & _U(2**_PLACE - 1)).astype(np.int64)
    valid = np.ones(n, bool)
    for end in bounds[1:-1].tolist():
        valid[max(0, end - width + 1) : min(end, n)] = False
    start = np.flatnonzero(valid)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], start[first], start[last]


def first_digits(docs: DataFrame, width: int) -> DataFrame:
    """(tag, place, low, high, digit, span) of every run: the anchor's place in its text, the offsets, the two hashes."""
    def state(batches):
        for part in slices(batches, "text"):
            data, bounds = flat(part.column("text"))
            if len(data) < width:
                continue
            tags = part.column("tag").to_numpy()
            hashes, other = RangeHash(data), RangeHash(data, 1)
            anchor, lowest, highest = _anchored(data, bounds, width, hashes)
            row = np.searchsorted(bounds, anchor, "right") - 1
            for b, (low, high) in enumerate(_blocks(width)):
                lo, hi = np.maximum(anchor - highest, low), np.minimum(anchor - lowest, high)
                ok = np.flatnonzero(lo <= hi)
                x, lo, hi = anchor[ok], lo[ok], hi[ok]
                digit = mix(other(x - low, x - high + width), b)
                span = mix(hashes(x - hi, x - lo + width) + _U(1 << 32) * lo.astype(np.uint64) + hi.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(tags[row[ok]]), pa.array((x - bounds[row[ok]]).astype(np.int64)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)),
                    pa.array(digit.view(np.int64)), pa.array(span.view(np.int64))], names=["tag", "place", "low", "high", "digit", "span"])

    return docs.select("tag", "text").mapInArrow(state, "tag bigint, place bigint, low smallint, high smallint, digit bigint, span bigint")


def _spans(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted runs; `wanted` has tag, place, low, high, digit and more."""
    lists = wanted.groupBy("tag").agg(F.collect_list(F.struct("place", "low", "high", "digit", "alone", "many")).alias("runs"))

    def cut_out(batches):
        for batch in slices(batches, "text"):
            rows = []
            texts, lists = as_binary(batch.column("text")), batch.column("runs")
            for tag, text, mine in zip(batch.column("tag").to_pylist(), texts, lists.to_pylist()):
                text = text.as_buffer().to_pybytes()
                rows += [(r["digit"], r["many"], tag, r["place"], r["low"], r["high"], r["alone"], text[r["place"] - r["high"] : r["place"] - r["low"] + width]) for r in mine]
            for a in range(0, len(rows), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[a : a + 4000]), _SPAN_TYPES)], names=_SPAN_NAMES)

    return docs.select("tag", "text").join(lists, "tag").mapInArrow(cut_out, "digit bigint, many boolean, tag bigint, place bigint, low smallint, high smallint, alone boolean, bytes binary")


_SPAN_NAMES = ["digit", "many", "tag", "place", "low", "high", "alone", "bytes"]
_SPAN_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary()]


def _windows(batch: pa.RecordBatch):
    """(data, row, start): every window of the rows' spans, the highest offset first."""
    data, bounds = flat(batch.column("bytes"))
    high, low = batch.column("high").to_numpy().astype(np.int64), batch.column("low").to_numpy().astype(np.int64)
    count = high - low + 1
    row = np.repeat(np.arange(len(count)), count)
    return data, row, bounds[:-1][row] + runs(count), high, count


def repeated_windows(batch: pa.RecordBatch, width: int, across: bool = False) -> np.ndarray:
    """For every window of the batch (see _windows) whether the same bytes start in another run (across: of another row) of the same digit.

    Radix sort from the most significant digit: `group` is the place in the order so far; windows alone in theirs drop out.
    """
    data, row, start, _, _ = _windows(batch)
    digit = batch.column("digit").to_numpy()
    hashes = RangeHash(data)
    group = digit[row].view(np.uint64)
    alive = np.arange(len(row))
    edges = np.linspace(0, width, 5).astype(np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        s = start[alive]
        group = mix(group * _U(0x9E3779B97F4A7C15) + hashes(s + a, s + b), 3)
        _, number, size = np.unique(group, return_inverse=True, return_counts=True)
        several = size[number] > 1
        alive, group = alive[several], group[several]
    if across and len(alive):
        tag, (_, number) = batch.column("tag").to_numpy()[row[alive]], np.unique(group, return_inverse=True)
        least, most = np.full(number.max() + 1, np.iinfo(np.int64).max), np.full(number.max() + 1, -1, np.int64)
        np.minimum.at(least, number, tag)
        np.maximum.at(most, number, tag)
        alive = alive[(least < most)[number]]
    out = np.zeros(len(row), bool)
    out[alive] = True
    return out


def _covered(batch: pa.RecordBatch, hit: np.ndarray, width: int) -> pa.RecordBatch:
    """(tag, a, b) of the bytes under the hit windows of runs that aren't known to be repeated yet."""
    _, row, _, high, count = _windows(batch)
    place = batch.column("place").to_numpy()
    at = (place - high)[row] + runs(count)
    chosen = np.flatnonzero(hit & batch.column("alone").to_numpy(zero_copy_only=False)[row])
    row, at = row[chosen], at[chosen]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(batch.column("tag").to_numpy()[row[first]]), pa.array(at[first]), pa.array(at[last] + width)], names=["tag", "a", "b"])


def _sorted_locally(spans: DataFrame, width: int, across: bool) -> DataFrame:
    def sort(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            digit = table.column("digit").to_numpy()
            whole = int(np.searchsorted(digit, digit[-1]))  # the last digit may go on in the next batch
            yield from solve(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None:
            yield from solve(rest)

    def solve(table):
        digit = table.column("digit").to_numpy() if table.num_rows else np.zeros(0)
        edges = np.append(np.flatnonzero(np.append(True, digit[1:] != digit[:-1])), len(digit)) if len(digit) else np.zeros(1, np.int64)
        a = 0
        while a < len(edges) - 1:  # whole digits, about LOCAL_SPANS rows at a time
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + LOCAL_SPANS, "right")) - 1)
            part = table.slice(edges[a], edges[b] - edges[a]).combine_chunks().to_batches()[0]
            yield _covered(part, repeated_windows(part, width, across), width)
            a = b

    ordered = spans.filter("not many").repartition("digit").sortWithinPartitions("digit")
    return ordered.mapInArrow(sort, "tag bigint, a bigint, b bigint")


def _counted(spans: DataFrame, width: int, across: bool) -> DataFrame:
    """The same for digits with many spans: windows as rows."""
    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                data, row, start, high, count = _windows(part)
                h = [RangeHash(data, s)(start, start + width).view(np.int64) for s in (0, 1)]
                at = (part.column("place").to_numpy() - high)[row] + runs(count)
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(part.column("tag").to_numpy()[row]), pa.array(at),
                                                  pa.array(part.column("alone").to_numpy(zero_copy_only=False)[row])], names=["h", "g", "tag", "a", "alone"])

    rows = spans.filter("many").mapInArrow(spread, "h bigint, g bigint, tag bigint, a bigint, alone boolean")
    # written first: a join with an aggregate of the same stage can't be split where one key has most rows
    twice = cut(rows.groupBy("h", "g").agg(_several(across).alias("several")).filter("several").select("h", "g"), "twice")
    return rows.filter("alone").join(twice, ["h", "g"]).select("tag", "a", (F.col("a") + width).alias("b"))


def _several(across: bool):
    return F.min("tag") < F.max("tag") if across else F.count(F.lit(1)) > 1


def repeated_ranges(docs: DataFrame, width: int = WIDTH, across: bool = False) -> DataFrame:
    """(tag, a, b): byte ranges, which may overlap, of the rows (tag, text) that repeated windows cover.

    across: windows that another row has. Of spans that only one row has, several times, one stands for all then.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width has to be at least {2 * GRAM} bytes")
    stated = first_digits(docs, width)
    shared = cut(stated.groupBy("digit").agg(_several(across).alias("several")).filter("several").select("digit"), "digits")
    kept = cut(stated.join(shared, "digit"), "runs")
    discard(shared)
    classes = cut(kept.groupBy("digit", "span").agg(_several(across).alias("several"), F.min(F.struct("tag", "place", "low", "high")).alias("one")), "classes")
    known = kept.join(classes.filter("several").select("digit", "span"), ["digit", "span"]).select(
        "tag", (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + width).alias("b"))
    mixed = cut(classes.groupBy("digit").agg(F.count(F.lit(1)).alias("spans"), F.bool_or(~F.col("several")).alias("open")).filter("spans > 1 and open").select("digit", "spans"), "mixed")
    wanted = classes.join(mixed, "digit").select("digit", "one.*", (~F.col("several")).alias("alone"), (F.col("spans") > LOCAL_SPANS).alias("many"))
    spans = cut(_spans(docs, wanted, width), "spans")
    return known.union(_sorted_locally(spans, width, across)).union(_counted(spans, width, across))


def _worded(text: str = "text"):
    """A column with each word of the texts (runs of characters but white space) as CODE bytes."""
    @arrow_udf("binary")
    def code(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
            data, bounds = flat(part.column("text"))
            start, end, first = words(data, bounds, NON_SPACE)
            made = (RangeHash(data)(start, end) >> _U(64 - 8 * CODE)).astype(np.uint32)
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * CODE).astype(np.int64)), pa.py_buffer(made)]).cast(pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return code(text)


def passage_sharers(tagged: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(tag): the rows of (tag, text) that have a run of `passage` words which another row has as well."""
    ranges = repeated_ranges(tagged.select("tag", _worded().alias("text")), passage * CODE, across=True)
    begins = F.ceil(F.col("a") / CODE) * CODE  # a range is a run of repeated windows: does one of them begin with a word?
    return ranges.filter(begins + passage * CODE <= F.col("b")).select("tag").distinct()


def _merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for r in sorted((r["a"], r["b"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return out


def _rest(text: bytes, gone: list[list[int]]) -> bytes:
    edges = [0, *(e for r in gone for e in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, removed (merged ranges as begin, end, begin, end ..), kept (the remaining bytes), shares_passage
    (whether another row has a run of PASSAGE words of this one; such a run may be shorter than `width` bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    tagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tag"))
    ranges = repeated_ranges(tagged, width).select("tag", F.struct("a", "b").alias("range"), F.lit(False).alias("shares"))
    both = ranges.union(passage_sharers(tagged).select("tag", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("range"), F.lit(True).alias("shares")))
    ranges = both.groupBy("tag").agg(F.collect_list("range").alias("ranges"), F.bool_or("shares").alias("shares"))

    def remove(batches):
        for batch in slices(batches, "text"):
            sizes, gone, kept = [], [], []
            for text, mine in zip(as_binary(batch.column("text")), batch.column("ranges").to_pylist()):
                text, mine = text.as_buffer().to_pybytes(), _merged(mine or ())
                sizes.append(len(text))
                gone.append([e for r in mine for e in r])
                kept.append(_rest(text, mine))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pc.fill_null(batch.column("shares"), False)],
                                             names=["id", "n_bytes", "removed", "kept", "shares_passage"])

    return tagged.join(ranges, "tag", "left").select("id", "text", "ranges", "shares").mapInArrow(
        remove, f"id {kind}, n_bytes bigint, removed array<bigint>, kept binary, shares_passage boolean").withColumnRenamed("id", id_col)
