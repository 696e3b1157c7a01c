"""Exact dedup of texts that arrive in batches, against an immutable snapshot.

A snapshot keeps one row for each distinct digest and static binary-fuse filters over them, one filter for each
range of digests. The digests of a new batch are grouped among themselves first; a group that the filter of its
range rules out is new and goes no further. The others join the snapshot's rows. Every row of a group of two or
more is then compared, byte by byte, with the text of the group's first row; a row that differs in spite of its
digest is grouped by a second digest instead.

Texts are equal when they are identical after each run of white space (space, tab, line feed, vertical tab, form
feed, carriage return) is replaced by one space. Of equal texts the row with the smallest id stays. Null texts
count as empty, and empty texts are equal. Null ids come after all others; of rows that share text and id one
stays. A hot text (one that a third of all rows share) is one row after the map-side grouping, and its rows meet
their group only in plain equi-joins, which adaptive execution splits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut
from .fuse_filter import FuseFilter

#: Digests that one filter holds on average, and that one screening task gets.
FILTER_KEYS, SCREEN_KEYS = 50_000, 200_000


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def build_filters(digests: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Filters over the column `digest` of about n distinct rows: (range, seed, segment, segments, cells), and the number of ranges."""
    ranges = max(1, -(-n // FILTER_KEYS))

    def build(rows: pa.Table) -> pa.Table:
        f = FuseFilter.build(rows.column("key").to_numpy().view(np.uint64))
        return pa.table({"range": rows.column("range")[:1], "seed": pa.array([f.seed], pa.int32()), "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()),
                         "cells": pa.array([f.cells.tobytes()], pa.binary())})

    return _keyed(digests, ranges).select("range", "key").groupBy("range").applyInArrow(
        build, "range bigint, seed int, segment int, segments int, cells binary"), ranges


def _keyed(digests: DataFrame, ranges: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.withColumn("key", key).withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("bigint"))


def screen(digests: DataFrame, filters: DataFrame, ranges: int, n: int) -> DataFrame:
    """The distinct digests that a filter lets pass; those of ranges without a filter don't."""
    parts = max(1, -(-n // (ranges * SCREEN_KEYS)))

    def passed(rows: pa.Table, have: pa.Table) -> pa.Table:
        if not rows.num_rows or not have.num_rows:
            return rows.select(["digest"]).slice(0, 0)
        f = have.slice(0, 1).to_pylist()[0]
        ok = FuseFilter(f["seed"], f["segment"], f["segments"], np.frombuffer(f["cells"], np.uint16)).has(rows.column("key").to_numpy().view(np.uint64))
        return rows.select(["digest"]).filter(pa.array(ok))

    asked = _keyed(digests.select("digest"), ranges).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.groupBy("range", "part").cogroup(copies.groupBy("range", "part")).applyInArrow(passed, "digest binary")


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, n): the first row's (id is null, id, tag), and the number of rows. Counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"), F.count(F.lit(1)).alias("n"))


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tag"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", new_part: Column | None = None, digest=sha256) -> DataFrame:
    """One row for each row of docs: id, tag (its number in the scan), digest, first (none, id, tag of the row that stays), n.

    `new_part` is true on the rows of the new batch (default: half of the rows, by a hash of the id); the others are the snapshot.
    `digest` makes a binary digest of the normalised text.
    """
    new_part = F.pmod(F.xxhash64("id"), F.lit(2)) == 1 if new_part is None else new_part
    text = normalised("text")
    tagged = _tagged(docs, id_col, text_col)
    rows = cut(tagged.select("id", "tag", digest(text).alias("digest"), F.coalesce(new_part, F.lit(True)).alias("new")), "digests")
    known, coming = cut(_groups(rows.filter("not new"), "digest"), "snapshot"), cut(_groups(rows.filter("new"), "digest"), "batch")

    filters, ranges = build_filters(known, known.count())
    maybe = cut(screen(coming, filters, ranges, coming.count()), "maybe")
    fresh = coming.join(maybe, "digest", "left_anti")
    meeting = coming.join(maybe, "digest").select("digest", F.col("first").alias("first2"), F.col("n").alias("n2"))
    groups = known.join(meeting, "digest", "full").select(
        "digest", F.least("first", "first2").alias("first"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
    groups = cut(groups.unionByName(fresh), "groups")

    several = groups.filter("n > 1").select("digest", F.col("first.tag").alias("keeper"))
    members = cut(tagged.select("tag", text.alias("text"), digest(text).alias("digest")).join(several, "digest"), "members")
    keepers = members.filter("tag = keeper").select("digest", F.col("text").alias("keeper_text"))
    odd = cut(members.join(keepers, "digest").filter("text <> keeper_text").select("tag", F.sha2("text", 512).alias("variant")), "odd")
    if odd.isEmpty():
        return rows.join(groups, "digest").select("id", "tag", "digest", "first", "n")
    rows = rows.join(odd, "tag", "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    return rows.join(_groups(rows, "digest", "variant"), ["digest", "variant"]).select("id", "tag", "digest", "first", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256 (lowercase hex)."""
    return classify(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("tag") == F.col("first.tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns. `docs` has to be a table or another plan that gives its rows in the same partitions each time."""
    dropped = cut(classify(docs, id_col, text_col).filter("tag <> first.tag").select("tag"), "dropped")
    tagged = docs.select(F.struct(*docs.columns).alias("all"), F.monotonically_increasing_id().alias("tag"))
    return tagged.join(dropped, "tag", "left_anti").select("all.*")
