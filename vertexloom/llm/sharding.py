"""Sharding by extendible hashing, in DataFrame operations only.

A row's address is 60 bits: the first 32 from a hash of the key, the others from a hash of the columns that tell rows
of one key apart, so that even a key with a third of all rows can be split. The directory is a binary trie of address
prefixes: a bucket that is over the byte limit is split on its next bit, and no other is; what is left are the shards.
A single row (or several with one address) over the limit is a shard of its own, marked as oversized.

The byte sums of the prefixes come from one grouping of the rows at a depth a few bits below the expected one, and are
then rolled up; only rows in cells that are still too large are grouped again, 8 bits deeper. Nothing but sums of
cells is shuffled for the directory, and the number of cells goes with total bytes / limit.

Null texts have 0 bytes, null keys are a key of their own, repeated rows have one address and stay together; a table
without rows has no shards.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut

BITS, KEY_BITS, DEEPER = 60, 32, 8


def _bits(hex_digits: int, *columns: str) -> Column:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")


def address(key: list[str], apart: list[str] = ()) -> Column:
    """60 bits; all of them from the key when no other columns are named."""
    if not apart:
        return _bits(BITS // 4, *key)
    return F.shiftleft(_bits(KEY_BITS // 4, *key), BITS - KEY_BITS).bitwiseOR(_bits((BITS - KEY_BITS) // 4, *key, *apart))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, cell_depth, cell, shard_bytes, shard_rows, oversized) for the table (address, n_bytes).

    A row with the address a belongs to the shard of the cell a >> (60 - cell_depth).
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth, low, out, open_cells = min(BITS, max(0, -(-total // limit) - 1).bit_length() + 6), 0, None, None
    while True:
        rows = sizes.select("address", "n_bytes")
        if open_cells is not None:
            rows = rows.withColumn("cell", F.shiftright("address", BITS - low)).join(open_cells, "cell", "left_semi").drop("cell")
        cells = cut(rows.groupBy(F.shiftright("address", BITS - depth).alias("cell")).agg(
            F.sum("n_bytes").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("address").alias("lo"), F.max("address").alias("hi")), "cells")
        # every prefix above a cell, down from the depth at which the last pass ended
        above = cells.select("cell", "n", "rows", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, cast({depth} - depth as int))"))
        nodes = above.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = nodes.withColumn("done", (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
        mapped = above.select("cell", "depth", "prefix").join(nodes.filter("done"), ["depth", "prefix"])
        shards = mapped.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s")).select(
            F.expr("if(s.depth = 0, '', lpad(bin(s.prefix), s.depth, '0'))").alias("shard"), F.col("s.depth").alias("depth"), F.lit(depth).alias("cell_depth"), "cell",
            "s.shard_bytes", "s.shard_rows", (F.col("s.shard_bytes") > limit).alias("oversized"))
        shards = cut(shards, "shards")
        out = shards if out is None else out.unionByName(shards)
        open_cells = cut(cells.join(shards, "cell", "left_anti").select("cell"), "open")
        if depth == BITS or open_cells.isEmpty():
            return out
        low, depth = depth, min(BITS, depth + DEEPER)


def assign(docs: DataFrame, key: list[str], limit: int, text_col: str = "text", apart: list[str] = ()) -> DataFrame:
    """The rows of docs as a struct `row`, with n_bytes, shard (its prefix in bits), depth, shard_bytes, shard_rows, oversized."""
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("row"), n_bytes.alias("n_bytes"), address(key, apart).alias("address"))
    shards = directory(cut(rows.select("address", "n_bytes"), "sizes"), limit)
    out = None
    for depth in sorted(r[0] for r in shards.select("cell_depth").distinct().collect()):  # at most 60 / 8 + 1
        part = rows.withColumn("cell", F.shiftright("address", BITS - depth)).join(shards.filter(F.col("cell_depth") == depth), "cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumn("cell", F.col("address")).join(shards, "cell")
    return out.select("row", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversized")


def write_shards(docs: DataFrame, path: str, key: list[str], limit: int, text_col: str = "text", apart: list[str] = ()) -> DataFrame:
    """Writes the rows to path/shard=s<bits>/ (with underscores before the name if docs has such a column), one file for each shard, and
    returns what `assign` does without the rows."""
    name = "shard"
    while name in docs.columns:
        name = "_" + name
    placed = assign(docs, key, limit, text_col, apart)
    named = placed.select("row.*", F.concat(F.lit("s"), "shard").alias(name))
    named.repartition(name).write.partitionBy(name).parquet(path)
    return placed.drop("row")
