"""Joins on keys of which one may hold a large part of all rows."""

from pyspark.sql import DataFrame, functions as F

from .lineage import cut

HOT_ROWS = 1_000_000
#: The most keys that are split by a salt: the hottest. A key after these has less than a thousandth of all rows.
HOT_KEYS = 1000
EVEN = "even"  # as counts: the keys were counted and none is hot


def hot_keys(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than hot_rows rows, HOT_KEYS at most, and the number of parts each is split into."""
    return counts.filter(F.col("n") > hot_rows).orderBy(F.col("n").desc()).limit(HOT_KEYS).select(
        *keys, F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_parts"))


def counted(left: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | str:
    """Row counts by key for joins that are made again and again: the hot keys' rows, or EVEN."""
    counts = cut(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows), "hot")
    return EVEN if counts.isEmpty() else counts


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
                counts: DataFrame | str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join in which a hot key of the left side is spread over several tasks.

    Where `counts` is known (the keys with their left row count `n`), the rows of a hot key get a salt from the `spread`
    columns and the matching right rows are copied once for each salt. Without counts, or when they are EVEN, this is a plain
    join: adaptive execution measures the shuffled partitions and splits a hot one, which costs no second pass over the left side.
    """
    if counts is None or isinstance(counts, str):
        return left.join(right, keys, how)
    hot = F.broadcast(hot_keys(counts, keys, hot_rows))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted = left.join(hot, keys, "left").select(*left.columns, F.pmod(F.xxhash64(*spread), parts).cast("int").alias("_salt"))
    copies = right.join(hot, keys, "left").select(*right.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, take: dict[str, str], spread: list[str],
           how: str = "inner", counts: DataFrame | str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add columns of a one-row-per-key table; `take` maps right column to new name."""
    small = right.select(F.col(right_key).alias(key), *[F.col(c).alias(n) for c, n in take.items()])
    if isinstance(counts, DataFrame):
        counts = counts.select(F.col(counts.columns[0]).alias(key), "n")
    return salted_join(left, small, [key], spread, how, counts, hot_rows)
