"""Global order without a one-task window: row numbers, running sums and exact-size samples."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import SPAN
from .lineage import cut

BINS = 1 << 16


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows in range partitions, sorted, with the partition `_part` and the place in it `_local`."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_place", F.monotonically_increasing_id()), "ranged")
    return (placed.withColumn("_part", F.shiftright("_place", 33))
            .withColumn("_local", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place"))


def _offsets(parts: DataFrame, value: str) -> DataFrame:
    """Sum of `value` over earlier partitions; one row for each partition of the job."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("_part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before")))


def with_row_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """0-based position in the given order (names or columns; a total order gives a stable result)."""
    placed = _ranged(df, order)
    sizes = placed.groupBy("_part").agg((F.max("_local") + 1).alias("_size"))
    return (placed.join(_offsets(sizes, "_size"), "_part")
            .withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before"))


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows before this one, plus this one, in a total order."""
    placed = _ranged(df, order)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    inside = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(_offsets(sums, "_sum"), "_part")
            .withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_part", "_local", "_before"))


def first_k(df: DataFrame, k: int, rank: str, ties: list[str], span: int = SPAN):
    """Boolean column that is true on exactly the k rows with the smallest (rank, ties).

    A histogram of the rank (at most 65,536 bins reach the driver) names the bin that holds the
    k-th row; only that bin is sorted. The result is a plain comparison, so both the chosen rows and
    the rest are filters on the input. `rank` is an integer in [0, span).
    """
    if k <= 0:
        return F.lit(False)
    bin_of = F.floor(F.col(rank) / F.lit(float(span)) * BINS).cast("int")
    counts = sorted(df.groupBy(bin_of.alias("bin")).count().collect())
    seen = 0
    for row in counts:
        if seen + row["count"] >= k:
            break
        seen += row["count"]
    else:
        return F.lit(True)
    order = [rank] + ties
    edge = (df.filter(bin_of == row["bin"]).select(*order)
            .withColumn("_rn", F.row_number().over(Window.orderBy(*order))).filter(F.col("_rn") == k - seen).first())
    at_or_before = F.lit(True)
    for name in reversed(order):
        bound = F.lit(edge[name])
        at_or_before = (F.col(name) < bound) | ((F.col(name) == bound) & at_or_before)
    return at_or_before
