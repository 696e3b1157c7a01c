"""Portable random numbers: the same value in Spark, in SQL engines and after a task is run again.

A draw is the first 52 bits of the md5 of the joined keys. Rows keep their draw wherever they are
computed, so a lost executor or a second attempt never changes a sample.
"""

from pyspark.sql import Column, functions as F

SPAN = 1 << 52


def _col(key):
    return F.col(key) if isinstance(key, str) else key if isinstance(key, Column) else F.lit(key)


def draw(*keys, seed) -> Column:
    """Integer in [0, 2^52) for the keys (column names, columns or numbers) and the seed."""
    joined = F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")


def unit(*keys, seed) -> Column:
    """The same draw as a double in [0, 1)."""
    return draw(*keys, seed=seed) / F.lit(float(SPAN))
