"""Joins of a big, possibly skewed table to a table with one or few rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on the column ``key``; the columns of ``left``, then those of ``right``.

    Both sides are read once. Spark chooses the join by the sizes it measures; where it shuffles, adaptive
    execution splits the partitions of hot keys (and of NULL keys, which match nothing) of the left side,
    however many there are. The right side is packed into one column, so its names cannot clash.
    """
    rest = [c for c in right.columns if c != key]
    packed = right.select(key, F.struct(*rest).alias("_row"))
    return left.join(packed, key, how).select(*left.columns, *[F.col("_row")[c].alias(c) for c in rest])
