"""Votes within groups: dominant and unanimous values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dominant(
    rows: DataFrame, keys: list[str], values: list[str], order: str, least: int, share: float, single: bool = False
) -> DataFrame:
    """(keys, values, n, share): the most frequent combination of values of each group, if frequent enough.

    It needs ``least`` rows and ``share`` of the group's rows (both inclusive); with ``single``
    the only combination of a group wins whatever its count. Equal counts go to the one seen
    first by ``order``. Rows with null values must be filtered before. Counts are
    pre-aggregated by combination, so a group of a third of all rows costs no more than its
    distinct combinations.
    """
    counted = rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(*values, "n"), F.struct("n", -F.col("first")))
    groups = counted.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    won = (F.col("b.n") >= least) & (F.col("b.n") / F.col("all") >= share)
    if single:
        won |= F.col("kinds") == 1
    return groups.where(won).select(*keys, *(F.col(f"b.{v}").alias(v) for v in values), F.col("b.n").alias("n"), (F.col("b.n") / F.col("all")).alias("share"))


def unanimous(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values): per value column what all its non-null rows agree on, else null."""
    agree = lambda v: F.when(F.min(v) == F.max(v), F.max(v)).alias(v)
    return rows.groupBy(*keys).agg(*(agree(v) for v in values))
