"""Numbers of rows in a total order, without one task for the whole table or for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import cut, join_sized

_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Add the place of each row from 1 by the columns of ``order``, nulls first.

    Rows are range-partitioned and sorted; a row's number is its place in its partition and the
    rows of the partitions before. Only one row per partition is ordered in one place. Ties of
    all columns are numbered in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", _BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def numbered_within(rows: DataFrame, key: Column, order: list[str], name: str = "number") -> DataFrame:
    """Add ``key`` and the place of each row from 1 among the rows of its key.

    The place in the whole less the first place of the key: a key with a third of all rows is
    sorted in as many tasks as any third of them. Rows of a null key share one.
    """
    placed = numbered(rows.withColumn("key", key), ["key", *order], "_place")
    first = cut(placed.where("key IS NOT NULL").groupBy("key").agg(F.min("_place").alias("_first")))
    none = placed.where("key IS NULL")
    lone = none.agg(F.min("_place").alias("_first"))
    known = join_sized(placed.where("key IS NOT NULL"), first, ["key"], "inner", row_bytes=120)
    every = known.unionByName(none.crossJoin(F.broadcast(lone)).select(*known.columns))  # one row
    return every.withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
