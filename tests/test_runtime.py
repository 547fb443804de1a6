"""Joins of counted sides, and numbers in a total order, on both of their ways."""

import pytest
from pyspark.sql import functions as F

from paperloom import runtime
from paperloom.operators import numbering


@pytest.mark.parametrize("limit", [runtime.BROADCAST_LIMIT_BYTES, 0])
@pytest.mark.parametrize("rows", [runtime.ROWS_A_TASK, 20])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_sized(spark, monkeypatch, limit, rows, how):
    """Broadcast, plain and spread ways give the same rows; null keys match nothing."""
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", limit)
    monkeypatch.setattr(runtime, "ROWS_A_TASK", rows)
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7)
    left = spark.range(300).select("id", key.alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.createDataFrame([(k, f"v{k}") for k in [*range(5), 0, None]], "k long, v string")
    got = sorted(((r["id"], r["v"]) for r in runtime.join_sized(left, runtime.cut(right), ["k"], how).collect()), key=str)
    assert got == sorted(((r["id"], r["v"]) for r in left.join(right, "k", how).collect()), key=str)


def test_bytes_are_measured(spark):
    long = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"), F.array(F.repeat(F.lit("y"), 1000)).alias("a"))
    assert runtime.bytes_of(long, 1) > 1_100_000 and runtime.bytes_of(long.where("false"), 1) == 0 and runtime.bytes_of(spark.range(100).toDF("v"), 70) == 7000


def test_numbers(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "hot" if i % 3 else f"k{i}") for i in range(101)] + [(200, None), (201, None)], "id int, k string")
    got = {r["id"]: r["number"] for r in numbering.numbered(rows, ["id"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got), 1)}
    within = numbering.numbered_within(rows.withColumn("number", F.lit(0)).drop("number"), F.col("k"), ["id"]).collect()
    by = {}
    for r in within:
        by.setdefault(r["k"], []).append((r["id"], r["number"]))
    for group in by.values():
        assert [n for _, n in sorted(group)] == list(range(1, len(group) + 1))
    assert numbering.numbered_within(rows.where("id > 999"), F.col("k"), ["id"]).count() == 0


def test_free_deletes_what_was_cut(spark):
    import os

    a = runtime.cut(spark.range(10).toDF("v"))
    b = runtime.cut(a.where("v > 3"))
    place = a._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    assert os.path.exists(place.removeprefix("file:"))
    runtime.free(a, a, spark.range(3))
    assert not os.path.exists(place.removeprefix("file:")) and b.count() == 6
