"""Components of rows that share keys, without listing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import cut, join_sized


def components(ids: DataFrame, keyed: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, label): label is the least id reachable over shared keys.

    ``ids`` has every id, ``keyed`` (id, key). A round takes the least label of each key and
    of each id; both are pre-aggregated, and keys are joined back with a salt, so a key held by
    a third of all ids spreads. Rounds end when no label changes. Ids without a key are their
    own label.
    """
    keyed = cut(keyed.select("id", "key").distinct())
    labels = cut(ids.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(most_rounds):
        by_key = cut(keyed.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")))
        by_key = by_key.where("n > 1 AND least < most")
        if by_key.isEmpty():
            return labels
        least = join_sized(keyed, by_key.select("key", "least"), ["key"], "inner", row_bytes=120).groupBy("id").agg(F.min("least").alias("least"))
        stepped = labels.join(least, "id", "left").select("id", F.least("label", F.coalesce("least", "label")).alias("label"))
        # pointer jump: follow the label of the label, halving long chains
        stepped = cut(stepped)
        over = stepped.where("label < id").select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = cut(join_sized(stepped, over, ["label"], "left", row_bytes=32).select("id", F.coalesce("further", "label").alias("label")))
    raise RuntimeError("components did not settle")
