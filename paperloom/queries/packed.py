"""Problem 1: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators.unpack import unpack_values
from paperloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack_values(table(spark, d, "invoice_records"), "row_id", "line_items").where("n_items > 1").select("row_id", "pos", "item")


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return unpack_values(table(spark, d, "invoice_records"), "row_id", "line_items")


QUERIES = {f.__name__: f for f in (p1_found, p1_values)}
ORACLE: dict[str, str] = {}
