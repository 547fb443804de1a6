"""Identity of repeated records and their occurrence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.numbering import numbered_within


def field_key(no: str = "invoice_no", day: str = "invoice_date", total: str = "total_amount") -> Column:
    """number|date|total, the bare number if date or total is blank, null without a number."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.when(t(no) != "", F.when((t(day) != "") & (t(total) != ""), F.concat_ws("|", t(no), t(day), t(total))).otherwise(t(no)))


def archive_key(no: str = "invoice_no", tax: str = "seller_tax", day: str = "invoice_date", total: str = "total_amount") -> Column:
    """number|seller's tax|total, else seller's tax|date|total."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return F.when(c(no) != "", F.concat_ws("|", F.lit("invoice"), c(no), c(tax), c(total))).otherwise(F.concat_ws("|", F.lit("fallback"), c(tax), c(day), c(total)))


def grid_key(no: str = "invoice_no", tax: str = "seller_tax", total: str = "total_amount") -> Column:
    """number|seller's tax|total without regard to case; blanks collide."""
    return F.lower(F.concat_ws("|", *(F.coalesce(F.col(x), F.lit("")) for x in (no, tax, total))))


def occurrences(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Add ``key`` and ``occurrence``, 0 for the first of a key by ``order``; rows of a null key are all first."""
    placed = numbered_within(rows, key, [order], "occurrence")
    return placed.withColumn("occurrence", F.when(F.col("key").isNull(), 0).otherwise(F.col("occurrence") - 1).cast("int"))
