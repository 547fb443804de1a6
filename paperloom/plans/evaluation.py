"""Scores of recognised pages against their texts: blocks, pages, overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.score import TABLE_WEIGHT, TEXT_WEIGHT, best_window_score, table_score
from paperloom.functions.text import IMAGE_LINK
from paperloom.operators.tables import html_rows

TABLE = r"(?is)<table.*?</table>"


def predicted_text(markdown: Column) -> Column:
    """Text of a page without tables and pictures, in one line."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(markdown, F.lit("")), TABLE, ""), IMAGE_LINK, "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def scored(truth: DataFrame, predictions: DataFrame, page: str) -> DataFrame:
    """(page, kind, place, score) of the true blocks against the predicted page, an empty one where there is none.

    ``truth`` has page, kind (text or table), place, ignore and text; ignored blocks and empty texts are left out.
    A text is sought in the page's whole text, the k-th table of the page compared with its k-th predicted one.
    """
    p = predictions.groupBy(page).agg(F.max("markdown").alias("_md"))
    t = truth.where(~F.coalesce("ignore", F.lit(False))).withColumn("place", F.coalesce("place", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(page).orderBy("place"))
    tables = t.where("kind = 'table'").withColumn("_k", rank).join(p, page, "left")
    given = F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce("_md", F.lit("")), F.lit(TABLE), 0), F.col("_k")), F.lit(""))
    tables = tables.select(page, "kind", "place", table_score(html_rows(F.col("text")), html_rows(given)).alias("score"))
    texts = t.where("kind = 'text' AND text <> ''").join(p.select(page, predicted_text(F.col("_md")).alias("_md")), page, "left")
    texts = texts.select(page, "kind", "place", best_window_score(F.col("text"), F.coalesce("_md", F.lit(""))).alias("score"))
    return texts.unionByName(tables)


def page_report(blocks: DataFrame) -> DataFrame:
    """(page, text_avg, table_avg) of (page, block, kind, score); a kind without blocks counts 0."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return blocks.groupBy("page").agg(mean("text").alias("text_avg"), mean("table").alias("table_avg"))


def overall(blocks: DataFrame) -> DataFrame:
    """One row (text_avg, table_avg, overall, text_blocks, table_blocks); weights are not renormalised."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    m = blocks.agg(mean("text").alias("text_avg"), mean("table").alias("table_avg"), F.count_if(F.col("kind") == "text").alias("text_blocks"), F.count_if(F.col("kind") == "table").alias("table_blocks"))
    return m.withColumn("overall", F.col("text_avg") * TEXT_WEIGHT + F.col("table_avg") * TABLE_WEIGHT)


def worst(blocks: DataFrame, k: int = 8) -> DataFrame:
    return blocks.orderBy("score", "page", "block").limit(k)


def tally(checks: DataFrame) -> DataFrame:
    """One row of counts of three-valued results: passed, failed, skipped."""
    return checks.agg(F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("skipped"))


def positional(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the right row of the same rank in their group, as ``l`` and ``r``."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda df: df.withColumn("rank", F.row_number().over(w))
    return number(left).alias("l").join(number(right).alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.rank") == F.col("r.rank")), "left")


def style_top(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, value, n): the k most frequent values of each key; ties by value."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("r") <= k).drop("r")


def column_shares(cells: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """(key, column, share): share of each column by the square root of its longest text."""
    longest = cells.groupBy(key, column).agg(F.sqrt(F.greatest(F.max(F.length(text)), F.lit(1)).cast("double")).alias("w"))
    return longest.select(key, column, (F.col("w") / F.sum("w").over(Window.partitionBy(key))).alias("share"))
