"""Daily traffic of access logs: views, visitors, pages, tools, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.access_log import STALE_TOOL, kind, parse_lines



def calls(lines: DataFrame) -> DataFrame:
    """Parsed lines with their kind; the page of the home file is the home page."""
    return parse_lines(lines).withColumn("kind", kind()).withColumn(
        "name", F.when((F.col("kind") == "page") & (F.col("path") == "/index.html"), "/").otherwise(F.col("path")))


def daily(lines: DataFrame) -> DataFrame:
    """(day, pv, uv, tools): a day with surviving calls that are neither page nor tool has zeros."""
    human = calls(lines).where("kind NOT IN ('scanner', 'robot')")
    page, tool = F.col("kind") == "page", F.col("kind") == "tool"
    # distinct (day, ip) are pre-aggregated, spread by visitor, before the day is summed up
    by_ip = human.groupBy("day", "ip").agg(F.count_if(page).alias("pv"), F.count_if(tool).alias("tools"))
    return by_ip.groupBy("day").agg(F.sum("pv").alias("pv"), F.count_if(F.col("pv") > 0).alias("uv"), F.sum("tools").alias("tools"))


def per_name(lines: DataFrame, what: str) -> DataFrame:
    """(day, name, n) of pages or tools."""
    return calls(lines).where(F.col("kind") == what).groupBy("day", "name").agg(F.count(F.lit(1)).alias("n"))


def top(names: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent names over all days; ties by name."""
    return names.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def latest_top(names: DataFrame, today: str, k: int = 10) -> DataFrame:
    """The k most frequent names of today, or of the latest day there is if today has none."""
    at = names.agg(F.coalesce(F.max(F.when(F.col("day") == F.lit(today).cast("date"), F.col("day"))), F.max("day")).alias("day"))
    return top(names.join(F.broadcast(at), "day"), k)  # one row


def clean_tools(names: DataFrame) -> DataFrame:
    """Kept history without the keys of probes."""
    return names.where(~F.col("name").rlike(STALE_TOOL))


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """(day, pv, uv, tools, source): a day parsed anew replaces the kept one as a whole; others stay."""
    n, o = new.alias("n"), old.alias("o")
    fresh = F.col("n.day").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col("o.day") == F.col("n.day"), "full_outer").select(
        *(pick(c) for c in ("day", "pv", "uv", "tools")), F.when(fresh, "new").otherwise("old").alias("source"))


def change(days: DataFrame, value: str = "pv") -> DataFrame:
    """(day, value, change): per cent against the day before, half up; null without one or after none."""
    w = Window.orderBy("day")  # one row a day
    before = F.lag(value).over(w)
    pct = F.floor((F.col(value) - before) / before * 100 + 0.5).cast("long")
    return days.select("day", value, F.when(before > 0, pct).alias("change"))


def last_days(days: DataFrame, n: int = 7) -> DataFrame:
    """The last n days that are recorded."""
    return days.withColumn("r", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("r") <= n).drop("r")


def usage_total(counts: DataFrame, n: int = 30) -> DataFrame:
    """(name, total) over the last n recorded days of (day, name, n)."""
    days = counts.select("day").distinct().orderBy(F.desc("day")).limit(n)
    return counts.join(F.broadcast(days), "day", "left_semi").groupBy("name").agg(F.sum("n").alias("total"))  # n rows


def label_by_prefix(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, n, label): label of the longest key that begins the name, the name itself if none."""
    hit = names.alias("n").join(F.broadcast(labels).alias("l"), F.col("n.name").startswith(F.col("l.key")), "left")
    best = F.max_by("l.label", F.struct(F.length("l.key"), F.col("l.key")))
    return hit.groupBy("n.name", "n.n").agg(F.coalesce(best, F.col("n.name")).alias("label"))
