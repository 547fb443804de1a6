"""Streams over access_log, run to their end in several batches and compared with the batch plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.queries import traffic as batch
from paperloom.runtime import shared_folder, table
from paperloom.sources import sinks
from paperloom.streaming import traffic as st

#: Files that the lines are parted into, and files of a batch.
FILES, AT_ONCE = 6, 2
#: Lines may come so late here: what was received together was written over many days.
LATE = "800 days"


def scratch(spark, what: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _arriving(spark, d: str, here: str):
    """The lines as a stream in the order they were received, several files to a batch; days come late and in parts."""
    table(spark, d, "access_log").repartitionByRange(FILES, "received_at").write.parquet(f"{here}/lines")
    return st.table_stream(spark, f"{here}/lines", AT_ONCE)


def stream_daily(spark, d):
    """Counts of days, kept in a history that every batch brings up to date."""
    here = scratch(spark, "daily")
    st.keep_history(_arriving(spark, d, here), f"{here}/history", f"{here}/state", LATE).awaitTermination()
    return sinks.read_history(spark, f"{here}/history").select("day", "pv", "tools")


def stream_visitors(spark, d):
    """Visitors by day, each kept once by the stream's state and written to a folder."""
    here = scratch(spark, "visitors")
    st.keep_rows(st.visitor_stream(_arriving(spark, d, here), LATE), f"{here}/seen", f"{here}/state").awaitTermination()
    return spark.read.schema("day date, ip string").parquet(f"{here}/seen").groupBy("day").agg(F.count(F.lit(1)).alias("uv"))


def stream_closed_days(spark, d):
    """What the history says of days before and after a late batch: visitors of known days stay, counts are replaced."""
    days = batch.t.daily(table(spark, d, "access_log"))
    first = days.where("dayofmonth(day) <= 20")
    late = days.where("dayofmonth(day) >= 10").select("day", (F.col("pv") + 1).alias("pv"), "tools")
    return st.upserted(first, late)


QUERIES = {f.__name__: f for f in (stream_daily, stream_visitors, stream_closed_days)}
ORACLE = {
    "stream_daily": batch._CALLS + "SELECT day, pv, tools FROM daily",
    "stream_visitors": batch._CALLS + "SELECT day, uv FROM daily WHERE uv > 0",
    "stream_closed_days": batch._CALLS + "SELECT day, CASE WHEN day(day) >= 10 THEN pv + 1 ELSE pv END AS pv, CASE WHEN day(day) <= 20 THEN uv END AS uv, tools FROM daily",
}
