"""Access logs as a stream: daily counts with late lines, exact visitors, history kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.traffic import calls
from paperloom.sources import sinks

#: How late a line may come after the newest one before its day is closed.
LATE = "10 days"


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a folder of logs as they appear."""
    return spark.readStream.text(folder).select(F.col("value").alias("raw_line"))


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Lines of a folder of parquet files, at most ``files`` of them in one batch."""
    schema = "raw_line string, log_file string, received_at timestamp_ntz"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def daily_stream(lines: DataFrame, late: str = LATE) -> DataFrame:
    """(day, pv, tools) with a watermark; the day is the log's own, kept beside the event time's window."""
    human = calls(lines).where("kind NOT IN ('scanner', 'robot')").withColumn("at", F.col("day").cast("timestamp"))
    return (
        human.withWatermark("at", late).groupBy(F.window("at", "1 day"), "day")
        .agg(F.count_if(F.col("kind") == "page").alias("pv"), F.count_if(F.col("kind") == "tool").alias("tools")).select("day", "pv", "tools")
    )


def visitor_stream(lines: DataFrame, late: str = LATE) -> DataFrame:
    """(day, ip) of each day's visitors, once; state is one key per visitor and open day."""
    pages = calls(lines).where(F.col("kind") == "page").withColumn("at", F.col("day").cast("timestamp"))
    return pages.withWatermark("at", late).dropDuplicatesWithinWatermark(["day", "ip"]).select("day", "ip")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """History with the days of ``new`` (day, pv, tools) replaced; the visitors of a day that is known stay."""
    known = old.select("day", F.col("pv").alias("o_pv"), F.col("uv").alias("uv"), F.col("tools").alias("o_tools"))
    return known.join(new.select("day", "pv", "tools"), "day", "full").select("day", F.coalesce("pv", "o_pv").alias("pv"), "uv", F.coalesce("tools", "o_tools").alias("tools"))


def keep_history(lines: DataFrame, folder: str, checkpoint: str, late: str = LATE):
    """Start a query that replaces the days of each batch in the history, once per batch.

    A batch that is run again after a failure replaces the same days with the same counts.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        sinks.write_history(upserted(sinks.read_history(batch.sparkSession, folder), batch), folder)

    return daily_stream(lines, late).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_rows(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends its rows to a folder of parquet files, each batch exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
