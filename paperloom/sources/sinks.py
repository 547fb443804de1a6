"""Where results go: history of days, pages as markdown, appended lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and paths in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_history(days: DataFrame, folder: str) -> None:
    """History sorted by day, replaced as a whole.

    The new history is written beside the old one, as it may be computed from what it replaces. Then
    the old one is moved away, the new one takes its place, and only then the old one is deleted; a
    stop in between leaves one of both for ``read_history``.
    """
    spark, name = days.sparkSession, folder.rstrip("/")
    days.coalesce(1).sortWithinPartitions("day").write.mode("overwrite").json(f"{name}-next")  # a row a day
    fs, path = _files(spark, name)
    now, old = path(name), path(f"{name}-old")
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(path(f"{name}-next"), now)
    fs.delete(old, True)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """Kept history; malformed lines are dropped, and a folder that isn't there is an empty history."""
    schema, name = "day date, pv bigint, uv bigint, tools bigint", folder.rstrip("/")
    fs, path = _files(spark, name)
    for place in (name, f"{name}-old"):
        if fs.exists(path(place)):
            return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(place)
    return spark.createDataFrame([], schema)


def write_lines(rows: DataFrame, column: str, folder: str, name: str, packed: bool = False) -> None:
    """Lines as text files name-0.log, name-1.log, ..., or .log.gz."""
    spark, beside = rows.sparkSession, f"{folder.rstrip('/')}/_{name}"
    rows.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").option("compression", "gzip" if packed else "none").text(beside)
    fs, path = _files(spark, beside)
    parts = sorted(f.getPath().toString() for f in fs.listStatus(path(beside)) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        fs.rename(path(part), path(f"{folder.rstrip('/')}/{name}-{i}.log" + (".gz" if packed else "")))
    fs.delete(path(beside), True)


def write_pages(paragraphs: DataFrame, folder: str) -> None:
    """One text per scan, paragraphs parted by a blank line, partitioned by scan."""
    page = paragraphs.groupBy("scan_id").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(para_no, text))), x -> x.text)"), "\n\n").alias("value"))
    page.write.mode("overwrite").partitionBy("scan_id").text(folder)


def append_lines(rows: DataFrame, folder: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)
