"""Readers and sinks: tables written to files of the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans import traffic as t
from paperloom.queries import traffic as batch
from paperloom.queries.pages import _BLOCKS
from paperloom.queries.streams import scratch
from paperloom.runtime import table
from paperloom.plans import layout as lo
from paperloom.sources import access_log, files, sinks


def log_files(spark, d):
    """Daily counts of logs read from plain and packed files; files of other names are not logs."""
    here, lines = scratch(spark, "logs"), table(spark, d, "access_log")
    plain = F.pmod(F.xxhash64("raw_line"), F.lit(2)) == 0
    sinks.write_lines(lines.where(plain | F.col("raw_line").isNull()), "raw_line", here, "access")
    sinks.write_lines(lines.where(~plain), "raw_line", here, "access.1", packed=True)
    sinks.write_lines(lines, "raw_line", here, "error")
    return t.daily(access_log.read_logs(spark, here))


def log_listing(spark, d):
    """Files by suffix, those below an excluded folder counted apart."""
    here, lines = scratch(spark, "listing"), table(spark, d, "access_log").coalesce(1)
    sinks.write_lines(lines, "raw_line", here, "access")
    sinks.write_lines(lines, "raw_line", here, "packed", packed=True)
    sinks.write_lines(lines, "raw_line", f"{here}/kept-out", "access")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{here}/kept-out").toUri().getPath()
    found = files.listed(spark, here, ("log",), (root,))
    return found.agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"), F.min("length").alias("shortest"))


def history_kept(spark, d):
    """A history written twice and read again: the second one replaces the first."""
    here, days = scratch(spark, "history"), t.daily(table(spark, d, "access_log"))
    sinks.write_history(days.where("pv > 0"), here)
    sinks.write_history(days, here)
    return sinks.read_history(spark, here)


def history_missing(spark, d):
    """A history that isn't there is empty."""
    return sinks.read_history(spark, scratch(spark, "nothing")).agg(F.count(F.lit(1)).alias("n"))


def usage_read(spark, d):
    """Counts by day and tool from JSON maps, one a day."""
    per = t.per_name(table(spark, d, "access_log"), "tool")
    days = per.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"))
    return files.usage_counts(days.select(F.to_json(F.create_map(F.col("day").cast("string"), F.col("m"))).alias("value")))


def tab_lines(spark, d):
    """Recognised lines from tab-separated text; lines without a text or place have fewer parts and are dropped."""
    rows = table(spark, d, "ocr_lines").select(F.concat_ws("\t", "text", "x", "y", "width", "height").alias("value"))
    return files.tab_lines(rows).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("height"), 6).alias("height"))


def detail_read(spark, d):
    """Blocks of pages from JSON, a page each; broken JSON gives none."""
    b = lo.blocks(table(spark, d, "ocr_lines")).select("scan_id", "page_no", "line_idx", "label", "text")
    packed = b.groupBy("scan_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_idx", "label", "text"))).alias("b"))
    value = F.to_json(F.array(F.struct(F.transform("b", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("textblocks"))))
    value = F.when(F.pmod("page_no", F.lit(7)) == 6, F.substr(value, F.lit(1), F.length(value) - 3)).otherwise(value)
    pages = packed.select(F.concat_ws("|", "scan_id", "page_no").alias("key"), value.alias("value"))
    return files.detail_pages(pages, "key", "value").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def lines_appended(spark, d):
    """Feedback appended to a file of JSON lines, twice."""
    here = scratch(spark, "feedback")
    rows = table(spark, d, "documents").where("source = 'feedback_form'").select("doc_id", "text")
    sinks.append_lines(rows, here)
    sinks.append_lines(rows, here)
    back = spark.read.schema("doc_id bigint, text string").json(here)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("text")).alias("chars"))


def pages_written(spark, d):
    """Lines of each scan written as one text, read again by scan."""
    here = scratch(spark, "pages")
    rows = table(spark, d, "scan_files").where("tier = 0").select("scan_id").join(table(spark, d, "ocr_lines"), "scan_id").where("text <> ''")
    sinks.write_pages(rows.select("scan_id", F.struct("page_no", "line_idx", "line_id").alias("para_no"), "text"), here)
    return spark.read.text(here, wholetext=True).select(F.col("scan_id").cast("bigint").alias("scan_id"), F.length("value").alias("chars"))


def file_limits(spark, d):
    return files.within_limits(table(spark, d, "scan_files")).select("scan_id", "refused")


def file_manifest(spark, d):
    """Name, size and digest of written files: one file a source's documents."""
    here = scratch(spark, "manifest")
    docs = table(spark, d, "documents").where("source = 'glossary' AND text IS NOT NULL")
    docs.coalesce(1).sortWithinPartitions("doc_id").select("text").write.text(here)
    return files.manifest(spark, here).where("name LIKE 'part-%'").select("size", "sha256")


QUERIES = {f.__name__: f for f in (
    log_files, log_listing, history_kept, history_missing, usage_read, tab_lines, detail_read, lines_appended, pages_written, file_limits, file_manifest)}
ORACLE = {
    "log_files": batch._CALLS + "SELECT * FROM daily",
    "log_listing": "SELECT CAST(1 AS BIGINT) AS included, CAST(1 AS BIGINT) AS excluded, CAST(sum(strlen(coalesce(raw_line, '')) + 1) AS BIGINT) AS shortest FROM access_log",
    "history_kept": batch._CALLS + "SELECT * FROM daily",
    "history_missing": "SELECT CAST(0 AS BIGINT) AS n",
    "usage_read": batch._CALLS + "SELECT day, name, n FROM tools",
    "tab_lines": "SELECT text, count(*) AS n, round(sum(x), 6) AS x, round(sum(height), 6) AS height FROM ocr_lines WHERE text IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL AND NOT contains(text, chr(9)) GROUP BY text",
    "detail_read": f"WITH {_BLOCKS} SELECT scan_id || '|' || page_no AS key, label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM b WHERE page_no % 7 <> 6 GROUP BY ALL",
    "lines_appended": "SELECT doc_id, 2 * count(*) AS n, CAST(min(length(text)) AS INT) AS chars FROM documents WHERE source = 'feedback_form' GROUP BY doc_id",
    "pages_written": "SELECT scan_id, CAST(sum(length(text)) + 2 * (count(*) - 1) + 1 AS INT) AS chars FROM scan_files JOIN ocr_lines USING (scan_id) WHERE tier = 0 AND text <> '' GROUP BY scan_id",
    "file_limits": "SELECT scan_id, CASE WHEN page_count IS NULL THEN 'unknown' WHEN page_count <= 0 THEN 'empty' WHEN page_count > 80 THEN 'too long' WHEN page_count > 50 THEN 'only in parts' END AS refused FROM scan_files",
    "file_manifest": "WITH t AS (SELECT string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE source = 'glossary' AND text IS NOT NULL) SELECT CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS sha256 FROM t",
}
