"""Queries over access_log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans import traffic as t
from paperloom.runtime import table
from paperloom.sources import access_log as a

#: Days kept from an earlier run and days parsed anew overlap in June 2025.
OLD_UNTIL, NEW_FROM, TODAY = "2025-06-30", "2025-06-01", "2030-01-01"
# Labels of tool paths, longest prefix wins.
LABELS = (("/api/", "tool"), ("/api/convert", "conversion"), ("/api/convert?to=docx", "conversion to docx"), ("/api/scan/", "scan"),
          ("/api/scan/start", "scan job"), ("/api/ocr", "text recognition"), ("/api/merge", "merging"))
#: Times that a recognised page is billed.
BILLED = 2
# Shown names of tools.
NAMES = (("/api/ocr", "text recognition"), ("/api/convert", "conversion"), ("/api/merge", "merging"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "access_log")


def traffic_calls(spark, d):
    return t.calls(_lines(spark, d)).groupBy("day", "method", "status", "kind").agg(F.count(F.lit(1)).alias("n"))


def traffic_classified(spark, d):
    return t.calls(_lines(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def traffic_malformed(spark, d):
    lines = _lines(spark, d)
    good = a.parse_lines(lines).agg(F.count(F.lit(1)).alias("good"))
    return lines.agg(F.count(F.lit(1)).alias("all_lines")).crossJoin(good).select("all_lines", "good")


def traffic_daily(spark, d):
    return t.daily(_lines(spark, d))


def traffic_zero_days(spark, d):
    return t.daily(_lines(spark, d)).where("pv = 0").select("day", "uv", "tools")


def traffic_top_pages(spark, d):
    return t.top(t.per_name(_lines(spark, d), "page"))


def traffic_top_tools(spark, d):
    return t.top(t.clean_tools(t.per_name(_lines(spark, d), "tool")))


def traffic_latest_tools(spark, d):
    return t.latest_top(t.per_name(_lines(spark, d), "tool"), TODAY)


def traffic_history_merge(spark, d):
    days = t.daily(_lines(spark, d))
    old = days.where(F.col("day") <= OLD_UNTIL).withColumn("pv", F.col("pv") + 1000)
    return t.merge_history(old, days.where(F.col("day") >= NEW_FROM))


def traffic_change(spark, d):
    return t.change(t.daily(_lines(spark, d)))


def traffic_last_week(spark, d):
    return t.last_days(t.daily(_lines(spark, d)), 7)


def traffic_tool_labels(spark, d):
    names = t.per_name(_lines(spark, d), "tool").groupBy("name").agg(F.sum("n").alias("n"))
    return t.label_by_prefix(names, spark.createDataFrame(LABELS, "key string, label string"))


def usage_last_days(spark, d):
    return t.usage_total(t.per_name(_lines(spark, d), "tool"), 30)


def usage_billing(spark, d):
    """Pages of recognised files by day; each is billed twice, once with the whole file and once alone."""
    files = table(spark, d, "scan_files").where("tier = 2 AND page_count > 0").select(F.to_date("received_at").alias("day"), "page_count")
    return files.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.sum("page_count").alias("pages"), (F.sum("page_count") * BILLED).alias("billed"))


def usage_named(spark, d):
    """Totals under the names of a fixed list; what isn't listed keeps its key."""
    names = spark.createDataFrame(NAMES, "name string, shown string")
    totals = t.per_name(_lines(spark, d), "tool").groupBy("name").agg(F.sum("n").alias("n"))
    return totals.join(F.broadcast(names), "name", "left").select("name", F.coalesce("shown", "name").alias("shown"), "n")  # the list is fixed


_SCAN = a.SCANNER.replace("'", "''")
_CALLS = rf"""
WITH parsed AS (
  SELECT regexp_extract(raw_line, '{a.LINE}', ['ip','time','method','path','status','agent']) AS x
  FROM access_log WHERE regexp_matches(raw_line, '{a.LINE}')
), typed AS (
  SELECT x.ip AS ip, x.method AS method, x.path AS path, x.status AS status, x.agent AS agent,
         CAST(strptime(substr(x.time, 1, 11), '%d/%b/%Y') AS DATE) AS day
  FROM parsed WHERE try_strptime(x.time, '%d/%b/%Y:%H:%M:%S %z') IS NOT NULL
), calls AS (
  SELECT *, CASE WHEN regexp_matches(path, '{_SCAN}') THEN 'scanner' WHEN regexp_matches(agent, '{a.ROBOT}') THEN 'robot'
    WHEN method = 'GET' AND regexp_matches(path, '{a.PAGE}') THEN 'page'
    WHEN NOT regexp_matches(path, '{a.TOOL}') THEN 'other'
    WHEN regexp_matches(path, '{a.PROBE}') THEN 'probe' WHEN status = '404' THEN 'missing' ELSE 'tool' END AS kind
  FROM typed
), named AS (SELECT *, CASE WHEN kind = 'page' AND path = '/index.html' THEN '/' ELSE path END AS name FROM calls
), daily AS (
  SELECT day, CAST(count(*) FILTER (kind = 'page') AS BIGINT) AS pv, CAST(count(DISTINCT ip) FILTER (kind = 'page') AS BIGINT) AS uv,
         CAST(count(*) FILTER (kind = 'tool') AS BIGINT) AS tools
  FROM named WHERE kind NOT IN ('scanner', 'robot') GROUP BY day
), tools AS (SELECT day, name, count(*) AS n FROM named WHERE kind = 'tool' GROUP BY day, name)
"""
_LABEL_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in LABELS)
QUERIES = {f.__name__: f for f in (
    traffic_calls, traffic_classified, traffic_malformed, traffic_daily, traffic_zero_days, traffic_top_pages, traffic_top_tools,
    traffic_latest_tools, traffic_history_merge, traffic_change, traffic_last_week, traffic_tool_labels, usage_last_days, usage_billing, usage_named)}
ORACLE = {
    "traffic_calls": _CALLS + "SELECT day, method, status, kind, count(*) AS n FROM named GROUP BY ALL",
    "traffic_classified": _CALLS + "SELECT kind, count(*) AS n FROM named GROUP BY kind",
    "traffic_malformed": _CALLS + "SELECT (SELECT count(*) FROM access_log) AS all_lines, (SELECT count(*) FROM typed) AS good",
    "traffic_daily": _CALLS + "SELECT * FROM daily",
    "traffic_zero_days": _CALLS + "SELECT day, uv, tools FROM daily WHERE pv = 0",
    "traffic_top_pages": _CALLS + "SELECT name, count(*) AS n FROM named WHERE kind = 'page' GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "traffic_top_tools": _CALLS + f"SELECT name, CAST(sum(n) AS BIGINT) AS n FROM tools WHERE NOT regexp_matches(name, '{a.STALE_TOOL}') GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "traffic_latest_tools": _CALLS + f"""SELECT name, CAST(sum(n) AS BIGINT) AS n FROM tools
      WHERE day = (SELECT coalesce(max(day) FILTER (day = DATE '{TODAY}'), max(day)) FROM tools) GROUP BY name ORDER BY n DESC, name LIMIT 10""",
    "traffic_history_merge": _CALLS + f""", old AS (SELECT day, pv + 1000 AS pv, uv, tools FROM daily WHERE day <= DATE '{OLD_UNTIL}'),
      new AS (SELECT * FROM daily WHERE day >= DATE '{NEW_FROM}')
      SELECT *, 'new' AS source FROM new UNION ALL SELECT *, 'old' AS source FROM old WHERE day NOT IN (SELECT day FROM new)""",
    "traffic_change": _CALLS + """, w AS (SELECT day, pv, lag(pv) OVER (ORDER BY day) AS b FROM daily)
      SELECT day, pv, CASE WHEN b > 0 THEN CAST(floor((pv - b) / CAST(b AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS change FROM w""",
    "traffic_last_week": _CALLS + "SELECT * FROM daily ORDER BY day DESC LIMIT 7",
    "traffic_tool_labels": _CALLS + f""", labels(key, label) AS (VALUES {_LABEL_ROWS}), s AS (SELECT name, CAST(sum(n) AS BIGINT) AS n FROM tools GROUP BY name)
      SELECT name, n, coalesce((SELECT label FROM labels WHERE starts_with(s.name, key) ORDER BY length(key) DESC LIMIT 1), name) AS label FROM s""",
    "usage_last_days": _CALLS + """SELECT name, CAST(sum(n) AS BIGINT) AS total FROM tools
      WHERE day IN (SELECT DISTINCT day FROM tools ORDER BY day DESC LIMIT 30) GROUP BY name""",
    "usage_billing": "SELECT CAST(received_at AS DATE) AS day, count(*) AS files, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(page_count) * 2 AS BIGINT) AS billed FROM scan_files WHERE tier = 2 AND page_count > 0 GROUP BY 1",
    "usage_named": _CALLS + "SELECT name, CASE name WHEN '/api/ocr' THEN 'text recognition' WHEN '/api/convert' THEN 'conversion' WHEN '/api/merge' THEN 'merging' ELSE name END AS shown, CAST(sum(n) AS BIGINT) AS n FROM tools GROUP BY name",
}
