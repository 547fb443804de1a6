"""Access-log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The combined log format, and what tells scanners, robots, pages and tool calls.
LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)[^"]*"\s+(\d+)\s+\S+\s+"[^"]*"\s+"([^"]*)"'
SCANNER_PATHS = (
    "/wp-admin", "/wp-login", r"/xmlrpc\.php", "/phpmyadmin", r"/\.env", "/admin", "/config", r"/api/\.env", "/api/graphql",
    "/api/v1/", "/api/settings", "/api/config", "/boaform", "/shell", "/vendor/", r"/\.git", "/php$", "/cgi-bin", "/actuator",
    "/console", r"/setup\.php", "/jndi", "/solr", "/manager/html", "/api/users", "/api/login", "/api/auth", "/ecp/",
    "/.well-known/", "/api/_", "/api/test",
)
ROBOT_AGENTS = (
    "bot", "spider", "crawl", "semrush", "ahrefs", "mj12", "dotbot", "python-requests", "curl", "wget", "zgrab", "nmap", "scanner",
    "masscan", "netsystems", "bytespider", "bingpreview", "go-http", "java/", "okhttp", "headless", "phantom",
)
PROBES = (r"\.\./", "/etc/passwd", "/proc/self", r"union\s+select", r"select\s+.+\s+from", "/api/?$", "/api/[A-Za-z0-9]{80,}")
PAGE = r"^/(?:index\.html)?$|^/[^/?#]+\.html$"
TOOL = "^/api/"
TIME = "dd/MMM/yyyy:HH:mm:ss Z"

SCANNER = "(?i)(" + "|".join(SCANNER_PATHS) + ")"
ROBOT = "(?i)(" + "|".join(ROBOT_AGENTS) + ")"
PROBE = "(?i)(" + "|".join(PROBES) + ")"
#: Tool keys dropped from kept history; one path more than in the live filter.
STALE_TOOL = "(?i)(" + "|".join((*PROBES, "/api/mcp")) + ")"


def parse_lines(lines: DataFrame, column: str = "raw_line") -> DataFrame:
    """One row per well-formed line: ip, day, method, path, status, agent, at.

    Null, empty, cut and foreign lines and impossible times give no row. The day is the one
    written in the line, in the line's own offset, not the session's. Repeated lines are
    separate calls.
    """
    part = lambda i: F.regexp_extract(column, LINE, i)
    rows = lines.where(F.col(column).rlike(LINE)).select(
        part(1).alias("ip"), part(2).alias("time"), part(3).alias("method"), part(4).alias("path"),
        part(5).alias("status"), part(6).alias("agent"))
    at = F.try_to_timestamp("time", F.lit(TIME))
    day = F.to_date(F.substring("time", 1, 11), "dd/MMM/yyyy")
    return rows.withColumn("at", at).where("at IS NOT NULL").withColumn("day", day).drop("time")


def kind(path: str = "path", method: str = "method", status: str = "status", agent: str = "agent") -> Column:
    """scanner, robot, page, tool, probe, missing or other, tested in this order."""
    p = F.col(path)
    return (
        F.when(p.rlike(SCANNER), "scanner").when(F.col(agent).rlike(ROBOT), "robot")
        .when((F.col(method) == "GET") & p.rlike(PAGE), "page")
        .when(~p.rlike(TOOL), "other").when(p.rlike(PROBE), "probe").when(F.col(status) == "404", "missing").otherwise("tool")
    )


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """raw_line and log_file of plain and gzip logs of a folder; unreadable files are skipped."""
    return (
        spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "access*.log*").option("recursiveFileLookup", "true").text(folder)
        .select(F.col("value").alias("raw_line"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("log_file"))
    )
