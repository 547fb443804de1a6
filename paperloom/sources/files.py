"""Files of documents: listing with exclusions, manifests, texts of plain, office and line files."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import numbering

# Kinds of files that are scanned, and limits of a conversion.
SUFFIXES = ("pdf", "jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "ofd")
MOST_PAGES, MOST_CONVERTED = 50, 80


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, excluded: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """(path, length, modified, included, content): files of a folder by suffix, without regard to case.

    Files below an excluded folder are listed as not included, so both can be counted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    files = files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    files = files.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    below = F.lit(False)
    for root in excluded:
        below |= F.col("path").startswith(root.rstrip("/") + "/")
    return files.withColumn("included", ~below)


def numbered(files: DataFrame) -> DataFrame:
    """Included files numbered from 1 by path."""
    return numbering.numbered(files.where("included"), ["path"], "row_id")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def runs_of_docx(content: bytes | None) -> str | None:
    """Text runs of an office document in order, a line for each paragraph; null for what is none."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "ignore")
    except Exception:
        return None
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S) or [xml]
    text = "\n".join("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in paragraphs)
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")


def docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the docx files of a folder, unreadable ones with null."""
    def run(c: pd.Series) -> pd.Series:
        return c.map(runs_of_docx)

    run.__annotations__ = {"c": pd.Series, "return": pd.Series}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.pandas_udf(run, T.StringType())("content").alias("text"))


def plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text): whole text files, bad bytes replaced."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def tab_lines(rows: DataFrame, column: str = "value") -> DataFrame:
    """(text, x, y, width, height) of tab-separated lines with exactly five parts and numbers; others are dropped."""
    p = F.split(column, "\t", -1)
    n = lambda i: F.expr(f"try_cast(split({column}, '\\t', -1)[{i}] AS DOUBLE)")
    parsed = rows.where(F.size(p) == 5).select(p[0].alias("text"), n(1).alias("x"), n(2).alias("y"), n(3).alias("width"), n(4).alias("height"))
    return parsed.where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")


def usage_counts(rows: DataFrame, column: str = "value") -> DataFrame:
    """(day, name, n) of JSON maps day -> name -> count; malformed text gives no row."""
    m = F.from_json(column, "map<string,map<string,bigint>>")
    days = rows.select(F.explode(m).alias("day", "counts"))
    return days.select(F.to_date("day").alias("day"), F.explode("counts").alias("name", "n"))


def detail_pages(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, page, block, label, text) of JSON lists of pages with text blocks; anything else gives no row."""
    schema = "array<struct<textblocks:array<struct<label:string,text:string>>>>"
    pages = rows.select(key, F.posexplode(F.from_json(column, schema)).alias("page", "p"))
    return pages.select(key, "page", F.posexplode("p.textblocks").alias("block", "b")).select(key, "page", "block", "b.label", "b.text")


def within_limits(files: DataFrame, pages: str = "page_count") -> DataFrame:
    """Files with the reason they are refused, null if they are not."""
    p = F.col(pages)
    return files.withColumn("refused", F.when(p.isNull(), "unknown").when(p <= 0, "empty").when(p > MOST_CONVERTED, "too long").when(p > MOST_PAGES, "only in parts"))
