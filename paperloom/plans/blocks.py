"""Pages as labelled blocks with tables in markup: measures, classes, and choices between readings of a table.

A page is any set of key columns; its blocks have a label, a text and, where known, a box. All
measures are sums and flags by page, so a page of a third of all blocks is aggregated in parts
before the shuffle. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.tables import pipe_tables

# Words that tell kinds of pages, headers of kinds of tables, thresholds.
CONTRACT_HINTS = ("服务合同", "甲方", "乙方", "CMCCTD", "签字/盖章", "合同专用章", "监测项目")
CHECKLIST_HINTS = ("任务清单", "考评项目", "扣分标准", "你需要做什么", "要准备的资料")
DENSE_HINTS = ("规格书", "概况", "标高", "基坑", "监测", "参数", "结构概况", "技术规格", "单体")
SCORING_HINTS = ("考评打分表", "服务管理考评", "考评得分", "扣分标准", "考评内容")
SCORING_HEADERS = ("序号", "考评内容", "分值", "扣分标准", "备注", "考评标准", "扣分", "得分")
TASK_HEADERS = ("时间", "任务名称", "你需要做什么", "要准备的资料")
RUBRIC_WORDS = ("考评打分", "扣分标准", "考评项目", "服务管理考评", "考评日期")
SEMANTIC_WORDS = ("考评", "扣分标准", "考评项目", "序号", "小计", "合计", "项目名称", "考评内容")
POOR_TABLE, FAIR_TABLE, SEMANTIC, LARGE_SHARE = 0.35, 0.5, 0.22, 0.35

TABLE = r"(?is)<table.*?</table>"
CELL = r"(?is)<t[dh]([^>]*)>(.*?)</t[dh]>"


def has_table(c: Column) -> Column:
    return F.coalesce(F.lower(c).contains("<table"), F.lit(False))


def table_markup(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_no, html) of the pipe tables of texts; equal first cells one below the other are one cell with a row span."""
    cells = pipe_tables(docs, key, text)
    rows = cells.groupBy(key, "table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "cell"))).alias("c")).select(
        key, "table_no", "row_no", F.transform("c", lambda x: x["cell"]).alias("cells"))
    w = Window.partitionBy(key, "table_no").orderBy("row_no")
    new = (F.row_number().over(w) == 1) | (F.size("cells") < 2) | (F.col("cells")[0] != F.lag(F.col("cells")[0]).over(w))
    rows = rows.withColumn("new", new).withColumn("run", F.count_if("new").over(w))
    rows = rows.withColumn("span", F.count(F.lit(1)).over(Window.partitionBy(key, "table_no", "run")))
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    td = lambda attrs, c: F.concat(F.lit("<td"), attrs, F.lit(">"), safe(c), F.lit("</td>"))
    first = F.when(F.col("new") & (F.col("span") > 1), td(F.concat(F.lit(' rowspan="'), F.col("span").cast("string"), F.lit('"')), F.col("cells")[0])).when(
        F.col("new"), td(F.lit(""), F.col("cells")[0])).otherwise("")
    rest = F.array_join(F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: td(F.lit(""), c)), "")
    rows = rows.withColumn("row", F.concat(F.lit("<tr>"), first, rest, F.lit("</tr>")))
    packed = rows.groupBy(key, "table_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "row"))).alias("r"))
    return packed.select(key, "table_no", F.concat(F.lit("<table>"), F.array_join("r.row", ""), F.lit("</table>")).alias("html"))


def document_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, text) of each text: its tables in markup, its other lines as paragraphs; blank lines are left out."""
    lines = docs.select(key, F.explode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line"))
    t = F.trim("line")
    row = t.startswith("|") & t.endswith("|") & (F.length(t) > 2)
    paras = lines.where(~row & (t != "")).select(key, F.lit("para").alias("label"), F.col("line").alias("text"))
    return paras.unionByName(table_markup(docs, key, text).select(key, F.lit("table").alias("label"), F.col("html").alias("text")))


def parsed_rows(html: Column) -> Column:
    """array<array<string>>: cleaned cell texts of one table, rows without cells left out."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(CELL), 2), lambda c: tx.cleaned(F.regexp_replace(c, "<[^>]+>", ""))))
    return F.filter(rows, lambda r: F.size(r) > 0)


def table_quality(rows: Column) -> Column:
    """Mean readability of the cells that aren't empty; 0 if there are none."""
    scores = F.transform(F.filter(F.flatten(rows), lambda c: c != ""), tx.quality)
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)


def hits(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds."""
    return sum((F.coalesce(c.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))


def best_table(detail: Column, markdown: Column, dense: Column) -> Column:
    """Of two readings of a table the more legible one; the markdown one if they are alike."""
    d, m = F.coalesce(detail, F.lit("")), F.coalesce(markdown, F.lit(""))
    dq, mq = (F.when(F.trim(x) == "", 0.0).otherwise(table_quality(parsed_rows(x))) for x in (d, m))
    return (
        F.when(F.trim(m) == "", d).when(~has_table(d), m).when(dense & (mq >= F.greatest(dq, F.lit(POOR_TABLE)) * 0.85), m)
        .when((dq < POOR_TABLE) & (mq > dq), m).when((mq < POOR_TABLE) & (dq > mq), d).when(mq > dq, m).otherwise(d))


def page_tables(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, has_table, cells, semantic, poor_table, wide_poor_table, scoring_header, task_header, table_text, first_quality) of pages with tables.

    Of the first table of a page, in the order of texts, come ``semantic`` and ``first_quality``.
    """
    t = blocks.where(has_table(F.col("text"))).select(*keys, F.col("text").alias("block"), F.explode(F.regexp_extract_all("text", F.lit(TABLE), 0)).alias("html"))
    t = t.withColumn("rows", parsed_rows(F.col("html"))).withColumn("q", table_quality(F.col("rows"))).withColumn("n_rows", F.size("rows"))
    t = t.withColumns({
        "n_cols": F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)), "said": F.array_join(F.flatten("rows"), ""),
        "cells": F.regexp_count("html", F.lit(r"(?i)<t[dh]"))})
    known = lambda r, names: F.size(F.array_intersect(r, F.lit(list(names)))) >= 2
    scoring = F.exists(F.slice("rows", 1, 3), lambda r: (F.size(r) >= 3) & known(r, SCORING_HEADERS))
    task = (F.size(F.element_at("rows", 1)) >= 3) & known(F.element_at("rows", 1), TASK_HEADERS)
    some = F.col("n_rows") > 0
    semantic = F.when(F.trim("said") == "", 0.0).otherwise(hits(F.col("said"), SEMANTIC_WORDS) / len(SEMANTIC_WORDS))
    return t.groupBy(*keys).agg(
        F.sum("cells").alias("cells"), F.min_by(semantic, "html").alias("semantic"), F.min_by("q", "html").alias("first_quality"),
        F.max(F.col("q") < POOR_TABLE).alias("poor_table"),
        F.max(some & ((F.col("q") < POOR_TABLE) | ((F.col("n_rows") >= 3) & (F.col("n_cols") >= 6) & (F.col("q") < FAIR_TABLE)))).alias("abnormal"),
        F.max(some & scoring).alias("scoring_header"), F.max(F.coalesce(some & task, F.lit(False))).alias("task_header"))


def page_stats(blocks: DataFrame, keys: list[str], marks: tuple[str, ...] = tx.STATIC_MARKS) -> DataFrame:
    """Measures of each page: lengths by kind of text, tables, watermarks, words that tell kinds of pages."""
    c = F.col
    b = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("label", F.lower(F.coalesce("label", F.lit("para"))))
    b = b.withColumns({"clean": tx.cleaned(c("text")), "tabular": has_table(c("text")), "raw": tx.stripped(c("text"))})
    mark = c("clean").isin(*marks)
    b = b.withColumn("noise", mark | tx.is_noise(c("clean")))
    size = lambda test, of: F.coalesce(F.sum(F.when(test, F.length(of))), F.lit(0))
    tabled = (c("label") == "table") | c("tabular")
    body = ~c("label").isin("header", "foot", "image")
    content = ~c("label").isin("foot", "image", "table") & (c("raw") != "")
    held = lambda words: [F.max(c("text").contains(w)) for w in words]
    count = lambda words: sum((F.coalesce(x, F.lit(False)).cast("int") for x in held(words)), F.lit(0))
    g = b.groupBy(*keys).agg(
        size(~c("label").isin("foot", "image"), "raw").alias("raw_len"), size(body & ~c("noise"), "clean").alias("meaningful_len"),
        size(~c("label").isin("foot", "image", "table") & ~c("tabular") & ~c("noise"), "clean").alias("non_table_len"),
        size(body & tabled, "text").alias("table_chars"), size(body & ~tabled, "clean").alias("other_chars"),
        F.coalesce(F.max(content & (c("raw").rlike("臻|至善|厚生|德厚|李于|正德|哪生|名厚") | mark)), F.lit(False)).alias("watermark_heavy"),
        F.max("tabular").alias("has_table"), count(CONTRACT_HINTS).alias("contract_hits"), count(SCORING_HINTS).alias("scoring_hits"),
        count(CHECKLIST_HINTS).alias("checklist_hits"), count(DENSE_HINTS).alias("dense_hits"), count(RUBRIC_WORDS).alias("rubric_hits"),
        F.max(c("text").contains("任务清单")).alias("task_list"), (F.max(c("text").contains("任务名称")) & F.max(c("text").contains("你需要做什么"))).alias("task_names"),
        F.max(c("tabular") & c("text").contains("分值")).alias("points"), F.max(c("tabular") & c("text").contains("备注")).alias("remarks"),
        size(c("tabular"), F.regexp_replace("text", "<[^>]+>", "")).alias("table_said"))
    g = g.join(page_tables(b, keys), keys, "left")
    zero = {"cells": 0, "semantic": 1.0, "first_quality": 1.0}
    flags = ("poor_table", "abnormal", "scoring_header", "task_header")
    g = g.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zero.items()} | {n: F.coalesce(n, F.lit(False)) for n in flags})
    return g.withColumn("mainly_table", c("table_chars") > F.greatest(2 * c("other_chars"), F.lit(80)))


def large_images(blocks: DataFrame, keys: list[str], width: str, height: str) -> DataFrame:
    """(keys, large_image): pages of a known size with a picture over LARGE_SHARE of it."""
    area = F.abs(F.coalesce("x1", F.lit(0.0)) - F.coalesce("x0", F.lit(0.0))) * F.abs(F.coalesce("y1", F.lit(0.0)) - F.coalesce("y0", F.lit(0.0)))
    page = F.col(width) * F.col(height)
    big = F.lower("label").isin("image", "figure", "fig") & (page > 0) & (area >= page * LARGE_SHARE)
    return blocks.groupBy(*keys).agg(F.max(F.coalesce(big, F.lit(False))).alias("large_image"))


def classes(stats: DataFrame, keys: list[str], large_image: str | None = None, signature: str | None = None) -> DataFrame:
    """Classes of pages from their measures; flags of pictures and signature pages may be given as columns."""
    c = F.col
    large = c(large_image) if large_image else F.lit(False)
    sign = c(signature) if signature else F.lit(False)
    scoring = (c("scoring_hits") >= 2) & (c("has_table") | c("mainly_table"))
    dense = scoring | ((c("checklist_hits") == 0) & (
        (c("cells") >= 12).cast("int") + c("mainly_table").cast("int") + (c("dense_hits") >= 1).cast("int") + (c("has_table") & (c("cells") >= 6)).cast("int")
        + c("poor_table").cast("int") >= 2))
    blank = F.when(c("cells") >= 8, False).when(sign, (c("meaningful_len") < 8) & ~c("has_table")).otherwise(
        ((c("meaningful_len") < 20) & (c("cells") == 0)) | (large & (c("meaningful_len") < 30)))
    rubric = (c("rubric_hits") > 0) | (c("points") & c("remarks") & (c("table_said") < 280))
    table_shot = c("has_table") & rubric & (c("semantic") < SEMANTIC)
    editable = (c("meaningful_len") >= 12) | (c("raw_len") >= 25) | (c("has_table") & (c("raw_len") >= 15))
    shot = ~table_shot & ~editable & ~(c("has_table") & (c("raw_len") >= 15)) & (c("meaningful_len") < 8) & (c("raw_len") < 18)
    return stats.select(
        *keys, (c("contract_hits") >= 2).alias("contract"), (c("task_list") | c("task_names")).alias("checklist"), scoring.alias("scoring_form"),
        dense.alias("dense_table"), c("abnormal").alias("quality_abnormal"), blank.alias("blank_risk"), table_shot.alias("needs_table_snapshot"),
        editable.alias("editable"), shot.alias("should_snapshot"), c("watermark_heavy"))
