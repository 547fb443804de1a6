"""Tables rebuilt from markup, pipes and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import cleaned, compact, joined_words

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL_ATTRS, CELL_TEXT = r"(?is)<t[dh]([^>]*)>.*?</t[dh]>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def html_cells(tables: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, row_no, cell_no, cell_text, rowspan, colspan) of tr/td markup; rows without cells are dropped and not counted."""
    span = lambda attrs, what: F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.regexp_extract(attrs, rf"(?i){what}\s*=\s*[\"']?(\d+)", 1), F.lit("999")).cast("int"), F.lit(1)))
    rows = tables.select(key, F.posexplode(F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(ROW), 1), lambda r: r.rlike(r"(?is)<t[dh][^>]*>.*?</t[dh]>"))).alias("row_no", "row"))
    pairs = F.arrays_zip(F.regexp_extract_all("row", F.lit(CELL_ATTRS), 1).alias("attrs"), F.regexp_extract_all("row", F.lit(CELL_TEXT), 1).alias("inner"))
    cells = rows.select(key, "row_no", F.posexplode(pairs).alias("cell_no", "c"))
    return cells.select(
        key, "row_no", "cell_no", cleaned(F.regexp_replace("c.inner", "<[^>]+>", "")).alias("cell_text"),
        span(F.col("c.attrs"), "rowspan").alias("rowspan"), span(F.col("c.attrs"), "colspan").alias("colspan"))


_PLACED = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("row_no", "cell_no", "r", "c")]))


def placed_cells(cells: list) -> list[dict]:
    """Grid place of each cell: a cell takes the first free column of its row; spans keep theirs."""
    taken, out, row, col = set(), [], None, 0
    for x in sorted(cells, key=lambda x: (x["row_no"], x["cell_no"])):
        if x["row_no"] != row:
            row, col = x["row_no"], 0
        while (row, col) in taken:
            col += 1
        taken.update((row + i, col + j) for i in range(x["rowspan"]) for j in range(x["colspan"]))
        out.append({"row_no": row, "cell_no": x["cell_no"], "r": row, "c": col})
        col += x["colspan"]
    return out


def html_grid(tables: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, row_no, cell_no, r, c): places of the cells; state runs over one table only."""
    import pandas as pd

    def place(cells: pd.Series) -> pd.Series:
        return cells.map(placed_cells)

    place.__annotations__ = {"cells": pd.Series, "return": pd.Series}
    packed = html_cells(tables, key, html).groupBy(key).agg(F.collect_list(F.struct("row_no", "cell_no", "rowspan", "colspan")).alias("cells"))
    return packed.select(key, F.explode(F.pandas_udf(place, _PLACED)("cells")).alias("p")).select(key, "p.*")


def pipe_tables(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_no, row_no, col_no, cell, is_header) of tables drawn with pipes.

    Lines that begin and end with a pipe are rows; a run of at least two rows is a table, a
    line of dashes marks the row before it as header (the first row else) and is no row. Short
    rows are padded. Works line by line inside each text, so no order across rows is used.
    """
    lines = docs.where(F.col(text).contains("|")).select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    is_row = (F.col("line").startswith("|")) & F.col("line").endswith("|") & (F.length("line") > 2)
    w = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("is_row", is_row).withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(w)).where("is_row")
    lines = lines.withColumn("ruler", F.col("line").rlike(r"^[|\-\s:]+$")).withColumn("ruled", F.coalesce(F.lead("ruler").over(Window.partitionBy(key, "run").orderBy("n")), F.lit(False)))
    cells = F.transform(F.slice(F.split("line", r"\|"), 2, F.size(F.split("line", r"\|")) - 2), lambda c: F.trim(c))
    rows = lines.where("NOT ruler").withColumn("cells", cells).where(F.exists("cells", lambda c: c != ""))
    run = Window.partitionBy(key, "run")
    rows = rows.withColumns({"n_rows": F.count(F.lit(1)).over(run), "n_cols": F.max(F.size("cells")).over(run), "row_no": F.row_number().over(run.orderBy("n")) - 1})
    rows = rows.withColumn("any_ruled", F.max("ruled").over(run)).where("n_rows >= 2")
    rows = rows.withColumn("table_no", F.dense_rank().over(Window.partitionBy(key).orderBy("run")) - 1)
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("n_cols"))), F.lit(1), F.col("n_cols"))
    header = F.when(F.col("any_ruled"), F.col("ruled")).otherwise(F.col("row_no") == 0)
    return rows.select(key, "table_no", "row_no", header.alias("is_header"), F.posexplode(padded).alias("col_no", "cell"))


def html_rows(html: Column) -> Column:
    """array<array<string>> of compact cell texts, as compared in scoring."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ROW), 1)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL_TEXT), 1), lambda c: compact(F.regexp_replace(c, "<[^>]+>", ""))))
    return F.filter(cells, lambda r: F.size(r) > 0)


def to_html(rows: Column) -> Column:
    """Markup of array<array<string>>; only & and < are escaped."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))


def clustered_lines(words: DataFrame, group: list[str], text: str, x: str, y: str, step: float) -> DataFrame:
    """(group, line_key, line_text): words whose height rounds to the same step, half to even, joined by place."""
    key = (F.bround(F.col(y) / step) * step).alias("line_key")
    lines = words.where(F.length(text) > 0).select(*group, key, F.struct(F.col(x).alias("x"), F.col(text).alias("t")).alias("w"))
    return lines.groupBy(*group, "line_key").agg(F.sort_array(F.collect_list("w")).alias("ws")).select(
        *group, "line_key", joined_words(F.col("ws.t")).alias("line_text"))


def column_of(x: Column, anchors: list[float]) -> Column:
    """Index of the column whose header stands nearest by midpoints; the last one beyond."""
    out = F.lit(len(anchors) - 1)
    for i in reversed(range(len(anchors) - 1)):
        out = F.when(x < (anchors[i] + anchors[i + 1]) / 2, i).otherwise(out)
    return out


def sections(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, order, section, title, text): each line with the title in force, titles left out.

    A title is forward-filled over the lines that follow; lines before any have the title null.
    """
    is_title = F.col(text).rlike("^(第[一二三四五六七八九十0-9]+[章条节]|[一二三四五]、)")
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("is_title", F.coalesce(is_title, F.lit(False)))
    return t.withColumn("section", F.count_if(F.col("is_title")).over(w)).withColumn("title", F.last(F.when(F.col("is_title"), F.substring(text, 1, 31)), True).over(w)).where(
        "NOT is_title").select(group, order, "section", "title", text)


def continued_rows(rows: DataFrame, group: str, order: str, first: str, rest: str) -> DataFrame:
    """Rows without a first cell are appended to the row before: (group, row_no, first, rest)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.length(first), F.lit(0)) > 0
    runs = rows.withColumn("row_no", F.count_if(starts).over(w)).where("row_no > 0")
    return runs.groupBy(group, "row_no").agg(F.max(first).alias(first), F.sort_array(F.collect_list(F.struct(order, F.col(rest).alias("v")))).alias("p")).select(
        group, "row_no", first, F.array_join(F.filter(F.col("p.v"), lambda v: v != ""), " ").alias(rest))


def equal_runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, value, first, last, n) of stretches of equal neighbouring values."""
    w = Window.partitionBy(group).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(group, "run", value).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")
