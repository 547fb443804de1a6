"""Recognised lines of pages: page metrics, watermarks, roles by place, routing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.money import amount
from paperloom.runtime import cut, join_sized

# How often and how short a text is to be a watermark; what each measure leaves out.
MARK_PAGES, MARK_LENGTH, MARK_COUNTED = 4, 6, 8
LEFT_OUT = {"counting": ("header", "foot", "image", "table"), "raw": ("foot", "image"), "meaningful": ("header", "foot", "image"), "no_table": ("foot", "image", "table")}
ROUTE_TEXT, ROUTE_SCAN = 0, 2
LOW_CONFIDENCE = 75


def blocks(lines: DataFrame) -> DataFrame:
    """Lines as labelled blocks: head and foot by place, tables by pipes or repeated blanks, else para."""
    label = F.when(F.col("y") >= 0.95, "header").when(F.col("y") <= 0.045, "foot").when(F.col("text").rlike(r"\|.*\||\S+( \S+){5,}$") & F.col("text").rlike("[一-鿿]"), "table").otherwise("para")
    return lines.withColumn("label", label).withColumn("clean", tx.cleaned(F.col("text")))


def keeps(measure: str) -> Column:
    return ~F.lower("label").isin(*LEFT_OUT[measure])


def repeated_marks(b: DataFrame) -> DataFrame:
    """(scan_id, mark, n): short texts that return so often in a document that they are watermarks."""
    fit = F.length("clean").between(2, MARK_COUNTED) & F.col("clean").rlike("^[一-鿿A-Za-z0-9·、，。]+$")
    counted = b.where(keeps("counting") & fit).groupBy("scan_id", F.col("clean").alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= MARK_PAGES) & (F.length("mark") <= MARK_LENGTH))


def page_metrics(lines: DataFrame) -> DataFrame:
    """(scan_id, page_no, raw_len, meaningful_len, no_table_len, n_short, mean_quality, mainly_table).

    A text that is a watermark of its document counts as noise; marks are joined back by
    (document, text), salted if they are many.
    """
    b = blocks(lines)
    marks = cut(repeated_marks(b).select("scan_id", F.col("mark").alias("clean"), F.lit(True).alias("is_mark")))
    b = join_sized(b, marks, ["scan_id", "clean"], "left", row_bytes=60)
    # computed once per block, as several measures use them
    b = b.withColumn("q", tx.quality(F.col("clean"))).withColumn("noise", F.coalesce("is_mark", F.lit(False)) | tx.is_noise(F.col("clean"), known_quality=F.col("q")))
    noise = F.col("noise")
    size = lambda keep, test, of: F.coalesce(F.sum(F.when(keep & test, F.length(of))), F.lit(0))
    content = F.col("clean") != ""
    table = F.coalesce(F.sum(F.when(F.col("label") == "table", F.length("clean"))), F.lit(0))
    other = F.coalesce(F.sum(F.when(F.col("label") == "para", F.length("clean"))), F.lit(0))
    return b.groupBy("scan_id", "page_no").agg(
        size(keeps("raw"), F.lit(True), F.trim(F.coalesce("text", F.lit("")))).alias("raw_len"),
        size(keeps("meaningful"), ~noise, "clean").alias("meaningful_len"), size(keeps("no_table"), ~noise, "clean").alias("no_table_len"),
        F.count_if(keeps("raw") & content & (F.length("clean") <= 4)).alias("n_short"),
        F.round(F.coalesce(F.avg(F.when(keeps("raw") & content, F.col("q"))), F.lit(0.0)), 6).alias("mean_quality"),
        (table > F.greatest(2 * other, F.lit(80))).alias("mainly_table"))


def dropped_blocks(lines: DataFrame) -> DataFrame:
    """(fate, n): what becomes of the blocks: header, noise, or kept."""
    b = blocks(lines).where(~F.col("label").isin("foot", "image"))
    fate = F.when(F.col("label") == "header", "header").when(tx.is_noise(F.col("clean")), "noise").otherwise("kept")
    return b.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def tier(has_text: Column, has_seal: Column) -> Column:
    """Route of a file: its text layer if there is one and no seal, recognition else."""
    return F.when(has_text & ~has_seal, ROUTE_TEXT).otherwise(ROUTE_SCAN)


def route_check(files: DataFrame) -> DataFrame:
    """Stored and computed routes by flags, with the pages that recognition bills twice."""
    t = tier(F.coalesce("has_text_layer", F.lit(False)), F.coalesce("has_red_seal", F.lit(False)))
    return files.withColumn("route", t).groupBy("tier", "route", "has_text_layer", "has_red_seal").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(F.col("route") == ROUTE_SCAN, F.col("page_count") * 2)), F.lit(0)).alias("billed"))


def near_amounts(lines: DataFrame, word: str, reach: float = 0.04) -> DataFrame:
    """(scan_id, page_no, amount): largest amount on or right of a line that holds the word, at its height.

    A band join within a page: candidates are bounded by the page's lines.
    """
    num = F.regexp_extract("text", r"[¥￥]?\s*(-?\d[\d,]*\.\d{2})", 1)
    amounts = lines.select("scan_id", "page_no", F.col("x").alias("ax"), F.col("y").alias("ay"), amount(num).alias("amount")).where("amount IS NOT NULL")
    labels = lines.where(F.col("text").contains(word)).select("scan_id", "page_no", F.col("x").alias("lx"), F.col("y").alias("ly"))
    near = labels.join(amounts, ["scan_id", "page_no"]).where((F.abs(F.col("ay") - F.col("ly")) < reach) & (F.col("ax") >= F.col("lx")))
    return near.groupBy("scan_id", "page_no").agg(F.max("amount").alias("amount"))


def nearest_label(lines: DataFrame, labels: str, values: str) -> DataFrame:
    """(line_id, label): for each line that matches ``values`` the nearest line of its page that matches ``labels``; ties by reading order."""
    v = lines.where(F.col("text").rlike(values)).select("scan_id", "page_no", "line_id", "x", "y")
    l = lines.where(F.col("text").rlike(labels)).select("scan_id", "page_no", F.col("text").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("line_idx").alias("li"))
    d = F.abs(F.col("x") - F.col("lx")) + F.abs(F.col("y") - F.col("ly"))
    return v.join(l, ["scan_id", "page_no"]).groupBy("line_id").agg(F.min_by("label", F.struct(d, F.col("li"))).alias("label"))


def parties_by_place(lines: DataFrame) -> DataFrame:
    """(scan_id, buyer_name, seller_name, buyer_tax, seller_tax, total) of one-page invoices, by region of the page."""
    left, right = F.col("x") < 0.46, F.col("x") >= 0.48
    band = F.col("y").between(0.5, 0.91)
    order = F.struct(-F.round("y", 4), F.col("x"))
    name = F.regexp_extract("text", "名称[:：]\\s*(.+)$", 1)
    code = F.upper(F.regexp_extract("text", "([0-9A-Za-z]{18})", 1))
    total = amount(F.regexp_extract("text", r"小写[)）]\s*[¥￥]?\s*(-?[\d,]+\.\d{2})", 1))
    first = lambda value, test: F.min_by(F.when(test & (value != ""), value), F.when(test & (value != ""), order))
    return lines.groupBy("scan_id").agg(
        first(name, band & left).alias("buyer_name"), first(name, band & right).alias("seller_name"),
        first(code, band & left).alias("buyer_tax"), first(code, band & right).alias("seller_tax"), F.max(total).alias("total"),
        F.max("page_no").alias("pages")).where("pages = 1 AND (buyer_name IS NOT NULL OR seller_name IS NOT NULL)").drop("pages")


def label_pairs_merged(lines: DataFrame) -> DataFrame:
    """Neighbouring lines of one height whose texts together make the label "名称", merged: (scan_id, page_no, line_idx, label)."""
    w = Window.partitionBy("scan_id", "page_no").orderBy("line_idx", "line_id")
    t = lines.withColumn("next", F.lead("text").over(w)).withColumn("ny", F.lead("y").over(w))
    pairs = t.where((F.trim("text") == "名") & F.trim("next").startswith("称") & (F.abs(F.col("y") - F.col("ny")) < 0.05))
    return pairs.select("scan_id", "page_no", "line_idx", F.concat(F.trim("text"), F.trim("next")).alias("label"))


def median_heights(lines: DataFrame) -> DataFrame:
    """(scan_id, page_no, height): upper median of the heights of a page's lines."""
    return lines.where("height IS NOT NULL").groupBy("scan_id", "page_no").agg(F.sort_array(F.collect_list("height")).alias("h")).select(
        "scan_id", "page_no", F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")).alias("height"))


def small_beside_large(boxes: DataFrame, keys: list[str], w: str, h: str, x: str, y: str, least: float, reach: float) -> DataFrame:
    """Boxes of a group without the small ones near a large one.

    A box is large if both its sides reach ``least``; a small one is left out if its centre is within
    ``reach`` of a large one's centre on both axes. Groups without large boxes stay whole, and so does
    one of which nothing else would stay (large boxes always do). Only large boxes meet small ones, in
    the cells around them, so a full group isn't compared all with all. A box without a place or size
    is neither large nor near.
    """
    cell = lambda c: F.floor(c / (reach * 1.001))  # noqa: E731  # a little wider than reach, so rounding skips no cell
    around = lambda c: F.explode(F.array(*(cell(F.col(c)) + off for off in (-1, 0, 1))))
    b = boxes.withColumn("_cx", F.col(x) + F.col(w) / 2).withColumn("_cy", F.col(y) + F.col(h) / 2)
    large = F.coalesce((F.col(w) >= least) & (F.col(h) >= least), F.lit(False))
    big = b.where(large).select(*keys, F.col("_cx").alias("_bx"), F.col("_cy").alias("_by")).distinct()
    big = big.withColumn("_gx", around("_bx")).withColumn("_gy", around("_by"))
    small = b.where(~large).withColumn("_gx", cell(F.col("_cx"))).withColumn("_gy", cell(F.col("_cy")))
    cond = (F.abs(small["_cx"] - big["_bx"]) < reach) & (F.abs(small["_cy"] - big["_by"]) < reach)
    for k in [*keys, "_gx", "_gy"]:
        cond &= small[k] == big[k]
    kept = small.join(big, cond, "left_anti").drop("_gx", "_gy")
    return b.where(large).unionByName(kept).drop("_cx", "_cy")


def confidence(words: DataFrame, keys: list[str], conf: str = "conf") -> DataFrame:
    """(keys, mean_conf, low_ratio): over words with a confidence that is not negative; 0 if none."""
    good = F.when(F.col(conf) >= 0, F.col(conf))
    return words.groupBy(*keys).agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_conf"), F.coalesce(F.avg((good < LOW_CONFIDENCE).cast("double")), F.lit(0.0)).alias("low_ratio"))


def spread_boxes(boxes: list, most: int, overlap: float = 0.42) -> list:
    """Ids of the heaviest boxes in order that don't lie on a heavier one: their middles are near on both axes."""
    kept: list = []
    for b in sorted(boxes, key=lambda b: (-b["weight"], b["id"])):
        cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
        if not any(abs(cx - k[0]) < min(b["width"], k[2]) * overlap and abs(cy - k[1]) < min(b["height"], k[3]) * overlap for k in kept):
            kept.append((cx, cy, b["width"], b["height"], b["id"]))
            if len(kept) == most:
                break
    return [k[4] for k in kept]


def largest_boxes(boxes: DataFrame, keys: list[str], id_: str, most: int) -> DataFrame:
    """(keys, id, place): the heaviest boxes of each page, those on a heavier one left out; ties by id.

    Each step depends on what was kept before, so a page is one fold; pages are the largest groups.
    """
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: spread_boxes(list(p), most))

    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    packed = boxes.groupBy(*keys).agg(F.collect_list(F.struct(F.col(id_).alias("id"), "x", "y", "width", "height", "weight")).alias("_b"))
    kind = dict(boxes.dtypes)[id_]
    return packed.select(*keys, F.posexplode(F.pandas_udf(run, f"array<{kind}>")("_b")).alias("_p", id_)).select(*keys, id_, (F.col("_p") + 1).alias("place"))
