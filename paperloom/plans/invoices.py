"""Invoice records: typed view, votes, completion, checks, archive plan, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import money
from paperloom.functions.checksum import valid_credit_code
from paperloom.functions.money import stripped
from paperloom.functions.names import clean_name, reliable, suspicious
from paperloom.operators.repeats import archive_key, field_key, grid_key, occurrences
from paperloom.operators.vote import dominant, unanimous
from paperloom.runtime import cut, join_sized

FILLED = (
    "buyer_name", "buyer_tax", "seller_name", "seller_tax", "invoice_date", "pretax_amount", "tax_amount", "total_amount",
    "tax_rate", "invoice_type", "invoice_no", "line_items",
)
# Thresholds of the votes, (least count, least share).
MAPPING, BUYER, SELLER, VALUE = (2, 0.8), (3, 0.5), (3, 0.85), (3, 0.35)
NO_CODE = "个人无税号"
BAD_SIGNS = '[\\\\/:*?"<>|]+'


def typed(records: DataFrame) -> DataFrame:
    """Records with numbers beside their strings: pretax, tax, total, pct, is_pdf."""
    return records.withColumns({
        "pretax": money.amount(F.col("pretax_amount")), "tax": money.amount(F.col("tax_amount")), "total": money.amount(F.col("total_amount")),
        "pct": money.rate(F.col("tax_rate")), "is_pdf": F.coalesce(F.lower("original_path").endswith(".pdf"), F.lit(False))})


def amount_checks(records: DataFrame) -> DataFrame:
    """(row_id, adds_up, conflict, unusual_rate, negative): what the amounts say of each record."""
    t = typed(records)
    c = F.col
    return t.select(
        "row_id", money.adds_up(c("pretax"), c("tax"), c("total")).alias("adds_up"),
        money.conflicts(c("pretax"), c("tax"), c("total"), c("pct"), c("is_pdf")).alias("conflict"),
        F.coalesce(~c("pct").isin(*money.COMMON_RATES), F.lit(False)).alias("unusual_rate"),
        (F.coalesce(c("pretax") < 0, F.lit(False)) | F.coalesce(c("tax") < 0, F.lit(False)) | F.coalesce(c("total") < 0, F.lit(False))).alias("negative"))


def blanked(records: DataFrame) -> DataFrame:
    """Amounts and rate as stored, empty where they contradict each other."""
    t = typed(records)
    bad = money.conflicts(*(F.col(c) for c in ("pretax", "tax", "total", "pct", "is_pdf")))
    return t.select("row_id", *(F.when(bad, "").otherwise(stripped(F.col(c))).alias(c) for c in ("pretax_amount", "tax_amount", "total_amount", "tax_rate")))


def _plain(records: DataFrame) -> DataFrame:
    return records.select("row_id", "original_path", "fields_needing_review", *(stripped(F.col(c)).alias(c) for c in FILLED))


def mapping(rows: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, n, share): targets that a source names alone or nearly always."""
    pairs = rows.where((F.col(source) != "") & (F.col(target) != "")).select("row_id", F.col(source).alias("source"), F.col(target).alias("target"))
    return dominant(pairs, ["source"], ["target"], "row_id", *MAPPING, single=True)


def sound_buyers(rows: DataFrame) -> DataFrame:
    """Records with a plausible buyer name and a valid code, or the sentinel of private buyers."""
    return rows.withColumn("buyer_tax", F.upper("buyer_tax")).where(
        (F.col("buyer_name") != "") & ~suspicious(F.col("buyer_name")) & ((F.col("buyer_tax") == NO_CODE) | valid_credit_code(F.col("buyer_tax"))))


def buyer_pair(rows: DataFrame) -> DataFrame:
    """The one buyer of most records, as (buyer_name, buyer_tax, n, share); no row if none is."""
    return dominant(sound_buyers(rows), [], ["buyer_name", "buyer_tax"], "row_id", *BUYER)


def context(rows: DataFrame) -> DataFrame:
    buyer = F.when(F.col("buyer_tax") != "", F.upper("buyer_tax")).otherwise(F.col("buyer_name"))
    return rows.withColumn("ctx_buyer", buyer)


CONTEXT = ["ctx_buyer", "invoice_type", "tax_rate"]


def seller_pairs(rows: DataFrame) -> DataFrame:
    """The seller of nearly all records of a buyer, type and rate."""
    good = context(rows).withColumn("seller_tax", F.upper("seller_tax")).where(
        (F.col("ctx_buyer") != "") & (F.col("invoice_type") != "") & (F.col("tax_rate") != "")
        & (F.col("seller_name") != "") & ~suspicious(F.col("seller_name")) & valid_credit_code(F.col("seller_tax")))
    return dominant(good, CONTEXT, ["seller_name", "seller_tax"], "row_id", *SELLER)


def common_value(rows: DataFrame, field: str, least: tuple[int, float] | None = None) -> DataFrame:
    """(value, n, share) of a field if one value is common enough."""
    return dominant(rows.where(F.col(field) != "").select("row_id", F.col(field).alias("value")), [], ["value"], "row_id", *(least or VALUE))


def _fill(now: Column, needs: Column, value: Column) -> Column:
    return F.when(value.isNotNull() & needs, value).otherwise(now)


def fill_repeats(rows: DataFrame) -> DataFrame:
    """Fields that all trustworthy records of one invoice agree on, filled where blank or doubted."""
    keyed = cut(rows.withColumn("key", field_key()))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    inside = keyed.join(groups, "key", "left_semi").select("key", *(F.when(reliable(f, F.col(f)), F.col(f)).alias(f) for f in FILLED))
    agreed = cut(unanimous(inside, ["key"], list(FILLED)).withColumnsRenamed({f: f"v_{f}" for f in FILLED}))
    joined = join_sized(keyed, agreed, ["key"], "left", row_bytes=600)
    doubted = lambda f: F.coalesce(F.array_contains("fields_needing_review", f), F.lit(False))
    out = {f: _fill(F.col(f), (F.col(f) == "") | doubted(f), F.col(f"v_{f}")) for f in FILLED}
    kept = F.filter("fields_needing_review", lambda x: ~F.array_contains(F.array(*(F.when(F.col(f"v_{f}").isNotNull(), F.lit(f)).otherwise("") for f in FILLED)), x))
    return joined.withColumns({**out, "fields_needing_review": kept}).select("row_id", "original_path", "fields_needing_review", *FILLED)


def fill_parties(rows: DataFrame, side: str) -> DataFrame:
    """Codes by name and names by code, where one nearly always goes with the other."""
    name, code = f"{side}_name", f"{side}_tax"
    by_name = cut(mapping(rows, name, code)).select(F.col("source").alias(name), F.col("target").alias("v_code"))
    by_code = cut(mapping(rows, code, name)).select(F.col("source").alias("u_code"), F.col("target").alias("v_name"))
    r = join_sized(rows, by_name, [name], "left", row_bytes=120).withColumn("u_code", F.upper(code))
    r = join_sized(r, by_code, ["u_code"], "left", row_bytes=120)
    upper = F.col("u_code")
    wrong = (upper == "") | ~valid_credit_code(upper) | (upper != F.col("v_code"))
    take_code = (F.col(name) != "") & F.col("v_code").isNotNull() & wrong
    take_name = ~F.coalesce(take_code, F.lit(False)) & (upper != "") & (F.col(name) == "") & F.col("v_name").isNotNull()
    take_code, take_name = F.coalesce(take_code, F.lit(False)), F.coalesce(take_name, F.lit(False))
    gone = F.when(take_code, F.lit(code)).when(take_name, F.lit(name)).otherwise(F.lit(""))
    return r.withColumns({
        "fields_needing_review": F.array_remove("fields_needing_review", gone),
        code: F.when(take_code, F.col("v_code")).otherwise(F.col(code)), name: F.when(take_name, F.col("v_name")).otherwise(F.col(name)),
    }).drop("u_code", "v_code", "v_name")


def fill_common(rows: DataFrame) -> DataFrame:
    """The batch's dominant buyer, then the seller of the context that results."""
    doubted = lambda f: F.coalesce(F.array_contains("fields_needing_review", f), F.lit(False))
    pair = buyer_pair(rows).select(F.col("buyer_name").alias("v_name"), F.col("buyer_tax").alias("v_tax"))
    r = rows.join(F.broadcast(pair), F.lit(True), "left")  # at most one row

    def apply(r: DataFrame, side: str) -> DataFrame:
        n, t = f"{side}_name", f"{side}_tax"
        need_n, need_t = (F.col(n) == "") | doubted(n), (F.col(t) == "") | doubted(t)
        has = F.col("v_name").isNotNull()
        gone = F.array(F.when(has & need_n, n).otherwise(""), F.when(has & need_t, t).otherwise(""))
        return r.withColumns({
            "fields_needing_review": F.array_except("fields_needing_review", gone),
            n: _fill(F.col(n), need_n, F.col("v_name")), t: _fill(F.col(t), need_t, F.col("v_tax"))}).drop("v_name", "v_tax")

    r = cut(apply(r, "buyer"))
    pairs = cut(seller_pairs(r)).select(*CONTEXT, F.col("seller_name").alias("v_name"), F.col("seller_tax").alias("v_tax"))
    r = join_sized(context(r), pairs, CONTEXT, "left", row_bytes=200)
    return apply(r, "seller").drop("ctx_buyer")


def completed(records: DataFrame) -> DataFrame:
    """Records after all passes: repeats, buyer's pairs, seller's pairs, dominant buyer, seller by context.

    The order matters: later passes see the values of earlier ones. Each pass is cut, as its
    votes have to see all rows.
    """
    rows = _plain(records)
    rows = rows.withColumn("fields_needing_review", F.coalesce("fields_needing_review", F.array().cast("array<string>")))
    for f in ("buyer_name", "seller_name"):
        rows = rows.withColumn(f, clean_name(F.col(f)))
    rows = cut(fill_repeats(rows))
    for side in ("buyer", "seller"):
        rows = cut(fill_parties(rows, side))
    return fill_common(rows)


def quality_flags(rows: DataFrame) -> DataFrame:
    """Long form (row_id, field, reason) of what is missing or doubtful in each field."""
    t = typed(rows)
    say = lambda field, test, reason: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason")))
    required = [f for f in FILLED if f != "line_items"]
    flags = [say(f, stripped(F.col(f)) == "", "missing") for f in required]
    for f in ("buyer_name", "seller_name"):
        flags.append(say(f, (stripped(F.col(f)) != "") & suspicious(F.col(f)), "suspicious"))
        flags.append(say(f, (stripped(F.col("buyer_name")) != "") & (stripped(F.col("buyer_name")) == stripped(F.col("seller_name"))), "same party"))
    for f in ("buyer_tax", "seller_tax"):
        v = stripped(F.col(f))
        flags.append(say(f, (v != "") & (v != NO_CODE) & ~valid_credit_code(v), "check character"))
    for f, n in (("pretax_amount", "pretax"), ("tax_amount", "tax"), ("total_amount", "total")):
        flags.append(say(f, (stripped(F.col(f)) != "") & F.col(n).isNull(), "unreadable"))
        flags.append(say(f, F.col(n) < 0, "negative"))
        flags.append(say(f, money.differs(F.col("pretax") + F.col("tax"), F.col("total")), "sum"))
    flags.append(say("tax_rate", (stripped(F.col("tax_rate")) != "") & F.col("pct").isNull(), "unreadable"))
    flags.append(say("tax_rate", ~F.col("pct").isin(*money.COMMON_RATES), "unusual"))
    return t.select("row_id", F.explode(F.array_compact(F.array(*flags))).alias("f")).select("row_id", "f.field", "f.reason")


def swapped(rows: DataFrame, least: tuple[int, float] | None = None) -> DataFrame:
    """(row_id, by_tax, by_name): the common buyer stands on the seller's side only."""
    tax = common_value(rows, "buyer_tax", least).select(F.upper("value").alias("c_tax"))
    name = common_value(rows, "buyer_name", least).select(F.col("value").alias("c_name"))
    r = rows.join(F.broadcast(tax), F.lit(True), "left").join(F.broadcast(name), F.lit(True), "left")  # at most one row each
    by_tax = (F.upper("seller_tax") == F.col("c_tax")) & (F.upper("buyer_tax") != F.col("c_tax"))
    by_name = (F.col("seller_name") == F.col("c_name")) & (F.col("buyer_name") != F.col("c_name"))
    return r.select("row_id", F.coalesce(by_tax, F.lit(False)).alias("by_tax"), F.coalesce(by_name, F.lit(False)).alias("by_name")).where("by_tax OR by_name")


def kpis(records: DataFrame) -> DataFrame:
    """One row: records, pending, confirmed, repeats, and the total of first, confirmed records."""
    r = occurrences(typed(records), grid_key(), "row_id")
    pending = F.size(F.coalesce("fields_needing_review", F.array().cast("array<string>"))) > 0
    return r.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("confirmed"),
        F.count_if(F.col("occurrence") > 0).alias("repeats"),
        F.round(F.sum(F.when((F.col("occurrence") == 0) & ~pending, F.col("total"))), 2).alias("unique_total"))


def month(c: Column, otherwise: str) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) >= 7, F.concat(F.substring(c, 1, 4), F.lit("年"), F.substring(c, 6, 2), F.lit("月"))).otherwise(otherwise)


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, BAD_SIGNS, "_"), r"\s+", ""), 1, 180)


def archive_plan(records: DataFrame) -> DataFrame:
    """(row_id, folder, name): where each file goes; repeats get a folder and a number of their own."""
    r = occurrences(records, archive_key(), "row_id")
    or_else = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(d)
    suffix = F.lower(F.regexp_extract("original_name", r"(\.[^.]+)$", 1))
    stem = F.regexp_replace("original_name", r"\.[^.]+$", "")
    raw = F.concat(F.concat_ws("_", or_else("invoice_no", stem), or_else("buyer_name", "待确认购买方"), or_else("invoice_date", "待确认日期"),
                               F.concat(or_else("total_amount", "待确认金额"), F.lit("元"))), suffix)
    name, again = safe_name(raw), F.col("occurrence") > 0
    numbered = F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_重复"), F.col("occurrence"), F.regexp_extract(name, r"(\.[^.]+)$", 1))
    at = month(F.col("invoice_date"), "待确认月份")
    return r.select("row_id", F.when(again, F.concat(F.lit("重复发票/"), at)).otherwise(at).alias("folder"), F.when(again, numbered).otherwise(name).alias("name"))


def collision_numbers(plan: DataFrame) -> DataFrame:
    """(row_id, folder, final_name): the second file of a name in a folder gets _2, and so on."""
    stem, suffix = F.regexp_replace("name", r"\.[^.]+$", ""), F.regexp_extract("name", r"(\.[^.]+)$", 1)
    r = occurrences(plan, F.concat_ws("/", "folder", "name"), "row_id").withColumn("k", F.col("occurrence") + 1)
    return r.select("row_id", "folder", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("k"), suffix)).alias("final_name"))


REPORT = ("row_id", "archive_month", "category", "seller_name", "total_amount", "status", "archived_name", "review_summary")


def report(records: DataFrame, columns: tuple[str, ...] = REPORT) -> DataFrame:
    """Report rows and a last row with the total; unknown columns are dropped, invoice_no if none is left."""
    reasons = lambda f: F.coalesce(F.try_element_at("review_reasons", f), F.array().cast("array<string>"))
    parts = F.transform(F.array_sort("fields_needing_review"), lambda f: F.concat(f, F.lit(": "), F.when(F.size(reasons(f)) > 0, F.array_join(reasons(f), "；")).otherwise("待确认")))
    scrub = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    known = {
        "archive_month": month(F.col("invoice_date"), ""), "archived_name": F.regexp_extract(F.coalesce("archived_path", F.lit("")), r"([^/]*)$", 1),
        "review_summary": F.coalesce(F.array_join(parts, " | "), F.lit(""))}
    cols = [c for c in columns if c in known or c in records.columns] or ["invoice_no"]
    rows = records.select(F.lit(0).alias("part"), *(known.get(c, scrub(c)).alias(c) for c in cols))
    plain = F.regexp_replace(F.coalesce("total_amount", F.lit("")), ",", "")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.trim(plain).rlike(money.NUMBER), F.trim(plain).cast("double"))), 2).alias("s"))
    last = total.select(F.lit(1).alias("part"), *(
        (F.concat(F.lit("合  计（共 "), F.col("n"), F.lit(" 张）")) if i == 0 else F.format_number("s", 2) if c == "total_amount" else F.lit("")).alias(c)
        for i, c in enumerate(cols)))
    return rows.unionByName(last)


def widths(records: DataFrame, columns: tuple[str, ...], least: int = 8, most: int = 40) -> DataFrame:
    """(column_name, width): shown width of the longest value plus two, within bounds."""
    longest = records.agg(*(F.max(money.shown_width(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.least(F.lit(most), F.greatest(F.lit(least), F.col(c) + 2)).alias("width")) for c in columns))
    return longest.select(F.explode(pairs).alias("p")).select("p.column_name", "p.width")
