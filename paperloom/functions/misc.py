"""Small rules: versions, keys, plausibility of texts, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and ends of organisations, words that only labels hold, glyphs of poor readings.
ORG_WORDS = ("公司", "研究院", "勘察院", "中心", "银行", "学校", "单位", "个体工商户", "商行", "店", "厂")
ORG_ALONE = ("公司", "有限公司", "有限责任公司", "股份有限公司", "研究院", "分院", "中心", "银行", "学校", "单位")
BANK_WORDS = ("开户银行", "银行账号", "收款人", "复核人")
LABELS = ("统一社会信用", "纳税人识别", "开户银行", "银行账号", "项目名称")
POOR_GLYPHS = "語泡夠註柔訂订後颔漿"
ORG_END = (
    r"(?:有限责任公司|股份有限公司|有限公司|分公司|(?:研究院|勘察院)(?![^，,;；]{0,12}(?:分院|有限公司|有限责任公司|股份有限公司))"
    r"|分院|商行|中心|银行|学校|单位|店(?:[（(]个体工商户[）)])?|厂)"
)
TITLE_MARKS = ("一、", "二、", "三、", "四、", "五、")
NOISE_STARTS = ("□", "注：", "安全类资料", "平安类资料", "项目级资料")
MOST_HYBRID = 30


def bumped(version: Column, level: Column) -> Column:
    """Next version of major.minor.patch; 0.0.1 if it is none."""
    v = F.trim(F.coalesce(version, F.lit("0.0.0")))
    part = lambda i: F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    l = F.lower(F.coalesce(level, F.lit("patch")))
    dotted = lambda *p: F.concat_ws(".", *(x.cast("string") for x in p))
    nxt = F.when(l == "major", dotted(part(1) + 1, F.lit(0), F.lit(0))).when(l == "minor", dotted(part(1), part(2) + 1, F.lit(0))).otherwise(dotted(part(1), part(2), part(3) + 1))
    return F.when(v.rlike(r"^\d+\.\d+\.\d+$"), nxt).otherwise("0.0.1")


def next_build(current: Column, today: Column) -> Column:
    """today.n: one more than the current build of the same day, else 1."""
    day = F.date_format(today, "yyyy.MM.dd")
    n = F.regexp_extract(F.trim(F.coalesce(current, F.lit(""))), r"^(\d{4}\.\d{2}\.\d{2})\.(\d+)$", 2)
    same = F.regexp_extract(F.trim(F.coalesce(current, F.lit(""))), r"^(\d{4}\.\d{2}\.\d{2})\.(\d+)$", 1) == day
    return F.concat(day, F.lit("."), F.when(same, n.cast("int") + 1).otherwise(1).cast("string"))


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def document_mode(pages: Column) -> Column:
    return F.when(pages <= MOST_HYBRID, "hybrid").otherwise("text")


def company_like(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return (F.length(t) >= 4) & ~t.isin(*ORG_ALONE) & ~t.rlike("^[0-9A-Za-z]+$") & ~t.rlike("|".join(BANK_WORDS)) & t.rlike("|".join(ORG_WORDS))


def plausible_name(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.length(t).between(3, 80) & ~t.rlike("|".join(LABELS)) & (F.length(F.regexp_replace(t, "[^一-鿿]", "")) >= 3)


def company_chunks(c: Column) -> Column:
    """Names of organisations in a run of text, up to their ends.

    The text is parted at the marks no name holds first, so the search never runs over more.
    """
    pieces = F.filter(F.split(F.coalesce(c, F.lit("")), "[，,;；]"), lambda x: x.rlike("|".join(ORG_WORDS)))
    found = F.flatten(F.transform(pieces, lambda x: F.regexp_extract_all(x, F.lit(f"(.+?{ORG_END})"), 1)))
    return F.filter(F.transform(found, lambda x: F.trim(x)), company_like)


def poorly_read(c: Column) -> Column:
    return F.coalesce(c.contains("|") | c.rlike(f"[{POOR_GLYPHS}]"), F.lit(False))


def sheet_title(c: Column) -> Column:
    """Title of a section line, safe as a sheet's name; null if the line is no title."""
    t = F.trim(F.regexp_replace(F.split(c, "□")[0], r"[/\\*?:\[\]]", " "))
    cut = F.substring(t, 1, 31)
    return F.when(c.rlike("^(" + "|".join(TITLE_MARKS) + ")"), F.when(cut == "", "数据").otherwise(cut))


def noise_row(cells: Column) -> Column:
    """True for a table row of section marks, boilerplate, paths, or one long first cell."""
    t = F.trim(F.array_join(cells, ""))
    rest_empty = ~F.exists(F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1))), lambda x: x != "")
    return (t == "") | t.rlike("^(" + "|".join(TITLE_MARKS + NOISE_STARTS) + ")") | t.rlike(r"F:[\\/]") | ((F.length(cells[0]) > 35) & rest_empty)


def padded(cells: Column, n: int) -> Column:
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Eight numbers of a box's corners, clockwise from the upper left; a missing far side is ten away."""
    a, b = F.coalesce(x0, F.lit(0.0)), F.coalesce(y0, F.lit(0.0))
    c, d = F.coalesce(x1, a + 10), F.coalesce(y1, b + 10)
    return F.array(a, b, c, b, c, d, a, d)


def alignment(x0: Column, x1: Column, page: Column, text: Column) -> Column:
    """center, right or left of a block by its text, width and middle."""
    t = F.coalesce(text, F.lit(""))
    middle, width = (x0 + x1) / 2 / page, (x1 - x0) / page
    return (
        F.when(F.trim(t).rlike(r"^甲\s*方|^乙\s*方"), "left").when(t.contains("服务合同") | (F.trim(t) == "合同"), "center")
        .when(width > 0.58, "center").when(middle.between(0.36, 0.64) & ((width > 0.38) | (F.length(t) <= 36)), "center")
        .when(middle >= 0.68, "right").otherwise("left"))
