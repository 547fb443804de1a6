"""Text of recognised blocks: cleaning, quality, noise; page ranges; joining of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short texts that stay although short; pieces of watermarks; lists for quality.
KEPT_SHORT = ("分值", "备注", "序号", "日期", "姓名")
MARK_PIECES = ("臻子", "至善", "厚生", "德厚", "李于", "正德", "哪生", "名厚")
MARK_HINTS = ("臻", "至善", "厚生", "德厚")
MARKS = (
    r"德厚生臻子至美\s*", r"德厚生\s*", r"正德厚生?\s*", r"正臻子\s*", r"名厚生\s*", r"正德厚生臻子不?\"?\s*", "臻子至善", "李于至善", "生臻子至善",
    r"于至善[。.]?\s*", r"哪生臻子不\"?\s*", r"臻予玉\s*", r"臻、\s*",
)
STATIC_MARKS = (
    "臻子至善", "李于至善", "生臻子至善", "德厚生臻子至美", "德厚生臻子", "正德厚生", "正德厚生臻子", "哪生臻子", "臻予玉", "想", "于至善", "厚",
    "正德厚生臻子不", "生牛", "器", "德厚生", "名厚生",
)
# Misreadings of scanned pages and what they stand for, applied in this order.
FIXES = (
    ("56生态", "5G生态"), ("勤察", "勘察"), ("粉察", "勘察"), ("勒茶", "勘察"), ("限眼同的求", "按照"), ("甲防", "甲方"), ("平方", "甲方"), ("上渣", "上海"),
    ("勤装", "勘察"), ("黑章", "盖章"), (r"舍:\s*公", "："), ("授校", "授权"), ("仅器", "仪器"), ("寄注", "备注"), ("个同专用章", "合同专用章"),
    ("[1I]硬件", "IT硬件"), (r"SU[\\／/]系统", "SDN系统"), ("报客户机", "瘦客户机"),
)
SIGN_WORDS = ("签字", "盖章", "签章", "日期", "甲方", "乙方", "合同专用章", "授权代表", "法定代表人", "第八条", "第九条", "签字页", "签章页")
EVAL_MARKS = "(臻子至善|李于至善|德厚生|正德厚生|哪生臻子|名厚生|于至善|厚生臻子|德厚|正德)"
LOW_QUALITY = 0.28
IMAGE_LINK = r"!\[[^\]]*\]\([^)]+\)"
SPACE = r"(?U)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Patterns replaced one after the other; texts without any of them are passed by."""
    def each(t: Column) -> Column:
        out = t
        for pattern, by in pairs:
            out = F.regexp_replace(out, "(?U)" + pattern, by)
        return F.when(t.rlike("(?U)" + "|".join(p for p, _ in pairs)), out).otherwise(t)

    return let(c, each)


def cleaned(c: Column) -> Column:
    """One-line text without heading marks and pieces of watermarks, known misreadings put right; null counts as empty."""
    plain = stripped(F.translate(F.coalesce(c, F.lit("")), "　", " "))
    headless = let(plain, lambda t: F.when(t.startswith("#"), F.regexp_replace(t, r"(?U)^#{1,6}\s+", "")).otherwise(t))
    fixed = replaced(replaced(headless, tuple((m, "") for m in MARKS)), FIXES)
    return stripped(F.regexp_replace(fixed, SPACE, " "))


def compact(c: Column) -> Column:
    """Text without white space and watermark phrases, as compared in scoring."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, ""), EVAL_MARKS, "")


def _count(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", ""))


def han_share(c: Column) -> Column:
    """Share of ideographs among characters that aren't blank; 0 for blank."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")
    return F.when(F.length(t) == 0, 0.0).otherwise(_count(t, "一-鿿") / F.length(t))


def quality(c: Column) -> Column:
    """Readability between 0 and 1: ideographs and alphanumerics, less penalties; 1 for blank."""
    def of(t: Column, s: Column) -> Column:
        base = (_count(s, "一-鿿") + _count(s, "A-Za-z0-9") * 0.85) / F.length(s)
        pieces = sum((F.when(t.contains(w), 0.18).otherwise(0.0) for w in MARK_PIECES), F.lit(0.0))
        penalty = F.when(t.rlike("|".join(MARK_PIECES)), pieces).otherwise(0.0)
        penalty += F.when(t.rlike("[女熊端足文]{3,}"), 0.35).otherwise(0.0) + F.when((F.length(s) <= 3) & ~s.rlike("[0-9]"), 0.25).otherwise(0.0)
        return F.when(F.length(s) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)))

    return let(F.trim(F.coalesce(c, F.lit(""))), lambda t: let(F.regexp_replace(t, SPACE, ""), lambda s: of(t, s)))


def is_noise(text: Column, marks: Column | None = None, signature: Column | None = None, known_quality: Column | None = None) -> Column:
    """True for a cleaned text without content; signature pages keep more. ``known_quality`` saves computing it again."""
    sig = F.lit(False) if signature is None else signature

    def of(t: Column) -> Column:
        wanted = sig & t.rlike("|".join(SIGN_WORDS)) & (F.length(t) >= 3)
        in_marks = F.lit(False) if marks is None else F.coalesce(F.array_contains(marks, t), F.lit(False))
        short = (F.length(t) <= 2) & ~t.rlike("[0-9]")
        poor = (quality(t) if known_quality is None else known_quality) < LOW_QUALITY
        spared = sig & (F.length(t) >= 6) & t.rlike("[一-鿿]{2,}")
        phrase = (F.length(t) <= 6) & ~t.rlike("[，。；：、（）()0-9]") & t.rlike("|".join(MARK_HINTS))
        return (
            F.when(t == "", True).when(wanted, False).when(in_marks, True)
            .when(short, ~t.isin(*KEPT_SHORT)).when(poor, ~spared).otherwise(phrase)
        )

    return let(text, of)


def usable(c: Column) -> Column:
    """True if a block has a table, or text beyond links to images."""
    t = F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: ~x.rlike(rf"^\s*{IMAGE_LINK}\s*$")), "\n")
    enough = (F.length(F.trim(t)) >= 4) & ((_count(t, "一-鿿") >= 2) | (_count(t, "A-Za-z0-9") >= 3))
    return t.rlike("(?i)<table") | enough


def join_cjk(c: Column) -> Column:
    """Blanks between ideographs and after full-width marks dropped, others single."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[一-鿿])\s+(?=[一-鿿])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([，、；：])\s+", "$1"), r"\s{2,}", " "))


def joined_words(words: Column) -> Column:
    """Words in order as one line: a blank only between two ASCII neighbours."""
    ascii_end = lambda s: F.right(s, F.lit(1)).rlike(r"^[\x00-\x7F]$")
    ascii_all = lambda s: s.rlike(r"^[\x00-\x7F]*$")
    line = F.aggregate(words, F.lit(""), lambda a, w: F.when(a == "", w).when(ascii_end(a) & ascii_all(w), F.concat(a, F.lit(" "), w)).otherwise(F.concat(a, w)))
    return join_cjk(F.trim(line))


def page_numbers(spec: Column, total: Column) -> Column:
    """Sorted distinct 0-based pages of "1,3，7-5" within 1..total; null if none or malformed."""
    parts = F.filter(F.transform(F.split(F.translate(spec, "，", ","), ","), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda s: F.try_to_number(F.trim(s), F.lit("9999999")).cast("int")
    ends = F.transform(parts, lambda p: F.struct(
        number(F.split(p, "-", 2)[0]).alias("a"), F.when(p.contains("-"), number(F.try_element_at(F.split(p, "-", 2), F.lit(2)))).otherwise(number(p)).alias("b")))
    bad = F.exists(ends, lambda e: e["a"].isNull() | e["b"].isNull())
    low = lambda e: F.greatest(F.least(e["a"], e["b"]), F.lit(1))
    high = lambda e: F.least(F.greatest(e["a"], e["b"]), total)
    pages = F.flatten(F.transform(F.filter(ends, lambda e: low(e) <= high(e)), lambda e: F.sequence(low(e), high(e))))
    got = F.array_sort(F.array_distinct(F.transform(pages, lambda p: p - 1)))
    return F.when(~F.coalesce(bad, F.lit(True)) & (F.size(got) > 0), got)
