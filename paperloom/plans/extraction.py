"""Fields of scanned invoices from their lines, and classes of pages.

Every field is a first, last or nearest match taken by an aggregate over lines, so no scan is
gathered in one task, however long. Ties go to the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import is_noise, cleaned, quality

# Wordings on invoices, and thresholds of the readings' quality.
SIGNALS = ("名称", "纳税人识别号", "统一社会信用代码", "发票号码", "开票日期", "合计", "税率", "税额", "价税合计")
ORGS = "公司|研究院|分院|银行|商行|店|厂"
BUYER, SELLER = "^(?:购|买方信息|购货单位)", "^(?:销|售方信息|销货单位)"
NAME, CODE = r"(?:名\s*称|名|称|桥|社|祢|林|抬头)\s*[:：]\s*(.+)", r"(?i)([A-Z0-9]{15,20})"
GOOD, FAIR = 46, 36
LOW_HAN, LONG, LOW_CONF = 0.35, 20, 0.04
SIGN_PAGE, SIGN_HINT, SIGNED = "签章页|签字页", "签字/盖章|合同专用章", "日期|盖章|签字|签章"


def invoice_fields(lines: DataFrame) -> DataFrame:
    """(scan_id, day, no, kind, rate, item, total, tax, pretax) of each scan's lines; null where nothing is found."""
    order = F.struct("page_no", "line_idx", "line_id")
    t = F.col("text")
    date = F.regexp_extract(t, r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})", 0)
    ymd = F.concat_ws("-", F.regexp_extract(t, r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})", 1),
                      *(F.lpad(F.regexp_extract(t, r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})", i), 2, "0") for i in (2, 3)))
    # digits parted by blanks, looked at if no line has a written date
    spaced = r"\b(20\d{2})\s+(0?[1-9]|1[0-2])\s+(0?[1-9]|[12]\d|3[01])\b"
    apart = F.concat_ws("-", F.regexp_extract(t, spaced, 1), *(F.lpad(F.regexp_extract(t, spaced, i), 2, "0") for i in (2, 3)))
    labelled = F.regexp_extract(t, r"发票号码[:：]\s*(\d{8,24})", 1)
    loose = F.regexp_extract(t, r"(?:^|\D)(\d{8,24})(?:\D|$)", 1)
    near = (F.col("y") > 0.86) & (F.col("y") < 0.98) & (loose != "")
    rate = F.regexp_extract(t, r"(\d{1,2})\s*%", 1)
    item = t.contains("*") & (F.length(F.trim(t)) > 4)
    money = F.regexp_extract(t, r"[¥￥]\s*(-?\d[\d,]*\.\d{2})", 1)
    amount = F.when(money != "", F.translate(money, ",", "").cast("double"))
    first = lambda value, test, by=order: F.min_by(F.when(test, value), F.when(test, by))
    f = lines.where("text IS NOT NULL").groupBy("scan_id").agg(
        F.coalesce(first(ymd, date != ""), first(apart, t.rlike(spaced))).alias("day"), first(labelled, labelled != "").alias("labelled"),
        first(loose, near, F.struct(F.abs(F.col("y") - 0.90), "page_no", "line_idx", "line_id")).alias("loose"),
        F.max(t.contains("电子发票")).alias("electronic"), F.max(t.rlike("专用|支用|索用")).alias("special"), F.max(t.rlike("普通发票|普票")).alias("ordinary"),
        F.max(t.contains("增值税")).alias("vat"), first(F.concat(rate, F.lit("%")), rate != "").alias("rate"),
        first(F.regexp_replace(F.trim(t), r"\s+", ""), item).alias("item"), F.max(amount).alias("total"))
    no = F.coalesce("labelled", "loose")
    kind = F.when(F.col("special"), "增值税专用发票").when(F.col("ordinary"), "增值税普通发票").when(F.col("electronic") | (F.length(no) >= 20), "增值税电子发票").when(F.col("vat"), "增值税普通发票")
    # the largest amount under a fifth of the total is the tax
    amounts = lines.select("scan_id", amount.alias("a")).where("a > 0")
    tax = amounts.join(f.select("scan_id", "total"), "scan_id").where("a < total * 0.2").groupBy("scan_id").agg(F.max("a").alias("tax"))
    return f.join(tax, "scan_id", "left").select(
        "scan_id", "day", no.alias("no"), kind.alias("kind"), "rate", "item", "total", "tax", F.round(F.col("total") - F.col("tax"), 2).alias("pretax"))


def sections_of_parties(lines: DataFrame) -> DataFrame:
    """(scan_id, page_no, buyer_name, buyer_tax, seller_name, seller_tax): first values under each party's heading.

    A heading holds for the lines below it on its page. A seller equal to the buyer is left out.
    """
    w = Window.partitionBy("scan_id", "page_no").orderBy("line_idx", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("text")
    head = F.when(t.rlike(BUYER), "buyer").when(t.rlike(SELLER), "seller")
    l = lines.where(F.length(t) > 0).withColumn("head", head).withColumn("side", F.last("head", True).over(w)).where("head IS NULL AND side IS NOT NULL")
    name = F.regexp_replace(F.regexp_extract(t, NAME, 1), r"(?U)\s+", "")
    code = F.when(t.rlike("纳税人识别号|统一社会信用代码|税号|^[A-Z0-9]{15,20}$"), F.upper(F.regexp_extract(t, CODE, 1))).otherwise("")
    order = F.struct("line_idx", "line_id")
    first = lambda side, v: F.min_by(F.when((F.col("side") == side) & (F.length(v) >= 2), v), F.when((F.col("side") == side) & (F.length(v) >= 2), order))
    p = l.groupBy("scan_id", "page_no").agg(*(first(s, v).alias(f"{s}_{n}") for s in ("buyer", "seller") for n, v in (("name", name), ("tax", code))))
    apart = lambda n: F.when(~F.coalesce(F.col(f"seller_{n}") == F.col(f"buyer_{n}"), F.lit(False)), F.col(f"seller_{n}")).alias(f"seller_{n}")
    return p.select("scan_id", "page_no", "buyer_name", "buyer_tax", apart("name"), apart("tax"))


def page_classes(lines: DataFrame) -> DataFrame:
    """(scan_id, page_no, score, good, accepted, low_quality, signature, fragmented, blank_risk, editable) of each page."""
    t = F.col("text")
    clean = cleaned(t)
    l = lines.where("text IS NOT NULL").withColumn("clean", clean)
    l = l.withColumns({"q": quality(F.col("clean"))}).withColumn("noise", is_noise(F.col("clean"), known_quality=F.col("q")))
    any_of = lambda pattern: F.max(t.rlike(pattern))
    content = F.col("clean") != ""
    chars = F.sum(F.length(t))
    han = F.sum(F.length(F.regexp_replace(t, "[^一-鿿]", "")))
    solid = F.sum(F.length(F.regexp_replace(t, r"\s", "")))
    meaning = F.sum(F.length(F.regexp_replace(t, "[^一-鿿0-9A-Za-z]", "")))
    g = l.groupBy("scan_id", "page_no").agg(
        F.count(F.lit(1)).alias("n"), *(any_of(s).cast("int").alias(f"s{i}") for i, s in enumerate(SIGNALS)),
        F.count_if(t.rlike(ORGS)).alias("orgs"), F.count_if(t.rlike("[0-9]")).alias("digits"), chars.alias("chars"), han.alias("han"), solid.alias("solid"), meaning.alias("meaning"),
        F.count_if(t.rlike(r"[\x00-\x08\x0e-\x1f]")).alias("control"), any_of(SIGN_PAGE).alias("is_sign"), any_of(SIGN_HINT).alias("hint"),
        any_of("甲方").alias("a"), any_of("乙方").alias("b"), any_of(SIGNED).alias("signed"), any_of("签字|盖章|合同专用章|甲方|乙方").alias("sig_like"),
        any_of("第[一二三四五六七八九十0-9]+条").alias("clause"), F.count_if(content & (F.length("clean") <= 4)).alias("short"), F.count_if(content).alias("texts"),
        F.avg(F.when(content, F.col("q"))).alias("mean"), F.coalesce(F.sum(F.when(~F.col("noise"), F.length("clean"))), F.lit(0)).alias("meaningful"))
    last = g.groupBy("scan_id").agg(F.max("page_no").alias("last_page"))
    g = g.join(last, "scan_id")
    score = F.col("n") + 8 * sum((F.col(f"s{i}") for i in range(len(SIGNALS))), F.lit(0)) + 2 * F.col("orgs") + 2 * F.col("digits")
    c = F.col
    back = c("last_page") - c("page_no")
    signature = F.when(c("is_sign"), True).when(c("hint"), back < 3).otherwise((back < 2) & c("a") & c("b") & c("signed"))
    fragmented = (
        F.when(c("texts") == 0, False).when(~c("sig_like") & (c("mean") >= 0.42), False)
        .when(c("sig_like") & (c("short") >= 3) & (c("short") >= F.floor(c("texts") * 0.25)), True)
        .when((c("short") >= F.greatest(F.lit(3), F.floor(c("texts") * 0.32))) & (c("mean") < 0.42), True)
        .when(c("mean") < 0.38, True).otherwise(c("sig_like") & ~c("clause") & (c("short") >= 2) & (c("mean") < 0.55)))
    return g.select(
        "scan_id", "page_no", score.cast("long").alias("score"),
        ((score >= GOOD) | ((score >= FAIR) & (c("digits") > 0) & (c("chars") > 80) & (c("orgs") > 0))).alias("good"),
        ((c("chars") >= 100) & (c("n") >= 8) & (c("control") == 0) & (c("meaning") / F.greatest(c("chars"), F.lit(1)) >= LOW_HAN)).alias("accepted"),
        ((c("chars") == 0) | ((c("solid") > LONG) & (c("han") / F.greatest(c("solid"), F.lit(1)) < LOW_HAN))).alias("low_quality"),
        F.coalesce(signature, F.lit(False)).alias("signature"), F.coalesce(fragmented, F.lit(False)).alias("fragmented"),
        F.when(signature, c("meaningful") < 8).otherwise(c("meaningful") < 20).alias("blank_risk"), ((c("meaningful") >= 12) | (c("chars") >= 25)).alias("editable"))


def warned_pages(classes: DataFrame, test: Column) -> DataFrame:
    """(scan_id, pages): sorted page numbers of a file that need a look, joined."""
    return classes.where(test).groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page_no")), lambda p: F.concat(F.lit("第"), p.cast("string"), F.lit("页"))), "、").alias("pages"))


def row_heights(lines: DataFrame) -> DataFrame:
    """(line_id, gap): distance to the next line below on the page; null for the last."""
    w = Window.partitionBy("scan_id", "page_no").orderBy(F.desc("y"), "x", "line_id")
    return lines.where("y IS NOT NULL").select("line_id", F.round(F.col("y") - F.lead("y").over(w), 6).alias("gap"))


def reading_order(lines: DataFrame) -> DataFrame:
    """(line_id, place): place on the page from top to bottom and left to right; missing coordinates count as zero."""
    w = Window.partitionBy("scan_id", "page_no").orderBy(F.desc(F.coalesce("y", F.lit(0.0))), F.coalesce("x", F.lit(0.0)), "line_id")
    return lines.select("line_id", F.row_number().over(w).alias("place"))


def changes_by_kind(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, entry): entries of release notes under the heading in force, "changed" before any."""
    lines = notes.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("n", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    heads = {"added": "added|新增", "changed": "changed|变更", "fixed": "fixed|修复"}
    kind = F.lit(None).cast("string")
    for k, pattern in heads.items():
        kind = F.when(F.col("line").rlike(f"(?i)^({pattern}):"), k).otherwise(kind)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    l = lines.withColumn("head", kind).withColumn("kind", F.coalesce(F.last("head", True).over(w), F.lit("changed")))
    own = F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    entry = F.when(F.col("head").isNotNull(), own).when(F.col("line").rlike("^[-*]"), F.trim(F.regexp_replace("line", "^[-* ]+", "")))
    return l.select(key, "n", "kind", entry.alias("entry")).where("entry <> ''")


def log_keywords(lines: DataFrame, words: dict[str, str], text: str, day: Column) -> DataFrame:
    """(day, one count per word): lines that match each pattern by day."""
    return lines.groupBy(day.alias("day")).agg(*(F.count_if(F.coalesce(F.col(text).rlike(p), F.lit(False))).alias(n) for n, p in words.items()))


def page_plan(files: DataFrame, spec: Column, turn: Column) -> DataFrame:
    """(scan_id, page, rotation): kept pages of each file with the rotation modulo a full turn."""
    from paperloom.functions.text import page_numbers

    pages = files.where("page_count > 0").select("scan_id", F.explode(F.coalesce(page_numbers(spec, F.col("page_count")), F.sequence(F.lit(0), F.col("page_count") - 1))).alias("page"))
    return pages.select("scan_id", "page", F.pmod(turn, F.lit(360)).alias("rotation"))


#: Rectangles (left, right, bottom, top) of an invoice's amounts: before tax, tax, total, in four layouts; then of the rate.
LAYOUTS = (
    ((0.66, 0.80, 0.30, 0.36), (0.86, 0.98, 0.30, 0.36), (0.72, 0.88, 0.23, 0.31)),
    ((0.62, 0.74, 0.43, 0.50), (0.90, 0.99, 0.43, 0.50), (0.62, 0.78, 0.18, 0.24)),
    ((0.62, 0.76, 0.15, 0.22), (0.88, 0.99, 0.15, 0.22), (0.70, 0.84, 0.10, 0.16)),
    ((0.68, 0.80, 0.48, 0.64), (0.88, 0.98, 0.48, 0.64), None),
)
RATE_PLACES = ((0.76, 0.86, 0.48, 0.64), (0.70, 0.90, 0.42, 0.70))


def amounts_by_place(lines: DataFrame) -> DataFrame:
    """(scan_id, page_no, pretax, tax, total, rate) by the rectangles that the middles of lines fall into.

    In each rectangle the value nearest to its middle counts, ties by reading order; the layouts are
    tried in order for what is still missing, one without amount and tax gives no total.
    """
    t = F.trim("text")
    number = F.regexp_extract(t, r"(?:¥|￥)?\s*(-?\d{1,8}(?:,\d{3})*(?:\.\d{2}))", 1)
    value = F.when(number != "", F.translate(number, ",", "").cast("double"))
    percent = F.regexp_extract(t, r"(?:^|\D)(\d{1,2})\s*%", 1)
    l = lines.where(F.length(t) > 0).select(
        "scan_id", "page_no", "line_idx", "line_id", value.alias("v"), F.when(percent != "", F.concat(percent, F.lit("%"))).alias("p"),
        (F.col("x") + F.col("width") / 2).alias("mx"), (F.col("y") + F.col("height") / 2).alias("my")).where("v IS NOT NULL OR p IS NOT NULL")

    def pick(name: str, box: tuple | None) -> Column:
        if box is None:
            return F.lit(None)
        a, b, c, e = box
        test = F.col("mx").between(a, b) & F.col("my").between(c, e) & F.col(name).isNotNull()
        far = F.abs(F.col("mx") - (a + b) / 2) + F.abs(F.col("my") - (c + e) / 2)
        return F.min_by(F.when(test, F.col(name)), F.when(test, F.struct(F.round(far, 9), "line_idx", "line_id")))

    picked = l.groupBy("scan_id", "page_no").agg(
        *(pick("v", box).cast("double").alias(f"l{i}_{n}") for i, boxes in enumerate(LAYOUTS) for n, box in zip(("pretax", "tax", "total"), boxes)),
        *(pick("p", box).alias(f"r{i}") for i, box in enumerate(RATE_PLACES)))
    known = lambda i: F.col(f"l{i}_pretax").isNotNull() | F.col(f"l{i}_tax").isNotNull()
    return picked.select(
        "scan_id", "page_no", *(F.coalesce(*(F.when(known(i), F.col(f"l{i}_{n}")) for i in range(len(LAYOUTS)))).alias(n) for n in ("pretax", "tax", "total")),
        F.coalesce("r0", "r1").alias("rate")).where("pretax IS NOT NULL OR tax IS NOT NULL OR total IS NOT NULL OR rate IS NOT NULL")


def party_lines(texts: DataFrame, keys: list[str], text: str, top: str, bottom: str) -> DataFrame:
    """(keys, part, text, y0, y1): lines that name several parties parted before each one, their boxes in equal shares."""
    pieces = F.filter(F.transform(F.split(text, "(?=甲\\s*方|乙\\s*方)"), lambda c: F.trim(c)), lambda c: c.rlike("^(甲\\s*方|乙\\s*方)"))
    t = texts.where(F.col(text).rlike("甲\\s*方")).withColumn("_p", pieces).where(F.size("_p") >= 2).withColumn("_n", F.size("_p"))
    high = F.greatest(F.col(bottom) - F.col(top), F.lit(1.0))
    t = t.select(*keys, F.col(top).alias("_a"), high.alias("_h"), "_n", F.posexplode("_p").alias("part", "text"))
    at = lambda i: F.col("_a") + F.floor(F.col("_h") * (i / F.col("_n")))
    return t.select(*keys, "part", "text", at(F.col("part")).alias("y0"), at(F.col("part") + 1).alias("y1"))


def sentence_blocks(texts: DataFrame, key: str, text: str, kinds: tuple[str, ...]) -> DataFrame:
    """(key, kind, block): sentences of a text shared out to kinds of blocks in order, equally, the last one takes the rest."""
    fixes = (("56生态", "5G生态"), ("勤察|粉察", "勘察"), ("CNCCT[BD]-SS", "CMCCTD-SS"), ("&lt;", "<"))
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "　", " ")
    for pattern, by in fixes:
        plain = F.regexp_replace(plain, pattern, by)
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(plain, r"(?<=[。；;！!？?])\s*"), lambda p: F.trim(p)), lambda p: p != "")
    n, k = F.size("parts"), len(kinds)
    share = F.greatest(F.lit(1), F.floor(n / k).cast("int"))
    block = lambda i: F.when(n >= k, F.array_join(F.slice("parts", i * share + 1, share if i < k - 1 else F.greatest(n - i * share, F.lit(0))), " ")).otherwise(
        F.coalesce(F.try_element_at("parts", F.lit(i + 1)), F.lit("")))
    t = texts.select(key, parts.alias("parts"))
    return t.select(key, F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), block(i).alias("block")) for i, name in enumerate(kinds)))).alias("b")).select(key, "b.kind", "b.block")


def log_exams(lines: DataFrame, text: str) -> DataFrame:
    """(tier, n, pages, mean_pages, billed): what log lines say of examined files; recognised pages are billed twice."""
    t = lines.where(F.col(text).contains("PDF体检")).select(
        F.regexp_extract(text, r"tier=(\d+)", 1).cast("int").alias("tier"), F.regexp_extract(text, r"pages=(\d+)", 1).alias("p"))
    pages = F.when(F.col("p") != "", F.col("p").cast("bigint"))
    return t.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(pages), F.lit(0)).alias("pages"), F.round(F.avg(pages), 6).alias("mean_pages"),
        F.coalesce(F.sum(F.when((F.col("tier") == 2) & (pages > 0), pages * 2)), F.lit(0)).alias("billed"))
