"""Queries over ocr_lines, scan_files and documents: text, pages, tables, scores."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.functions import score, text as tx
from paperloom.functions.misc import alignment
from paperloom.operators import chunks, numbering, tables
from paperloom.plans import evaluation as ev
from paperloom.plans import layout as lo
from paperloom.runtime import cut, table

# Tables in markup and pages to name, for operators whose input no table holds.
NEAR = (("kitten", "sitting"), ("", ""), ("abc", ""), ("flaw", "lawn"), ("same text here", "same text here"))


#: Most names looked for at once.
MOST_NAMES = 10_000


def _lines(spark, d):
    return table(spark, d, "ocr_lines")


def _docs(spark, d):
    return table(spark, d, "documents")


def doc_text_quality(spark, d):
    return _docs(spark, d).select("doc_id", F.round(tx.quality(F.col("text")), 6).alias("quality"), F.round(tx.han_share(F.col("text")), 6).alias("han_share"))


def line_cleaned(spark, d):
    return _lines(spark, d).select("line_id", tx.cleaned(F.col("text")).alias("clean"))


def line_noise(spark, d):
    return _lines(spark, d).select("line_id", tx.is_noise(tx.cleaned(F.col("text"))).alias("noise"))


def doc_usable(spark, d):
    return _docs(spark, d).select("doc_id", tx.usable(F.col("text")).alias("usable"))


def page_metrics(spark, d):
    return lo.page_metrics(_lines(spark, d))


def page_marks(spark, d):
    """Short lines that return in the texts of a source, each source as one document."""
    lines = _docs(spark, d).where("source IS NOT NULL").select(F.col("source").alias("scan_id"), F.explode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("text"))
    return lo.repeated_marks(lines.withColumn("label", F.lit("para")).withColumn("clean", tx.cleaned(F.col("text"))))


def page_dropped(spark, d):
    return lo.dropped_blocks(_lines(spark, d))


def page_median_heights(spark, d):
    return lo.median_heights(_lines(spark, d))


def doc_repeated_lines(spark, d):
    """Lines that return within a document."""
    lines = _docs(spark, d).select("doc_id", F.explode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line"))
    return lines.where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def doc_pipe_tables(spark, d):
    return tables.pipe_tables(_docs(spark, d), "doc_id")


def pipe_column_shares(spark, d):
    s = ev.column_shares(tables.pipe_tables(_docs(spark, d), "doc_id"), "doc_id", "col_no", "cell")
    return s.select("doc_id", "col_no", F.round("share", 6).alias("share"))


def page_spec(spark, d):
    """A specification of pages for each scanned file, read back within its pages."""
    n = lambda k: (F.pmod("scan_id", F.lit(k)) + 1).cast("string")
    spec = F.when(F.pmod("scan_id", F.lit(11)) == 0, "x").otherwise(F.concat(n(3), F.lit(",，"), n(9), F.lit(" - "), n(4), F.lit(", "), n(13)))
    files = table(spark, d, "scan_files").select("scan_id", spec.alias("spec"), F.coalesce("page_count", F.lit(12)).cast("int").alias("total"))
    return files.select("scan_id", tx.page_numbers(F.col("spec"), F.col("total")).alias("pages"))


def line_clusters(spark, d):
    """Lines of a page whose heights fall in the same step, joined from left to right."""
    return tables.clustered_lines(_lines(spark, d).withColumn("top", (1 - F.col("y")) * 1000), ["scan_id", "page_no"], "text", "x", "top", 4.0)


def word_columns(spark, d):
    return _lines(spark, d).select("line_id", tables.column_of(F.col("x"), [0.1, 0.35, 0.55, 0.8]).alias("column_no"))


def doc_sections(spark, d):
    """Clauses of contracts: every line under its title."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line")).where(F.trim("line") != "")
    s = tables.sections(lines, "doc_id", "n", "line")
    return s.groupBy("doc_id", "section", "title").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def continued_lines(spark, d):
    """Indented lines with the lines that go on below them, by page."""
    lines = _lines(spark, d).where(F.col("text").isNotNull())
    left = F.when(F.col("x") > 0.12, F.col("text")).otherwise("")
    body = F.when(F.col("x") <= 0.12, F.col("text")).otherwise("")
    rows = lines.select(F.concat_ws("|", "scan_id", "page_no").alias("page"), "line_idx", left.alias("head"), body.alias("body"))
    return tables.continued_rows(rows, "page", "line_idx", "head", "body").select("page", "row_no", F.length("head").alias("head_chars"), F.length("body").alias("body_chars"))


def label_runs(spark, d):
    """Stretches of neighbouring lines of one height on a page."""
    lines = _lines(spark, d).select(F.concat_ws("|", "scan_id", "page_no").alias("page"), "line_id", F.round("height", 3).alias("h"))
    return tables.equal_runs(lines, "page", "line_id", "h")


def nearest_amount(spark, d):
    return lo.near_amounts(_lines(spark, d), "小写")


def nearest_label(spark, d):
    return lo.nearest_label(_lines(spark, d), "名称", "^[0-9A-Z]{18}$")


def parties_by_place(spark, d):
    return lo.parties_by_place(_lines(spark, d))


def labels_in_two_lines(spark, d):
    """Labels of scans broken after their first sign, found again as pairs of lines."""
    l = _lines(spark, d).where(F.col("text").startswith("名称")).select("scan_id", "page_no", "line_idx", "line_id", "y", "text")
    first = l.select("scan_id", "page_no", (F.col("line_idx") * 2).alias("line_idx"), "line_id", "y", F.lit("名").alias("text"))
    rest = l.select("scan_id", "page_no", (F.col("line_idx") * 2 + 1).alias("line_idx"), "line_id", (F.col("y") + 0.001).alias("y"), F.substr("text", F.lit(2)).alias("text"))
    return lo.label_pairs_merged(first.unionByName(rest))


#: Least side of a large box and reach of it, as shares of the page.
LARGE_SIDE, REACH = 0.02, 0.3


def small_beside_large(spark, d):
    """Lines of every page without the flat ones whose centre is near a higher one's."""
    return lo.small_beside_large(_lines(spark, d), ["scan_id", "page_no"], "width", "height", "x", "y", LARGE_SIDE, REACH).select("line_id")


def route_check(spark, d):
    return lo.route_check(table(spark, d, "scan_files"))


def _words(spark, d):
    """Words of lines with a stand-in for a reader's confidence: from the line's place and length, -1 if blank."""
    words = _lines(spark, d).where("text IS NOT NULL").select("scan_id", "page_no", "line_id", F.explode(F.split("text", " ")).alias("word"))
    conf = F.when(F.col("word") == "", -1.0).otherwise(F.pmod(F.col("line_id") * 7 + F.length("word") * 13, F.lit(60)) + 40.0)
    return words.withColumn("conf", conf)


def word_confidence(spark, d):
    c = lo.confidence(_words(spark, d), ["scan_id", "page_no"])
    return c.select("scan_id", "page_no", F.round("mean_conf", 6).alias("mean_conf"), F.round("low_ratio", 6).alias("low_ratio"))


def document_confidence(spark, d):
    pages = lo.confidence(_words(spark, d), ["scan_id", "page_no"])
    return pages.groupBy("scan_id").agg(F.round(F.avg("mean_conf"), 6).alias("doc_conf"))


def words_boxed(spark, d):
    """Largest boxes of each page that don't lie on a larger one, six at most."""
    l = _lines(spark, d).where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    l = l.withColumn("weight", F.round(F.col("width") * F.col("height"), 9))
    return lo.largest_boxes(l, ["scan_id", "page_no"], "line_id", 6)


def layout_likeness(spark, d):
    """Each page against the next one of its scan: paragraphs, alignment, length of text."""
    far = F.col("x") + F.col("width")
    l = _lines(spark, d).where("text IS NOT NULL").withColumn("align", alignment(F.col("x"), far, F.lit(1.0), F.col("text")))
    f = l.groupBy("scan_id", "page_no").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("text_len"), *(F.count_if(F.col("align") == a).alias(a) for a in ("left", "center", "right")))
    other = f.select("scan_id", (F.col("page_no") - 1).alias("page_no"), *(F.col(c).alias(f"o_{c}") for c in ("paragraphs", "text_len", "left", "center", "right")))
    return f.join(other, ["scan_id", "page_no"]).select("scan_id", "page_no", F.round(score.layout_similarity("", "o_"), 6).alias("likeness"))


def edit_scores(spark, d):
    """Stored texts of invoice rows against the names of the party's other records: long and short forms."""
    r = table(spark, d, "invoice_records").select("invoice_no", "row_id", F.regexp_replace("original_name", "[^0-9A-Za-z._]", "").alias("a"))
    return r.select("row_id", score.edit_score(F.col("a"), F.concat(F.lit("20240101_"), F.lpad(F.col("row_id").cast("string"), 8, "0"), F.lit(".pdf"))).alias("score"))


def edit_pairs(spark, d):
    return spark.createDataFrame(NEAR, "a string, b string").select("a", "b", score.edit_score(F.col("a"), F.col("b")).alias("score"), score.best_window_score(F.col("a"), F.col("b")).alias("window_score"))


def edit_windows(spark, d):
    """Each recognised line of an invoice's scan against the seller named in its record."""
    names = table(spark, d, "invoice_records").where("seller_name IS NOT NULL").select("row_id", "seller_name")
    scans = table(spark, d, "scan_files").select("scan_id", "row_id").join(names, "row_id").select("scan_id", "seller_name")
    lines = _lines(spark, d).where("text IS NOT NULL").select("line_id", "scan_id", "text")
    return lines.join(scans, "scan_id").select("line_id", score.best_window_score(F.col("seller_name"), F.col("text")).alias("window_score"))


def text_likeness(spark, d):
    """Each document's whole text against that of the next document of its source, by bigrams; the last of a source has none."""
    docs = _docs(spark, d).where(F.length("text") > 0)
    placed = cut(numbering.numbered_within(docs.select("doc_id", "source", "received_at"), F.col("source"), ["received_at", "doc_id"]).select("doc_id", "key", "number"))
    after = placed.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), (F.col("number") - 1).alias("before"))
    pairs = placed.join(after, F.col("key").eqNullSafe(F.col("next_key")) & (F.col("number") == F.col("before"))).select("doc_id", "next_id")
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_id")
    return both.select("doc_id", "next_id", F.round(score.text_similarity(F.col("text"), F.col("next_text")), 6).alias("likeness"))


def check_tally(spark, d):
    return ev.tally(table(spark, d, "scan_files").select(F.when(F.col("page_count").isNotNull(), F.col("has_text_layer")).alias("ok")))


def positional_match(spark, d):
    """k-th numbered line of a page with the k-th amount of it."""
    l = _lines(spark, d).where(F.col("text").rlike("^名称")).select(F.concat_ws("|", "scan_id", "page_no").alias("page"), "line_idx", "line_id")
    r = _lines(spark, d).where(F.col("text").rlike("^[0-9A-Z]{18}$")).select(F.concat_ws("|", "scan_id", "page_no").alias("page"), "line_idx", F.col("line_id").alias("code_line"))
    return ev.positional(l, r, "page", "line_idx").select("l.line_id", "r.code_line")


def style_top(spark, d):
    return ev.style_top(_lines(spark, d).where("height IS NOT NULL").withColumn("h", F.round("height", 3)).withColumn("page_kind", F.when(F.col("scan_id") == 1, "binder").otherwise("other")), "page_kind", "h", 5)


def text_chunks(spark, d):
    return chunks.line_chunks(_docs(spark, d), "doc_id").select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


def overlap_dropped(spark, d):
    parts = ((1, 0, "a\nb\nc\nd"), (1, 1, "c\nd\ne"), (1, 2, "e\nf"), (2, 0, "x"), (2, 1, "y"))
    return chunks.drop_overlap(spark.createDataFrame(parts, "doc int, part int, text string"), "doc", "part")


def best_table_match(spark, d):
    rows = ((1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.95), (1, 1, 1, 0.2), (2, 0, 0, 0.0))
    return chunks.greedy_match(spark.createDataFrame(rows, "doc int, a int, b int, score double"), "doc")


def words_in_documents(spark, d):
    """Whether a document names a category of the list: one pass with all names, whose number is checked."""
    names = [r["name"] for r in table(spark, d, "category_ref").where("name <> ''").select("name").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names to look for")
    pattern = "|".join(re.escape(n) for n in names) or "(?!)"
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.col("text").rlike(pattern).alias("names_one"))


def scans_by_record(spark, d):
    """Scans of records that are there by left semi join, those of none by left anti join."""
    s, r = table(spark, d, "scan_files").select("scan_id", "row_id"), table(spark, d, "invoice_records").where("status IS NOT NULL").select("row_id")
    return s.join(r, "row_id", "left_semi").select("scan_id", F.lit(True).alias("has_record")).unionByName(s.join(r, "row_id", "left_anti").select("scan_id", F.lit(False).alias("has_record")))


_W = r"[\s\pZ\x0b\x{85}]"
_SP = _W + "+"
# Fixed values, written out here again so that a slip in the functions shows: pieces of watermarks, misreadings.
_PIECES = ("德厚生臻子至美W*", "德厚生W*", "正德厚生?W*", "正臻子W*", "名厚生W*", '正德厚生臻子不?"?W*', "臻子至善", "李于至善", "生臻子至善", "于至善[。.]?W*", '哪生臻子不"?W*', "臻予玉W*", "臻、W*")
_MISREAD = (
    ("56生态", "5G生态"), ("勤察", "勘察"), ("粉察", "勘察"), ("勒茶", "勘察"), ("限眼同的求", "按照"), ("甲防", "甲方"), ("平方", "甲方"), ("上渣", "上海"), ("勤装", "勘察"),
    ("黑章", "盖章"), ("舍:W*公", "："), ("授校", "授权"), ("仅器", "仪器"), ("寄注", "备注"), ("个同专用章", "合同专用章"), ("[1I]硬件", "IT硬件"), (r"SU[\\／/]系统", "SDN系统"), ("报客户机", "瘦客户机"))


def _cleaned(c: str) -> str:
    """The cleaning of a one-line text as nested SQL."""
    ends = f"^{_SP}|{_SP}$"
    out = f"regexp_replace(regexp_replace(replace(coalesce({c}, ''), '　', ' '), '{ends}', '', 'g'), '^#{{1,6}}{_SP}', '')"
    for p in _PIECES:
        out = f"regexp_replace({out}, '{p.replace('W', _W)}', '', 'g')"
    for p, by in _MISREAD:
        out = f"regexp_replace({out}, '{p.replace('W', _W)}', '{by}', 'g')"
    return f"regexp_replace(regexp_replace({out}, '{_SP}', ' ', 'g'), '{ends}', '', 'g')"


_CLEAN = _cleaned("text")


def _quality(t: str) -> str:
    s = f"regexp_replace(trim({t}, ' '), '{_SP}', '', 'g')"
    pen = " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 0.18 ELSE 0 END" for w in ("臻子", "至善", "厚生", "德厚", "李于", "正德", "哪生", "名厚"))
    return f"""CASE WHEN length({s}) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (length(regexp_replace({s}, '[^一-鿿]', '', 'g')) + length(regexp_replace({s}, '[^A-Za-z0-9]', '', 'g')) * 0.85::DOUBLE) / length({s})
      - ({pen} + CASE WHEN regexp_matches({t}, '[女熊端足文]{{3,}}') THEN 0.35 ELSE 0 END + CASE WHEN length({s}) <= 3 AND NOT regexp_matches({s}, '[0-9]') THEN 0.25 ELSE 0 END)::DOUBLE)) END"""


def _noise(c: str) -> str:
    return f"""CASE WHEN {c} = '' THEN true WHEN length({c}) <= 2 AND NOT regexp_matches({c}, '[0-9]') THEN {c} NOT IN ('分值', '备注', '序号', '日期', '姓名')
      WHEN {_quality(c)} < 0.28 THEN true ELSE length({c}) <= 6 AND NOT regexp_matches({c}, '[，。；：、（）()0-9]') AND regexp_matches({c}, '臻|至善|厚生|德厚') END"""


_BLOCKS = rf"""b AS (SELECT *, {_CLEAN} AS clean, CASE WHEN y >= 0.95 THEN 'header' WHEN y <= 0.045 THEN 'foot'
  WHEN regexp_matches(text, '\|.*\||\S+( \S+){{5,}}$') AND regexp_matches(text, '[一-鿿]') THEN 'table' ELSE 'para' END AS label FROM ocr_lines)"""
_DLINES = r"SELECT doc_id, i - 1 AS n, ls[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL) t, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)"
_PIPES = rf"""WITH l AS ({_DLINES}), f AS (SELECT doc_id, n, trim(line, ' ') AS line, starts_with(trim(line, ' '), '|') AND ends_with(trim(line, ' '), '|') AND length(trim(line, ' ')) > 2 AS is_row FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(text, '|'))),
  g AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM f), h AS (SELECT *, regexp_matches(line, '^[|\-\s:]+$') AS ruler FROM g WHERE is_row),
  i AS (SELECT *, coalesce(lead(ruler) OVER (PARTITION BY doc_id, run ORDER BY n), false) AS ruled, list_transform(string_split(line, '|')[2:-2], lambda c: trim(c, ' ')) AS cells FROM h),
  j AS (SELECT *, count(*) OVER w AS n_rows, max(len(cells)) OVER w AS n_cols, row_number() OVER (PARTITION BY doc_id, run ORDER BY n) - 1 AS row_no, bool_or(ruled) OVER w AS any_ruled
    FROM i WHERE NOT ruler AND len(list_filter(cells, lambda c: c <> '')) > 0 WINDOW w AS (PARTITION BY doc_id, run)),
  k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS table_no FROM j WHERE n_rows >= 2),
  cells AS (SELECT doc_id, CAST(table_no AS INT) AS table_no, CAST(row_no AS INT) AS row_no, CASE WHEN any_ruled THEN ruled ELSE row_no = 0 END AS is_header, CAST(c AS INT) AS col_no, coalesce(cells[c + 1], '') AS cell
    FROM k, LATERAL (SELECT unnest(range(0, n_cols)) AS c))"""
_place = lambda v, side: f"arg_min(CASE WHEN band AND {side} AND {v} IS NOT NULL THEN {v} END, CASE WHEN band AND {side} AND {v} IS NOT NULL THEN o END)"
_q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_CONF = """WITH w AS (SELECT scan_id, page_no, line_id, unnest(string_split(text, ' ')) AS word FROM ocr_lines WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN word = '' THEN -1.0 ELSE (line_id * 7 + length(word) * 13) % 60 + 40.0 END AS conf FROM w),
  p AS (SELECT scan_id, page_no, coalesce(avg(CAST(conf AS DOUBLE)) FILTER (conf >= 0), 0.0) AS m, coalesce(avg(CAST(conf < 75 AS INT)::DOUBLE) FILTER (conf >= 0), 0.0) AS low FROM c GROUP BY ALL)"""
_amt = r"CAST(replace(nullif(regexp_extract(text, '[¥￥]?\s*(-?\d[\d,]*\.\d{2})', 1), ''), ',', '') AS DOUBLE)"
QUERIES = {f.__name__: f for f in (
    doc_text_quality, line_cleaned, line_noise, doc_usable, page_metrics, page_marks, page_dropped, page_median_heights, doc_repeated_lines,
    doc_pipe_tables, pipe_column_shares, page_spec, line_clusters, word_columns, doc_sections, continued_lines,
    label_runs, nearest_amount, nearest_label, parties_by_place, labels_in_two_lines, small_beside_large, route_check, word_confidence,
    document_confidence, edit_scores, edit_pairs, edit_windows, text_likeness, check_tally, positional_match,
    style_top, text_chunks, overlap_dropped, best_table_match, words_in_documents, scans_by_record, words_boxed, layout_likeness)}
ORACLE = {
    "doc_text_quality": f"SELECT doc_id, round({_quality('coalesce(text, chr(32))')}, 6) AS quality, round(CASE WHEN length(regexp_replace(coalesce(text,''), '{_SP}', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(regexp_replace(coalesce(text,''), '{_SP}', '', 'g'), '[^一-鿿]', '', 'g')) / CAST(length(regexp_replace(coalesce(text,''), '{_SP}', '', 'g')) AS DOUBLE) END, 6) AS han_share FROM documents",
    "line_cleaned": f"SELECT line_id, {_CLEAN} AS clean FROM ocr_lines",
    "line_noise": f"WITH c AS (SELECT line_id, {_CLEAN} AS clean FROM ocr_lines) SELECT line_id, {_noise('clean')} AS noise FROM c",
    "page_marks": rf"""WITH l AS (SELECT source AS scan_id, {_cleaned('line')} AS mark FROM (SELECT source, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))
      SELECT scan_id, mark, count(*) AS n FROM l WHERE length(mark) BETWEEN 2 AND 6 AND regexp_matches(mark, '^[一-鿿A-Za-z0-9·、，。]+$') GROUP BY ALL HAVING count(*) >= 4""",
    "page_metrics": f"""WITH {_BLOCKS}, m AS (SELECT scan_id, clean FROM b WHERE label NOT IN ('header','foot','image','table') AND length(clean) BETWEEN 2 AND 6 AND regexp_matches(clean, '^[一-鿿A-Za-z0-9·、，。]+$') GROUP BY ALL HAVING count(*) >= 4),
      x AS (SELECT b.*, (m.clean IS NOT NULL OR {_noise('b.clean')}) AS noise FROM b LEFT JOIN m ON m.scan_id = b.scan_id AND m.clean = b.clean)
      SELECT scan_id, page_no, CAST(coalesce(sum(length(trim(coalesce(text, ''), ' '))) FILTER (label NOT IN ('foot','image')), 0) AS BIGINT) AS raw_len,
        CAST(coalesce(sum(length(clean)) FILTER (label NOT IN ('header','foot','image') AND NOT noise), 0) AS BIGINT) AS meaningful_len,
        CAST(coalesce(sum(length(clean)) FILTER (label NOT IN ('foot','image','table') AND NOT noise), 0) AS BIGINT) AS no_table_len,
        count(*) FILTER (label NOT IN ('foot','image') AND clean <> '' AND length(clean) <= 4) AS n_short,
        round(coalesce(avg({_quality('clean')}) FILTER (label NOT IN ('foot','image') AND clean <> ''), 0.0), 6) AS mean_quality,
        coalesce(sum(length(clean)) FILTER (label = 'table'), 0) > greatest(2 * coalesce(sum(length(clean)) FILTER (label = 'para'), 0), 80) AS mainly_table FROM x GROUP BY scan_id, page_no""",
    "page_dropped": f"WITH {_BLOCKS} SELECT CASE WHEN label = 'header' THEN 'header' WHEN {_noise('clean')} THEN 'noise' ELSE 'kept' END AS fate, count(*) AS n FROM b WHERE label NOT IN ('foot','image') GROUP BY 1",
    "page_median_heights": "SELECT scan_id, page_no, list_sort(list(height))[CAST(floor(count(*) / 2) AS INT) + 1] AS height FROM ocr_lines WHERE height IS NOT NULL GROUP BY ALL",
    "doc_repeated_lines": f"SELECT doc_id, line, count(*) AS n FROM ({_DLINES}) WHERE trim(line, ' ') <> '' GROUP BY ALL HAVING count(*) > 1",
    "doc_pipe_tables": _PIPES + " SELECT * FROM cells",
    "pipe_column_shares": _PIPES + ", w AS (SELECT doc_id, col_no, sqrt(greatest(max(length(cell)), 1)) AS w FROM cells GROUP BY ALL) SELECT doc_id, col_no, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS share FROM w",
    "word_columns": "SELECT line_id, CAST(CASE WHEN x < (0.1::DOUBLE + 0.35::DOUBLE) / 2 THEN 0 WHEN x < (0.35::DOUBLE + 0.55::DOUBLE) / 2 THEN 1 WHEN x < (0.55::DOUBLE + 0.8::DOUBLE) / 2 THEN 2 ELSE 3 END AS INT) AS column_no FROM ocr_lines",
    "doc_sections": f"""WITH l AS (SELECT * FROM ({_DLINES}) WHERE trim(line, ' ') <> ''), f AS (SELECT *, regexp_matches(line, '^(第[一二三四五六七八九十0-9]+[章条节]|[一二三四五]、)') AS t FROM l),
      g AS (SELECT *, count(*) FILTER (t) OVER (PARTITION BY doc_id ORDER BY n) AS section, last_value(CASE WHEN t THEN substr(line, 1, 31) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS title FROM f)
      SELECT doc_id, section, title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM g WHERE NOT t GROUP BY ALL""",
    "continued_lines": """WITH r AS (SELECT scan_id || '|' || page_no AS page, line_idx, CASE WHEN x > 0.12 THEN text ELSE '' END AS head, CASE WHEN x <= 0.12 THEN text ELSE '' END AS body FROM ocr_lines WHERE text IS NOT NULL),
      g AS (SELECT *, count(*) FILTER (length(head) > 0) OVER (PARTITION BY page ORDER BY line_idx) AS row_no FROM r)
      SELECT page, row_no, CAST(length(max(head)) AS INT) AS head_chars, CAST(length(coalesce(string_agg(body, ' ' ORDER BY line_idx) FILTER (body <> ''), '')) AS INT) AS body_chars FROM g WHERE row_no > 0 GROUP BY ALL""",
    "label_runs": """WITH l AS (SELECT scan_id || '|' || page_no AS page, line_id, round(height, 3) AS h FROM ocr_lines), s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_id) AS a, row_number() OVER (PARTITION BY page, h ORDER BY line_id) AS b FROM l)
      SELECT page, h, min(line_id) AS first, max(line_id) AS last, count(*) AS n FROM s GROUP BY page, h, a - b""",
    "nearest_amount": f"""WITH a AS (SELECT scan_id, page_no, x AS ax, y AS ay, {_amt} AS amount FROM ocr_lines), l AS (SELECT scan_id, page_no, x AS lx, y AS ly FROM ocr_lines WHERE contains(text, '小写'))
      SELECT l.scan_id, l.page_no, max(amount) AS amount FROM l JOIN a USING (scan_id, page_no) WHERE amount IS NOT NULL AND abs(ay - ly) < 0.04 AND ax >= lx GROUP BY ALL""",
    "nearest_label": """SELECT line_id, label FROM (SELECT v.line_id, l.text AS label, row_number() OVER (PARTITION BY v.line_id ORDER BY abs(v.x - l.x) + abs(v.y - l.y), l.line_idx) AS k
      FROM ocr_lines v JOIN ocr_lines l USING (scan_id, page_no) WHERE regexp_matches(v.text, '^[0-9A-Z]{18}$') AND contains(l.text, '名称')) WHERE k = 1""",
    "labels_in_two_lines": "SELECT scan_id, page_no, CAST(line_idx * 2 AS INT) AS line_idx, '名' || substr(text, 2) AS label FROM ocr_lines WHERE starts_with(text, '名称') AND y IS NOT NULL",
    "small_beside_large": """WITH b AS (SELECT line_id, scan_id, page_no, x + width / 2 AS cx, y + height / 2 AS cy, coalesce(least(width, height) >= 0.02::DOUBLE AND width IS NOT NULL AND height IS NOT NULL, false) AS large FROM ocr_lines)
      SELECT line_id FROM b s WHERE large OR NOT EXISTS (SELECT 1 FROM b g WHERE g.large AND g.scan_id = s.scan_id AND g.page_no = s.page_no AND abs(s.cx - g.cx) < 0.3::DOUBLE AND abs(s.cy - g.cy) < 0.3::DOUBLE)""",
    "route_check": """SELECT tier, CAST(CASE WHEN coalesce(has_text_layer, false) AND NOT coalesce(has_red_seal, false) THEN 0 ELSE 2 END AS INT) AS route, has_text_layer, has_red_seal, count(*) AS files,
      CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, CAST(coalesce(sum(CASE WHEN NOT (coalesce(has_text_layer, false) AND NOT coalesce(has_red_seal, false)) THEN page_count * 2 END), 0) AS BIGINT) AS billed FROM scan_files GROUP BY ALL""",
    "word_confidence": _CONF + " SELECT scan_id, page_no, round(m, 6) AS mean_conf, round(low, 6) AS low_ratio FROM p",
    "document_confidence": _CONF + " SELECT scan_id, round(avg(m), 6) AS doc_conf FROM p GROUP BY scan_id",
    "page_spec": """WITH f AS (SELECT scan_id, CAST(coalesce(page_count, 12) AS INT) AS total, scan_id % 3 + 1 AS a, scan_id % 9 + 1 AS b, scan_id % 4 + 1 AS c, scan_id % 13 + 1 AS e FROM scan_files),
      p AS (SELECT scan_id, list_sort(list_distinct(list_transform(list_filter(list_concat([a, e], range(least(b, c), greatest(b, c) + 1)), lambda x: x <= total), lambda x: CAST(x - 1 AS INT)))) AS ps FROM f)
      SELECT scan_id, CASE WHEN scan_id % 11 = 0 OR len(ps) = 0 THEN NULL ELSE ps END AS pages FROM p""",
    "words_boxed": """WITH b AS (SELECT scan_id, page_no, line_id, x + width / 2 AS cx, y + height / 2 AS cy, width AS w, height AS h, round(width * height, 9) AS weight FROM ocr_lines WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL)
      SELECT scan_id, page_no, line_id, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, page_no ORDER BY weight DESC, line_id) AS k FROM b WHERE NOT EXISTS (SELECT 1 FROM b g WHERE g.scan_id = b.scan_id AND g.page_no = b.page_no
        AND (g.weight > b.weight OR (g.weight = b.weight AND g.line_id < b.line_id)) AND abs(g.cx - b.cx) < least(g.w, b.w) * 0.42::DOUBLE AND abs(g.cy - b.cy) < least(g.h, b.h) * 0.42::DOUBLE)) WHERE k <= 6""",
    "layout_likeness": r"""WITH l AS (SELECT scan_id, page_no, text, CASE WHEN regexp_matches(trim(text, ' '), '^甲\s*方|^乙\s*方') THEN 'left' WHEN contains(text, '服务合同') OR trim(text, ' ') = '合同' THEN 'center' WHEN w > 0.58::DOUBLE THEN 'center'
        WHEN m BETWEEN 0.36::DOUBLE AND 0.64::DOUBLE AND (w > 0.38::DOUBLE OR length(text) <= 36) THEN 'center' WHEN m >= 0.68::DOUBLE THEN 'right' ELSE 'left' END AS al
        FROM (SELECT scan_id, page_no, text, (x + (x + width)) / 2 AS m, x + width - x AS w FROM ocr_lines WHERE text IS NOT NULL)),
      f AS (SELECT scan_id, page_no, count(*) AS n, sum(length(text)) AS t, count(*) FILTER (al = 'left') AS lf, count(*) FILTER (al = 'center') AS ce, count(*) FILTER (al = 'right') AS ri FROM l GROUP BY ALL)
      SELECT a.scan_id, a.page_no, round(least(1.0, least(a.n, b.n) / CAST(greatest(a.n, b.n) AS DOUBLE) * 0.2::DOUBLE
        + greatest(0, 1 - (abs(a.lf - b.lf) + abs(a.ce - b.ce) + abs(a.ri - b.ri)) / CAST(greatest(b.lf + b.ce + b.ri, 1) AS DOUBLE)) * 0.25::DOUBLE + 0.15::DOUBLE
        + CASE WHEN a.t > 0 OR b.t > 0 THEN least(a.t, b.t) / CAST(greatest(a.t, b.t, 1) AS DOUBLE) * 0.25::DOUBLE ELSE 0 END), 6) AS likeness FROM f a JOIN f b ON a.scan_id = b.scan_id AND b.page_no = a.page_no + 1""",
    "line_clusters": r"""WITH w AS (SELECT scan_id, page_no, round_even(((1 - y) * 1000) / 4.0, 0) * 4.0 AS line_key, x, text FROM ocr_lines WHERE length(text) > 0),
      p AS (SELECT *, lag(text) OVER (PARTITION BY scan_id, page_no, line_key ORDER BY x NULLS FIRST, text) AS b FROM w),
      j AS (SELECT scan_id, page_no, line_key, trim(string_agg(CASE WHEN regexp_matches(right(b, 1), '^[\x00-\x7F]$') AND regexp_matches(text, '^[\x00-\x7F]*$') THEN ' ' || text ELSE text END, '' ORDER BY x NULLS FIRST, text), ' ') AS t FROM p GROUP BY ALL)
      SELECT scan_id, page_no, line_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([一-鿿])[\s\x0b]+([一-鿿])', '\1\2', 'g'), '([一-鿿])[\s\x0b]+([一-鿿])', '\1\2', 'g'), '([，、；：])[\s\x0b]+', '\1', 'g'), '[\s\x0b]{2,}', ' ', 'g'), ' ') AS line_text FROM j""",
    "text_likeness": r"""WITH k AS (SELECT doc_id, lead(doc_id) OVER w AS next_id, text AS a, lead(text) OVER w AS b FROM documents WHERE length(text) > 0 WINDOW w AS (PARTITION BY source ORDER BY received_at NULLS FIRST, doc_id)),
      s AS (SELECT doc_id, next_id, regexp_replace(a, '[\s\pZ\x0b\x{85}]+', '', 'g') AS x, regexp_replace(b, '[\s\pZ\x0b\x{85}]+', '', 'g') AS y FROM k WHERE next_id IS NOT NULL),
      c AS (SELECT *, string_split(x, '') AS cx, string_split(y, '') AS cy FROM s),
      g AS (SELECT doc_id, next_id, x, y, CASE WHEN length(x) > 1 THEN list_distinct(list_transform(range(1, length(x)), lambda i: cx[i] || cx[i + 1])) ELSE [x] END AS m, CASE WHEN length(y) > 1 THEN list_distinct(list_transform(range(1, length(y)), lambda i: cy[i] || cy[i + 1])) ELSE [y] END AS n FROM c),
      o AS (SELECT *, len(list_intersect(m, n)) AS shared FROM g)
      SELECT doc_id, next_id, round(CASE WHEN x = '' AND y = '' THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE greatest(CASE WHEN length(x) < length(y) AND contains(y, substr(x, 1, 40)) THEN 0.85::DOUBLE WHEN length(y) < length(x) AND contains(x, substr(y, 1, 40)) THEN 0.85::DOUBLE ELSE 0 END,
        0.5::DOUBLE * (shared / CAST(greatest(len(m) + len(n) - shared, 1) AS DOUBLE)) + 0.3::DOUBLE * (least(length(x), length(y)) / CAST(greatest(length(x), length(y)) AS DOUBLE)) + 0.2::DOUBLE * CASE WHEN substr(x, 1, 20) = substr(y, 1, 20) THEN 1 ELSE 0 END) END, 6) AS likeness FROM o""",
    "edit_scores": r"""WITH p AS (SELECT row_id, regexp_replace(original_name, '[^0-9A-Za-z._]', '', 'g') AS a, '20240101_' || lpad(CAST(row_id AS VARCHAR), 8, '0') || '.pdf' AS b FROM invoice_records)
      SELECT row_id, round_even(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END * 100, 2) AS score FROM p""",
    "doc_usable": r"""WITH k AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*!\[[^\]]*\]\([^)]+\)\s*$')), chr(10)) AS t FROM k)
      SELECT doc_id, regexp_matches(t, '(?i)<table') OR (length(trim(t, ' ')) >= 4 AND (length(regexp_replace(t, '[^一-鿿]', '', 'g')) >= 2 OR length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) >= 3)) AS usable FROM l""",
    "parties_by_place": rf"""WITH l AS (SELECT scan_id, page_no, x, y, nullif(regexp_extract(text, '名称[:：]\s*(.+)$', 1), '') AS nm, nullif(upper(regexp_extract(text, '([0-9A-Za-z]{{18}})', 1)), '') AS cd,
        CAST(replace(nullif(regexp_extract(text, '小写[)）]\s*[¥￥]?\s*(-?[\d,]+\.\d{{2}})', 1), ''), ',', '') AS DOUBLE) AS t, y BETWEEN 0.5 AND 0.91 AS band, (-round(y, 4), x) AS o FROM ocr_lines)
      SELECT scan_id, {_place('nm', 'x < 0.46')} AS buyer_name, {_place('nm', 'x >= 0.48')} AS seller_name, {_place('cd', 'x < 0.46')} AS buyer_tax, {_place('cd', 'x >= 0.48')} AS seller_tax, max(t) AS total
      FROM l GROUP BY scan_id HAVING max(page_no) = 1 AND (buyer_name IS NOT NULL OR seller_name IS NOT NULL)""",
    "edit_pairs": "SELECT a, b, score, CASE WHEN a = '' THEN 100.0 WHEN b = '' THEN 0.0 WHEN contains(b, a) THEN greatest(score, 92.0) ELSE score END AS window_score FROM (SELECT *, round_even((CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END) * 100, 2) AS score FROM (SELECT a, b FROM (VALUES "
    + ", ".join(f"({_q(a)}, {_q(b)}, {_q(a.replace(' ', ''))}, {_q(b.replace(' ', ''))})" for a, b in NEAR) + ") v(a, b, ca, cb)))",
    "check_tally": "SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS skipped FROM (SELECT CASE WHEN page_count IS NOT NULL THEN has_text_layer END AS ok FROM scan_files)",
    "positional_match": """WITH l AS (SELECT scan_id, page_no, line_id, row_number() OVER (PARTITION BY scan_id, page_no ORDER BY line_idx) AS k FROM ocr_lines WHERE starts_with(text, '名称')),
      r AS (SELECT scan_id, page_no, line_id AS code_line, row_number() OVER (PARTITION BY scan_id, page_no ORDER BY line_idx) AS k FROM ocr_lines WHERE regexp_matches(text, '^[0-9A-Z]{18}$'))
      SELECT l.line_id, r.code_line FROM l LEFT JOIN r USING (scan_id, page_no, k)""",
    "style_top": """SELECT page_kind, h, n FROM (SELECT CASE WHEN scan_id = 1 THEN 'binder' ELSE 'other' END AS page_kind, round(height, 3) AS h, count(*) AS n, row_number() OVER (PARTITION BY CASE WHEN scan_id = 1 THEN 'binder' ELSE 'other' END ORDER BY count(*) DESC, round(height, 3)) AS k
      FROM ocr_lines WHERE height IS NOT NULL GROUP BY ALL) WHERE k <= 5""".replace("GROUP BY ALL", "GROUP BY 1, 2"),
    "scans_by_record": "SELECT scan_id, EXISTS (SELECT 1 FROM invoice_records r WHERE r.row_id = s.row_id AND r.status IS NOT NULL) AS has_record FROM scan_files s",
    "words_in_documents": "SELECT doc_id, EXISTS (SELECT 1 FROM category_ref c WHERE contains(d.text, c.name)) AS names_one FROM documents d WHERE text IS NOT NULL",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
