"""Queries of field extraction, page classes and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import misc as ms
from paperloom.functions.money import amount
from paperloom.plans import extraction as ex
from paperloom.queries.pages import _CLEAN, _cleaned, _DLINES, _noise, _quality
from paperloom.queries.invoices import _amount
from paperloom.runtime import table

# Inputs no table holds.
VERSIONS = (("1.2.3", "major"), ("1.2.3", "minor"), ("1.2.3", None), ("x", "patch"), (None, "minor"))
BUILDS = (("2026.01.05.4", "2026-01-05"), ("2026.01.04.9", "2026-01-05"), (None, "2026-01-05"))
WORDS = {"text_layer": "文本层可用", "no_layer": "无文本层", "seal": "印章"}


def _lines(spark, d):
    return table(spark, d, "ocr_lines")


def invoice_fields(spark, d):
    return ex.invoice_fields(_lines(spark, d))


def invoice_fields_checked(spark, d):
    """Extracted totals against the records of the scanned files: how many agree."""
    f = ex.invoice_fields(_lines(spark, d)).select("scan_id", "no", "total")
    r = table(spark, d, "invoice_records").select("row_id", "invoice_no", amount(F.col("total_amount")).alias("stored"))
    s = table(spark, d, "scan_files").where("row_id IS NOT NULL").select("scan_id", "row_id")
    return s.join(f, "scan_id").join(r, "row_id").agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("no") == F.col("invoice_no")).alias("same_number"), F.count_if(F.col("total") == F.col("stored")).alias("same_total"))


def sections_of_parties(spark, d):
    return ex.sections_of_parties(_lines(spark, d))


def page_classes(spark, d):
    return ex.page_classes(_lines(spark, d))


def pages_to_check(spark, d):
    return ex.warned_pages(ex.page_classes(_lines(spark, d)), F.col("blank_risk") | F.col("fragmented"))


def row_heights(spark, d):
    return ex.row_heights(_lines(spark, d))


def reading_order(spark, d):
    return ex.reading_order(_lines(spark, d))


def version_bumps(spark, d):
    return spark.createDataFrame(VERSIONS, "version string, level string").select("version", "level", ms.bumped(F.col("version"), F.col("level")).alias("next_version"))


def build_numbers(spark, d):
    return spark.createDataFrame(BUILDS, "build string, today string").select("build", ms.next_build(F.col("build"), F.to_date("today")).alias("next_build"))


def cache_keys(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", ms.cache_key(F.col("text"), F.lit("zh"), F.lit("en")).alias("key"))


def document_modes(spark, d):
    return table(spark, d, "scan_files").select("scan_id", ms.document_mode(F.col("page_count")).alias("mode"))


def company_names(spark, d):
    r = table(spark, d, "invoice_records")
    names = r.select(F.col("seller_name").alias("name")).unionByName(r.select(F.col("buyer_name").alias("name"))).distinct()
    return names.select("name", ms.company_like(F.col("name")).alias("company_like"), ms.plausible_name(F.col("name")).alias("plausible"), ms.poorly_read(F.col("name")).alias("poorly_read"))


def company_chunks(spark, d):
    """Names of organisations inside documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(ms.company_chunks(F.col("text"))).alias("chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _document_rows(spark, d):
    """Lines of documents as rows of cells parted by pipes."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("cells"))


def noise_rows(spark, d):
    return _document_rows(spark, d).select("doc_id", "n", ms.noise_row(F.col("cells")).alias("noise"), ms.sheet_title(F.col("cells")[0]).alias("title"))


def padded_rows(spark, d):
    """Rows cut or filled to three cells."""
    return _document_rows(spark, d).select("doc_id", "n", F.array_join(ms.padded(F.col("cells"), 3), "|").alias("row"))


def box_corners(spark, d):
    """Corners of each line's box, clockwise, and how the line stands."""
    far_x, far_y = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    c = ms.corners(F.col("x"), F.col("y"), far_x, far_y)
    return _lines(spark, d).select("line_id", ms.alignment(F.col("x"), far_x, F.lit(1.0), F.col("text")).alias("align"), *(F.round(c[i], 9).alias(n) for i, n in enumerate(names)))


def changes_by_kind(spark, d):
    """Entries of the texts' lists under the heading in force; headings are put before each first and second entry."""
    docs = table(spark, d, "documents").where("source = 'release_notes'").select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    headed = docs.select("doc_id", F.regexp_replace("text", r"\n- (.*\n)- ", "\nAdded:\n- $1修复: ").alias("text"))
    return ex.changes_by_kind(headed, "doc_id", "text").select("doc_id", "n", "kind", "entry")


def routes_by_day(spark, d):
    return ex.log_keywords(table(spark, d, "scan_files"), WORDS, "reason", F.to_date("received_at"))


def page_plan(spark, d):
    return ex.page_plan(table(spark, d, "scan_files"), F.lit("1,3-4"), F.lit(450))


def amount_table(spark, d):
    return ex.amounts_by_place(_lines(spark, d))


def party_lines(spark, d):
    """Lines of documents that name both parties; a line's place stands for its box."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("n", "line"))
    docs = docs.withColumn("y0", F.col("n") * 20.0).withColumn("y1", F.col("n") * 20.0 + 15.0)
    return ex.party_lines(docs, ["doc_id", "n"], "line", "y0", "y1")


def sentence_blocks(spark, d):
    """Three blocks of each document, by their lengths."""
    b = ex.sentence_blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ("head", "body", "end"))
    return b.select("doc_id", "kind", F.length("block").alias("chars"), F.md5("block").alias("digest"))


def log_exams(spark, d):
    """The log lines that the scanned files would leave, read back."""
    line = F.concat(F.lit("info PDF体检: tier="), "tier", F.lit(" reason="), F.coalesce("reason", F.lit("")), F.when(F.col("page_count").isNotNull(), F.concat(F.lit(" pages="), "page_count")).otherwise(""))
    return ex.log_exams(table(spark, d, "scan_files").select(line.alias("line")), "line")


QUERIES = {f.__name__: f for f in (
    amount_table, party_lines, sentence_blocks, log_exams, invoice_fields, invoice_fields_checked, sections_of_parties, page_classes, pages_to_check, row_heights, reading_order, version_bumps, build_numbers,
    cache_keys, document_modes, company_names, company_chunks, noise_rows, padded_rows, box_corners, changes_by_kind, routes_by_day, page_plan)}
_first = lambda v, t, o="page_no, line_idx, line_id": f"arg_min(CASE WHEN {t} THEN {v} END, CASE WHEN {t} THEN ({o}) END)"
_q = lambda s: "NULL" if s is None else f"'{s}'"
_side = lambda side, v: f"arg_min(CASE WHEN side = '{side}' AND length({v}) >= 2 THEN {v} END, CASE WHEN side = '{side}' AND length({v}) >= 2 THEN (line_idx, line_id) END)"
_DATE = r"regexp_extract(text, '(20\d{{2}})年\s*(\d{{1,2}})月\s*(\d{{1,2}})', {})"
_YMD = f"{_DATE.format(1)} || '-' || lpad({_DATE.format(2)}, 2, '0') || '-' || lpad({_DATE.format(3)}, 2, '0')"
_SPACED = r"\b(20\d{2})\s+(0?[1-9]|1[0-2])\s+(0?[1-9]|[12]\d|3[01])\b"
_SPACED_DAY = f"regexp_extract(text, '{_SPACED}', 1) || '-' || lpad(regexp_extract(text, '{_SPACED}', 2), 2, '0') || '-' || lpad(regexp_extract(text, '{_SPACED}', 3), 2, '0')"
_LAB, _LOOSE = r"regexp_extract(text, '发票号码[:：]\s*(\d{8,24})', 1)", r"regexp_extract(text, '(?:^|\D)(\d{8,24})(?:\D|$)', 1)"
_MON = r"CAST(replace(nullif(regexp_extract(text, '[¥￥]\s*(-?\d[\d,]*\.\d{2})', 1), ''), ',', '') AS DOUBLE)"
_RATE = r"regexp_extract(text, '(\d{1,2})\s*%', 1)"
_FIELDS = rf"""f AS (SELECT scan_id, coalesce({_first(_YMD, _DATE.format(0) + " <> ''")}, {_first(_SPACED_DAY, f"regexp_matches(text, '{_SPACED}')")}) AS day, {_first(_LAB, _LAB + " <> ''")} AS labelled,
  {_first(_LOOSE, f"y > 0.86 AND y < 0.98 AND {_LOOSE} <> ''", "abs(y - 0.90), page_no, line_idx, line_id")} AS loose, bool_or(contains(text, '电子发票')) AS el, bool_or(regexp_matches(text, '专用|支用|索用')) AS sp,
  bool_or(regexp_matches(text, '普通发票|普票')) AS od, bool_or(contains(text, '增值税')) AS vat, {_first(_RATE + " || '%'", _RATE + " <> ''")} AS rate,
  {_first(r"regexp_replace(trim(text, ' '), '\s+', '', 'g')", "contains(text, '*') AND length(trim(text, ' ')) > 4")} AS item, max({_MON}) AS total FROM ocr_lines WHERE text IS NOT NULL GROUP BY scan_id),
  x AS (SELECT scan_id, max(a) AS tax FROM (SELECT scan_id, {_MON} AS a FROM ocr_lines) l JOIN f USING (scan_id) WHERE a > 0 AND a < total * 0.2::DOUBLE GROUP BY scan_id),
  fields AS (SELECT scan_id, day, coalesce(labelled, loose) AS no, CASE WHEN sp THEN '增值税专用发票' WHEN od THEN '增值税普通发票' WHEN el OR length(coalesce(labelled, loose)) >= 20 THEN '增值税电子发票' WHEN vat THEN '增值税普通发票' END AS kind,
    rate, item, total, tax, round(total - tax, 2) AS pretax FROM f LEFT JOIN x USING (scan_id))"""
_any = lambda p: f"bool_or(regexp_matches(text, '{p}'))"
_SCORE = "n + 8 * (" + " + ".join(f"s{i}" for i in range(len(ex.SIGNALS))) + ") + 2 * orgs + 2 * digits"
_CLASSES = rf"""WITH c AS (SELECT *, {_CLEAN} AS clean FROM ocr_lines WHERE text IS NOT NULL), q AS (SELECT *, {_quality('clean')} AS q, {_noise('clean')} AS noise FROM c),
  g AS (SELECT scan_id, page_no, count(*) AS n, {", ".join(f"CAST({_any(s)} AS INT) AS s{i}" for i, s in enumerate(ex.SIGNALS))}, count(*) FILTER (regexp_matches(text, '{ex.ORGS}')) AS orgs,
    count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, sum(length(text)) AS chars, sum(length(regexp_replace(text, '[^一-鿿]', '', 'g'))) AS han, sum(length(regexp_replace(text, '\s', '', 'g'))) AS solid,
    sum(length(regexp_replace(text, '[^一-鿿0-9A-Za-z]', '', 'g'))) AS meaning, count(*) FILTER (regexp_matches(text, '[\x00-\x08\x0e-\x1f]')) AS control, {_any(ex.SIGN_PAGE)} AS is_sign, {_any(ex.SIGN_HINT)} AS hint,
    {_any('甲方')} AS a, {_any('乙方')} AS b, {_any(ex.SIGNED)} AS signed, {_any('签字|盖章|合同专用章|甲方|乙方')} AS sig_like, {_any('第[一二三四五六七八九十0-9]+条')} AS clause,
    count(*) FILTER (clean <> '' AND length(clean) <= 4) AS short, count(*) FILTER (clean <> '') AS texts, avg(q) FILTER (clean <> '') AS mean, coalesce(sum(length(clean)) FILTER (NOT noise), 0) AS meaningful FROM q GROUP BY scan_id, page_no),
  h AS (SELECT *, max(page_no) OVER (PARTITION BY scan_id) - page_no AS back, {_SCORE} AS score FROM g),
  i AS (SELECT *, coalesce(CASE WHEN is_sign THEN true WHEN hint THEN back < 3 ELSE back < 2 AND a AND b AND signed END, false) AS signature FROM h),
  classes AS (SELECT scan_id, page_no, CAST(score AS BIGINT) AS score, score >= 46 OR (score >= 36 AND digits > 0 AND chars > 80 AND orgs > 0) AS good,
    chars >= 100 AND n >= 8 AND control = 0 AND meaning / CAST(greatest(chars, 1) AS DOUBLE) >= 0.35::DOUBLE AS accepted, chars = 0 OR (solid > 20 AND han / CAST(greatest(solid, 1) AS DOUBLE) < 0.35::DOUBLE) AS low_quality, signature,
    coalesce(CASE WHEN texts = 0 THEN false WHEN NOT sig_like AND mean >= 0.42::DOUBLE THEN false WHEN sig_like AND short >= 3 AND short >= floor(texts * 0.25::DOUBLE) THEN true
      WHEN short >= greatest(3, floor(texts * 0.32::DOUBLE)) AND mean < 0.42::DOUBLE THEN true WHEN mean < 0.38::DOUBLE THEN true ELSE sig_like AND NOT clause AND short >= 2 AND mean < 0.55::DOUBLE END, false) AS fragmented,
    CASE WHEN signature THEN meaningful < 8 ELSE meaningful < 20 END AS blank_risk, meaningful >= 12 OR chars >= 25 AS editable FROM i)"""
_RECT = lambda col, box: "NULL" if box is None else f"arg_min(CASE WHEN mx BETWEEN {box[0]}::DOUBLE AND {box[1]}::DOUBLE AND my BETWEEN {box[2]}::DOUBLE AND {box[3]}::DOUBLE THEN {col} END, CASE WHEN {col} IS NOT NULL AND mx BETWEEN {box[0]}::DOUBLE AND {box[1]}::DOUBLE AND my BETWEEN {box[2]}::DOUBLE AND {box[3]}::DOUBLE THEN (round(abs(mx - ({box[0]}::DOUBLE + {box[1]}::DOUBLE) / 2) + abs(my - ({box[2]}::DOUBLE + {box[3]}::DOUBLE) / 2), 9), line_idx, line_id) END)"
_PLACES = (((0.66, 0.80, 0.30, 0.36), (0.86, 0.98, 0.30, 0.36), (0.72, 0.88, 0.23, 0.31)), ((0.62, 0.74, 0.43, 0.50), (0.90, 0.99, 0.43, 0.50), (0.62, 0.78, 0.18, 0.24)),
           ((0.62, 0.76, 0.15, 0.22), (0.88, 0.99, 0.15, 0.22), (0.70, 0.84, 0.10, 0.16)), ((0.68, 0.80, 0.48, 0.64), (0.88, 0.98, 0.48, 0.64), None))
_ANY_OF = lambda n: "coalesce(" + ", ".join(f"CASE WHEN p{i} IS NOT NULL OR t{i} IS NOT NULL THEN {n}{i} END" for i in range(4)) + ")"
_WORDS = ", ".join(f"count(*) FILTER (regexp_matches(reason, '{p}')) AS {n}" for n, p in WORDS.items())
ORACLE = {
    "amount_table": rf"""WITH l AS (SELECT *, x + width / 2 AS mx, y + height / 2 AS my, CAST(replace(nullif(regexp_extract(trim(text, ' '), '(?:¥|￥)?\s*(-?\d{{1,8}}(?:,\d{{3}})*(?:\.\d{{2}}))', 1), ''), ',', '') AS DOUBLE) AS v,
        nullif(regexp_extract(trim(text, ' '), '(?:^|\D)(\d{{1,2}})\s*%', 1), '') || '%' AS p FROM ocr_lines WHERE length(trim(text, ' ')) > 0),
      g AS (SELECT scan_id, page_no, {", ".join(f"CAST({_RECT('v', box)} AS DOUBLE) AS {n}{i}" for i, boxes in enumerate(_PLACES) for n, box in zip("ptx", boxes))}, {_RECT('p', (0.76, 0.86, 0.48, 0.64))} AS ra, {_RECT('p', (0.70, 0.90, 0.42, 0.70))} AS rb FROM l GROUP BY ALL),
      o AS (SELECT scan_id, page_no, {_ANY_OF('p')} AS pretax, {_ANY_OF('t')} AS tax, {_ANY_OF('x')} AS total, coalesce(ra, rb) AS rate FROM g) SELECT * FROM o WHERE pretax IS NOT NULL OR tax IS NOT NULL OR total IS NOT NULL OR rate IS NOT NULL""",
    "party_lines": rf"""WITH l AS (SELECT doc_id, CAST(n AS INT) AS n, list_filter(list_transform(string_split(regexp_replace(line, '(甲\s*方|乙\s*方)', chr(1) || '\1', 'g'), chr(1)), lambda c: trim(c, ' ')), lambda c: regexp_matches(c, '^(甲\s*方|乙\s*方)')) AS p FROM ({_DLINES}) WHERE regexp_matches(line, '甲\s*方'))
      SELECT doc_id, n, CAST(i - 1 AS INT) AS part, p[i] AS text, n * 20.0::DOUBLE + floor(15.0::DOUBLE * ((i - 1) / CAST(len(p) AS DOUBLE))) AS y0, n * 20.0::DOUBLE + floor(15.0::DOUBLE * (i / CAST(len(p) AS DOUBLE))) AS y1 FROM l, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) WHERE len(p) >= 2""",
    "sentence_blocks": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), '　', ' '), '56生态', '5G生态'), '勤察|粉察', '勘察', 'g'), 'CNCCT[BD]-SS', 'CMCCTD-SS', 'g'), '&lt;', '<'), '[\s\pZ\x0b\x{85}]+', ' ', 'g'), ' ') AS t FROM documents),
      s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([。；;！!？?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ')), lambda p: p <> '') AS ps FROM t),
      k AS (SELECT *, len(ps) AS n, greatest(1, len(ps) // 3) AS sh FROM s), b AS (SELECT doc_id, kind, coalesce(CASE WHEN n >= 3 THEN array_to_string(ps[i * sh + 1 : CASE WHEN i < 2 THEN (i + 1) * sh ELSE n END], ' ') ELSE ps[i + 1] END, '') AS block FROM k, (VALUES (0, 'head'), (1, 'body'), (2, 'end')) v(i, kind))
      SELECT doc_id, kind, CAST(length(block) AS INT) AS chars, md5(block) AS digest FROM b""",
    "log_exams": "SELECT tier, count(*) AS n, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, round(avg(page_count), 6) AS mean_pages, CAST(coalesce(sum(CASE WHEN tier = 2 AND page_count > 0 THEN page_count * 2 END), 0) AS BIGINT) AS billed FROM scan_files GROUP BY tier",
    "invoice_fields": f"WITH {_FIELDS} SELECT * FROM fields",
    "invoice_fields_checked": f"WITH {_FIELDS} SELECT count(*) AS scans, count(*) FILTER (f.no = r.invoice_no) AS same_number, count(*) FILTER (f.total = {_amount('r.total_amount')}) AS same_total FROM scan_files s JOIN fields f ON f.scan_id = s.scan_id JOIN invoice_records r ON r.row_id = s.row_id",
    "version_bumps": "SELECT version, level, CASE WHEN NOT regexp_matches(v, '^\\d+\\.\\d+\\.\\d+$') THEN '0.0.1' WHEN l = 'major' THEN (p[1] + 1) || '.0.0' WHEN l = 'minor' THEN p[1] || '.' || (p[2] + 1) || '.0' ELSE p[1] || '.' || p[2] || '.' || (p[3] + 1) END AS next_version "
    "FROM (SELECT version, level, coalesce(version, '0.0.0') AS v, coalesce(level, 'patch') AS l, list_transform(string_split(coalesce(version, '0.0.0'), '.'), lambda x: try_cast(x AS INT)) AS p FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in VERSIONS) + ") w(version, level))",
    "build_numbers": "SELECT build, d || '.' || CASE WHEN starts_with(coalesce(build, ''), d || '.') THEN CAST(substr(build, length(d) + 2) AS INT) + 1 ELSE 1 END AS next_build FROM (SELECT build, replace(today, '-', '.') AS d FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in BUILDS) + ") w(build, today))",
    "sections_of_parties": rf"""WITH l AS (SELECT *, trim(text, ' ') AS t, CASE WHEN regexp_matches(trim(text, ' '), '{ex.BUYER}') THEN 'buyer' WHEN regexp_matches(trim(text, ' '), '{ex.SELLER}') THEN 'seller' END AS head FROM ocr_lines WHERE length(trim(text, ' ')) > 0),
      m AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY scan_id, page_no ORDER BY line_idx, line_id) AS side, regexp_replace(regexp_extract(t, '{ex.NAME}', 1), '[\s\pZ]+', '', 'g') AS nm,
        CASE WHEN regexp_matches(t, '纳税人识别号|统一社会信用代码|税号|^[A-Z0-9]{{15,20}}$') THEN upper(regexp_extract(t, '{ex.CODE}', 1)) ELSE '' END AS cd FROM l),
      p AS (SELECT scan_id, page_no, {_side('buyer', 'nm')} AS buyer_name, {_side('buyer', 'cd')} AS buyer_tax, {_side('seller', 'nm')} AS sn, {_side('seller', 'cd')} AS st FROM m WHERE head IS NULL AND side IS NOT NULL GROUP BY ALL)
      SELECT scan_id, page_no, buyer_name, buyer_tax, CASE WHEN NOT coalesce(sn = buyer_name, false) THEN sn END AS seller_name, CASE WHEN NOT coalesce(st = buyer_tax, false) THEN st END AS seller_tax FROM p""",
    "page_classes": _CLASSES + " SELECT * FROM classes",
    "pages_to_check": _CLASSES + " SELECT scan_id, string_agg('第' || page_no || '页', '、' ORDER BY page_no) AS pages FROM classes WHERE blank_risk OR fragmented GROUP BY scan_id",
    "row_heights": "SELECT line_id, round(y - lead(y) OVER (PARTITION BY scan_id, page_no ORDER BY y DESC, x NULLS FIRST, line_id), 6) AS gap FROM ocr_lines WHERE y IS NOT NULL",
    "reading_order": "SELECT line_id, CAST(row_number() OVER (PARTITION BY scan_id, page_no ORDER BY coalesce(y, 0) DESC, coalesce(x, 0), line_id) AS INT) AS place FROM ocr_lines",
    "cache_keys": "SELECT doc_id, sha1(text || '|zh|en') AS key FROM documents WHERE text IS NOT NULL",
    "document_modes": "SELECT scan_id, CASE WHEN page_count <= 30 THEN 'hybrid' ELSE 'text' END AS mode FROM scan_files",
    "company_names": rf"""WITH w AS (SELECT name, coalesce(name, '') AS t FROM (SELECT seller_name AS name FROM invoice_records UNION SELECT buyer_name FROM invoice_records))
      SELECT name, length(t) >= 4 AND t NOT IN ('公司', '有限公司', '有限责任公司', '股份有限公司', '研究院', '分院', '中心', '银行', '学校', '单位') AND NOT regexp_matches(t, '^[0-9A-Za-z]+$')
          AND NOT regexp_matches(t, '开户银行|银行账号|收款人|复核人') AND regexp_matches(t, '公司|研究院|勘察院|中心|银行|学校|单位|个体工商户|商行|店|厂') AS company_like,
        length(t) BETWEEN 3 AND 80 AND NOT regexp_matches(t, '统一社会信用|纳税人识别|开户银行|银行账号|项目名称') AND length(regexp_replace(t, '[^一-鿿]', '', 'g')) >= 3 AS plausible,
        contains(t, '|') OR regexp_matches(t, '[\x{{8A9E}}\x{{6CE1}}\x{{5920}}\x{{8A3B}}\x{{67D4}}\x{{8A02}}\x{{8BA2}}\x{{5F8C}}\x{{9894}}\x{{6F3F}}]') AS poorly_read FROM w""",
    "box_corners": r"""SELECT line_id, CASE WHEN regexp_matches(trim(t, ' '), '^甲\s*方|^乙\s*方') THEN 'left' WHEN contains(t, '服务合同') OR trim(t, ' ') = '合同' THEN 'center' WHEN w > 0.58::DOUBLE THEN 'center'
        WHEN m BETWEEN 0.36::DOUBLE AND 0.64::DOUBLE AND (w > 0.38::DOUBLE OR length(t) <= 36) THEN 'center' WHEN m >= 0.68::DOUBLE THEN 'right' ELSE 'left' END AS align,
      round(a, 9) AS ax, round(b, 9) AS ay, round(c, 9) AS bx, round(b, 9) AS by, round(c, 9) AS cx, round(e, 9) AS cy, round(a, 9) AS dx, round(e, 9) AS dy
      FROM (SELECT line_id, coalesce(text, '') AS t, (x + (x + width)) / 2 AS m, x + width - x AS w, coalesce(x, 0) AS a, coalesce(y, 0) AS b, coalesce(x + width, coalesce(x, 0) + 10) AS c, coalesce(y + height, coalesce(y, 0) + 10) AS e FROM ocr_lines)""",
    "noise_rows": rf"""WITH r AS (SELECT doc_id, CAST(n AS INT) AS n, list_transform(string_split(line, '|'), lambda c: trim(c, ' ')) AS cs FROM ({_DLINES})), t AS (SELECT *, trim(array_to_string(cs, ''), ' ') AS t,
        substr(trim(regexp_replace(string_split(cs[1], '□')[1], '[/\\*?:\[\]]', ' ', 'g'), ' '), 1, 31) AS h FROM r)
      SELECT doc_id, n, t = '' OR regexp_matches(t, '^(一、|二、|三、|四、|五、|□|注：|安全类资料|平安类资料|项目级资料)') OR regexp_matches(t, 'F:[\\/]') OR (length(cs[1]) > 35 AND len(list_filter(cs[2:], lambda x: x <> '')) = 0) AS noise,
        CASE WHEN regexp_matches(cs[1], '^(一、|二、|三、|四、|五、)') THEN CASE WHEN h = '' THEN '数据' ELSE h END END AS title FROM t""",
    "padded_rows": rf"""WITH r AS (SELECT doc_id, CAST(n AS INT) AS n, list_transform(string_split(line, '|'), lambda c: trim(c, ' ')) AS cs FROM ({_DLINES}))
      SELECT doc_id, n, cs[1] || '|' || coalesce(cs[2], '') || '|' || coalesce(cs[3], '') AS row FROM r""",
    "changes_by_kind": r"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n- (.*\n)- ', E'\nAdded:\n- \\1修复: ', 'g') AS text FROM documents WHERE source = 'release_notes' AND text IS NOT NULL),
      l AS (SELECT doc_id, CAST(i - 1 AS INT) AS n, trim(ls[i], ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM h) t, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
      k AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(fixed|修复):') THEN 'fixed' WHEN regexp_matches(line, '(?i)^(changed|变更):') THEN 'changed' WHEN regexp_matches(line, '(?i)^(added|新增):') THEN 'added' END AS head FROM l WHERE line <> ''),
      f AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 'changed') AS kind FROM k),
      e AS (SELECT doc_id, n, kind, CASE WHEN head IS NOT NULL THEN trim(regexp_extract(line, '^[^:]*:(.*)$', 1), ' ') WHEN regexp_matches(line, '^[-*]') THEN trim(regexp_replace(line, '^[-* ]+', ''), ' ') END AS entry FROM f)
      SELECT * FROM e WHERE entry <> ''""",
    "routes_by_day": f"SELECT CAST(received_at AS DATE) AS day, {_WORDS} FROM scan_files GROUP BY 1",
    "page_plan": "SELECT scan_id, CAST(p AS INT) AS page, CAST(90 AS INT) AS rotation FROM scan_files, (VALUES (0), (2), (3)) v(p) WHERE page_count > p",
}
