"""Queries of pages as blocks: documents with their tables in markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import score, text as tx
from paperloom.operators import tables
from paperloom.plans import blocks as bl
from paperloom.plans import evaluation as ev
from paperloom.plans import layout as lo
from paperloom.queries.pages import _cleaned, _noise, _PIPES, _quality, _SP
from paperloom.runtime import cut, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _markup(spark, d):
    return bl.table_markup(_docs(spark, d), "doc_id").select("doc_id", "table_no", F.concat_ws("|", "doc_id", "table_no").alias("t"), "html")


def html_tables(spark, d):
    """Pipe tables of documents in markup, equal first cells as one with a row span."""
    return _markup(spark, d).select("t", "html")


def html_cells(spark, d):
    return tables.html_cells(_markup(spark, d), "t")


def html_grid(spark, d):
    """Places of the cells: row spans push the cells below to the right."""
    return tables.html_grid(_markup(spark, d), "t")


def html_round_trip(spark, d):
    return _markup(spark, d).select("t", tables.to_html(tables.html_rows(F.col("html"))).alias("markup"))


def table_pairs_best(spark, d):
    """Of each table and the table of the same place in the next document, two readings as it were, the one to take."""
    m = _markup(spark, d)
    other = m.select((F.col("doc_id") - 1).alias("doc_id"), "table_no", F.col("html").alias("other"))
    j = m.join(other, ["doc_id", "table_no"], "left")
    return j.select("t", F.when(bl.best_table(F.col("html"), F.col("other"), F.lit(False)) == F.col("html"), "detail").otherwise("markdown").alias("taken"))


def table_scores(spark, d):
    """Each table against the table of the same place in the next document; no table there scores 0."""
    m = _markup(spark, d)
    other = m.select((F.col("doc_id") - 1).alias("doc_id"), "table_no", F.col("html").alias("other"))
    j = m.join(other, ["doc_id", "table_no"], "left")
    return j.select("t", F.round(score.table_score(tables.html_rows(F.col("html")), tables.html_rows(F.col("other"))), 2).alias("score"))


def table_quality(spark, d):
    """Mean readability of a table's cells."""
    return _markup(spark, d).select("t", F.round(bl.table_quality(bl.parsed_rows(F.col("html"))), 4).alias("quality"))


def _stats(spark, d):
    return bl.page_stats(bl.document_blocks(_docs(spark, d).where("text IS NOT NULL")), ["doc_id"])


def block_stats(spark, d):
    s = _stats(spark, d)
    return s.select("doc_id", "raw_len", "meaningful_len", "non_table_len", "cells", "has_table", "mainly_table", F.round("first_quality", 4).alias("first_quality"), F.round("semantic", 6).alias("semantic"))


def block_classes(spark, d):
    return bl.classes(_stats(spark, d), ["doc_id"])


def watermark_sets(spark, d):
    """Short lines that return in documents of a source, together with the fixed marks, once each."""
    lines = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("scan_id"), F.explode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("text"))
    b = lines.withColumn("label", F.lit("para")).withColumn("clean", tx.cleaned(F.col("text")))
    moving = lo.repeated_marks(b).select(F.col("scan_id").alias("source"), "mark")
    fixed = lines.select(F.col("scan_id").alias("source")).distinct().select("source", F.explode(F.lit(list(tx.STATIC_MARKS))).alias("mark"))
    return moving.unionByName(fixed).distinct()


def _evaluated(spark, d):
    """Lines and tables of documents against their pages as predicted; documents without a source have no prediction."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", "text")
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("place", "line"))
    row = F.trim("line").startswith("|") & F.trim("line").endswith("|") & (F.length(F.trim("line")) > 2)
    texts = lines.where(~row & (F.trim("line") != "")).select("doc_id", F.lit("text").alias("kind"), "place", (F.length("line") <= 4).alias("ignore"), F.col("line").alias("text"))
    marked = bl.table_markup(docs, "doc_id").select("doc_id", F.lit("table").alias("kind"), F.col("table_no").alias("place"), F.lit(False).alias("ignore"), F.col("html").alias("text"))
    truth = cut(texts.unionByName(marked))
    md = truth.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("kind", "place", "text"))).getField("text"), "\n").alias("markdown"))
    given = docs.where("source IS NOT NULL").select("doc_id").join(md, "doc_id")
    return ev.scored(truth, given, "doc_id")


def eval_blocks(spark, d):
    return _evaluated(spark, d).select("doc_id", "kind", "place", F.round("score", 2).alias("score"))


def eval_pages(spark, d):
    r = ev.page_report(_evaluated(spark, d).withColumn("page", F.col("doc_id")))
    return r.select("page", F.round("text_avg", 4).alias("text_avg"), F.round("table_avg", 4).alias("table_avg"))


def eval_overall(spark, d):
    r = ev.overall(_evaluated(spark, d))
    return r.select("text_blocks", "table_blocks", *(F.round(c, 4).alias(c) for c in ("text_avg", "table_avg", "overall")))


def eval_worst(spark, d):
    s = _evaluated(spark, d).select(F.col("doc_id").alias("page"), F.concat_ws("|", "kind", "place").alias("block"), "kind", "score")
    return ev.worst(s).select("page", "block", F.round("score", 4).alias("score"))


_X = lambda c: f"replace(replace({c}, '&', '&amp;'), '<', '&lt;')"
_HTML = _PIPES + f""", rws AS (SELECT doc_id, table_no, row_no, list(cell ORDER BY col_no) AS cs FROM cells GROUP BY ALL),
  runs AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, table_no ORDER BY row_no) AS run FROM (SELECT *, coalesce(len(cs) < 2 OR cs[1] <> lag(cs[1]) OVER (PARTITION BY doc_id, table_no ORDER BY row_no), true) AS new FROM rws)),
  spans AS (SELECT *, doc_id || '|' || table_no AS t, count(*) OVER (PARTITION BY doc_id, table_no, run) AS span FROM runs),
  kept AS (SELECT t, doc_id, table_no, row_no, i - 1 AS c, CAST(i - CASE WHEN new THEN 1 ELSE 2 END AS INT) AS cell_no, {_X('cs[i]')} AS cell, CAST(CASE WHEN i = 1 THEN span ELSE 1 END AS INT) AS rowspan
    FROM spans, LATERAL (SELECT unnest(range(1, len(cs) + 1)) AS i) WHERE new OR i > 1),
  htm AS (SELECT t, doc_id, table_no, '<table>' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY row_no) || '</table>' AS html FROM (SELECT t, doc_id, table_no, row_no,
    string_agg('<td' || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || '>' || cell || '</td>', '' ORDER BY c) AS tds FROM kept GROUP BY ALL) GROUP BY ALL),
  quals AS (SELECT t, doc_id, coalesce(avg({_quality('x')}) FILTER (x <> ''), 0.0) AS q FROM (SELECT t, doc_id, {_cleaned('cell')} AS x FROM kept) GROUP BY ALL)"""
_COMPACT = lambda c: f"regexp_replace(regexp_replace({c}, '{_SP}', '', 'g'), '(臻子至善|李于至善|德厚生|正德厚生|哪生臻子|名厚生|于至善|厚生臻子|德厚|正德)', '', 'g')"
_count = lambda words: " + ".join(f"CAST(bool_or(contains(text, '{w}')) AS INT)" for w in words)
_STATIC = "'臻子至善', '李于至善', '生臻子至善', '德厚生臻子至美', '德厚生臻子', '正德厚生', '正德厚生臻子', '哪生臻子', '臻予玉', '想', '于至善', '厚', '正德厚生臻子不', '生牛', '器', '德厚生', '名厚生'"
_STATS = _HTML + rf""", blks AS (SELECT doc_id, 'table' AS label, html AS text FROM htm UNION ALL
    SELECT doc_id, 'para', line FROM l WHERE NOT (starts_with(trim(line, ' '), '|') AND ends_with(trim(line, ' '), '|') AND length(trim(line, ' ')) > 2) AND trim(line, ' ') <> ''),
  b AS (SELECT *, regexp_replace(text, '^{_SP}|{_SP}$', '', 'g') AS raw, {_cleaned('text')} AS clean FROM blks), n AS (SELECT *, clean IN ({_STATIC}) AS mark, clean IN ({_STATIC}) OR {_noise('clean')} AS noise FROM b),
  words AS (SELECT doc_id, row_no, t, list({_cleaned('cell')} ORDER BY c) AS r FROM kept GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY row_no) AS k FROM words),
  tabs AS (SELECT doc_id, t, count(*) AS n_rows, max(len(r)) AS n_cols, sum(len(r)) AS cells, string_agg(array_to_string(r, ''), '' ORDER BY k) AS said,
    bool_or(k <= 3 AND len(r) >= 3 AND len(list_intersect(r, ['序号', '考评内容', '分值', '扣分标准', '备注', '考评标准', '扣分', '得分'])) >= 2) AS scoring FROM numbered GROUP BY ALL),
  facts AS (SELECT tabs.doc_id, CAST(sum(cells) AS BIGINT) AS cells, arg_min(q, html) AS first_quality, bool_or(q < 0.35::DOUBLE) AS poor, bool_or(q < 0.35::DOUBLE OR (n_rows >= 3 AND n_cols >= 6 AND q < 0.5::DOUBLE)) AS abnormal,
    arg_min(CASE WHEN trim(said, ' ') = '' THEN 0.0 ELSE ({" + ".join(f"CAST(contains(said, '{w}') AS INT)" for w in ("考评", "扣分标准", "考评项目", "序号", "小计", "合计", "项目名称", "考评内容"))}) / 8.0::DOUBLE END, html) AS semantic
    FROM tabs JOIN quals USING (t) JOIN htm USING (t) GROUP BY tabs.doc_id),
  st AS (SELECT doc_id, CAST(coalesce(sum(length(raw)), 0) AS BIGINT) AS raw_len, CAST(coalesce(sum(length(clean)) FILTER (NOT noise), 0) AS BIGINT) AS meaningful_len,
    CAST(coalesce(sum(length(clean)) FILTER (NOT noise AND label = 'para'), 0) AS BIGINT) AS non_table_len, bool_or(label = 'table') AS has_table,
    coalesce(sum(length(text)) FILTER (label = 'table'), 0) > greatest(2 * coalesce(sum(length(clean)) FILTER (label = 'para'), 0), 80) AS mainly_table,
    coalesce(bool_or(regexp_matches(raw, '臻|至善|厚生|德厚|李于|正德|哪生|名厚') OR mark) FILTER (label = 'para' AND raw <> ''), false) AS watermark_heavy,
    {_count(("服务合同", "甲方", "乙方", "CMCCTD", "签字/盖章", "合同专用章", "监测项目"))} AS ch, {_count(("考评打分表", "服务管理考评", "考评得分", "扣分标准", "考评内容"))} AS sh,
    {_count(("任务清单", "考评项目", "扣分标准", "你需要做什么", "要准备的资料"))} AS kh, {_count(("规格书", "概况", "标高", "基坑", "监测", "参数", "结构概况", "技术规格", "单体"))} AS dh,
    {_count(("考评打分", "扣分标准", "考评项目", "服务管理考评", "考评日期"))} AS rh, bool_or(contains(text, '任务清单')) OR (bool_or(contains(text, '任务名称')) AND bool_or(contains(text, '你需要做什么'))) AS checklist,
    bool_or(label = 'table' AND contains(text, '分值')) AND bool_or(label = 'table' AND contains(text, '备注')) AND coalesce(sum(length(regexp_replace(text, '<[^>]+>', '', 'g'))) FILTER (label = 'table'), 0) < 280 AS pr FROM n GROUP BY doc_id),
  stats AS (SELECT st.*, coalesce(cells, 0) AS cells, coalesce(first_quality, 1.0) AS first_quality, coalesce(semantic, 1.0) AS semantic, coalesce(poor, false) AS poor, coalesce(abnormal, false) AS abnormal FROM st LEFT JOIN facts USING (doc_id))"""
_SCORED = _HTML + rf""", gt AS (SELECT doc_id, 'text' AS kind, CAST(n AS INT) AS place, {_COMPACT('line')} AS g FROM l WHERE NOT (starts_with(trim(line, ' '), '|') AND ends_with(trim(line, ' '), '|') AND length(trim(line, ' ')) > 2) AND trim(line, ' ') <> '' AND length(line) > 4),
  pool AS (SELECT doc_id, {_COMPACT("string_agg(line, chr(10) ORDER BY n)")} AS p FROM l JOIN documents USING (doc_id) WHERE source IS NOT NULL AND NOT (starts_with(trim(line, ' '), '|') AND ends_with(trim(line, ' '), '|') AND length(trim(line, ' ')) > 2) AND trim(line, ' ') <> '' GROUP BY doc_id),
  scored AS (SELECT doc_id, kind, place, CASE WHEN g = '' THEN 100.0 WHEN coalesce(p, '') = '' THEN 0.0 WHEN contains(p, g) THEN greatest(92.0, round_even(length(g) / CAST(length(p) AS DOUBLE) * 100, 2)) END AS score FROM gt LEFT JOIN pool USING (doc_id)
    UNION ALL SELECT h.doc_id, 'table', CAST(table_no AS INT), CASE WHEN source IS NOT NULL THEN 100.0 ELSE 0.0 END FROM htm h JOIN documents USING (doc_id))"""
QUERIES = {f.__name__: f for f in (html_tables, html_cells, html_grid, html_round_trip, table_pairs_best, table_scores, table_quality, block_stats, block_classes, watermark_sets, eval_blocks, eval_pages, eval_overall, eval_worst)}
_avg = lambda k: f"coalesce(avg(score) FILTER (kind = '{k}'), 0.0)"
ORACLE = {
    "html_tables": _HTML + " SELECT t, html FROM htm",
    "html_cells": _HTML + f" SELECT t, CAST(dense_rank() OVER (PARTITION BY t ORDER BY row_no) - 1 AS INT) AS row_no, cell_no, {_cleaned('cell')} AS cell_text, rowspan, CAST(1 AS INT) AS colspan FROM kept",
    "html_grid": _HTML + " SELECT t, CAST(row_no AS INT) AS row_no, cell_no, CAST(row_no AS INT) AS r, CAST(c AS INT) AS c FROM kept",
    "html_round_trip": _HTML + f" SELECT t, '<table>' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY row_no) || '</table>' AS markup FROM (SELECT t, row_no, string_agg('<td>' || {_X(_COMPACT('cell'))} || '</td>', '' ORDER BY c) AS tds FROM kept GROUP BY ALL) GROUP BY t",
    "table_quality": _HTML + " SELECT t, round(q, 4) AS quality FROM quals",
    "table_pairs_best": _HTML + """ SELECT a.t, CASE WHEN o.t IS NULL THEN 'detail' WHEN h.html = oh.html THEN 'detail' WHEN a.q < 0.35::DOUBLE AND o.q > a.q THEN 'markdown' WHEN o.q < 0.35::DOUBLE AND a.q > o.q THEN 'detail' WHEN o.q > a.q THEN 'markdown' ELSE 'detail' END AS taken
      FROM quals a JOIN htm h USING (t) LEFT JOIN htm oh ON oh.doc_id = h.doc_id + 1 AND oh.table_no = h.table_no LEFT JOIN quals o ON o.t = oh.t""",
    "block_stats": _STATS + " SELECT doc_id, raw_len, meaningful_len, non_table_len, cells, has_table, mainly_table, round(first_quality, 4) AS first_quality, round(semantic, 6) AS semantic FROM stats",
    "block_classes": _STATS + """ SELECT doc_id, ch >= 2 AS contract, checklist, sh >= 2 AND (has_table OR mainly_table) AS scoring_form,
      (sh >= 2 AND (has_table OR mainly_table)) OR (kh = 0 AND CAST(cells >= 12 AS INT) + CAST(mainly_table AS INT) + CAST(dh >= 1 AS INT) + CAST(has_table AND cells >= 6 AS INT) + CAST(poor AS INT) >= 2) AS dense_table,
      abnormal AS quality_abnormal, cells < 8 AND meaningful_len < 20 AND cells = 0 AS blank_risk, has_table AND (rh > 0 OR pr) AND semantic < 0.22::DOUBLE AS needs_table_snapshot,
      meaningful_len >= 12 OR raw_len >= 25 OR (has_table AND raw_len >= 15) AS editable,
      NOT (has_table AND (rh > 0 OR pr) AND semantic < 0.22::DOUBLE) AND NOT (meaningful_len >= 12 OR raw_len >= 25 OR (has_table AND raw_len >= 15)) AND NOT (has_table AND raw_len >= 15) AND meaningful_len < 8 AND raw_len < 18 AS should_snapshot, watermark_heavy FROM stats""",
    "eval_blocks": _SCORED + " SELECT doc_id, kind, place, round(score, 2) AS score FROM scored",
    "eval_pages": _SCORED + f" SELECT doc_id AS page, round({_avg('text')}, 4) AS text_avg, round({_avg('table')}, 4) AS table_avg FROM scored GROUP BY doc_id",
    "eval_overall": _SCORED + f" SELECT count(*) FILTER (kind = 'text') AS text_blocks, count(*) FILTER (kind = 'table') AS table_blocks, round({_avg('text')}, 4) AS text_avg, round({_avg('table')}, 4) AS table_avg, round({_avg('text')} * 0.6 + {_avg('table')} * 0.4, 4) AS overall FROM scored",
    "eval_worst": _SCORED + " SELECT doc_id AS page, kind || '|' || place AS block, round(score, 4) AS score FROM scored ORDER BY scored.score, page, block LIMIT 8",
    "watermark_sets": rf"""WITH l AS (SELECT source, {_cleaned('line')} AS mark FROM (SELECT source, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))
      SELECT source, mark FROM l WHERE length(mark) BETWEEN 2 AND 6 AND regexp_matches(mark, '^[一-鿿A-Za-z0-9·、，。]+$') GROUP BY ALL HAVING count(*) >= 4 UNION SELECT DISTINCT source, unnest([{_STATIC}]) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""",
}
