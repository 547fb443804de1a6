"""Queries over invoice_records and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import money
from paperloom.functions.checksum import ALPHABET, WEIGHTS, valid_credit_code
from paperloom.functions.names import FRONT_LABEL, LABEL_STARTS, LABEL_WORDS, NAME_ENDS, clean_name, suspicious
from paperloom.operators.repeats import archive_key, field_key, grid_key, occurrences
from paperloom.plans import invoices as p
from paperloom.runtime import table


#: Least records and share that make a buyer common: here a buyer of a fiftieth of all records.
COMMON_BUYER = (3, 0.02)
#: Columns of records that a report may show.
REPORTED = ("original_name", "buyer_name", "buyer_tax", "seller_name", "seller_tax", "invoice_date", "pretax_amount", "tax_amount", "total_amount", "tax_rate", "invoice_type", "invoice_no",
            "category", "line_items", "archived_path", "status", "station")


def _r(spark, d):
    return table(spark, d, "invoice_records")


def _plain(spark, d):
    return p._plain(_r(spark, d))


def invoice_typed(spark, d):
    return p.typed(_r(spark, d)).select("row_id", "pretax", "tax", "total", "pct", "is_pdf")


def invoice_amount_checks(spark, d):
    return p.amount_checks(_r(spark, d))


def invoice_blank_on_conflict(spark, d):
    return p.blanked(_r(spark, d))


def invoice_rate_inferred(spark, d):
    t = p.typed(_r(spark, d))
    return t.select("row_id", money.inferred_rate(F.col("pretax"), F.col("tax")).alias("rate"))


def checksum_codes(spark, d):
    both = _r(spark, d).select(F.col("buyer_tax").alias("code")).unionByName(_r(spark, d).select(F.col("seller_tax").alias("code")))
    return both.where("code IS NOT NULL").select("code").distinct().select("code", valid_credit_code(F.col("code")).alias("ok"))


def names_cleaned(spark, d):
    names = _r(spark, d).select(F.col("seller_name").alias("name")).unionByName(_r(spark, d).select(F.col("buyer_name").alias("name"))).distinct()
    return names.select("name", clean_name(F.col("name")).alias("cleaned"), suspicious(F.col("name")).alias("suspicious"))


def repeats_by_fields(spark, d):
    return occurrences(_r(spark, d), field_key(), "row_id").where("key IS NOT NULL").select("row_id", "key", "occurrence")


def repeats_by_archive(spark, d):
    return occurrences(_r(spark, d), archive_key(), "row_id").select("row_id", "key", "occurrence")


def repeats_by_grid(spark, d):
    return occurrences(_r(spark, d), grid_key(), "row_id").select("row_id", "key", "occurrence")


def record_kpis(spark, d):
    return p.kpis(_r(spark, d))


def pending_records(spark, d):
    return _r(spark, d).where(F.size("fields_needing_review") > 0).select("row_id", F.size("fields_needing_review").alias("n_fields"))


def vote_unanimous(spark, d):
    rows = _plain(spark, d).withColumn("key", field_key()).where("key IS NOT NULL")
    return p.unanimous(rows.select("key", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("seller_tax", "tax_rate", "pretax_amount"))), ["key"], ["seller_tax", "tax_rate", "pretax_amount"])


def vote_mapping(spark, d):
    """Codes of names on both sides, and names of codes."""
    ways = [(f"{s}_{a}", f"{s}_{b}") for s in ("buyer", "seller") for a, b in (("name", "tax"), ("tax", "name"))]
    out = None
    for source, target in ways:
        one = p.mapping(_plain(spark, d), source, target).withColumn("way", F.lit(f"{source}>{target}"))
        out = one if out is None else out.unionByName(one)
    return out


def vote_global_pair(spark, d):
    """The most frequent sound buyer pair of all records, and whether it is frequent enough to fill others."""
    top = p.dominant(p.sound_buyers(_plain(spark, d)), [], ["buyer_name", "buyer_tax"], "row_id", 0, 0.0)
    return top.withColumn("fills", (F.col("n") >= p.BUYER[0]) & (F.col("share") >= p.BUYER[1]))


def vote_context_pair(spark, d):
    return p.seller_pairs(_plain(spark, d))


def vote_value(spark, d):
    return p.common_value(_plain(spark, d), "tax_rate")


def nation_of_customers(spark, d):
    """The market segment that most customers of a nation have; the same vote over the star tables."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return p.dominant(c, ["n_name"], ["c_mktsegment"], "c_custkey", 2, 0.0)


def records_completed(spark, d):
    return p.completed(_r(spark, d)).select("row_id", "buyer_name", "buyer_tax", "seller_name", "seller_tax", F.size("fields_needing_review").cast("int").alias("n_doubted"))


def quality_flags(spark, d):
    return p.quality_flags(_r(spark, d))


def quality_status(spark, d):
    flags = p.quality_flags(_r(spark, d)).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_flags"))
    return _r(spark, d).select("row_id").join(flags, "row_id", "left").select("row_id", F.coalesce("n_flags", F.lit(0)).alias("n_flags"))


def parties_swapped(spark, d):
    """Records with a buyer of many records on the seller's side; the most frequent tenth-of-records parties count."""
    return p.swapped(_plain(spark, d), COMMON_BUYER)


def archive_plan(spark, d):
    return p.archive_plan(_r(spark, d))


def archive_collisions(spark, d):
    return p.collision_numbers(p.archive_plan(_r(spark, d)))


def report_rows(spark, d):
    return p.report(_r(spark, d))


def report_widths(spark, d):
    return p.widths(_r(spark, d), REPORTED)


def reasons_long(spark, d):
    return _r(spark, d).select("row_id", F.explode("review_reasons").alias("field", "reasons")).select("row_id", "field", F.posexplode("reasons").alias("seq", "reason"))


def scans_of_invoices(spark, d):
    """Scanned files joined to their records; files of other kinds and invoices never scanned are counted apart."""
    s, r = table(spark, d, "scan_files"), _r(spark, d).select("row_id", "station")
    return s.join(r, "row_id", "full_outer").groupBy(F.col("scan_id").isNotNull().alias("has_scan"), F.col("station").isNotNull().alias("has_record")).agg(F.count(F.lit(1)).alias("n"))


def records_by_number_in_name(spark, d):
    """Records whose number is a part of eight or more digits of an archived file's name: the first file by path."""
    files = p.archive_plan(_r(spark, d)).select(F.concat_ws("/", "folder", "name").alias("path"), F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    parts = files.select("path", F.explode(F.split("stem", "[_\\- ]")).alias("token")).where(F.col("token").rlike(r"^\d{8,}$"))
    first = parts.groupBy(F.lower("token").alias("token")).agg(F.min("path").alias("path"))
    return _r(spark, d).select("row_id", F.col("invoice_no").alias("token")).join(first, "token").select("row_id", "token", "path")


def invoice_view(spark, d):
    """Star tables as invoices: lines and amounts by seller, segment and month, in exact decimals."""
    l, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    cents = lambda c: F.col(c).cast("decimal(12,2)")
    pre = cents("l_extendedprice") * (F.lit(1) - cents("l_discount"))
    return (
        l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_name").alias("seller_name"), F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(pre).cast("double").alias("pretax"), F.sum(pre * cents("l_tax")).cast("double").alias("tax"))
    )


_TRIM = r"regexp_replace(coalesce({c}, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_t = lambda c: _TRIM.format(c=c)
_amount = lambda c: f"CASE WHEN regexp_matches(translate({_t(c)}, ',￥¥元', ''), '{money.NUMBER}') THEN CAST(translate({_t(c)}, ',￥¥元', '') AS DOUBLE) END"
_RATE = rf"CASE WHEN {_t('tax_rate')} IN ('免税','不征税','0%') THEN 0.0 WHEN regexp_matches({_t('tax_rate')}, '^\d{{1,2}}(\.\d+)?%$') THEN CAST(replace({_t('tax_rate')}, '%', '') AS DOUBLE) END"
_TYPED = f"""typed AS (SELECT *, {_amount('pretax_amount')} AS pretax, {_amount('tax_amount')} AS tax, {_amount('total_amount')} AS total,
  {_RATE} AS pct, coalesce(ends_with(lower(original_path), '.pdf'), false) AS is_pdf FROM invoice_records)"""
_COMMON = ", ".join(map(str, money.COMMON_RATES))
_CONFLICT = """coalesce(abs(pretax + tax - total) > 0.05, false) OR ((NOT is_pdf OR NOT coalesce(abs(pretax + tax - total) <= 0.05, false))
  AND (pretax IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL AND pct IS NOT NULL)
  AND (coalesce(abs(pretax * pct / 100 - tax) > 0.05, false) OR coalesce(abs(total / (1 + pct / 100) - pretax) > 0.05, false)))"""
_CHECK = (
    f"substr('{ALPHABET}', 1 + (31 - (" + " + ".join(f"(strpos('{ALPHABET}', substr(u, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(WEIGHTS)) + ") % 31) % 31, 1)")
_valid = lambda c: f"coalesce((SELECT regexp_matches(u, '^[{ALPHABET}]{{18}}$') AND substr(u, 18, 1) = {_CHECK} FROM (SELECT upper(trim({c}, ' ')) AS u)), false)"
_FIELDS = ("buyer_name", "buyer_tax", "seller_name", "seller_tax", "invoice_date", "pretax_amount", "tax_amount", "total_amount", "tax_rate", "invoice_type", "invoice_no", "line_items")
_PLAIN = "plain AS (SELECT row_id, original_path, fields_needing_review, " + ", ".join(f"{_t(f)} AS {f}" for f in _FIELDS) + " FROM invoice_records)"
_FIELD_KEY = "CASE WHEN trim(coalesce(invoice_no, '')) <> '' THEN CASE WHEN trim(coalesce(invoice_date, '')) <> '' AND trim(coalesce(total_amount, '')) <> '' THEN trim(invoice_no) || '|' || trim(invoice_date) || '|' || trim(total_amount) ELSE trim(invoice_no) END END"
_z = lambda c: f"coalesce({c}, '')"
_ARCHIVE_KEY = f"CASE WHEN {_z('invoice_no')} <> '' THEN 'invoice|' || invoice_no || '|' || {_z('seller_tax')} || '|' || {_z('total_amount')} ELSE 'fallback|' || {_z('seller_tax')} || '|' || {_z('invoice_date')} || '|' || {_z('total_amount')} END"
_GRID_KEY = f"lower({_z('invoice_no')} || '|' || {_z('seller_tax')} || '|' || {_z('total_amount')})"
_again = lambda key: f"SELECT row_id, {key} AS key, CAST(row_number() OVER (PARTITION BY {key} ORDER BY row_id) - 1 AS INT) AS occurrence FROM invoice_records"
_suspicious = lambda c: rf"""(SELECT CASE WHEN w = '个人' THEN false ELSE length(w) < 3 OR regexp_matches(w, '^(?:{"|".join(LABEL_STARTS)})') OR regexp_matches(w, '^[0-9A-Za-z]+$')
  OR regexp_matches(w, '{"|".join(LABEL_WORDS)}') OR (ends_with(w, '银行') AND length(w) <= 8) OR length(regexp_replace(w, '[^一-鿿]', '', 'g')) < 2 END
  FROM (SELECT regexp_replace(coalesce({c}, ''), '[\s\pZ]+', '', 'g') AS w))"""  # noqa: E731


def _vote(cte: str, rows: str, keys: list[str], values: list[str], order: str, least: int, share: float, single: bool = False) -> str:
    k, v = ", ".join(keys), ", ".join(values)
    part = f"PARTITION BY {k}" if keys else ""
    won = f"(n >= {least} AND n / CAST(al AS DOUBLE) >= {share})" + (" OR kinds = 1" if single else "")
    return f"""WITH {cte}, counted AS (SELECT {k + ',' if k else ''} {v}, count(*) AS n, min({order}) AS fst FROM ({rows}) GROUP BY ALL),
      ranked AS (SELECT *, sum(n) OVER ({part}) AS al, count(*) OVER ({part}) AS kinds, row_number() OVER ({part} ORDER BY n DESC, fst) AS rn FROM counted)
      SELECT {k + ',' if k else ''} {v}, n, n / CAST(al AS DOUBLE) AS share FROM ranked WHERE rn = 1 AND ({won})"""


_SELLERS = f"""SELECT row_id, CASE WHEN buyer_tax <> '' THEN upper(buyer_tax) ELSE buyer_name END AS ctx_buyer, invoice_type, tax_rate, seller_name, upper(seller_tax) AS seller_tax
  FROM plain WHERE (buyer_tax <> '' OR buyer_name <> '') AND invoice_type <> '' AND tax_rate <> '' AND seller_name <> '' AND NOT {_suspicious('seller_name')} AND {_valid('seller_tax')}"""
_NAME_STEM = r"regexp_replace({c}, '\.[^.]+$', '')"
_or = lambda c, x: f"CASE WHEN {_z(c)} <> '' THEN {c} ELSE {x} END"
_ARCHIVE = rf"""keyed AS (SELECT *, row_number() OVER (PARTITION BY {_ARCHIVE_KEY} ORDER BY row_id) - 1 AS k FROM invoice_records),
  named AS (SELECT row_id, k, CASE WHEN length(invoice_date) >= 7 THEN substr(invoice_date,1,4) || '年' || substr(invoice_date,6,2) || '月' ELSE '待确认月份' END AS m,
    substr(regexp_replace(regexp_replace({_or('invoice_no', _NAME_STEM.format(c='original_name'))} || '_' || {_or('buyer_name', "'待确认购买方'")} || '_' || {_or('invoice_date', "'待确认日期'")}
      || '_' || {_or('total_amount', "'待确认金额'")} || '元' || lower(regexp_extract(original_name, '(\.[^.]+)$', 1)), '[\\/:*?"<>|]+', '_', 'g'), '\s+', '', 'g'), 1, 180) AS nm FROM keyed),
  plan AS (SELECT row_id, CASE WHEN k > 0 THEN '重复发票/' || m ELSE m END AS folder,
    CASE WHEN k > 0 THEN regexp_replace(nm, '\.[^.]+$', '') || '_重复' || k || regexp_extract(nm, '(\.[^.]+)$', 1) ELSE nm END AS name FROM named)"""
_REQUIRED = [f for f in _FIELDS if f != "line_items"]
_flag = lambda field, test, why: f"SELECT row_id, '{field}' AS field, '{why}' AS reason FROM typed WHERE coalesce({test}, false)"
_FLAGS = " UNION ALL ".join(
    [_flag(f, f"{_t(f)} = ''", "missing") for f in _REQUIRED]
    + [_flag(f, f"{_t(f)} <> '' AND {_suspicious(f)}", "suspicious") for f in ("buyer_name", "seller_name")]
    + [_flag(f, f"{_t('buyer_name')} <> '' AND {_t('buyer_name')} = {_t('seller_name')}", "same party") for f in ("buyer_name", "seller_name")]
    + [_flag(f, f"{_t(f)} <> '' AND {_t(f)} <> '个人无税号' AND NOT {_valid(_t(f))}", "check character") for f in ("buyer_tax", "seller_tax")]
    + [_flag(f, f"{_t(f)} <> '' AND {n} IS NULL", "unreadable") for f, n in (("pretax_amount", "pretax"), ("tax_amount", "tax"), ("total_amount", "total"))]
    + [_flag(f, f"{n} < 0", "negative") for f, n in (("pretax_amount", "pretax"), ("tax_amount", "tax"), ("total_amount", "total"))]
    + [_flag(f, "abs(pretax + tax - total) > 0.05", "sum") for f in ("pretax_amount", "tax_amount", "total_amount")]
    + [_flag("tax_rate", f"{_t('tax_rate')} <> '' AND pct IS NULL", "unreadable"), _flag("tax_rate", f"pct NOT IN ({_COMMON})", "unusual")])
_width = lambda c: f"SELECT '{c}' AS column_name, CAST(least(40, greatest(8, max(length(coalesce({c}, '')) + length(regexp_replace(coalesce({c}, ''), '[\\x00-\\x7F]', '', 'g'))) + 2)) AS INT) AS width FROM invoice_records"


def _best(rows: str, keys: list[str], values: list[str], least: int, share: float, single: bool = False) -> str:
    """The vote as a subquery."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    won = f"(n >= {least} AND n / CAST(al AS DOUBLE) >= {share})" + (" OR kinds = 1" if single else "")
    return f"""(SELECT {k}{', '.join(values)} FROM (SELECT *, sum(n) OVER ({part}) AS al, count(*) OVER ({part}) AS kinds, row_number() OVER ({part} ORDER BY n DESC, fst) AS rn
      FROM (SELECT {k}{', '.join(values)}, count(*) AS n, min(row_id) AS fst FROM ({rows}) GROUP BY ALL)) WHERE rn = 1 AND ({won}))"""


def _clean_sql(c: str) -> str:
    """The name cleaning as nested SQL."""
    w = f"regexp_replace(regexp_replace(coalesce({c}, ''), '[\\s\\pZ]+', '', 'g'), '{FRONT_LABEL}', '')"
    rest = f"regexp_extract({w}, '^[一-龥]{{1,3}}[：:]+(.+)$', 1)"
    t = f"(CASE WHEN {rest} <> '' AND regexp_matches({rest}, '{NAME_ENDS}') THEN {rest} ELSE {w} END)"
    u = f"(CASE WHEN regexp_matches({t}, '[（(]个体工商户[）)]$') THEN {t} ELSE regexp_replace({t}, '[（(][^）)]*[）)]$', '') END)"
    return f"regexp_replace({u}, '^[：:，,。 ]+|[：:，,。 ]+$', '', 'g')"


def _reliable(f: str) -> str:
    base = f"{f} <> '' AND {f} <> '待确认'"
    if f in ("buyer_name", "seller_name"):
        return f"{base} AND NOT {_suspicious(f)}"
    if f in ("buyer_tax", "seller_tax"):
        return f"{base} AND ({f} = '个人无税号' OR {_valid(f)})"
    if f == "tax_rate":
        return f"{base} AND ({f} = '免税' OR regexp_matches({f}, '^\\d{{1,2}}%$'))"
    if f.endswith("_amount"):
        return f"{base} AND regexp_matches(translate({f}, ',￥¥元', ''), '{money.NUMBER}')"
    return base


def _completed() -> str:
    keep = [f for f in _FIELDS]
    names = {"buyer_name", "seller_name"}
    steps = ["f0 AS (SELECT row_id, coalesce(fields_needing_review, []) AS rev, " + ", ".join(f"{_clean_sql(_t(f)) if f in names else _t(f)} AS {f}" for f in keep) + " FROM invoice_records)"]
    steps.append(f"k0 AS (SELECT *, {_FIELD_KEY} AS key FROM f0)")
    agreed = ", ".join(f"CASE WHEN min(CASE WHEN {_reliable(f)} THEN {f} END) = max(CASE WHEN {_reliable(f)} THEN {f} END) THEN max(CASE WHEN {_reliable(f)} THEN {f} END) END AS v_{f}" for f in keep)
    steps.append(f"a0 AS (SELECT key, {agreed} FROM k0 WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)")
    filled = ", ".join(f"CASE WHEN v_{f} IS NOT NULL AND ({f} = '' OR list_contains(rev, '{f}')) THEN v_{f} ELSE {f} END AS {f}" for f in keep)
    known = "[" + ", ".join(f"CASE WHEN v_{f} IS NOT NULL THEN '{f}' ELSE '' END" for f in keep) + "]"
    steps.append(f"f1 AS (SELECT row_id, list_filter(rev, lambda x: NOT list_contains({known}, x)) AS rev, {filled} FROM k0 LEFT JOIN a0 USING (key))")
    now = "f1"
    for side, nxt in (("buyer", "f2"), ("seller", "f3")):
        n, t = f"{side}_name", f"{side}_tax"
        pairs = lambda x, y: f"SELECT row_id, {x} AS source, {y} AS target FROM {now} WHERE {x} <> '' AND {y} <> ''"  # noqa: B023, E731
        code = f"coalesce({n} <> '' AND b.target IS NOT NULL AND (upper({t}) = '' OR NOT {_valid(f'upper({t})')} OR upper({t}) <> b.target), false)"
        rest = ", ".join(f for f in keep if f not in (n, t))
        steps.append(f"""{nxt}m AS (SELECT m.*, b.target AS v_code, c.target AS v_name, {code} AS tc
          FROM {now} m LEFT JOIN {_best(pairs(n, t), ['source'], ['target'], 2, 0.8, True)} b ON b.source = {n} LEFT JOIN {_best(pairs(t, n), ['source'], ['target'], 2, 0.8, True)} c ON c.source = upper({t}))""")
        steps.append(f"{nxt}n AS (SELECT *, (NOT tc AND {t} <> '' AND {n} = '' AND v_name IS NOT NULL) AS tn FROM {nxt}m)")
        steps.append(f"""{nxt} AS (SELECT row_id, list_filter(rev, lambda x: x <> CASE WHEN tc THEN '{t}' WHEN tn THEN '{n}' ELSE '' END) AS rev, {rest},
          CASE WHEN tc THEN v_code ELSE {t} END AS {t}, CASE WHEN tn THEN v_name ELSE {n} END AS {n} FROM {nxt}n)""")
        now = nxt

    def common(src: str, side: str, winner: str, on: str, nxt: str) -> str:
        n, t = f"{side}_name", f"{side}_tax"
        need_n, need_t = f"(p.{n} IS NOT NULL AND (s.{n} = '' OR list_contains(s.rev, '{n}')))", f"(p.{n} IS NOT NULL AND (s.{t} = '' OR list_contains(s.rev, '{t}')))"
        rest = ", ".join(f"s.{f}" for f in keep if f not in (n, t))
        return f"""{nxt} AS (SELECT s.row_id, list_filter(s.rev, lambda x: NOT (x = '{n}' AND {need_n}) AND NOT (x = '{t}' AND {need_t})) AS rev, {rest},
          CASE WHEN {need_n} THEN p.{n} ELSE s.{n} END AS {n}, CASE WHEN {need_t} THEN p.{t} ELSE s.{t} END AS {t} FROM {src} s LEFT JOIN {winner} p ON {on})"""

    good_buyer = f"SELECT row_id, buyer_name, upper(buyer_tax) AS buyer_tax FROM f3 WHERE buyer_name <> '' AND NOT {_suspicious('buyer_name')} AND (upper(buyer_tax) = '个人无税号' OR {_valid('buyer_tax')})"
    steps.append(common("f3", "buyer", _best(good_buyer, [], ["buyer_name", "buyer_tax"], 3, 0.5), "true", "f4"))
    steps.append("f4c AS (SELECT *, CASE WHEN buyer_tax <> '' THEN upper(buyer_tax) ELSE buyer_name END AS ctx_buyer FROM f4)")
    good_seller = f"SELECT row_id, ctx_buyer, invoice_type, tax_rate, seller_name, upper(seller_tax) AS seller_tax FROM f4c WHERE ctx_buyer <> '' AND invoice_type <> '' AND tax_rate <> '' AND seller_name <> '' AND NOT {_suspicious('seller_name')} AND {_valid('seller_tax')}"
    steps.append(common("f4c", "seller", _best(good_seller, ["ctx_buyer", "invoice_type", "tax_rate"], ["seller_name", "seller_tax"], 3, 0.85), "p.ctx_buyer = s.ctx_buyer AND p.invoice_type = s.invoice_type AND p.tax_rate = s.tax_rate", "f5"))
    return "WITH " + ",\n".join(steps) + " SELECT row_id, buyer_name, buyer_tax, seller_name, seller_tax, CAST(len(rev) AS INT) AS n_doubted FROM f5"


QUERIES = {f.__name__: f for f in (
    invoice_typed, invoice_amount_checks, invoice_blank_on_conflict, invoice_rate_inferred, checksum_codes, names_cleaned, repeats_by_fields,
    repeats_by_archive, repeats_by_grid, record_kpis, pending_records, vote_unanimous, vote_mapping, vote_global_pair, vote_context_pair, vote_value,
    nation_of_customers, records_completed, quality_flags, quality_status, parties_swapped, archive_plan, archive_collisions, report_rows,
    report_widths, reasons_long, scans_of_invoices, records_by_number_in_name, invoice_view)}
_REPORT_REASONS = "array_to_string(list_transform(list_sort(fields_needing_review), lambda f: f || ': ' || CASE WHEN len(coalesce(review_reasons[f], [])) > 0 THEN array_to_string(review_reasons[f], '；') ELSE '待确认' END), ' | ')"
_scrub = lambda c: f"regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
ORACLE = {
    "invoice_typed": f"WITH {_TYPED} SELECT row_id, pretax, tax, total, pct, is_pdf FROM typed",
    "invoice_amount_checks": f"""WITH {_TYPED} SELECT row_id, abs(pretax + tax - total) <= 0.05 AS adds_up, ({_CONFLICT}) AS conflict,
      coalesce(pct NOT IN ({_COMMON}), false) AS unusual_rate, coalesce(pretax < 0, false) OR coalesce(tax < 0, false) OR coalesce(total < 0, false) AS negative FROM typed""",
    "invoice_blank_on_conflict": f"WITH {_TYPED} SELECT row_id, " + ", ".join(f"CASE WHEN {_CONFLICT} THEN '' ELSE {_t(c)} END AS {c}" for c in ("pretax_amount", "tax_amount", "total_amount", "tax_rate")) + " FROM typed",
    "invoice_rate_inferred": f"""WITH {_TYPED}, near AS (SELECT row_id, pretax, (SELECT min((abs(tax / pretax * 100 - r), r)) FROM (VALUES (1.0),(3.0),(6.0),(9.0),(13.0)) v(r)) AS b FROM typed)
      SELECT row_id, CASE WHEN pretax > 0 AND b[1] <= 0.6 THEN CAST(b[2] AS DOUBLE) END AS rate FROM near""",
    "checksum_codes": f"SELECT code, {_valid('code')} AS ok FROM (SELECT buyer_tax AS code FROM invoice_records UNION SELECT seller_tax FROM invoice_records) WHERE code IS NOT NULL",
    "names_cleaned": rf"""WITH w AS (SELECT seller_name AS name FROM invoice_records UNION SELECT buyer_name FROM invoice_records),
      a AS (SELECT name, regexp_replace(regexp_replace(coalesce(name, ''), '[\s\pZ]+', '', 'g'), '{FRONT_LABEL}', '') AS t FROM w),
      b AS (SELECT name, t, regexp_extract(t, '^[一-龥]{{1,3}}[：:]+(.+)$', 1) AS rest FROM a),
      c AS (SELECT name, CASE WHEN rest <> '' AND regexp_matches(rest, '{NAME_ENDS}') THEN rest ELSE t END AS t FROM b),
      e AS (SELECT name, CASE WHEN regexp_matches(t, '[（(]个体工商户[）)]$') THEN t ELSE regexp_replace(t, '[（(][^）)]*[）)]$', '') END AS t FROM c)
      SELECT name, regexp_replace(t, '^[：:，,。 ]+|[：:，,。 ]+$', '', 'g') AS cleaned, {_suspicious('name')} AS suspicious FROM e""",
    "repeats_by_fields": f"SELECT * FROM ({_again(_FIELD_KEY)}) WHERE key IS NOT NULL",
    "repeats_by_archive": _again(_ARCHIVE_KEY), "repeats_by_grid": _again(_GRID_KEY),
    "record_kpis": f"""WITH {_TYPED}, k AS (SELECT *, row_number() OVER (PARTITION BY {_GRID_KEY} ORDER BY row_id) AS rn, len(fields_needing_review) > 0 AS pending FROM typed)
      SELECT count(*) AS records, count(*) FILTER (pending) AS pending, count(*) FILTER (NOT pending) AS confirmed, count(*) FILTER (rn > 1) AS repeats,
        round(sum(total) FILTER (rn = 1 AND NOT pending), 2) AS unique_total FROM k""",
    "pending_records": "SELECT row_id, CAST(len(fields_needing_review) AS INT) AS n_fields FROM invoice_records WHERE len(fields_needing_review) > 0",
    "vote_unanimous": f"""WITH {_PLAIN}, k AS (SELECT *, {_FIELD_KEY} AS key FROM plain) SELECT key, """ + ", ".join(
        f"CASE WHEN min(nullif({c}, '')) = max(nullif({c}, '')) THEN max(nullif({c}, '')) END AS {c}" for c in ("seller_tax", "tax_rate", "pretax_amount")) + " FROM k WHERE key IS NOT NULL GROUP BY key",
    "vote_mapping": " UNION ALL ".join("SELECT *, '" + f"{a}>{b}" + "' AS way FROM (" + _vote(
        _PLAIN, f"SELECT row_id, {a} AS source, {b} AS target FROM plain WHERE {a} <> '' AND {b} <> ''", ["source"], ["target"], "row_id", 2, 0.8, True) + ")"
        for a, b in (("buyer_name", "buyer_tax"), ("buyer_tax", "buyer_name"), ("seller_name", "seller_tax"), ("seller_tax", "seller_name"))),
    "vote_global_pair": "SELECT *, n >= 3 AND share >= 0.5::DOUBLE AS fills FROM (" + _vote(
        _PLAIN, f"SELECT row_id, buyer_name, upper(buyer_tax) AS buyer_tax FROM plain WHERE buyer_name <> '' AND NOT {_suspicious('buyer_name')} AND (upper(buyer_tax) = '个人无税号' OR {_valid('buyer_tax')})",
        [], ["buyer_name", "buyer_tax"], "row_id", 0, 0.0) + ")",
    "vote_context_pair": _vote(_PLAIN, _SELLERS, ["ctx_buyer", "invoice_type", "tax_rate"], ["seller_name", "seller_tax"], "row_id", 3, 0.85),
    "vote_value": _vote(_PLAIN, "SELECT row_id, tax_rate AS value FROM plain WHERE tax_rate <> ''", [], ["value"], "row_id", 3, 0.35),
    "nation_of_customers": _vote("c AS (SELECT n_name, c_mktsegment, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)", "SELECT * FROM c", ["n_name"], ["c_mktsegment"], "c_custkey", 2, 0.0),
    "records_completed": _completed(),
    "quality_flags": f"WITH {_TYPED} {_FLAGS}",
    "quality_status": f"WITH {_TYPED}, f AS ({_FLAGS}) SELECT r.row_id, count(f.field) AS n_flags FROM invoice_records r LEFT JOIN f ON f.row_id = r.row_id GROUP BY r.row_id",
    "parties_swapped": f"""WITH {_PLAIN}, ct AS (SELECT upper(value) AS v FROM ({_vote('x AS (SELECT 1)', "SELECT row_id, buyer_tax AS value FROM plain WHERE buyer_tax <> ''", [], ['value'], 'row_id', 3, 0.02)})),
      cn AS (SELECT value AS v FROM ({_vote('x AS (SELECT 1)', "SELECT row_id, buyer_name AS value FROM plain WHERE buyer_name <> ''", [], ['value'], 'row_id', 3, 0.02)})),
      s AS (SELECT row_id, coalesce(upper(seller_tax) = (SELECT v FROM ct) AND upper(buyer_tax) <> (SELECT v FROM ct), false) AS by_tax,
        coalesce(seller_name = (SELECT v FROM cn) AND buyer_name <> (SELECT v FROM cn), false) AS by_name FROM plain) SELECT * FROM s WHERE by_tax OR by_name""",
    "archive_plan": f"WITH {_ARCHIVE} SELECT * FROM plan",
    "archive_collisions": rf"""WITH {_ARCHIVE}, n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY row_id) AS k FROM plan)
      SELECT row_id, folder, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\.[^.]+$', '') || '_' || k || regexp_extract(name, '(\.[^.]+)$', 1) END AS final_name FROM n""",
    "report_rows": f"""SELECT 0 AS part, {_scrub('row_id')} AS row_id, CASE WHEN length(invoice_date) >= 7 THEN substr(invoice_date,1,4) || '年' || substr(invoice_date,6,2) || '月' ELSE '' END AS archive_month,
      {_scrub('category')} AS category, {_scrub('seller_name')} AS seller_name, {_scrub('total_amount')} AS total_amount, {_scrub('status')} AS status,
      regexp_extract(coalesce(archived_path, ''), '([^/]*)$', 1) AS archived_name, coalesce({_REPORT_REASONS}, '') AS review_summary FROM invoice_records
      UNION ALL SELECT 1, '合  计（共 ' || count(*) || ' 张）', '', '', '', format('{{:,.2f}}', round(sum(CASE WHEN regexp_matches(trim(replace(coalesce(total_amount, ''), ',', '')), '{money.NUMBER}') THEN CAST(trim(replace(total_amount, ',', '')) AS DOUBLE) END), 2)), '', '', '' FROM invoice_records""",
    "report_widths": " UNION ALL ".join(_width(c) for c in REPORTED),
    "reasons_long": "SELECT row_id, e.key AS field, CAST(i - 1 AS INT) AS seq, e.value[i] AS reason FROM (SELECT row_id, unnest(map_entries(review_reasons)) AS e FROM invoice_records) t, LATERAL (SELECT unnest(range(1, len(e.value) + 1)) AS i)",
    "scans_of_invoices": "SELECT s.scan_id IS NOT NULL AS has_scan, r.station IS NOT NULL AS has_record, count(*) AS n FROM scan_files s FULL JOIN invoice_records r ON s.row_id = r.row_id GROUP BY ALL",
    "records_by_number_in_name": rf"""WITH {_ARCHIVE}, t AS (SELECT folder || '/' || name AS path, unnest(string_split_regex(regexp_replace(name, '\.[^.]+$', ''), '[_\- ]')) AS token FROM plan),
      f AS (SELECT token, min(path) AS path FROM t WHERE regexp_matches(token, '^\d{{8,}}$') GROUP BY token) SELECT r.row_id, token, path FROM invoice_records r JOIN f ON r.invoice_no = token""",
    "invoice_view": """SELECT s_name AS seller_name, c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_lines,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS pretax,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) * CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) AS tax
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
}
