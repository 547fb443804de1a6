"""Hand-worked fixtures of the core operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import money, score, text as tx
from paperloom.functions.checksum import valid_credit_code
from paperloom.operators import chunks, tables, vote
from paperloom.operators.repeats import field_key, occurrences
from paperloom.plans import evaluation, invoices, layout, traffic
from paperloom.sources import access_log, files, sinks

LOG = [
    '10.0.0.1 - - [12/Jun/2026:00:10:00 +0800] "GET / HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.1 - - [12/Jun/2026:23:59:00 +0800] "GET /index.html HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.2 - - [12/Jun/2026:10:00:00 +0800] "GET /a.html?x=1 HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.3 - - [12/Jun/2026:10:01:00 +0800] "POST /api/ocr HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.3 - - [12/Jun/2026:10:02:00 +0800] "POST /api/none HTTP/1.1" 404 10 "-" "Mozilla/5.0"',
    '10.0.0.4 - - [12/Jun/2026:10:03:00 +0800] "GET /wp-login.php HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.5 - - [12/Jun/2026:10:04:00 +0800] "GET /a.html HTTP/1.1" 200 10 "-" "somebot/1.0"',
    '10.0.0.2 - - [13/Jun/2026:10:05:00 +0800] "GET /robots.txt HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    '10.0.0.3 - - [12/Jun/2026:10:06:00 +0800] "POST /api/convert?x=1 HTTP/1.1" 200 10 "-" "Mozilla/5.0"',
    "not a log line", "", None,
]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_traffic(spark):
    lines = spark.createDataFrame([(x,) for x in LOG], "raw_line string")
    days = {str(r["day"]): (r["pv"], r["uv"], r["tools"]) for r in traffic.daily(lines).collect()}
    assert days == {"2026-06-12": (2, 1, 2), "2026-06-13": (0, 0, 0)}
    tools = {r["name"]: r["n"] for r in traffic.per_name(lines, "tool").collect()}
    assert tools == {"/api/ocr": 1, "/api/convert?x=1": 1}
    assert {r["name"]: r["n"] for r in traffic.per_name(lines, "page").collect()} == {"/": 2}


def test_history(spark):
    D = datetime.date
    kept = spark.createDataFrame([(D(2026, 6, 10), 5, 1, 0), (D(2026, 6, 12), 99, 9, 9)], "day date, pv long, uv long, tools long")
    new = spark.createDataFrame([(D(2026, 6, 12), 2, 1, 2), (D(2026, 6, 13), 0, 0, 0)], kept.schema)
    merged = {r["day"].day: r["pv"] for r in traffic.merge_history(kept, new).collect()}
    assert merged == {10: 5, 12: 2, 13: 0}
    again = traffic.merge_history(traffic.merge_history(kept, new).drop("source"), new)
    assert {r["day"].day: r["pv"] for r in again.collect()} == merged
    days = spark.createDataFrame([(D(2026, 1, i), v) for i, v in enumerate([10, 15, 0, 1, 8, 9, 8, 7], 1)], "day date, pv long")
    assert [r["change"] for r in traffic.change(days).orderBy("day").collect()] == [None, 50, -100, None, 700, 13, -11, -12]


def test_usage(spark):
    rows = spark.createDataFrame([('{"2026-06-01":{"m1":2},"2026-06-05":{"m1":1,"m2":4},"2026-06-09":{"m2":1}}',), ("broken",), (None,)], "value string")
    counts = files.usage_counts(rows)
    assert {r["name"]: r["total"] for r in traffic.usage_total(counts, 2).collect()} == {"m1": 1, "m2": 5}


def test_log_files(spark, tmp_path):
    import gzip

    (tmp_path / "access.1.log").write_text(LOG[0] + "\n")
    with gzip.open(tmp_path / "access.2.log.gz", "wt") as f:
        f.write(LOG[3] + "\n")
    (tmp_path / "other.txt").write_text("x\n")
    assert access_log.parse_lines(access_log.read_logs(spark, str(tmp_path))).count() == 2


def test_history_files(spark, tmp_path):
    D = datetime.date
    folder = str(tmp_path / "history")
    assert sinks.read_history(spark, folder).count() == 0
    days = spark.createDataFrame([(D(2026, 6, 2), 1, 1, 0), (D(2026, 6, 1), 5, 1, 0)], "day date, pv long, uv long, tools long")
    sinks.write_history(days, folder)
    sinks.write_history(sinks.read_history(spark, folder).withColumn("pv", F.col("pv") + 1), folder)
    assert [r["pv"] for r in sinks.read_history(spark, folder).orderBy("day").collect()] == [6, 2]


@pytest.mark.parametrize(("code", "ok"), [
    ("91990000MA0000001B", True), ("91990000MA0000002E", True), ("91990000ma0000003h", True), ("91990000MA0000004L", True),
    ("91990000MA0000001C", False), ("", False), (None, False), ("91990000MA000000I1", False), ("9199", False)])
def test_checksum(spark, code, ok):
    assert one(spark, valid_credit_code(F.lit(code).cast("string")))[0] is ok


def test_money(spark):
    values = ["1,234.50", "￥12", "¥-3.5元", "nan", "1_0", "", None, " 7 ", "12 CNY", "1e2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(money.amount(F.col("v"))).collect()] == [1234.5, 12.0, -3.5, None, None, None, None, 7.0, None, 100.0]
    rates = spark.createDataFrame([(v,) for v in ["13%", "免税", "4", "6.5%", None, "100%"]], "v string")
    assert [r[0] for r in rates.select(money.rate(F.col("v"))).collect()] == [13.0, 0.0, None, 6.5, None, None]


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "a", "y"), (5, "b", "z"), (6, "c", "p"), (7, "c", "q")], "id int, k string, v string")
    got = {r["k"]: r["v"] for r in vote.dominant(rows, ["k"], ["v"], "id", 2, 0.75, True).collect()}
    assert got == {"a": "x", "b": "z"}
    tie = {r["k"]: r["v"] for r in vote.dominant(rows, ["k"], ["v"], "id", 1, 0.5).collect()}
    assert tie["c"] == "p"
    assert vote.dominant(rows.where("id > 99"), [], ["v"], "id", 1, 0.1).count() == 0
    assert {r["k"]: r["v"] for r in vote.unanimous(rows, ["k"], ["v"]).collect()} == {"a": None, "b": "z", "c": None}


RECORD = "row_id int, original_path string, original_name string, buyer_name string, buyer_tax string, seller_name string, seller_tax string, invoice_date string, pretax_amount string, tax_amount string, total_amount string, tax_rate string, invoice_type string, invoice_no string, category string, line_items string, archived_path string, status string, fields_needing_review array<string>, review_reasons map<string,array<string>>"
B, C, D_, E_ = "91990000MA0000001B", "91990000MA0000002E", "91990000MA0000003H", "91990000MA0000004L"


def records(spark):
    a, b, c, d = "甲样例有限公司", "乙样例有限公司", "丙样例有限公司", "丁样例有限公司"
    rows = [
        (1, "a.pdf", a, B, b, C, "2026-01-05", "100.00", "13.00", "113.00", "13%", "10000001"), (2, "b.jpg", a, B, "", "", "2026-01-05", "", "", "113.00", "13%", "10000001"),
        (3, "c.jpg", a, B, c, D_, "2026-01-06", "100.00", "6.00", "107.00", "6%", "10000002"), (4, "d.pdf", a, B, b, "", "2026-02-01", "50.00", "2.00", "52.00", "4%", "10000003"),
        (5, "e.jpg", d, E_, a, B, "2026-02-02", "100.00", "13.00", "113.00", "13%", "10000004")]
    full = [(i, p, p, bn, bt, sn, st, day, pre, tax, tot, rate, "t", no, "", "", "", "", [], {}) for i, p, bn, bt, sn, st, day, pre, tax, tot, rate, no in rows]
    return spark.createDataFrame(full, RECORD)


def test_completion(spark):
    r = records(spark)
    done = {x["row_id"]: x for x in invoices.completed(r).collect()}
    assert (done[2]["seller_name"], done[2]["seller_tax"]) == ("乙样例有限公司", C)
    assert done[4]["seller_tax"] == C
    assert (done[5]["buyer_name"], done[5]["seller_tax"]) == ("丁样例有限公司", B)
    checks = {x["row_id"]: x for x in invoices.amount_checks(r).collect()}
    assert checks[3]["conflict"] and not checks[1]["conflict"]
    assert checks[4]["unusual_rate"] and not checks[4]["conflict"]  # a PDF whose sum is right
    swapped = {x["row_id"] for x in invoices.swapped(invoices._plain(r)).collect()}
    assert swapped == {5}
    assert invoices.completed(r.where("row_id < 0")).count() == 0


def test_repeats(spark):
    r = records(spark)
    assert [x["occurrence"] for x in occurrences(r, field_key(), "row_id").orderBy("row_id").collect()] == [0, 1, 0, 0, 0]
    plan = {x["row_id"]: x["folder"] for x in invoices.archive_plan(r).collect()}
    assert plan[1] == "2026年01月" and plan[2] == "2026年01月"  # before completion the keys differ
    done = invoices.completed(r).withColumns({c: F.lit(None).cast("string") for c in ("category", "archived_path", "status")}).withColumn("original_name", F.col("original_path"))
    assert {x["row_id"]: x["folder"] for x in invoices.archive_plan(done).collect()}[2] == "重复发票/2026年01月"


def test_tables(spark):
    df = spark.createDataFrame([(1, '<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table>')], "t int, html string")
    assert sorted((r["row_no"], r["cell_no"], r["r"], r["c"]) for r in tables.html_grid(df, "t").collect()) == [(0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1)]
    pipe = spark.createDataFrame([(1, "x\n| h1 | h2 |\n|----|----|\n| 1 | 2 |\n| 3 |\nend"), (2, None), (3, "| a |")], "d int, text string")
    got = [(r["row_no"], r["col_no"], r["cell"], r["is_header"]) for r in tables.pipe_tables(pipe, "d").orderBy("row_no", "col_no").collect()]
    assert got == [(0, 0, "h1", True), (0, 1, "h2", True), (1, 0, "1", False), (1, 1, "2", False), (2, 0, "3", False), (2, 1, "", False)]
    words = spark.createDataFrame([(1, "a", 3.0, 10.0), (1, "b", 1.0, 6.0), (1, "c", 2.0, 14.0), (1, "中", 5.0, 6.0)], "g int, t string, x double, y double")
    assert {r["line_key"]: r["line_text"] for r in tables.clustered_lines(words, ["g"], "t", "x", "y", 4.0).collect()} == {8.0: "b a中", 16.0: "c"}


def test_page_numbers(spark):
    specs = [("1,3，7-5, 12", 10, [0, 2, 4, 5, 6]), ("0,99", 10, None), ("", 10, None), ("2-4,3-6", 5, [1, 2, 3, 4]), ("x", 3, None), (None, 4, None)]
    df = spark.createDataFrame([s[:2] for s in specs], "s string, n int")
    assert [r[0] for r in df.select(tx.page_numbers(F.col("s"), F.col("n"))).collect()] == [s[2] for s in specs]


def test_scores(spark):
    s = lambda a, b: one(spark, score.edit_score(F.lit(a), F.lit(b)))[0]
    assert (s("kitten", "sitting"), s("", ""), s("abc", "")) == (57.14, 100.0, 0.0)
    t = lambda a, b: one(spark, score.table_score(tables.html_rows(F.lit(a)), tables.html_rows(F.lit(b))))[0]
    x = "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>{}</td></tr></table>"
    assert (t(x.format(2), x.format(3)), t("", ""), t(x, "")) == (95.65, 100.0, 0.0)
    blocks = spark.createDataFrame([(1, 1, "text", 50.0)], "page int, block int, kind string, score double")
    assert evaluation.overall(blocks).first()["overall"] == 30.0


def test_chunks(spark):
    assert chunks.pack_lines("a" * 10, 400) == ["a" * 10]
    text = "\n".join("x" * 150 for _ in range(5))
    assert [len(c) for c in chunks.pack_lines(text, 400)] == [301, 301, 150]
    assert chunks.seamless(["a\nb\nc\nd", "c\nd\ne", "e\nf"]) == ["a", "b", "c", "d", "e", "f"]
    assert chunks.greedy([{"a": 0, "b": 0, "score": 0.9}, {"a": 1, "b": 0, "score": 0.95}, {"a": 1, "b": 1, "score": 0.2}]) == [
        {"a": 0, "b": 0, "score": 0.9}, {"a": 1, "b": 1, "score": 0.2}]


def test_places(spark):
    rows = [
        (1, 1, 0, 0, "名称：甲样例有限公司", 0.10, 0.73), (1, 1, 1, 1, B, 0.28, 0.66), (1, 1, 2, 2, "名称：乙样例股份有限公司", 0.55, 0.73), (1, 1, 3, 3, C, 0.76, 0.66)]
    df = spark.createDataFrame(rows, "scan_id int, page_no int, line_idx int, line_id int, text string, x double, y double")
    r = layout.parties_by_place(df).first()
    assert (r["buyer_name"], r["seller_name"], r["buyer_tax"], r["seller_tax"]) == ("甲样例有限公司", "乙样例股份有限公司", B, C)


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"1")
    (tmp_path / "in" / "b.txt").write_text("text")
    (tmp_path / "out" / "c.png").write_bytes(b"22")
    listed = files.listed(spark, str(tmp_path), excluded=(str(tmp_path / "out"),)).collect()
    assert sorted(r["included"] for r in listed) == [False, True]
    assert files.numbered(files.listed(spark, str(tmp_path))).count() == 2
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>a &amp; b</w:t></w:r><w:r><w:t xml:space='preserve'> c</w:t></w:r></w:p>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    assert {r["name"]: r["text"] for r in files.docx_texts(spark, str(tmp_path)).collect()} == {"d.docx": "a & b c", "e.docx": None}
    assert files.manifest(spark, str(tmp_path / "in")).where("name = 'a.PDF'").first()["size"] == 1
    tabs = spark.createDataFrame([("t\t0.1\t0.2\t0.3\t0.4",), ("bad\t1",), ("t\tx\t1\t1\t1",)], "value string")
    assert files.tab_lines(tabs).count() == 1


def test_stream_history(spark, tmp_path):
    from paperloom.streaming import traffic as st

    logs, kept = tmp_path / "logs", str(tmp_path / "kept")
    logs.mkdir()
    (logs / "access.1.log").write_text("\n".join(x for x in LOG if x))
    st.keep_history(st.log_stream(spark, str(logs)), kept, str(tmp_path / "cp")).awaitTermination()
    assert {str(r["day"]): r["pv"] for r in sinks.read_history(spark, kept).collect()} == {"2026-06-12": 2, "2026-06-13": 0}
