"""Queries of pages over whole tables, against brute force."""

import datetime
import random
import re

from pyspark.sql import functions as F

from paperloom.functions import misc, score, text
from paperloom.plans import blocks, evaluation, layout
from paperloom.queries import pages
from paperloom.sources import sinks
from paperloom.streaming import traffic as st

BOX = "line_id bigint, scan_id bigint, page_no int, x double, y double, width double, height double"


def test_small_beside_large_on_every_page(spark):
    rng = random.Random(7)
    rows = [(i, 1 + i % 2, 1 + i // 60, rng.choice([0.05, 0.1, 0.15, rng.random(), -0.02]), rng.random() / 4, rng.choice([0.01, 0.03, 0.2]), rng.choice([0.01, 0.05])) for i in range(240)]
    rows += [(900, 1, 2, None, 0.1, 0.1, 0.1), (901, 1, 2, 0.1, None, 0.01, 0.01), (902, 1, 3, 0.1, 0.1, None, 0.1), (903, None, 3, 0.1, 0.1, 0.1, 0.1)]
    rows += [(950, 9, 1, 0.1, 0.1, 0.01, 0.01), (951, 9, 1, 0.1, 0.1, 0.01, 0.01)]  # a page without large boxes
    df = spark.createDataFrame(rows, BOX).selectExpr("*", "0 AS area", "1 AS bx")
    large = lambda r: None not in r[5:7] and min(r[5:7]) >= 0.03

    def dropped(s):
        if large(s) or None in s[3:7]:
            return False
        middle = lambda r: (r[3] + r[5] / 2, r[4] + r[6] / 2)
        return any(large(g) and g[1:3] == s[1:3] and None not in (*g[1:7], s[1]) and max(abs(a - b) for a, b in zip(middle(s), middle(g))) < 0.05 for g in rows)

    got = sorted(r["line_id"] for r in layout.small_beside_large(df, ["scan_id", "page_no"], "width", "height", "x", "y", 0.03, 0.05).collect())
    want = sorted(r[0] for r in rows if not dropped(r))
    assert got == want and any(r[2] > 1 and dropped(r) for r in rows)


def test_alignment(spark):
    rows = [(0.1, 0.9, "long line"), (0.25, 0.75, "x"), (0.7, 0.8, "x"), (0.45, 0.5, "y" * 40), (0.0, 0.9, "甲 方：某"), (0.7, 0.8, "服务合同（二）"), (0.0, 0.1, None), (0.4, 0.42, "short")]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    got = [r[0] for r in df.select(misc.alignment(F.col("a"), F.col("b"), F.lit(1.0), F.col("t"))).collect()]
    assert got == ["center", "center", "right", "left", "left", "center", "left", "center"]


def test_cleaning(spark):
    rows = [("## 标题  一", "标题 一"), ("正德厚生臻子不\"甲防盖章", "不\"甲方盖章"), ("哪生臻子不\" 黑章", "盖章"), ("1硬件　粉察", "IT硬件 勘察"), ("SU\\系统", "SDN系统"), ("于至善。 平方", "甲方"), ("臻、x", "x"), (None, ""), ("\u2003a\u00a0\u00a0b\u2003", "a b")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.select(text.cleaned(F.col("t")).alias("got"), "want").where("got <> want").collect() == []


def test_poor_glyphs(spark):
    df = spark.createDataFrame([("皇后",), ("先後",), ("a|b",), (None,)], "t string")
    assert [r[0] for r in df.select(misc.poorly_read(F.col("t"))).collect()] == [False, True, True, False]


def test_boxes_kept_by_weight():
    box = lambda i, x, y, w: {"id": i, "x": x, "y": y, "width": 10.0, "height": 10.0, "weight": w}
    assert layout.spread_boxes([box(1, 0, 0, 5.0), box(2, 3, 3, 9.0), box(3, 50, 0, 5.0), box(4, 80, 0, 5.0)], 2) == [2, 3]
    assert layout.spread_boxes([], 3) == []


def test_classes_of_blocks(spark):
    table_ = lambda cells: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>"
    form = table_([["序号", "考评内容", "扣分标准", "得分"]] + [["1", "服务管理考评", "每次扣二分", "5"]] * 3)
    rows = [
        (1, "para", "考评打分表 扣分标准"), (1, "table", form), (2, "para", "甲方与乙方签订服务合同"), (3, "para", None), (4, "table", table_([["||", "%%"], ["~~", "^^"], ["--", "=="]])),
        (5, "para", "任务清单"), (5, "table", table_([["时间", "任务名称", "你需要做什么"], ["一", "二", "三"]])), (6, "para", "臻子至善"), (7, "image", None), (8, "table", table_([["扣分标准", "x"]]))]
    blocks_ = spark.createDataFrame(rows, "page int, label string, text string")
    stats = blocks.page_stats(blocks_, ["page"])
    got = {r["page"]: r for r in blocks.classes(stats, ["page"]).collect()}
    assert [p for p in got if got[p]["scoring_form"]] == [1] and [p for p in got if got[p]["contract"]] == [2]
    assert sorted(p for p in got if got[p]["blank_risk"]) == [2, 3, 6, 7] and [p for p in got if got[p]["checklist"]] == [5]
    assert [p for p in got if got[p]["watermark_heavy"]] == [6] and [p for p in got if got[p]["quality_abnormal"]] == [4]
    assert sorted(p for p in got if got[p]["dense_table"]) == [1, 4] and sorted(p for p in got if got[p]["needs_table_snapshot"]) == [8]
    assert sorted(p for p in got if got[p]["should_snapshot"]) == [3, 6, 7]
    facts = {r["page"]: r for r in blocks.page_tables(blocks_, ["page"]).collect()}
    assert facts[1]["scoring_header"] and facts[5]["task_header"] and not facts[4]["task_header"]
    pictures = spark.createDataFrame([(1, "image", 0.0, 0.0, 60.0, 60.0), (2, "image", 0.0, 0.0, 50.0, 50.0), (3, "para", 0.0, 0.0, 99.0, 99.0), (4, "figure", None, None, None, None)],
                                     "page int, label string, x0 double, y0 double, x1 double, y1 double").selectExpr("*", "100.0 AS w", "100.0 AS h")
    assert sorted(r["page"] for r in blocks.large_images(pictures, ["page"], "w", "h").where("large_image").collect()) == [1]


def test_better_reading_of_a_table(spark):
    good, poor = "<table><tr><td>清楚的文字</td></tr></table>", "<table><tr><td>%%~~</td></tr></table>"
    df = spark.createDataFrame([(good, poor), (poor, good), (good, ""), ("", good), (None, None), (good, good)], "a string, b string")
    got = [r[0] for r in df.select(blocks.best_table(F.col("a"), F.col("b"), F.lit(False))).collect()]
    assert got == [good, good, good, good, "", good]


def test_evaluation_by_page(spark):
    t = "<table><tr><td>a</td></tr></table>"
    truth = spark.createDataFrame([(1, "text", 0, False, "hello world"), (1, "text", 1, True, "left out"), (1, "table", 0, False, t), (1, "table", 1, False, t), (2, "text", 0, False, "nothing"), (2, "text", 1, None, "")],
                                  "page int, kind string, place int, ignore boolean, text string")
    given = spark.createDataFrame([(1, f"a hello   world page ![x](y) {t}")], "page int, markdown string")
    got = {(r["page"], r["kind"], r["place"]): r["score"] for r in evaluation.scored(truth, given, "page").collect()}
    assert got == {(1, "text", 0): 92.0, (1, "table", 0): 100.0, (1, "table", 1): 0.0, (2, "text", 0): 0.0}


def test_contained_text_needs_no_edits(spark):
    """The score of a contained text is that of its edit distance."""
    df = spark.createDataFrame([("abc", "xxabc"), ("abc", "abc"), ("b", "abc"), ("abcdefghijk", "abcdefghijkl")], "g string, p string")
    for r in df.select(score.best_window_score(F.col("g"), F.col("p")).alias("s"), score.edit_score(F.col("g"), F.col("p")).alias("e")).collect():
        assert r["s"] == max(r["e"], 92.0)


def test_history_survives_a_stop(spark, tmp_path):
    folder = str(tmp_path / "h")
    days = spark.createDataFrame([("2026-01-01", 1, 2, 3)], "day string, pv bigint, uv bigint, tools bigint").withColumn("day", F.to_date("day"))
    sinks.write_history(days, folder)
    (tmp_path / "h").rename(tmp_path / "h-old")  # stopped after the old one was moved away
    assert sinks.read_history(spark, folder).count() == 1
    new = st.upserted(sinks.read_history(spark, folder), days.withColumn("pv", F.lit(9)).drop("uv")).first()
    assert (new["pv"], new["uv"]) == (9, 2)


def likeness(a, b):
    x, y = re.sub(r"\s+", "", a), re.sub(r"\s+", "", b)
    if not x or not y:
        return 1.0 if x == y else 0.0
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    m, n = grams(x), grams(y)
    short, long = sorted((x, y), key=len)
    inside = 0.85 if len(short) < len(long) and short[:40] in long else 0.0
    return max(inside, 0.5 * len(m & n) / len(m | n) + 0.3 * len(short) / len(long) + 0.2 * (x[:20] == y[:20]))


def test_likeness_of_whole_texts(spark, tmp_path):
    rng = random.Random(9)
    texts = ["one line only", "first\nmiddle 🙂 line\nlast", "first\r\nother middle\r\nlast", "   ", "\n", "", None, "x", "长文本" * 3000, "长文本" * 2000 + "。"]
    texts += ["".join(rng.choice("ab 。\n🙂") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    day = datetime.datetime(2026, 1, 1)
    rows = [(i, t, ("a", "b", None)[i % 3], day + datetime.timedelta(days=i % 7) if i % 5 else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, received_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for source in ("a", "b", None):
        own = sorted((r for r in rows if r[2] == source and r[1]), key=lambda r: (r[3] is not None, r[3] or day, r[0]))
        want |= {p[0]: (q[0], round(likeness(p[1], q[1]), 5)) for p, q in zip(own, own[1:])}
    got = {r["doc_id"]: (r["next_id"], round(r["likeness"], 5)) for r in pages.text_likeness(spark, str(tmp_path)).collect()}
    assert got == want


def test_windows_over_tables(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
        return row[-1]

    def best(g, p):
        ratio = lambda b: round((1 - distance(g, b) / max(len(g), len(b))) * 100, 2)
        if not p:
            return 0.0
        if g in p:
            return max(ratio(p), 92.0)
        starts = range(0, max(0, len(p) - len(g) - 1) + 1, max(1, len(g) // 3)) if len(p) > 1.5 * len(g) else ()
        return max([ratio(p), *(ratio(p[i : i + len(g) + 80]) for i in starts)])

    lines = [(1, 7, "ABCDEFGH"), (2, 7, "xxABCDEFGHyy"), (3, 7, "z" * 150 + "ABCDEXGH"), (4, 7, ""), (5, 8, "ABCDEFGH"), (6, 9, "ABCD"), (7, 7, None), (8, 7, "ABCXEFGH")]
    spark.createDataFrame(lines, "line_id bigint, scan_id bigint, text string").write.parquet(f"{tmp_path}/ocr_lines.parquet")
    spark.createDataFrame([(7, 70), (8, None), (9, 90)], "scan_id bigint, row_id int").write.parquet(f"{tmp_path}/scan_files.parquet")
    spark.createDataFrame([(70, "ABCDEFGH"), (90, None)], "row_id int, seller_name string").write.parquet(f"{tmp_path}/invoice_records.parquet")
    got = {r["line_id"]: r["window_score"] for r in pages.edit_windows(spark, str(tmp_path)).collect()}
    assert got == {i: best("ABCDEFGH", t) for i, scan, t in lines if scan == 7 and t is not None}
