"""Hand-worked cases of field extraction and small rules."""

import datetime

from pyspark.sql import functions as F

from paperloom.functions import misc
from paperloom.plans import extraction as ex

LINE = "scan_id int, page_no int, line_idx int, line_id int, text string, x double, y double"


def lines(spark, texts, scan=1):
    return spark.createDataFrame([(scan, 1, i, i, t, 0.1, 0.95 - i / 50) for i, t in enumerate(texts)], LINE)


def test_fields(spark):
    got = ex.invoice_fields(lines(spark, ["电子发票（增值税专用发票）", "发票号码：12345678", "开票日期：2026年3月6口", None, "*文具*签字笔 13%", "¥100.00", "¥13.00", "价税合计（小写）¥113.00", ""])).first()
    assert (got["day"], got["no"], got["kind"], got["rate"], got["item"], got["total"], got["tax"], got["pretax"]) == (
        "2026-03-06", "12345678", "增值税专用发票", "13%", "*文具*签字笔13%", 113.0, 13.0, 100.0)
    loose = ex.invoice_fields(lines(spark, ["x", "20 87654321 9", "11112222"])).first()
    assert loose["no"] == "11112222"  # nearest to the usual height
    assert ex.invoice_fields(lines(spark, [])).count() == 0


def test_parties(spark):
    b, s = "91990000MA0000001B", "91990000MA0000002E"
    got = ex.sections_of_parties(lines(spark, ["购买方信息", "名称：甲样例有限公司", b, "销售方信息", "名称：乙样例有限公司", f"税号：{s}"])).first()
    assert (got["buyer_name"], got["buyer_tax"], got["seller_name"], got["seller_tax"]) == ("甲样例有限公司", b, "乙样例有限公司", s)
    same = ex.sections_of_parties(lines(spark, ["购买方信息", "名称：甲样例有限公司", "销售方信息", "名称：甲样例有限公司"])).first()
    assert same["seller_name"] is None
    assert ex.sections_of_parties(lines(spark, ["名称：甲样例有限公司"])).count() == 0


def test_small_rules(spark):
    one = lambda *c: list(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    v = lambda a, b: misc.bumped(F.lit(a), F.lit(b))
    assert one(v("1.2.3", "major"), v("1.2.3", "minor"), v("1.2.3", None), v("x", "patch")) == ["2.0.0", "1.3.0", "1.2.4", "0.0.1"]
    day = F.lit(datetime.date(2026, 1, 5))
    assert one(misc.next_build(F.lit("2026.01.05.4"), day), misc.next_build(F.lit(None), day)) == ["2026.01.05.5", "2026.01.05.1"]
    assert one(misc.company_chunks(F.lit("甲样例有限公司上海分公司，乙商行;丙")))[0] == ["甲样例有限公司", "上海分公司"]
    assert one(misc.corners(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(5.0)))[0] == [1.0, 2.0, 11.0, 2.0, 11.0, 5.0, 1.0, 5.0]
    assert one(misc.padded(F.array(F.lit("a")), 3), misc.padded(F.array(*map(F.lit, "abcd")), 3)) == [["a", "", ""], ["a", "b", "c"]]


def test_notes(spark):
    df = spark.createDataFrame([(1, "- zero\nAdded: one\n- two\nfixed:\n* three"), (2, None), (3, "")], "id int, note string")
    assert [(r["kind"], r["entry"]) for r in ex.changes_by_kind(df, "id", "note").orderBy("n").collect()] == [
        ("changed", "zero"), ("added", "one"), ("added", "two"), ("fixed", "three")]


def test_order(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, "a", 0.5, 0.9), (1, 1, 1, 1, "b", 0.1, 0.9), (1, 1, 2, 2, "c", None, None), (1, 1, 3, 3, "d", 0.1, 0.95)], LINE)
    assert [r["line_id"] for r in ex.reading_order(df).orderBy("place").collect()] == [3, 1, 0, 2]
