"""Problem 6 on both lists, on lists of its own, and with aliases that are given, learned or absent."""

import pytest
from pyspark.sql import functions as F

from paperloom.llm import match_list as m

TYPES = [(1, "增值税专用发票"), (2, "增值税普通发票"), (3, "增值税电子专用发票"), (4, "增值税电子普通发票"), (5, "增值税普通发票（卷票）"), (11, "出租车发票")]
GIVEN = [(1, "vat special invoice"), (4, "e-normal VAT invoice"), (11, "的士票")]


@pytest.fixture(scope="module")
def types():
    return m.Matcher(TYPES, GIVEN)


@pytest.mark.parametrize(("value", "want", "step"), [
    ("增 值税专用发票", 1, "mention"), ("【增值税普通发票（补）", 2, "mention"), ("报增值税普通发票类", 2, "mention"), ("e-normal VAT invoice。", 4, "mention"),
    ("VAT SPECIAL INVOICE", 1, "mention"), ("V AT special invoice", 1, "mention"), ("special vat invoice", 1, "tokens"), ("invoice vat special", 1, "tokens"),
    ("special vat invoce", 1, "tokens"), ("专票", 1, "abbreviation"), ("电子专票", 3, "abbreviation"), ("租车发票", 11, "abbreviation"),
    ("增值税专佣发票", 1, "tokens"), ("增值税电子普普通发票", 4, "tokens"), ("增值税普通发票（（卷票）", 5, "mention"), ("增值税普同发票（卷票）", 5, "tokens"),
    ("看附件", -1, "none"), ("单号35806", -1, "none"), ("letter", -1, "none"), ("???", -1, "none"), ("发票", -1, "none"), ("", -1, "none")])
def test_values(types, value, want, step):
    assert types.find(value) == (want, step)


def test_order_of_latin_tokens_is_free():
    assert m.Matcher([(1, "expense travel"), (2, "office rent")]).find("travel expense") == (1, "tokens")


def test_longest_mention_wins():
    own = m.Matcher([(1, "abc def"), (2, "abc"), (3, "住宿费"), (4, "业务招待餐费")], [(3, "def ghi")])
    assert [x[2] for x in own.mentions("abc def ghi")] in ([1], [3])
    assert own.find("abc") == (2, "mention")
    assert own.find("含住宿费 业务招待餐费等") == (4, "mention")
    assert own.find("see abcx") == (-1, "none")  # inside a word is no mention


def test_ties_mean_none():
    """Eight and more aliases of one entry don't hide an equally good other entry."""
    own = m.Matcher([(1, "甲乙丙丁"), (2, "甲乙丙戊")], [(1, f"甲乙丙丁辛{c}") for c in "子丑寅卯辰巳午未申"])
    assert own.find("甲乙丙") == (-1, "none")
    assert m.Matcher([(1, "abcd"), (2, "efgh")]).find("abcd efgh") == (-1, "none")


def test_index_loses_no_candidate():
    own = m.Matcher(TYPES, GIVEN)
    for value in ("增值税专佣发票", "租出车发票", "special vat invoce", "电普", "增税普通发票卷"):
        text, words = m.plain(value), m.tokens(m.plain(value))
        every = {}
        for name, i, others in own.sets:
            every[i] = max(every.get(i, 0.0), own._alike(text, words, name, others))
        found, step = own.find(value)
        if step == "tokens":
            assert every[found] == max(every.values())


def test_edits_by_brute_force():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        out = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            out = min(out, slow(a[2:], b[2:]) + 1)
        return out

    words = ["", "a", "ab", "ba", "abc", "acb", "bca", "aab", "abca"]
    for a in words:
        for b in words:
            assert m.edits(a, b) == slow(a, b)


def test_table(spark):
    ref = spark.createDataFrame(TYPES, "ref_id int, name string")
    given = spark.createDataFrame(GIVEN, "ref_id int, name string")
    rows = [(1, None), (2, ""), (3, "待确认"), (4, "增值税专用发票"), (5, "的士票"), (5, "的士票"), (6, "x" * 20_000), (7, "（未分类）")]
    df = spark.createDataFrame(rows, "row_id int, invoice_type string").selectExpr("*", "'c' AS value", "1 AS ref_id", "2 AS key", "3 AS step")
    got = sorted((r["row_id"], r["ref_id"]) for r in m.map_to_list(df, "row_id", "invoice_type", ref, given).collect())
    assert got == [(5, 11), (5, 11), (6, -1)]
    assert {r["ref_id"] for r in m.map_to_list(df, "row_id", "invoice_type", ref).collect()} == {-1}
    assert m.map_to_list(df.where("row_id > 9"), "row_id", "invoice_type", ref, given).count() == 0
    assert m.map_to_list(df, "row_id", "invoice_type", ref.where("ref_id > 99"), given).where("ref_id >= 0").count() == 0


def test_aliases_are_learned_from_records_of_one_thing(spark):
    ref = spark.createDataFrame([(1, "云服务费"), (2, "办公家具"), (3, "会议费")], "ref_id int, name string")
    names = {1: "云服务费", 2: "办公家具", 3: "会议费"}
    rows = []
    for i in range(60):
        e = i % 3 + 1
        rows += [(i, names[e]), (i, {1: "主机租赁", 2: "桌子椅子", 3: "见附件"}[e if i % 2 else 3])]
    rows += [(None, "桌子椅子"), (99, None), (100, "")]
    df = spark.createDataFrame(rows, "same int, category string").withColumn("thing", F.lit(0)).withColumn("form", F.lit("z"))
    learned = m.learned_aliases(df, "category", ref, F.col("same"))
    assert sorted(learned) == [(1, "主机租赁"), (2, "桌子椅子")]  # what stands beside every entry is no alias
    assert m.learned_aliases(df.where("same > 1000"), "category", ref, F.col("same")) == []
