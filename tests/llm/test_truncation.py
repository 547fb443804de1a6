"""Problem 9: prefixes against brute force, and judged ends."""

import random

from pyspark.sql import functions as F

from paperloom.llm import truncation as t

SENTENCES = ["The supplier delivers the goods within ten days", "Payment is due after written notice by mail", "Both parties keep the records for five years",
             "请确认编号是否与封面一致", "导出的文档在手机上显示正常", "本合同双方各执一份备案"]


def corpus():
    out, i = [], 0
    for a in SENTENCES:
        for b in SENTENCES:
            stop = "。" if a > "一" else ". "
            out.append((i := i + 1, f"{a}{stop}{b}{'。' if b > '一' else '.'}", "s"))
    return out


def test_short_prefixes_by_brute_force(spark):
    """Values of every length are compared, across partitions too; nulls and empty ones are left out."""
    rng = random.Random(3)
    values = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(150)} | {"zz" * 20, "zz" * 30}
    df = spark.createDataFrame([(v, True) for v in values] * 2 + [(None, True), ("", True)], "v string, whole boolean")
    want = {v for v in values if any(w != v and w.startswith(v) for w in values)}
    assert {r["v"] for r in t.continuations(df).collect()} == want


def test_dots_at_a_limit(spark):
    """Dots are the author's own, unless texts with dots pile up at one length of the source."""
    own = [(i, f"We are still waiting for the {'x' * i} parts...", "s") for i in range(30) if i != 25]
    put = [(100 + i, f"{i:02d} The clerk of the desk will send the sum of the list to th...", "s") for i in range(20)]
    other = [(200, put[0][1] + "", "r"), (201, "99 The clerk of the desk will send the sum of the list to us...", "r")]
    df = spark.createDataFrame(own + put + other, "doc_id int, text string, source string")
    assert {r["doc_id"] for r in t.cut_texts(df).collect()} == {100 + i for i in range(20)}


def test_ends(spark):
    whole = ["Regards\nThe desk", "as agreed.\n| a | 1 |", "see scan.\nreport.docx", "Thanks for the goods 🙂", "and so on......", SENTENCES[4], "", "   ", None, SENTENCES[0]]
    cut = ["The supplier delivers the goods wit", "Payment is due after written noti", "请确认编号是否与封", "本合同双方各执�", "Both parties keep the records for"]
    rows = corpus() + [(1000 + i, x, "s") for i, x in enumerate(whole)] + [(2000 + i, x, "s") for i, x in enumerate(cut)] + [(3000 + i, f"text number {i} goes here.\nRegards\nThe desk", "r") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("body", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r["doc_id"] for r in t.cut_texts(df).collect()}
    assert got == {2000 + i for i in range(len(cut))}
    rates = {r["source"]: (r["n_docs"], r["n_cut"]) for r in t.cut_rates(df).collect()}
    assert rates["s"][1] == len(cut) and rates["r"] == (4, 0)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string, source string")
    assert t.cut_texts(df).count() == 0


def test_repeats_and_nulls(spark):
    rows = corpus() + [(500, "The supplier delivers the goods wit", None), (501, "The supplier delivers the goods wit", "s"), (502, "y" * 200_000 + ".", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    assert {r["doc_id"] for r in t.cut_texts(df).collect()} == {500, 501}


def test_prefixes_decide(spark, monkeypatch):
    """Ends that look complete, but a longer copy goes on; without the join these rows are lost."""
    more = ["The list names the goods within ten days of the month", "The annex of nine pages in file list.xlsx shows all sums", "The scan was kept in folder nine as given to us"]
    rows = corpus() + [(600, f"{more[0]}. {SENTENCES[1]}.", "s"), (601, f"{more[1]}. {SENTENCES[2]}.", "s"), (602, f"{more[2]}. Our desk has closed. {SENTENCES[2]}.", "s")]
    rows += [(610 + i, f"{a}, as agreed. {SENTENCES[2]}.", "s") for i, a in enumerate(SENTENCES[:3])]  # an appendix
    cut = [(700, "The list names the goods within ten days", "s"), (701, "The annex of nine pages in file list.xlsx", "s"), (702, "The annex of nine pages in file list.", "s"),
           (703, f"{more[2]}. Our desk has closed.", "s")]
    whole = [(710, SENTENCES[0], "s"), (711, f"{SENTENCES[0]}.", "r"), (712, f"{SENTENCES[0]}. {SENTENCES[1]}.", "r")]
    df = spark.createDataFrame(rows + cut + whole, "doc_id int, text string, source string")
    assert {r["doc_id"] for r in t.cut_texts(df).collect()} == {700, 701, 702, 703}
    with monkeypatch.context() as m:
        none = t.continuations
        m.setattr(t, "continuations", lambda values: none(values).where("false"))
        assert t.cut_texts(df).count() == 0


def test_continuations_by_brute_force(spark):
    rng = random.Random(5)
    values = {"x" * 18 + "".join(rng.choice("ab") for _ in range(rng.randint(2, 9))): rng.random() < 0.4 for _ in range(300)}
    got = {r["v"]: (r["whole"], r["rest"]) for r in t.continuations(spark.createDataFrame(list(values.items()), "v string, whole boolean")).collect()}
    want = {}
    for v, whole in values.items():
        longer = sorted(w for w in values if w != v and w.startswith(v))
        if longer:
            want[v] = (whole, next((w[len(v):] for w in longer if values[w]), None))
    assert got == want
