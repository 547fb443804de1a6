"""Problem 5 against hand-made values and the standard's own tables."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import canon


@pytest.mark.parametrize("text", [
    "９１９９", "Ａbc", "café", "a​b", "x ", " x", "a　b", "ﬁnal", "А1B2", "Рage", "tο", "⼯商", "汽⻋", "⼀", "金金", "ab­c", "ΗΤ-2026", "供货合同 НΤ-2023-6247", "乐春Т3印务", "Ёlan", "νan", "x\u2028y", "a\x0bb", "æﬀ", "ＡＢ（甲）"])
def test_disguised(text):
    assert canon.looks_right_only(text)
    assert not canon.looks_right_only(canon.canonical(text))


@pytest.mark.parametrize("text", [None, "", "plain (text)", "中文，标点：（括号）。", "café", "Zürich", "Датчик ДТ-4", "10Ω 电阻 Δ 型", "¥12.50 — 一·二", "x  y", "①", "lower case", "СССР", "МОСТ", "КОТ", "стол СТ-4", "m²", "№ 5 … ½", "a\tb\r\nc", "µ μ"[2:]])
def test_in_order(text):
    assert not canon.looks_right_only(text)


def test_forms():
    assert canon.canonical("​９１９９ ") == "9199"
    assert canon.canonical("Кеstrelgrove (Υunquаn) Cо.") == "Kestrelgrove (Yunquan) Co."
    assert canon.folded("STRAẞE") == "strasse"
    assert canon.canonical("汽⻋⼯商") == "汽车工商"
    assert canon.canonical("a\tb\r\nc\u0085d\u2028e\x0bf") == "a b  c d e f"
    assert canon.canonical("СССР МОСТ КОТ") == "СССР МОСТ КОТ"
    assert canon.canonical(None) is None and canon.canonical("​") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_stable(text):
    fold = canon.folded(text)
    assert canon.folded(fold) == fold
    once = canon.canonical(text)
    assert canon.canonical(once) == once
    assert not any(unicodedata.category(c) == "Cf" and c in "​‌‍⁠﻿­" for c in once)


def test_found_is_what_canonical_changes():
    """Every character of the plane, inside a Latin word: found if changed, but for the exempt ones."""
    for i in (*range(0x20, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(i)
        if not canon._EXEMPT.match(c):
            assert canon.looks_right_only(f"x{c}x") == (canon.canonical(f"x{c}x") != f"x{c}x"), hex(i)
        fold = canon.folded(c)
        assert canon.folded(fold) == fold, hex(i)


def test_table(spark):
    rows = [(1, "９", None), (2, "", "ok"), (3, None, "a​"), (3, None, "a​"), (4, "x" * 100_000 + "​", "")]
    df = spark.createDataFrame(rows, "row_id int, buyer_tax string, seller_name string").selectExpr("*", "1 AS value", "2 AS key_id", "3 AS field_name")
    long = canon.fields(df, "t", "row_id", ["buyer_tax", "seller_name"])
    got = sorted((r["key_id"], r["field_name"]) for r in canon.find_disguised(long).collect())
    assert got == [(1, "buyer_tax"), (3, "seller_name"), (3, "seller_name"), (4, "buyer_tax")]
    assert canon.find_disguised(long.where("key_id > 9")).count() == 0
    assert canon.normalised(long).where("field_name = 'buyer_tax' AND key_id = 1").first()["canonical"] == "9"
