"""Packed fields: hand-worked cases, edge cases, and a brute-force search of the lattice."""

import itertools
import math

import pytest

from paperloom.functions.segments import lex
from paperloom.operators import unpack


def items(spark, texts, extra=False):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, packed string, pos string")
    out = {}
    for r in unpack.unpack_values(df, "id", "packed").orderBy("id", "pos").collect():
        out.setdefault(r["id"], []).append(r["item"])
    return [out.get(i, []) for i in range(len(texts))]


HEADS = ["stapler", "printer", "paper", "lamp", "toner", "desk"]


@pytest.fixture(scope="module")
def solved(spark):
    background = [f"{h}; {g}" for h, g in itertools.permutations(HEADS, 2)] + [f"{h} A4" for h in HEADS for _ in range(3)] + HEADS
    asked = [
        "stapler A4; printer", "stapler printer lamp", "stapler A4 printer", "1、stapler\n2、*office*printer\n3、lamp",
        '"a, b","c ""d"" e"', "“x，y”“z”", "(1)desk（red;blue）；(2)lamp A4", "①desk②lamp", "desk1/2 ; lamp 1,000", ";;desk; ;lamp;;",
        "*a*desk *b*lamp", "desk（大/中）|lamp", "「desk」 「lamp A4」", "1.stapler A4 2.desk", None, "", " ;; ", 'screen27"', "desk\r\nlamp",
    ]
    got = items(spark, asked + background)
    return dict(zip(map(str, asked), got))


@pytest.mark.parametrize(("text", "want"), [
    ("stapler A4; printer", ["stapler A4", "printer"]), ("stapler printer lamp", ["stapler", "printer", "lamp"]),
    ("stapler A4 printer", ["stapler A4", "printer"]), ("1、stapler\n2、*office*printer\n3、lamp", ["stapler", "*office*printer", "lamp"]),
    ('"a, b","c ""d"" e"', ["a, b", 'c "d" e']), ("“x，y”“z”", ["x，y", "z"]), ("(1)desk（red;blue）；(2)lamp A4", ["desk（red;blue）", "lamp A4"]),
    ("①desk②lamp", ["desk", "lamp"]), ("desk1/2 ; lamp 1,000", ["desk1/2", "lamp 1,000"]), (";;desk; ;lamp;;", ["desk", "lamp"]),
    ("*a*desk *b*lamp", ["*a*desk", "*b*lamp"]), ("desk（大/中）|lamp", ["desk（大/中）", "lamp"]), ("「desk」 「lamp A4」", ["desk", "lamp A4"]),
    ("1.stapler A4 2.desk", ["stapler A4", "desk"]), ("None", []), ("", []), (" ;; ", []), ('screen27"', ['screen27"']), ("desk\r\nlamp", ["desk", "lamp"]),
])
def test_splits(solved, text, want):
    assert solved[text] == want


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "id int, packed string")
    assert unpack.unpack_values(empty, "id", "packed").count() == 0
    assert items(spark, ["a;b", "a;b", "a;b"]) == [["a", "b"]] * 3


def test_long_text(spark):
    many = ";".join(f"v{i}" for i in range(5000))
    assert items(spark, [many])[0] == [f"v{i}" for i in range(5000)]


def test_unclosed_marks():
    assert [a for _, a, _ in lex("“desk, lamp")] == ["“desk", "lamp"]
    assert [a for _, a, _ in lex("desk（red, lamp")] == ["desk（red", "lamp"]


def test_lattice_equals_all_paths():
    steps = [{"i": i, "ah": h, "at": t, "ph": 1.0, "pt": 2.0, "nh": 50.0, "nt": 40.0, "starred": s}
             for i, (h, t, s) in enumerate([(9, 0, False), (1, 7, False), (5, 5, False), (0, 3, True), (2, 2, False)])]
    w = [unpack._weights(s) for s in steps]
    a, b = unpack.TAIL_AFTER_HEAD, unpack.TAIL_AFTER_TAIL
    go = {(0, 0): 1 - a, (0, 1): a, (1, 0): 1 - b, (1, 1): b}
    best, mass, post = (-1.0, None), 0.0, [0.0] * 5
    for path in itertools.product((0, 1), repeat=4):
        full = (0, *path)
        p = math.prod(w[i][full[i]] * go[full[i - 1], full[i]] for i in range(1, 5))
        best, mass = max(best, (p, full)), mass + p
        for i, k in enumerate(full):
            post[i] += p * (k == 0)
    got_post, got_path = unpack._lattice(steps)
    assert [1 - k for k in best[1]] == got_path
    assert got_post == pytest.approx([p / mass for p in post])
