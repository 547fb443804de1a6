"""Problem 3: trie against brute force, page lines, a small scanned file."""

import random

import pandas as pd
import pytest

from paperloom.llm import pages as g
from paperloom.llm.trie import Trie

SCHEMA = "line_id long, scan_id long, page_no int, line_idx int, text string, x double, y double, width double, height double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_by_brute_force():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(200)}
    trie = Trie((w, 1) for w in words)
    for q in list(words)[:40] + ["", "zzz"]:
        for d in (0, 1, 2):
            assert {w for w, _ in trie.within(q, d)} == {w for w in words if distance(q, w) <= d}


@pytest.mark.parametrize(("text", "want"), [
    ("- 12 -", True), ("第 3 页", True), ("第3页 共9页", True), ("Page 3 of 9", True), ("p. 4", True), ("iii", True), ("7/12", True), ("12", True), ("Seite 2 von 5", True),
    ("Pagc 3 of 9", True), ("HT-2026-9393", False), ("Section 4 | 12", False), ("内部资料", False), ("", False), (None, False), ("DA-0001", False)])
def test_page_only(text, want):
    assert g.page_only(text) is want


@pytest.mark.parametrize(("text", "n"), [("合计7,4O3.88元", 1), ("A4 B5 XR-20 70g", 0), ("第Z条", 1), ("20Z5-01-02", 1), ("91990000MA0000001B", 0), ("91990000MA0000001C", 1), ("12,345.67", 0)])
def test_numbers(text, n):
    assert len(g.bad_numbers(text)) == n


def test_differences():
    assert g.differences("includcd", "included") == ["e>c"]
    assert g.differences("becaiise", "because") == ["u>ii"]
    assert g.differences("cell", "cells") is None
    assert g.differences("a9rced", "agreed") == ["g>9", "e>c"]
    assert g.differences("abcdef", "uvwxyz") is None


def scan():
    text = ("The supplier delivers all machines after written confir-|mation of the price. The cost-|effective copy is archived by the department|"
            "and the internal audit checks every invoice within|ten working days. The machines are included in the|agreed price of the contract and the party may").split("|")
    rows, i = [], 0
    for scan_id in range(1, 17):
        for page in (1, 2):
            i += 1
            rows.append((i, scan_id, page, 0, "Service Contract", 0.4, 0.968, 0.2, 0.012))
            for k, t in enumerate(text):
                if scan_id == 3 and page == 1 and k == 4:
                    t = t.replace("included", "includcd").replace("machines", "machincs")
                if scan_id == 4 and page == 1 and k == 3:
                    t = t.replace("every", "evcry")
                i += 1
                rows.append((i, scan_id, page, k + 1, t, 0.13 if k == 0 else 0.1, 0.9 - k / 30, 0.5, 0.016))
            i += 1
            rows.append((i, scan_id, page, 9, f"- {page} -", 0.48, 0.03, 0.03, 0.011))
    rows.append((9001, 50, 1, 0, None, 0.1, 0.5, 0.1, 0.016))
    rows.append((9002, 50, 1, 1, "", None, None, None, None))
    rows += [(10_000 + k, 60, 1, k, "cost-effective follow-up", 0.1, 0.5, 0.3, 0.016) for k in range(6)]
    return rows


def test_noise(spark):
    rows = scan()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS plain", "1 AS zone", "2 AS next", "3 AS kind")
    got = {(r["line_id"], r["kind"]) for r in g.noise(df).collect()}
    want = set()
    for r in rows:
        t = r[4] or ""
        if t == "Service Contract":
            want.add((r[0], "running"))
        if t.startswith("- "):
            want.add((r[0], "page_no"))
        if t.endswith("confir-"):
            want.add((r[0], "hyphen"))
        if "includcd" in t or "evcry" in t:
            want.add((r[0], "misread"))
    assert got == want


def test_paragraphs(spark):
    df = spark.createDataFrame(scan(), SCHEMA)
    got = {(r["scan_id"], r["para_no"]): r["text"] for r in g.paragraphs(df).collect()}
    assert got[3, 1].startswith("The supplier delivers all machines after written confirmation of the price. The cost-effective copy")
    assert "machines are included in the agreed price" in got[3, 1] and "Service" not in got[3, 1]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert g.noise(df).count() == 0 and g.paragraphs(df).count() == 0


def test_surroundings_by_brute_force(monkeypatch):
    """Keys of every ideograph against plain slices; lots of any size give the same."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("税号 1٣a发票\U00020000。") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "号", "号" * 500]

    def pack(chars):
        out = 0
        for c in chars:
            out = out << 16 | min(ord(c), 0xFFFF)
        return out

    want = []
    for n, t in enumerate(texts):
        at = [i for i, c in enumerate(t) if not c.isspace()]
        s = "^^^" + "".join("0" if t[i].isdigit() else t[i] for i in at) + "$$$"
        want += [(n, i, pack(s[k : k + 3]), pack(s[k + 4 : k + 7]), pack(s[k + 1 : k + 3] + s[k + 4 : k + 6]), ord(t[i])) for k, i in enumerate(at) if "一" <= t[i] <= "鿿"]
    for places, signs in ((7, 50), (10_000, 10_000), (3, 1)):
        monkeypatch.setattr(g, "PLACES", places)
        monkeypatch.setattr(g, "SIGNS", signs)
        got = []
        for first, lot in g._lots(pd.Series(texts)):
            for text, at, keys, c in g.surroundings(lot):
                got += [(first + int(n), int(i), *(int(k[j]) for k in keys), int(c[j])) for j, (n, i) in enumerate(zip(text, at))]
        assert sorted(got) == sorted(want)


def test_filter_holds_every_key(spark):
    keys = [f"word{i}" for i in range(3000)]
    hashes = g._hashed(keys)
    table = g.bit_filter(spark.createDataFrame([(int(h),) for h in hashes], "h long"))
    assert g.held(table, hashes).all()
    others = g._hashed([f"other{i}" for i in range(3000)])
    assert g.held(table, others).mean() < 0.15


def test_short_words_with_two_letters_for_one():


    known = pd.DataFrame({"word": ["valid", "date", "have"], "n": [900, 800, 5000]})
    got = g._retrieve((0, 0), pd.DataFrame({"word": ["vahd", "dafe"], "n": [2, 2]}), known)
    assert {(r.word, r.right) for r in got.itertuples()} == {("vahd", "valid"), ("dafe", "date")}
