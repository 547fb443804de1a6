"""Problem 2: names taken apart, scored, and linked."""

import pytest

from paperloom.llm import parties as p

PLACES, TRADES = frozenset({"长浦", "石津", "云泉"}), frozenset({"科技", "环保设备", "印务", "打印店"})
CODES = ["91990000MA0000001B", "91990000MA0000002E", "91990000MA0000003H", "91990000MA0000004L"]


@pytest.mark.parametrize(("name", "want"), [
    ("长浦朗朴祺骏科技有限公司", ("长浦", "朗朴祺骏", "科技", "")), ("朗朴祺骏(长浦)科技有限公司", ("长浦", "朗朴祺骏", "科技", "")),
    ("长浦市朗朴祺骏科技有公限司", ("长浦", "朗朴祺骏", "科技", "")), ("科技有限公司长浦朗朴祺骏", ("长浦", "朗朴祺骏", "科技", "")),
    ("石津品安泰雨打印店(个体工商户)", ("石津", "品安泰雨", "打印店", "")), ("老品安泰雨", ("", "品安泰雨", "", "")), ("品安泰雨家", ("", "品安泰雨", "", "")),
    ("云泉荣隆峰清环保设备有限责任公司石津分公司", ("云泉", "荣隆峰清", "环保设备", "石津")), ("朗朴祺骏科技(股份)有限公司", ("", "朗朴祺骏", "科技", ""))])
def test_apart(name, want):
    got = p.take_apart(name, PLACES, TRADES)
    assert tuple(got[k] for k in ("place", "core", "trade", "branch")) == want


def test_lcs_by_brute_force():
    from itertools import combinations

    def slow(a, b):
        subs = lambda t: {"".join(c) for n in range(len(t) + 1) for c in combinations(t, n)}
        return max(len(x) for x in subs(a) & subs(b))

    for a in ("", "ab", "abcab", "xyz"):
        for b in ("", "ba", "bcaab", "azy"):
            assert p.lcs(a, b) == slow(a, b)


def test_score():
    a = lambda n: p.take_apart(n, PLACES, TRADES)
    assert p.score(a("长浦朗朴祺骏科技有限公司"), a("石津朗朴祺骏科技有限公司")) == 0
    assert p.score(a("云泉荣隆峰清科技有限公司"), a("云泉荣隆峰清科技有限公司石津分公司")) == 0
    assert p.score(a("朗朴棋骏科技有限公司"), a("长浦朗朴祺骏科技有限公司")) > 0.7
    assert p.score(a("fiskalund auditing"), a("fiskalund auditing (pingsong) co., ltd.")) > 0.9
    assert p.score(a("jml luoping"), a("jøndal marine (luoping) co., ltd.")) > 0.8


def rows():
    cores = ["朗朴祺骏", "虹璟丰钰", "裕鸿建启", "祺湖德林"]
    out = []
    for core, code in zip(cores, CODES):
        for place in ("长浦",):
            full = f"{place}{core}科技有限公司"
            out += [(full, code), (full, None), (f"{place} {core} 科技有限公司", code), (f"{core}({place})科技有限公司", None), (f"{core}科技有限公司", None)]
    return out + [("名称：长浦朗朴祺骏科技有限公司", ""), ("长浦朗朴祺​骏科技有限公司", "待确认"), ("老裕鸿建启", CODES[2]), ("待确认", CODES[0]), ("", None), (None, CODES[1]), ("个人", "个人无税号")]


def records(spark, pairs):
    full = [(i, n, t, n, t, "2025-01-01", None) for i, (n, t) in enumerate(pairs)]
    return spark.createDataFrame(full, "row_id int, buyer_name string, buyer_tax string, seller_name string, seller_tax string, invoice_date string, invoice_no string").selectExpr("*", "'c' AS name", "1 AS party", "2 AS raw")


def test_linked(spark):
    got = {(r["name_a"], r["name_b"]) for r in p.linked_spellings(records(spark, rows())).collect()}
    groups = {}
    for n, _ in rows():
        if n and n not in p.NO_NAMES:
            core = next(c for c in ("朗朴祺骏", "虹璟丰钰", "裕鸿建启", "祺湖德林") if c in n.replace("​", "").replace(" ", ""))
            groups.setdefault(core, set()).add(n)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert got == want


def test_empty(spark):
    assert p.linked_spellings(records(spark, rows()).where("row_id < 0")).count() == 0


def test_different_numbers_stay_apart(spark):
    pairs = [("长浦甲乙丙丁科技有限公司", CODES[0]), ("长浦甲乙丙戊科技有限公司", CODES[1]), ("x" * 5000, None)]
    assert p.linked_spellings(records(spark, pairs)).count() == 0


def test_blocking_alone(spark):
    """Names asked as if they had no number find their party by suffixes; none finds itself."""
    places, trades = frozenset({"北城", "南城"}), frozenset({"信息技术", "机电设备"})
    names = {"北城瑞丰恒信息技术有限公司": "A", "北城瑞丰恒信息技术公司": "A", "瑞丰恒信息技术(北城)有限公司": "A", "南城华庆朗机电设备有限公司": "B", "南城华庆郎机电设备有限公司": "B", "北城单独机电设备有限公司": "C"}
    rows = [(n, p.take_apart(p.plain_name(n), places, trades), c) for n, c in names.items()]
    df = spark.createDataFrame([(n, tuple(x[k] for k in ("place", "core", "trade", "branch")), c) for n, x, c in rows],
                               "name string, parts struct<place:string,core:string,trade:string,branch:string>, code string")
    got = {r["name"]: r["code"] for r in p._match(df.select("name", "parts"), df).collect()}
    assert got == {n: c for n, c in names.items() if c != "C"}
    assert p._match(df.where("false").select("name", "parts"), df).count() == 0
