"""Problem 4: grouping without pairs against a pairwise rule; skyline against its definition."""

import datetime
import itertools

from paperloom.llm import components as cc
from paperloom.llm import survivor as s

SCHEMA = ("row_id int, buyer_name string, buyer_tax string, seller_name string, seller_tax string, invoice_date string, pretax_amount string, tax_amount string, "
          "total_amount string, tax_rate string, invoice_type string, invoice_no string, category string, line_items string, fields_needing_review array<string>, scanned_at timestamp")


def row(i, no="12345678", total="113.00", day="2025-01-05", pre="100.00", tax="13.00", goods="paper", doubt=(), at=1, seller="91990000MA0000001B"):
    return (i, "b", "91990000MA0000002E", "s", seller, day, pre, tax, total, "13%", "t", no, "c", goods, list(doubt), datetime.datetime(2025, 1, at, 10))


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS id", "1 AS label", "2 AS no", "3 AS key")
    return {r["first_row_id"]: (r["n_rows"], r["invoice_no"], r["total_amount"]) for r in s.survivors(df).collect()}


def test_same_number(spark):
    got = found(spark, [row(1), row(2, total="118.00", doubt=["total_amount"], at=3), row(3, no="No.1234 5678", total="¥113.00", at=2), row(9, no="99999999", day="2025-02-02", pre="1.00", tax="0.13", total="1.13")])
    assert got == {1: (3, "12345678", "113.00")}


def test_damaged_numbers(spark):
    no = "24960000000012345678"
    got = found(spark, [
        row(1, no=no), row(2, no="2496000000001234578", doubt=["invoice_no"], at=2), row(3, no="24960000000012345687", doubt=["invoice_no"], at=3),
        row(4, no=None, doubt=["invoice_no"], at=4), row(5, no="24960000000012345673", doubt=["invoice_no"], at=5), row(6, no="77770000000012345678", doubt=["invoice_no"], at=6)])
    assert got == {1: (5, no, "113.00")}


def test_resembling_stay_apart(spark):
    got = found(spark, [row(1, no="24960000000012345678", goods="a"), row(2, no="24960000000012345679", goods="b"), row(3, no="12345678"), row(4, no="12345678", day="2025-03-03", pre="7.00", tax="0.91", total="7.91", goods="x")])
    assert got == {}


def test_all_doubted(spark):
    got = found(spark, [row(1, no="", doubt=["invoice_no"]), row(2, no=None, doubt=["invoice_no"], at=2), row(3, no="", goods="other", doubt=["invoice_no"], at=2, pre="5.00", tax="0.65", total="5.65")])
    assert got == {1: (2, None, "113.00")}


def test_totals(spark):
    got = found(spark, [row(1, total=None, doubt=["total_amount"]), row(2, total="待确认", at=2), row(5, no="87654321", total="-1,113.00元", pre="-1000.00", tax="-113.00"), row(6, no="87654321", total="-1113.00", pre="", tax=None, at=9)])
    assert got == {1: (2, "12345678", "113.00"), 5: (2, "87654321", "-1113.00")}


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert s.survivors(df).count() == 0
    blank = [(i, *[None] * 13, None, None) for i in range(3)]
    assert s.survivors(spark.createDataFrame(blank, SCHEMA)).count() == 0


def test_fields_from_layers(spark):
    rows = [list(row(1, at=1)), list(row(2, at=2))]
    rows[1][12], rows[0][12] = None, "kept"
    r = s.survivors(spark.createDataFrame([tuple(x) for x in rows], SCHEMA)).first()
    assert r["category"] == "kept"


def test_values_of_undominated_records_come_first():
    """A value of a dominated record isn't taken ahead of an undominated one's, though its class has the latest record."""
    def cls(completeness, trust, **latest):
        return {"completeness": completeness, "trust": trust, **dict.fromkeys(("row", *s.GIVEN)),
                **{f: {"recency": r, "back": -row, "value": v} for f, (r, row, v) in latest.items()}}

    got = s.filled([
        cls(10, 3, row=(10, 1, "1"), seller_name=(10, 1, "a"), category=(9, 2, "of B")),  # A without a category, B dominated by A
        cls(11, 2, row=(5, 3, "3"), seller_name=(5, 3, "c"), category=(5, 3, "of C"))])  # C undominated
    assert (got["survivor_row_id"], got["seller_name"], got["category"]) == (1, "a", "of C")


def test_layers_of_all_records_choose_the_same_values(spark):
    """Leaving out records that are the latest in no field changes no value: random invoices by the definition."""
    import random

    rng = random.Random(11)
    names = ("seller_name", "category", "tax_rate")
    for _ in range(200):
        records = [(rng.randint(0, 2), rng.randint(0, 2), t, row, {f: f"{f}{row}" for f in names if rng.random() < 0.4}) for row, t in enumerate(rng.sample(range(50), 6))]
        classes = {}
        for c, t, at, row, values in records:
            k = classes.setdefault((c, t), {"completeness": c, "trust": t, **dict.fromkeys(("row", *s.GIVEN))})
            for f, v in {**values, "row": str(row)}.items():
                if k[f] is None or (at, -row) > (k[f]["recency"], k[f]["back"]):
                    k[f] = {"recency": at, "back": -row, "value": v}
        kept = {-k[f]["back"] for k in classes.values() for f in ("row", *names) if k[f]}
        left = [r for r in records if r[3] in kept]
        depth = s.layers([r[:3] for r in left])
        ranked = [r for _, r in sorted(zip(depth, left), key=lambda x: (x[0], -x[1][1], -x[1][0], -x[1][2], x[1][3]))]
        got = s.filled(list(classes.values()))
        assert {f: got[f] for f in names} == {f: next((r[4][f] for r in ranked if f in r[4]), None) for f in names}
        assert got["survivor_row_id"] == ranked[0][3]


def test_every_doubt_counts(spark):
    """Seven doubted fields are less trusted than six; doubts of unknown fields don't count."""
    six = ["buyer_name", "buyer_tax", "seller_name", "seller_tax", "tax_rate", "line_items"]
    rows = [row(1, doubt=[*six, "category"], at=9), row(2, doubt=[*six, "x", "y"], at=1)]
    assert s.survivors(spark.createDataFrame(rows, SCHEMA)).first()["survivor_row_id"] == 2


def test_layers_by_definition():
    points = [(a, b, c) for a, b, c in itertools.product(range(3), repeat=3)] + [(1, 1, 1)]
    beats = lambda p, q: all(x >= y for x, y in zip(p, q)) and p != q
    left, want, depth = set(range(len(points))), {}, 0
    while left:
        front = {i for i in left if not any(beats(points[j], points[i]) for j in left)}
        want |= dict.fromkeys(front, depth)
        left -= front
        depth += 1
    assert s.layers(points) == [want[i] for i in range(len(points))]


def test_components_by_search(spark):
    keyed = [(i, f"k{i // 2}") for i in range(40)] + [(i, f"m{(i + 1) // 2}") for i in range(20)] + [(60, "z"), (60, "z"), (61, None)]
    ids = spark.createDataFrame([(i,) for i in [*range(40), 60, 61]], "id int")
    got = {r["id"]: r["label"] for r in cc.components(ids, spark.createDataFrame(keyed, "id int, key string")).collect()}
    parent = {i: i for i in [*range(40), 60, 61]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, k in keyed:
        if k is not None:
            by.setdefault(k, []).append(i)
    for group in by.values():
        for i in group[1:]:
            a, b = sorted((root(group[0]), root(i)))
            parent[b] = a
    assert got == {i: root(i) for i in parent}
