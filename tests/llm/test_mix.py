"""Problem 8: shares, caps, redistribution."""

import pytest

from paperloom.llm import mix as m

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def docs(spark, sizes):
    rows, i = [], 0
    for source, lang, n, words in sizes:
        for _ in range(n):
            i += 1
            rows.append((i, " ".join(WORDS[(i + k) % 8] for k in range(words)), lang, source))
    rows += [(i + 1, None, "en", "a"), (i + 2, "", "en", "a"), (i + 3, "stray text", None, None)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").selectExpr("*", "1 AS budget", "2 AS epoch")


def weights(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares(spark):
    d = docs(spark, [("a", "en", 300, 20), ("a", "DE", 100, 20), ("b", "en", 40, 20), ("c", "zh", 50, 20)])
    picked, shares = m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.3, 3), ("missing", 0.2, 2)]))
    s = {r["source"]: r for r in shares.collect()}
    assert s["a"]["actual_share"] == pytest.approx(0.5 / 0.8, abs=0.01) and s["b"]["actual_share"] == pytest.approx(0.3 / 0.8, abs=0.01)
    assert s["c"]["mix_tokens"] == 0 and s["c"]["actual_share"] is None and s["missing"]["actual_share"] == 0.0
    rows = picked.collect()
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    assert all(r["epoch"] < 3 for r in rows) and {r["source"] for r in rows} == {"a", "b"}
    again = m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.3, 3), ("missing", 0.2, 2)]))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    other = m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.3, 3), ("missing", 0.2, 2)]), seed=5)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_siblings_before_ancestors():
    leaves = [
        {"path": ("x", "en", "p"), "weight": 0.4, "capacity": 10.0}, {"path": ("x", "en", "q"), "weight": 0.2, "capacity": 100.0},
        {"path": ("x", "de", "p"), "weight": 0.2, "capacity": 100.0}, {"path": ("y", "en", "r"), "weight": 0.2, "capacity": 100.0}]
    m.settle(leaves, 100.0)
    assert [round(x["budget"]) for x in leaves] == [10, 50, 20, 20]
    leaves[1]["capacity"] = 30.0
    m.settle(leaves, 100.0)
    assert [round(x["budget"]) for x in leaves] == [10, 30, 40, 20]
    leaves[2]["capacity"] = 25.0
    m.settle(leaves, 100.0)
    assert [round(x["budget"]) for x in leaves] == [10, 30, 25, 35]


def test_budget_and_caps(spark):
    d = docs(spark, [("a", "en", 30, 20), ("b", "en", 30, 20)])
    picked, shares = m.mix(d, weights(spark, [("a", 0.9, 1), ("b", 0.1, 2)]), budget=10_000)
    s = {r["source"]: r for r in shares.collect()}
    assert s["a"]["epochs"] == 1 and s["b"]["epochs"] == 2
    assert s["a"]["mix_tokens"] == s["a"]["available_tokens"] and s["b"]["mix_tokens"] == 2 * s["b"]["available_tokens"]


def test_empty(spark):
    d = docs(spark, []).where("doc_id < 0")
    picked, shares = m.mix(d, weights(spark, [("a", 1.0, 1)]))
    assert picked.count() == 0 and shares.count() == 1


def test_shortages_go_to_siblings_through_the_operator(spark):
    """A source without enough tokens: the other source of its domain and language makes up for it, no other."""
    d = docs(spark, [("a", "en", 5, 20), ("b", "en", 300, 20), ("b", "de", 300, 20), ("c", "en", 300, 20)])
    domains = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "source string, domain string")
    w = weights(spark, [("a", 0.3, 1), ("b", 0.4, 1), ("c", 0.3, 1)])
    s = {r["source"]: r["mix_tokens"] for r in m.mix(d, w, budget=6000, domains=domains)[1].collect()}
    most = 30  # tokens of a document at most
    assert s["a"] < 200 and abs(s["b"] - (2400 + 1800 - s["a"])) <= most and abs(s["c"] - 1800) <= most
    alone = {r["source"]: r["mix_tokens"] for r in m.mix(d, w, budget=6000)[1].collect()}  # no common domain: all others share
    assert alone["b"] < s["b"] and alone["c"] > s["c"]


def test_sources_miss_by_less_than_a_document(spark):
    """Many leaves with long documents: their roundings don't add up."""
    d = docs(spark, [("a", f"l{i}", 8, 150) for i in range(12)] + [("b", "en", 400, 20)])
    s = {r["source"]: r for r in m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), budget=12_000)[1].collect()}
    assert abs(s["a"]["mix_tokens"] - 6000) < 300 and abs(s["b"]["mix_tokens"] - 6000) < 40


def test_zero_capacity_and_refusal(spark, monkeypatch):
    d = docs(spark, [("a", "en", 30, 20), ("b", "en", 30, 20)])
    s = {r["source"]: r["mix_tokens"] for r in m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.5, 0)]))[1].collect()}
    assert s["a"] > 0 and s["b"] == 0
    monkeypatch.setattr(m, "MOST_LEAVES", 1)
    with pytest.raises(ValueError):
        m.mix(d, weights(spark, [("a", 0.5, 1), ("b", 0.5, 1)]))
