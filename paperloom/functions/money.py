"""Amounts, rates and their arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates in use, rates that are inferred, and the tolerance of sums.
COMMON_RATES = (0.0, 1.0, 3.0, 5.0, 6.0, 9.0, 13.0)
INFERRED_RATES = (1.0, 3.0, 6.0, 9.0, 13.0)
INFER_WITHIN = 0.6
TOLERANCE = 0.05
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def stripped(c: Column) -> Column:
    """Text without outer white space of any kind; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def amount(c: Column) -> Column:
    """Double of an amount written with separators and signs of currency; null if it is none.

    Only digits, point and exponent are numbers here: words like "nan" and digits grouped
    with underscores are not.
    """
    plain = F.translate(stripped(c), ",￥¥元", "")
    return F.when(plain.rlike(NUMBER), plain.cast("double"))


def rate(c: Column) -> Column:
    """Per cent as double; exempt and untaxed count as 0; null if not a rate."""
    t = stripped(c)
    return F.when(t.isin("免税", "不征税", "0%"), F.lit(0.0)).when(t.rlike(r"^\d{1,2}(\.\d+)?%$"), F.regexp_extract(t, r"^([\d.]+)%$", 1).cast("double"))


def differs(a: Column, b: Column) -> Column:
    """True if two amounts differ by more than the tolerance; null if one is missing."""
    return F.abs(a - b) > TOLERANCE


def adds_up(pretax: Column, tax: Column, total: Column) -> Column:
    return ~differs(pretax + tax, total)


def conflicts(pretax: Column, tax: Column, total: Column, pct: Column, is_pdf: Column) -> Column:
    """True if sum or rate contradict; rates of a PDF whose sum is right are not held against it."""
    false = F.lit(False)
    sum_wrong = F.coalesce(differs(pretax + tax, total), false)
    right_sum = F.coalesce(adds_up(pretax, tax, total), false)
    by_rate = F.coalesce(differs(pretax * pct / 100, tax), false) | F.coalesce(differs(total / (1 + pct / 100), pretax), false)
    complete = pretax.isNotNull() & tax.isNotNull() & total.isNotNull() & pct.isNotNull()
    return sum_wrong | ((~is_pdf | ~right_sum) & complete & by_rate)


def inferred_rate(pretax: Column, tax: Column) -> Column:
    """The usual rate nearest to tax / pretax, if within reach; the smaller of two equally near."""
    pct = tax / pretax * 100
    near = F.array_min(F.array(*(F.struct(F.abs(pct - r).alias("d"), F.lit(r).alias("r")) for r in INFERRED_RATES)))
    return F.when((pretax > 0) & (near["d"] <= INFER_WITHIN), near["r"])


def shown_width(c: Column) -> Column:
    """Columns a text takes: two for every character beyond ASCII."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
