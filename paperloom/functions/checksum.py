"""Check digit of the 18-character unified credit code, as one built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code's alphabet and the weights of its first 17 places.
ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def check_character(code: Column) -> Column:
    """The character that place 18 must have."""
    places = F.sequence(F.lit(1), F.lit(17))
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    terms = F.transform(places, lambda i: (F.instr(F.lit(ALPHABET), F.substr(code, i, F.lit(1))) - 1) * F.element_at(weights, i))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + x)
    return F.substr(F.lit(ALPHABET), F.pmod(31 - F.pmod(total, F.lit(31)), F.lit(31)) + 1, F.lit(1))


def valid_credit_code(code: Column) -> Column:
    """True for a well-formed code with the right last character; case and outer blanks don't matter; null is false."""
    c = F.upper(F.trim(code))
    return F.coalesce(c.rlike(f"^[{ALPHABET}]{{18}}$") & (F.substr(c, F.lit(18), F.lit(1)) == check_character(c)), F.lit(False))
