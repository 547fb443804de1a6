"""Similarity of texts and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import compact

# Score of a contained text, its shortest window beyond, weights of the parts.
CONTAINED, EXTRA = 92.0, 80
TEXT_WEIGHT, TABLE_WEIGHT = 0.6, 0.4


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def edit_score(a: Column, b: Column) -> Column:
    """Per cent of ``edit_ratio`` of the compact texts, two places."""
    return F.bround(edit_ratio(compact(a), compact(b)) * 100, 2)


def best_window_score(wanted: Column, pool: Column) -> Column:
    """Best score of a text against a longer pool: whole, contained, or sliding windows of it.

    The distance of a contained text is what the pool has beside it, so it needs no table of edits.
    """
    g, p = compact(wanted), compact(pool)
    whole = F.bround(edit_ratio(g, p) * 100, 2)
    step = F.greatest(F.lit(1), F.floor(F.length(g) / 3).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(p) - F.length(g) - 1), step)
    windows = F.transform(starts, lambda i: F.bround(edit_ratio(g, F.substr(p, i + 1, F.length(g) + EXTRA)) * 100, 2))
    return (
        F.when(g == "", 100.0).when(p == "", 0.0).when(F.instr(p, g) > 0, F.greatest(F.bround(F.length(g) / F.length(p) * 100, 2), F.lit(CONTAINED)))
        .when(F.length(p) > F.length(g) * 1.5, F.greatest(whole, F.array_max(windows))).otherwise(whole)
    )


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbours; the text itself if it has one character only."""
    chars = F.split(t, "")  # once: substr would walk a long text anew for every pair
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length(t) - 1), F.slice(chars, F.lit(2), F.length(t) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(t) > 1, F.array_distinct(pairs)).otherwise(F.array(t))


def text_similarity(a: Column, b: Column) -> Column:
    """Bigram overlap, length ratio and equal beginnings; a contained beginning counts .85 at least."""
    x, y = F.regexp_replace(F.coalesce(a, F.lit("")), r"(?U)\s+", ""), F.regexp_replace(F.coalesce(b, F.lit("")), r"(?U)\s+", "")
    m, n = bigrams(x), bigrams(y)
    overlap = F.size(F.array_intersect(m, n)) / F.greatest(F.size(F.array_union(m, n)), F.lit(1))
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    begins = F.when(F.substring(x, 1, 20) == F.substring(y, 1, 20), 1.0).otherwise(0.0)
    inside = F.when((F.length(x) < F.length(y)) & (F.instr(y, F.substring(x, 1, 40)) > 0), 0.85).when(
        (F.length(y) < F.length(x)) & (F.instr(x, F.substring(y, 1, 40)) > 0), 0.85).otherwise(0.0)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(
        F.greatest(inside, 0.5 * overlap + 0.3 * ratio + 0.2 * begins))


def flat_table(rows: Column) -> Column:
    """Cells of array<array<string>> in order, joined as compared by ``table_score``."""
    return F.array_join(F.transform(F.flatten(rows), lambda c: F.concat(F.lit("TRC:"), c)), "|")


def table_score(a: Column, b: Column) -> Column:
    """Per cent likeness of two tables by the edit distance of their flat forms; 100 if both are empty."""
    none = lambda t: F.size(t) == 0
    return F.when(none(a) & none(b), 100.0).when(none(a) | none(b), 0.0).otherwise(F.bround(edit_ratio(flat_table(a), flat_table(b)) * 100, 2))


def layout_similarity(ours: str, theirs: str) -> Column:
    """Likeness of two page layouts from columns with the two prefixes: paragraphs, left, center, right, text_len.

    Weights are summed for what applies; pictures and tables are in neither, which counts as alike.
    """
    a, b = (lambda c: F.col(ours + c)), (lambda c: F.col(theirs + c))
    ratio = lambda c: F.least(a(c), b(c)) / F.greatest(a(c), b(c), F.lit(1))
    aligns = ("left", "center", "right")
    far = sum((F.abs(a(c) - b(c)) for c in aligns), F.lit(0))
    total = F.greatest(sum((b(c) for c in aligns), F.lit(0)), F.lit(1))
    paragraphs = F.when((a("paragraphs") > 0) & (b("paragraphs") > 0), ratio("paragraphs") * 0.2).otherwise(0.0)
    length = F.when((a("text_len") > 0) | (b("text_len") > 0), ratio("text_len") * 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), paragraphs + F.greatest(F.lit(0.0), 1 - far / total) * 0.25 + 0.15 + length)
