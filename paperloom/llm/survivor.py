"""Problem 4: one surviving record for each invoice that was scanned several times.

Grouping uses no pairs. Rows with a well-formed number are joined over number plus date,
amounts or goods. Rows whose number is missing, malformed or named in fields_needing_review
are attached to the one invoice of equal date and amounts whose number differs by one slip (a
digit masked, two neighbours swapped, a digit lost), or of equal goods. Invoices that merely
resemble each other keep numbers of their own.

The survivor is chosen by a skyline: values that are missing, malformed or doubted count as
null; records undominated in completeness, trust and recency form the first layer, those
undominated among the rest the next, and so on. Within a layer the policy is trust, then
completeness, then recency, then row_id. Nulls are filled from successive layers.

Of records of equal completeness and trust a later one dominates an earlier one, so only the
latest one with a value in a field can give that value. Records that are the latest in no field
are therefore left out before the layers are formed, by aggregation; each record that stays
keeps its own recency. Completeness has 14 values and trust 18, so a group of a third of all
rows reaches a task as at most 252 classes of no more records than there are fields.
Null or empty fields never match each other; an invoice scanned once is no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.canon import canonical_udf
from paperloom.llm.components import components
from paperloom.runtime import cut, join_sized

#: Fields of the survivor; the tolerance of the sum of amounts.
FIELDS = (
    "buyer_name", "buyer_tax", "seller_name", "seller_tax", "invoice_date", "pretax_amount", "tax_amount",
    "total_amount", "tax_rate", "invoice_type", "invoice_no", "category", "line_items",
)
TOLERANCE = 0.05
_MISSING = ("", "待确认", "（未分类）")


def _clean(c: Column) -> Column:
    return F.when(c.isin(*_MISSING), None).otherwise(c)


def digits_of(c: Column) -> Column:
    """Digits of a number that consists of digits, blanks and a label; null if none."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(d) > 0, d)


def money(c: Column) -> Column:
    """Amount as decimal with two places; signs of currency, separators and blanks are dropped."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)[\s,¥$€元]|CNY|RMB|人民币", ""), "[−–—]", "-")
    return F.when(plain.rlike(r"^[-+]?\d{1,15}(\.\d+)?$"), plain.cast("decimal(18,2)"))


def readings(records: DataFrame) -> DataFrame:
    """One row per record with canonical values, what is doubted, and the weak flag of the number."""
    flagged = lambda f: F.coalesce(F.array_contains("fields_needing_review", f), F.lit(False))
    plain = records.select(
        F.col("row_id").cast("long").alias("id"), "scanned_at", "fields_needing_review",
        *(_clean(canonical_udf(f)).alias(f) for f in FIELDS))
    no, total, pre, tax = digits_of(F.col("invoice_no")), money(F.col("total_amount")), money(F.col("pretax_amount")), money(F.col("tax_amount"))
    r = plain.withColumns({
        "no": no, "total": total, "pre": pre, "tax": tax,
        "day": F.regexp_replace("invoice_date", "[/.年月]", "-"), "goods": F.col("line_items"),
    })
    r = r.withColumn("well", F.coalesce(F.length("no").isin(8, 20), F.lit(False)))
    r = r.withColumn("weak", ~F.col("well") | flagged("invoice_no"))
    odd = F.coalesce(F.abs(F.col("pre") + F.col("tax") - F.col("total")) > TOLERANCE, F.lit(False))
    return r.withColumn("total_doubted", flagged("total_amount") | odd | F.col("total").isNull())


def _key(kind: str, *cols: str) -> Column:
    """Key of the columns, null if one of them is null."""
    return F.concat_ws("|", F.lit(kind), *cols) if not cols else F.when(
        F.forall(F.array(*(F.col(c).cast("string") for c in cols)), lambda x: x.isNotNull()),
        F.xxhash64(F.lit(kind), *(F.col(c).cast("string") for c in cols)))


def slips(no: str) -> Column:
    """Wordings that a number shares with all numbers one slip away."""
    c, n = F.col(no), F.length(no)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    one = F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("*"), F.substr(c, i + 1)))
    two = F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("**"), F.substr(c, i + 2)))
    gap = F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("*"), F.substr(c, i)))
    return F.when(n > 0, F.array_distinct(F.concat(one, two, gap)))


def invoices(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, (id, invoice, n_rows)): invoice is the least row_id of the rows of one invoice."""
    r = cut(readings(records))
    sure = r.where("well")
    keyed = sure.select("id", F.explode(F.array_compact(F.array(
        _key("n1", "no", "day"), _key("n2", "no", "pre", "tax"), _key("n3", "no", "goods")))).alias("key"))
    first = components(r.select("id"), keyed)
    labelled = cut(r.join(first, "id"))
    strong = cut(labelled.groupBy("label").agg(F.max(F.when(~F.col("weak"), 1).otherwise(0)).alias("strong")))
    r1 = cut(join_sized(labelled, strong, ["label"], "inner", row_bytes=32))
    weak, rest = r1.where("strong = 0"), r1.where("strong = 1")
    # (preference, key) of a row; only keys under which exactly one sure invoice is known count
    contents = [("day", "pre", "tax", "goods"), ("day", "total", "goods"), ("day", "pre", "tax", "seller_tax"), ("day", "pre", "tax", "buyer_tax"), ("day", "pre", "tax"), ("pre", "tax", "goods", "seller_tax")]

    def plain_keys(df: DataFrame) -> DataFrame:
        return df.select("id", "label", F.explode(F.array(*(
            F.struct(F.lit(10 + i).alias("rank"), _key(f"c{i}", *c).alias("key")) for i, c in enumerate(contents)))).alias("k")).select(
            "id", "label", "k.rank", "k.key").where("key IS NOT NULL")

    def near_keys(df: DataFrame) -> DataFrame:
        with_no = df.where("no IS NOT NULL").select("id", "label", *{c for x in contents for c in x}, F.explode(slips("no")).alias("slip"))
        return with_no.select("id", "label", F.explode(F.array(*(
            F.struct(F.lit(i).alias("rank"), _key(f"s{i}", *c, "slip").alias("key")) for i, c in enumerate(contents)))).alias("k")).select(
            "id", "label", "k.rank", "k.key").where("key IS NOT NULL")

    # contents alone speak only for rows without a number; a number that is there must be near
    no_number = weak.where("no IS NULL OR length(no) < 6")
    asked = cut(near_keys(weak).unionByName(plain_keys(no_number)))
    # sure rows are looked at only if their contents occur among the weak ones
    wanted = plain_keys(weak).select("key").distinct()
    met = cut(plain_keys(rest).join(wanted, "key", "left_semi"))
    near = near_keys(rest.join(met.select("id").distinct(), "id", "left_semi"))
    known = near.unionByName(met).groupBy("key").agg(F.min("label").alias("to"), F.max("label").alias("max_to"))
    known = known.where("to = max_to").select("key", "to")
    attached = cut(
        asked.join(known, "key").groupBy("label")
        .agg(F.min_by("to", F.struct("rank", "to")).alias("to"))
    )
    alone = weak.join(attached.select("label"), "label", "left_anti")
    among = alone.select("id", "label", F.explode(F.array_compact(F.array(
        _key("w0", "day", "pre", "tax", "goods"), _key("w1", "day", "total", "goods"), _key("w2", "day", "pre", "tax", "seller_tax", "buyer_tax")))).alias("key"))
    loose = components(alone.select(F.col("label").alias("id")), among.select(F.col("label").alias("id"), "key"))
    joined = join_sized(r1.select("id", "label"), attached, ["label"], "left", row_bytes=32)
    joined = join_sized(joined, loose.select(F.col("id").alias("label"), F.col("label").alias("loose")), ["label"], "left", row_bytes=32)
    joined = cut(joined.select("id", F.coalesce("to", "loose", "label").alias("g")))
    least = cut(joined.groupBy("g").agg(F.min("id").alias("invoice"), F.count(F.lit(1)).alias("n_rows")))
    return r, cut(join_sized(joined, least, ["g"], "inner", row_bytes=40).select("id", "invoice", "n_rows"))


def layers(points: list[tuple]) -> list[int]:
    """Dominance layer of each (completeness, trust, recency), 0 for the undominated."""
    order = sorted(range(len(points)), key=lambda i: points[i], reverse=True)
    fronts: list[list[tuple]] = []
    out = [0] * len(points)
    for i in order:
        p = points[i]
        k = 0
        while k < len(fronts) and any(all(a >= b for a, b in zip(q, p)) and q != p for q in fronts[k]):
            k += 1
        if k == len(fronts):
            fronts.append([])
        fronts[k].append(p)
        out[i] = k
    return out


#: What records give beside FIELDS: number and total undoubted, well-formed only, and the sum of the amounts.
GIVEN = (*FIELDS, "no", "total", "any_no", "any_total", "sum_total")


def filled(classes: list[dict]) -> dict:
    """Survivor of one invoice from its classes of equal completeness and trust.

    A class has, for each of GIVEN and for ``row``, the latest (recency, row, value) or None. The
    records behind them are laid in layers; each field takes its value from the first layer that has
    one, by trust, completeness, recency and row within a layer.
    """
    records: dict[int, tuple] = {}
    values: dict[int, dict] = {}
    for c in classes:
        for f in ("row", *GIVEN):
            if c[f] is not None:
                row = -c[f]["back"]
                records[row] = (c["completeness"], c["trust"], c[f]["recency"])
                values.setdefault(row, {})[f] = c[f]["value"]
    rows = list(records)
    depth = dict(zip(rows, layers([records[r] for r in rows])))
    ranked = sorted(rows, key=lambda r: (depth[r], -records[r][1], -records[r][0], -records[r][2], r))
    out = {f: next((values[r][f] for r in ranked if f in values[r]), None) for f in GIVEN}
    return out | {"survivor_row_id": ranked[0]}


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"invoice": i, "n_rows": n, **filled(list(c))} for i, n, c in zip(batch["invoice"], batch["n_rows"], batch["classes"])]
        yield pd.DataFrame(rows, columns=_COLUMNS)


_COLUMNS = ["invoice", "n_rows", "survivor_row_id", *GIVEN]
_SCHEMA = "invoice long, n_rows long, survivor_row_id long, " + ", ".join(f"{c} string" for c in _COLUMNS[3:])


def survivors(records: DataFrame) -> DataFrame:
    """One row per invoice with at least two rows: first_row_id, n_rows, survivor_row_id and the fields."""
    r, groups = invoices(records)
    m = r.join(groups.where("n_rows > 1"), "id")
    m = m.withColumns({
        "good_no": F.when(~F.col("weak"), F.col("no")), "fair_no": F.when(F.col("well"), F.col("no")),
        "good_total": F.when(~F.col("total_doubted"), F.col("total").cast("string")), "fair_total": F.col("total").cast("string"),
        "sum_total": (F.col("pre") + F.col("tax")).cast("decimal(18,2)").cast("string"),
    })
    # agreement within the invoice is part of trust
    m = cut(m)
    for f in ("no", "total"):
        votes = m.where(f"good_{f} IS NOT NULL").groupBy("invoice", f"good_{f}").agg(F.count(F.lit(1)).alias("v"))
        top = cut(votes.groupBy("invoice").agg(F.max_by(f"good_{f}", F.struct("v", f"good_{f}")).alias(f"top_{f}")))
        m = join_sized(m, top, ["invoice"], "left", row_bytes=60)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    m = m.withColumns({
        "completeness": sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0)),
        "trust": 2 * yes(F.col("good_no") == F.col("top_no")) + 2 * yes(F.col("good_total") == F.col("top_total"))
        - F.coalesce(F.size(F.array_intersect("fields_needing_review", F.lit(list(FIELDS)))), F.lit(0)),
        "recency": F.coalesce(F.unix_micros(F.col("scanned_at").cast("timestamp")), F.lit(0)),
    })
    doubted = lambda f: F.coalesce(F.array_contains("fields_needing_review", f), F.lit(False))
    value = {f: F.when(~doubted(f), F.col(f)) for f in FIELDS} | {
        "no": F.col("good_no"), "total": F.col("good_total"), "any_no": F.col("fair_no"), "any_total": F.col("fair_total"), "sum_total": F.col("sum_total")}
    latest = lambda c, name: F.max(F.when(c.isNotNull(), F.struct("recency", (-F.col("id")).alias("back"), c.alias("value")))).alias(name)
    classes = m.groupBy("invoice", "n_rows", "completeness", "trust").agg(
        latest(F.col("id").cast("string"), "row"), *(latest(value[f], f) for f in GIVEN))
    packed = classes.groupBy("invoice", "n_rows").agg(F.collect_list(F.struct("completeness", "trust", "row", *GIVEN)).alias("classes"))
    out = packed.mapInPandas(_survivors, _SCHEMA)
    return out.select(
        F.col("invoice").cast("int").alias("first_row_id"), "n_rows", F.col("survivor_row_id").cast("int").alias("survivor_row_id"),
        *(c for c in FIELDS if c not in ("invoice_no", "total_amount")),
        F.coalesce("no", "any_no").alias("invoice_no"), F.coalesce("total", "sum_total", "any_total").alias("total_amount"))
