"""Problem 2: spellings of names that mean the same party.

A spelling is folded (problem 5) and taken apart into place, core, trade and branch; common
first and last parts are learned from the whole column. Spellings seen with a tax number of
valid check digit belong to its party, as do those on a repeated scan of an invoice whose
other scan has the number. The rest is linked by suffix blocking: suffixes of the tokens of a
name, from both ends, are indexed; suffixes that are too common are refined with place or
trade first and discarded only if they still are. Candidates are compared by the ratio of the
longest common subsequence, part by part, and linked if one party alone is best. Names left
over are linked if their parts are equal.

No names: null, "", the sentinels. Parties with different numbers are never linked, nor a
branch with its head office. A spelling seen with two numbers goes to the more frequent one,
the smaller number if equal.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.checksum import valid_credit_code
from paperloom.llm.canon import canonical_udf, folded
from paperloom.llm.survivor import digits_of
from paperloom.runtime import cut, join_sized

#: Shares of all names that make a first part a place and a last part a trade; at most 1 / share each.
PLACE_SHARE, TRADE_SHARE = 0.008, 0.004
#: Least different characters beside such a part.
KINDS = 4
#: Shortest suffix of a token; most parties under a suffix before it is refined, then discarded.
SUFFIX, COMMON = 2, 64
#: Least similarity of cores and of whole names, and the lead over the next party.
LEAST_CORE, LEAST_WHOLE, LEAST_LATIN, LEAD = 0.66, 0.8, 0.8, 0.02
NO_NAMES = ("", "待确认", "个人")

# Legal forms.
_FORM = re.compile(r"(?:(?:\(?股份\)?)?有限(?:责任)?公司|\(个体(?:工商)?户\))$")
_WORN = re.compile(r"(?:\(?股份\)?)?(?:有限责.公司|有限.任公司|有.责任公司|有限责任公.|有限责任.司|有限责公司|有限任公司|有.公司|.限公司|有限.司|有限公.)$|公司$")
_RUN = re.compile(r"[股份有限责任公司()]{2,}$")
_MIDDLE = re.compile(r"^(.{2,8}?)(?:\(?股份\)?)?有限(?:责任)?公司(.{4,})$")
_BRANCH = re.compile(r"(?<=公司)(.{2,6})分公司$")
_LABEL = re.compile(r"^(?:名称|购买方|销售方|单位)[:：]")
_LEGAL = {"co", "ltd", "company", "limited", "inc", "gmbh", "llc", "corp", "kg", "ag"}
_HAN = re.compile("[一-鿿]")

PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("place", "core", "trade", "branch")])


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def alike(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def plain_name(raw: str | None) -> str:
    text = folded(raw) or ""
    text = _LABEL.sub("", text.strip())
    return re.sub(r"\s+", "", text) if _HAN.search(text) else re.sub(r"\s+", " ", text).strip()


def trunk(name: str) -> tuple[str, str]:
    """Han name without its legal form, and its branch; a form in the middle moves to the end."""
    branch = ""
    if m := _BRANCH.search(name):
        branch, name = m[1], name[: m.start()]
    for form in (_FORM, _WORN, _RUN):
        if (m := form.search(name)) and m.start() >= 2:
            return name[: m.start()], branch
    if m := _MIDDLE.match(name):
        return m[2] + m[1], branch
    return name, branch


def take_apart(name: str, places: frozenset, trades: frozenset) -> dict:
    if not _HAN.search(name):
        words = [w for w in re.findall(r"[^\W_]+", name) if w not in _LEGAL]
        return {"place": "", "core": " ".join(words), "trade": "", "branch": "latin"}
    body, branch = trunk(name)
    place = ""
    for m in re.finditer(r"\((.{2,3}?)市?\)", body):
        if m[1] in places:
            place = m[1]
            body = body.replace(m[0], "", 1)
            break
    body = body.replace("(个体工商户)", "").replace("(个体户)", "")
    if not place and body[:2] in places and len(body) > 4:
        place, body = body[:2], body[2:]
        body = body[1:] if body[:1] == "市" and len(body) > 3 else body
    trade = next((body[-k:] for k in range(6, 1, -1) if body[-k:] in trades and len(body) - k >= 2), "")
    core = body[: len(body) - len(trade)] if trade else body
    if not trade and not place:
        core = core[1:] if core[:1] in "老小" and len(core) in (4, 5) else core[:-1] if core[-1:] == "家" and len(core) in (4, 5) else core
    return {"place": place, "core": core, "trade": trade, "branch": branch}


def _score_latin(a: str, b: str) -> float:
    """Words of a are matched to the most alike words of b; an abbreviation counts as its word."""
    xs, ys = a.split(), b.split()
    if not xs or not ys:
        return 0.0
    if len(xs) == 2 and len(xs[0]) == len(ys) and xs[1] in ys:
        # initials of the words, with the place written out
        if sorted(xs[0]) == sorted(y[0] for y in ys):
            return 0.9
    total, free = 0.0, list(ys)
    for x in xs:
        best = max(free, key=lambda y: max(alike(x, y), 0.9 if len(x) > 1 and y.startswith(x) else 0.0), default=None)
        if best is None:
            break
        s = max(alike(x, best), 0.9 if len(x) > 1 and best.startswith(x) else 0.0)
        total += s if s > 0.6 else 0.0
        free.remove(best)
    return total / max(len(xs), 2) if len(xs) <= len(ys) else total / len(xs)


def score(a: dict, b: dict) -> float:
    """Similarity of the parts of two names; 0 if some part contradicts."""
    if (a["branch"] or "") != (b["branch"] or ""):
        return 0.0
    if a["branch"] == "latin":
        s = _score_latin(a["core"], b["core"])
        return s if s >= LEAST_LATIN else 0.0
    if a["place"] and b["place"] and a["place"] != b["place"]:
        return 0.0
    core = alike(a["core"], b["core"])
    if bool(a["trade"]) != bool(b["trade"]):
        # a slip inside the trade leaves it in the core
        whole = alike(a["core"] + a["trade"], b["core"] + b["trade"])
        core = max(core, whole) if whole >= LEAST_WHOLE else core
    if core < LEAST_CORE:
        return 0.0
    same_place = bool(a["place"]) and a["place"] == b["place"]
    trade = 0.5
    if a["trade"] and b["trade"]:
        common = lcs(a["trade"], b["trade"])
        trade = 1.0 if a["trade"] == b["trade"] else common / min(len(a["trade"]), len(b["trade"]))
        if trade < 0.5:
            return 0.0
    if core < 0.99 and not (same_place and trade >= 0.5) and not (trade >= 1.0 and core >= 0.7) and core < 0.8:
        return 0.0
    return core + 0.1 * same_place + 0.1 * trade


def _suffixes(parts: dict) -> list[str]:
    """Suffixes of the tokens of a name and, for slips near their end, of the reversed tokens."""
    least = SUFFIX if parts["branch"] != "latin" else 4
    out = set()
    for token in parts["core"].split():
        for word, mark in ((token, ">"), (token[::-1], "<")):
            out.update(mark + word[-k:] for k in range(min(least, len(word)), len(word) + 1))
    return sorted(out)


def _udf(f, kind):
    return F.pandas_udf(f, kind)


def parts_of(names: DataFrame, column: str) -> DataFrame:
    """Add ``parts`` to distinct plain names; places and trades are learned from all of them."""
    def cut_trunk(s: pd.Series) -> pd.Series:
        return s.map(lambda n: trunk(n)[0] if _HAN.search(n) else "")

    bodies = cut(names.select(_udf(cut_trunk, T.StringType())(column).alias("b")).where(F.length("b") > 3))
    n = max(1, bodies.count())
    # shares bound these lists: at most 1 / share entries for each length
    # a place goes with many cores after it, a trade with many before it
    common = lambda df, share: df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("beside").alias("kinds")).where(
        (F.col("n") >= n * share) & (F.col("kinds") >= KINDS)).select("part").collect()
    starts = bodies.select(F.substring("b", 1, 2).alias("part"), F.substring("b", 3, 1).alias("beside"))
    ends = bodies.select(F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("b") - 2)), lambda k: F.struct(
        F.right("b", k).alias("part"), F.substr("b", F.length("b") - k, F.lit(1)).alias("beside")))).alias("e")).select("e.*")
    places, trades = (frozenset(r["part"] for r in common(df, share)) for df, share in ((starts, PLACE_SHARE), (ends, TRADE_SHARE)))

    def apart(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([take_apart(x, places, trades) for x in s], columns=PARTS.names, index=s.index)

    apart.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return names.withColumn("parts", F.pandas_udf(apart, PARTS)(column))


def spellings(records: DataFrame) -> DataFrame:
    """(raw, code, scan): every name as stored, its valid tax number or null, a key of the invoice's side."""
    no, day = digits_of(canonical_udf("invoice_no")), F.regexp_replace("invoice_date", "[/.]", "-")
    scan = lambda role: F.when((F.length(no) >= 6) & (F.length(day) > 0), F.concat_ws("|", F.lit(role), no, day))
    sides = [records.select(F.col(f"{s}_name").alias("raw"), F.col(f"{s}_tax").alias("tax"), scan(s).alias("scan")) for s in ("buyer", "seller")]
    both = sides[0].unionByName(sides[1]).where(F.col("raw").isNotNull() & ~F.col("raw").isin(*NO_NAMES))
    code = F.upper(F.regexp_replace(canonical_udf("tax"), r"\s", ""))
    return both.select("raw", "scan", code.alias("c")).select("raw", "scan", F.when(valid_credit_code(F.col("c")), F.col("c")).alias("code"))


def parties(records: DataFrame) -> DataFrame:
    """(raw, name, party): each distinct stored spelling and the party it means."""
    def plain(s: pd.Series) -> pd.Series:
        return s.map(plain_name)

    rows = spellings(records).groupBy("raw", "code", "scan").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows)
    raws = cut(rows.select("raw").distinct().withColumn("name", _udf(plain, T.StringType())("raw")).where((F.length("name") > 0) & ~F.col("name").isin(*NO_NAMES)))
    named = cut(join_sized(rows, raws, ["raw"], "inner"))
    names = raws.select("name").distinct()
    # votes of the tax numbers
    by_code = named.where("code IS NOT NULL").groupBy("name", "code").agg(F.sum("n").alias("n"))
    voted = by_code.groupBy("name").agg(F.max_by("code", F.struct("n", _reverse("code"))).alias("code"))
    voted = cut(voted)
    # the number on another scan of the same invoice, if there is one only
    scans = named.where("code IS NOT NULL AND scan IS NOT NULL").groupBy("scan").agg(F.min("code").alias("c0"), F.max("code").alias("c1")).where("c0 = c1")
    open_rows = named.where("scan IS NOT NULL").select("name", "scan", "n").join(voted.select("name"), "name", "left_anti")
    seen = open_rows.join(scans, "scan").groupBy("name", F.col("c0").alias("code")).agg(F.sum("n").alias("n"))
    seen = seen.groupBy("name").agg(F.max_by("code", F.struct("n", _reverse("code"))).alias("code"))
    known = cut(voted.unionByName(seen))
    apart = cut(parts_of(names, "name").join(known, "name", "left").select("name", "parts", "code"))
    matched = cut(_match(apart.where("code IS NULL"), apart.where("code IS NOT NULL")))
    full = apart.join(matched.withColumnRenamed("code", "found"), "name", "left")
    left = F.concat_ws("|", F.lit("parts"), "parts.place", "parts.core", "parts.trade", "parts.branch")
    classes = cut(full.select("name", F.coalesce("code", "found", left).alias("party")))
    return cut(join_sized(raws, classes, ["name"], "inner"))


def _reverse(code: str) -> Column:
    """Orders equal counts so that the smaller number wins in max_by."""
    return F.translate(code, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA9876543210")


def _match(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, code) of the asked names for which one party alone is the most alike.

    A name is never compared with itself. A suffix with more than COMMON parties is refined with the
    place, with the trade, and with both, and each of these keys is left out only if it still has more;
    parties are counted exactly. The whole core is a key that is never left out. Keys and names meet as
    hashes; the parts are joined to the distinct pairs only.
    """
    def keys(parts: pd.DataFrame) -> pd.Series:
        return pd.Series([_suffixes(p) for p in parts.to_dict("records")], index=parts.index)

    keys.__annotations__ = {"parts": pd.DataFrame, "return": pd.Series}
    suffixes = F.pandas_udf(keys, T.ArrayType(T.StringType()))
    place, trade = F.concat(F.lit("|p"), "parts.place"), F.concat(F.lit("|t"), "parts.trade")
    refined = lambda x: F.array(x, F.concat(x, place), F.concat(x, trade), F.concat(x, place, trade))
    whole = F.concat(F.lit("="), "parts.core")
    # narrower keys come behind wider ones; 0 marks the whole core
    narrow = lambda df: df.withColumn("suffix", F.explode(suffixes("parts"))).select(*df.columns, F.posexplode(refined(F.col("suffix"))).alias("level", "key"))
    both = lambda df: narrow(df).select(*df.columns, (F.col("level") + 1).alias("level"), "key").unionByName(df.select("*", F.lit(0).alias("level"), whole.alias("key")))
    hashed = lambda *names: [F.xxhash64(n).alias(n) for n in names]
    index = cut(both(known.select("name", "code", "parts")).select("level", *hashed("key", "name", "code")).distinct())
    usable = index.where("level > 0").select("key", "code").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("parties")).where(F.col("parties") <= COMMON).select("key")
    left = index.where("level > 0").join(usable, "key", "left_semi").unionByName(index.where("level = 0")).select("key", F.col("name").alias("source"))
    right = both(asked.select("name", "parts")).select(*hashed("key", "name"))
    met = right.join(left, "key").where("name <> source").select(F.col("name").alias("asked_id"), F.col("source").alias("known_id")).distinct()
    pairs = met.join(asked.select(F.xxhash64("name").alias("asked_id"), "name", F.col("parts").alias("a")), "asked_id")
    pairs = pairs.join(known.select(F.xxhash64("name").alias("known_id"), "code", F.col("parts").alias("b")), "known_id").select("name", "code", "a", "b")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a.to_dict("records"), b.to_dict("records"))], index=a.index, dtype="float64")

    compare.__annotations__ = {"a": pd.DataFrame, "b": pd.DataFrame, "return": pd.Series}
    scored = pairs.withColumn("s", F.pandas_udf(compare, T.DoubleType())("a", "b")).where("s > 0").groupBy("name", "code").agg(F.max("s").alias("s"))
    best = scored.groupBy("name").agg(F.max_by("code", F.struct("s", _reverse("code"))).alias("code"), F.max("s").alias("s"))
    rival = scored.join(best.select("name", F.col("code").alias("first")), "name").where("code <> first").groupBy("name").agg(F.max("s").alias("next"))
    return best.join(rival, "name", "left").where(F.coalesce(F.col("s") - F.col("next"), F.lit(1.0)) > LEAD).select("name", "code")


def linked_spellings(records: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points: all pairs of spellings of one party.

    The pairs are what is asked for; both sides hold distinct spellings only, and the larger
    is spread with a salt where a party's spellings are many.
    """
    who = parties(records).select("party", "raw")
    other = who.select("party", F.col("raw").alias("name_b"))
    return join_sized(who.withColumnRenamed("raw", "name_a"), other, ["party"], "inner", row_bytes=160).where("name_a < name_b").select("name_a", "name_b")
