"""Problem 3: noise in the text of scanned pages.

Page furniture is told by its place and by its return on other pages. Line ends broken by an
added hyphen are told by the counts of the joined word and of the compound in the corpus.
Misread characters: for words, all entries of a vocabulary trie within an edit distance are
retrieved by intersecting it with the word's Levenshtein automaton; for ideographs, which have
no word bounds, the candidates are the characters seen in the same surroundings. Candidates
are ranked by counts and surroundings, and a substitution counts as a misreading only if it
recurs through the corpus. ``paragraphs`` drops the furniture, repairs and reflows the lines.

Words and surroundings are counted over all lines. Nulls and empty texts are no cases; lines
of equal place keep the order of line_id. No step gathers a whole scan in one task: pages are
the largest groups, and neighbouring pages meet by an equi-join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.checksum import ALPHABET, WEIGHTS
from paperloom.llm.canon import canonical, canonical_udf, per_distinct
from paperloom.llm.trie import Trie
from paperloom.runtime import cut, free, join_sized

#: Heights of the head and foot zones; height of furniture against the scan's usual line.
HEAD, FOOT, SMALL = 0.95, 0.045, 0.85
#: A word is known from so many occurrences; a slip is so many times rarer than its right form, less if it has signs no word has.
KNOWN, RARER, ODDER = 5, 20.0, 4.0
#: A surrounding tells a character if seen so often with such a share; the doubted one has at most so much.
SEEN, SURE, DOUBT, BACKED = 20, 0.9, 0.04, 0.2
#: A substitution is a misreading if it recurs in so many words or surroundings.
RECURS = 3
#: A character whose occurrences are nearly all misread is one wherever it stands.
ALWAYS = 0.5
#: Words a trie holds at most, queries against it in one task.
SHARD, QUERIES = 200_000, 20_000
#: Bits of the filters sent to all tasks: so many for each key, between the least and the most (16 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27
#: Signs taken together, places tested at once: so memory follows neither the batch nor the longest line.
SIGNS, PLACES = 1_000_000, 200_000
#: Signs that are looked for one by one.
FEW = 64
#: Pages whose paragraphs are numbered in one task.
BLOCK = 1000
#: Edit distance of the automaton; longest changed stretch on either side.
DISTANCE, STRETCH = 2, 2

_HYPHEN = "-‐‑¬­"
_WORD = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9!|$]*[A-Za-zÀ-ɏ0-9]|[0-9!|$][A-Za-zÀ-ɏ0-9!|$]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]*")
_COMPOUND = re.compile(r"[A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)+")
_ODD = re.compile("[0-9!|$]")
_LETTERS = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[一-鿿]")
_DIGITS = re.compile(r"\d+")
_NUMBER = re.compile(r"(?<![A-Za-zÀ-ɏ0-9])[0-9OoIlZS][0-9OoIlZS.,:/-]*[0-9OoIlZS](?![A-Za-zÀ-ɏ0-9])")
_UNIT = re.compile(r"(?<![A-Za-zÀ-ɏ0-9])(?=[0-9OoIlZS]*[0-9])[0-9OoIlZS]*[OoIlZS][0-9OoIlZS]*(?=[gG](?![A-Za-z0-9]))")
_LONE = re.compile(r"(?<=[一-鿿])[OoIlZS](?=[年月日号页条份张箱个元天家次种台])")
_CODE = re.compile(r"(?<![A-Za-z0-9])[0-9A-Za-z]{18}(?![A-Za-z0-9])")
# Letters taken for digits.
_AS_DIGIT = str.maketrans("OoIlZS", "001125")

_WIDE = str.maketrans(",;:?!", "，；：？！")

# What stands around a page's number.
_PAGE = re.compile(
    r"(?:[-–—·.|/\s\[\]()]|第|页|頁|共|总|之|p(?:age|g|p)?\.?|of|seite|blatt|von|s\.|no\.?)*"
    r"(?:(?:\d|[oliszb])+|[ivxlc]+)"
    r"(?:(?:[-–—·.|/\s\[\]()]|第|页|頁|共|总|之|page|of|seite|von)+(?:(?:\d|[oliszb])+|[ivxlc]+))?"
    r"(?:[-–—·.|/\s\[\]()]|页|頁)*", re.I)
_PAGE_FORMS = ("第0页", "第0页共0页", "page0of0", "seite0von0", "p.0", "共0页第0页", "-0-", "0/0", "page0", "seite0")


def page_only(text: str | None) -> bool:
    """True if a line of furniture only tells the page, read with one slip at most."""
    if not text or not text.strip():
        return False
    t = text.strip()
    if _PAGE.fullmatch(t):
        return True
    masked = _DIGITS.sub("0", re.sub(r"\s+", "", t.lower()))
    return "0" in masked and len(masked) >= 3 and any(
        abs(len(masked) - len(f)) <= 1 and sum(a != b for a, b in zip(masked, f)) + abs(len(masked) - len(f)) <= 1
        for f in _PAGE_FORMS if len(f) >= 3)


def _masked(text: str | None) -> str | None:
    return None if not text else re.sub(r"\d+", "0", re.sub(r"\s+", "", text.lower()))


def laid_out(lines: DataFrame) -> DataFrame:
    """Lines with plain text, furniture kinds, the hyphen left at the end, and the next line of the text."""
    base = lines.select("line_id", "scan_id", "page_no", "line_idx", "text", "x", "y", "height", canonical_udf("text").alias("plain"))
    base = cut(base.withColumn("zone", F.coalesce((F.col("y") >= HEAD) | (F.col("y") <= FOOT), F.lit(False))))
    usual = cut(base.where("NOT zone").groupBy("scan_id").agg(F.percentile_approx("height", 0.5).alias("usual")))
    zone = base.where("zone").withColumn("mask", per_distinct(_masked, T.StringType())("plain"))
    again = cut(
        zone.where("mask IS NOT NULL").groupBy("scan_id", "mask").agg((F.max("page_no") > F.min("page_no")).alias("again")).where("again"))
    zone = join_sized(join_sized(zone, usual, ["scan_id"], "left", row_bytes=24), again, ["scan_id", "mask"], "left", row_bytes=120)
    zone = zone.withColumn("furniture", F.coalesce("again", F.lit(False)) | F.coalesce(F.col("height") <= SMALL * F.col("usual"), F.lit(False)))
    zone = zone.withColumn("page_only", F.col("furniture") & per_distinct(page_only, T.BooleanType())("plain")).drop("mask", "usual", "again")
    rest = base.where("NOT zone").withColumn("furniture", F.lit(False)).withColumn("page_only", F.lit(False))
    every = zone.unionByName(rest)
    # the hyphen a line ends with after a letter; the canonical form keeps all but the soft one
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s   　​-‍⁠﻿]+$", "")
    mark = F.when(F.col("plain").rlike("[A-Za-zÀ-ɏ!|0-9][-‐‑¬]$"), F.right("plain", F.lit(1))).when(
        bare.rlike("[A-Za-zÀ-ɏ!|0-9]\u00ad$"), F.lit("\u00ad")).otherwise("")
    body = every.where("NOT furniture AND length(plain) > 0").withColumn("mark", mark)
    order = Window.partitionBy("scan_id", "page_no").orderBy("line_idx", "line_id")
    body = body.withColumn("next", F.lead("plain").over(order)).withColumn("before", F.lag("mark").over(order))
    # the text goes on at the first body line of the next page
    edge = body.groupBy("scan_id", "page_no").agg(
        F.min_by("plain", F.struct("line_idx", "line_id")).alias("first"), F.max_by("mark", F.struct("line_idx", "line_id")).alias("last"))
    edge = cut(edge)
    ahead = edge.select("scan_id", (F.col("page_no") - 1).alias("page_no"), F.col("first").alias("ahead"))
    behind = edge.select("scan_id", (F.col("page_no") + 1).alias("page_no"), F.col("last").alias("behind"))
    body = body.join(ahead, ["scan_id", "page_no"], "left").join(behind, ["scan_id", "page_no"], "left")
    body = body.withColumns({
        "next": F.coalesce("next", "ahead"), "open": F.col("mark").isin(*"-‐‑¬"), "after": F.coalesce("before", "behind", F.lit("")).isin(*"-‐‑¬"),
    }).drop("ahead", "behind", "before")
    other = every.where("furniture OR coalesce(length(plain), 0) = 0").withColumns({
        "next": F.lit(None).cast("string"), "open": F.lit(False), "mark": F.lit(""), "after": F.lit(False)})
    return cut(body.unionByName(other))


def fragments(plain: str, nxt: str | None) -> tuple[str, str] | None:
    """The two parts of a word broken at the end of the line."""
    head = re.search(r"([A-Za-zÀ-ɏ0-9!|$]+)[-‐‑¬]*\s*$", plain)
    tail = re.match(r"\s*([A-Za-zÀ-ɏ0-9!|$]+)", nxt or "")
    return (head[1], tail[1]) if head and tail else None


def words_of(plain: str, open_: bool, after: bool, nxt: str | None) -> Iterator[tuple[str, int]]:
    """(word in lower case, place) of the Latin words; the parts of a broken word are joined first."""
    found = [m for m in _WORD.finditer(plain)]
    joined = fragments(plain, nxt) if open_ else None
    for i, m in enumerate(found):
        if after and i == 0 and m.start() <= 1:
            continue
        if open_ and i == len(found) - 1 and joined:
            continue
        if sum(c.isdigit() for c in m[0]) <= len(m[0]) // 3 and len(m[0]) > 2:
            yield m[0].lower(), m.start()
    if joined:
        yield (joined[0] + joined[1]).lower(), -1


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Which characters of the basic plane are blank, and which are digits."""
    every = [chr(i) for i in range(0x10000)]
    return np.array([c.isspace() for c in every]), np.array([c.isdigit() for c in every])


def surroundings(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(text number, place, keys, ideograph) of every ideograph, in lots of at most PLACES.

    The keys are three characters to the left, three to the right, two on both sides, each packed in
    64 bits; blanks are passed over, digits count as 0, "^" and "$" stand beyond the ends, characters
    outside the basic plane count as one.
    """
    blank, digit = _classes()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.minimum(code, 0xFFFF).astype(np.int64)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = ~blank[code]
    code, text, at = np.where(digit[code], 48, code)[kept], text[kept], at[kept]
    han = np.flatnonzero((code >= 0x4E00) & (code <= 0x9FFF))
    for first in range(0, len(han), PLACES):
        i = han[first : first + PLACES]

        def beside(k: int) -> np.ndarray:
            j = i + k
            near = np.clip(j, 0, len(code) - 1)
            return np.where((j == near) & (text[near] == text[i]), code[near], 0x24 if k > 0 else 0x5E).astype(np.uint64)

        a, b, c, d, e, f = (beside(k) for k in (-3, -2, -1, 1, 2, 3))
        s16, s32, s48 = (np.uint64(n) for n in (16, 32, 48))
        keys = [(a << s32) | (b << s16) | c, (d << s32) | (e << s16) | f, (b << s48) | (c << s32) | (d << s16) | e]
        yield text[i], at[i], keys, code[i]


def _lots(values: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts with together at most SIGNS characters, or one longer one, and the number of the first."""
    lot, size, first = [], 0, 0
    for n, t in enumerate(values):
        if lot and size + len(t) > SIGNS:
            yield first, lot
            lot, size, first = [], 0, n
        lot.append(t)
        size += len(t)
    if lot:
        yield first, lot


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        for plain, open_, after, nxt, furniture in zip(batch["plain"], batch["open"], batch["after"], batch["next"], batch["furniture"]):
            for word, at in words_of(plain, open_, after, nxt):
                seen["W" if at >= 0 else "J", word] += 1  # broken words are no evidence of how a word is written
            if not furniture:
                for m in _COMPOUND.finditer(plain):
                    seen["C", m[0].lower()] += 1
        yield pd.DataFrame([(k, key, n) for (k, key), n in seen.items()], columns=["kind", "key", "n"])


def _count_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, c, n): kind 0 for the left, 1 for the right, 2 for both sides."""
    for batch in batches:
        for _, lot in _lots(batch["plain"]):
            for _, _, keys, c in surroundings(lot):
                for kind, key in enumerate(keys):
                    seen = pd.DataFrame({"key": key.view(np.int64), "c": c.astype(np.int32)}).groupby(["key", "c"], sort=False).size().reset_index(name="n")
                    yield pd.DataFrame({"kind": np.int32(kind), "key": seen["key"], "c": seen["c"], "n": seen["n"]})


def sign(c: str) -> Column:
    """The character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 4, "0")), "UTF-16BE")


def differences(wrong: str, right: str) -> list[str] | None:
    """Changed stretches "right>wrong" of two words, None if one is empty or too long.

    One stretch of at most STRETCH characters on either side, or two single characters.
    """
    a = 0
    while a < min(len(wrong), len(right)) and wrong[a] == right[a]:
        a += 1
    b = 0
    while b < min(len(wrong), len(right)) - a and wrong[-1 - b] == right[-1 - b]:
        b += 1
    x, y = right[a : len(right) - b], wrong[a : len(wrong) - b]
    if x and y and len(x) <= STRETCH and len(y) <= STRETCH and (len(x) == len(y) == 1 or len(x) != len(y)):
        return [f"{x}>{y}"]
    if len(wrong) == len(right):
        changed = [f"{r}>{w}" for r, w in zip(right, wrong) if r != w]
        return changed if len(changed) <= 2 else None
    return None


def _retrieve(key: tuple, words: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Known words in reach of each word's automaton that are much more frequent than it."""
    trie = Trie(zip(known["word"], known["n"]))
    out = []
    for word, n in zip(words["word"], words["n"]):
        least = ODDER if _ODD.search(word) else RARER
        for right, m in trie.within(word, DISTANCE):
            # in a short word two changes must be one stretch
            if m >= least * n and right != word and (d := differences(word, right)) and (len(word) > 4 or len(d) == 1):
                out.append((word, right, d, len(d[0]) if len(word) <= 4 else 0, int(m)))
    return pd.DataFrame(out, columns=["word", "right", "changes", "wide", "m"])


def skeleton(word: str, learned: list[list[str]]) -> str:
    """The word with every stretch that a recurring substitution makes put back, longer ones first, twice for slips in slips."""
    for right, wrong in 2 * sorted(learned, key=lambda x: (-len(x[1]), x)):
        if len(wrong) > len(right) or len(wrong) == len(right) == 1:
            word = word.replace(wrong, right)
    return word


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, right): words that are misreadings of known ones by substitutions that recur."""
    words = cut(counts.where("kind IN ('W', 'J')").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "W", F.col("n")).otherwise(0)).alias("unbroken")))
    known = words.where((F.col("unbroken") >= KNOWN) & F.col("word").rlike("^[a-zà-ɏ]+$") & (F.length("word") > 2))
    asked = words.where(F.length("word") > 2)
    shards = max(1, -(-known.count() // SHARD))
    parts = max(1, -(-asked.count() // QUERIES))
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    right = known.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    near = cut(left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(
        _retrieve, "word string, right string, changes array<string>, wide int, m long"))
    best = cut(near.groupBy("word").agg(F.max_by(F.struct("right", "changes"), F.struct(-F.size("changes"), -F.col("wide"), "m", "right")).alias("b")).select("word", "b.*"))
    single = best.where(F.size("changes") == 1).select(F.col("changes")[0].alias("change"))
    recurring = single.groupBy("change").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= RECURS).select("change", F.lit(1).alias("r"))
    strange = F.col("change").rlike(">.*[0-9!|$]")  # a digit or sign in place of letters needs no second case
    told = best.select("word", "right", F.explode("changes").alias("change")).join(recurring, "change", "left").groupBy("word", "right").agg(
        F.min(F.when(F.col("r").isNotNull() | strange, 1).otherwise(0)).alias("ok"))
    told = cut(told.where("ok = 1").select("word", "right"))
    # words with several slips: both sides are written with one form of each recurring substitution
    learned = [r["change"].split(">", 1) for r in recurring.select("change").orderBy("change").collect()]  # pairs of short stretches
    form = per_distinct(lambda w: None if w is None else skeleton(w, learned), T.StringType())
    forms = known.select(F.col("word").alias("right"), F.col("n").alias("m"), form("word").alias("form"))
    forms = forms.groupBy("form").agg(F.max_by("right", F.struct("m", "right")).alias("right"), F.max("m").alias("m"))
    rest = asked.join(told.select("word"), "word", "left_anti").select("word", "n", form("word").alias("form"))
    more = rest.join(forms, "form").where((F.col("word") != F.col("right")) & (F.length("word") > 4) & (
        F.col("m") >= F.col("n") * F.when(F.col("word").rlike("[0-9!|$]"), ODDER).otherwise(RARER)))
    return cut(told.unionByName(more.select("word", "right")))


def _mixed(kind: int | np.ndarray, key: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of a surrounding with its ideograph."""
    x = key.astype(np.uint64) ^ (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(kind).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _hashed(keys: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(k.encode()) for k in keys), dtype=np.uint64, count=len(keys))


def bit_filter(hashed: DataFrame) -> np.ndarray:
    """A filter over the hashes of ``h``: its size follows their number up to MOST_BITS, so it may be sent to all tasks.

    A hash marks two bits, one by its lower and one by its upper half.
    """
    n = hashed.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    words = hashed.select(F.explode(F.array(F.expr(f"h & {bits - 1}L"), F.expr(f"shiftrightunsigned(h, 32) & {bits - 1}L"))).alias("b")).select(F.shiftright("b", 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 32).cast("int")).alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # at most MOST_BITS / 32 rows
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["m"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    def marked(half: np.ndarray) -> np.ndarray:
        b = (half & np.uint64(len(table) * 32 - 1)).astype(np.int64)
        return ((table[b >> 5] >> (b & 31).astype(np.uint32)) & 1).astype(bool)

    return marked(hashes) & marked(hashes >> np.uint64(32))


def bad_numbers(plain: str) -> list[tuple[int, str]]:
    """(place, right text) of numbers with letters in them, and of codes whose check character is wrong."""
    out = []
    for m in _NUMBER.finditer(plain):
        t = m[0]
        if t.isdigit() or not any(c.isdigit() for c in t) or not any(c in "OoIlZS" for c in t):
            continue
        right = t.translate(_AS_DIGIT)
        if re.fullmatch(r"[\d.,:/-]+", right) and not re.fullmatch(r"[A-Z]\d", t):
            out.append((m.start(), right))
    out += [(m.start(), m[0].translate(_AS_DIGIT)) for pattern in (_LONE, _UNIT) for m in pattern.finditer(plain)]
    for m in _CODE.finditer(plain):
        t = m[0].upper()
        if t[:2] in ("91", "9L", "9I", "92", "93") or sum(c.isdigit() for c in t) >= 8:
            if t.isdigit():
                continue
            if any(c not in ALPHABET for c in t):
                out.append((m.start(), ""))
            else:
                k = (31 - sum(ALPHABET.index(c) * w for c, w in zip(t, WEIGHTS)) % 31) % 31
                if ALPHABET[k] != t[17]:
                    out.append((m.start(), ""))
    return out


def misread(laid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word counts, findings): findings are (line_id, at, was, right) of each misread word, number or ideograph."""
    used = laid.where("length(plain) > 0").select("line_id", "plain", "open", "after", "next", "furniture")
    latin, ideographs = used.where(F.col("plain").rlike("[A-Za-zÀ-ɏ]")), used.where(F.col("plain").rlike("[一-鿿]")).select("line_id", "plain")
    counts = cut(latin.mapInPandas(_count_words, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    slips = misread_words(counts)
    around = cut(ideographs.select("plain").mapInPandas(_count_signs, "kind int, key long, c int, n long").groupBy("kind", "key", "c").agg(F.sum("n").alias("n")))
    # only surroundings seen often say something; the most frequent sign is found as one number with its count
    often = around.groupBy("kind", "key").agg(F.sum("n").alias("total"), F.max(F.col("n") * 65536 + F.col("c")).alias("best")).where(F.col("total") >= SEEN)
    often = cut(often.select("kind", "key", "total", F.shiftright("best", 16).alias("most"), (F.col("best") % 65536).cast("int").alias("top")))
    told = join_sized(around, often, ["kind", "key"], "inner", row_bytes=40)
    rare = (F.col("most") >= F.col("total") * SURE) & (F.col("c") != F.col("top")) & (F.col("n") <= F.greatest(F.lit(1.0), F.col("total") * DOUBT))
    backing = F.col("n") >= F.col("total") * BACKED
    told = cut(told.where(rare | backing).select("kind", "key", "c", F.when(rare, F.col("top")).alias("top"), F.when(backing, 1).alias("backed")))
    free(around, often)
    doubted = told.where("top IS NOT NULL")

    def mix(kind: pd.Series, key: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_mixed(kind.to_numpy(), key.to_numpy().view(np.uint64), c.to_numpy()).view(np.int64))

    mix.__annotations__ = {k: pd.Series for k in ("kind", "key", "c", "return")}

    def crc(word: pd.Series) -> pd.Series:
        return pd.Series(_hashed(list(word)).astype(np.int64))

    crc.__annotations__ = {"word": pd.Series, "return": pd.Series}
    sc = used.sparkSession.sparkContext
    sign_bits = sc.broadcast(bit_filter(doubted.select(F.pandas_udf(mix, "long")("kind", "key", "c").alias("h"))))
    word_bits = sc.broadcast(bit_filter(slips.select(F.pandas_udf(crc, "long")("word").alias("h"))))

    def find_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, asked = [], []
            for line, plain, open_, after, nxt in zip(batch["line_id"], batch["plain"], batch["open"], batch["after"], batch["next"]):
                out += [(line, at, "", right) for at, right in bad_numbers(plain)]
                asked += [(line, at, word, None) for word, at in words_of(plain, open_, after, nxt)]
            marks = held(word_bits.value, _hashed([a[2] for a in asked]))
            out += [a for a, h in zip(asked, marks) if h]
            yield pd.DataFrame(out, columns=["line_id", "at", "was", "right"])

    def find_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A place keeps all its surroundings if one of them is doubted; kind 3 counts the ideographs."""
        for batch in batches:
            lines = batch["line_id"].to_numpy()
            for first, lot in _lots(batch["plain"]):
                for text, at, keys, c in surroundings(lot):
                    signs, n = np.unique(c, return_counts=True)
                    yield pd.DataFrame({"line_id": np.int64(-1), "at": n.astype(np.int32), "kind": np.int32(3), "key": np.int64(0), "c": signs.astype(np.int32)})
                    hit = np.zeros(len(c), dtype=bool)
                    for kind, key in enumerate(keys):
                        hit |= held(sign_bits.value, _mixed(kind, key, c))
                    for kind, key in enumerate(keys):
                        yield pd.DataFrame({"line_id": lines[first + text[hit]], "at": at[hit].astype(np.int32), "kind": np.int32(kind), "key": key[hit].view(np.int64), "c": c[hit].astype(np.int32)})

    hits = cut(used.where(F.col("plain").rlike("[A-Za-zÀ-ɏ0-9]")).mapInPandas(find_words, "line_id long, at int, was string, right string"))
    numbers = hits.where("right IS NOT NULL")
    by_word = hits.where("right IS NULL").drop("right").join(slips.withColumnsRenamed({"word": "was"}), "was").select("line_id", "at", "was", "right")
    # a place is misread if a surrounding tells another character and none backs the one that stands there
    seen = cut(ideographs.mapInPandas(find_signs, "line_id long, at int, kind int, key long, c int"))
    spots = seen.where("kind < 3").join(told, ["kind", "key", "c"], "left")
    spots = cut(spots.groupBy("line_id", "at", "c").agg(
        F.max("backed").alias("backed"), F.mode("top", True).alias("top"),
        F.max(F.when(F.col("top").isNotNull(), F.struct("kind", "key"))).alias("by")).where("backed IS NULL AND top IS NOT NULL"))
    pairs = spots.groupBy("top", "c").agg(F.count_distinct("by").alias("k")).where(F.col("k") >= RECURS)
    sure = cut(spots.join(pairs, ["top", "c"]).select("line_id", "at", sign("c").alias("was"), sign("top").alias("right")))
    always = sure.groupBy("was").agg(F.count(F.lit(1)).alias("bad"), F.mode("right", True).alias("right"))
    always = always.join(seen.where("kind = 3").groupBy("c").agg(F.sum("at").alias("n")).select(sign("c").alias("was"), "n"), "was").where((F.col("bad") >= ALWAYS * F.col("n")) & (F.col("n") >= KNOWN))
    fixed = {r["was"]: r["right"] for r in always.collect()}  # at most as many as there are ideographs
    more = None
    if fixed:
        signs = F.regexp_extract_all("plain", F.lit("([" + "".join(sorted(fixed)) + "])"), 1)
        table = F.create_map(*(F.lit(x) for pair in sorted(fixed.items()) for x in pair))
        # one search for each sign is faster than a pattern over all of a line, as long as there are few
        some = reduce(lambda a, b: a | b, (F.col("plain").contains(c) for c in sorted(fixed))) if len(fixed) <= FEW else F.lit(True)
        more = ideographs.where(some).select("line_id", F.explode(signs).alias("was")).select("line_id", F.lit(-2).alias("at"), "was", table[F.col("was")].alias("right"))
        more = more.join(sure.select("line_id", "was").distinct(), ["line_id", "was"], "left_anti")
    found = numbers.unionByName(by_word).unionByName(sure)
    found = cut(found.unionByName(more.select(*found.columns)) if more is not None else found)
    free(told, seen, spots, sure, hits)
    return counts, found


def hyphens(laid: DataFrame, counts: DataFrame) -> DataFrame:
    """(line_id, joined): lines whose last word was broken by an added hyphen, with the whole word."""
    def parts(plain: pd.Series, nxt: pd.Series) -> pd.DataFrame:
        got = [fragments(a, b) or (None, None) for a, b in zip(plain, nxt)]
        return pd.DataFrame(got, columns=["head", "tail"], index=plain.index)

    parts.__annotations__ = {"plain": pd.Series, "nxt": pd.Series, "return": pd.DataFrame}
    ends = laid.where("mark <> '' AND next IS NOT NULL").select("line_id", "mark", F.pandas_udf(parts, "head string, tail string")("plain", "next").alias("p")).select("line_id", "mark", "p.*").where("head IS NOT NULL AND tail IS NOT NULL")
    ends = cut(ends.withColumns({"word": F.lower(F.concat("head", "tail")), "compound": F.lower(F.concat("head", F.lit("-"), "tail")), "first": F.lower("head"), "second": F.lower("tail")}))
    n = lambda kind, key, name: counts.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("n").alias(name))
    e = ends.join(n("W", "word", "n_word"), "word", "left").join(n("C", "compound", "n_compound"), "compound", "left")
    e = e.join(n("W", "first", "n_first"), "first", "left").join(n("W", "second", "n_second"), "second", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    word, compound = z("n_word"), z("n_compound")
    both_known = (z("n_first") >= KNOWN) & (z("n_second") >= KNOWN)
    added = F.when(F.col("mark") == "\u00ad", (word > 0) & (word > z("n_first"))).when(F.col("mark") == "¬", True).when(F.col("head").rlike("^[0-9]+$") | F.col("tail").rlike("^[0-9]+$"), False).when(
        word > compound, True).when(compound > word, False).when(F.col("tail").rlike("^[A-ZÀ-Þ]"), False).otherwise(~both_known)
    return e.where(added).select("line_id", F.concat("head", "tail").alias("joined"))


def noise(lines: DataFrame) -> DataFrame:
    """(line_id, kind), each pair once."""
    laid = laid_out(lines)
    counts, wrong = misread(laid)
    furniture = laid.where("furniture").select("line_id", F.when(F.col("page_only"), "page_no").otherwise("running").alias("kind"))
    broken = hyphens(laid, counts).select("line_id", F.lit("hyphen").alias("kind"))
    # a slip in a joined word belongs to the line that holds the changed stretch
    bad = _blamed(laid, wrong).select("line_id", F.lit("misread").alias("kind"))
    return furniture.unionByName(broken).unionByName(bad).distinct()


def _blamed(laid: DataFrame, wrong: DataFrame) -> DataFrame:
    """Findings with the line to blame: for joined words the next line if the slip lies there."""
    here = wrong.where("at <> -1").select("line_id", "was", "right", "at")
    across = wrong.where("at = -1").join(laid.select("line_id", "scan_id", "page_no", "line_idx", "plain", "next"), "line_id")

    def side(plain: pd.Series, nxt: pd.Series, was: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for p, n, w, r in zip(plain, nxt, was, right):
            f = fragments(p, n)
            k = next((i for i, (a, b) in enumerate(zip(w, r)) if a != b), min(len(w), len(r)))
            out.append(bool(f) and k >= len(f[0]))
        return pd.Series(out, index=plain.index)

    side.__annotations__ = {k: pd.Series for k in ("plain", "nxt", "was", "right", "return")}
    across = cut(across.withColumn("later", F.pandas_udf(side, "boolean")("plain", "next", "was", "right")))
    own = across.where("NOT later").select("line_id", "was", "right", "at")
    body = laid.where("NOT furniture AND after AND length(plain) > 0").select("scan_id", F.col("page_no").alias("p"), F.col("line_idx").alias("i"), F.col("line_id").alias("to"))
    same = across.where("later").join(body.withColumnsRenamed({"p": "page_no"}), ["scan_id", "page_no"]).where("i > line_idx")
    same = same.groupBy("line_id", "was", "right", "at").agg(F.min_by("to", "i").alias("to"), F.min("i").alias("i"), F.min("line_idx").alias("line_idx"))
    turned = across.where("later").join(body.withColumn("page_no", F.col("p") - 1), ["scan_id", "page_no"])
    turned = turned.groupBy("line_id", "was", "right", "at").agg(F.min_by("to", "i").alias("to"))
    moved = same.select("line_id", "was", "right", "at", "to").unionByName(
        turned.join(same.select("line_id", "at"), ["line_id", "at"], "left_anti").select("line_id", "was", "right", "at", "to"))
    return here.unionByName(own).unionByName(moved.select(F.col("to").alias("line_id"), "was", "right", "at"))


def _repair(plain: str, found: list) -> str:
    """The line with its misread stretches put right; the letter case of words is kept."""
    chars = list(plain)
    later = []
    for f in found:
        at, was, right = f["at"], f["was"], f["right"]
        if not right:
            continue
        if at >= 0 and len(was) == 1:
            chars[at] = right
        elif at == -2:
            chars = [right if c == was else c for c in chars]
        elif at >= 0:
            later.append((at, was, right))
    for at, was, right in sorted(later, key=lambda x: -x[0]):
        old = "".join(chars[at : at + (len(was) or len(right))])
        new = right.capitalize() if old[:1].isupper() else right
        chars[at : at + len(old)] = list(new)
    return "".join(chars)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(scan_id, para_no, first_page, n_lines, text): furniture dropped, characters repaired, lines reflowed.

    A paragraph begins at the first line of a scan and at lines that start further right than
    the usual left edge of their page; it goes on over page ends.
    """
    laid = laid_out(lines)
    counts, wrong = misread(laid)
    broken = hyphens(laid, counts).select("line_id", F.lower("joined").alias("joined"))
    inside = wrong.where("at <> -1").groupBy("line_id").agg(F.collect_set(F.struct("at", "was", "right")).alias("found"))
    whole = wrong.where("at = -1").select("line_id", F.col("right").alias("whole"))
    body = laid.where("NOT furniture AND length(plain) > 0").join(inside, "line_id", "left").join(broken, "line_id", "left").join(whole.groupBy("line_id").agg(F.first("whole").alias("whole")), "line_id", "left")

    def fix(plain: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_repair(p, list(f)) if f is not None else p for p, f in zip(plain, found)], index=plain.index)

    fix.__annotations__ = {"plain": pd.Series, "found": pd.Series, "return": pd.Series}
    body = body.withColumn("fixed", F.trim(F.pandas_udf(fix, T.StringType())("plain", "found")))
    page = Window.partitionBy("scan_id", "page_no")
    order = page.orderBy("line_idx", "line_id")
    body = body.withColumn("left", F.percentile_approx("x", 0.4).over(page)).withColumn("begins", (F.col("x") > F.col("left") + 0.018).cast("int"))
    body = cut(body.withColumn("within", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    # running count of paragraphs in two steps, so that no scan is ordered as a whole
    pages = cut(body.groupBy("scan_id", "page_no").agg(F.max("within").alias("k")).withColumn("block", F.floor(F.col("page_no") / BLOCK)))
    earlier = lambda *by: Window.partitionBy("scan_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = pages.groupBy("scan_id", "block").agg(F.sum("k").alias("b")).withColumn("skipped", F.coalesce(F.sum("b").over(earlier("block")), F.lit(0)))
    pages = pages.withColumn("inner", F.coalesce(F.sum("k").over(earlier("block", "page_no")), F.lit(0))).join(blocks, ["scan_id", "block"]).select(
        "scan_id", "page_no", (F.col("inner") + F.col("skipped")).alias("skip"))
    placed = body.join(pages, ["scan_id", "page_no"]).withColumn("para", F.col("skip") + F.col("within"))
    packed = placed.groupBy("scan_id", "para").agg(
        F.min("page_no").alias("first_page"), F.count(F.lit(1)).cast("int").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct("page_no", "line_idx", "line_id", "fixed", "joined", "whole"))).alias("parts"))

    def flow(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: reflow([(x["fixed"], x["joined"], x["whole"]) for x in p]))

    flow.__annotations__ = {"parts": pd.Series, "return": pd.Series}
    return packed.select(
        "scan_id", F.col("para").cast("int").alias("para_no"), "first_page", "n_lines", F.pandas_udf(flow, T.StringType())("parts").alias("text"))


def reflow(parts: list[tuple[str, str | None, str | None]]) -> str:
    """One paragraph from (line, joined word if its end was broken, repaired form of that word)."""
    out, glue, swap = "", True, None
    for text, joined, whole in parts:
        if swap and glue:
            head = re.match(r"[A-Za-zÀ-ɏ0-9!|$]+", text)
            start = re.search(r"[A-Za-zÀ-ɏ0-9!|$]+$", out)
            if head and start:
                word = swap.capitalize() if start[0][:1].isupper() else swap
                out, text = out[: start.start()] + word, text[head.end() :]
        if out and not glue:
            a, b = out[-1], text[:1]
            compound = re.search(r"[A-Za-zÀ-ɏ]-$", out) and b.islower() and not re.match(r"(?:und|oder|and|or)\b", text)
            out += " " if a < "⺀" and b < "⺀" and not compound else ""
        out += text
        glue, swap = joined is not None, whole
        if glue:
            out = re.sub(f"[{_HYPHEN}]+$", "", out.rstrip())
    # marks beside ideographs get back the width that the canonical form took
    out = re.sub(r"(?<=[一-鿿])[,;:?!](?=[一-鿿0-9]|$)", lambda m: m[0].translate(_WIDE), out)
    return re.sub(r"(?<=[一-鿿])\)", "）", re.sub(r"\((?=[一-鿿])", "（", out))
