"""Problem 6: freely entered values mapped to the entries of a reference list.

Per distinct value: a multi-pattern automaton over names and aliases finds embedded mentions;
of overlapping ones the longest stays, and the longest of those left names the entry. A mention
does not decide if two entries are mentioned at equal length, or if the text beside it holds a
token that the list knows from other entries ("... (roll)" beside the plain form): such values,
and those without a mention, go to the similarity of token sets (ideographs one by one, Latin
by word, in any order), found over an inverted index of the tokens. The best entry must reach
the threshold and beat every other entry, else the value means none (-1). A value that leaves
out letters of one name only ("abbreviation") means it if one of its tokens is rare in the list.

Aliases are read, not written here: a table may be given, and ``learned_aliases`` finds them in
the records themselves. Where two records describe the same thing and one of them has a name of
the list, what the other one says is a vote for that name.

Null, "" and the sentinels are no values; an empty list maps every value to -1. Ties between
entries give -1. Repeated rows get the same answer, extra columns are not read. The list must
be small: it is collected after its rows are counted, as every worker holds the automaton.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.canon import folded
from paperloom.runtime import cut, join_sized

#: Most entries of a reference list, names and aliases together; the automaton lives in each worker.
MOST_ENTRIES = 100_000
#: Least similarity; lead of an abbreviation, entries that may share its rarest token, and the least weight it keeps of the name.
LEAST, LEAD, RARE, KEPT = 0.62, 0.05, 3, 0.25
#: Least likeness of two Latin words with a slip.
WORD = 0.7
#: An alias is learned from so many things at least (a share bounds their number), if so large a part of
#: them names one entry, and by so much more than chance would among all forms tried (log likelihood).
VOTES, VOTES_SHARE, AGREED, BEYOND = 2, 1e-5, 0.75, 1.0
#: Times that learned aliases may serve to learn others.
ROUNDS = 2
SENTINELS = ("", "待确认", "（未分类）")

_MARKS = re.compile(r"[\s【】\[\]「」《》<>()。．.?？!！,，;；:：、\-_/|·'\"“”]+")
# Words for "kind of" and "and the like" behind a value.
_KIND = re.compile(r"(?<=..)[类等]$")
_BLANK = re.compile(r"(?<=[^\x00-\x7f]) | (?=[^\x00-\x7f])")
_TOKEN = re.compile(r"[a-z0-9]+|[^a-z0-9\s]")


def plain(value: str) -> str:
    """Folded value without marks; blanks are kept between Latin words only."""
    return _KIND.sub("", _BLANK.sub("", _MARKS.sub(" ", folded(value) or "").strip()))


def edits(a: str, b: str) -> int:
    """Edit distance in which the swap of two neighbours counts once."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _grams(word: str) -> set[str]:
    """Index keys of a token: an ideograph itself, the letter pairs of a word."""
    return {word} if len(word) == 1 else {word[i : i + 2] for i in range(len(word) - 1)}


def _subsequence(a: str, b: str) -> bool:
    rest = iter(b)
    return all(c in rest for c in a)


class Matcher:
    """Automaton and token index over (id, name) entries and aliases; ``find`` gives the id meant, or -1, and the step."""

    def __init__(self, entries: list[tuple[int, str]], others: list[tuple[int, str]] = ()):
        import ahocorasick

        ids: dict[str, set[int]] = {}
        for i, name in entries:
            ids.setdefault(plain(name), set()).add(i)
        self.names = {n: min(i) for n, i in ids.items() if n}
        meant: dict[str, set[int]] = {}
        for i, name in others:
            meant.setdefault(plain(name), set()).add(i)
        # an alias of two entries means none, a name is never an alias of another
        self.forms = {n: min(i) for n, i in meant.items() if n and len(i) == 1} | self.names
        # words broken by a blank: the whole value without blanks
        self.joined = {n.replace(" ", ""): i for n, i in self.forms.items() if n.isascii()}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.forms.items():
            if len(name) > 1:
                self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()
        self.sets = [(n, i, tokens(n)) for n, i in self.forms.items()]
        self.index: dict[str, list[int]] = {}
        self.holders: dict[str, set[int]] = {}
        for at, (_, i, words) in enumerate(self.sets):
            for g in set().union(*map(_grams, words)) if words else ():
                self.index.setdefault(g, []).append(at)
        for n, i in self.names.items():
            for w in tokens(n):
                self.holders.setdefault(w, set()).add(i)
        # tokens weigh by their rarity among entries, unknown ones as the mean
        used: dict[str, set[int]] = {}
        for _, i, words in self.sets:
            for w in words:
                used.setdefault(w, set()).add(i)
        count = max(1, len(set(self.names.values())))
        self.weight = {w: math.log(max(1.0, count / len(h))) + 0.1 for w, h in used.items()}
        self.mean = sum(self.weight.values()) / len(self.weight) if self.weight else 1.0

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """Non-overlapping (start, end, id), longer before earlier."""
        found = [(e - n + 1, e + 1, i) for e, (n, i) in self.automaton.iter(text)] if len(self.automaton) else []

        def latin(at: int) -> bool:
            return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()

        # a Latin mention must be a word of its own
        found = [m for m in found if not (latin(m[0]) and latin(m[0] - 1) or latin(m[1] - 1) and latin(m[1]))]
        taken: list[tuple[int, int, int]] = []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        return taken

    def mentioned(self, text: str) -> int | None:
        """The entry of the longest mention, None if none decides."""
        seen = self.mentions(text)
        if not seen:
            return self.joined.get(text.replace(" ", "")) if text.isascii() else None
        best = seen[0]
        size = best[1] - best[0]
        if any(m[2] != best[2] and m[1] - m[0] == size for m in seen):
            return None
        beside = text
        for m in sorted(seen, reverse=True):
            beside = beside[: m[0]] + " " + beside[m[1] :]
        # tokens of other entries beside the mentions contradict them
        return None if any(self.holders.get(w, {best[2]}) - {best[2]} and best[2] not in self.holders[w] for w in tokens(beside)) else best[2]

    def find(self, value: str) -> tuple[int, str]:
        text = plain(value)
        if not text:
            return -1, "none"
        named = self.mentioned(text)
        if named is not None:
            return named, "mention"
        words = tokens(text)
        shared = {at for g in set().union(*map(_grams, words)) for at in self.index.get(g, ())}
        alike: dict[int, float] = {}
        for at in shared:
            name, i, others = self.sets[at]
            alike[i] = max(alike.get(i, 0.0), self._alike(text, words, name, others))  # the best of each entry
        for step, scores, least, lead in (("abbreviation", self._short(text, words, shared), KEPT, LEAD), ("tokens", alike, LEAST, 0.0)):
            ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
            if ranked and ranked[0][1] >= least and (len(ranked) == 1 or ranked[0][1] - ranked[1][1] > lead):
                return ranked[0][0], step
        return -1, "none"

    def _short(self, text: str, words: list[str], shared: set[int]) -> dict[int, float]:
        """Share that an abbreviation keeps of the names it may stand for, by the weight of their tokens."""
        if len(words) < 2 or min((len(self.holders.get(w, ())) or RARE + 1 for w in words), default=RARE + 1) > RARE:
            return {}
        kept = sum(self.weight.get(w, self.mean) for w in words)
        out: dict[int, float] = {}
        for at in shared:
            name, i, others = self.sets[at]
            if name in self.names and len(name) > len(text) and _subsequence(text, name):
                out[i] = max(out.get(i, 0.0), kept / sum(self.weight[w] for w in others))
        return out

    def _alike(self, a: str, words: list[str], b: str, others: list[str]) -> float:
        """Latin: tokens in common, in any order, each up to a slip. Ideographs: weights of tokens in common, and edits."""
        if all(w.isalnum() and w.isascii() for w in words) or all(w.isalnum() and w.isascii() for w in others):
            if not (all(w.isascii() for w in words) and all(w.isascii() for w in others)):
                return 0.0
            free, total = list(others), 0.0
            for w in words:
                like = [(1.0 if w == o else 1 - edits(w, o) / max(len(w), len(o)) if min(len(w), len(o)) > 3 else 0.0) for o in free]
                if like and max(like) >= WORD:
                    total += max(like)
                    free.pop(like.index(max(like)))
            return 2 * total / (len(words) + len(others))
        one, two = set(words), set(others)
        if len(one & two) < 2:
            return 0.0
        weigh = lambda group: sum(self.weight.get(w, self.mean) for w in group)
        return weigh(one & two) / (weigh(one) + weigh(two)) + 0.5 * (1 - edits(a, b) / max(len(a), len(b)))


def _entries(reference: DataFrame) -> list[tuple[int, str]]:
    n = reference.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} entries are no list to be held by every worker")
    return [(r["ref_id"], r["name"]) for r in reference.select("ref_id", "name").collect() if r["name"] and r["ref_id"] is not None]


def learned_aliases(df: DataFrame, field: str, reference: DataFrame, same: Column, given: DataFrame | None = None) -> list[tuple[int, str]]:
    """(ref_id, alias) learned from records with equal ``same``: they describe one thing.

    Counted over all records. Forms with digits tell numbers or pages rather than kinds and aren't learned. A thing counts if the names and aliases mentioned by its records
    are of one entry; each other form of its records is then a vote for that entry. A null
    ``same`` is no thing. At most 1 / VOTES_SHARE aliases can reach the least share of votes.
    """
    entries = _entries(reference)
    known = _entries(given) if given is not None else []

    def forms(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        done = [plain(v) for v in distinct]
        return pd.Series([done[c] for c in codes], index=values.index, dtype=object)

    forms.__annotations__ = {"values": pd.Series, "return": pd.Series}
    said = df.select(same.alias("thing"), F.col(field).alias("value")).where(
        F.col("thing").isNotNull() & F.col("value").isNotNull() & ~F.col("value").isin(*SENTINELS))
    said = cut(said.distinct().select("thing", F.pandas_udf(forms, "string")("value").alias("form")).where("form <> '' AND NOT form RLIKE '[0-9]'").distinct())
    several = said.groupBy("thing").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("thing")
    said = cut(said.join(several, "thing", "left_semi"))
    distinct = cut(said.select("form").distinct())
    for _ in range(ROUNDS):
        def resolve(batches: Iterator[pd.DataFrame], known: list = known) -> Iterator[pd.DataFrame]:
            matcher = Matcher(entries, known)
            for batch in batches:
                ids = [matcher.mentioned(f) for f in batch["form"]]
                likely = [i if i is not None else matcher.find(f)[0] for i, f in zip(ids, batch["form"])]
                yield pd.DataFrame({"form": batch["form"], "ref_id": pd.array(ids, dtype="Int32"), "likely": pd.array(likely, dtype="Int32")})

        named = cut(distinct.mapInPandas(resolve, "form string, ref_id int, likely int"))
        told = cut(join_sized(said, named, ["form"], "inner", row_bytes=200))
        things = told.where("ref_id IS NOT NULL").groupBy("thing").agg(F.min("ref_id").alias("ref"), F.max("ref_id").alias("most")).where("ref = most").select("thing", "ref")
        things = cut(things)
        base = {r["ref"]: r["n"] for r in things.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_ENTRIES rows
        total = sum(base.values())
        if not total:
            return known
        votes = join_sized(told.where("ref_id IS NULL"), things, ["thing"], "inner", row_bytes=32).groupBy("form", "likely", "ref").agg(F.count(F.lit(1)).alias("k"))
        won = votes.groupBy("form", "likely").agg(F.sum("k").alias("n"), F.max("k").alias("k"), F.max_by("ref", F.struct("k", -F.col("ref"))).alias("ref"))
        # what is understood anyway needs no alias
        won = won.where((F.col("likely") != F.col("ref")) & (F.col("k") >= max(VOTES, total * VOTES_SHARE))).collect()  # at most 1 / VOTES_SHARE rows
        least = BEYOND + math.log(max(1, len(won)))
        more = [(r["ref"], r["form"]) for r in won if r["k"] >= AGREED * r["n"] and r["k"] * math.log(r["k"] / r["n"] / (base[r["ref"]] / total)) >= least]
        if not more:
            break
        known = known + more
    return known


def map_to_list(
    df: DataFrame, key: str, field: str, reference: DataFrame, aliases: DataFrame | None = None, same: Column | None = None
) -> DataFrame:
    """(key, field_name, ref_id, step) of the values that are not the exact name of an entry.

    ``aliases`` (ref_id, name) are given, more are learned if ``same`` tells records of one thing.
    """
    entries = _entries(reference)
    if same is not None:
        known = learned_aliases(df, field, reference, same, aliases)
    else:
        known = _entries(aliases) if aliases is not None else []
    names, ids = [name for _, name in entries], {i for i, _ in entries}
    known = [a for a in known if a[0] in ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries, known)
        memo: dict[str, tuple[int, str]] = {}
        for batch in batches:
            for v in batch["value"].unique():
                if v not in memo:
                    memo[v] = matcher.find(v)
            found = [memo[v] for v in batch["value"]]
            yield pd.DataFrame({"key": batch["key"], "ref_id": pd.Series([i for i, _ in found], dtype="int32"), "step": [s for _, s in found]})
            if len(memo) > MOST_ENTRIES:
                memo.clear()

    values = df.select(F.col(key).alias("key"), F.col(field).alias("value")).where(
        F.col("value").isNotNull() & ~F.col("value").isin(*SENTINELS, *names)
    )
    kind = dict(df.dtypes)[key]
    return values.mapInPandas(run, f"key {kind}, ref_id int, step string").select(
        F.col("key").alias(key), F.lit(field).alias("field_name"), "ref_id", "step"
    )
