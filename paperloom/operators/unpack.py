"""Several values packed in one field: split into one row per value, position kept.

Quoted spans, brackets and marks between digits are atomic. Marks that can only separate are
cut by rule (``functions.segments``). A single space is ambiguous: it parts two values
("stapler printer") or belongs to one ("stapler A4"). For it, value frequencies are learned
from the whole column by expectation-maximisation: every atom has an expected count as the
head of a value and as the tail of one, each backed off to its first two characters; the
lattice of a stretch is summed forward and backward for the expected counts, and the Viterbi
path over the learned counts gives the split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.segments import lex
from paperloom.runtime import cut, join_sized

#: Rounds of expectation-maximisation; counts change by under a hundredth after three.
ROUNDS = 3
#: Weight of the two-character prefix counts against the atom's own counts, and of the unseen.
BACKOFF, UNSEEN = 0.2, 0.05
#: Prior probabilities inside a stretch: a tail follows a head, a tail follows a tail.
TAIL_AFTER_HEAD, TAIL_AFTER_TAIL = 0.5, 0.02

_LEXED = T.ArrayType(
    T.StructType([
        T.StructField("stretch", T.IntegerType()),
        T.StructField("atom", T.StringType()),
        T.StructField("quoted", T.BooleanType()),
    ])
)


@F.pandas_udf(_LEXED)
def _lex(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"stretch": s, "atom": a, "quoted": q} for s, a, q in lex(t)])


def _weights(row: dict) -> tuple[float, float]:
    """Emission of an atom as head and as tail; an atom in asterisks can only be a head."""
    head = (row["ah"] + BACKOFF * row["ph"] + UNSEEN) / row["nh"]
    tail = (row["at"] + BACKOFF * row["pt"] + UNSEEN) / row["nt"]
    if row["starred"]:
        return head, 1e-9 * head
    return head, tail


def _lattice(steps: list[dict]) -> tuple[list[float], list[int]]:
    """Posterior of every atom being a head, and the Viterbi path (1: begins a value)."""
    n = len(steps)
    w = [_weights(s) for s in steps]
    trans = {(0, 0): 1 - TAIL_AFTER_HEAD, (0, 1): TAIL_AFTER_HEAD, (1, 0): 1 - TAIL_AFTER_TAIL, (1, 1): TAIL_AFTER_TAIL}
    fwd, best, back = [(1.0, 0.0)], [(0.0, -math.inf)], []
    for i in range(1, n):
        f, b = fwd[-1], best[-1]
        cur = [w[i][k] * sum(f[j] * trans[j, k] for j in (0, 1)) for k in (0, 1)]
        z = sum(cur) or 1.0
        fwd.append((cur[0] / z, cur[1] / z))
        pick = [max((b[j] + math.log(trans[j, k]), -j) for j in (0, 1)) for k in (0, 1)]
        back.append([-p[1] for p in pick])
        best.append(tuple(math.log(max(w[i][k], 1e-300)) + pick[k][0] for k in (0, 1)))
    bwd = [(1.0, 1.0)]
    for i in range(n - 1, 0, -1):
        cur = [sum(trans[j, k] * w[i][k] * bwd[0][k] for k in (0, 1)) for j in (0, 1)]
        z = sum(cur) or 1.0
        bwd.insert(0, (cur[0] / z, cur[1] / z))
    post = []
    for f, b in zip(fwd, bwd):
        h, t = f[0] * b[0], f[1] * b[1]
        post.append(h / (h + t) if h + t else 1.0)
    k = 0 if best[-1][0] >= best[-1][1] else 1
    path = [1 - k]
    for i in range(n - 2, -1, -1):
        k = back[i][k]
        path.insert(0, 1 - k)
    return post, path


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [_lattice(list(steps)) for steps in batch["steps"]]
        yield pd.DataFrame({"run": batch["run"], "post": [d[0] for d in done], "path": [d[1] for d in done]})


def _prefix(atom: str) -> F.Column:
    """First two characters of the value itself, after a leading *class* mark."""
    return F.substring(F.regexp_replace(atom, r"^\*[^*]*\*", ""), 1, 2)


def _counts(atoms: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """Expected head and tail counts by key from the open atoms and those sure to begin a value."""
    return (
        atoms.select(key, (F.col("n") * F.col("post")).alias("h"), (F.col("n") * (1 - F.col("post"))).alias("t"))
        .unionByName(first.select(key, F.col("n").alias("h"), F.lit(0.0).alias("t")))
        .groupBy(key)
        .agg(F.sum("h").alias("h"), F.sum("t").alias("t"))
    )


def unpack_values(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos, item, n_items): each value of ``field``, pos from 1.

    Nulls, empty strings and strings of marks only give no row. Repeated strings are solved
    once. Extra columns of ``df`` are ignored, whatever their names. A key that occurs in
    several rows yields its values once per row.
    """
    rows = df.select(F.col(key).alias("key"), F.col(field).alias("text")).where(F.length("text") > 0)
    texts = cut(
        rows.groupBy("text")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .withColumn("lexed", _lex("text"))
    )
    atoms = texts.select("text", "n", F.posexplode("lexed").alias("i", "x")).select(
        "text", "n", "i", "x.stretch", "x.atom", "x.quoted"
    )
    # stretches of one atom are settled; the others are pooled by their wording
    stretches = atoms.groupBy("text", "n", "stretch").agg(
        F.sort_array(F.collect_list(F.struct("i", "atom", "quoted"))).alias("parts")
    )
    settled = stretches.where(F.size("parts") == 1)
    open_ = stretches.where(F.size("parts") > 1).withColumn("run", F.col("parts.atom"))
    runs = cut(open_.groupBy("run").agg(F.sum("n").alias("n")))
    steps = runs.select("run", "n", F.posexplode("run").alias("i", "atom")).select(
        "run", "n", "i", "atom", _prefix("atom").alias("prefix"), F.col("atom").rlike(r"^\*[^*]+\*").alias("starred")
    )
    first = (
        settled.where(~F.col("parts")[0]["quoted"])
        .select("n", F.col("parts")[0]["atom"].alias("atom"))
        .unionByName(runs.select("n", F.col("run")[0].alias("atom")))
        .groupBy("atom").agg(F.sum("n").alias("n"))
        .withColumn("prefix", _prefix("atom"))
    )
    first = cut(first)
    later = steps.where("i > 0").withColumn("post", F.lit(0.5))
    for turn in range(ROUNDS + 1):
        by_atom = cut(_counts(later, first, "atom"))
        by_prefix = cut(_counts(later, first, "prefix"))
        total = by_atom.agg(F.sum("h").alias("nh"), F.sum("t").alias("nt"))
        known = join_sized(steps, by_atom.select("atom", F.col("h").alias("ah"), F.col("t").alias("at")), ["atom"], "left")
        known = join_sized(known, by_prefix.select("prefix", F.col("h").alias("ph"), F.col("t").alias("pt")), ["prefix"], "left")
        known = known.join(F.broadcast(total)).select(  # one row
            "run",
            F.struct(
                "i", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ah", "at", "ph", "pt")),
                *(F.greatest(c, F.lit(1.0)).alias(c) for c in ("nh", "nt")), "starred",
            ).alias("step"),
        )
        solved = cut(
            known.groupBy("run").agg(F.sort_array(F.collect_list("step")).alias("steps"))
            .mapInPandas(_solve, "run array<string>, post array<double>, path array<int>")
        )
        if turn < ROUNDS:
            later = (
                solved.join(runs, "run").select("n", F.arrays_zip("run", "post").alias("z"))
                .select("n", F.explode(F.slice("z", 2, F.size("z") - 1)).alias("z"))
                .select("n", F.col("z.run").alias("atom"), F.col("z.post").alias("post"))
                .groupBy("atom", "post").agg(F.sum("n").alias("n"))
                .withColumn("prefix", _prefix("atom"))
            )
    path = solved.select("run", "path")
    split = join_sized(open_, path, ["run"], "inner", row_bytes=400).select(
        "text",
        F.explode(
            F.transform("parts", lambda p, i: F.struct(
                p["i"].alias("i"), p["atom"].alias("atom"), F.element_at("path", i + 1).alias("begins"))),
        ).alias("p"),
    ).select("text", "p.i", "p.atom", "p.begins")
    pieces = split.unionByName(
        settled.select("text", F.col("parts")[0]["i"].alias("i"), F.col("parts")[0]["atom"].alias("atom"), F.lit(1).alias("begins"))
    )
    # one array of values per distinct text: an atom that begins no value is glued to the last one
    solved_texts = (
        pieces.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("i", "atom", "begins"))).alias("p"))
        .select("text", F.aggregate(
            "p", F.array().cast("array<string>"),
            lambda acc, x: F.when(x["begins"] == 1, F.concat(acc, F.array(x["atom"]))).otherwise(
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x["atom"])))
            ),
        ).alias("items"))
    )
    solved_texts = cut(solved_texts)
    return (
        join_sized(rows, solved_texts, ["text"], "inner", row_bytes=800)
        .select("key", F.posexplode("items").alias("p", "item"), F.size("items").alias("n_items"))
        .select(F.col("key").alias(key), (F.col("p") + 1).cast("int").alias("pos"), "item", "n_items")
    )
