"""Problem 8: mixing sources to target weights.

Targets are propagated down a tree of domain, language and source. A leaf can give at most its
tokens times the source's repeats; what it lacks goes to siblings under the same language
first, then to the domain, then to all. Each leaf's documents are put in a seeded order anew
in every epoch, and the prefix of that order whose tokens come nearest to the budget is taken.

No leaf is rounded alone: of every leaf the documents that fit its budget whole are taken, and
the one document at each leaf's edge is added while that brings its source nearer to the sum of
its leaves' budgets. So a source misses its budget by less than one document.

Without a budget the total is the largest at which every source that can give something reaches
its share exactly; with one, or with AVAILABLE (all tokens there are), what a source can't give
goes to others. Domains are given by a table; a source it lacks is a domain of its own. Sources without a target, null sources, and documents without tokens are left
out of the mix and reported with no share. Repeated doc_ids are separate records in one place
of the order; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encode import TOKENIZER, count_column
from paperloom.runtime import cut, join_sized

#: Most leaves of the tree; their budgets are settled in one place.
MOST_LEAVES = 100_000
#: Documents in a bucket of a leaf's order; only the bucket in which the budget ends is ordered by row. Most buckets, in bits.
IN_BUCKET, BUCKET_BITS = 2000, 24
#: Budget of as many tokens as the sources with a target have.
AVAILABLE = -1.0


def settle(leaves: list[dict], total: float) -> None:
    """Give each leaf its ``budget``: weight of the total, at most its capacity, shortages first to siblings.

    ``leaves`` have path (domain, language, source), weight and capacity.
    """
    def free(group: list[dict]) -> float:
        return sum(max(0.0, x["capacity"] - x["budget"]) for x in group)

    def share(group: list[dict], amount: float) -> float:
        """Spread amount over leaves with room in proportion to their weights; return what is left."""
        while amount > 1e-9:
            room = [x for x in group if x["capacity"] - x["budget"] > 1e-9 and x["weight"] > 0]
            weight = sum(x["weight"] for x in room)
            if not room:
                break
            given = 0.0
            for x in room:
                part = min(amount * x["weight"] / weight, x["capacity"] - x["budget"])
                x["budget"] += part
                given += part
            if given <= 1e-9:
                break
            amount -= given
        return max(0.0, amount)

    for x in leaves:
        x["budget"] = min(total * x["weight"], x["capacity"])
        x["lack"] = total * x["weight"] - x["budget"]
    for depth in (2, 1, 0):
        groups: dict[tuple, list[dict]] = {}
        for x in leaves:
            groups.setdefault(x["path"][:depth], []).append(x)
        for group in groups.values():
            rest = share(group, sum(x["lack"] for x in group))
            for x in group:
                x["lack"] = 0.0
            group[0]["lack"] = rest


def plan(sizes: list[tuple], weights: dict[str, tuple[float, int]], budget: float | None, domains: dict[str, str] | None = None) -> list[dict]:
    """Leaves with budgets from (source, lang, tokens), source -> (share, repeats) and source -> domain."""
    domains = domains or {}
    tokens: dict[str, int] = {}
    for source, _, n in sizes:
        tokens[source] = tokens.get(source, 0) + n
    leaves = [
        {"path": (domains.get(s, s), lang, s), "source": s, "lang": lang, "tokens": n, "repeats": weights[s][1],
         "weight": weights[s][0] * n / tokens[s], "capacity": float(n * weights[s][1])}
        for s, lang, n in sorted(sizes, key=lambda x: (x[0], x[1])) if s in weights and n > 0
    ]
    present = sum(x["weight"] for x in leaves)
    if not leaves or present <= 0:
        return []
    for x in leaves:
        x["weight"] /= present
    reach: dict[str, list[float]] = {}
    for x in leaves:
        a = reach.setdefault(x["source"], [0.0, 0.0])
        a[0] += x["weight"]
        a[1] += x["capacity"]
    if budget is None:
        total = min((c / w for w, c in reach.values() if w > 0 and c > 0), default=0.0)
    else:
        total = float(sum(x["tokens"] for x in leaves)) if budget == AVAILABLE else budget
    settle(leaves, total)
    return leaves


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of each document, labels of languages folded."""
    return documents.select(
        "doc_id", "source", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), count_column("text", path).alias("n_tokens"))


def edges_taken(edges: list[dict]) -> list[dict]:
    """The edge documents that bring their source nearer to its budget, those that their leaf lacks most first.

    ``edges`` has one row for each leaf and epoch that ends inside a document: its source, lang, epoch,
    budget, the tokens of the whole documents below it, and the document's n_tokens.
    """
    chosen = []
    open_: dict[str, list[dict]] = {}
    for e in edges:
        open_.setdefault(e["source"], []).append(e)
    for source, some in open_.items():
        lack = sum(e["budget"] - e["below"] for e in some)
        for e in sorted(some, key=lambda e: (-(e["budget"] - e["below"]) / e["n_tokens"], e["lang"], e["epoch"])):
            if abs(lack - e["n_tokens"]) < abs(lack):
                lack -= e["n_tokens"]
                chosen.append(e)
    return chosen


def _held(df: DataFrame, columns: list[str], what: str) -> list:
    """Rows of a table that must be small; larger ones are refused, none is left out."""
    rows = df.select(columns).limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} {what}")
    return rows


def mix(
    documents: DataFrame, weights: DataFrame, budget: float | None = None, seed: int = 17, path: str = TOKENIZER, domains: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): (doc_id, source, epoch, n_tokens), and per source target and actual share.

    ``weights`` has source, target_share and max_repeats, ``domains`` source and domain.
    """
    spark = documents.sparkSession
    docs = cut(sized(documents, path))
    known = weights.select("source", "target_share", "max_repeats").where("source IS NOT NULL")
    by_leaf = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    table = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in _held(known, known.columns, "weights")}
    sizes = _held(by_leaf.join(known.select("source"), "source"), by_leaf.columns, "leaves")
    named = {r["source"]: r["domain"] for r in _held(domains, ["source", "domain"], "domains") if r["domain"] is not None} if domains is not None else {}
    leaves = plan([(r["source"], r["lang"], int(r["n"] or 0)) for r in sizes], table, budget, named)
    buckets_of = {(r["source"], r["lang"]): min(1 << BUCKET_BITS, r["docs"] // IN_BUCKET + 1) for r in sizes}
    rows = [
        (x["source"], x["lang"], e, float(min(x["tokens"], x["budget"] - e * x["tokens"])), bool(x["budget"] - e * x["tokens"] >= x["tokens"]),
         buckets_of[x["source"], x["lang"]])
        for x in leaves for e in range(x["repeats"]) if x["budget"] - e * x["tokens"] > 0.5
    ]
    epochs = spark.createDataFrame(rows, "source string, lang string, epoch int, budget double, whole boolean, buckets long")
    drawn = docs.where("n_tokens > 0").join(F.broadcast(epochs), ["source", "lang"])  # at most MOST_LEAVES * repeats rows
    full = drawn.where("whole")
    part = drawn.where("NOT whole").withColumn("draw", F.xxhash64(F.lit(seed), "epoch", "doc_id")).withColumn(
        "bucket", F.shiftright(F.shiftrightunsigned("draw", 64 - BUCKET_BITS) * F.col("buckets"), BUCKET_BITS))
    leaf = ["source", "lang", "epoch"]
    so_far = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut(
        part.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("t"))
        .withColumn("before", F.coalesce(F.sum("t").over(so_far), F.lit(0)))
    )
    placed = join_sized(part, buckets, [*leaf, "bucket"], "inner", row_bytes=80)
    inside = placed.where("before + t <= budget")
    order = Window.partitionBy(*leaf, "bucket").orderBy("rank", "doc_id", "n_tokens")
    edge = placed.where("before < budget AND before + t > budget").withColumn("rank", F.shiftrightunsigned("draw", 1))
    edge = edge.withColumns({
        "at": F.col("before") + F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "place": F.row_number().over(order)})
    edge = cut(edge)  # one bucket of each leaf
    over = edge.where("at <= budget AND at + n_tokens > budget").groupBy(*leaf).agg(
        F.min_by(F.struct("bucket", "place", "at", "n_tokens", "budget"), F.struct("bucket", "place")).alias("e"))
    found = [{"source": r["source"], "lang": r["lang"], "epoch": r["epoch"], "below": r["e"]["at"], **r["e"].asDict()} for r in over.collect()]  # one row a leaf
    more = spark.createDataFrame(
        [(e["source"], e["lang"], e["epoch"], e["bucket"], e["place"]) for e in edges_taken(found)], "source string, lang string, epoch int, bucket long, place int")
    fits = edge.where("at + n_tokens <= budget")
    added = edge.join(F.broadcast(more), [*leaf, "bucket", "place"], "left_semi")  # one row a leaf
    edge = fits.unionByName(added)
    columns = ["doc_id", "source", "epoch", "n_tokens"]
    selection = cut(full.select(columns).unionByName(inside.select(columns)).unionByName(edge.select(columns)))
    taken = selection.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_docs"), (F.max("epoch") + 1).alias("epochs"))
    total = taken.agg(F.sum("mix_tokens").alias("all_tokens"))
    shares = (
        docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
        .join(F.broadcast(known), "source", "full").join(taken, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select(
            "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("mix_docs", F.lit(0)).alias("mix_docs"),
            F.coalesce("epochs", F.lit(0)).alias("epochs"),
            F.when(F.col("target_share").isNotNull(), F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0))).alias("actual_share"))
    )
    return selection, shares
