"""Order-dependent folds inside one document: chunking, overlap of parts, greedy matching.

No built-in expresses them: each step depends on what the steps before kept. They run per
document as Arrow functions.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk; lines compared at a seam, and their least likeness.
CHUNK, SEAM_LINES, SEAM = 400, 4, 0.85


def pack_lines(text: str | None, size: int) -> list[str]:
    """Lines joined greedily to chunks of at most ``size``; a longer line is a chunk of its own."""
    if text is None:
        return []
    if len(text) <= size:
        return [text]
    out, now = [], None
    for line in text.split("\n"):
        if now and len(now) + len(line) + 1 > size:
            out.append(now)
            now = line
        else:
            now = f"{now}\n{line}" if now else line
    return out + [now] if now else out


def line_chunks(docs: DataFrame, key: str, text: str = "text", size: int = CHUNK) -> DataFrame:
    """(key, chunk_no, chunk); a null text has no chunk, an empty one an empty chunk."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack_lines(t, size))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.pandas_udf(run, T.ArrayType(T.StringType()))(text)).alias("chunk_no", "chunk"))


def seamless(parts: list[str]) -> list[str]:
    """Lines of overlapping parts, repeated lines at the seams once."""
    kept: list[str] = []
    for i, part in enumerate(parts):
        lines = [x for x in (part or "").split("\n") if x.strip()]
        skip = 0
        if i:
            for n in range(min(SEAM_LINES, len(kept), len(lines)), 0, -1):
                if SequenceMatcher(None, "".join(kept[-n:]), "".join(lines[:n])).ratio() > SEAM:
                    skip = n
                    break
        kept += lines[skip:]
    return kept


def drop_overlap(parts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, n_lines, text) of the parts of each document joined without repeated seams."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: "\n".join(seamless(list(p))))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    packed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("p"))
    joined = packed.select(key, F.pandas_udf(run, T.StringType())("p.t").alias("text"))
    return joined.select(key, F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), "text")


def greedy(scores: list) -> list[dict]:
    """Each a in order takes the best unused b with a positive score; the first of equal ones."""
    used, out = set(), []
    for a in sorted({x["a"] for x in scores}):
        best = None
        for x in sorted((x for x in scores if x["a"] == a), key=lambda x: x["b"]):
            if x["b"] not in used and x["score"] > (best["score"] if best else 0.0):
                best = x
        if best:
            used.add(best["b"])
        out.append({"a": a, "b": best["b"] if best else None, "score": best["score"] if best else 0.0})
    return out


def greedy_match(scores: DataFrame, key: str) -> DataFrame:
    """(key, a, b, score) from all scores (key, a, b, score) of the tables of one document."""
    kind = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("score", T.DoubleType())]))

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: greedy(list(x)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    packed = scores.groupBy(key).agg(F.collect_list(F.struct("a", "b", "score")).alias("p"))
    return packed.select(key, F.explode(F.pandas_udf(run, kind)("p")).alias("m")).select(key, "m.*")
