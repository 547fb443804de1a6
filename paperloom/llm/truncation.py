"""Problem 9: texts that end before their author's end.

Self-join by prefix: distinct values are sorted across the cluster, where a strict prefix of
longer copies stands directly before one of them. Values are whole texts and, as most cut
texts have no longer copy, also the last unfinished sentence of each text among the sentences
of all texts (digits masked). Whole texts can be prefixes of others by chance, and sentences
with names have no copy, so the join is completed by counts over the whole corpus: endings
seen before a stop, closing lines seen at the end of other texts, and lengths at which a
source piles up (a field limit). A text is cut if nothing shows its end to be complete, or if
a longer copy shows that a known ending, a stop or a file name isn't its end:

* its last sentence never stops there, goes on in a sentence that stops later, and not by a
  mere appendix (a continuation that several complete sentences take);
* the longer text goes on inside the same token ("list.xlsx" after "list.");
* the longer text shares a sentence that hardly any other has, so it is no copy by chance.

Values of any length are compared; a prefix shorter than PREFIX supports an open end but
overrules none that looks complete, as short ones are prefixes by chance. Dots at the end are
the author's own unless texts that end with dots pile up at that very length of the source:
then the field put them there.

Null, empty and blank texts are whole. Repeated texts are judged once and reported for every
row. Ties don't matter: no order among rows is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.runtime import cut, free, join_sized

#: Least copies that make an ending or a closing line known, and their least share of the texts.
LEAST_ENDS, ENDS_SHARE = 2, 2e-5
LEAST_CLOSINGS, CLOSINGS_SHARE = 3, 1e-4
#: A length is a field limit if so many different texts of a source have it, such a share, and so many times more than others nearby.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_TIMES, NEARBY = 8, 0.005, 8.0, 25
#: Characters of an ending, Latin and ideographic; longest closing line; shortest prefix that overrules an end that looks complete.
LATIN, HAN, CLOSING, PREFIX = 10, 5, 60, 20
#: Characters kept of a continuation; complete sentences that make it an appendix; most texts that share a telling sentence.
REST, APPENDIX, TELLING = 60, 2, 2

_BREAK = re.compile(r"[。！？!?…]+|\.(?=\s|$)|\n")
_STOP = re.compile(r"(?:[。！？!?…]|\.)[\"”’»）)」』]*$")
_DOTS = r"(\.\.\.|…)\s*$"
_ROW = re.compile(r"\|.*\|$")
_FILE = re.compile(r"[^\s/]\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|md|rtf|od[tsp]|png|jpe?g|tiff?|gif|zip|7z|rar|eml|html?)$", re.I)
_SIGN = re.compile(r"[\U0001f000-\U0001faff☀-➿️‍]$")

FORM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("body", "tail", "closing", "fragment")]
    + [T.StructField("stopped", T.BooleanType()), T.StructField("layout", T.BooleanType()), T.StructField("broken", T.BooleanType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("ends", "sentences")]
)


def ending(text: str) -> str:
    text = text.rstrip()
    return text[-LATIN:] if text and text[-1] < "⺀" else text[-HAN:]


def anatomy(text: str | None) -> dict:
    """What the judgement needs of one text; digits are masked in all but the body."""
    body = re.sub(r"\r\n?", "\n", text or "").rstrip()
    broken = body.endswith("�")
    masked = re.sub(r"\d", "0", body)
    ends, sentences, start = set(), set(), 0
    for m in _BREAK.finditer(masked):
        sentence = masked[start : m.start()].strip()
        if sentence and m.end() < len(masked):
            ends.add(ending(masked[: m.start()]))
            sentences.add(sentence)
        start = m.end()
    lines = masked.rsplit("\n", 1)
    last = lines[-1].strip()
    return {
        "body": body.rstrip("�"), "tail": ending(masked), "closing": last if len(lines) == 2 and len(last) <= CLOSING else None,
        "fragment": masked[start:].strip("� \n\t"), "stopped": not masked or bool(_STOP.search(masked) or _SIGN.search(masked)),
        "layout": bool(_ROW.match(last) or _FILE.search(last)), "broken": broken,
        "ends": sorted(ends), "sentences": sorted(sentences),
    }


def _anatomies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([anatomy(t if isinstance(t, str) else None) for t in texts], columns=FORM.names, index=texts.index)


_anatomies.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def continuations(values: DataFrame) -> DataFrame:
    """(v, whole, rest): how values of (v, whole) go on in longer ones, told where they do.

    ``rest`` is the continuation in the nearest longer value that is whole, null if only values
    that are not whole are longer. Values that begin with v stand directly behind it, so if any
    whole one does, the next whole one in order does. One sort, from the end, in which equal
    values meet and count once, as whole if one of them is; between partitions the first value
    and first whole value of each are compared.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.where(F.length("v") > 0).select("v", "whole").repartitionByRange(parts, "v").sortWithinPartitions(F.desc("v"), F.desc("whole"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, after, after_whole = TaskContext.get().partitionId(), None, None
        names = ["v", "whole", "rest", "begun", "part", "kind"]
        for batch in batches:
            out = []
            for v, whole in zip(batch["v"], batch["whole"]):
                if v == after:
                    continue  # repeated
                begun = after is not None and after.startswith(v)
                if after_whole is not None and after_whole.startswith(v):
                    out.append((v, whole, after_whole[len(v) : len(v) + REST], True, part, 0))
                elif after_whole is None and (after is None or begun):
                    out.append((v, whole, None, begun, part, 1))  # may go on in the next partition
                elif begun:
                    out.append((v, whole, None, True, part, 0))
                after = v
                after_whole = v if whole else after_whole
            if out:
                yield pd.DataFrame(out, columns=names)
        if after is not None:
            yield pd.DataFrame([(after, after_whole is not None, after_whole, False, part, 2)], columns=names)

    told = cut(ordered.mapInPandas(run, "v string, whole boolean, rest string, begun boolean, part int, kind int"))
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # as many rows as partitions
    edges = told.where("kind = 2").select("part", F.first("v").over(later).alias("next"), F.first("rest", ignorenulls=True).over(later).alias("next_whole"))
    open_ = told.where("kind = 1").join(F.broadcast(edges), "part", "left")
    starts = lambda c: F.coalesce(F.col(c).startswith(F.col("v")), F.lit(False))
    open_ = open_.withColumn("rest", F.when(starts("next_whole"), F.substr("next_whole", F.length("v") + 1, F.lit(REST))))
    open_ = open_.where(F.col("begun") | starts("next") | F.col("rest").isNotNull())
    return told.where("kind = 0").select("v", "whole", "rest").unionByName(open_.select("v", "whole", "rest"))


def goes_on(body: str, rest: str) -> str | None:
    """Where a longer copy goes on: "inside" a token of the body, with an "added" file name or row only, or "behind" it."""
    latin = lambda c: c.isalnum() and c < "⺀"
    if latin(rest[:1] or " ") and (latin(body[-1]) or (body[-1] == "." and latin(body[-2:-1] or " "))):
        return "inside"
    line = rest.strip()
    return "added" if len(rest) < REST and "\n" not in line and (_ROW.match(line) or _FILE.search(line)) else "behind"


def _goes_on(bodies: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, rest in bodies:
        yield pd.Series([goes_on(b, r) for b, r in zip(body, rest)], index=body.index, dtype=object)


_goes_on.__annotations__ = {"bodies": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, evidence): evidence is null for whole texts, else what speaks for a cut.

    "prefix": the text or its last sentence is a strict prefix of longer ones, whatever its end
    looks like if the longer one tells (see above); "limit": it has
    the length of a field limit of its source; "broken": it ends inside a character; "open":
    its end is unlike any complete one.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    forms = F.pandas_udf(_anatomies, FORM)
    blank_text = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    full = rows.where(~blank_text)
    texts = cut(full.select("text").distinct().withColumn("id", F.xxhash64("text")).withColumn("form", forms("text")).select("id", "form.*", F.xxhash64("form.body").alias("body_id"), F.xxhash64("form.fragment").alias("fragment_id")))
    n = texts.count()
    known_ends = cut(
        texts.select(F.explode("ends").alias("tail")).groupBy("tail").count()
        .where(F.col("count") >= max(LEAST_ENDS, n * ENDS_SHARE)).select("tail", F.lit(True).alias("ended"))
    )
    known_closings = cut(
        texts.where("closing IS NOT NULL").groupBy("closing").count()
        .where(F.col("count") >= max(LEAST_CLOSINGS, n * CLOSINGS_SHARE)).select("closing", F.lit(True).alias("closed"))
    )
    on = F.pandas_udf(_goes_on, T.StringType())
    copies = cut(continuations(texts.select(F.col("body").alias("v"), F.lit(True).alias("whole"))).select(F.xxhash64("v").alias("body_id"), on("v", "rest").alias("on")))
    sentences = texts.select("id", F.explode("sentences").alias("s"))
    # copies that are none by chance: a sentence of them is in hardly any other text
    doubted = texts.select("body_id", "id", "sentences").join(copies.where("on = 'behind'"), "body_id").select("id", F.explode("sentences").alias("s"))
    rare = sentences.join(doubted.select("s").distinct(), "s", "left_semi").groupBy("s").count().where(F.col("count") <= TELLING)
    telling = cut(doubted.join(rare, "s").select("id").distinct().withColumn("telling", F.lit(True)))
    begun = cut(continuations(texts.select(F.col("fragment").alias("v"), F.lit(False).alias("whole")).unionByName(sentences.select(F.col("s").alias("v"), F.lit(True).alias("whole")))
        .groupBy("v").agg(F.max("whole").alias("whole"))))  # sentences repeat often
    appendices = begun.where("whole AND rest IS NOT NULL").groupBy("rest").count().where(F.col("count") >= APPENDIX).select("rest", F.lit(True).alias("appendix"))
    fragments = begun.join(appendices, "rest", "left").select(
        F.xxhash64("v").alias("fragment_id"), F.lit(True).alias("begun"),
        (~F.col("whole") & (F.length("v") >= PREFIX) & F.col("rest").isNotNull() & F.col("appendix").isNull()).alias("unfinished"))  # values are told by their hash from here on
    dotted = F.col("text").rlike(_DOTS)
    # lengths at which texts pile up, and those at which texts that end with dots do: dots that the field put there
    sizes = full.select("source", F.xxhash64("text").alias("id"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), dotted.alias("dotted")).distinct()
    sizes = sizes.withColumn("n", F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")),
        F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")),
        F.struct(F.lit("dots").alias("unit"), F.when(F.col("dotted"), F.col("chars")).alias("n"))))).select("source", "n.*").where("n IS NOT NULL")
    near = Window.partitionBy("source", "unit").orderBy("n").rangeBetween(-NEARBY, NEARBY)
    limits = (
        sizes.groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("others", (F.sum("c").over(near) - F.col("c")) / (2 * NEARBY))
        .withColumn("all", F.sum("c").over(Window.partitionBy("source", "unit")))
        .where((F.col("c") >= LIMIT_TEXTS) & (F.col("c") >= LIMIT_SHARE * F.col("all")) & (F.col("c") >= LIMIT_TIMES * (F.col("others") + 0.25)))
    )
    limits = cut(limits.select(F.coalesce("source", F.lit("")).alias("src"), "unit", "n"))
    by_chars = limits.where("unit = 'chars'").select("src", F.col("n").alias("chars"), F.lit(True).alias("at_chars"))
    by_dots = limits.where("unit = 'dots'").select("src", F.col("n").alias("chars"), F.lit(True).alias("dotted"), F.lit(True).alias("at_dots"))
    by_bytes = limits.where("unit = 'bytes'").select("src", F.col("n").alias("bytes"), F.lit(True).alias("at_bytes"))
    judged = texts.select("id", "tail", "closing", "stopped", "layout", "broken", "body_id", "fragment_id", (F.length("body") >= PREFIX).alias("long"), (F.length("fragment") > 0).alias("open"))
    judged = join_sized(judged, known_ends, ["tail"], "left")
    judged = join_sized(judged, known_closings, ["closing"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    judged = judged.withColumn("settled", F.col("stopped") | F.col("layout") | no("closed"))
    judged = join_sized(judged.join(copies, "body_id", "left"), telling, ["id"], "left", row_bytes=64)
    # texts that end with a stop share the empty fragment, which has no copy
    flags = ["id", "broken", "settled", no("ended").alias("ended"), F.col("on").isNotNull().alias("copied"), (F.col("long") & (F.coalesce(F.col("on") == "inside", F.lit(False)) | no("telling"))).alias("longer")]
    some = judged.where("open").join(fragments, "fragment_id", "left").select(*flags, no("begun").alias("begun"), no("unfinished").alias("unfinished"))
    none = judged.where("NOT open").select(*flags, F.lit(False).alias("begun"), F.lit(False).alias("unfinished"))
    judged = cut(some.unionByName(none).select(
        "id", "broken", "settled", "ended", (F.col("longer") | F.col("unfinished")).alias("longer"), (F.col("copied") | F.col("begun")).alias("prefix")))
    free(texts, known_ends, known_closings, copies, telling, begun)
    out = full.withColumn("id", F.xxhash64("text")).withColumn("src", F.coalesce("source", F.lit(""))).withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text")).withColumn("dotted", dotted)
    out = join_sized(out, by_dots, ["src", "chars", "dotted"], "left", row_bytes=64)
    out = join_sized(out, by_chars, ["src", "chars"], "left", row_bytes=64)
    out = join_sized(out, by_bytes, ["src", "bytes"], "left", row_bytes=64)
    out = join_sized(out.select("key", "source", "id", no("at_dots").alias("dots"), (no("at_chars") | no("at_bytes")).alias("limit")), judged, ["id"], "left", row_bytes=64)
    evidence = (
        F.when(F.col("broken"), "broken").when(F.col("longer"), "prefix").when(F.col("dots"), "limit").when(F.col("settled"), None).when(F.col("limit"), "limit")
        .when(F.col("ended"), None).when(F.col("prefix"), "prefix").otherwise("open")
    )
    blank = rows.where(blank_text).select("key", "source", F.lit(None).cast("string").alias("evidence"))
    return out.select("key", "source", evidence.alias("evidence")).unionByName(blank).withColumnsRenamed({"key": key, "source": source})


def cut_texts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return judge(documents, key).where("evidence IS NOT NULL").select(key)


def cut_rates(documents: DataFrame) -> DataFrame:
    """How often each source cuts; a null source is a group of its own."""
    return judge(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("evidence").alias("n_cut"),
        (F.count("evidence") / F.count(F.lit(1))).alias("rate"))
