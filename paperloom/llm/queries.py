"""Queries of the training-data operators. None has SQL: their tests compare them with brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import canon, encode, match_list, mix, pages, parties, survivor, truncation
from paperloom.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parties.linked_spellings(table(spark, d, "invoice_records"))


def p2_parties(spark: SparkSession, d: str) -> DataFrame:
    """Each party with the number of its spellings and of their distinct folded forms."""
    return parties.parties(table(spark, d, "invoice_records")).groupBy("party").agg(
        F.count(F.lit(1)).alias("n_spellings"), F.count_distinct("name").alias("n_names"), F.min("raw").alias("example"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.noise(table(spark, d, "ocr_lines"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.paragraphs(table(spark, d, "ocr_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "invoice_records")).select("first_row_id", "invoice_no", "total_amount")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "invoice_records"))


def _p5_values(spark: SparkSession, d: str) -> DataFrame:
    return canon.fields(table(spark, d, "invoice_records"), "invoice_records", "row_id", ["buyer_tax", "seller_name"]).unionByName(
        canon.fields(table(spark, d, "ocr_lines"), "ocr_lines", "line_id", ["text"]))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.find_disguised(_p5_values(spark, d))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canon.normalised(_p5_values(spark, d)).select("table_name", "key_id", "field_name", "canonical", "folded")


def _p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Both fields with the step that decided; scans of one invoice (number and day) teach the aliases."""
    records = table(spark, d, "invoice_records")
    no, day = survivor.digits_of(F.col("invoice_no")), F.regexp_replace("invoice_date", "[/.]", "-")
    same = F.when(F.length(no).isin(8, 20) & (F.length(day) > 0), F.xxhash64(no, day))
    return match_list.map_to_list(records, "row_id", "invoice_type", table(spark, d, "invoice_type_ref"), same=same).unionByName(
        match_list.map_to_list(records, "row_id", "category", table(spark, d, "category_ref"), same=same))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_mapped(spark, d).select("row_id", "field_name", "ref_id")


def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """Rows decided by each step of the operator."""
    return _p6_mapped(spark, d).groupBy("field_name", "step").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    long = canon.fields(table(spark, d, "invoice_records"), "invoice_records", "row_id", ["invoice_type", "category"])
    missed = p6_found(spark, d).where("ref_id = -1").select(F.col("row_id").cast("bigint").alias("key_id"), "field_name")
    return long.join(missed, ["key_id", "field_name"]).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not decode to their text: none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("back", encode.text_column(encode.ids_column("text"))).where("back <> text").select("doc_id")


#: Domains of this project's sources; the rest are domains of their own.
DOMAINS = {
    "contract_scan": "agreements", "release_notes": "reference", "glossary": "reference", "meeting_minutes": "reference",
    "mail_export": "messages", "helpdesk": "messages", "mobile_note": "messages", "feedback_form": "messages",
}


def _p8(spark: SparkSession, d: str, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    domains = spark.createDataFrame(list(DOMAINS.items()), "source string, domain string")
    return mix.mix(table(spark, d, "documents"), table(spark, d, "source_weights"), budget, domains=domains)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)[1]


def p8_budget_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix of as many tokens as there are: small sources fall short, and their siblings give more."""
    return _p8(spark, d, mix.AVAILABLE)[0]


def p8_budget_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d, mix.AVAILABLE)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "documents"))


def p9_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cut documents by what told them, whole ones as null."""
    return truncation.judge(table(spark, d, "documents")).groupBy("evidence").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p2_found, p2_parties, p3_found, p3_paragraphs, p4_found, p4_survivors, p5_found, p5_canonical,
        p6_found, p6_steps, p6_unmatched, p7_ids, p7_round_trip, p8_mix, p8_shares, p8_budget_mix, p8_budget_shares, p9_found, p9_rates, p9_evidence,
    )
}
ORACLE: dict[str, str] = {}
