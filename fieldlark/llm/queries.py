"""The registered query of each operator: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.session import checkpoint_dir, ship_package

from . import filter_audit, line_dedup, url_filters


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    checkpoint_dir(ship_package(spark))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints_and_edits

    return fingerprints_and_edits(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), window=2048).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in list against all pages, each fetched on a day given by its id."""
    from .url_filters import capture_day, filter_urls, list_entries

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages.withColumn("fetched_on", capture_day(F.col("page_id"))), list_entries(spark))
    return judged.select("page_id", "url", F.col("fetched_on").cast("string").alias("fetched_on"), "host", "decision", "category", "rule")


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = _read(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")), threshold=0.3)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, threshold=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")), threshold=0.5)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard sizes differ by one row at most."""
    from .sharding import shard_rows

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shard_rows(docs, shards=8).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), limit=2048)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts of which a tenth are given a periodic end."""
    from .periodic_runs import periodic_runs, plant_periods, run_digests

    return run_digests(periodic_runs(plant_periods(_read(spark, sf_dir, "documents"))))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_span_dedup": op4_span_dedup,
    "op6_decontamination": op6_decontamination,
    "op5_quality": op5_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {"op3_url_filters": url_filters.oracle(), "op11_filter_audit": filter_audit.SQL, "op13_line_dedup": line_dedup.SQL}
