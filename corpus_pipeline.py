"""Corpus pipeline: quality, near duplicates, repeated sentences, benchmark leaks, packing.

Each stage takes the documents that its predecessor kept (columns of
``documents``) and returns the ones it keeps, whole; the last returns the
packed pieces. A stage is written as Parquet and reread as the next one's
``docs``. SQL cannot express the stages; their tests hold them against
brute-force versions.

Null texts are empty to the classifier, linked with nothing, unchanged by
sentence removal, leak nothing and pack as their end id; empty tables pass
through; extra columns are kept until packing. Near duplicates and leaks are
told by row, not by id: a row's key is its id (null last) and its text's SHA-256.
Rows equal in both are copies of each other; one survives (of the least hash of
all columns but maps), or all if they hold no word. Only in sentence removal rows
with equal ids count as one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.llm.decontamination import find_leaks
from fieldlark.llm.near_dedup import near_duplicates
from fieldlark.llm.packing import pack_documents
from fieldlark.llm.quality import fit_quality, score_quality
from fieldlark.llm.span_dedup import remove_repeats
from fieldlark.session import Steps, checkpoint_dir, delete_path, ship_package

def _prepare(spark: SparkSession, docs: DataFrame) -> DataFrame:
    checkpoint_dir(ship_package(spark))
    return docs


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with a key per row that orders by id, and four names that docs does not use, the key's first."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("row_key", "other_key", "row_kept", "row_place"):
        while name in taken:
            name += "_"
        names.append(name)
    empty = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", empty).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    return docs.withColumn(names[0], key), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    docs = _prepare(spark, docs)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, threshold=0.3, keep_columns=True).where("predicted = 1").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8)."""
    docs = _prepare(spark, docs)
    keyed, (key, other, kept, place) = _keyed(docs)
    found = near_duplicates(keyed, id_col=key, shingle=5, threshold=80).groupBy(F.col(key).alias(other)).agg(F.max("kept").alias(kept), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
    found = Steps(spark).put("found", found.where(~F.col(kept) | (F.col("n") > 1) & (F.col("size") > 0)).select(other, kept))
    alone = keyed.join(found, F.col(key) == F.col(other), "left_anti")
    order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    equal = keyed.join(found.where(kept), F.col(key) == F.col(other), "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(place) == 1)
    return alone.select(docs.columns).unionByName(equal.select(docs.columns))


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated sentence runs, n_chars as of the new text."""
    docs = _prepare(spark, docs)
    out = remove_repeats(docs, keep_columns=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    docs = _prepare(spark, docs)
    keyed, (key, other, *_) = _keyed(docs)
    leaks = find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(F.col(key).alias(other)).distinct()
    return keyed.join(leaks, F.col(key) == F.col(other), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    docs = _prepare(spark, docs)
    return pack_documents(docs, window=2048).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``.

    What a stage keeps is written to the shared checkpoint folder and removed
    once the next stage is written; the last one stays for the rows returned.
    """
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_path(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
