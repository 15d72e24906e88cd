"""A training corpus from ``documents``: language ID, near-duplicates,
benchmark decontamination, personal data, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet in the shared folder and read again as the next stage's documents, so
a stage's failure costs that stage alone.  All stages but the last return the
columns of documents, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carrylens.llm.common import table, written
from carrylens.llm.op2_packing import pack_documents
from carrylens.llm.op3_minhash import near_duplicates
from carrylens.llm.op6_personal import personal_data, redact
from carrylens.llm.op7_decontaminate import decontaminate
from carrylens.llm.op8_language import WORST_RATE, identify


def _row_id():
    """What operators call a row by, besides its doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: not ``und``, and coded by the best
    language's tree in fewer bits a byte than plain bytes take."""
    # the operator's own columns get names that documents can't clash with
    slim = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    named = identify(slim, docs)
    return named.filter((F.col("lang_pred") != "und") & (F.col("bits_a_byte") < WORST_RATE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near-duplicates, once."""
    keep = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    order = W.partitionBy("doc_id").orderBy(F.col("text"))
    first = kept.select(F.struct("*").alias("row"), F.row_number().over(order).alias("place")).filter("place = 1").select("row.*")
    return first.unionByName(docs.filter("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark window."""
    hits = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0)
    hits = written(hits.select(F.col("doc_id").alias("h_doc"), F.col("row_id").alias("h_row")).distinct(), "contaminated")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["h_doc"]) & (_row_id() == hits["h_row"]), "left_anti")


def personal_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    spans = personal_data(docs).filter(F.size("spans") > 0)
    spans = written(spans.select(F.col("doc_id").alias("h_doc"), F.col("row_id").alias("h_row"), F.col("spans").alias("h_spans")).dropDuplicates(["h_doc", "h_row"]), "personal")
    # the row travels as one column, so none of its names can clash
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d_doc"), _row_id().alias("d_row"))
    rows = whole.join(spans, F.col("d_doc").eqNullSafe(F.col("h_doc")) & (F.col("d_row") == F.col("h_row")), "left")
    text = F.when(F.col("h_spans").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("h_spans")))
    put = {"text": text}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("h_spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(put[c].alias(c) if c in put else F.col("row")[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data_redaction),
    ("packing", packing),
]

#: Signatures, an FM-index and a tokenizer aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
