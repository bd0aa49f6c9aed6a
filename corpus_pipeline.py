"""Corpus pipeline: from raw documents to packed token sequences.

Each stage calls one operator on all rows that the stage before kept, is written as
Parquet in the shared folder and read again.  All but the last return the columns of
``documents``.  Null texts count as empty and pass the filters; rows with a null id are
told apart by their text.  SQL cannot express the stages (learned scores, bit-distance
components, a genetic search), so tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from respan.llm import decontamination, packing, pii, simhash, toxicity
from respan.llm.util import crc_mod, stored, table, tokenizer_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject; it learns from the
    labels of documents whose crc32(doc_id) modulo 5 is not 0."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each SimHash group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other slot values."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_filter), ("simhash", near_duplicates), ("decontamination", decontaminate),
          ("pii", redact), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        df = stored(stage(spark, df, sf_dir), f"pipeline-{name}")
    return df


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
