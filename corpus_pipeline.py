"""A corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes the documents that the one before kept, and all but the last return the columns of documents;
n_chars follows the text.

Rows: a null text fails the quality rules, and so do empty and short ones; very long texts pass whole through every stage; a verdict holds for
its row alone, whatever doc_ids are null or repeat; of rows that repeat one stays; of a group of near-duplicates the smallest doc_id stays,
nulls last, and of ties the first row; an empty table gives an empty result; extra columns pass all stages but the
last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm.near_copies import first_rows
from verbaspark.llm.op2_chunks import dedup, unused
from verbaspark.llm.op5_divergence import kept_rows
from verbaspark.llm.op6_hilbert import pack
from verbaspark.llm.op8_secrets import redact
from verbaspark.runtime import materialize, shared_dir


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row, by which verdicts come back: doc_id may be null or repeat."""
    return materialize(docs.withColumn(unused("row", docs.columns), F.monotonically_increasing_id()), "rows")


def _kept(rows: DataFrame, row: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose number ``kept`` holds; the side to hash has eight bytes a document."""
    return rows.join(kept.withColumnRenamed(kept.columns[0], row).hint("shuffle_hash"), row, "left_semi").select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go; each row is judged by itself, whatever its doc_id."""
    return kept_rows(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word similarity of 0.8 or more) the row with the smallest doc_id stays,
    nulls last; of equal rows one."""
    rows = _numbered(docs)
    row = rows.columns[-1]
    return _kept(rows, row, first_rows(rows.select(F.col(row).alias("row"), "doc_id", "text")), docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out."""
    return _counted(dedup(docs, report=False))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences along the curve."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
