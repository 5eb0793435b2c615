"""Readers of the text formats: lines, categories, cases with answers, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SNAPSHOT = "cases array<struct<id:string,lang:string,category:string,input:string,expected:string,reference_error:string,reference_seconds:double>>"


def _file(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One text a line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """``category|input`` lines; the language is the file's name."""
    parts = F.split("value", r"\|", 2)
    df = _file(spark.read.text(path)).where(F.trim("value") != "")
    return df.select(F.regexp_replace("file", r"\..*$", "").alias("lang"), parts[0].alias("category"), parts[1].alias("input"))


def cases(spark: SparkSession, path: str, answer_first: bool = False) -> DataFrame:
    """``written~spoken[~another]`` lines; ``answer_first``: the written form stands last."""
    parts = F.split("value", "~")
    df = _file(spark.read.text(path)).where(F.col("value").contains("~")).withColumn("parts", parts)
    n = F.size("parts")
    written = F.element_at("parts", -1) if answer_first else F.col("parts")[0]
    spoken = F.slice("parts", F.lit(1), n - 1) if answer_first else F.slice("parts", F.lit(2), n - 1)
    return df.select("file", written.alias("input"), F.transform(spoken, lambda x: F.trim(x)).alias("expected"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a ``~written`` line and one answer a line; ``place`` grows along a file. Blocks are parted while reading, so a file can be split."""
    whole = _file(spark.read.option("lineSep", "\n~").text(path))
    block = whole.select("file", F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^~", "").alias("block"))
    rows = F.filter(F.split("block", r"\r?\n"), lambda x: F.trim(x) != "")
    return block.withColumn("rows", rows).where(F.size("rows") > 0).select("file", "place", F.col("rows")[0].alias("input"), F.slice("rows", F.lit(2), F.size("rows")).alias("expected"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON documents that hold a list of them."""
    return spark.read.schema(_SNAPSHOT).json(path, multiLine=True).select(F.inline("cases"))


def write_snapshot(cases: DataFrame, path: str, most: int = 1000) -> None:
    """JSON documents, one a file, each with at most ``most`` cases of one language."""
    place = F.monotonically_increasing_id()
    blocks = cases.withColumn("block", F.call_function("div", place, F.lit(most)))
    documents = blocks.groupBy("lang", "block").agg(F.collect_list(F.struct(*cases.columns)).alias("cases")).drop("block")
    documents.write.option("maxRecordsPerFile", 1).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
