"""The parity job: recorded cases through the rules, with outcomes by language and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark import api
from verbaspark.functions.text import strip
from verbaspark.operators import spacing
from verbaspark.plans import reports
from verbaspark.runtime import ship
from verbaspark.sources import readers


def judged(cases: DataFrame) -> DataFrame:
    """``cases`` (lang, category, input, expected, reference_error) with output, error and outcome."""
    ship(cases.sparkSession)
    said = cases.withColumn("r", api.try_normalize(F.col("input"), F.col("lang"))).select("*", "r.*").drop("r")
    matched = F.when(F.col("output").isNotNull() & (strip(F.col("input")) != ""), strip(spacing.align(F.col("input"), F.col("output")))).otherwise(F.col("output"))
    said = said.withColumn("output", matched)
    return said.withColumn("outcome", reports.outcome(F.col("output"), F.col("error"), F.col("expected"), F.col("reference_error")))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of all JSON documents in a folder."""
    return readers.snapshot(spark, folder)


def classes(spark: SparkSession, pattern: str) -> DataFrame:
    """``written~spoken[~another]`` files as <lang>/..._<class>.txt: exact where the output is one of the readings."""
    cases = readers.cases(spark, pattern).withColumn("path", F.input_file_name())
    lang = F.element_at(F.split("path", "/"), -2)
    cases = cases.select(lang.alias("lang"), F.regexp_extract("file", r"^(?:test_cases_)?(.*)\.txt$", 1).alias("category"), F.col("input"), "expected")
    said = cases.withColumn("output", api.try_normalize(F.col("input"), F.col("lang"))["output"])
    return said.withColumn("outcome", F.when(reports.membership(F.col("output"), F.col("expected")), "exact").otherwise("mismatch"))


def tally(cases: DataFrame, by: str = "category") -> DataFrame:
    """Cases and exact ones of each language and category, with totals (null names)."""
    return cases.rollup("lang", by).agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") == "exact").alias("exact")).orderBy(F.col("lang").asc_nulls_last(), F.col(by).asc_nulls_last())
