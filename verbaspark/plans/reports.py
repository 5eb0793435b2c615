"""Parity reports: each case's outcome, and counts and medians by language with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(output: Column, error: Column, expected: Column, expected_error: Column) -> Column:
    """exact, both_reject, reference_rejects_only, regression_error or mismatch."""
    return (
        F.when(error.isNotNull() & expected_error.isNotNull(), "both_reject")
        .when(error.isNotNull(), "regression_error")
        .when(expected_error.isNotNull(), "reference_rejects_only")
        .when(output == expected, "exact")
        .otherwise("mismatch")
    )


def tally(cases: DataFrame) -> DataFrame:
    """Cases of each language and outcome, and totals of each language and of all (null names)."""
    return cases.rollup("lang", "outcome").agg(F.count("*").alias("cases"))


def summary(cases: DataFrame) -> DataFrame:
    """By language: cases, exact ones, errors, distinct inputs, and the median of ``seconds``."""
    return cases.groupBy("lang").agg(
        F.count("*").alias("cases"), F.count_if(F.col("outcome") == "exact").alias("exact"),
        F.count_if(F.col("outcome").isin("both_reject", "regression_error")).alias("errors"),
        F.countDistinct("input").alias("inputs"), F.percentile("seconds", 0.5).alias("median_seconds"),
    )


def speedups(runs: DataFrame, key: str, engine: str, seconds: str, base: str, other: str) -> DataFrame:
    """By ``key``: the median ``seconds`` of two engines, and how many times faster the other is."""
    medians = runs.groupBy(key).agg(*[F.percentile(F.when(F.col(engine) == e, F.col(seconds)), 0.5).alias(name) for e, name in ((base, "base_median"), (other, "other_median"))])
    return medians.withColumn("speedup", F.try_divide("base_median", "other_median"))


def membership(output: Column, expected: Column) -> Column:
    """Whether an output is one of several readings that may be expected."""
    return F.coalesce(F.array_contains(expected, output), F.lit(False))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two runs whose values differ or that one run lacks."""
    a, b = left.select(*keys, F.col(value).alias("left")), right.select(*keys, F.col(value).alias("right"))
    return a.join(b, keys, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
