"""Made inputs of ten kinds from a seed, for trying the rules on texts that nobody wrote: the same on every run and engine.

Numbers come from whole-number arithmetic on the row's number and the seed, so that SQL can make the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("cardinal", "decimal", "money", "date", "time", "telephone", "electronic", "mixed", "symbols", "edge")


def _drawn(seed: int, k: int, size: int) -> str:
    """SQL for a number from 0 to size - 1 that looks drawn by chance; ``id`` is the row's number."""
    return f"(((id * 48271 + {seed * 7919 + k * 104729}) % 2147483647) * 69621 % 2147483647 % {size})"


def forms(seed: int) -> list[str]:
    """An SQL expression of the text for each kind, which both engines read."""
    n = lambda k, size: _drawn(seed, k, size)
    s = lambda e: f"CAST({e} AS STRING)"
    two = lambda e: f"lpad({s(e)}, 2, '0')"
    sign = f"substr('$£€', CAST({n(1, 3)} + 1 AS INT), 1)"
    return [
        f"CASE WHEN {n(2, 4)} = 0 THEN '-' ELSE '' END || {s(n(3, 1000000))}",
        f"{s(n(4, 100))} || '.' || {s(n(5, 1000))}",
        f"{sign} || {s(n(6, 10000))} || '.' || {two(n(7, 100))}",
        f"{s(f'(1900 + {n(8, 200)})')} || '-' || {two(f'({n(9, 12)} + 1)')} || '-' || {two(f'({n(10, 28)} + 1)')}",
        f"{s(n(11, 24))} || ':' || {two(n(12, 60))}",
        f"{s(f'({n(13, 800)} + 200)')} || '-' || {s(f'({n(14, 800)} + 200)')} || '-' || {s(f'({n(15, 9000)} + 1000)')}",
        f"'user' || {s(n(16, 100))} || '@host' || {s(n(17, 10))} || '.org'",
        f"'buy ' || {s(n(18, 30))} || ' kg for ' || {sign} || {s(n(19, 90))} || ' at ' || {s(n(20, 12))} || ':30'",
        f"repeat(substr('#$%&*+=@', CAST({n(21, 8)} + 1 AS INT), 1), CAST({n(22, 3)} + 1 AS INT)) || ' x' || {s(n(23, 10))}",
        f"split_part('  |[1]|\ue0007|\uff11\uff12|\u200b3|a\u03014|  5|\u202e6', '|', CAST({n(24, 8)} + 1 AS INT))",
    ]


def inputs(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, kind and text of ``n`` inputs of each kind; equal texts stay."""
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(form).alias("text")) for kind, form in zip(KINDS, forms(seed), strict=True)])).alias("r")
    return spark.range(n).select("id", rows).select("id", "r.kind", "r.text")


def twin(n: int, seed: int) -> str:
    return " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, {form} AS text FROM (SELECT unnest(range({n})) AS id)" for kind, form in zip(KINDS, forms(seed), strict=True))
