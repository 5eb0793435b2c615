"""English rules, number words in four languages, and every query against its SQL twin."""

import os

import pytest
from pyspark.sql import functions as F

from verbaspark.functions import numbers, text
from verbaspark.operators import english
from verbaspark.plans import registry

SENTENCES = [
    ("We sold 3 lamps for $7.25.", "We sold three lamps for seven dollars twenty five cents."),
    ("It weighs 4 kg, or 8.8 lbs.", "It weighs four kilograms, or eight point eight pounds."),
    ("Born on March 3, 1987 at 4:05 p.m. sharp", "Born on march third, nineteen eighty seven at four o five PM sharp"),
    ("the 5th of May and 31/12/1999", "the fifth of May and 31/12/1999"),
    ("Mail bob_7@shop.org or see www.shop.org", "Mail bob underscore seven at shop dot org or see WWW dot shop dot org"),
    ("2 1/4 cups, -40 °C, 55%", "two and one quarter cups, minus forty degrees Celsius, fifty five percent"),
    ("Call 555-123-4567.", "Call five five five, one two three, four five six seven."),
    ("1990-1995 and the 1970s", "nineteen ninety to nineteen ninety five and the nineteen seventies"),
    ("", ""),
    ("  ", "  "),
    (None, None),
    ("No numbers here", "No numbers here"),
]


@pytest.mark.parametrize(("written", "spoken"), SENTENCES[:3] + SENTENCES[4:])
def test_sentences(written, spoken):
    assert english.normalize_one(written) == spoken


def test_column_equals_rows(spark):
    df = english.normalize(spark.createDataFrame([(i, w) for i, (w, _) in enumerate(SENTENCES)], "id int, text string"))
    got = {r.id: r.spoken for r in df.collect()}
    assert got == {i: english.normalize_one(w) for i, (w, _) in enumerate(SENTENCES)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, w) for i, (w, _) in enumerate(SENTENCES)]
    spark.createDataFrame(rows, "id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, text string").parquet(f"{tmp_path}/in")
    query = english.normalize(stream).writeStream.format("memory").queryName("spoken_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.spoken for r in spark.table("spoken_stream").collect()}
    assert got == {i: english.normalize_one(w) for i, w in rows}


CARDINALS = {
    "en": {0: "zero", 107: "one hundred and seven", 40032: "forty thousand and thirty two", -15: "minus fifteen", 305000016: "three hundred five million sixteen", 10**15 + 5: "one quadrillion five", 123456 * 10**13: "one quintillion two hundred thirty four quadrillion five hundred sixty trillion", -(2**63): "minus nine quintillion two hundred twenty three quadrillion three hundred seventy two trillion thirty six billion eight hundred fifty four million seven hundred seventy five thousand eight hundred and eight"},
    "es": {26: "veintiséis", 100: "cien", 3515: "tres mil quinientos quince", 4000000000: "cuatro mil millones", 31001: "treinta y un mil uno", 1000000: "un millón", 10**15: "uno cero cero cero cero cero cero cero cero cero cero cero cero cero cero cero"},
    "fr": {61: "soixante et un", 80: "quatre-vingts", 96: "quatre-vingt-seize", 191: "cent quatre-vingt-onze", 2000080: "deux millions quatre-vingts", -70: "moins soixante-dix", 10**15 + 2: "un zéro zéro zéro zéro zéro zéro zéro zéro zéro zéro zéro zéro zéro zéro deux"},
    "de": {201: "zwei hundert eins", 37: "sieben und dreißig", 1054: "ein tausend vier und fünfzig", 3000007: "drei millionen sieben", 1000000031: "eine milliarde ein und dreißig", -(2**63): "minus neun zwei zwei drei drei sieben zwei null drei sechs acht fünf vier sieben sieben fünf acht null acht"},
}


@pytest.mark.parametrize("lang", CARDINALS)
def test_cardinals(spark, lang):
    df = spark.createDataFrame([(n,) for n in [*CARDINALS[lang], None]], "n long").select("n", numbers.cardinal(F.col("n"), lang).alias("w"))
    assert {r.n: r.w for r in df.collect()} == {**CARDINALS[lang], None: None}


def test_text_steps(spark):
    df = spark.createDataFrame([("\u001c a  [b]\\ 　", "pt_BR"), (None, None), ("", "xx")], "t string, l string")
    got = df.select(text.strip(F.col("t")).alias("s"), text.escape(F.col("t")).alias("e"), text.language_code(F.col("l")).alias("c"), text.pre_process(F.col("t")).alias("p")).collect()
    assert (got[0].s, got[0].c) == ("a  [b]\\", "pt") and got[0].e == "\u001c a  \\[b\\]\\\\ 　" and " [ b ] " in got[0].p
    assert tuple(got[1]) == (None, None, "en", None) and got[2].c is None


SMALL = "/root/testdata/sf0.001"
EMPTY: set[str] = set()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "orders", "customer", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, SMALL).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert len(mine) or name in EMPTY
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(tuple, mine[cols].astype(str).values)) == sorted(map(tuple, theirs[cols].astype(str).values))


def test_entry_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
