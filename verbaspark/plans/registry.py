"""Named queries over the tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaspark.functions import numbers, text
from verbaspark.operators import english, multilingual, spacing, tokens, transducer
from verbaspark.plans import reports
from verbaspark.plans import sql_words as sql
from verbaspark.runtime import ship
from verbaspark.sources import protocol

QUERIES: dict = {}
ORACLES: dict = {}


def _query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of few splits over all cores, since one row group is one task; a large table stays as it is read.

    This alone changes a plan with a table's size, and no result."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 4 * cores else df


# Numbers


def _cardinal_query(lang: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", numbers.cardinal(F.col("o_orderkey"), lang).alias("words"))

    _query(f"SELECT o_orderkey, {sql.cardinal(lang, 'o_orderkey')} AS words FROM orders", f"cardinal_{lang}")(run)


for _lang in ("en", "es", "fr", "de"):
    _cardinal_query(_lang)


def _wider_query(lang: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spread(_table(spark, sf_dir, "part")).select("p_partkey", numbers.cardinal(F.col("p_partkey"), lang).alias("words"))

    _query(f"SELECT p_partkey, {sql.kinyarwanda('p_partkey') if lang == 'rw' else sql.wider_cardinal(lang, 'p_partkey')} AS words FROM part", f"cardinal_{lang}")(run)


for _lang in (*sql.WIDER, "rw"):
    _wider_query(_lang)


@_query(f"SELECT p_partkey, {sql.digits('CAST(p_partkey AS VARCHAR)')} AS words FROM part")
def digits_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "part")).select("p_partkey", numbers.digits(F.col("p_partkey").cast("string")).alias("words"))


@_query(f"SELECT o_orderkey, {sql.ordinal('o_orderkey')} AS words FROM orders")
def ordinal_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", numbers.ordinal(F.col("o_orderkey")).alias("words"))


_YEAR = "year(o_orderdate)"


@_query(f"SELECT o_orderkey, {sql.year(_YEAR)} AS words FROM orders")
def year_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", numbers.year(F.year("o_orderdate")).alias("words"))


def spoken_date(day: Column) -> Column:
    month = F.element_at(F.lit(english.MONTHS), F.month(day))
    return F.concat_ws(" ", month, numbers.ordinal(F.dayofmonth(day)), numbers.year(F.year(day)))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in english.MONTHS) + "]"


@_query(f"SELECT o_orderkey, {_MONTHS}[month(o_orderdate)] || ' ' || {sql.ordinal('day(o_orderdate)')} || ' ' || {sql.year(_YEAR)} AS words FROM orders")
def date_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", spoken_date(F.col("o_orderdate")).alias("words"))


def spoken_time(moment: Column) -> Column:
    """Hours and minutes on a 24-hour clock."""
    h, m = F.hour(moment), F.minute(moment)
    minutes = F.when(m < 10, F.concat(F.lit("o "), numbers.cardinal(m))).otherwise(numbers.cardinal(m))
    return F.concat_ws(" ", numbers.cardinal(h), F.when(m == 0, "o'clock").otherwise(minutes))


@_query(f"SELECT event_id, {sql.cardinal('en', 'hour(ts)')} || ' ' || CASE WHEN minute(ts) = 0 THEN 'o''clock' WHEN minute(ts) < 10 THEN 'o ' || {sql.cardinal('en', 'minute(ts)')} ELSE {sql.cardinal('en', 'minute(ts)')} END AS words FROM events")
def time_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "events")).select("event_id", spoken_time(F.col("ts")).alias("words"))


def spoken_money(cents: Column) -> Column:
    major, minor = F.call_function("div", cents, F.lit(100)), cents % 100
    unit = lambda n, one, many: F.concat(numbers.cardinal(n), F.when(n == 1, f" {one}").otherwise(f" {many}"))
    return F.concat_ws(" ", F.when((major > 0) | (minor == 0), unit(major, "dollar", "dollars")), F.when(minor > 0, unit(minor, "cent", "cents")))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_MAJOR, _MINOR = f"({_CENTS} // 100)", f"({_CENTS} % 100)"


@_query(f"""SELECT o_orderkey, concat_ws(' ', CASE WHEN {_MAJOR} > 0 OR {_MINOR} = 0 THEN {sql.cardinal('en', _MAJOR)} || CASE WHEN {_MAJOR} = 1 THEN ' dollar' ELSE ' dollars' END END,
  CASE WHEN {_MINOR} > 0 THEN {sql.cardinal('en', _MINOR)} || CASE WHEN {_MINOR} = 1 THEN ' cent' ELSE ' cents' END END) AS words FROM orders""")
def money_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", spoken_money(cents).alias("words"))


@_query(f"SELECT p_partkey, {sql.cardinal('en', 'p_size')} || CASE WHEN p_size = 1 THEN ' kilogram' ELSE ' kilograms' END AS words FROM part")
def measure_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(numbers.cardinal(F.col("p_size")), F.when(F.col("p_size") == 1, " kilogram").otherwise(" kilograms"))
    return _spread(_table(spark, sf_dir, "part")).select("p_partkey", words.alias("words"))


_TAX = "CAST(round(l_tax * 100) AS BIGINT)"


@_query(f"SELECT l_orderkey, l_linenumber, {sql.cardinal('en', f'({_TAX} // 100)')} || ' point ' || {sql.digits(f'''lpad(CAST({_TAX} % 100 AS VARCHAR), 2, '0')''')} AS words FROM lineitem")
def decimal_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.round(F.col("l_tax") * 100).cast("long")
    words = F.concat(numbers.cardinal(((n - n % 100) / 100).cast("long")), F.lit(" point "), numbers.digits(F.lpad((n % 100).cast("string"), 2, "0")))
    return _spread(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", words.alias("words"))


_BOTTOM = "(l_linenumber + 1)"


@_query(f"""SELECT l_orderkey, l_linenumber, {sql.cardinal('en', 'l_linenumber', False)} || ' ' || CASE WHEN {_BOTTOM} = 2 THEN 'half' WHEN {_BOTTOM} = 4 THEN 'quarter' ELSE {sql.ordinal(_BOTTOM)} END
  || CASE WHEN l_linenumber = 1 THEN '' ELSE 's' END AS words FROM lineitem""")
def fraction_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("l_linenumber")
    name = F.when(top + 1 == 2, "half").when(top + 1 == 4, "quarter").otherwise(numbers.ordinal(top + 1))
    words = F.concat(numbers.cardinal(top, joined=False), F.lit(" "), name, F.when(top == 1, "").otherwise("s"))
    return _spread(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", words.alias("words"))


# Text steps

_LOCALES = "['en-US', 'pt_BR', '', 'DE', 'xx-YY', 'zh-Hans-CN']"
_SQL_CODES = "', '".join(text.LANGUAGES)


@_query(f"""SELECT doc_id, locale, CASE WHEN code IN ('{_SQL_CODES}') THEN code END AS code FROM (
  SELECT doc_id, locale, lower(regexp_extract(coalesce(nullif(locale, ''), 'en-US'), '^[^-_]*')) AS code FROM (
    SELECT doc_id, {_LOCALES}[doc_id % 6 + 1] AS locale FROM documents))""")
def language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    locale = F.element_at(F.lit(["en-US", "pt_BR", "", "DE", "xx-YY", "zh-Hans-CN"]), (F.col("doc_id") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", locale.alias("locale")).withColumn("code", text.language_code(F.col("locale")))


_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _text_query(name: str, step, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", step(F.concat(F.lit("  [a]\\  "), "text", F.lit("　\n"))).alias("result"))

    _query(f"SELECT doc_id, {oracle.format(t='t')} AS result FROM (SELECT doc_id, ' ' || chr(160) || '[a]\\  ' || text || chr(12288) || chr(10) AS t FROM documents)", name)(run)


_text_query("strip_text", text.strip, f"regexp_replace({{t}}, '^[{_WHITE.replace('{', '{{').replace('}', '}}')}]+|[{_WHITE.replace('{', '{{').replace('}', '}}')}]+$', '', 'g')")
_text_query("collapse_spaces", text.collapse_spaces, "regexp_replace({t}, '  +', ' ', 'g')")
_text_query("escape_text", text.escape, r"replace(replace(replace({t}, '\', '\\'), '[', '\['), ']', '\]')")
_text_query("pre_process", text.pre_process, r"regexp_replace(regexp_replace({t}, '([\[\]])', ' \1 ', 'g'), ' +', ' ', 'g')")


# Documents


@_query()
def normalize_en_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken form of every English document."""
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    return english.normalize(_spread(docs)).select("doc_id", "spoken")


@_query("SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"), F.countDistinct("text").alias("texts"))


@_query("SELECT coalesce(lang, 'all') AS lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang)")
def totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "documents", "chars")


@_query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE (place - 1) % greatest(n // 20, 1) = 0")
def sample_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About twenty evenly spaced rows of each language: a sampling operator."""
    w = W.partitionBy("lang")
    docs = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.row_number().over(w.orderBy("doc_id")).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    return docs.where((F.col("place") - 1) % F.greatest(F.floor(F.col("n") / 20), F.lit(1)) == 0).drop("n")


@_query(r"SELECT span, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS span FROM documents) GROUP BY span")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number as written, and how often."""
    spans = F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return _table(spark, sf_dir, "documents").select(F.explode(spans).alias("span")).groupBy("span").agg(F.count("*").alias("n"))


@_query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@_query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@_query("SELECT doc_id, 'OK' || chr(9) || hex(encode(text)) AS line FROM documents")
def hex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch protocol's reply lines: a status and the text's UTF-8 bytes in hex."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("OK\t"), F.hex(F.encode("text", "UTF-8"))).alias("line"))


# All languages, texts to texts


@_query()
def normalize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken form of every document in its own language."""
    return multilingual.normalize(_spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))).select("doc_id", "lang", "spoken")


@_query()
def normalize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken form of every turn of the conversations, as English."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return english.normalize(_spread(turns)).select("conv_id", "turn", "spoken")


@_query()
def detokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its marks were set apart and joined again."""
    apart = F.regexp_replace("text", r"([,.?!:;()\"'])", " $1 ")
    ship(spark)
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", spacing.detokenize(apart, F.col("lang")).alias("result"))


@_query()
def match_spaces_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spaces around its marks restored after they were removed."""
    tight = F.regexp_replace("text", r" ?([,.?!:;]) ?", "$1")
    ship(spark)
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", spacing.align(F.col("text"), tight).alias("result"))


@_query()
def batch_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch protocol's reply to each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", protocol.request(F.coalesce("text", F.lit("")), F.col("lang")).alias("line"))
    return protocol.replies(_spread(docs)).select("doc_id", "reply")


_TAGGED = """'tokens { date { month: "' || o_orderpriority || '" day: "' || o_orderkey || '" } } tokens { name: "' || o_orderstatus || '" } '"""


@_query(f"""SELECT o_orderkey, '[{{"tokens": {{"date": {{"month": "' || o_orderpriority || '", "day": "' || o_orderkey || '"}}}}}}, {{"tokens": {{"name": "' || o_orderstatus || '"}}}}]' AS tokens FROM orders""")
def read_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified tokens read into JSON."""
    ship(spark)
    tagged = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TAGGED).alias("tagged"))
    return tagged.select("o_orderkey", tokens.token_json(F.col("tagged")).alias("r")).select("o_orderkey", F.col("r.tokens").alias("tokens"))


#: A to B and digits to x, one byte at a time; the dearer arc of a never wins.
_SMALL_GRAPH = transducer.Graph([(0, 0, b, b, 0) for b in range(1, 256) if not 48 <= b <= 57 and b != 65] + [(0, 0, 65, 66, 0), (0, 0, 65, 67, 1)] + [(0, 0, b, 120, 0.5) for b in range(48, 58)], {0: 0})


@_query("SELECT c_custkey, translate(c_name, 'A0123456789', 'Bxxxxxxxxxx') AS output FROM customer")
def transduce_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names through a small weighted transducer."""
    ship(spark)
    names = _table(spark, sf_dir, "customer").select("c_custkey", transducer.rewrite(F.col("c_name"), _SMALL_GRAPH).alias("r"))
    return names.select("c_custkey", F.col("r.output").alias("output"))


@_query("SELECT lang, outcome, count(*) AS cases FROM (SELECT lang, CASE WHEN n_chars = length(text) THEN 'exact' ELSE 'mismatch' END AS outcome FROM documents) GROUP BY ROLLUP (lang, outcome)")
def parity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by language with totals, over the stored lengths of documents."""
    none = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "documents")
    return reports.tally(docs.select("lang", reports.outcome(F.length("text"), none, F.col("n_chars"), none).alias("outcome")))


from verbaspark.plans import constructed  # noqa: E402, F401  registers the queries over made inputs
