"""Queries over inputs that are made from the tables, each with an SQL twin that states the answer directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark import api
from verbaspark.functions import numbers, text
from verbaspark.operators import multilingual, spacing, tokens, transducer
from verbaspark.plans import reports, sentences, stress
from verbaspark.plans import sql_words as sql
from verbaspark.plans.registry import _query, _table
from verbaspark.runtime import shared_dir, ship
from verbaspark.sources import protocol, readers


def _sentence_query(lang: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sentences.spoken(spark, sf_dir, lang)

    _query(sentences.twin(lang), f"spoken_{lang}")(run)


for _lang in text.LANGUAGES:
    _sentence_query(_lang)


# Marks and spaces: (language, tokens apart, joined)
_TOKENS = [
    ("en", "'He said , \" ' || p_brand || ' \" ( now ) , it ''s $ ' || p_size || ' !'", "'He said, \"' || p_brand || '\" (now), it''s $' || p_size || '!'"),
    ("fr", "'l'' eau ( ' || p_brand || ' ) ; oui : ' || p_size || ' %'", "'l''eau (' || p_brand || ') ; oui : ' || p_size || ' %'"),
    ("it", "'dell'' arte , ' || p_brand || ' .'", "'dell''arte, ' || p_brand || '.'"),
    ("zh", "'漢 字 , ' || p_size || ' 字 字 a'", "'漢字, ' || p_size || ' 字字 a'"),
    ("ko", "'가 나 . ' || p_brand", "'가 나. ' || p_brand"),
    ("de", "'¿ a @-@ b ? [ ' || p_size || ' ] „ c „ € ' || p_size", "'¿a-b? [' || p_size || '] „c„ €' || p_size"),
]


@_query(" UNION ALL ".join(f"SELECT p_partkey, '{lang}' AS lang, {joined} AS result FROM part" for lang, _, joined in _TOKENS))
def detokenize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens apart to print spacing, in six languages."""
    ship(spark)
    rows = F.array(*[F.struct(F.lit(lang).alias("lang"), F.expr(apart).alias("apart")) for lang, apart, _ in _TOKENS])
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("r"))
    return parts.select("p_partkey", "r.lang", spacing.detokenize(F.col("r.apart"), F.col("r.lang")).alias("result"))


# (written, spoken, spoken with the written spaces)
_SPACED = [
    ("'a , b (' || p_size || ') c'", "'a, b ( ' || p_size || ' ) c'", "'a , b (' || p_size || ') c'"),
    ("p_brand || '-x , y'", "p_brand || ' - x, y'", "p_brand || '-x , y'"),
    ("'x; ' || p_brand || ' .'", "'x ;' || p_brand || '.'", "'x; ' || p_brand || ' .'"),
    ("'``q`` ' || p_size", "'\" q \" ' || p_size", "'\"q\" ' || p_size"),
    ("'a. b.' || p_size", "'a . b ' || p_size", "'a. b ' || p_size"),
]


@_query(" UNION ALL ".join(f"SELECT p_partkey, {k} AS form, {said} AS result FROM part" for k, (_, _, said) in enumerate(_SPACED)))
def match_spaces_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken texts with the spaces that the written ones have around marks."""
    ship(spark)
    rows = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(w).alias("w"), F.expr(s).alias("s")) for k, (w, s, _) in enumerate(_SPACED)])
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("r"))
    return parts.select("p_partkey", "r.form", spacing.align(F.col("r.w"), F.col("r.s")).alias("result"))


_CODES = list(range(0x20, 0x2100, 7)) + list(range(0x2100, 0x30000, 101)) + [b for pair in spacing.WIDE_RANGES for b in (pair[0] - 1, *pair, pair[1] + 1)]
_SIGNS = [0x24, 0xA2, 0xA3, 0xA4, 0xA5, 0x20A9, 0x20AC, 0x20B9, 0x20BF]
_CODES = [c for c in dict.fromkeys([*_CODES, *_SIGNS]) if not 0xD800 <= c < 0xE000 and c not in range(0x20A0, 0x20D0) and c not in range(0x11FD0, 0x12000) or c in _SIGNS]
_OTHER_SIGNS = (0x58F, 0x60B, 0x9F2, 0x9F3, 0x9FB, 0xAF1, 0xBF9, 0xE3F, 0x17DB, 0xA838, 0xFDFC, 0xFE69, 0xFF04, 0xFFE0, 0xFFE1, 0xFFE5, 0xFFE6)


@_query(f"""SELECT code, {' OR '.join(f'code BETWEEN {a} AND {b}' for a, b in spacing.WIDE_RANGES)} AS wide, code IN ({', '.join(map(str, (*_SIGNS, *_OTHER_SIGNS)))}) AS currency
  FROM (SELECT unnest([{', '.join(map(str, _CODES))}])::BIGINT AS code)""")
def character_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters join without spaces, and which are currency signs."""
    rows = spark.createDataFrame([(c, chr(c)) for c in _CODES], "code long, c string")
    return rows.select("code", text.matches_ranges(F.col("c"), spacing.WIDE_RANGES).alias("wide"), text.currency(F.col("c")).alias("currency"))


# Tokens

_MANY = """repeat('tokens { date { month: "x" day: "y" } } ', CAST(p_size % 9 + 1 AS INT))"""


@_query("SELECT p_partkey, CAST(list_concat(list_transform(range(0, (p_size % 9 + 1) // 3), lambda x: 3), CASE WHEN (p_size % 9 + 1) % 3 = 0 THEN [] ELSE [(p_size % 9 + 1) % 3] END) AS INT[])::VARCHAR AS sizes FROM part")
def token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two orders each, in groups of eight orders at most."""
    ship(spark)
    parts = _table(spark, sf_dir, "part").select("p_partkey", tokens.group_sizes(F.expr(_MANY), 8).alias("g"))
    return parts.select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: x.cast("string")), ", "), F.lit("]")).alias("sizes"))


_DATED = """'tokens { date { day: "' || p_size || '" month: "may" } }'"""


@_query("""SELECT p_partkey, place, CASE place WHEN 0 THEN ' tokens {  date { day: "' || p_size || '" month: "may"  }  } ' ELSE ' tokens {  date { month: "may" day: "' || p_size || '"  }  } ' END AS written
  FROM part, (SELECT unnest([0, 1]) AS place)""")
def token_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a token's fields, serialized."""
    ship(spark)
    return _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(tokens.orderings(F.expr(_DATED))).alias("place", "written"))


def _copying(skip: bytes) -> list[tuple[int, int, int, int, float]]:
    """Edges that copy every byte but those of ``skip``."""
    return [(0, 0, b, b, 0) for b in range(1, 256) if b not in skip]


def _month_first() -> transducer.Graph:
    """Takes only serializations that name the month before the day; writes the values with a space between."""
    edges, state = [], 0

    def read(word: str, write: str = "") -> None:
        nonlocal state
        for k, b in enumerate(word.encode()):
            edges.append((state, state + 1, b, 0, 0))
            state += 1
        for b in write.encode():
            edges.append((state, state + 1, 0, b, 0))
            state += 1

    read(' tokens {  date { month: "may" day: "', "may ")
    edges.extend((state, state, b, b, 0) for b in range(48, 58))
    read('"  }  } ')
    return transducer.Graph(edges, {state: 0})


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '\\[' || p_size || '\\]' ELSE 'may ' || p_size END AS output FROM part")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order that a verbalizing graph takes; the escaped source where it takes none."""
    ship(spark)
    tagged = F.when(F.col("p_size") % 3 == 0, F.replace(F.expr(_DATED), F.lit("month"), F.lit("year"))).otherwise(F.expr(_DATED))
    said = tokens.spoken_tokens(tagged, F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]")), _month_first())
    return _table(spark, sf_dir, "part").select("p_partkey", said.alias("r")).select("p_partkey", "r.output")


@_query("""SELECT p_partkey, k AS place, CASE k WHEN 0 THEN 'date' ELSE 'name' END AS class, CASE k WHEN 0 THEN '{"day": "' || p_size || '", "month": "may"}' ELSE '"x"' END AS fields
  FROM part, (SELECT unnest([0, 1]) AS k)""")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified tokens as rows, by the table function."""
    ship(spark)
    spark.udtf.register("token_rows", tokens.token_rows)
    _table(spark, sf_dir, "part").select("p_partkey", F.expr(f"""{_DATED} || ' tokens {{ name: "x" }}'""").alias("tagged")).createOrReplaceTempView("tagged_parts")
    return spark.sql("SELECT p_partkey, t.place, t.class, t.fields FROM tagged_parts, LATERAL token_rows(tagged) t")


@_query("SELECT n_fields, factorial(n_fields)::BIGINT AS orders, count(*) AS lines FROM (SELECT CAST(l_linenumber AS INT) AS n_fields FROM lineitem) GROUP BY n_fields")
def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of tokens with as many fields as a line's number."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("n_fields"))
    return lines.groupBy("n_fields").agg(F.count("*").alias("lines")).select("n_fields", tokens.order_count(F.col("n_fields")).alias("orders"), "lines")


@_query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax AS FLOAT) + CAST(l_discount AS FLOAT) AS DOUBLE) AS cost FROM lineitem")
def float_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums rounded to 32 bits, as a graph's costs are."""
    cost = text.to_float32(text.to_float32(F.col("l_tax")) + text.to_float32(F.col("l_discount")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cost.cast("double").alias("cost"))


# Transducers

#: Two equal readings of a, y by its own order and x after projection; digits become two signs, the second of which is paid for.
_TIES = [(0, 1, 97, 120, 0), (0, 2, 97, 121, 0), *((0, 3, b, 35, 0.25) for b in range(48, 58)), *((0, 4, b, 36, 0.5) for b in range(48, 58))]
_TIES += [(s, 0, 0, 0, 0) for s in (1, 2, 3, 4)] + [(0, 0, b, b, 0) for b in range(1, 256) if b != 97 and not 48 <= b < 58]


@_query("SELECT p_partkey, translate(p_name, 'a0123456789', 'y##########') AS plain, translate(p_type, 'a0123456789', 'x##########') AS projected FROM part")
def transduce_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal paths: the winner by the order of the graph, and by that of its output alone."""
    ship(spark)
    plain, projected = (transducer.Graph(_TIES, {0: 0}, project_output=p) for p in (False, True))
    parts = _table(spark, sf_dir, "part").select("p_partkey", transducer.rewrite(F.col("p_name"), plain).alias("a"), transducer.rewrite(F.col("p_type"), projected).alias("b"))
    return parts.select("p_partkey", F.col("a.output").alias("plain"), F.col("b.output").alias("projected"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ok ' || c_custkey END AS output, CASE WHEN c_custkey % 2 = 1 THEN 'NoPathError: no path for ''no ' || c_custkey || '''' END AS error FROM customer")
def transduce_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that the graph does not accept is one row's error."""
    ship(spark)
    word = F.concat(F.when(F.col("c_custkey") % 2 == 0, "ok ").otherwise("no "), F.col("c_custkey").cast("string"))
    return _table(spark, sf_dir, "customer").select("c_custkey", transducer.rewrite(word, transducer.Graph(_copying(b"n"), {0: 0})).alias("r")).select("c_custkey", "r.output", "r.error")


_FILED = [(0, 1, 97, 120, 0.5), (1, 2, 0, 45, 0.25), (2, 0, 98, 121, 0.0)]


@_query("SELECT * FROM (VALUES (0, 1, 97, 120, 0.5::FLOAT), (1, 2, 0, 45, 0.25::FLOAT), (2, 0, 98, 121, 0::FLOAT)) AS t(source, target, read, write, weight)")
def graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed graph file's edges, written and read back through the shared folder."""
    path = f"{shared_dir(spark)}/graph"
    ship(spark)

    def write(_: object) -> object:
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [transducer.write_graph(_FILED, {0: 0.0}, b"GRAPHV01").hex()]})

    spark.range(0, 1, 1, 1).mapInArrow(write, "value string").write.text(path)
    raw = spark.read.text(path).select(F.unhex("value").alias("raw"))

    def read(batches: object) -> object:
        import pyarrow as pa

        for batch in batches:
            for x in batch.column(0).to_pylist():
                edges = transducer.read_arrays(x, b"GRAPHV01")[1]
                yield pa.RecordBatch.from_pandas(edges.astype({"source": "int32", "target": "int32", "read": "int32", "write": "int32"}), preserve_index=False)

    return raw.mapInArrow(read, "source int, target int, read int, write int, weight float")


# The front door

_PLACES = ["en-US", "es_MX", "xx-YY", "de", "", "tlh"]


@_query(f"""SELECT doc_id, CASE k WHEN 0 THEN 'ab ' || {sql.cardinal('en', 'n')} WHEN 1 THEN 'ab ' || {sql.cardinal('es', 'n')} WHEN 3 THEN 'ab ' || {sql.cardinal('de', 'n')} WHEN 4 THEN 'ab ' || {sql.cardinal('en', 'n')} END AS output,
  CASE k WHEN 2 THEN 'ValueError: unsupported language: ''xx-YY''' WHEN 5 THEN 'ValueError: unsupported language: ''tlh''' END AS error
  FROM (SELECT doc_id, doc_id % 6 AS k, doc_id % 997 AS n FROM documents)""")
def normalize_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several locales: an unknown one is one row's error."""
    ship(spark)
    place = F.element_at(F.lit(_PLACES), (F.col("doc_id") % 6 + 1).cast("int"))
    said = api.try_normalize(F.concat(F.lit("ab "), (F.col("doc_id") % 997).cast("string")), place)
    return _table(spark, sf_dir, "documents").select("doc_id", said.alias("r")).select("doc_id", "r.output", "r.error")


@_query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'OK' || chr(9) || lower(hex(encode('ab ' || {sql.wider_cardinal('pt', 'n')})))
  WHEN 1 THEN 'ERR' || chr(9) || 'ValueError' || chr(9) || lower(hex(encode('seven fields parted by tabs are expected')))
  WHEN 2 THEN 'ERR' || chr(9) || 'ValueError' || chr(9) || lower(hex(encode('input_case ''lower_cased'' is not offered for pt')))
  ELSE 'OK' || chr(9) END AS reply FROM (SELECT doc_id, doc_id % 2000 AS n FROM documents)""")
def protocol_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch protocol: good requests, a wrong number of fields, an option that is not offered, a blank text."""
    k, body = F.col("doc_id") % 4, F.concat(F.lit("ab "), (F.col("doc_id") % 2000).cast("string"))
    good = protocol.request(body, F.lit("pt"))
    line = F.when(k == 0, good).when(k == 1, F.lit("a\tb")).when(k == 2, F.replace(good, F.lit("\tcased"), F.lit("\tlower_cased"))).otherwise(protocol.request(F.lit("  "), F.lit("pt")))
    return protocol.replies(_table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))).select("doc_id", "reply")


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS checked FROM documents")
def valid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text where they are UTF-8: every third document has a byte too many."""
    raw = F.unhex(F.concat(F.hex(F.encode("text", "UTF-8")), F.when(F.col("doc_id") % 3 == 0, "FF").otherwise("")))
    return _table(spark, sf_dir, "documents").select("doc_id", text.valid_utf8(raw).alias("checked"))


@_query("SELECT p_partkey, form, CASE form WHEN 0 THEN 'twelve' WHEN 1 THEN chr(57344) || ' ' || 'two' WHEN 2 THEN '  ' WHEN 3 THEN '' ELSE 'onetwo' END AS spoken FROM part, (SELECT unnest([0, 1, 2, 3, 4]) AS form)")
def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero characters inside numbers and words, private characters, blanks and nothing."""
    forms = F.posexplode(F.array(*[F.lit(t) for t in ("1\x002", "\ue000 2", "  ", "", "one\x00two")])).alias("form", "text")
    return multilingual.normalize(_table(spark, sf_dir, "part").select("p_partkey", forms), F.lit("en")).select("p_partkey", "form", "spoken")


# Sources and sinks


@_query(f"SELECT p_partkey, {sql.cardinal('es', 'p_partkey')} AS spoken FROM part")
def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text files, read, spoken and written again; the key is carried by the line's end."""
    path = shared_dir(spark)
    _table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" #"), F.lpad(F.col("p_partkey").cast("string"), 9, "x")).alias("value")).write.text(f"{path}/in")
    lines = readers.lines(spark, f"{path}/in").select(F.split("text", " #")[0].alias("text"), F.ltrim(F.split("text", " #")[1], F.lit("x")).cast("long").alias("p_partkey"))
    return multilingual.normalize(lines, F.lit("es")).select("p_partkey", "spoken")


@_query("SELECT 'en' AS lang, 'size' || (p_size % 3) AS category, p_name || '|' || p_partkey AS input FROM part")
def category_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``category|input`` lines, written and read."""
    path = f"{shared_dir(spark)}/cases"
    _table(spark, sf_dir, "part").select(F.concat(F.lit("size"), (F.col("p_size") % 3).cast("string"), F.lit("|"), "p_name", F.lit("|"), F.col("p_partkey").cast("string")).alias("value")).write.text(path)
    return readers.categories(spark, path).select(F.lit("en").alias("lang"), "category", "input")


@_query("SELECT p_partkey::VARCHAR AS input, p_name || ';' || p_brand AS expected FROM part")
def tilde_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``written~spoken~another`` lines, written and read."""
    path = f"{shared_dir(spark)}/cases"
    _table(spark, sf_dir, "part").select(F.concat_ws("~", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("value")).write.text(path)
    return readers.cases(spark, path).select("input", F.array_join("expected", ";").alias("expected"))


@_query("SELECT p_partkey::VARCHAR AS input, p_name || ';' || p_brand AS expected FROM part")
def block_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a written line and its answers, written and read."""
    path = f"{shared_dir(spark)}/cases"
    _table(spark, sf_dir, "part").select(F.concat(F.lit("~"), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit("\n"), "p_brand").alias("value")).write.text(path)
    return readers.blocks(spark, path).select("input", F.array_join("expected", ";").alias("expected"))


@_query("SELECT p_partkey::VARCHAR AS id, lower(substr(p_brand, 1, 2)) AS lang, p_name AS input, p_type AS expected FROM part")
def snapshot_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON documents and read."""
    path = f"{shared_dir(spark)}/snapshot"
    cases = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lower(F.substring("p_brand", 1, 2)).alias("lang"), F.col("p_name").alias("input"), F.col("p_type").alias("expected"))
    readers.write_snapshot(cases, path)
    return readers.snapshot(spark, path).select("id", "lang", "input", "expected")


@_query("SELECT doc_id, text, lang FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, written and read."""
    path = f"{shared_dir(spark)}/lines"
    readers.write_jsonl(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string")


# Reports


@_query("SELECT lang, kind, 'exact' AS outcome, count(*) AS cases FROM (" + " UNION ALL ".join(f"SELECT '{lang}' AS lang, '{kind}' AS kind FROM part" for lang in ("en", "fr", "ja", "ko") for kind in ("cardinal", "ordinal")[: 2 if lang == "en" else 1]) + ") GROUP BY lang, kind")
def parity_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of texts through the rules against number columns, by language and class."""
    n = (F.col("p_partkey") % 1000).cast("long")
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    rows = [F.struct(F.lit(lang).alias("lang"), F.lit("cardinal").alias("kind"), n.cast("string").alias("written"), numbers.cardinal(n, lang).alias("expected")) for lang in ("en", "fr", "ja", "ko")]
    rows.append(F.struct(F.lit("en").alias("lang"), F.lit("ordinal").alias("kind"), F.concat(n.cast("string"), end).alias("written"), numbers.ordinal(n).alias("expected")))
    cases = _table(spark, sf_dir, "part").select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    none = F.lit(None).cast("string")
    judged = multilingual.normalize(cases, "lang", "written", "said").withColumn("outcome", reports.outcome(F.col("said"), none, F.col("expected"), none))
    return judged.groupBy("lang", "kind", "outcome").agg(F.count("*").alias("cases"))


@_query("""SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, l.lang AS "left", r.lang AS "right" FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0) l
  FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 0) r ON l.doc_id = r.doc_id WHERE l.lang IS DISTINCT FROM r.lang""")
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two runs differ, or one lacks a row."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    right = docs.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 10 == 1, "xx").otherwise(F.col("lang")))
    return reports.compare(docs.where("doc_id % 5 <> 0"), right, ["doc_id"], "lang")


_CASES = "SELECT lang, n_chars / 8.0 AS seconds, text AS input, CASE WHEN doc_id % 9 = 0 THEN 'both_reject' WHEN doc_id % 9 = 1 THEN 'mismatch' ELSE 'exact' END AS outcome FROM documents"


@_query(f"SELECT lang, count(*) AS cases, count(*) FILTER (outcome = 'exact') AS exact, count(*) FILTER (outcome = 'both_reject') AS errors, count(DISTINCT input) AS inputs, quantile_cont(seconds, 0.5)::DOUBLE AS median_seconds FROM ({_CASES}) GROUP BY lang")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct inputs and medians by language."""
    docs = _table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    return reports.summary(docs.select("lang", (F.col("n_chars") / 8.0).cast("double").alias("seconds"), F.col("text").alias("input"), F.when(k == 0, "both_reject").when(k == 1, "mismatch").otherwise("exact").alias("outcome")))


@_query("""SELECT l_linestatus, quantile_cont(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DOUBLE) END, 0.5) AS base_median, quantile_cont(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) END, 0.5) AS other_median,
  round(quantile_cont(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DOUBLE) END, 0.5) / quantile_cont(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DOUBLE) END, 0.5), 6) AS speedup FROM lineitem GROUP BY l_linestatus""")
def speed_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two engines' times and their ratio, by group; quantities stand for times."""
    runs = _table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("double").alias("seconds"))
    return reports.speedups(runs, "l_linestatus", "l_returnflag", "seconds", "A", "R").withColumn("speedup", F.round("speedup", 6))


@_query("SELECT p_partkey, p_size % 3 < 2 AS listed FROM part")
def expected_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a spoken form one of the readings that may be expected."""
    said = numbers.cardinal(F.col("p_size"))
    readings = F.when(F.col("p_size") % 3 == 0, F.array(said, F.lit("x"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("x"), said)).otherwise(F.array(F.lit("x")))
    return _table(spark, sf_dir, "part").select("p_partkey", reports.membership(said, readings).alias("listed"))


@_query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@_query("""SELECT 'union' AS op, p_brand AS value FROM part WHERE p_size < 10 UNION SELECT 'union', p_brand FROM part WHERE p_size > 40
  UNION ALL (SELECT 'except', p_type FROM part WHERE p_size < 10 EXCEPT SELECT 'except', p_type FROM part WHERE p_size > 40)
  UNION ALL (SELECT 'intersect', p_type FROM part WHERE p_size < 10 INTERSECT SELECT 'intersect', p_type FROM part WHERE p_size > 40)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union without repeats, difference and intersection of two lists of inputs."""
    part = _table(spark, sf_dir, "part")
    low, high = part.where("p_size < 10"), part.where("p_size > 40")
    pair = lambda op, column: (x.select(F.lit(op).alias("op"), F.col(column).alias("value")) for x in (low, high))
    (a, b), (c, d), (e, f) = pair("union", "p_brand"), pair("except", "p_type"), pair("intersect", "p_type")
    return a.unionByName(b).distinct().unionByName(c.subtract(d)).unionByName(e.intersect(f))


@_query(stress.twin(200, 7))
def stress_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made inputs of ten kinds from a seed."""
    return stress.inputs(spark, 200, 7)
