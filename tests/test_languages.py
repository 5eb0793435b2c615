"""Sixteen languages, the steps around them, readers, the batch protocol, streams and SQL."""

import gzip
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaspark import api
from verbaspark.functions import numbers, worldwords
from verbaspark.operators import multilingual, spacing, tokens, transducer
from verbaspark.plans import reports, sql_words
from verbaspark.sources import protocol, readers
from verbaspark.streaming import lines

SENTENCES = [
    ("es", "Vale 3,5 kg o 12 €.", "Vale tres coma cinco kilogramos o doce euros."),
    ("es", "la 21.ª de 3/5", "la vigesimoprimera de tres quintos"),
    ("fr", "Le 1er mai 2024, 71 lots", "Le premier mai deux mille vingt-quatre, soixante et onze lots"),
    ("de", "Um 9:05 Uhr 4 kg für $3,20", "Um neun uhr fünf vier kilogramm für drei dollar zwanzig cent"),
    ("pt", "R$ 3,07 e 2 km", "três reais e sete centavos e dois quilômetros"),
    ("it", "sono 21 € e 8%", "sono ventuno euro e otto percento"),
    ("sv", "2,5 kg och 31", "två komma fem kilogram och trettioett"),
    ("hu", "Itt 2,5 van", "Itt kettő egész öt tized van"),
    ("vi", "lúc 9:05 có 24 kg", "lúc chín giờ năm phút có hai mươi tư ki lô gam"),
    ("zh", "2025-01-05有3/4和7%", "二零二五年一月五日有四分之三和百分之七"),
    ("ja", "午後1234円で3/4", "午後千二百三十四円で四分の三"),
    ("ko", "사과 21개", "사과 이십일 개"),
    ("ru", "дом 22-й и 1,5", "дом двадцать второй и одна целая пять десятых"),
    ("hi", "२५ और 7वीं", "पच्चीस और सातवीं"),
    ("rw", "abantu 19", "abantu cumi n'icyenda"),
    ("ar", "21", "واحد وعشرون"),
    ("hy", "1234", "հազար երկու հարյուր երեսունչորս"),
    ("es", "sin cifras", "sin cifras"),
]


@pytest.mark.parametrize(("lang", "written", "spoken"), SENTENCES)
def test_sentences(lang, written, spoken):
    assert multilingual.normalize_one(written, lang) == spoken


def test_columns_equal_rows(spark):
    rows = [(i, lang, w) for i, (lang, w, _) in enumerate(SENTENCES)] + [(90, "es", None), (91, "es", "  "), (92, "xx", "1"), (93, None, "1"), (94, "en", "2 cats")]
    got = {r.i: r.spoken for r in multilingual.normalize(spark.createDataFrame(rows, "i int, lang string, text string")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(SENTENCES)} | {90: None, 91: "  ", 92: None, 93: None, 94: "two cats"}


NUMBERS = [0, 1, 2, 10, 11, 15, 16, 21, 28, 80, 100, 101, 110, 999, 1000, 1001, 1010, 1100, 2000, 2010, 10000, 10010, 12345, 100000, 110000, 101001, 999999, 1000000, 21000000, 1001001001, -7, 123456789012]
LARGE = [10**12, 10**12 + 10**9 + 1, 987654321098765, 10**15, 10**15 + 5, 123456 * 10**13, -(10**16) - 20, 10**18 + 10**9 + 1, 2**63 - 1]


@pytest.mark.parametrize("lang", sorted(worldwords.TONGUES))
def test_number_columns(spark, lang):
    df = spark.createDataFrame([(n,) for n in [*NUMBERS, *LARGE, -(2**63), None]], "n long").select("n", numbers.cardinal(F.col("n"), lang).alias("w"))
    got = {r.n: r.w for r in df.collect()}
    assert got.pop(-(2**63)).startswith(worldwords.TONGUES[lang].minus)
    assert got == {n: worldwords.words(n, lang) for n in [*NUMBERS, *LARGE]} | {None: None}


@pytest.mark.parametrize("lang", sql_words.WIDER)
def test_number_twins(lang):
    span = "list_concat(range(0, 12000), range(12001, 1000000, 9973))"
    rows = duckdb.sql(f"SELECT n, {sql_words.wider_cardinal(lang, 'n')} FROM (SELECT unnest({span})::BIGINT AS n)").fetchall()
    assert all(said == worldwords.words(n, lang) for n, said in rows)


def test_spacing(spark):
    assert spacing.detokenize_one("He said , \" go \" ( now ) it 's $ 5 .", "en") == 'He said, "go" (now) it\'s $5.'
    assert spacing.detokenize_one("l' eau : oui !", "fr") == "l'eau : oui !"
    assert spacing.detokenize_one("漢 字 a", "zh") == "漢字 a" and spacing.detokenize_one("", "en") == ""
    assert spacing.align_one("the 3 dogs' bowls", "the three dogs 'bowls") == "the three dogs' bowls"
    assert spacing.align_one("a-b , c", "a - b, c") == "a-b , c"
    row = spark.createDataFrame([("a , b", "en", "a,b"), (None, "en", None)], "t string, l string, s string")
    got = row.select(spacing.detokenize(F.col("t"), F.col("l")).alias("d"), spacing.align(F.col("t"), F.col("s")).alias("m")).collect()
    assert tuple(got[0]) == ("a, b", "a , b") and tuple(got[1]) == (None, None)


def test_tokens():
    tree = tokens.parse('tokens { measure { units: "km" decimal: "7" } } tokens { name: "a "b" } tokens { date { day: "" preserve_order: true } }')
    assert tree[0] == {"tokens": {"measure": {"units": "km", "decimal": "7"}}} and tree[1] == {"tokens": {"name": 'a "b'}}
    assert tree[2]["tokens"]["date"] == {"day": None, "preserve_order": True}
    assert [tokens.orders(t) for t in tree] == [2, 1, 2]
    assert [len(g) for g in tokens.bounded_groups(tree[:1] * 5, 4)] == [2, 2, 1]
    assert len(list(tokens.candidates(tree[:2]))) == 2
    r = random.Random(1)
    for _ in range(300):
        sizes = [r.randint(1, 4) for _ in range(r.randint(0, 9))]
        groups = tokens.bounded_groups([{f"k{i}": "v" for i in range(n)} for n in sizes], 48)
        assert [len(t) for g in groups for t in g] == sizes
        products = [math.prod(math.factorial(len(t)) for t in g) for g in groups]
        assert all(p <= 48 for p in products) and all(p * math.factorial(len(g[0])) > 48 for p, g in zip(products, groups[1:], strict=False))
    with pytest.raises(ValueError):
        tokens.bounded_groups(tree, 1)
    with pytest.raises(ValueError):
        tokens.serializations(tree[2])
    for bad in ("tokens {", "}", "tokens", "a: true", 'preserve_order: "x" '):
        with pytest.raises(tokens.ParseError):
            tokens.parse(bad)


def test_first_success(spark):
    """The first order that the verbalizer takes; the source with its marks escaped where none is."""
    tagged = 'tokens { measure { units: "km" decimal: "7" } } tokens { name: "on" }'
    tried = []

    def verbalize(order):
        tried.append(order)
        if 'units: "km" decimal' in order:
            raise transducer.NoPathError("no")
        return "seven kilometers  on"

    assert tokens.first_success(tagged, "7 km [on]", verbalize) == "seven kilometers on" and len(tried) == 2
    assert tokens.first_success('tokens { name: "" }', "a [b]\\", str) == "a \\[b\\]\\\\"
    with pytest.raises(tokens.ParseError):
        tokens.first_success("tokens {", "x", str)
    graph = transducer.Graph([(0, 0, b, b, 0) for b in range(1, 256) if b != ord("k")], {0: 0})
    rows = [('tokens { name: "on" }', "on"), ('tokens { name: "km" }', "[km]"), ("}", "x"), (None, "y")]
    got = spark.createDataFrame(rows, "t string, s string").select(tokens.spoken_tokens(F.col("t"), F.col("s"), graph).alias("r")).select("r.*").collect()
    assert "on" in got[0].output and got[1].output == "\\[km\\]" and got[2].error.startswith("ParseError") and tuple(got[3]) == (None, None)
    spark.udtf.register("token_rows", tokens.token_rows)
    listed = spark.sql(f"SELECT * FROM token_rows('{tagged}') ORDER BY place").collect()
    assert [tuple(r) for r in listed] == [(0, "measure", '{"units": "km", "decimal": "7"}'), (1, "name", '"on"')]


def brute_paths(edges, finals, text):
    """(cost, output) of every path, for graphs without cycles."""
    out, data = [], text.encode()

    def walk(state, at, cost, said):
        if at == len(data) and state in finals:
            out.append((float(np.float32(cost + np.float32(finals[state]))), said))
        for source, target, read, write, weight in edges:
            if source == state and (not read or at < len(data) and data[at] == read):
                walk(target, at + bool(read), np.float32(cost + np.float32(weight)), said + bytes([write] * bool(write)))

    walk(0, 0, np.float32(0), b"")
    return out


def test_transducer(spark):
    tie = [(0, 1, 98, 113, 0), (0, 2, 98, 114, 0)]
    assert transducer.Graph(tie, {1: 0, 2: 0}).rewrite("b") == "r"
    assert transducer.Graph(tie, {1: 0, 2: 0}, project_output=True).rewrite("b") == "q"
    loop = transducer.Graph([(0, 1, 0, 0, 0), (1, 0, 0, 0, 1), (0, 2, 97, 122, 0)], {2: 0})
    assert loop.rewrite("\x00a") == "z"
    with pytest.raises(ValueError, match="negative"):
        transducer.Graph([(0, 1, 0, 0, -2), (1, 0, 0, 0, 1), (0, 2, 97, 122, 0)], {2: 0}).rewrite("a")
    got = spark.createDataFrame([("a",), ("b",), (None,)], "t string").select(transducer.rewrite(F.col("t"), loop).alias("r")).select("r.*").collect()
    assert got[0].output == "z" and got[1].error.startswith("NoPathError") and tuple(got[2]) == (None, None)
    r, accepted = random.Random(3), 0
    for _ in range(600):
        size = r.randint(2, 5)
        edges = [(a, r.randint(a + 1, size), r.choice([0, 97, 97, 98]), r.choice([0, 120, 121]), r.choice([0, 0.1, 1, -0.5])) for a in (r.randrange(size) for _ in range(r.randint(1, 10)))]
        finals, text = {r.randint(0, size): r.choice([0, 0.5]) for _ in range(2)}, "".join(r.choice("ab") for _ in range(r.randint(0, 3)))
        paths = brute_paths(edges, finals, text)
        for project in (False, True):
            graph = transducer.Graph(edges, finals, project_output=project)
            if not paths:
                with pytest.raises(transducer.NoPathError):
                    graph.rewrite(text)
                continue
            accepted += 1
            best = min(c for c, _ in paths)
            assert graph.rewrite(text).encode() in {o for c, o in paths if abs(c - best) < 1e-6}
    assert accepted > 200


def test_graph_files(spark, tmp_path):
    edges, finals = [(0, 1, 97, 120, 0.5), (1, 0, 0, 45, 0.25), (0, 0, 98, 121, 0)], {1: 0.125}
    raw = transducer.write_graph(edges, finals, b"MYGRAPH1")
    assert transducer.read_graph(raw, b"MYGRAPH1").rewrite("aba") == "x-yx" and transducer.read_graph(gzip.decompress(raw)).finals == {1: np.float32(0.125)}
    (tmp_path / "g.gz").write_bytes(raw)
    rows = transducer.graph_edges(spark, str(tmp_path), b"MYGRAPH1").collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(edges) and rows[0].file == "g.gz"
    plain = gzip.decompress(raw)
    for bad in (b"", plain[:-1], plain + b"\0", b"OTHERTAG" + plain[8:], plain[:8] + b"\xff" * 4 + plain[12:], plain[:20] + b"\x09" + plain[21:]):
        with pytest.raises(ValueError):
            transducer.read_arrays(bad, b"MYGRAPH1")


def test_spacing_columns(spark):
    """Columns and rows join alike, with quotes and without."""
    r = random.Random(1)
    parts = ["a", "bs", "l'", "'s", "'", '"', "„", "“", "``", "(", "[", "¿", ")", ".", ",", "?", "!", "%", "$", "€", "漢", "字a", "b漢", "가", "@-@", "12", "...", "$$", "?!", "\u3000", "\u001c"]
    rows = [(i, " ".join(r.choice(parts if i % 2 else [p for p in parts if not set(p) & set("'\"„“`")]) for _ in range(r.randint(0, 9))), lang) for i in range(600) for lang in ("en", "fr", "it", "zh", "ko", None)]
    got = spark.createDataFrame(rows, "i int, t string, l string").select("t", "l", spacing.detokenize(F.col("t"), F.col("l")).alias("d")).collect()
    assert all(x.d == spacing.detokenize_one(x.t, x.l) for x in got)


def test_front_door(spark):
    assert [api.normalize_text(x) for x in (None, "", "  ", 0, 42)] == [None, "", "  ", 0, "forty two"]
    assert api.Normalizer("pt_BR").normalize_list(["2", " "]) == ["dois", ""]
    for wrong in (lambda: api.language_of("xx-XX"), lambda: api.Normalizer("en", "lower_cased"), lambda: api.Normalizer(max_number_of_permutations_per_split=0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(NotImplementedError):
        api.normalize_text("a", "xx", return_spans=True)
    with pytest.raises(TypeError):
        api.Normalizer().normalize(3)
    df = spark.createDataFrame([("3", "es-MX"), ("3", "xx"), (None, "es")], "t string, l string")
    got = df.select(api.try_normalize(F.col("t"), F.col("l")).alias("r")).select("r.*").collect()
    assert got[0].output == "tres" and got[1].error.startswith("ValueError") and tuple(got[2]) == (None, None)
    api.register(spark)
    assert spark.sql("SELECT normalize_text('7 km', 'de-DE') AS a, detokenize('a .', 'en') AS b, match_spaces('a. b', 'a . b') AS c").first() == ("sieben kilometer", "a.", "a. b")


def test_protocol(spark):
    good = "\t".join(["de", "cased", "1", "729", "0", "1", "3 Hunde".encode().hex()])
    rows = [good, "a\tb", good.replace("de", "xx"), good[:-14] + "ff", good[:-1], None]
    got = [r.reply for r in protocol.replies(spark.createDataFrame([(r,) for r in rows], "line string")).collect()]
    assert bytes.fromhex(got[0].split("\t")[1]).decode() == "drei Hunde" and got[5] is None
    assert [g.split("\t")[1] for g in got[1:5]] == ["ValueError", "ValueError", "UnicodeError", "ValueError"]


def test_readers(spark, tmp_path):
    (tmp_path / "xx.txt").write_text("num|a|b\n\n")
    (tmp_path / "c.txt").write_text("1~one~uno\nplain\n")
    (tmp_path / "b.txt").write_text("~1\none\nuno\n~2\ntwo\n")
    (tmp_path / "s.json").write_text('{"cases": [{"id": "a", "lang": "en", "input": "1", "expected": "one", "reference_seconds": 0.5}]}')
    assert readers.categories(spark, f"{tmp_path}/xx.txt").first() == ("xx", "num", "a|b")
    assert readers.cases(spark, f"{tmp_path}/c.txt").first()[1:] == ("1", ["one", "uno"])
    assert readers.cases(spark, f"{tmp_path}/c.txt", answer_first=True).first()[1:] == ("uno", ["1", "one"])
    assert [tuple(r)[2:] for r in readers.blocks(spark, f"{tmp_path}/b.txt").orderBy("place").collect()] == [("1", ["one", "uno"]), ("2", ["two"])]
    assert readers.snapshot(spark, f"{tmp_path}/s.json").first().expected == "one"


def test_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("tengo 3\n\nnada\n")
    out = lines.spoken_lines(lines.read_lines(spark, f"{tmp_path}/in"), "es-ES")
    lines.write_lines(out, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["", "nada", "tengo tres"]


def test_reports(spark):
    rows = [("en", "a", "a", None, "a", None, 1.0), ("en", "b", None, "e", None, "f", 3.0), ("de", "c", "c", None, "d", None, 2.0)]
    df = spark.createDataFrame(rows, "lang string, input string, o string, e string, x string, xe string, seconds double")
    df = df.withColumn("outcome", reports.outcome(F.col("o"), F.col("e"), F.col("x"), F.col("xe")))
    assert {(r.lang, r.outcome): r.cases for r in reports.tally(df).collect()}[None, None] == 3
    assert tuple(reports.summary(df).where("lang = 'en'").first()) == ("en", 2, 1, 1, 2, 2.0)
    assert [r.input for r in reports.compare(df, df.where("lang = 'en'"), ["input"], "outcome").collect()] == ["c"]
