"""The command line, the parity job, made inputs, and rules that hold for every text."""

import io
import json
import random

from pyspark.sql import functions as F

from verbaspark import __main__ as command
from verbaspark import api
from verbaspark.functions import text
from verbaspark.operators import english, multilingual
from verbaspark.plans import parity, reports, stress
from verbaspark.sources import readers


def run(*arguments, lines=""):
    out = io.StringIO()
    return command.main(list(arguments), io.StringIO(lines), out), out.getvalue()


def test_command_line(capsys):
    assert run("--lang", "es-MX", "3 gatos", "nada") == (0, "tres gatos\nnada\n")
    assert run(lines="2 cats\n\nnone\n") == (0, "two cats\n\nnone\n")
    assert run("--lang", "xx", "a")[0] == 1 and run("--max-permutations", "0", "a")[0] == 1 and "ValueError" in capsys.readouterr().err
    request = "\t".join(["fr", "cased", "1", "729", "0", "1", "7 chats".encode().hex()])
    code, out = run("--batch", lines=f"{request}\nbad\n")
    assert code == 0 and out.splitlines() == [f"OK\t{'sept chats'.encode().hex()}", f"ERR\tValueError\t{b'seven fields parted by tabs are expected'.hex()}"]


def test_lines_by_spark(spark, tmp_path):
    (tmp_path / "in.txt").write_text("4 Hunde\nnichts\n")
    assert run("--lang", "de", "--input", f"{tmp_path}/in.txt", "--output", f"{tmp_path}/out")[0] == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["nichts", "vier Hunde"]


def test_parity(spark, tmp_path, capsys):
    cases = [("a", "en", "cardinal", "9 cats", "nine cats", None), ("b", "en", "cardinal", "8 cats", "ate cats", None), ("c", "xx", "cardinal", "1", None, "E: x"), ("d", "fr", "word", "rien", None, "E: y"), ("e", "en", "mark", "a , 1", "a , one", None)]
    names = ("id", "lang", "category", "input", "expected", "reference_error")
    (tmp_path / "s.json").write_text(json.dumps({"cases": [dict(zip(names, c, strict=True)) for c in cases]}))
    judged = parity.judged(parity.recorded(spark, f"{tmp_path}/s.json"))
    assert {r.id: r.outcome for r in judged.collect()} == {"a": "exact", "b": "mismatch", "c": "both_reject", "d": "reference_rejects_only", "e": "exact"}
    assert run("--parity", f"{tmp_path}/s.json")[0] == 0 and "cardinal" in capsys.readouterr().out
    (tmp_path / "en").mkdir()
    (tmp_path / "en" / "test_cases_number.txt").write_text("5~five~V\n6~sex\n")
    rows = parity.tally(parity.classes(spark, f"{tmp_path}/en/*.txt")).collect()
    assert ("en", "number", 2, 1) in [tuple(r) for r in rows]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", "en", "x", "y"), ("2", "en", "é", None), ("3", "fr", None, "z")], "id string, lang string, input string, expected string")
    readers.write_snapshot(df, f"{tmp_path}/s")
    readers.write_jsonl(df, f"{tmp_path}/l")
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, readers.snapshot(spark, f"{tmp_path}/s").select(df.columns).collect())) == want
    assert sorted(map(str, readers.jsonl(spark, f"{tmp_path}/l", "id string, lang string, input string, expected string").collect())) == want


def test_warm_and_options():
    api.warm("ko-KR")
    for wrong in ("xx", "tlh-US"):
        try:
            api.warm(wrong)
        except ValueError as e:
            assert "unsupported" in str(e)
    assert api.normalize_text("\x00") == "\x00" and api.normalize_text("1\x002") == "twelve" and api.normalize_text("\x00", "es") == "\x00"


def test_columns_equal_rows_on_odd_texts(spark):
    """A text whose trigger the native test misses would stay as it is: every made text must come out as it does alone."""
    r = random.Random(11)
    parts = ["٣", "３", "²", "½", "ſection IV", "Section iv", "é.com", "a.com", "x_y.txt", "é_é.txt", "=", "y=x", "+1", "++", "C++", "#", "#ab", "$", "€", "/", "a/b", "www.", "Dr. Who", "``q``", "U.S.A.", "[HH AH0]", "<x>", "\x00", "​", "K", "&", "a & b", " ", "  ", "\n", "word", "éa", ".", ",", "@", "tag@", "ii", "act II", "%", "ß"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 6))), lang) for i in range(700) for lang in ("en", "es", "zh")]
    rows += [(x.id, x.text, lang) for x in stress.inputs(spark, 40, 3).collect() for lang in ("en", "hi", "ko")]
    got = multilingual.normalize(spark.createDataFrame(rows, "i long, t string, l string"), "l", "t", "s").select("t", "l", "s").collect()
    bad = [(x.t, x.l, x.s, multilingual.normalize_one(x.t, x.l)) for x in got if x.s != multilingual.normalize_one(x.t, x.l)]
    assert not bad, bad[:5]
    alone = english.normalize(spark.createDataFrame(rows, "i long, t string, l string"), "t", "s").select("t", "s").distinct().collect()
    assert all(x.s == english.normalize_one(x.t) for x in alone)


def test_predicates_and_ratios(spark):
    df = spark.createDataFrame([("$",), ("a",), ("漢",), ("",), (None,)], "c string")
    got = [tuple(r) for r in df.select(text.currency(F.col("c")), text.letter(F.col("c")), text.matches_ranges(F.col("c"), [(0x4E00, 0x9FFF)])).collect()]
    assert got == [(True, False, False), (False, True, False), (False, True, True), (False, False, False), (None, None, None)]
    runs = spark.createDataFrame([("en", "a", 4.0), ("en", "a", 6.0), ("en", "b", 2.0), ("fr", "a", 1.0)], "lang string, engine string, s double")
    assert {r.lang: (r.base_median, r.other_median, r.speedup) for r in reports.speedups(runs, "lang", "engine", "s", "a", "b").collect()} == {"en": (5.0, 2.0, 2.5), "fr": (1.0, None, None)}
