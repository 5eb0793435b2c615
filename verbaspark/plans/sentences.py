"""Sentences made from the tables' numbers, class by class in every language, with their spoken forms in SQL.

A case has a kind, an SQL expression of the written text that both engines read, and one of the spoken text for the other engine. Names of
units, months and marks are written out here once more, so that a wrong one in the language's facts shows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.functions import lexicon as lex
from verbaspark.functions import worldwords as world
from verbaspark.operators import multilingual
from verbaspark.plans import sql_words as sql

Case = tuple[str, str, str]
N, SMALL, DAY, MINUTE = "p_partkey", "(p_size % 19 + 2)", "(p_partkey % 28 + 1)", "(p_partkey % 49 + 11)"
HOUR = "(p_size % 11 + 2)"


def text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def words(lang: str, e: str) -> str:
    if lang == "rw":
        return sql.kinyarwanda(e)
    return sql.cardinal(lang, e) if lang in ("en", "es", "fr", "de") else sql.wider_cardinal(lang, e)


def _pick(names: str, at: str) -> str:
    return f"string_split('{names}', '|')[CAST({at} AS BIGINT)]"


def _digits(lang: str, e: str) -> str:
    """The digits of a written number by name."""
    names = lex.under_1000(lang)[:10] if lang in ("en", "es", "fr", "de") else world.digit_words(lang)
    glue = "" if lang in ("zh", "ja", "ko") else " "
    return f"array_to_string(list_transform(string_split({text(e)}, ''), lambda d: {_pick('|'.join(names), 'CAST(d AS BIGINT) + 1')}), '{glue}')"


#: Decimal mark and its name, with the spaces around it.
POINTS = {
    "es": (",", " coma "), "fr": (",", " virgule "), "de": (",", " komma "), "pt": (",", " vírgula "), "it": (",", " virgola "), "sv": (",", " komma "),
    "vi": (",", " phẩy "), "hi": (".", " दशमलव "), "zh": (".", "点"), "ja": (".", "点"), "ko": (".", "점"),
}
#: A percentage: what stands before and behind the number's words.
PERCENT = {
    "es": ("", " por ciento"), "fr": ("", " pour cent"), "de": ("", " prozent"), "pt": ("", " por cento"), "it": ("", " percento"), "sv": ("", " procent"), "hu": ("", " százalék"),
    "hy": ("", " տոկոս"), "vi": ("", " phần trăm"), "ru": ("", " процентов"), "ar": ("", " في المئة"), "zh": ("百分之", ""), "ko": ("", " 퍼센트"),
}
#: Kilograms, of two and more.
KILOGRAMS = {
    "es": " kilogramos", "de": " kilogramm", "pt": " quilos", "it": " chilogrammi", "sv": " kilogram", "hu": " kilogramm", "vi": " ki lô gam", "hi": " किलोग्राम", "zh": "千克", "ko": " 킬로그램",
}
#: Written sign, and the currency's name of two and more.
MONEY = {
    "es": ("$", " dólares"), "de": ("$", " dollar"), "pt": ("R$ ", " reais"), "it": ("€", " euro"), "sv": ("€", " euro"), "hu": ("$", " dollár"), "vi": ("$", " đô la"), "hi": ("₹", " रुपए"),
    "zh": ("$", "美元"), "ko": ("₩", "원"), "ar": ("$", " دولار"),
}
#: Between hours and minutes, and after the minutes.
CLOCKS = {"es": (" y ", ""), "de": (" uhr ", ""), "it": (" e ", " minuti"), "sv": (" ", ""), "vi": (" giờ ", " phút"), "zh": ("点", "分"), "ja": ("時", "分")}
#: Month names, and what stands between day, month and year.
MONTHS = {
    "es": ("enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre", " de "),
    "fr": ("janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre", " "),
    "pt": ("janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro", " de "),
    "it": ("gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre", " "),
}
#: A fraction: what stands between its two numbers, and whether the lower one comes first.
FRACTIONS = {"zh": ("分之", True), "ja": ("分の", True), "ko": ("분의 ", True), "hi": (" बटा ", False)}


def _shared(lang: str) -> list[Case]:
    """The classes that follow one form in most languages."""
    out = [("cardinal", f"'ab ' || {text(N)} || ' cd'", f"'ab ' || {words(lang, N)} || ' cd'"), ("word", "'ab cd ' || p_type", "'ab cd ' || p_type")]
    tens = "(p_partkey % 80 + 12)"
    tens = f"({tens} + CASE WHEN {tens} % 10 = 1 THEN 1 ELSE 0 END)"  # a one at the end has forms of its own in some languages
    digit = "(p_size % 9 + 1)"
    if lang in POINTS:
        mark, name = POINTS[lang]
        out.append(("decimal", f"'ab ' || {text(tens)} || '{mark}' || {text(digit)} || ' cd'", f"'ab ' || {words(lang, tens)} || '{name}' || {words(lang, digit)} || ' cd'"))
    if lang in PERCENT:
        before, behind = PERCENT[lang]
        out.append(("percent", f"'ab ' || {text(tens)} || '% cd'", f"'ab {before}' || {words(lang, tens)} || '{behind} cd'"))
    if lang in KILOGRAMS:
        out.append(("measure", f"'ab ' || {text(tens)} || ' kg cd'", f"'ab ' || {words(lang, tens)} || '{KILOGRAMS[lang]} cd'"))
    if lang in MONEY:
        sign, name = MONEY[lang]
        out.append(("money", f"'ab {sign}' || {text(tens)} || ' cd'", f"'ab ' || {words(lang, tens)} || '{name} cd'"))
    minute = f"({tens} % 14 + 16)"
    minute = f"({minute} + CASE WHEN {minute} % 10 = 1 THEN 1 ELSE 0 END)"
    if lang in CLOCKS:
        between, behind = CLOCKS[lang]
        out.append(("time", f"'ab ' || {text(HOUR)} || ':' || {text(minute)} || {chr(39)} Uhr cd{chr(39)}" if lang == "de" else f"'ab ' || {text(HOUR)} || ':' || {text(minute)} || ' cd'", f"'ab ' || {words(lang, HOUR)} || '{between}' || {words(lang, minute)} || '{behind} cd'"))
    if lang in MONTHS:
        names, of = MONTHS[lang]
        month, day, year = "(p_size % 12 + 1)", "(p_partkey % 19 + 2)", "(2000 + p_size + 3)"
        out.append(("date", f"'ab ' || {text(year)} || '-' || lpad({text(month)}, 2, '0') || '-' || lpad({text(day)}, 2, '0') || ' cd'", f"'ab ' || {words(lang, day)} || '{of}' || {_pick(names, month)} || '{of}' || {words(lang, year)} || ' cd'"))
    if lang in FRACTIONS:
        between, lower_first = FRACTIONS[lang]
        top, bottom = "(p_size % 9 + 1)", "(p_partkey % 17 + 3)"
        a, b = (bottom, top) if lower_first else (top, bottom)
        out.append(("fraction", f"'ab ' || {text(top)} || '/' || {text(bottom)} || ' cd'", f"'ab ' || {words(lang, a)} || '{between}' || {words(lang, b)} || ' cd'"))
    if lang == "hu":
        out.append(("money", f"'ab ' || {text(tens)} || ' Ft-ot cd'", f"'ab ' || {words(lang, tens)} || ' forintot cd'"))
        out.append(("time", f"'ab ' || {text(HOUR)} || ':12:' || lpad({text(SMALL)}, 2, '0') || ' cd'", f"'ab ' || {words(lang, HOUR)} || ' óra tizenkettő perc ' || {words(lang, SMALL)} || ' másodperc cd'"))
    if lang == "ru":
        forms = lambda e, one, few, many: f"CASE WHEN {e} % 100 BETWEEN 11 AND 14 THEN '{many}' WHEN {e} % 10 = 1 THEN '{one}' WHEN {e} % 10 BETWEEN 2 AND 4 THEN '{few}' ELSE '{many}' END"
        out.append(("measure", f"'ab ' || {text(tens)} || ' км cd'", f"'ab ' || {words(lang, tens)} || ' ' || {forms(tens, 'километр', 'километра', 'километров')} || ' cd'"))
    if lang == "ko":
        out.append(("date", f"{text('(1990 + p_size)')} || '년 ' || {text('(p_partkey % 5 + 1)')} || '월 ' || {text(DAY)} || '일'", f"{words('ko', '(1990 + p_size)')} || '년 ' || {words('ko', '(p_partkey % 5 + 1)')} || '월 ' || {words('ko', DAY)} || ' 일'"))
    if lang == "hi":
        out.append(("native digits", f"'ab ' || translate({text(N)}, '0123456789', '०१२३४५६७८९') || ' cd'", f"'ab ' || {words('hi', N)} || ' cd'"))
        out.append(("time", f"'ab ' || {text(HOUR)} || ':15 cd'", f"'ab सवा ' || {words('hi', HOUR)} || ' cd'"))
        out.append(("letters", "'ab' || ' www.abc.in'", "'ab डब्ल्यू डब्ल्यू डब्ल्यू डॉट ए बी सी डॉट इन'"))
    return out


_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"
_SUFFIX = "CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"


def _english() -> list[Case]:
    below = "(p_partkey % 1000)"
    plain = lambda e: sql.cardinal("en", e, False)
    said = lambda e: sql.cardinal("en", e)
    thousands, five, year, block, four = "(p_partkey % 900 + 12)", "(p_partkey + 10000)", "(1960 + p_size)", "(p_partkey % 590 + 201)", "(p_size + 5100)"
    digits = lambda e: _digits("en", e)
    cents = "(p_size + 10)"
    return [
        ("cardinal", f"'ab ' || {text(below)} || ' cd'", f"'ab ' || {said(below)} || ' cd'"),
        ("cardinal", f"'ab -' || {text(below)} || ' cd'", f"'ab minus ' || {said(below)} || ' cd'"),
        ("cardinal", f"'ab ' || {text(thousands)} || ',045 cd'", f"'ab ' || {said(f'({thousands} * 1000 + 45)')} || ' cd'"),
        ("digits", f"'ab ' || {text(five)} || ' cd'", f"'ab ' || {digits(five)} || ' cd'"),
        ("ordinal", f"'the ' || {text(SMALL)} || {_SUFFIX.format(n=SMALL)} || ' cd'", f"'the ' || {sql.ordinal(SMALL)} || ' cd'"),
        ("ordinal", f"'the ' || {text(SMALL)} || 'zz cd'", f"'the ' || {plain(SMALL)} || ' zz cd'"),
        ("decimal", f"'ab ' || {text(SMALL)} || '.' || {text(cents)} || ' cd'", f"'ab ' || {said(SMALL)} || ' point ' || {digits(cents)} || ' cd'"),
        ("quantity", f"'ab ' || {text(SMALL)} || '.' || {text('(p_size % 9 + 1)')} || ' million cd'", f"'ab ' || {said(SMALL)} || ' point ' || {digits('(p_size % 9 + 1)')} || ' million cd'"),
        ("fraction", f"'ab 3/' || {text('(p_size % 15 + 5)')} || ' cd'", f"'ab three ' || {sql.ordinal('(p_size % 15 + 5)')} || 's cd'"),
        ("fraction", f"'ab ' || {text(SMALL)} || ' 1/4 cd'", f"'ab ' || {said(SMALL)} || ' and one quarter cd'"),
        ("money", f"'ab $' || {text(SMALL)} || '.' || {text(cents)} || ' cd'", f"'ab ' || {said(SMALL)} || ' dollars ' || {said(cents)} || ' cents cd'"),
        ("money", f"'ab £' || {text(SMALL)} || ' cd'", f"'ab ' || {said(SMALL)} || ' pounds cd'"),
        ("money", f"'ab $' || {text(SMALL)} || '.5 billion cd'", f"'ab ' || {said(SMALL)} || ' point five billion dollars cd'"),
        ("money", f"'ab $' || {text(SMALL)} || '/mo cd'", f"'ab ' || {said(SMALL)} || ' dollars per month cd'"),
        ("range", f"'ab $' || {text(SMALL)} || '-$' || {text(cents)} || ' cd'", f"'ab ' || {said(SMALL)} || ' dollars to ' || {said(cents)} || ' dollars cd'"),
        ("range", f"'ab ' || {text(year)} || '-' || {text(f'({year} + 7)')} || ' cd'", f"'ab ' || {sql.year(year)} || ' to ' || {sql.year(f'({year} + 7)')} || ' cd'"),
        ("range", f"'ab ' || {text(SMALL)} || '-30 kg cd'", f"'ab ' || {said(SMALL)} || ' to thirty kilograms cd'"),
        ("measure", f"'ab ' || {text(SMALL)} || ' km cd'", f"'ab ' || {said(SMALL)} || ' kilometers cd'"),
        ("measure", f"'ab ' || {text(SMALL)} || '% cd'", f"'ab ' || {said(SMALL)} || ' percent cd'"),
        ("measure", f"'ab ' || {text(SMALL)} || ' km/h cd'", f"'ab ' || {said(SMALL)} || ' kilometers per H cd'"),
        ("date", f"'ab ' || {_both('January|February|March|April|May|June|July|August|September|October|November|December', '(p_size % 12 + 1)')} || ' ' || {text(DAY)} || ', ' || {text(year)} || ' cd'", f"'ab ' || {_pick(_MONTH, '(p_size % 12 + 1)')} || ' ' || {sql.ordinal(DAY)} || ', ' || {sql.year(year)} || ' cd'"),
        ("date", f"'ab ' || {text(year)} || '-' || lpad({text('(p_size % 12 + 1)')}, 2, '0') || '-' || lpad({text(DAY)}, 2, '0') || ' cd'", f"'ab ' || {_pick(_MONTH, '(p_size % 12 + 1)')} || ' ' || {sql.ordinal(DAY)} || ' ' || {sql.year(year)} || ' cd'"),
        ("date", "'ab the ' || CAST((1950 + p_size % 5 * 10) AS STRING) || 's cd'", f"'ab the nineteen ' || {_pick('fifties|sixties|seventies|eighties|nineties', '(p_size % 5 + 1)')} || ' cd'"),
        ("year", f"'in ' || {text(year)} || ' cd'", f"'in ' || {sql.year(year)} || ' cd'"),
        ("time", f"'at ' || {text(HOUR)} || ':' || {text(MINUTE)} || ' p.m. cd'", f"'at ' || {said(HOUR)} || ' ' || {said(MINUTE)} || ' PM cd'"),
        ("time", f"'at ' || {text(HOUR)} || ':00 cd'", f"'at ' || {said(HOUR)} || ' o''clock cd'"),
        ("telephone", f"'call ' || {text(block)} || '-' || {text(block)} || '-' || {text(four)} || ' now'", f"'call ' || {digits(block)} || ', ' || {digits(block)} || ', ' || {digits(four)} || ' now'"),
        ("telephone", f"'call +1 ' || {text(block)} || '-555-' || {text(four)} || ' now'", f"'call plus one, ' || {digits(block)} || ', five five five, ' || {digits(four)} || ' now'"),
        ("electronic", f"'mail ann' || {text(SMALL)} || '@post.org now'", f"'mail ann ' || {digits(SMALL)} || ' at post dot org now'"),
        ("electronic", f"'see www.shop.net/x-' || {text(SMALL)} || ' now'", f"'see WWW dot shop dot net slash x dash ' || {digits(SMALL)} || ' now'"),
        ("whitelist", "'Dr. Who has ' || p_type", "'doctor Who has ' || p_type"),
        ("whitelist", "'the U.S.A. team'", "'the USA team'"),
        ("math", f"'y = x + ' || {text(SMALL)}", f"'y equals x plus ' || {said(SMALL)}"),
        ("math", f"{text(SMALL)} || '+3=' || {text(f'({SMALL} + 3)')}", f"{said(SMALL)} || ' plus three equals ' || {said(f'({SMALL} + 3)')}"),
        ("roman", f"'Chapter ' || {_both('II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX', '(p_partkey % 18 + 1)')} || ' ends'", f"'Chapter ' || {said('(p_partkey % 18 + 2)')} || ' ends'"),
        ("serial", f"'model B' || {text(SMALL)} || 'C cd'", f"'model B ' || {said(SMALL)} || ' C cd'"),
        ("address", f"{text(block)} || ' Oak St, cd'", f"CASE WHEN {block} // 10 % 10 = 0 THEN {digits(block)} ELSE {said(f'({block} // 100)')} || ' ' || {said(f'({block} % 100)')} END || ' Oak Street, cd'"),
        ("markup", f"'go <noise/> ' || {text(SMALL)}", f"'go <noise/> ' || {said(SMALL)}"),
        ("markup", f"'say [HH AH0 L OW1] ' || {text(SMALL)}", f"'say [HH AH0 L OW1] ' || {said(SMALL)}"),
        ("symbol", f"'#best & ' || {text(SMALL)}", f"'hash best and ' || {said(SMALL)}"),
        ("symbol", "'use C++ or ask @bob'", "'use C plus plus or ask at bob'"),
        ("punctuation", f"'``ab'', (cd); ' || {text(SMALL)} || '!'", f"'\"ab'', (cd); ' || {said(SMALL)} || '!'"),
        ("native digits", f"'ab ' || translate({text(SMALL)}, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' cd'", f"'ab ' || {said(SMALL)} || ' cd'"),
        ("sentinel", f"{_PRIVATE} || ' ' || {text(SMALL)}", f"{_PRIVATE} || ' ' || {said(SMALL)}"),
    ]


#: A character for private use, which marks may stand for in a caller's texts.
_PRIVATE = "'\ue000'"


def _both(names: str, at: str) -> str:
    """One of several names, in SQL that both engines read."""
    return f"split_part('{names}', '|', CAST({at} AS INT))"


def cases(lang: str) -> list[Case]:
    return _english() if lang == "en" else _shared(lang)


#: Cases that are made in one step: code for all at once is too long for the JVM to compile.
GROUP = 15


def spoken(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """p_partkey, case, kind and spoken form of every sentence of a language, by the language's rules."""
    from verbaspark.plans.registry import _spread, _table

    part = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"))
    made = [F.struct(F.lit(k).alias("case"), F.lit(kind).alias("kind"), F.expr(written).alias("written")) for k, (kind, written, _) in enumerate(cases(lang))]
    parts = [part.select("p_partkey", F.explode(F.array(*made[k : k + GROUP])).alias("r")) for k in range(0, len(made), GROUP)]
    rows = functools.reduce(DataFrame.unionAll, parts).select("p_partkey", "r.*").withColumn("lang", F.lit(lang))
    return multilingual.normalize(rows, "lang", "written", "spoken").select("p_partkey", "case", "kind", "spoken")


def twin(lang: str) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey, {k} AS \"case\", '{kind}' AS kind, {said} AS spoken FROM part" for k, (kind, _, said) in enumerate(cases(lang)))
