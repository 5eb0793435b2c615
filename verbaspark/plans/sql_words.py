"""Number words in SQL, written out from the small lists by arithmetic: the other way to the same words."""

from __future__ import annotations

from verbaspark.functions import lexicon as lex
from verbaspark.functions import worldwords as world


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TABLES = {form: _list(lex.under_1000(form)[:100]) for form in ("en", "es", "fr", "fr_short", "de")}


def under_1000(lang: str, g: str) -> str:
    """SQL for 1..999."""
    low = f"{_TABLES[lang]}[CAST(({g}) % 100 AS BIGINT) + 1]"
    high = f"(({g}) // 100)"
    if lang == "en":
        head = f"{_TABLES['en']}[CAST({high} AS BIGINT) + 1] || ' hundred'"
    elif lang == "es":
        head = f"CASE WHEN ({g}) = 100 THEN 'cien' ELSE {_list(lex.ES_HUNDREDS)}[CAST({high} AS BIGINT) + 1] END"
    elif lang.startswith("fr"):
        plural = "" if lang == "fr_short" else f" || CASE WHEN ({g}) >= 200 AND ({g}) % 100 = 0 THEN 's' ELSE '' END"
        head = f"CASE WHEN {high} = 1 THEN 'cent' ELSE {_TABLES['fr']}[CAST({high} AS BIGINT) + 1] || ' cent' END{plural}"
    else:
        head = f"CASE WHEN {high} = 1 THEN 'ein' ELSE {_TABLES['de']}[CAST({high} AS BIGINT) + 1] END || ' hundert'"
    return f"concat_ws(' ', CASE WHEN {high} > 0 THEN {head} END, CASE WHEN ({g}) % 100 > 0 THEN {low} END)"


def cardinal(lang: str, n: str, joined: bool = True) -> str:
    """SQL for the words of a whole number of 0 to 999,999,999."""
    g0, g1, g2 = f"({n} % 1000)", f"({n} // 1000 % 1000)", f"({n} // 1000000)"
    if lang == "en":
        last = under_1000("en", g0)
        if joined:
            last = f"CASE WHEN {g0} >= 100 AND {g0} % 100 > 0 THEN {_TABLES['en']}[CAST({g0} // 100 AS BIGINT) + 1] || ' hundred and ' || {_TABLES['en']}[CAST({g0} % 100 AS BIGINT) + 1] WHEN {g0} < 100 AND {g1} > 0 THEN 'and ' || {last} ELSE {last} END"
        parts = [f"CASE WHEN {g2} > 0 THEN {under_1000('en', g2)} || ' million' END", f"CASE WHEN {g1} > 0 THEN {under_1000('en', g1)} || ' thousand' END", f"CASE WHEN {g0} > 0 THEN {last} END"]
        zero = "zero"
    elif lang == "es":
        short = lambda g: f"regexp_replace(regexp_replace({under_1000('es', g)}, 'veintiuno$', 'veintiún'), 'uno$', 'un')"
        parts = [f"CASE WHEN {g2} = 1 THEN 'un millón' WHEN {g2} > 1 THEN {short(g2)} || ' millones' END", f"CASE WHEN {g1} = 1 THEN 'mil' WHEN {g1} > 1 THEN {short(g1)} || ' mil' END", f"CASE WHEN {g0} > 0 THEN {under_1000('es', g0)} END"]
        zero = "cero"
    elif lang == "fr":
        parts = [f"CASE WHEN {g2} = 1 THEN 'un million' WHEN {g2} > 1 THEN {under_1000('fr', g2)} || ' millions' END", f"CASE WHEN {g1} = 1 THEN 'mille' WHEN {g1} > 1 THEN {under_1000('fr_short', g1)} || ' mille' END", f"CASE WHEN {g0} > 0 THEN {under_1000('fr', g0)} END"]
        zero = "zéro"
    else:
        parts = [f"CASE WHEN {g2} = 1 THEN 'eine million' WHEN {g2} > 1 THEN {under_1000('de', g2)} || ' millionen' END", f"CASE WHEN {g1} = 1 THEN 'ein tausend' WHEN {g1} > 1 THEN {under_1000('de', g1)} || ' tausend' END", f"CASE WHEN {g0} > 0 THEN {under_1000('de', g0)} END"]
        zero = "null"
    return f"CASE WHEN {n} = 0 THEN '{zero}' ELSE concat_ws(' ', {', '.join(parts)}) END"


def ordinal(n: str) -> str:
    words = cardinal("en", n, joined=False)
    for a, b in lex.EN_ORDINALS.items():
        words = f"regexp_replace({words}, '{a}$', '{b}')"
    return f"regexp_replace(CASE WHEN regexp_matches({words}, '({'|'.join(lex.EN_ORDINALS.values())})$') THEN {words} ELSE regexp_replace({words}, 'y$', 'ie') || 'th' END, 'ieth$', 'ieth')"


def year(n: str) -> str:
    low = f"({n} % 100)"
    table = _TABLES["en"]
    return f"CASE WHEN {n} % 1000 < 10 THEN {table}[{n} // 1000 + 1] || ' thousand' || CASE WHEN {n} % 10 > 0 THEN ' ' || {table}[{n} % 10 + 1] ELSE '' END ELSE {table}[{n} // 100 + 1] || ' ' || CASE WHEN {low} = 0 THEN 'hundred' WHEN {low} < 10 THEN 'oh ' || {table}[{low} + 1] ELSE {table}[{low} + 1] END END"


def digits(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda d: {_TABLES['en']}[CAST(d AS BIGINT) + 1]), ' ')"


def _low(lang: str, g: str, feminine: bool = False) -> str:
    """SQL for 0..999 of a language of the wider set; null for 0."""
    name = {"pt": world._pt, "it": world._it, "sv": world._sv, "hu": world._hu, "hy": world._hy, "vi": world._vi, "ru": lambda n: world._ru(n, feminine), "ar": world._ar, "hi": world._hi}[lang]
    low = f"CASE WHEN ({g}) % 100 > 0 THEN {_list([name(n) for n in range(100)])}[CAST(({g}) % 100 AS BIGINT) + 1] END"
    high = f"CASE WHEN ({g}) > 99 THEN {_list(['_', *[name(100 * n) for n in range(1, 10)]])}[CAST(({g}) // 100 AS BIGINT) + 1] END"
    if lang == "pt":
        high = f"CASE WHEN ({g}) > 100 AND ({g}) < 200 THEN 'cento' ELSE {high} END"
    if lang == "vi":
        low = f"CASE WHEN ({g}) > 99 AND ({g}) % 100 BETWEEN 1 AND 9 THEN 'linh ' ELSE '' END || {low}"
    glue = {"pt": " e ", "sv": "", "hu": "", "ar": " و"}.get(lang, " ")
    return f"nullif(concat_ws('{glue}', {high}, {low}), '')"


def _thousands(lang: str, g: str) -> str:
    small = _low(lang, g, feminine=True)
    if lang == "ru":
        form = f"CASE WHEN ({g}) % 100 BETWEEN 11 AND 14 THEN 'тысяч' WHEN ({g}) % 10 = 1 THEN 'тысяча' WHEN ({g}) % 10 BETWEEN 2 AND 4 THEN 'тысячи' ELSE 'тысяч' END"
        return f"{small} || ' ' || {form}"
    if lang == "ar":
        return f"CASE WHEN ({g}) = 1 THEN 'ألف' WHEN ({g}) = 2 THEN 'ألفان' WHEN ({g}) <= 10 THEN {small} || ' اَلاف' ELSE {small} || ' ألف' END"
    one, many = {"pt": ("mil", " mil"), "it": ("mille", "mila"), "sv": ("tusen", "tusen"), "hu": ("ezer", "ezer"), "hy": ("հազար", " հազար"), "vi": ("một nghìn", " nghìn"), "hi": ("एक हज़ार", " हज़ार")}[lang]
    return f"CASE WHEN ({g}) = 1 THEN '{one}' ELSE {small} || '{many}' END"


def _eastern(lang: str, n: str) -> str:
    """Digit by digit, 0..99,999,999."""
    names = world.digit_words(lang)

    def four(g: str, low: bool) -> str:
        parts = []
        for k, sign in enumerate("천백십" if lang == "ko" else "千百十"):
            size = 10 ** (3 - k)
            d = f"(({g}) // {size} % 10)"
            said = f"{_list(names)}[CAST({d} AS BIGINT) + 1] || '{sign}'"
            if lang == "zh":
                bare = f"({g}) < 20" + (f" AND {n} < 20" if low else "")
                lead = f"CASE WHEN ({g}) >= {size * 100} AND (({g}) // {size * 10} % 10) = 0 THEN '零' ELSE '' END || " if k else ""
                said = f"{lead}" + (f"CASE WHEN {bare} THEN '十' ELSE {said} END" if sign == "十" else said)
            else:
                keep = f" AND NOT (({g}) {'= 1000' if low else '> 0'})" if lang == "ja" and k == 0 else ""
                said = f"CASE WHEN {d} = 1{keep} THEN '{sign}' ELSE {said} END"
            parts.append(f"CASE WHEN {d} > 0 THEN {said} ELSE '' END")
        d = f"(({g}) % 10)"
        lead = f"CASE WHEN ({g}) >= 100 AND (({g}) // 10 % 10) = 0 THEN '零' ELSE '' END || " if lang == "zh" else ""
        parts.append(f"CASE WHEN {d} > 0 THEN {lead}{_list(names)}[CAST({d} AS BIGINT) + 1] ELSE '' END")
        return " || ".join(parts)

    high, low = f"({n} // 10000)", f"({n} % 10000)"
    sign = "만" if lang == "ko" else "万"
    top = f"CASE WHEN {high} = 0 THEN '' " + (f"WHEN {high} = 1 THEN '{sign}' " if lang == "ko" else "") + f"ELSE {four(high, False)} || '{sign}' END"
    gap = f"CASE WHEN {high} > 0 AND {low} BETWEEN 1 AND 999 THEN '零' ELSE '' END || " if lang == "zh" else ""
    return f"CASE WHEN {n} = 0 THEN '{names[0]}' ELSE {top} || {gap}{four(low, True)} END"


#: Languages of the wider set with a twin.
WIDER = ("pt", "it", "sv", "hu", "hy", "vi", "ru", "ar", "hi", "zh", "ja", "ko")


def wider_cardinal(lang: str, n: str) -> str:
    """SQL for 0 to 999,999 (Hindi: 9,999,999; zh, ja, ko: 99,999,999)."""
    if lang in ("zh", "ja", "ko"):
        return _eastern(lang, n)
    g0, g1 = f"({n} % 1000)", f"({n} // 1000)"
    last = _low(lang, g0)
    glue = "''"
    if lang == "pt":
        glue = f"CASE WHEN {g0} < 100 OR {g0} % 100 = 0 THEN ' e ' ELSE ' ' END"
    elif lang == "vi":
        glue = f"CASE WHEN {g0} < 10 THEN ' linh ' ELSE ' ' END"
    elif lang == "hu":
        glue = f"CASE WHEN {n} > 2000 THEN '-' ELSE '' END"
    else:
        glue = {"ar": "' و'"}.get(lang, "' '")
    high = _thousands(lang, g1)
    if lang == "hi":
        lakh, g1 = f"({n} // 100000)", f"({n} // 1000 % 100)"
        high = f"concat_ws(' ', CASE WHEN {lakh} > 0 THEN {_low('hi', lakh)} || ' लाख' END, CASE WHEN {g1} > 0 THEN {_thousands('hi', g1)} END)"
    return f"CASE WHEN {n} = 0 THEN '{world.TONGUES[lang].zero}' WHEN {n} < 1000 THEN {last} WHEN {g0} = 0 THEN {high} ELSE {high} || {glue} || {last} END"


def kinyarwanda(n: str) -> str:
    """SQL for 0 to 9,999, from the small lists."""
    units, tens, hundreds = world.RW_UNITS, world.RW_TENS, world.RW_HUNDREDS
    pick = lambda names, at: f"{_list(names)}[CAST({at} AS BIGINT) + 1]"
    na = lambda word: f"CASE WHEN left({word}, 1) IN ('i', 'e', 'u') THEN ' n''' ELSE ' na ' END || {word}"

    def below_100(g: str, alone: str) -> str:
        ten = f"CASE WHEN {g} = 10 THEN '{alone}' WHEN {g} < 20 THEN 'cumi' ELSE {pick(tens, f'({g} // 10)')} END"
        return f"CASE WHEN {g} < 10 THEN {pick(units, g)} ELSE {ten} || CASE WHEN {g} % 10 > 0 THEN {na(pick(units, f'({g} % 10)'))} ELSE '' END END"

    low = f"({n} % 100)"
    g = f"({n} % 1000)"
    head = f"CASE WHEN {g} // 100 = 9 AND {low} > 0 THEN 'magana cyenda' ELSE {pick(hundreds, f'({g} // 100)')} END"
    plain = below_100(low, "icumi")
    tail = f"CASE WHEN {low} = 0 THEN '' WHEN {low} BETWEEN 11 AND 19 THEN ' na ' || {below_100(low, 'cumi')} ELSE {na(f'({plain})')} END"
    below_1000 = f"CASE WHEN {g} < 100 THEN {plain} ELSE {head} || {tail} END"
    thousand = f"CASE WHEN {n} < 2000 THEN 'igihumbi' ELSE 'ibihumbi ' || {pick(world.RW_THOUSANDS, f'({n} // 1000)')} END"
    joint = f"CASE WHEN {g} IN (9, 10) OR {g} // 100 = 1 THEN ' n''' ELSE ' na ' END"
    return f"CASE WHEN {n} < 1000 THEN {below_1000} WHEN {g} = 0 THEN {thousand} ELSE {thousand} || {joint} || {below_1000} END"
