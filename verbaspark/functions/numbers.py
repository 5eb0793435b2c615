"""Numbers to words as Column expressions: arithmetic on groups of three digits and literal tables, no Python rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbaspark.functions import worldwords as world
from verbaspark.functions.lexicon import EN_ORDINALS, EN_SCALES, under_1000


def _word(form: str, group: Column) -> Column:
    return _pick(under_1000(form), group)


def _div(n: Column, by: int) -> Column:
    """Whole division of a number that is not negative."""
    return F.call_function("div", n, F.lit(by))


def _signed(n: Column, minus: str, zero: str, words: Column) -> Column:
    return F.when(n == 0, zero).when(n.isNotNull(), F.concat(F.when(n < 0, f"{minus} ").otherwise(""), words))


#: From here on a language reads a number digit by digit, in columns as in texts; those not named, from 10**15.
LIMITS = {"en": 2**63, "rw": 10**12, "hi": 10**13, "hu": 2**63, "vi": 2**63, "zh": 2**63, "ja": 2**63, "ko": 2**63}


def cardinal(n: Column, lang: str = "en", joined: bool = True) -> Column:
    """Words of a whole number; null stays null. ``joined``: English ``and`` as in plain numbers.

    Every long has words: what lies beyond a language's greatest scale comes digit by digit, and so does the least long but in English."""
    n = n.cast("long")
    if lang == "en":
        return _english(n, joined)
    last = LIMITS.get(lang, 10**15) - 1
    words = _eastern(n, lang) if lang in ("zh", "ja", "ko") else _leveled(n, lang) if lang in world.TONGUES else _western(n, lang)
    minus = {"es": "menos", "fr": "moins", "de": "minus"}.get(lang) or world.TONGUES[lang].minus
    names = world.digit_words(lang) if lang in world.TONGUES else under_1000(lang)[:10]
    spelt = F.concat(F.when(n < 0, f"{minus} ").otherwise(""), digits(F.replace(n.cast("string"), F.lit("-"), F.lit("")), names))
    return F.when((n <= last) & (n >= -last), words).when(n.isNotNull(), spelt)


def _bound(value: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a value that is computed once for each row, however often ``read`` uses it."""
    return F.transform(F.array(value), read)[0]


def _english(n: Column, joined: bool) -> Column:
    """One look-up for each group of three digits; the tables hold the scales and the spaces before."""
    names = under_1000("en")
    ends = under_1000("en_and") if joined else names
    alone = ["", *(f" {w}" for w in ends[1:])]
    behind = ["", *(f" and {w}" if joined else f" {w}" for w in names[1:100]), *alone[100:]]

    def read(text: Column) -> Column:
        g = [F.substring(text, 19 - 3 * k, 3).cast("int") for k in range(7)]
        parts = [_pick(["", *(f" {w} {EN_SCALES[k]}" for w in names[1:])], g[k]) for k in range(6, 0, -1)]
        last = _pick(alone + behind, g[0] + F.when(g[1] > 0, 1000).otherwise(0))
        words = F.ltrim(F.concat(*parts, last))
        return F.when(words == "", "zero").when(F.substring(text, 22, 1) == "-", F.concat(F.lit("minus "), words)).otherwise(words)

    written = n.cast("string")  # as digits: the least long has no positive counterpart
    padded = F.concat(F.lpad(F.replace(written, F.lit("-"), F.lit("")), 21, "0"), F.substring(written, 1, 1))
    return F.when(n.isNotNull(), _bound(padded, read))


def _western(n: Column, lang: str) -> Column:
    """Spanish, French and German."""
    a = F.abs(n)
    g = [_div(a, 1000**k) % 1000 for k in range(5)]
    if lang == "es":
        def six(high: Column, low: Column, end: str) -> Column:
            thousand = F.when(high == 1, "mil").when(high > 1, F.concat(_word("es_short", high), F.lit(" mil")))
            return F.concat_ws(" ", thousand, F.when(low > 0, _word(end, low)))

        big = F.when(g[4] == 1, "un billón").when(g[4] > 1, F.concat(_word("es_short", g[4]), F.lit(" billones")))
        millions = g[3] * 1000 + g[2]
        middle = F.when(millions == 1, "un millón").when(millions > 1, F.concat(six(g[3], g[2], "es_short"), F.lit(" millones")))
        return _signed(n, "menos", "cero", F.concat_ws(" ", big, middle, F.when((g[1] > 0) | (g[0] > 0), six(g[1], g[0], "es"))))
    if lang == "fr":
        names = {4: "billion", 3: "milliard", 2: "million"}
        parts = [F.when(g[k] == 1, f"un {names[k]}").when(g[k] > 1, F.concat(_word("fr", g[k]), F.lit(f" {names[k]}s"))) for k in (4, 3, 2)]
        thousand = F.when(g[1] == 1, "mille").when(g[1] > 1, F.concat(_word("fr_short", g[1]), F.lit(" mille")))
        return _signed(n, "moins", "zéro", F.concat_ws(" ", *parts, thousand, F.when(g[0] > 0, _word("fr", g[0]))))
    if lang == "de":
        names = {4: ("billion", "billionen"), 3: ("milliarde", "milliarden"), 2: ("million", "millionen")}
        parts = [F.when(g[k] == 1, f"eine {names[k][0]}").when(g[k] > 1, F.concat(_word("de", g[k]), F.lit(f" {names[k][1]}"))) for k in (4, 3, 2)]
        thousand = F.when(g[1] == 1, "ein tausend").when(g[1] > 1, F.concat(_word("de", g[1]), F.lit(" tausend")))
        return _signed(n, "minus", "null", F.concat_ws(" ", *parts, thousand, F.when(g[0] > 0, _word("de", g[0]))))
    raise ValueError(f"no number words for {lang!r}")


def _pick(table: list[str], at: Column) -> Column:
    """An entry of a fixed list, which the optimizer folds into one literal."""
    return F.element_at(F.split(F.lit("|".join(table)), r"\|"), at.cast("int") + 1)


def _leveled(n: Column, lang: str, top: int | None = None) -> Column:
    """Level by level with a table of 1000 names each; what joins a level to those above is a table as well.
    ``top``: how many the greatest level counts, where that is less."""
    tongue, a = world.TONGUES[lang], F.abs(n)
    pieces = []
    for k, (div, size, name) in enumerate(tongue.levels):
        size = top if top and not k else size
        if div > 10**18:
            continue
        g = _div(a, div) % size
        if lang == "vi" and not k and not top:
            said = F.concat(_leveled(g, "vi", 10), F.lit(" tỷ"))
        elif lang == "it" and div == 10**6:
            high = _div(g, 1000)
            thousands = _pick([""] + [world.TONGUES["it"].levels[2][2](k) for k in range(1, 1000)], high)
            said = F.when(g == 1, "un milione").otherwise(F.concat_ws(" ", F.when(high > 0, thousands), F.when(g % 1000 > 0, _pick([""] + [name_ for name_ in map(tongue.levels[3][2], range(1, 1000))], g % 1000)), F.lit("milioni")))
        else:
            said = _pick([""] + [name(k) for k in range(1, min(size, 1000))], g)
        joint = lambda below: _pick([""] + [tongue.joint(div, k, below, False) for k in range(1, min(size, 1000))], F.greatest(g % 1000, F.lit(1)))  # noqa: B023, E731
        between = F.when(a % div > 0, joint(True)).otherwise(joint(False))
        pieces.append(F.when(g > 0, F.concat(F.when(a >= div * size, between).otherwise("") if div * size < 2**63 else F.lit(""), said)))
    out = F.concat_ws("", *pieces)
    if lang == "hu":
        out = F.when(a <= 2000, F.replace(out, F.lit("-"), F.lit(""))).otherwise(out)
    return _signed(n, tongue.minus, tongue.zero, out)


def _eastern(n: Column, lang: str) -> Column:
    """Groups of four digits: signs are set between the digits, then empty places go."""
    tongue, a = world.TONGUES[lang], F.abs(n)
    names = "".join(world.digit_words(lang))
    zero, one = names[0], names[1]
    thousand, hundred, ten = "천백십" if lang == "ko" else "千百十"
    pieces, empty_above = [], F.lit(False)
    for k, sign in ((4, "경" if lang == "ko" else "京"), (3, "조" if lang == "ko" else "兆"), (2, "억" if lang == "ko" else "億" if lang == "ja" else "亿"), (1, "만" if lang == "ko" else "万"), (0, "")):
        g = _div(a, 10_000**k) % 10_000
        above = a >= 10_000 ** (k + 1) if k < 4 else F.lit(False)
        padded = F.translate(F.lpad(g.cast("string"), 4, "0"), "0123456789", names)
        said = F.regexp_replace(padded, "^(.)(.)(.)(.)$", f"$1{thousand}$2{hundred}$3{ten}$4")
        if lang == "zh":
            said = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, f"{zero}[{thousand}{hundred}{ten}]", zero), f"{zero}+", zero), f"^{zero}|{zero}$", "")
            said = F.when(g < 20, F.regexp_replace(said, f"^{one}{ten}", ten) if k else F.when(a < 20, F.regexp_replace(said, f"^{one}{ten}", ten)).otherwise(said)).otherwise(said)
            gap = F.when(above & ((g < 1000) | empty_above), zero).otherwise("")
        else:
            said = F.regexp_replace(F.regexp_replace(said, f"{zero}[{thousand}{hundred}{ten}]?", ""), f"{one}(?=[{thousand}{hundred}{ten}])", "")
            if lang == "ja":
                said = F.when((_div(g, 1000) == 1) & ((g == 1000) | F.lit(k > 0)), F.concat(F.lit(one), said)).otherwise(said)
            gap = F.lit("")
        bare = F.when((g == 1) & F.lit(lang == "ko" and k == 1), "").otherwise(said)
        pieces.append(F.when(g > 0, F.concat(gap, bare, F.lit(sign))))
        empty_above = g == 0
    minus = F.when(n < 0, tongue.minus + ("" if lang == "zh" else " ")).otherwise("")
    return F.when(n == 0, tongue.zero).when(n.isNotNull(), F.concat(minus, *[F.coalesce(p, F.lit("")) for p in pieces]))


def digits(text: Column, names: list[str] | None = None) -> Column:
    """Each digit of a string by name, English by default."""
    out = text
    for d, name in enumerate(names or under_1000("en")[:10]):
        out = F.replace(out, F.lit(str(d)), F.lit(f"{name} "))
    return F.rtrim(out)


def ordinal(n: Column) -> Column:
    """English ordinal words."""
    endings = F.create_map(*[F.lit(x) for pair in EN_ORDINALS.items() for x in pair])

    def read(words: Column) -> Column:
        last = F.substring_index(words, " ", -1)
        ending = F.coalesce(F.try_element_at(endings, last), F.when(last.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th"))))
        return F.concat(F.substring(words, F.lit(1), F.length(words) - F.length(last)), ending)

    return F.when(n.isNotNull(), _bound(cardinal(n, "en", joined=False), read))


def year(n: Column) -> Column:
    """English year reading of 1000 to 9999: pairs, ``oh`` for a single digit, ``hundred`` for none."""
    n = n.cast("long")
    high, low = _div(n, 100), n % 100
    pairs = F.concat_ws(" ", _word("en", high), F.when(low == 0, "hundred").when(low < 10, F.concat(F.lit("oh "), _word("en", low))).otherwise(_word("en", low)))
    plain = F.concat_ws(" ", _word("en", _div(n, 1000)), F.lit("thousand"), F.when(n % 10 > 0, _word("en", n % 10)))
    return F.when(n % 1000 < 10, plain).otherwise(pairs)
