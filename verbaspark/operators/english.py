"""English written to spoken form: spans of a text are classified by ordered patterns and replaced by words.

Texts without any trigger pass by a native test; the others go through one Arrow function. The spaces around
spans stay as they are in the text.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaspark.functions.lexicon import EN_ORDINALS, EN_SCALES, under_1000
from verbaspark.runtime import ship

MONTHS = "january february march april may june july august september october november december".split()
_MONTH_OF = {m: m for m in MONTHS} | {m[:3]: m for m in MONTHS} | {"sept": "september"}
_M = "(?:" + "|".join(sorted(_MONTH_OF, key=len, reverse=True)) + r")(?![a-z])"
#: Currency signs and names: major one and many, minor one and many.
CURRENCIES = {
    "$": ("dollar", "dollars", "cent", "cents"), "US$": ("us dollar", "us dollars", "cent", "cents"), "£": ("pound", "pounds", "penny", "pence"),
    "€": ("euro", "euros", "cent", "cents"), "¥": ("yen", "yen", "sen", "sen"), "₩": ("won", "won", "jeon", "jeon"),
}
#: Units: one and many.
UNITS = {
    "kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "mg": ("milligram", "milligrams"), "km": ("kilometer", "kilometers"), "cm": ("centimeter", "centimeters"),
    "mm": ("millimeter", "millimeters"), "ml": ("milliliter", "milliliters"), "kw": ("kilowatt", "kilowatts"), "mbps": ("megabit per second", "megabits per second"),
    "lb": ("pound", "pounds"), "lbs": ("pound", "pounds"), "min": ("minute", "minutes"), "ft": ("foot", "feet"), "mph": ("mile per hour", "miles per hour"),
    "kb": ("kilobyte", "kilobytes"), "mb": ("megabyte", "megabytes"), "gb": ("gigabyte", "gigabytes"), "tb": ("terabyte", "terabytes"), "hz": ("hertz", "hertz"), "ghz": ("gigahertz", "gigahertz"),
    "°c": ("degree Celsius", "degrees Celsius"), "°f": ("degree Fahrenheit", "degrees Fahrenheit"), "m²": ("square meter", "square meters"), "km²": ("square kilometer", "square kilometers"),
    "m2": ("square meter", "square meters"), "m³": ("cubic meter", "cubic meters"), "km³": ("cubic kilometer", "cubic kilometers"), "%": ("percent", "percent"),
}
_U = "(?:" + "|".join(map(re.escape, sorted(UNITS, key=len, reverse=True))) + ")"
PERIODS = {"mo": "month", "yr": "year", "wk": "week", "d": "day", "hr": "hour"}
ABBREVIATIONS = {"Dr.": "doctor", "Mr.": "mister", "Mrs.": "misses", "Ms.": "miss"}
STREETS = {"st": "Street", "ave": "Avenue", "ct": "Court", "expy": "Expressway", "hwy": "Highway", "rd": "Road", "blvd": "Boulevard", "dr": "Drive", "ln": "Lane"}
_NAMES = {".": "dot", "@": "at", "-": "dash", "_": "underscore", "/": "slash", ":": "colon", "&": "ampersand", "+": "plus", "=": "equals", "?": "question mark", "~": "tilde", "#": "hash", "%": "percent"}
_SCALE_LETTERS = {"b": "billion", "m": "million", "k": "thousand", "t": "trillion"}
_SCALE = r"(?:thousand|million|billion|trillion)"
#: Protocols, formats and two-letter domains of countries, which are said letter by letter.
_LETTERED = {"www", "http", "https", "ftp", "html"}
#: Operators and symbols alone; each mark of a run is said.
_OPERATORS = {"+": "plus", "-": "minus", "=": "equals", "*": "asterisk"}
_ALONE = {"$": "dollar", "€": "euro", "₩": "won", "£": "pound", "¥": "yen", "#": "hash", "%": "percent", "&": "and", "@": "at", "/": "slash"}
_SYMBOLS = {"#": "hash", "@": "at", "$": "dollar", "+": "plus"}


def _groups(n: int) -> list[int]:
    out = [n % 1000]
    while n := n // 1000:
        out.append(n % 1000)
    return out


def cardinal(n: int, joined: bool = True) -> str:
    if not n:
        return "zero"
    groups = _groups(n)
    if len(groups) > len(EN_SCALES):
        return spell(str(n))
    words = [f"{under_1000('en')[g]} {EN_SCALES[k]}" for k, g in enumerate(groups) if k and g][::-1]
    last = groups[0]
    if last:
        plain = under_1000("en")[last]
        if joined:
            plain = under_1000("en_and")[last] if last >= 100 else f"and {plain}" if len(groups) > 1 and groups[1] else plain
        words.append(plain)
    return " ".join(words)


def spell(digits: str) -> str:
    return " ".join(under_1000("en")[int(d)] for d in digits if d.isdigit())


def ordinal(n: int) -> str:
    head, _, last = cardinal(n, False).rpartition(" ")
    last = EN_ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return f"{head} {last}".strip()


def year(text: str) -> str:
    n = int(text)
    if len(text) == 2:
        return spell(text) if n < 10 else cardinal(n)
    if n % 1000 < 10:
        return cardinal(n, False)
    low = n % 100
    return f"{under_1000('en')[n // 100]} {'hundred' if not low else f'oh {under_1000("en")[low]}' if low < 10 else under_1000('en')[low]}"


def integer(text: str, joined: bool = True) -> str:
    """Digits with or without separators: long runs and leading zeros digit by digit."""
    sign = "minus " if text[0] in "-−" else ""
    text = text.lstrip("-−")
    if "," not in text and (len(text) > 4 or (text[0] == "0" and len(text) > 1)):
        return sign + spell(text)
    return sign + cardinal(int(text.replace(",", "")), joined)


def number(text: str, joined: bool = True, read: bool = False) -> str:
    """An integer or a decimal; ``read``: long integers as numbers."""
    whole, dot, rest = text.partition(".")
    sign = "minus " if whole[:1] in ("-", "−") else ""
    whole = whole.lstrip("-−")
    said = "" if not whole else cardinal(int(whole.replace(",", "")), joined) if read or dot else integer(whole, joined)
    return sign + (f"{said} point {spell(rest)}".strip() if dot else said)


def money(sign: str, amount: str, scale: str = "") -> str:
    one, many, minor_one, minor_many = CURRENCIES[sign]
    if scale:
        return f"{number(amount, False, True)} {scale} {many}"
    whole, _, rest = amount.partition(".")
    major = int(whole.replace(",", "") or 0)
    rest = rest.rstrip("0")
    if len(rest) > 2:
        return f"{number(whole + '.' + rest, True, True)} {many}" if whole else f"point {spell(rest)} {many}"
    minor = int(rest.ljust(2, "0")) if rest else 0
    out = [f"{cardinal(major)} {one if major == 1 else many}"] if major or not minor else []
    if minor:
        out.append(f"{cardinal(minor)} {minor_one if minor == 1 else minor_many}")
    return " ".join(out)


def measure(amount: str, unit: str) -> str:
    one, many = UNITS[unit.lower()]
    return f"{number(amount, True, True)} {one if amount.lstrip('-') in ('1', '1.0') else many}"


def fraction(top: str, bottom: str, whole: str = "") -> str:
    a, b = int(top), int(bottom)
    if b == 1:
        said = f"{cardinal(a, False)} over one"
    else:
        name = {2: "half", 4: "quarter"}.get(b) or ordinal(b)
        if a != 1:
            name = "halves" if b == 2 else name + "s"
        said = f"{cardinal(a, False)} {name}"
    if whole:
        return f"{number(whole)} and {'a half' if said == 'one half' else said}"
    return said


def date(day: str, month: str, year_text: str = "", of: bool = False, joint: str = " ") -> str:
    tail = joint + year(year_text) if year_text else ""
    return (f"the {ordinal(int(day))} of {month}" if of else f"{month} {ordinal(int(day))}") + tail


def clock(hour: str, minute: str, half: str = "", zone: str = "") -> str:
    h, m = int(hour), int(minute or 0)
    half = half.replace(".", "").upper()
    said = cardinal(h) if half and not m else f"{cardinal(h)} o'clock" if not m and h <= 12 or not m and not half else f"{cardinal(h)} {f'o {cardinal(m)}' if m < 10 else cardinal(m)}"
    return " ".join(x for x in (said, half, zone.replace(".", "").upper()) if x)


def electronic(text: str) -> str:
    """Names of the marks, digits one by one; parts said letter by letter are written in capitals: ``_LETTERED`` ones, and the last part of a
    host's name where it has two letters."""
    host = re.search(r"(?:^|@|//)[^/@]*\.([A-Za-z]{2})(?=$|[/:?])", text)
    out = []
    for m in re.finditer(r"[A-Za-z]+|\d|[^A-Za-z\d]", text):
        part = m[0]
        if part.isdigit():
            out.append(spell(part))
        elif part.isalpha():
            out.append(part.upper() if part.lower() in _LETTERED or host and m.start() == host.start(1) else part)
        else:
            out.append(_NAMES.get(part, part))
    return " ".join(out)


def math(text: str) -> str:
    return " ".join(_OPERATORS.get(p) or (cardinal(int(p), False) if p.isdigit() else p) for p in re.findall(r"\d+|[A-Za-z]+|[+\-=*]", text))


def symbols(text: str) -> str:
    return " ".join(_SYMBOLS[c] for c in text)


def phone(country: str, *blocks: str) -> str:
    said = [("eight hundred" if b == "800" else spell(b)) for b in blocks if b]
    return ", ".join([f"plus {spell(country)}"] * bool(country) + said)


def roman(text: str) -> int:
    value = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    n = [value[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True))


def _plural_year(text: str) -> str:
    n = int(text)
    if len(text) == 4 and n % 1000 == 0:
        return cardinal(n, False) + "s"
    tens = under_1000("en")[n % 100]
    tens = "hundreds" if not n % 100 else tens[:-1] + "ies" if tens.endswith("y") else tens + "s"
    return (under_1000("en")[n // 100] + " " if len(text) == 4 else "") + tens


_NUM = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
_DEC = rf"-?(?:{_NUM}(?:\.\d+)?|\.\d+)"
_HALF = r"(?:[ap]\.m\.?|[ap]m(?![a-z]))"
_ZONE = r"(?:\s?(?:e\.?s\.?t|p\.?s\.?t|gmt|utc|cst|mst)\b\.?)?"
_SIGN = r"(?:US\$|[$£€¥₩])"


def _money_span(m: re.Match) -> str:
    scale = m["mscale"] or ""
    return money(m["msign"], m["mamount"], _SCALE_LETTERS.get(scale.lower(), scale))


#: Class, pattern, reading; the first that matches at a place wins.
RULES: list[tuple[str, str, object]] = [
    ("markup", r"<[^<>\s][^<>]*>", lambda m: m[0]),
    ("markup", r"\[(?=[^\[\]]*[A-Z]{2}[012]?[ \]])[A-Z012 ]+\]", lambda m: m[0]),
    ("math", r"(?<![\w.,=+\-*/])(?:[a-z]|\d{1,4})(?: ?[+\-*] ?(?:[a-z]|\d{1,4}))* ?= ?(?:[a-z]|\d{1,4})(?: ?[+\-*] ?(?:[a-z]|\d{1,4}))*(?![\w.,=]\w|\w)", lambda m: math(m[0])),
    ("math", r"(?<![\w.,])\d+\*\d+(?![\w.,*])", lambda m: math(m[0])),
    ("url", r"\b(?:https?|ftp|file)://\S*[\w/]|\bwww\.[\w.\-/]*\w", lambda m: electronic(m[0])),
    ("email", r"(?<![\w.])[\w.+\-&]+@[A-Za-z\d\-]+(?:\.[A-Za-z\d\-]+)+(?:/[\w\-/]*)?", lambda m: electronic(m[0])),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]\d)", lambda m: electronic(m[0])),
    ("domain", r"(?<![\w.@])[A-Za-z][A-Za-z\d\-]*(?:\.[A-Za-z\d\-]+)*\.(?:com|org|net|edu|uk|de|fr|it)(?:/[\w\-/.]*\w)?(?![\w@])", lambda m: electronic(m[0])),
    ("file", r"(?<![\w.])\w+_\w+\.[a-z]{2,4}(?!\w)", lambda m: electronic(m[0])),
    ("phone", r"(?<![\w+\-])(?:\+(?P<pc>\d{1,3})[ \-]?)?\(?(?P<p1>\d{3})\)?[ \-.]?-?(?P<p2>\d{3})[\-.](?P<p3>\d{4})(?:-(?P<p4>\d+))?(?![\w])", lambda m: phone(m["pc"] or "", m["p1"], m["p2"], m["p3"], m["p4"] or "")),
    ("ssn", r"(?<![\w\-])(?P<s1>\d{3})-(?P<s2>\d{2})-(?P<s3>\d{4})(?![\w\-])", lambda m: phone("", m["s1"], m["s2"], m["s3"])),
    ("date", rf"(?i:\b(?P<d1m>{_M})\.?[ \-](?P<d1d>\d{{1,2}})(?:st|nd|rd|th)?(?:(?P<d1c>, ?|[ \-])(?P<d1y>\d{{4}}))?)(?![\w/])", lambda m: date(m["d1d"], _MONTH_OF[m["d1m"].lower()], m["d1y"] or "", joint=", " if "," in (m["d1c"] or "") else " ")),
    ("date", rf"(?i:\b(?:the )?(?P<d2d>\d{{1,2}})(?:st|nd|rd|th)? (?P<d2m>{_M})\.?(?:(?P<d2c>[, ]+)(?P<d2y>\d{{4}}))?)(?!\w)", lambda m: date(m["d2d"], _MONTH_OF[m["d2m"].lower()], m["d2y"] or "", of=True, joint=(m["d2c"] or " "))),
    ("date", rf"(?i:\b(?P<d3m>{_M})\.? (?P<d3y>\d{{4}}))(?!\w)", lambda m: f"{_MONTH_OF[m['d3m'].lower()]} {year(m['d3y'])}"),
    ("date", r"(?<![\w/\-.])(?P<d4y>[12]\d{3})(?P<d4s>[\-/.])(?P<d4m>0?[1-9]|1[0-2])(?P=d4s)(?P<d4d>0?[1-9]|[12]\d|3[01])(?![\w/])", lambda m: date(m["d4d"], MONTHS[int(m["d4m"]) - 1], m["d4y"])),
    ("date", r"(?<![\w/\-.])(?P<d5m>0?[1-9]|1[0-2])(?P<d5s>[\-/.])(?P<d5d>0?[1-9]|[12]\d|3[01])(?P=d5s)(?P<d5y>\d{4}|\d{2})(?![\w/])", lambda m: date(m["d5d"], MONTHS[int(m["d5m"]) - 1], m["d5y"])),
    ("date", r"(?<![\w/\-.])(?P<d6d>1[3-9]|2\d|3[01])(?P<d6s>[\-/.])(?P<d6m>0?[1-9]|1[0-2])(?P=d6s)(?P<d6y>\d{4})(?![\w/])", lambda m: date(m["d6d"], MONTHS[int(m["d6m"]) - 1], m["d6y"], of=True)),
    ("date", r"(?<![\w])(?P<q>[1-4])Q(?P<qy>\d{2}|\d{4})(?!\w)", lambda m: f"the {ordinal(int(m['q']))} quarter of {year(m['qy'])}"),
    ("decade", r"(?<![\w])(?:(?P<mid>mid)-)?'?(?P<e1>\d{3}0|\d0)\s?s(?:-(?P<e2>\d{3}0|\d0)s)?(?!\w)", lambda m: ("mid " if m["mid"] else "") + _plural_year(m["e1"]) + (f" to {_plural_year(m['e2'])}" if m["e2"] else "")),
    ("years", r"(?<![\w\-,.$])(?P<y1>1[1-9]\d\d|20\d\d)-(?P<y2>1[1-9]\d\d|20\d\d)(?![\w\-]| ?(?i:kg|km|lb))", lambda m: f"{year(m['y1'])} to {year(m['y2'])}"),
    ("time", rf"(?i:\b(?P<t1h>\d{{1,2}})(?:[:.](?P<t1m>\d{{2}}))? ?(?P<t1a>{_HALF}) ?- ?(?P<t2h>\d{{1,2}})(?:[:.](?P<t2m>\d{{2}}))? ?(?P<t2a>{_HALF}))", lambda m: f"{clock(m['t1h'], m['t1m'], m['t1a'])} to {clock(m['t2h'], m['t2m'], m['t2a'])}"),
    ("time", rf"(?i:\b(?P<u1>\d{{1,2}}):(?P<u2>\d\d):(?P<u3>\d\d)(?: ?(?P<u4>{_HALF}))?(?P<u5>{_ZONE}))(?![\w:])", lambda m: " ".join(x for x in (f"{cardinal(int(m['u1']))} hour{'s' * (int(m['u1']) != 1)} {cardinal(int(m['u2']))} minute{'s' * (int(m['u2']) != 1)} and {cardinal(int(m['u3']))} second{'s' * (int(m['u3']) != 1)}", (m["u4"] or "").replace(".", "").upper(), m["u5"].strip().replace(".", "").upper()) if x)),
    ("time", rf"(?i:(?<![\w.:])(?P<v1>\d{{1,2}})(?:[:.](?P<v2>\d\d))? ?(?P<v3>{_HALF})(?P<v4>{_ZONE}))", lambda m: clock(m["v1"], m["v2"], m["v3"], m["v4"].strip())),
    ("time", r"(?<![\w:.])(?P<w1>[01]?\d|2[0-4]):(?P<w2>[0-5]\d)(?![\w:])", lambda m: clock(m["w1"], m["w2"])),
    ("money", rf"(?P<r1>{_SIGN})(?P<r2>{_DEC})-(?P<r3>{_SIGN})(?P<r4>{_DEC})(?!\w)", lambda m: f"{money(m['r1'], m['r2'])} to {money(m['r3'], m['r4'])}"),
    ("money", rf"(?P<mp1>{_SIGN})(?P<mp2>(?:{_NUM}(?:\.\d+)?|\.\d+))/(?P<mp3>mo|yr|wk|d|hr)\b", lambda m: f"{money(m['mp1'], m['mp2'])} per {PERIODS[m['mp3']]}"),
    ("money", rf"(?P<msign>{_SIGN})(?P<mamount>(?:{_NUM}(?:\.\d+)?|\.\d+))(?: ?(?P<mscale>{_SCALE}\b|[bBmMkK](?!\w)))?(?![\w@])", _money_span),
    ("money", rf"(?<![\w.])(?P<mm1>{_DEC})(?P<mm2> {_SCALE})? (?P<mm3>yuan|euros|dollars)\b", lambda m: f"{number(m['mm1'], False, True)}{m['mm2'] or ''} {m['mm3']}"),
    ("fraction", r"(?<![\w/.,])(?:(?P<f1>\d+) )?(?P<f2>\d+) ?/ ?(?P<f3>[1-9]\d*)(?i:th|rd|nd|st)?(?![\w/])(?: (?P<f4>lbs|cups)\b)?", lambda m: fraction(m["f2"], m["f3"], m["f1"] or "") + (f" {UNITS[m['f4']][1] if m['f4'] in UNITS else m['f4']}" if m["f4"] else "")),
    ("measure", rf"(?i:(?<![\w.,/])(?P<g1>{_DEC})-(?P<g2>{_DEC}) ?(?P<g3>{_U}))(?![\w²³])", lambda m: f"{number(m['g1'], True, True)} to {measure(m['g2'], m['g3'])}"),
    ("measure", rf"(?i:(?<![\w.,/])(?P<h1>{_DEC})(?P<h0> {_SCALE})? ?(?P<h2>{_U})/(?P<h3>{_U}|h|s))(?!\w)", lambda m: measure(m["h1"], m["h2"]) + " per " + (UNITS[m["h3"].lower()][0] if m["h3"].lower() in UNITS else m["h3"].upper())),
    ("measure", rf"(?i:(?<![\w.,/])(?P<i1>{_DEC})(?P<i0> {_SCALE}) ?(?P<i2>{_U}))(?![\w²³/])", lambda m: f"{number(m['i1'], False, True)}{m['i0']} {UNITS[m['i2'].lower()][1]}"),
    ("measure", rf"(?i:(?<![\w.,/])(?P<j1>{_DEC}) ?(?P<j2>{_U}))(?![\w²³/])", lambda m: measure(m["j1"], m["j2"])),
    ("measure", rf"(?i:(?<![\w.,/])(?P<k1>{_DEC})/(?P<k2>{_U}))(?!\w)", lambda m: f"{number(m['k1'])} per {UNITS[m['k2'].lower()][0]}"),
    ("measure", r"(?<![\w.,/])(?P<l1>-?\d+(?:\.\d+)?) (?P<l2>[hmsL])(?!\w)", lambda m: f"{number(m['l1'])} {m['l2'].upper()}"),
    ("address", rf"(?<![\w])(?P<a1>\d{{3,4}})(?P<a2>(?: [A-Z][\w']*| \d+(?:st|nd|rd|th))+?) (?P<a3>(?i:{'|'.join(STREETS)}))\b\.?", lambda m: _address(m)),
    ("address", rf"(?<![\w])(?P<b1>\d{{1,2}})(?P<b2>(?: [A-Z][\w']*)+?) (?P<b3>(?i:{'|'.join(STREETS)}))\b\.?(?= *$| [A-Z]|,)", lambda m: f"{cardinal(int(m['b1']))}{m['b2']} {STREETS[m['b3'].lower()]}"),
    ("quantity", rf"(?<![\w.])(?P<n1>{_DEC}) (?P<n2>{_SCALE})\b", lambda m: f"{number(m['n1'], False, True)} {m['n2']}"),
    ("ordinal", r"(?<![\w.])(?P<o1>\d{1,3}(?:,\d{3})+|\d+)(?P<o2>st|nd|rd|th)(?![\w\-])", lambda m: _ordinal_span(m["o1"], m["o2"])),
    ("whitelist", r"(?<!\w)(?P<x1>Dr\.|Mr\.|Mrs\.|Ms\.)(?= [A-Z])", lambda m: ABBREVIATIONS[m["x1"]]),
    ("roman", r"\b(?P<c1>(?i:chapter|part|section|volume|act)) (?P<c2>(?=[IVXL])(?:XL|L?X{0,3})(?:IX|IV|V?I{0,3}))(?!\w)", lambda m: f"{m['c1']} {cardinal(roman(m['c2']))}"),
    ("year", r"(?<![\w.,/\-+:])(?P<z>1[1-9]\d\d|20\d\d)(?![\w/\-%°]|[.,:]\d)", lambda m: year(m["z"])),
    ("decimal", rf"(?<![\w.])(?P<dd>-?(?:{_NUM})?\.\d+)(?![\w.]\w)", lambda m: number(m["dd"])),
    ("cardinal", rf"(?<![\w.\-])(?P<cn>-(?={_NUM}))?(?P<cc>{_NUM})(?!\w)", lambda m: ("minus " if m["cn"] else "") + integer(m["cc"])),
    ("serial", r"(?<![\w])(?=\w*\d)(?=\w*[A-Za-z])[A-Za-z\d]+(?!\w)", lambda m: _serial(m[0])),
    ("cardinal", r"(?<=[A-Za-z\d]-)(?P<ce>\d+)(?!\w)", lambda m: integer(m["ce"], False)),
    ("symbol", r"(?<=\w)(?P<sa> ?)&(?P<sb> ?)(?=\w)", lambda m: " and "),
    ("whitelist", r"(?<![\w.])(?:[A-Z]\.){3,}", lambda m: m[0].replace(".", "")),
    ("symbol", r"(?<!\S)(?P<sh>[$€₩£¥#%&@/])(?!\S)", lambda m: _ALONE[m["sh"]]),
    ("symbol", r"(?<![^\s(\"'])(?P<sc>[@#])(?=[A-Za-z]{2})", lambda m: symbols(m["sc"]) + " "),
    ("symbol", r"(?<=[A-Za-z])(?P<sd>[#$]+|\+\+)(?=[A-Za-z])", lambda m: f" {symbols(m['sd'])} "),
    ("symbol", r"(?<=[A-Za-z])(?P<se>[#$]+|\+\+)(?=[\s.,;:!?]|$)", lambda m: f" {symbols(m['se'])}"),
    ("symbol", r"(?<=[a-z]{3})(?P<sf> ?)/(?P<sg> ?)(?=[a-z]{3})", lambda m: " slash "),
]


def _ordinal_span(text: str, suffix: str) -> str:
    n = int(text.replace(",", ""))
    right = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return ordinal(n) if suffix == right else f"{cardinal(n, False)} {suffix}"


def _serial(text: str) -> str:
    return " ".join(integer(p, False) if p.isdigit() else p for p in re.findall(r"\d+|[A-Za-z]+", text))


def _address(m: re.Match) -> str:
    n = m["a1"]
    house = spell(n) if len(n) == 3 and n[1] == "0" else f"{cardinal(int(n[:-2]))} {cardinal(int(n[-2:]))}" if n[-2] != "0" else spell(n)
    names = re.sub(r"\b(\d+)(st|nd|rd|th)\b", lambda o: _ordinal_span(o[1], o[2]), m["a2"])
    names = re.sub(r" ([NSEW])(?= )", lambda o: " " + {"N": "North", "S": "South", "E": "East", "W": "West"}[o[1]], names)
    return f"{house}{names} {STREETS[m['a3'].lower()]}"


_ALL = re.compile("|".join(f"(?P<rule{k}>{pattern})" for k, (_, pattern, _) in enumerate(RULES)))
_WORD_STARTS = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
#: Where a span can begin at all: other places need not try the rules.
_BEGIN = re.compile(
    r"[\d<\[$£€¥₩_#@/%]|(?<![\w.])[A-Z]\.[A-Z]|[^\x00-\x7f]| /|[.+\-](?=[\w.+\-&@])|\((?=\d)|'(?=\d)| ?&|(?<![A-Za-z\d])(?=[\w+\-]*[\d@._$:&+\-=])[A-Za-z]|(?<![A-Za-z\d])[a-z](?= [=+\-*] ?\w)|\+\+"
    rf"|\b(?i:(?:{_WORD_STARTS})\.?[ \-]\d|the \d|(?:chapter|part|section|volume|act) [ivxl])"
)
#: A text that this does not match has no span (Java syntax).
TRIGGER = r"[\p{Nd}@&<=_#$%€₩£¥]|``|[A-Z]\.[A-Z]\.|(?:^|\s)/(?:\s|$)|\+\+|[a-z] ?/ ?[a-z]|://|www\.|[A-Za-z0-9\-]\.(?:com|org|net|edu|uk|de|fr|it)|(?:Dr|Mr|Mrs|Ms)\. |(?iu:chapter|part|section|volume|act) [IVXLivxl]"


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, class and spoken form of each span of a text, from left to right."""
    out, at = [], 0
    while place := _BEGIN.search(text, at):
        m = _ALL.match(text, place.start())
        at = m.end() if m else place.start() + 1
        if not m:
            continue
        k = int(m.lastgroup[4:]) if m.lastgroup and m.lastgroup.startswith("rule") else next(i for i in range(len(RULES)) if m[f"rule{i}"] is not None)
        kind, _, read = RULES[k]
        out.append((m.start(), m.end(), kind, read(m)))
    return out


def normalize_one(text: str | None) -> str | None:
    """Spoken form of one text; null, empty and blank texts stay."""
    if not text or not text.strip():
        return text
    text = (text.replace("\x00", "") or text).replace("``", '"')
    out, done = [], 0
    for a, b, _, said in spans(text):
        out += [text[done:a], said]
        done = b
    return "".join([*out, text[done:]]).strip()


#: Texts that a worker's memo of spoken forms holds at most, and the longest in characters that it holds.
MEMO, MEMO_CHARS = 1 << 17, 128
_remembered = functools.lru_cache(MEMO)(normalize_one)


def normalize_again(text: str | None) -> str | None:
    """``normalize_one`` with the answers to short texts seen lately looked up. It changes no result."""
    return _remembered(text) if text and len(text) <= MEMO_CHARS else normalize_one(text)


def normalize(df: DataFrame, column: str = "text", out: str = "spoken") -> DataFrame:
    """``df`` with the spoken form of ``column``. Only texts with a trigger reach Python."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def spoken(texts: pd.Series) -> pd.Series:
        return texts.map(normalize_again, na_action="ignore")

    return df.withColumn(out, spoken(F.when(F.col(column).rlike(TRIGGER), F.col(column)))).withColumn(out, F.coalesce(out, _plain(F.col(column))))


def _plain(text: Column) -> Column:
    from verbaspark.functions.text import drop_nul, strip

    return F.when(strip(text) == "", text).otherwise(strip(drop_nul(text)))
