"""Number words of each language, built by rule for 0 to 999."""

from __future__ import annotations

import functools

EN_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion"]
EN_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
ES_UNITS = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
ES_TENS = "_ _ _ treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = "_ ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
FR_UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = "_ _ vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt".split()
DE_UNITS = "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
DE_TENS = "_ _ zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()


def _en(n: int, joint: str = " ") -> str:
    if n < 20:
        return EN_UNITS[n]
    if n < 100:
        return EN_TENS[n // 10] + (f" {EN_UNITS[n % 10]}" if n % 10 else "")
    return f"{EN_UNITS[n // 100]} hundred" + (joint + _en(n % 100) if n % 100 else "")


def _es(n: int) -> str:
    if n < 30:
        return ES_UNITS[n]
    if n < 100:
        return ES_TENS[n // 10] + (f" y {ES_UNITS[n % 10]}" if n % 10 else "")
    if n == 100:
        return "cien"
    return ES_HUNDREDS[n // 100] + (f" {_es(n % 100)}" if n % 100 else "")


def _fr(n: int) -> str:
    if n < 20:
        return FR_UNITS[n]
    if n < 100:
        ten, one = FR_TENS[n // 10], n - n // 10 * 10 + (10 if n // 10 in (7, 9) else 0)
        if not one:
            return ten + "s" * (n == 80)
        return f"{ten} et {FR_UNITS[one]}" if one in (1, 11) and n < 80 else f"{ten}-{FR_UNITS[one]}"
    head = "cent" if n < 200 else f"{FR_UNITS[n // 100]} cent"
    return f"{head} {_fr(n % 100)}" if n % 100 else head + "s" * (n >= 200)


def _de(n: int) -> str:
    if n < 20:
        return DE_UNITS[n]
    if n < 100:
        one = "ein" if n % 10 == 1 else DE_UNITS[n % 10]
        return f"{one} und {DE_TENS[n // 10]}" if n % 10 else DE_TENS[n // 10]
    return f"{'ein' if n < 200 else DE_UNITS[n // 100]} hundert" + (f" {_de(n % 100)}" if n % 100 else "")


def _es_short(n: int) -> str:
    """Before a noun: un, veintiún."""
    word = _es(n)
    return word[:-9] + "veintiún" if word.endswith("veintiuno") else word[:-1] if word.endswith("uno") else word


def _fr_short(n: int) -> str:
    """Before mille: no plural s."""
    word = _fr(n)
    return word[:-1] if word.endswith(("vingts", "cents")) else word


@functools.cache
def under_1000(form: str) -> list[str]:
    """Words of 0..999 in one form: en, en_and, es, es_short, fr, fr_short or de."""
    rule = {"en": _en, "en_and": lambda n: _en(n, " and "), "es": _es, "es_short": _es_short, "fr": _fr, "fr_short": _fr_short, "de": _de}[form]
    return [rule(n) for n in range(1000)]
