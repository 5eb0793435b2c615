"""Written to spoken form in sixteen languages: one table of facts for each language, one set of patterns for all.

English has a module of its own. A text without digits passes by a native test; the others go through one Arrow function.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaspark.functions import worldwords as world
from verbaspark.functions.lexicon import under_1000
from verbaspark.operators import english
from verbaspark.runtime import ship

_SCALES = {"es": (("billón", "billones"), None, ("millón", "millones")), "fr": (("billion", "billions"), ("milliard", "milliards"), ("million", "millions")), "de": (("billion", "billionen"), ("milliarde", "milliarden"), ("million", "millionen"))}


def say(n: int, lang: str) -> str:
    """Words of a whole number in any of the languages."""
    if lang in world.TONGUES:
        return world.words(n, lang)
    if lang == "en":
        return ("minus " if n < 0 else "") + english.cardinal(abs(n))
    if n < 0:
        return f"{VOICES[lang].minus} {say(-n, lang)}"
    if n < 1000:
        return under_1000(lang)[n]
    if n >= 10**15:
        return spell(str(n), lang)
    short = lambda k: f"{'un' if lang == 'fr' else 'eine'}" if k == 1 else under_1000(lang)[k]
    out, rest = [], n
    if lang == "es":
        for size, (one, many) in ((10**12, _SCALES["es"][0]), (10**6, _SCALES["es"][2])):
            k, rest = divmod(rest, size)
            if k:
                out.append(f"un {one}" if k == 1 else f"{_before_noun(say(k, 'es'))} {many}")
        k, rest = divmod(rest, 1000)
        out += ["mil" if k == 1 else f"{under_1000('es_short')[k]} mil"] if k else []
    else:
        for size, (one, many) in zip((10**12, 10**9, 10**6), _SCALES[lang], strict=True):
            k, rest = divmod(rest, size)
            if k:
                out.append(f"{short(k)} {one if k == 1 else many}")
        k, rest = divmod(rest, 1000)
        if k:
            out.append(("mille" if k == 1 else f"{under_1000('fr_short')[k]} mille") if lang == "fr" else ("ein tausend" if k == 1 else f"{under_1000('de')[k]} tausend"))
    return " ".join([*out, *([under_1000(lang)[rest]] if rest else [])])


def spell(digits: str, lang: str) -> str:
    return world.spell(digits, lang) if lang in world.TONGUES else " ".join(under_1000(lang)[int(d)] for d in digits)


def _before_noun(words: str) -> str:
    """Spanish: uno and veintiuno lose their ending before a noun."""
    return re.sub(r"\buno$", "un", re.sub(r"veintiuno$", "veintiún", words))


@dataclass(frozen=True)
class Voice:
    """What the shared patterns need to know of a language."""

    minus: str
    point: str
    comma: bool = True
    thousands: str = r"[.  ]"
    percent: str = ""
    #: Sign or code: major one and many, minor one and many.
    money: dict = field(default_factory=dict)
    minor_joint: str = " "
    units: dict = field(default_factory=dict)
    per: str = ""
    months: tuple = ()
    of: str = " "
    #: Digits after the sign: digit, number or pairs.
    after: str = "digit"
    feminine: frozenset = frozenset()
    whitelist: dict = field(default_factory=dict)
    #: Names for electronic addresses; empty: they stay as they are.
    names: dict = field(default_factory=dict)


def _units(text: str) -> dict:
    """``kg kilogramo kilogramos; ...`` with underscores for spaces."""
    return {u: (one.replace("_", " "), many.replace("_", " ")) for u, one, many in (p.split() for p in text.split(";"))}


_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
_FR = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
_DE = "januar februar märz april mai juni juli august september oktober november dezember"
_PT = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro"
_IT = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre"
_SV = "januari februari mars april maj juni juli augusti september oktober november december"
VOICES = {
    "es": Voice("menos", "coma", percent="por ciento", after="number", of=" de ", months=tuple(_ES.split()),
        money={"$": ("dólar", "dólares", "centavo", "centavos"), "€": ("euro", "euros", "céntimo", "céntimos"), "£": ("libra", "libras", "penique", "peniques")}, feminine=frozenset({"libra", "libras", "hora", "horas", "milla por hora", "millas por hora"}),
        units=_units("kg kilogramo kilogramos;g gramo gramos;mg miligramo miligramos;km kilómetro kilómetros;m metro metros;cm centímetro centímetros;mm milímetro milímetros;ml mililitro mililitros;l litro litros;h hora horas;min minuto minutos;mph milla_por_hora millas_por_hora"), per="por",
        whitelist={"Dra.": "Doctora", "Dr.": "Doctor", "Sra.": "Señora", "Sr.": "Señor"}, names={":": "dos puntos", "/": "barra", ".": "punto", "@": "arroba", "-": "guion", "_": "guion bajo"}),
    "fr": Voice("moins", "virgule", percent="pour cent", after="pairs", months=tuple(_FR.split())),
    "de": Voice("minus", "komma", percent="prozent", months=tuple(_DE.split()), thousands=r"[  ]",
        money={"$": ("dollar", "dollar", "cent", "cent"), "€": ("euro", "euro", "cent", "cent"), "£": ("pfund", "pfund", "penny", "pence")},
        units=_units("kg kilogramm kilogramm;g gramm gramm;mg milligramm milligramm;km kilometer kilometer;m meter meter;cm zentimeter zentimeter;mm millimeter millimeter;ml milliliter milliliter;l liter liter;h stunde stunden;min minute minuten;mv millivolt millivolt;kwh kilowattstunde kilowattstunden;°C grad_celsius grad_celsius;m² quadrat_meter quadrat_meter;m³ kubik_meter kubik_meter;cm³ kubik_zentimeter kubik_zentimeter;km² quadrat_kilometer quadrat_kilometer"), per="pro",
        whitelist={"Dr.": "doktor"}, names={":": "doppelpunkt", "/": "slash", ".": "punkt", "@": "at", "-": "strich", "_": "unterstrich"}),
    "pt": Voice("menos", "vírgula", percent="por cento", of=" de ", months=tuple(_PT.split()), minor_joint=" e ",
        money={"R$": ("real", "reais", "centavo", "centavos"), "$": ("dólar", "dólares", "centavo", "centavos"), "€": ("euro", "euros", "centavo", "centavos"), "£": ("libra", "libras", "pence", "pence")},
        units=_units("kg quilo quilos;g grama gramas;mg miligrama miligramas;km quilômetro quilômetros;m metro metros;cm centímetro centímetros;mm milímetro milímetros;ml mililitro mililitros;l litro litros;m² metro_quadrado metros_quadrados;°C grau_celsius graus_celsius;min minuto minutos"),
        names={":": "dois pontos", "/": "barra", ".": "ponto", "@": "arroba", "-": "hífen", "_": "sublinhado"}),
    "it": Voice("meno", "virgola", percent="percento", after="number", months=tuple(_IT.split()), thousands=r"[  ]",
        money={"€": ("euro", "euro", "centesimo", "centesimi"), "eur": ("euro", "euro", "centesimo", "centesimi"), "$": ("dollaro", "dollari", "centesimo", "centesimi"), "£": ("sterlina", "sterline", "penny", "penny"), "₽": ("rublo", "rubli", "copeca", "copechi")},
        units=_units("kg chilogrammo chilogrammi;g grammo grammi;km chilometro chilometri;m metro metri;cm centimetro centimetri;mm millimetro millimetri;ml millilitro millilitri;l litro litri;h ora ore;min minuto minuti;s secondo secondi;A ampere ampere;d giorno giorni;°C grado_celsius grado_celsius"), per="per",
        names={":": "due punti", "/": "slash", ".": "punto", "@": "chiocciola", "-": "trattino", "_": "trattino basso"}),
    "sv": Voice("minus", "komma", percent="procent", after="number", months=tuple(_SV.split()),
        money={"$": ("dollar", "dollar", "cent", "cent"), "€": ("euro", "euro", "cent", "cent"), "£": ("pund", "pund", "penny", "pence"), "kr": ("krona", "kronor", "öre", "öre"), "₩": ("won", "won", "", ""), "¥": ("yen", "yen", "", "")},
        units=_units("kg kilogram kilogram;g gram gram;km kilometer kilometer;m meter meter;cm centimeter centimeter;mm millimeter millimeter;ml milliliter milliliter;min minut minuter;tim timme timmar;°C celsiusgrad celsiusgrader"), per="per"),
    "hu": Voice("mínusz", "egész", percent="százalék", after="denominator", money={"$": ("dollár", "dollár", "cent", "cent"), "€": ("euró", "euró", "cent", "cent"), "£": ("font", "font", "penny", "penny")},
        units=_units("kg kilogramm kilogramm;g gramm gramm;km kilométer kilométer;m méter méter;cm centiméter centiméter;mm milliméter milliméter;ml milliliter milliliter;l liter liter;min perc perc")),
    "hy": Voice("մինուս", "ամբողջ", percent="տոկոս", after="denominator", units=_units("կգ կիլոգրամ կիլոգրամ;կմ կիլոմետր կիլոմետր")),
    "vi": Voice("âm", "phẩy", percent="phần trăm", money={"₫": ("đồng", "đồng", "", ""), "$": ("đô la", "đô la", "xu", "xu"), "usd": ("đô la", "đô la", "xu", "xu"), "USD": ("đô la", "đô la", "xu", "xu"), "€": ("ơ rô", "ơ rô", "xu", "xu"), "¥": ("yên nhật", "yên nhật", "", ""), "£": ("bảng anh", "bảng anh", "xu", "xu"), "₹": ("rupee", "rupee", "", "")},
        units=_units("kg ki_lô_gam ki_lô_gam;g gam gam;mg mi_li_gam mi_li_gam;km ki_lô_mét ki_lô_mét;m mét mét;cm xăng_ti_mét xăng_ti_mét;mm mi_li_mét mi_li_mét;ml mi_li_lít mi_li_lít;l lít lít;inch inch inch;m² mét_vuông mét_vuông;m³ mét_khối mét_khối;cm³ xăng_ti_mét_khối xăng_ti_mét_khối;km² ki_lô_mét_vuông ki_lô_mét_vuông;°C độ_C độ_C;gb gi_ga_bai gi_ga_bai;mb mê_ga_bai mê_ga_bai;v vôn vôn;w oát oát;kw ki_lô_oát ki_lô_oát;ha héc_ta héc_ta;hz héc héc"), per="trên"),
    "ru": Voice("минус", "целых", percent="процентов", after="denominator", thousands=r"[.  ]"),
    "ar": Voice("سالب", "فاصلة", comma=False, thousands=r",", percent="في المئة", after="number", money={"$": ("دولار", "دولار", "سنت", "سنتات"), "€": ("يورو", "يورو", "سنت", "سنتات"), "د.ك": ("دينار كويتي", "دينار كويتي", "فلس", "فلس")}, minor_joint=" و"),
    "rw": Voice("minus", "virgule", thousands=r"(?!)"),
    "hi": Voice("ऋणात्मक", "दशमलव", comma=False, thousands=r"(?!)", money={"₹": ("रुपया", "रुपए", "पैसा", "पैसे"), "$": ("डॉलर", "डॉलर", "सेंट", "सेंट"), "£": ("पाउंड", "पाउंड", "पेंस", "पेंस"), "€": ("यूरो", "यूरो", "सेंट", "सेंट")}, minor_joint=" ",
        units=_units("kg किलोग्राम किलोग्राम;g ग्राम ग्राम;km किलोमीटर किलोमीटर;m मीटर मीटर;cm सेंटीमीटर सेंटीमीटर;mm मिलीमीटर मिलीमीटर;ml मिलीलीटर मिलीलीटर;l लीटर लीटर;ac एकड़ एकड़;ft फ़ुट फीट;K केल्विन केल्विन;oz आउन्स आउन्स;yr साल साल;pt पिंट पिंट;dg डेसीग्राम डेसीग्राम;mi मील मील;hr घंटा घंटे;min मिनट मिनट;s सेकंड सेकंड;cl सेंटीलीटर सेंटीलीटर;t टन टन"), per="प्रति"),
    "zh": Voice("负", "点", comma=False, thousands=",", percent="百分之", units=_units("kg 千克 千克;g 克 克;km 千米 千米;m 米 米;cm 厘米 厘米;mm 毫米 毫米;ml 毫升 毫升;℃ 摄氏度 摄氏度"), money={"$": ("美元", "美元", "", ""), "€": ("欧元", "欧元", "", ""), "¥": ("元", "元", "", ""), "￥": ("元", "元", "", ""), "£": ("英镑", "英镑", "", "")}),
    "ja": Voice("マイナス", "点", comma=False, thousands=r"(?!)"),
    "ko": Voice("마이너스", "점", comma=False, thousands=",", percent=" 퍼센트",
        money={"₩": ("원", "원", "", ""), "$": ("달러", "달러", "센트", "센트"), "€": ("유로", "유로", "센트", "센트"), "£": ("파운드", "파운드", "펜스", "펜스"), "¥": ("엔", "엔", "", ""), "CAD": ("캐나다 달러", "캐나다 달러", "", "")},
        units=_units("kg 킬로그램 킬로그램;g 그램 그램;mg 밀리그램 밀리그램;km 킬로미터 킬로미터;m 미터 미터;cm 센티미터 센티미터;mm 밀리미터 밀리미터;ml 밀리리터 밀리리터;l 리터 리터"), per="퍼"),
}

_HU_PARTS = ("", "tized", "század", "ezred", "tízezred", "százezred", "milliomod")
_RU_PARTS = ("", "десят", "сот", "тысячн", "десятитысячн", "стотысячн", "миллионн")
_HY_PARTS = ("", "տասնորդական", "հարյուրերորդական", "հազարերորդական")
_FR_ORDINALS = {"un": "uni", "cinq": "cinqui", "neuf": "neuvi"}
_ES_ORDINALS = "_ primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo undécimo duodécimo".split()
_ES_ORDINAL_TENS = "_ décimo vigésimo trigésimo cuadragésimo quincuagésimo sexagésimo septuagésimo octogésimo nonagésimo".split()
_PT_ORDINALS = "_ primeiro segundo terceiro quarto quinto sexto sétimo oitavo nono décimo".split()
_PT_ORDINAL_TENS = "_ décimo vigésimo trigésimo quadragésimo quinquagésimo sexagésimo septuagésimo octogésimo nonagésimo".split()
_DE_ORDINALS = {"eins": "erster", "drei": "dritter", "sieben": "siebter", "acht": "achter", "null": "nullter"}
_SV_ORDINALS = "_ första andra tredje fjärde femte sjätte sjunde åttonde nionde tionde elfte tolfte trettonde fjortonde femtonde sextonde sjuttonde artonde nittonde".split()
_VI_ORDINALS = {1: "nhất", 4: "tư"}
_ES_ORDINAL_HUNDREDS = "_ centésimo ducentésimo tricentésimo cuadringentésimo quingentésimo sexcentésimo septingentésimo octingentésimo noningentésimo".split()
_HI_ORDINALS = {1: "पहल", 2: "दूसर", 3: "तीसर", 4: "चौथ", 6: "छठ"}
_RU_ORDINALS = "нулев перв втор трет четверт пят шест седьм восьм девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат".split()
_RU_ORDINAL_TENS = "_ _ двадцат тридцат сороков пятидесят шестидесят семидесят восьмидесят девяност".split()
_RU_ORDINAL_HUNDREDS = "_ сот двухсот трехсот четырехсот пятисот шестисот семисот восьмисот девятисот".split()
_RU_ENDINGS = {"я": "ая", "е": "ое", "го": "ого", "м": "ом", "му": "ому", "х": "ых", "ю": "ую"}
_KO_NATIVE = "_ 한 두 세 네 다섯 여섯 일곱 여덟 아홉".split()
_KO_NATIVE_TENS = "_ 열 스물 서른 마흔 쉰 예순 일흔 여든 아흔".split()
_AR_PARTS = "_ واحد|نصف نصفان|ثلث أثلاث|ربع أرباع|خمس أخماس|سدس أسداس|سبع أسباع|ثمن أثمان|تسع أتساع|عشر أعشار".split("|")
_AR_PLACES = ("", "عشرة", "مئة", "ألف", "عشرة آلاف", "مئة ألف", "مليون")


# Ordinals, month names and letters of the languages whose written forms have them.
_HU_ORDINALS = "nulladik első második harmadik negyedik ötödik hatodik hetedik nyolcadik kilencedik tizedik".split()
_HU_ORDINAL_TENS = "_ tizedik huszadik harmincadik negyvenedik ötvenedik hatvanadik hetvenedik nyolcvanadik kilencvenedik".split()
_HU_MONTHS = "január február március április május június július augusztus szeptember október november december".split()
_HU_FORINT = {"": "forint", "-ba": "forintba", "-ot": "forintot", "-ért": "forintért", "-tal": "forinttal"}
_HY_ORDINALS = {1: "առաջին", 2: "երկրորդ", 3: "երրորդ", 4: "չորրորդ"}
_RU_HOURS = "первого второго третьего четвертого пятого шестого седьмого восьмого девятого десятого одиннадцатого двенадцатого".split()
_RU_UNITS = {"кг": "килограмм килограмма килограммов", "г": "грамм грамма граммов", "мг": "миллиграмм миллиграмма миллиграммов", "км": "километр километра километров", "м": "метр метра метров", "см": "сантиметр сантиметра сантиметров", "мм": "миллиметр миллиметра миллиметров", "л": "литр литра литров", "мл": "миллилитр миллилитра миллилитров", "₽": "рубль рубля рублей"}
_HI_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "ए बी सी डी ई एफ जी एच आई जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू एक्स वाई ज़ेड".split(), strict=True))
_HI_MARKS = {":": "कोलन", "/": "फॉरवर्ड स्लैश", ".": "डॉट", "@": "एट", "-": "हाइफ़न", "_": "अंडरस्कोर"}
_HI_DOMAINS = {"com": "कॉम", "in": "इन", "org": "ऑर्ग", "net": "नेट"}
_HU_MARKS = {":": "kettőspont", "/": "perjel", ".": "pont", "@": "kukac", "-": "kötőjel", "_": "aláhúzás"}


def _hu_ordinal(n: int) -> str:
    low = n % 100
    if low <= 10 and (low or not n):
        last = _HU_ORDINALS[low] if low > 2 or n < 10 else {1: "egyedik", 2: "kettedik"}[low]
        return (say(n - low, "hu") if n > low else "") + last
    if low and low % 10 == 0:
        return (say(n - low, "hu") if n > low else "") + _HU_ORDINAL_TENS[low // 10]
    if not low:
        return say(n, "hu") + "adik"
    return (say(n - low, "hu") if n > low else "") + {1: "tizen", 2: "huszon"}.get(low // 10, world.HU_TENS[low // 10]) + {1: "egyedik", 2: "kettedik"}.get(low % 10, _HU_ORDINALS[low % 10])


def _hu_day(day: str, end: str) -> str:
    """A day of the month, which one falls on with -n, and which it is with none."""
    d = int(day)
    said = "elseje" if d == 1 else _hu_ordinal(d) + ("a" if re.search("[aáoóuú][^eéiíöőüű]*$", _hu_ordinal(d)[:-3]) else "e")
    return said[:-1] + {"a": "á", "e": "é"}[said[-1]] + "n" if end else said


def _hu_letters(text: str) -> str:
    parts = re.findall(r"(?<=\.)(?:com|org|net|hu|eu)(?![\w])|\d|[^\W\d_]|[:/.@\-_]", text)
    return " ".join(_HU_MARKS.get(p) or (say(int(p), "hu") if p.isdigit() else p.lower()) for p in parts)


def _hi_letters(text: str) -> str:
    parts = re.findall(r"(?<=\.)(?:com|in|org|net)(?!\w)|[A-Za-z]|\d|[:/.@\-_]", text)
    return " ".join(_HI_DOMAINS.get(p) or _HI_MARKS.get(p) or (say(int(p), "hi") if p.isdigit() else _HI_LETTERS[p.lower()]) for p in parts)


def _hi_clock(hour: str, minute: str) -> str:
    h, m = int(hour), int(minute)
    if not m:
        return say(h, "hi")
    if m == 45 and h <= 12:
        return f"पौने {say(h % 12 + 1, 'hi')}"
    if m in (15, 30) and h <= 12:
        return {1: "डेढ़", 2: "ढाई"}.get(h, f"साढ़े {say(h, 'hi')}") if m == 30 else f"सवा {say(h, 'hi')}"
    return f"{say(h, 'hi')} बजकर {say(m, 'hi')} मिनट"


def _ru_counted(n: int, forms: str, feminine: bool = False) -> str:
    return f"{world._ru(n % 1000, feminine) if n < 1000 else say(n, 'ru')} {world._slavic(n, *forms.split())}"


def _ru_clock(hour: str, minute: str) -> str:
    h, m = int(hour), int(minute)
    if m == 30 and 0 < h < 13:
        return f"тридцать минут {_RU_HOURS[h % 12]}"
    if m == 45:
        return f"без пятнадцати минут {say((h + 1) % 12 or 12, 'ru')}"
    minutes = _ru_counted(m, "минута минуты минут", True)
    return f"{_ru_counted(h, 'час часа часов')} {minutes}"


def _ru_measure(amount: str, unit: str) -> str:
    forms = _RU_UNITS[unit]
    if "," in amount:
        return f"{number(amount, 'ru')} {forms.split()[1]}"
    return _ru_counted(int(re.sub(r"\D", "", amount)), forms)


def _ko_count(n: int) -> str:
    """Native words of a count below 100, before a noun."""
    return "스무" if n == 20 else (_KO_NATIVE_TENS[n // 10] if n > 9 else "") + (_KO_NATIVE[n % 10] if n % 10 else "")


def _ko_hour(hour: str) -> str:
    return _ko_count(int(hour)) if 0 < int(hour) < 13 else say(int(hour), "ko")


def _ru_ordinal(n: int, ending: str) -> str:
    """Russian ordinal with the ending that stands behind the digits."""
    low = n % 100
    if low == 0 and n >= 100:
        head, stem = n - n % 1000, _RU_ORDINAL_HUNDREDS[n // 100 % 10] if n % 1000 else "тысячн"
    elif low < 20 or low % 10 == 0:
        head, stem = n - low, _RU_ORDINALS[low] if low < 20 else _RU_ORDINAL_TENS[low // 10]
    else:
        head, stem = n - n % 10, _RU_ORDINALS[n % 10]
    if stem == "трет":
        said = "третий" if ending == "й" else "трет" + {"я": "ья", "е": "ье", "го": "ьего", "м": "ьем", "му": "ьему", "х": "ьих", "ю": "ью"}[ending]
    elif ending == "й":
        said = stem + ("ой" if stem in ("нулев", "втор", "шест", "седьм", "восьм", "сороков") else "ый")
    else:
        said = stem + _RU_ENDINGS[ending]
    return f"{say(head, 'ru')} {said}" if head else said


def _roman(text: str, lang: str) -> str | None:
    n = english.roman(text.upper())
    return say(n, lang)


def _hi_ordinal(n: int, ending: str) -> str:
    if n in _HI_ORDINALS:
        return _HI_ORDINALS[n] + {"ां": "ा", "ीं": "ी", "ें": "े"}.get(ending, ending)
    return say(n, "hi") + "व" + {"ा": "ां", "ी": "ीं", "े": "ें"}.get(ending, ending)


def ordinal(n: int, lang: str) -> str | None:
    """Ordinal words, masculine; null where the language has none here."""
    if lang == "fr":
        if n == 1:
            return "premier"
        words = re.sub(r"(quatre-vingt|cent|million|milliard)s$", r"\1", say(n, "fr"))
        head, last = re.match(r"(.*?)([^\s-]+)$", words).groups()
        return head + (_FR_ORDINALS.get(last) or last.removesuffix("e") + "i") + "ème"
    if lang in ("es", "pt"):
        low, tens = (_ES_ORDINALS, _ES_ORDINAL_TENS) if lang == "es" else (_PT_ORDINALS, _PT_ORDINAL_TENS)
        if n < len(low):
            return low[n]
        if lang == "es" and 12 < n < 30:
            return {1: "decimo", 2: "vigesimo"}[n // 10] + low[n % 10] if n % 10 else tens[n // 10]
        if lang == "es" and 100 <= n < 1000:
            return _ES_ORDINAL_HUNDREDS[n // 100] + (f" {ordinal(n % 100, 'es')}" if n % 100 else "")
        if lang == "es" and n == 1000:
            return "milésimo"
        return f"{tens[n // 10]} {low[n % 10]}" if n < 100 and n % 10 else tens[n // 10] if n < 100 else None
    if lang == "de":
        words = say(n, "de")
        head, _, last = words.rpartition(" ")
        said = _DE_ORDINALS.get(last) or last + ("ter" if n % 100 < 20 and n % 100 else "ster")
        return f"{head} {said}".strip()
    if lang == "sv":
        if n < 20:
            return _SV_ORDINALS[n]
        return world.words(n - n % 10, "sv") + _SV_ORDINALS[n % 10] if n % 10 and n < 100 else world.words(n, "sv") + "nde" if n < 100 else None
    if lang == "vi":
        return _VI_ORDINALS.get(n) or say(n, "vi")
    if lang in ("zh", "ja"):
        return "第" + say(n, lang)
    return None


def after_point(digits: str, lang: str) -> str:
    """The digits behind a decimal sign."""
    voice = VOICES[lang]
    rest = digits.lstrip("0")
    if voice.after == "digit" or not rest:
        return spell(digits, lang)
    zeros = [spell("0", lang)] * (len(digits) - len(rest))
    if voice.after == "pairs" and len(digits) > 3 and len(digits) % 2 == 0 and not zeros:
        return " ".join(say(int(digits[k : k + 2]), lang) for k in range(0, len(digits), 2))
    if lang == "sv" and len(digits) > 3:
        return spell(digits, lang)
    return " ".join([*zeros, say(int(rest), lang)])


def number(text: str, lang: str, plain: bool = False) -> str:
    """An integer or a decimal as written in the language."""
    voice = VOICES[lang]
    tight = lang in ("zh", "ja", "ko")
    minus = text[0] in "-−"
    whole, _, rest = text.lstrip("-−").partition("," if voice.comma else ".")
    whole = re.sub(r"\D", "", whole)
    padded = len(whole) > 1 and whole[0] == "0"
    said = spell(whole, lang) if padded and lang not in ("es", "vi", "zh", "ja") else say(int(whole or "0"), lang)
    if rest:
        places = len(rest)
        if lang == "hu" and places < len(_HU_PARTS):
            said = f"{said} egész {say(int(rest), 'hu')} {_HU_PARTS[places]}"
        elif lang == "ru" and places < len(_RU_PARTS):
            a, b, one = int(whole), int(rest), lambda k: k % 10 == 1 and k % 100 != 11
            said = f"{world._ru_thousands(a).rpartition(' ')[0] if a < 1000 else say(a, 'ru')} {'целая' if one(a) else 'целых'} {world._ru_thousands(b).rpartition(' ')[0] if b < 1000 else say(b, 'ru')} {_RU_PARTS[places]}{'ая' if one(b) else 'ых'}"
        elif lang == "hy" and places < len(_HY_PARTS):
            said = f"{said} ամբողջ {say(int(rest), 'hy')} {_HY_PARTS[places]}"
        elif lang == "ar" and places < len(_AR_PLACES):
            said = f"{said} و{say(int(rest), 'ar')} من {_AR_PLACES[places]}"
        elif lang == "sv" and said == "ett":
            said = f"en komma {after_point(rest, lang)}"
        else:
            space = "" if tight else " "
            said = f"{said}{space}{voice.point}{space}{after_point(rest, lang)}"
    return (voice.minus + ("" if lang in ("zh", "ja") else " ") if minus else "") + said


def _one(text: str) -> bool:
    return re.fullmatch(r"1(?:[.,]0+)?", text) is not None


def _counted(text: str, noun: str, lang: str) -> str:
    """A number that counts a noun."""
    said = number(text, lang)
    if lang == "es":
        if noun in VOICES["es"].feminine:
            return re.sub(r"ientos\b", "ientas", re.sub(r"\bun\b|\buno\b", "una", re.sub("veintiuno?$", "veintiuna", said))).replace("quinientos", "quinientas")
        return _before_noun(said) if "," not in text else said
    if lang == "de" and said == "eins":
        return "ein"
    if lang == "sv" and said == "ett" and noun in ("krona", "dollar", "euro", "minut", "timme"):
        return "en"
    return said


def money(amount: str, sign: str, lang: str, scale: str = "") -> str:
    voice = VOICES[lang]
    one, many, minor_one, minor_many = voice.money[sign]
    if lang in ("zh", "ja"):
        return number(amount, lang) + scale + many
    if lang == "ko" and sign == "₩":
        return number(amount, lang) + scale + many
    if lang == "ko" and scale:
        return f"{number(amount, lang)}{scale} {many}"
    if scale:
        return f"{number(amount, lang)} {scale} {'de ' if lang in ('es', 'pt') else ''}{many}"
    mark = "," if voice.comma else "."
    whole, _, rest = amount.partition(mark)
    rest = rest.rstrip("0")
    if rest and (len(rest) > 2 or not minor_one):
        return f"{number(f'{whole}{mark}{rest}', lang)} {many}"
    major, minor = int(re.sub(r"\D", "", whole) or 0), int(rest.ljust(2, "0")) if rest else 0
    parts = [f"{_counted(str(major), one if major == 1 else many, lang)} {one if major == 1 else many}"] if major or not minor else []
    if minor:
        parts.append(f"{_counted(str(minor), minor_one if minor == 1 else minor_many, lang)} {minor_one if minor == 1 else minor_many}")
    return voice.minor_joint.join(parts)


def measure(amount: str, unit: str, lang: str, per: str = "") -> str:
    voice = VOICES[lang]
    one, many = voice.units.get(unit) or voice.units[unit.lower()]
    noun = one if _one(amount.lstrip("-")) else many
    tail = ""
    if per:
        hour = {"es": "hora", "de": "stunde", "it": "ora", "sv": "timme", "vi": "giờ"}.get(lang, "")
        tail = f" {voice.per} {hour if per == 'h' else voice.units.get(per, (per,))[0]}"
    return _counted(amount, noun, lang) + ("" if lang in ("zh", "ja") else " ") + noun + tail


def percent(amount: str, lang: str) -> str:
    voice = VOICES[lang]
    return f"百分之{number(amount, lang)}" if lang == "zh" else number(amount, lang) + (voice.percent if voice.percent.startswith(" ") else f" {voice.percent}")


def year(text: str, lang: str) -> str:
    n = int(text)
    if lang == "de" and 1100 <= n < 2000:
        return f"{say(n // 100, 'de')}" + (f" {say(n % 100, 'de')}" if n % 100 else " hundert")
    if lang == "zh":
        return spell(text, "zh")
    if lang == "sv" and 2010 <= n < 2100:
        return f"tjugo{say(n % 100, 'sv')}"
    return say(n, lang)


def date(day: str, month: int, year_text: str, lang: str) -> str:
    voice, d = VOICES[lang], int(day)
    tail = year(year_text, lang) if year_text else ""
    if lang in ("zh", "ja", "ko"):
        marks, space = ("年月日", "") if lang != "ko" else ("년월일", " ")
        name = {6: "유", 10: "시"}.get(month) if lang == "ko" else None
        return space.join(([tail + marks[0]] if tail else []) + [(name or say(month, lang)) + marks[1], say(d, lang) + marks[2]])
    if lang == "vi":
        return f"{say(d, 'vi')} tháng {'tư' if month == 4 else say(month, 'vi')}" + (f" năm {tail}" if tail else "")
    said = ordinal(d, lang) if lang in ("de", "sv") else {"es": "primero", "fr": "premier", "pt": "primeiro"}.get(lang) if d == 1 and lang in ("es", "fr", "pt") else say(d, lang)
    return f"{said}{voice.of}{voice.months[month - 1]}" + (f"{voice.of}{tail}" if tail else "")


def clock(hour: str, minute: str, lang: str, second: str = "") -> str | None:
    h, m, s = int(hour), int(minute), int(second or 0)
    if lang == "es":
        said = re.sub(r"uno$", "una", re.sub("veintiuno", "veintiuna", say(h, "es")))
        return said if not m else f"{said} y {'media' if m == 30 else 'cuarto' if m == 15 else say(m, 'es')}"
    if lang == "de":
        return f"{'ein' if h == 1 else say(h, 'de')} uhr" + (f" {say(m, 'de')}" if m else "")
    if lang == "it":
        return f"{say(h, 'it')} e {'mezza' if m == 30 else 'un quarto' if m == 15 else say(m, 'it') + ' minuti'}" if m else None
    if lang == "sv":
        return f"{say(h, 'sv')} {say(m, 'sv')}" if m else None
    if lang == "zh":
        return f"{say(h, 'zh')}点{say(m, 'zh')}分" + (f"{say(s, 'zh')}秒" if second else "")
    if lang == "ja":
        return f"{say(h, 'ja')}時{say(m, 'ja')}分" + (f"{say(s, 'ja')}秒" if second else "") if m or second else None
    if lang == "vi":
        return f"{say(h, 'vi')} giờ" + (f" {say(m, 'vi')} phút" if m or second else "") + (f" {say(s, 'vi')} giây" if second else "")
    return None


_ES_PARTS = {2: "medio", 3: "tercio", 10: "décimo", 11: "onceavo", 12: "doceavo"}
_DE_PARTS = {2: "halb", 3: "drittel", 7: "siebtel", 8: "achtel"}


def fraction(top: str, bottom: str, lang: str) -> str | None:
    a, b = int(top), int(bottom)
    if lang == "zh":
        return f"{say(b, 'zh')}分之{say(a, 'zh')}"
    if lang == "ja":
        return f"{say(b, 'ja')}分の{say(a, 'ja')}"
    if lang == "ko":
        return f"{say(b, 'ko')}분의 {say(a, 'ko')}"
    if lang == "vi":
        return f"{say(a, 'vi')} phần {'tư' if b == 4 else say(b, 'vi')}"
    if lang == "hi":
        return f"{say(a, 'hi')} बटा {say(b, 'hi')}"
    if lang == "ar" and b > 0:
        if b > 10:
            return None
        one, many = _AR_PARTS[b - 1].split()
        return one if a == 1 else f"{say(a, 'ar')} {many}"
    if lang == "de" and b > 1:
        name = _DE_PARTS.get(b) or say(b, "de") + ("tel" if b % 100 < 20 else "stel")
        return f"{'ein' if a == 1 else say(a, 'de')} {name}"
    if lang == "es" and b > 1:
        name = _ES_PARTS.get(b) or {100: "centésimo", 1000: "milésimo"}.get(b) or (_ES_ORDINALS[b] if b < 10 else re.sub("[oae]$", "", say(b, "es").replace(" y ", "i")) + "avo" if b < 100 else None)
        return f"{say(a, 'es')} sobre {say(b, 'es')}" if name is None else "medio" if (a, b) == (1, 2) else f"{_before_noun(say(a, 'es'))} {name}{'s' if a > 1 else ''}"
    if lang == "pt" and b > 1:
        name = {2: "meio", 3: "terço"}.get(b) or (_PT_ORDINALS[b] if b < 11 else f"{say(b, 'pt')} avo")
        return f"{say(a, 'pt')} {name}{'s' if a > 1 else ''}"
    if lang == "fr" and b > 1:
        name = {2: "demi", 3: "tiers", 4: "quart"}.get(b) or ordinal(b, "fr")
        return f"{say(a, 'fr')} {name}{'s' if a > 1 and b != 3 else ''}"
    return None


def electronic(text: str, lang: str) -> str:
    names = VOICES[lang].names
    return " ".join(say(int(c), lang) if c.isdigit() else names.get(c, c) for c in re.sub(r"\.(com)\b", ".\x01", text)).replace("\x01", "com")


@functools.cache
def _rules(lang: str) -> tuple[re.Pattern, list]:
    """The compiled alternation of a language, and its readers by group number."""
    v = VOICES[lang]
    word = lang not in ("zh", "ja", "ko")
    begin, end = (r"(?<![\w.,])", r"(?!\w)") if word else (r"(?<![A-Za-z\d.])", r"(?![A-Za-z\d])" if lang == "zh" else r"(?!\d)")
    mark = "," if v.comma else r"\."
    whole = rf"(?:\d{{1,3}}(?:{v.thousands}\d{{3}})+(?!\d)|\d+)"
    num = rf"[-−]?{whole}(?:{mark}\d+)?"
    rules: list[tuple[str, str, object]] = []
    add = lambda kind, pattern, read: rules.append((kind, pattern, read))
    address = r"https?://[\w./\-]*\w|www\.[\w./\-]*\w|[\w.\-]+@[\w\-]+(?:\.[\w\-]+)+"
    add("electronic", f"({address})", (lambda g: electronic(g[0], lang)) if v.names else {"hu": lambda g: _hu_letters(g[0]), "hi": lambda g: _hi_letters(g[0])}.get(lang, lambda g: g[0]))
    if v.whitelist:
        add("whitelist", rf"(?<!\w)({'|'.join(re.escape(k) for k in v.whitelist)})(?=\s)", lambda g: v.whitelist[g[0]])
    if v.names:
        dot = v.names["."]
        add("version", r"(?<![\w.])(\d+(?:\.\d+){2,})(?![\w.]?\d)", lambda g: f" {dot} ".join(spell(p, lang) for p in g[0].split(".")))
    if v.months or lang in ("zh", "ja", "ko", "vi"):
        add("date", begin + r"(\d{4})-(0[1-9]|1[0-2])-([0-2]\d|3[01])(?!\w)" if word else begin + r"(\d{4})-(0?[1-9]|1[0-2])-([0-2]?\d|3[01])(?!\d)", lambda g: ("ngày " if lang == "vi" else "") + date(g[2], int(g[1]), g[0], lang))
    if lang in ("es", "fr", "pt", "vi"):
        add("date", begin + r"(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/(\d{4})" + end, lambda g: date(g[0], int(g[1]), g[2], lang))
    if lang in ("ja", "ko"):
        add("date", begin + r"(\d{4})/(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])(?!\d)", lambda g: date(g[2], int(g[1]), g[0], lang))
    if lang == "zh":
        add("date", begin + r"(\d{4})年(\d{1,2})月(\d{1,2})日", lambda g: date(g[2], int(g[1]), g[0], lang))
        add("year", begin + r"(\d{4})年", lambda g: year(g[0], lang) + "年")
    if v.months:
        names = "|".join(v.months)
        add("date", begin + rf"(\d{{1,2}})(?:\.|er|º|ª|°)? ?(?:de )?((?i:{names}))(?:(?: de)? (\d{{4}}))?" + end, lambda g: date(g[0], v.months.index(g[1].lower()) + 1, g[2] or "", lang))
    if clock("1", "20", lang):
        tail = " ?(?:Uhr|uhr)" if lang == "de" else ""
        add("time", begin + rf"([01]?\d|2[0-4]):([0-5]\d)(?::([0-5]\d))?{tail}(?![\w:])" if word else begin + r"([01]?\d|2[0-4]):([0-5]\d)(?::([0-5]\d))?(?!\d)", lambda g: clock(g[0], g[1], lang, g[2] or ""))
    if lang == "de":
        add("time", begin + r"([01]?\d|2[0-4]) (?:Uhr|uhr)" + end, lambda g: clock(g[0], "0", "de"))
    if v.money:
        signs = "|".join(re.escape(s) for s in sorted(v.money, key=len, reverse=True))
        scale = {"es": "millón|millones|billón|billones", "de": "million|millionen|milliarde|milliarden", "pt": "milhão|milhões|bilhão|bilhões", "sv": "miljon|miljoner|miljard|miljarder", "it": "milioni|miliardi", "zh": "万|亿", "ko": "만|억|조", "vi": "triệu|tỷ"}.get(lang, "(?!)")
        add("money", rf"(?<![\w.,])({signs}) ?({whole}(?:{mark}\d+)?)(?: ?({scale}))?" + (end if word else ""), lambda g: money(g[1], g[0], lang, g[2] or ""))
        if lang not in ("de", "hi", "ko"):
            add("money", rf"{begin}({whole}(?:{mark}\d+)?)(?: ({scale}))? ?({signs})" + (end if word else ""), lambda g: money(g[0], g[2], lang, g[1] or ""))
    if v.percent:
        add("percent", rf"{begin}({num}) ?%(?!\w)" if word else rf"{begin}({num}) ?%", lambda g: percent(g[0], lang))
    if v.units:
        units = "|".join(re.escape(u) for u in sorted(v.units, key=len, reverse=True))
        per = "|h" if v.per else ""
        add("measure", rf"{begin}({num}) ?({units})(?:/({units}{per}))?(?![\w/²³])" if word else (rf"{begin}({num}) ?({units})(?:/({units}))?(?![A-Za-z/가-힣])" if lang == "ko" else rf"{begin}({num}) ?({units})(?![A-Za-z/])"), lambda g: measure(g[0], g[1], lang, (g[2] if len(g) > 2 else "") or ""))
    if fraction("1", "2", lang):
        add("fraction", rf"{begin}(\d+)/([1-9]\d*)" + (r"(?![\w/])" if word else r"(?![\d/])"), lambda g: fraction(g[0], g[1], lang))
    if lang == "ko":
        add("time", begin + r"([01]?\d|2[0-4]):([0-5]\d)(?::([0-5]\d))?(?![\d:])", lambda g: _ko_hour(g[0]) + "시" + (f" {say(int(g[1]), 'ko')}{'분' if int(g[1]) else ''}" if int(g[1]) else "") + (f" {say(int(g[2]), 'ko')}초" if g[2] else "") + " ")
        add("time", begin + r"([01]?\d|2[0-4])시(?: ([0-5]?\d)분)?(?=[가-힣]?)", lambda g: _ko_hour(g[0]) + "시" + (f" {say(int(g[1]), 'ko')}분" if g[1] else "") + " ")
        add("date", begin + r"(\d{4})년 (\d{1,2})월 (\d{1,2})일", lambda g: f"{say(int(g[0]), 'ko')}년 {({6: '유', 10: '시'}.get(int(g[1])) or say(int(g[1]), 'ko'))}월 {say(int(g[2]), 'ko')} 일")
        add("date", begin + r"(\d{1,2})월 (\d{1,2})일", lambda g: f"{({6: '유', 10: '시'}.get(int(g[0])) or say(int(g[0]), 'ko'))}월 {say(int(g[1]), 'ko')} 일")
        add("money", rf"{begin}(\d{{1,3}}(?:,\d{{3}})+)원(?=[가-힣])", lambda g: number(g[0], "ko") + "원 ")
        add("count", begin + r"([1-9])(장|명|권|잔)(?![가-힣]월)", lambda g: _ko_count(int(g[0])) + g[1])
        add("ordinal", r"(?<!\d)([1-9]\d?)번째", lambda g: (("첫" if g[0] == "1" else ("스무" if g[0] == "20" else (_KO_NATIVE_TENS[int(g[0]) // 10] if len(g[0]) > 1 else "") + (_KO_NATIVE[int(g[0]) % 10] if int(g[0]) % 10 else "")))) + "번째")
        add("number", rf"{begin}({num})(?=[가-힣A-Za-z℃°]|입)", lambda g: number(g[0], "ko") + " ")
    if lang == "hu":
        months = "|".join(_HU_MONTHS)
        add("date", begin + rf"(?:(\d{{4}})\. )?((?i:{months})) (\d{{1,2}})(?:-(?:j?[eéáa]n)|(\.))(?!\w)", lambda g: (say(int(g[0]), "hu") + " " if g[0] else "") + f"{g[1]} {_hu_day(g[2], '' if g[3] else 'n')}")
        add("date", begin + rf"(\d{{4}})\. ((?i:{months}))", lambda g: f"{say(int(g[0]), 'hu')} {g[1]}")
        add("date", begin + r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?!\w)", lambda g: f"{say(int(g[0]), 'hu')} {_HU_MONTHS[int(g[1]) - 1]} {_hu_day(g[2], '')}")
        add("time", begin + r"(\d{1,2}):([0-5]\d):([0-5]\d)(?![\w:])", lambda g: " ".join(f"{say(int(x), 'hu')} {name}" for x, name in zip(g, ("óra", "perc", "másodperc"), strict=True)))
        add("money", rf"{begin}({whole}) Ft(-ba|-ot|-ért|-tal|)(?!\w)", lambda g: f"{number(g[0], 'hu')} {_HU_FORINT[g[1] or '']}")
        add("fraction", begin + r"(\d+)/(2|3|4|[5-9]|10)(?![\w/])", lambda g: f"{say(int(g[0]), 'hu')} {({2: 'fél', 3: 'harmad', 4: 'negyed', 5: 'ötöd', 6: 'hatod', 7: 'heted', 8: 'nyolcad', 9: 'kilenced', 10: 'tized'}[int(g[1])])}")
        add("ordinal", begin + r"(\d{1,3})\.(?= [a-zäáéíóöőúüű])", lambda g: _hu_ordinal(int(g[0])))
        add("version", r"(?<![\w.])(\d+(?:\.\d+){2,})(?![\w.]?\d)", lambda g: " pont ".join(say(int(p), "hu") for p in g[0].split(".")))
    if lang == "hy":
        add("kept", begin + r"(\d+(?:[.:\-]\d+)+(?:-[^\W\d_]+)?|\d+-ին|-?\d+,\d+(?: ?%)?|(?<=\[)\d+(?=\]))(?!\w)", lambda g: g[0])
        add("ordinal", begin + r"(\d{1,6})-?րդ(?!\w)", lambda g: _HY_ORDINALS.get(int(g[0])) or say(int(g[0]), "hy") + "երորդ")
        add("fraction", begin + r"(\d+)/([2-9]|10)(?![\w/])", lambda g: f"{say(int(g[0]), 'hy')} {_HY_ORDINALS.get(int(g[1])) or say(int(g[1]), 'hy') + 'երորդ'}")
    if lang == "hi":
        add("time", begin + r"([01]?\d|2[0-3]):([0-5]\d)(?![\w:])", lambda g: _hi_clock(g[0], g[1]))
        add("version", r"(?<![\w.])(\d+(?:\.\d+){3})(?![\w.]?\d)", lambda g: " डॉट ".join(spell(p, "hi") for p in g[0].split(".")))
        add("telephone", begin + r"([6-9]\d{9})(?!\w)", lambda g: spell("0" + g[0], "hi"))
        add("year", begin + r"(1[1-9]\d\d)(?= से| तक| में| का| की| ई)", lambda g: f"{say(int(g[0][:2]), 'hi')} सौ" + (f" {say(int(g[0][2:]), 'hi')}" if int(g[0][2:]) else ""))
        add("serial", r"(?<![\w.])([A-Z]{1,4}\d{2,6})(?!\w)", lambda g: _hi_letters(g[0]))
    if lang == "ru":
        add("time", begin + r"([01]?\d|2[0-3]):([0-5]\d)(?![\w:])", lambda g: _ru_clock(g[0], g[1]))
        add("measure", rf"{begin}({whole}(?:,\d+)?) ?({'|'.join(sorted(_RU_UNITS, key=len, reverse=True))})(?![\w/])", lambda g: _ru_measure(g[0], g[1]))
        add("version", r"(?<![\w.])(\d+(?:\.\d+){2,}|\d+:\d+:\d+)(?![\w.]?\d)", lambda g: g[0])
        add("ordinal", begin + r"(\d{1,6})-?(го|му|й|я|е|м|х|ю)(?!\w)", lambda g: _ru_ordinal(int(g[0]), g[1]))
    if lang == "hi":
        add("ordinal", begin + r"(\d+) ?व?([ा-ौ]ं?|ां|ीं|ें)(?!\w)", lambda g: _hi_ordinal(int(g[0]), g[1]))
    if lang == "vi":
        add("roman", r"(?i:(?<=chương )|(?<=phần )|(?<=mục )|(?<=khoản )|(?<=khóa )|(?<=đoạn )|(?<=thế kỉ )|(?<=thế kỷ )|(?<=điều )|(?<=thứ ))((?i:(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})))(?!\w)", lambda g: _roman(g[0], "vi"))
    if lang == "ja":
        add("range", r"(?<=[\d日月年紀時分])(〜)(?=\d)", lambda g: "から")
        add("weekday", r"\(([月火水木金土日])(?:〜([月火水木金土日]))?\)", lambda g: f"{g[0]}曜日" + (f"から{g[1]}曜日" if g[1] else ""))
    if lang == "de":
        add("ordinal", r"^(\d+)\.(?=$| [A-ZÄÖÜ])", lambda g: ordinal(int(g[0]), "de"))
    if lang == "fr":
        add("ordinal", begin + r"(\d+)(?:(er|e|ème|°)|(ère|re))" + end, lambda g: "première" if g[0] == "1" and g[2] else ordinal(int(g[0]), "fr"))
    if lang in ("es", "pt"):
        add("ordinal", begin + r"(\d{1,2})\.?(?:(º|°)|(ª)|(ᵉʳ))", lambda g: _gendered(ordinal(int(g[0]), lang), bool(g[2]), bool(g[3])))
    if lang == "sv":
        add("ordinal", begin + r"(\d{1,2}):[ae]" + end, lambda g: ordinal(int(g[0]), "sv"))
    if lang == "de":
        add("ordinal", begin + r"(\d+)\.(?= [A-ZÄÖÜ])", lambda g: ordinal(int(g[0]), "de").removesuffix("r"))
    if lang == "vi":
        add("ordinal", r"(?<=thứ )(\d+)" + end, lambda g: ordinal(int(g[0]), "vi"))
    if lang == "fr":
        add("telephone", begin + r"(\d\d(?: \d\d){3,4})" + end, lambda g: " ".join(number(p, "fr") for p in g[0].split()))
    if lang == "pt":
        add("telephone", r"\((\d{2})\) ?(\d{4,5})-(\d{4})" + end, lambda g: spell("".join(g[:3]), "pt"))
    if lang == "de":
        add("telephone", begin + r"(0\d{2,4}) (\d{5,9})" + end, lambda g: spell(g[0] + g[1], "de"))
        add("digits", begin + r"(\d{1,3}\.\d{3})(?![\d.])" + end, lambda g: " punkt ".join(number(g[0].split(".")[0], "de") if k == 0 else spell(p, "de") for k, p in enumerate(g[0].split("."))))
    if lang == "es":
        add("un", begin + r"(1) (millón|billón)", lambda g: f"un {g[1]}")
    if lang in ("fr", "pt"):
        add("un", begin + r"(1) (million|milliard|billion|milhão|bilhão)", lambda g: f"un {g[1]}" if lang == "fr" else f"um {g[1]}")
    if lang == "sv":
        add("un", begin + r"(1) (miljon|miljard)", lambda g: f"en {g[1]}")
    add("number", rf"{begin}({num})" + (end if word else r"(?!\d)"), lambda g: number(g[0], lang))
    return re.compile("|".join(f"(?P<r{k}>{p})" for k, (_, p, _) in enumerate(rules))), rules


def _gendered(word: str | None, feminine: bool, short: bool) -> str | None:
    if word and feminine:
        return " ".join(w[:-1] + "a" for w in word.split())
    return word[:-1] if word and short else word


_NATIVE = {ord(c): str(k) for k, c in enumerate("०१२३४५६७८९")}


def normalize_one(text: str | None, lang: str) -> str | None:
    """Spoken form of one text; null, empty and blank texts stay."""
    if lang == "en" or not text or not text.strip():
        return english.normalize_one(text)
    text = text.replace("\x00", "") or text
    if lang == "hi":
        text = text.translate(_NATIVE)
    pattern, rules = _rules(lang)

    def read(m: re.Match) -> str:
        k = next(i for i in range(len(rules)) if m[f"r{i}"] is not None)
        first = pattern.groupindex[f"r{k}"]
        last = pattern.groupindex.get(f"r{k + 1}", pattern.groups + 1)
        said = rules[k][2](list(m.groups()[first : last - 1]))
        return m[0] if said is None else said

    return pattern.sub(read, text).strip()


_remembered = functools.lru_cache(english.MEMO)(normalize_one)


def normalize_again(text: str | None, lang: str) -> str | None:
    """``normalize_one`` with the answers to short texts seen lately looked up. It changes no result."""
    return _remembered(text, lang) if text and len(text) <= english.MEMO_CHARS else normalize_one(text, lang)


#: A text that this does not match has no span in these languages.
TRIGGER = r"[\p{Nd}@]|://|www\.|(?:Dra?|Sra?)\. |(?i:chương|phần|mục|khoản|khóa|đoạn|thế kỉ|thế kỷ|điều|thứ) [ivxlIVXL]|\([月火水木金土日]"


def normalize(df: DataFrame, lang: str | Column = "lang", column: str = "text", out: str = "spoken") -> DataFrame:
    """``df`` with the spoken form of ``column`` in the language that ``lang`` names (a column).

    Null where the language is none of the seventeen. Only texts with a trigger reach Python.
    """
    ship(df.sparkSession)
    code = lang if isinstance(lang, Column) else F.col(lang)

    @F.pandas_udf("string")
    def spoken(texts: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or c is None else normalize_again(t, c) for t, c in zip(texts, codes, strict=True)], dtype=object)

    text = F.col(column)
    triggered = text.rlike(TRIGGER) | ((code == "en") & text.rlike(english.TRIGGER))
    known = code.isin("en", *VOICES)
    said = spoken(F.when(triggered & known, text), F.when(triggered & known, code))
    return df.withColumn(out, F.when(known, F.coalesce(said, english._plain(text))))
