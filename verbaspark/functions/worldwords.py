"""Number words of the languages beyond English, Spanish, French and German.

Each language is a list of levels, greatest first: (divisor, size, words of each count at that level), and a rule for
what stands between a level and the ones above it. ``words`` reads the levels for one number, ``numbers.cardinal``
turns the same levels into a Column expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

# The words of each language, in natural order.
PT_UNITS = "zero um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezesseis dezessete dezoito dezenove".split()
PT_TENS = "_ _ vinte trinta quarenta cinquenta sessenta setenta oitenta noventa".split()
PT_HUNDREDS = "_ cento duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos".split()
IT_UNITS = "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split()
IT_TENS = "_ _ venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split()
SV_UNITS = "noll ett två tre fyra fem sex sju åtta nio tio elva tolv tretton fjorton femton sexton sjutton arton nitton".split()
SV_TENS = "_ _ tjugo trettio fyrtio femtio sextio sjuttio åttio nittio".split()
HU_UNITS = "nulla egy kettő három négy öt hat hét nyolc kilenc".split()
HU_TENS = "_ tíz húsz harminc negyven ötven hatvan hetven nyolcvan kilencven".split()
HY_UNITS = "զրո մեկ երկու երեք չորս հինգ վեց յոթ ութ ինը տասը տասնմեկ տասներկու տասներեք տասնչորս տասնհինգ տասնվեց տասնյոթ տասնութ տասնինը".split()
HY_TENS = "_ _ քսան երեսուն քառասուն հիսուն վաթսուն յոթանասուն ութսուն իննսուն".split()
VI_UNITS = "không một hai ba bốn năm sáu bảy tám chín".split()
RU_UNITS = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "_ _ двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "_ сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
AR_UNITS = "صفر|واحد|اثنان|ثلاثة|أربعة|خمسة|ستة|سبعة|ثمانية|تسعة|عشرة|أحد عشر|اثنا عشر|ثلاثة عشر|أربعة عشر|خمسة عشر|ستة عشر|سبعة عشر|ثمانية عشر|تسعة عشر".split("|")
AR_TENS = "_ _ عشرون ثلاثون أربعون خمسون ستون سبعون ثمانون تسعون".split()
AR_HUNDREDS = "_|مئة|مئتان|ثلاث مئة|أربع مئة|خمس مئة|ست مئة|سبع مئة|ثمان مئة|تسع مئة".split("|")
RW_UNITS = "zeru rimwe kabiri gatatu kane gatanu gatandatu karindwi umunani icyenda".split()
RW_TENS = "_|icumi|makumyabiri|mirongo itatu|mirongo ine|mirongo itanu|mirongo itandatu|mirongo irindwi|mirongo inani|mirongo icyenda".split("|")
RW_HUNDREDS = "_|ijana|magana abiri|magana atatu|magana ane|magana atanu|magana atandatu|magana arindwi|magana inani|magana icyenda".split("|")
RW_THOUSANDS = "_ kimwe bibiri bitatu bine bitanu bitandatu birindwi umunani icyenda".split()
RW_MILLIONS = "_ imwe ebyiri eshatu enye eshanu esheshatu zirindwi umunani icyenda".split()
HI_WORDS = """शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस बीस इक्कीस बाईस तेईस चौबीस
पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस चालीस इकतालीस बयालीस तैंतालीस चौवालीस
पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरेपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ साठ इकसठ बासठ तिरेसठ चौंसठ पैंसठ छियासठ
सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी
अट्ठासी नवासी नब्बे इक्यानबे बानबे तिरानबे चौरानबे पंचानबे छियानबे सत्तानबे अट्ठानबे निन्यानबे""".split()
ZH_DIGITS, JA_DIGITS, KO_DIGITS = "零一二三四五六七八九", "零一二三四五六七八九", "영일이삼사오육칠팔구"


def _pt(n: int) -> str:
    if n < 20:
        return PT_UNITS[n]
    if n < 100:
        return PT_TENS[n // 10] + (f" e {PT_UNITS[n % 10]}" if n % 10 else "")
    return "cem" if n == 100 else PT_HUNDREDS[n // 100] + (f" e {_pt(n % 100)}" if n % 100 else "")


def _it(n: int) -> str:
    if n < 20:
        return IT_UNITS[n]
    if n < 100:
        one, ten = n % 10, IT_TENS[n // 10]
        return (ten[:-1] if one in (1, 8) else ten) + (IT_UNITS[one] if one else "")
    head = "cento" if n < 200 else IT_UNITS[n // 100] + "cento"
    return head + (f" {_it(n % 100)}" if n % 100 else "")


def _sv(n: int) -> str:
    if n < 20:
        return SV_UNITS[n]
    if n < 100:
        return SV_TENS[n // 10] + (SV_UNITS[n % 10] if n % 10 else "")
    return ("" if n < 200 else SV_UNITS[n // 100]) + "hundra" + (_sv(n % 100) if n % 100 else "")


def _hu(n: int) -> str:
    if n < 10:
        return HU_UNITS[n]
    if n < 100:
        ten = {1: "tizen", 2: "huszon"}.get(n // 10, HU_TENS[n // 10]) if n % 10 else HU_TENS[n // 10]
        return ten + (HU_UNITS[n % 10] if n % 10 else "")
    return ("" if n < 200 else "két" if n < 300 else HU_UNITS[n // 100]) + "száz" + (_hu(n % 100) if n % 100 else "")


def _hy(n: int) -> str:
    if n < 20:
        return HY_UNITS[n]
    if n < 100:
        return HY_TENS[n // 10] + (HY_UNITS[n % 10] if n % 10 else "")
    return ("" if n < 200 else f"{HY_UNITS[n // 100]} ") + "հարյուր" + (f" {_hy(n % 100)}" if n % 100 else "")


def _vi(n: int) -> str:
    if n < 10:
        return VI_UNITS[n]
    if n < 100:
        ten, one = divmod(n, 10)
        last = "" if not one else " lăm" if one == 5 else " mốt" if one == 1 and ten > 1 else " tư" if one == 4 and ten > 1 else f" {VI_UNITS[one]}"
        return ("mười" if ten == 1 else f"{VI_UNITS[ten]} mươi") + last
    rest = n % 100
    return f"{VI_UNITS[n // 100]} trăm" + (f" linh {VI_UNITS[rest]}" if 0 < rest < 10 else f" {_vi(rest)}" if rest else "")


def _ru(n: int, feminine: bool = False) -> str:
    if n < 20:
        return {1: "одна", 2: "две"}.get(n, RU_UNITS[n]) if feminine else RU_UNITS[n]
    if n < 100:
        return RU_TENS[n // 10] + (f" {_ru(n % 10, feminine)}" if n % 10 else "")
    return RU_HUNDREDS[n // 100] + (f" {_ru(n % 100, feminine)}" if n % 100 else "")


def _ar(n: int) -> str:
    if n < 20:
        return AR_UNITS[n]
    if n < 100:
        return (f"{AR_UNITS[n % 10]} و" if n % 10 else "") + AR_TENS[n // 10]
    return AR_HUNDREDS[n // 100] + (f" و{_ar(n % 100)}" if n % 100 else "")


def _na(word: str) -> str:
    """And, before a word: shortened before a vowel."""
    return f" n'{word}" if word[0] in "ieu" else f" na {word}"


def _rw(n: int, units: list[str], alone: str = "icumi") -> str:
    if n < 10:
        return units[n]
    if n < 100:
        ten = alone if n == 10 else "cumi" if n < 20 else RW_TENS[n // 10]
        return ten + (_na(units[n % 10]) if n % 10 else "")
    head = "magana cyenda" if n // 100 == 9 and n % 100 else RW_HUNDREDS[n // 100]
    return head + (f" na {_rw(n % 100, units, 'cumi')}" if 10 < n % 100 < 20 else _na(_rw(n % 100, units)) if n % 100 else "")


def _hi(n: int) -> str:
    return HI_WORDS[n] if n < 100 else f"{HI_WORDS[n // 100]} सौ" + (f" {HI_WORDS[n % 100]}" if n % 100 else "")


def _zh(n: int, head: bool = True) -> str:
    """0..9999; ``head``: nothing stands before."""
    if n < 10:
        return ZH_DIGITS[n]
    if n < 20:
        return ("" if head else "一") + "十" + (ZH_DIGITS[n % 10] if n % 10 else "")
    size, sign = next(x for x in ((1000, "千"), (100, "百"), (10, "十")) if n >= x[0])
    rest = n % size
    return ZH_DIGITS[n // size] + sign + (("零" if rest * 10 < size else "") + _zh(rest, False) if rest else "")


def _tens(n: int, digits: str, signs: str) -> str:
    """0..9999 with a one left out before ten, hundred and thousand."""
    out = ""
    for k in (3, 2, 1, 0):
        d = n // 10**k % 10
        if d:
            out += ("" if k and d == 1 else digits[d]) + signs[3 - k]
    return out.strip()


def _ja(n: int) -> str:
    return "一" * (n >= 1000 and n // 1000 == 1) + _tens(n, JA_DIGITS, "千百十 ")


def _ko(n: int) -> str:
    return _tens(n, KO_DIGITS, "천백십 ")


@dataclass(frozen=True)
class Tongue:
    """How a language counts: see the module."""

    zero: str
    minus: str
    point: str
    levels: tuple[tuple[int, int, Callable[[int], str]], ...]
    #: Between the words so far and a level: (divisor, count there, is anything below it, is the level above empty).
    joint: Callable[[int, int, bool, bool], str] = field(default=lambda div, g, below, gap: " ")
    #: Digits after the decimal sign: one by one, or as a number.
    digits: bool = True
    native: str = ""


def _by(one: str, many: str, small: Callable[[int], str]) -> Callable[[int], str]:
    return lambda g: one if g == 1 else f"{small(g)}{many}"


def _slavic(g: int, one: str, few: str, many: str) -> str:
    return many if g % 100 in (11, 12, 13, 14) or g % 10 in (0, 5, 6, 7, 8, 9) else one if g % 10 == 1 else few


def _ru_thousands(g: int) -> str:
    return f"{_ru(g, True)} {_slavic(g, 'тысяча', 'тысячи', 'тысяч')}"


def _ru_scale(name: str) -> Callable[[int], str]:
    return lambda g: f"{_ru(g)} {_slavic(g, name, name + 'а', name + 'ов')}"


def _ar_scale(one: str, two: str, few: str) -> Callable[[int], str]:
    return lambda g: one if g == 1 else two if g == 2 else f"{_ar(g)} {few if 3 <= g <= 10 else one}"


def _rw_thousands(g: int) -> str:
    return "igihumbi" if g == 1 else f"ibihumbi {_rw(g, RW_THOUSANDS)}"


def _rw_scale(name: str) -> Callable[[int], str]:
    return lambda g: f"{name} {_rw(g, RW_MILLIONS)}"


def _east(small: Callable[[int], str], signs: str, bare: str = "") -> tuple:
    """Levels of ten thousand; ``bare``: the sign that a count of one leaves alone."""
    return tuple((10_000**k, 10_000, (lambda g, s=s: s if g == 1 and s == bare else small(g) + s)) for k, s in zip((4, 3, 2, 1), signs, strict=True))


T, M, G, B = 10**3, 10**6, 10**9, 10**12
TONGUES = {
    "pt": Tongue("zero", "menos", "vírgula", ((B, T, _by("um trilhão", " trilhões", _pt)), (G, T, _by("um bilhão", " bilhões", _pt)), (M, T, _by("um milhão", " milhões", _pt)), (T, T, _by("mil", " mil", _pt)), (1, T, _pt)), lambda div, g, below, gap: " e " if not below and (g < 100 or g % 100 == 0) else " "),
    "it": Tongue("zero", "meno", "virgola", ((B, T, _by("un bilione", " bilioni", _it)), (M, M, lambda g: "un milione" if g == 1 else f"{_it_thousands(g)} milioni"), (T, T, _by("mille", "mila", _it)), (1, T, _it)), digits=False),
    "sv": Tongue("noll", "minus", "komma", ((B, T, _by("biljon", " biljoner", _sv)), (G, T, _by("miljard", " miljarder", _sv)), (M, T, _by("miljon", " miljoner", _sv)), (T, T, _by("tusen", "tusen", _sv)), (1, T, _sv)), digits=False),
    "hu": Tongue("nulla", "mínusz", "egész", ((10**21, T, _by("trilliárd", "trilliárd", _hu)), (10**18, T, _by("trillió", "trillió", _hu)), (10**15, T, _by("billiárd", "billiárd", _hu)), (B, T, _by("billió", "billió", _hu)), (G, T, _by("milliárd", "milliárd", _hu)), (M, T, _by("millió", "millió", _hu)), (T, T, _by("ezer", "ezer", _hu)), (1, T, _hu)), lambda div, g, below, gap: "-"),
    "hy": Tongue("զրո", "մինուս", "ամբողջ", tuple((d, T, (lambda g, s=s: f"{_hy(g)} {s}")) for d, s in ((B, "տրիլիոն"), (G, "միլիարդ"), (M, "միլիոն"))) + ((T, T, _by("հազար", " հազար", _hy)), (1, T, _hy)), digits=False),
    "vi": Tongue("không", "âm", "phẩy", ((G, 10**10, lambda g: f"{words(g, 'vi')} tỷ"),) + tuple((d, T, (lambda g, s=s: f"{_vi(g)} {s}")) for d, s in ((M, "triệu"), (T, "nghìn"))) + ((1, T, _vi),), lambda div, g, below, gap: " linh " if div == 1 and g < 10 else " "),
    "ru": Tongue("ноль", "минус", "целых", ((B, T, _ru_scale("триллион")), (G, T, _ru_scale("миллиард")), (M, T, _ru_scale("миллион")), (T, T, _ru_thousands), (1, T, _ru)), digits=False),
    "ar": Tongue("صفر", "سالب", "فاصلة", ((B, T, _ar_scale("تريليون", "تريليونان", "تريليونات")), (G, T, _ar_scale("مليار", "ملياران", "مليارات")), (M, T, _ar_scale("مليون", "مليونان", "ملايين")), (T, T, _ar_scale("ألف", "ألفان", "اَلاف")), (1, T, _ar)), lambda div, g, below, gap: " و", digits=False),
    "rw": Tongue("zeru", "minus", "", ((G, T, _rw_scale("tiriyoni")), (M, T, _rw_scale("miliyoni")), (T, T, _rw_thousands), (1, T, lambda g: _rw(g, RW_UNITS))), lambda div, g, below, gap: " n'" if div == T or div == 1 and (g == 10 or g == 9 or g // 100 == 1) else " na "),
    "hi": Tongue("शून्य", "ऋणात्मक", "दशमलव", ((10**11, 100, lambda g: f"{_hi(g)} खरब"), (G, 100, lambda g: f"{_hi(g)} अरब"), (10**7, 100, lambda g: f"{_hi(g)} करोड़"), (10**5, 100, lambda g: f"{_hi(g)} लाख"), (T, 100, lambda g: f"{_hi(g)} हज़ार"), (1, T, _hi)), native="०१२३४५६७८९"),
    "zh": Tongue("零", "负", "点", (*_east(_zh, "京兆亿万"), (1, 10_000, lambda g: _zh(g, g < 20))), lambda div, g, below, gap: ("零一" if div == 1 and 10 <= g < 20 else "零") if g < T or gap else ""),
    "ja": Tongue("零", "マイナス", "点", (*_east(_ja, "京兆億万"), (1, 10_000, lambda g: "一千" if g == T else _tens(g, JA_DIGITS, "千百十 "))), lambda div, g, below, gap: ""),
    "ko": Tongue("영", "마이너스", "점", (*_east(_ko, "경조억만", "만"), (1, 10_000, _ko)), lambda div, g, below, gap: ""),
}


def _it_thousands(n: int) -> str:
    high, low = divmod(n, T)
    return " ".join(([("mille" if high == 1 else _it(high) + "mila")] if high else []) + ([_it(low)] if low or not high else []))


def words(n: int, lang: str) -> str:
    """Words of a whole number; one beyond the greatest level is read digit by digit."""
    tongue = TONGUES[lang]
    if n < 0:
        return f"{tongue.minus} {words(-n, lang)}" if lang not in ("zh",) else tongue.minus + words(-n, lang)
    if n == 0:
        return tongue.zero
    top_div, top_size, _ = tongue.levels[0]
    if n >= top_div * top_size:
        return spell(str(n), lang)
    out, above = "", True
    for div, size, name in tongue.levels:
        g = n // div % size
        if g:
            out += (tongue.joint(div, g, n % div > 0, not above) if out else "") + name(g)
            if lang == "hu" and n <= 2000:
                out = out.replace("-", "")
        above = g > 0
    return out


@functools.cache
def digit_words(lang: str) -> list[str]:
    return list({"zh": ZH_DIGITS, "ja": JA_DIGITS, "ko": KO_DIGITS}.get(lang) or [words(d, lang) for d in range(10)])


def spell(digits: str, lang: str) -> str:
    """Digits by name; languages without spaces join them."""
    return ("" if lang in ("zh", "ja", "ko") else " ").join(digit_words(lang)[int(d)] for d in digits)
