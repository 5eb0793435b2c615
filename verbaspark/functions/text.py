"""Language-independent text steps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 17 supported languages.
LANGUAGES = ["ar", "de", "en", "es", "fr", "hi", "hu", "hy", "it", "ja", "ko", "pt", "ru", "rw", "sv", "vi", "zh"]
#: White space that strip removes, as a regular-expression class.
WHITE = r"\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def language_code(locale: Column, strict: bool = False) -> Column:
    """Two letters of a locale tag such as ``en-US`` or ``pt_BR``; empty and null mean en-US. An unknown language is
    null, or an error where ``strict``."""
    code = F.lower(F.split(F.coalesce(F.when(locale == "", None).otherwise(locale), F.lit("en-US")), "[-_]").getItem(0))
    known = F.when(code.isin(LANGUAGES), code)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unsupported language: "), code)).cast("string")) if strict else known


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def matches_ranges(char: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a text begins with a character of the code points' ranges, first and last."""
    return char.rlike("^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]")


def currency(char: Column) -> Column:
    """Whether a text begins with a currency sign."""
    return char.rlike(r"^\p{Sc}")


def letter(char: Column) -> Column:
    return char.rlike(r"^\p{L}")


def escape(text: Column) -> Column:
    """Backslash before backslash and square brackets."""
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def drop_nul(text: Column) -> Column:
    """Without U+0000; a text of nothing else stays."""
    rest = F.replace(text, F.lit("\x00"), F.lit(""))
    return F.when(rest == "", text).otherwise(rest)


def to_float32(x: Column) -> Column:
    """Rounded to 32 bits, as weights are after each sum."""
    return x.cast("float")


def valid_utf8(raw: Column) -> Column:
    """The text of UTF-8 bytes; null where they are malformed."""
    return F.try_validate_utf8(raw.cast("string"))


def pre_process(text: Column) -> Column:
    """Spaces around square brackets."""
    return F.regexp_replace(F.regexp_replace(text, r"([\[\]])", " $1 "), " +", " ")
