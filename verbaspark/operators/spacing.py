"""Spaces around marks: joining separate tokens as print does, and giving a spoken text the spaces of the written one.

Joining asks of each gap between two tokens whether the left one holds on to the right (opening brackets, currency signs, elided
words, opening quotes) or the right one to the left (closing marks, clitics, closing quotes, one wide character after another).
Quotes are paired beforehand, in a pass of their own. A text without quotes is joined by Column expressions alone.
"""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbaspark.functions.text import WHITE

#: Marks that hold on to what follows or to what stands before, quotes, and marks that French sets apart.
OPENING, CLOSING, QUOTES, FRENCH = "([{¿¡", r",.?!:;\%}])", "'\"„“`", r"?!:;\%"
#: Code points, first and last, of scripts written without spaces.
WIDE_RANGES = [
    (4352, 4607), (11904, 42191), (43072, 43135), (44032, 55215), (63744, 64255), (65072, 65103), (65381, 65500),
    (94208, 101119), (110592, 110895), (110960, 111359), (131072, 196607),
]
_WIDE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE_RANGES)  # for Java
_CLITIC, _ELIDED = re.compile(r"'[^\W\d_]"), re.compile(r".*[^\W\d_]'", re.S)


def is_wide(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in WIDE_RANGES)


def is_currency(c: str) -> bool:
    return unicodedata.category(c) == "Sc"


def _made_of(token: str, marks: str) -> bool:
    return not token.strip(marks)


def quote_ends(tokens: list[str], lang: str) -> dict[int, bool]:
    """Place of each quote that is a token of its own: does it close. Each kind of quote opens and closes by turns; the low and curly
    ones are one kind. In English a single quote after an s closes, and leaves the turn as it is."""
    opened: set[str] = set()
    out = {}
    for k, token in enumerate(tokens):
        if not _made_of(token, QUOTES):
            continue
        kind = '"' if _made_of(token, "„“") else token
        if kind in opened:
            opened.discard(kind)
            out[k] = True
        elif lang == "en" and token == "'" and k and tokens[k - 1].endswith("s"):
            out[k] = True
        else:
            opened.add(kind)
            out[k] = False
    return out


def _holds(tokens: list[str], lang: str) -> tuple[list[bool], list[bool]]:
    """For each token: does it hold on to the next one, and to the one before."""
    quotes = quote_ends(tokens, lang)
    to_next, to_last = [], []
    for k, token in enumerate(tokens):
        last = tokens[k - 1] if k else ""
        if lang != "ko" and is_wide(token[0]):
            to_next.append(False)
            to_last.append(bool(last) and is_wide(last[-1]))
            continue
        opening = all(c in OPENING or is_currency(c) for c in token)
        closing = not opening and _made_of(token, CLOSING)
        clitic = lang == "en" and bool(last) and bool(_CLITIC.match(token))
        elided = lang in ("fr", "it") and bool(_ELIDED.fullmatch(token)) and tokens[k + 1 : k + 2] != [] and tokens[k + 1][0].isalpha()
        to_next.append(opening or elided and not closing or quotes.get(k) is False)
        to_last.append(closing or clitic or quotes.get(k) is True)
    return to_next, to_last


def detokenize_one(text: str | None, lang: str) -> str | None:
    """Tokens parted by white space to print spacing."""
    if text is None:
        return None
    tokens = f" {text} ".replace(" @-@ ", "-").split()
    to_next, to_last = _holds(tokens, lang)
    apart = [lang == "fr" and len(t) == 1 and t in FRENCH for t in tokens]
    gaps = [" " if a or not (n or l) else "" for a, n, l in zip(apart[1:], to_next, to_last[1:], strict=False)]
    return "".join(t + g for t, g in zip(tokens, [*gaps, ""], strict=False))


def detokenize(text: Column, lang: Column) -> Column:
    """Tokens parted by white space to print spacing; null stays null. Only texts with quotes reach Python."""

    @F.pandas_udf("string")
    def join(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([detokenize_one(t, code) for t, code in zip(texts, langs, strict=True)], dtype=object)

    quoted = text.rlike(f"[{QUOTES}]")
    return F.coalesce(join(F.when(quoted, text), F.when(quoted, lang)), F.when(text.isNotNull(), _unquoted(text, F.coalesce(lang, F.lit("")))))


def _unquoted(text: Column, lang: Column) -> Column:
    """Without quotes each gap is settled by the characters at its two sides."""
    spaced = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(" @-@ "), F.lit("-")), f"[{WHITE}]+", " "))
    closing = r",.?!:;\\%}\])"
    opening = rf"(?<![^ ])([(\[{{¿¡\p{{Sc}}]+) "
    french = F.regexp_replace(F.regexp_replace(spaced, opening + r"(?=\S)(?![?!:;\\%](?: |$))", "$1"), rf"(?<=\S) (?![?!:;\\%](?: |$))([{closing}]+)(?![^ ])", "$1")
    others = F.regexp_replace(F.regexp_replace(spaced, opening + r"(?=\S)", "$1"), rf"(?<=\S) ([{closing}]+)(?![^ ])", "$1")
    joined = F.when(lang == "fr", french).otherwise(others)
    return F.when(lang == "ko", joined).otherwise(F.regexp_replace(joined, rf"(?<=[{_WIDE}]) (?=[{_WIDE}])", ""))


def places(text: str) -> dict[str, list[int]]:
    """Where each ASCII mark stands, in one pass."""
    out: dict[str, list[int]] = {}
    for m in re.finditer(f"[{re.escape(string.punctuation)}]", text):
        out.setdefault(m[0], []).append(m.start())
    return out


def paired(written: str, spoken: str, here: list[int], there: list[int]) -> list[tuple[int, int]]:
    """Which occurrences of a mark in the written text belong to which in the spoken one: all in order where there are equally many;
    else each takes the next one that is left, if the two have a neighbour in common."""
    if len(here) == len(there):
        return list(zip(here, there, strict=True))
    around = lambda text, k: (text[k - 1] if k else None, text[k + 1] if k + 1 < len(text) else None)
    out, left = [], iter(there)
    o = next(left, None)
    for i in here:
        if o is not None and any(a is not None and a == b for a, b in zip(around(written, i), around(spoken, o), strict=True)):
            out.append((i, o))
            o = next(left, None)
    return out


def align_one(written: str | None, spoken: str | None) -> str | None:
    """``spoken`` with the spaces that ``written`` has around each ASCII mark, mark by mark in the order of their codes."""
    if written is None or spoken is None:
        return spoken
    if "``" in written and "``" not in spoken:
        written = written.replace("``", '"')
    theirs = places(written)
    for mark in sorted(theirs):
        there = [k for k, c in enumerate(spoken) if c == mark]
        drop, before, behind = set(), set(), set()
        for i, o in paired(written, spoken, theirs[mark], there):
            for step, wanting in ((-1, before), (1, behind)):
                if 0 <= i + step < len(written) and 0 <= o + step < len(spoken):
                    want, have = written[i + step] == " ", spoken[o + step] == " "
                    if have and not want:
                        drop.add(o + step)
                    elif want and not have:
                        wanting.add(o)
        spoken = "".join(" " * (k in before) + ("" if k in drop else c) + " " * (k in behind) for k, c in enumerate(spoken))
    return re.sub(" +", " ", spoken)


def align(written: Column, spoken: Column) -> Column:
    """See ``align_one``. Where nothing has to move, the spoken text stays and no row reaches Python."""

    @F.pandas_udf("string")
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align_one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    same = written.isNull() | spoken.isNull() | (written == spoken)
    plain = F.when(written.isNull(), spoken).otherwise(F.regexp_replace(spoken, " +", " "))
    return F.when(same, plain).otherwise(match(F.when(~same, written), F.when(~same, spoken)))
