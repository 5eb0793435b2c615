"""The front door: one text, a list, a column, or SQL."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.functions import text as steps
from verbaspark.operators import multilingual, spacing, tokens
from verbaspark.runtime import ship

_BOTH_CASES = {"ko", "hy"}


def language_of(locale: str | None) -> str:
    """Two letters of a locale tag; none and empty mean en-US. An unknown language is a ``ValueError``."""
    code = (locale or "en-US").replace("_", "-").partition("-")[0].lower()
    if code not in steps.LANGUAGES:
        raise ValueError(f"unsupported language: {locale!r}")
    return code


@dataclass(frozen=True)
class Normalizer:
    """Options of a language, checked once. ``post_process`` and the limit are kept for callers that store them."""

    lang: str = "en"
    input_case: str = "cased"
    post_process: bool = True
    max_number_of_permutations_per_split: int = 729

    def __post_init__(self) -> None:
        object.__setattr__(self, "lang", language_of(self.lang))
        if self.max_number_of_permutations_per_split < 1:
            raise ValueError("max_number_of_permutations_per_split must be positive")
        if self.input_case not in ("cased", *(["lower_cased"] if self.lang in _BOTH_CASES else [])):
            raise ValueError(f"input_case {self.input_case!r} is not offered for {self.lang}")

    def normalize(self, text: str, punct_pre_process: bool = False, punct_post_process: bool = False) -> str:
        if not isinstance(text, str):
            raise TypeError("text must be a string")
        source = text.replace("[", " [ ").replace("]", " ] ") if punct_pre_process else text
        if not source.strip():
            return ""
        said = multilingual.normalize_one(source, self.lang)
        return spacing.align_one(text, said) if punct_post_process else said

    def normalize_list(self, texts: Iterable[str], **options: bool) -> list[str]:
        return [self.normalize(t, **options) for t in texts]

    def transform(self, df: DataFrame, column: str = "text", out: str = "spoken") -> DataFrame:
        """The column in spoken form; null stays null and blank texts stay."""
        return multilingual.normalize(df, F.lit(self.lang), column, out)


def warm(locale: str | None = "en-US") -> None:
    """Make a language's rules now, in this process, and check the locale. Workers make theirs once and keep them."""
    code = language_of(locale)
    multilingual.normalize_one("1", code)


def normalize_text(text: object, locale: str | None = "en-US", return_spans: bool = False) -> object:
    """One value in spoken form; false and blank values come back as they are."""
    if return_spans:
        raise NotImplementedError("spans are not offered")
    code = language_of(locale)
    if not text or not str(text).strip():
        return text
    return multilingual.normalize_one(str(text), code)


def try_normalize(text: Column, locale: Column) -> Column:
    """Struct of ``output`` and ``error`` for each row, of which one is null (both for a null text). One bad row ends nothing."""

    @F.pandas_udf("struct<output:string,error:string>")
    def run(texts: pd.Series, locales: pd.Series) -> pd.DataFrame:
        rows = []
        for t, place in zip(texts, locales, strict=True):
            try:
                rows.append((None if t is None else normalize_text(t, place), None))
            except ValueError as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["output", "error"], dtype=object)

    return run(text, locale)


def register(spark: SparkSession) -> None:
    """SQL functions ``normalize_text(text, locale)``, ``detokenize(text, lang)`` and ``match_spaces(written, spoken)``, and the
    table function ``token_rows(tagged)``.

    An unknown locale fails the query."""
    ship(spark)

    @F.pandas_udf("string")
    def spoken(texts: pd.Series, locales: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else normalize_text(t, place) for t, place in zip(texts, locales, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def join(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([spacing.detokenize_one(t, code) for t, code in zip(texts, langs, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def match(written: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([spacing.align_one(a, b) for a, b in zip(written, said, strict=True)], dtype=object)

    spark.udtf.register("token_rows", tokens.token_rows)
    for name, f in (("normalize_text", spoken), ("detokenize", join), ("match_spaces", match)):
        spark.udf.register(name, f)
