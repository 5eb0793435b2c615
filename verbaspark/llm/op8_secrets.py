"""Secret scan: fixed patterns, and a conditional random field that adds what they miss.

What the field tags loses the marks at its ends and whatever a fixed span covers; a rest without a letter or digit is
dropped. So no span of the field overlaps a fixed one, and none repeats what that has found.

Rows: null text counts as empty and has no spans; very long texts and words are read whole; fixed spans of different kinds may
overlap, and come by start, then kind; rows that repeat get equal answers; a null doc_id stays null; an empty table gives an empty
result; ``scan`` ignores other columns and ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm import crf
from verbaspark.llm.tables import chunks, documents, map_arrow

KINDS = ("assign", "access", "hex", "crf")


def _either(word: str) -> str:
    """The letters a-z of a pattern in either case, and no others."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns.
_ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_VALUE = re.compile(r"[:=][\"'`]*([^\"'`\s]{6,})")
#: Marks within a word after which a new name, or a quoted value, begins.
_SPLIT = re.compile(r"""[,;&?{\[|\0](?=\\?["'`]|[A-Za-z_][\w.\-]*\\?["'`]?[:=])""")
#: The password in an address such as scheme://user:password@host.
_USERINFO = re.compile(r"://[^\s/:@]*:([^\s/@][^\s@]*)@")
#: Two or more of one mark, as junk around a word.
_JUNK = r"([^\w\s=])\1+"
_JUNK_BEFORE, _JUNK_AFTER = re.compile(_JUNK), re.compile(f"{_JUNK}$")
#: Words whose scores a worker remembers; beyond, it starts anew.
REMEMBERED = 200_000


def base_spans(text: str, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of the fixed patterns' matches; ``longest``: of the words without white space."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if longest >= 32:
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def pieces(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """Start and end of each word, where those with ``cuts`` inside fall into pieces."""
    out, k = [], 0
    for m in re.finditer(r"\S+", text):
        start, end = m.span()
        while k < len(cuts) and cuts[k] < end:
            if cuts[k] > start:
                out.append((start, cuts[k]))
                start = cuts[k]
            k += 1
        out.append((start, end))
    return out


class Tagger:
    """Scores for whole texts from what is remembered of each word: its own score and its kind as a neighbour."""

    def __init__(self, model: crf.CRF):
        self.model = model
        w = model.weights
        own = crf._OWN
        self.before, self.before2, self.after = (w[own + k * crf.CONTEXTS : own + (k + 1) * crf.CONTEXTS] for k in range(3))
        self.file = w[own + 3 * crf.CONTEXTS :]
        self.own_score = functools.cache(lambda f: w[list(f)].sum(0))
        self._forget()

    def _forget(self) -> None:
        self.score = np.zeros((1024, 3))
        self.kind = np.zeros(1024, np.int64)
        tagger = self

        class Places(dict):
            def __missing__(self, word: str) -> int:
                at = self[word] = len(self)
                if at >= len(tagger.score):
                    tagger.score = np.vstack([tagger.score, np.zeros_like(tagger.score)])
                    tagger.kind = np.append(tagger.kind, np.zeros_like(tagger.kind))
                tagger.score[at] = tagger.own_score(crf.own_features(word))
                tagger.kind[at] = crf.context(word)
                return at

        self.place = Places()
        self.own_score.cache_clear()

    def scores(self, words: list[str], file: int) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        kind = np.concatenate([[crf.NO_WORD] * 2, self.kind[at], [crf.NO_WORD]])
        n = len(words)
        return self.score[at] + self.before[kind[1 : n + 1]] + self.before2[kind[:n]] + self.after[kind[3 : n + 3]] + self.file[file]

    def spans(self, text: str, words: list[str]) -> list[tuple[int, int]]:
        """Start and end of what the field tags, without the marks around it or the name before it. Words that hold
        several names and values are tagged piece by piece."""
        where = None
        cuts = [m.end() for m in _SPLIT.finditer(text)]
        if "://" in text and "@" in text:
            cuts = sorted({*cuts, *(x for m in _USERINFO.finditer(text) for x in m.span(1))})
        if cuts:
            where = pieces(text, cuts)
            words = [text[a:b] for a, b in where]
        found = self.model.spans(self.scores(words, crf.file_kind(text))) if words else []
        if not found:
            return []
        where = where or [m.span() for m in re.finditer(r"\S+", text)]
        out = []
        for a, b in found:
            start, end = where[a][0], where[b][1]
            if a == b and "://" not in text[start:end] and (m := _VALUE.search(text, start, end)):
                start, end = m.span(1)
            out.append((start, end))
        return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A span without the marks at its ends; none where no letter or digit is left."""
    core = text[start:end]
    while True:
        left = core.lstrip(crf.EDGES)
        left = left[m.end() :] if (m := _JUNK_BEFORE.match(left)) else left
        kept = left.rstrip(crf.EDGES)
        kept = kept[: m.start()] if (m := _JUNK_AFTER.search(kept)) else kept
        start += len(core) - len(left)
        if len(kept) == len(core):
            return (start, start + len(kept)) if any(map(str.isalnum, kept)) else None
        core = kept


def all_spans(text: str, tagger: Tagger) -> list[tuple[int, int, int]]:
    """Fixed spans, and what the field tags beside them; by start, then kind."""
    words = text.split()
    base = base_spans(text, max(map(len, words), default=0))
    more = []
    for a, b in tagger.spans(text, words):
        at = a
        for x, y, _ in [s for s in base if s[0] < b and s[1] > a] + [(b, b, 0)]:
            if x > at and (rest := trimmed(text, at, x)):
                more.append((*rest, 3))
            at = max(at, y)
    return sorted(base + more, key=lambda s: (s[0], s[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans."""
    model = crf.trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in chunks(batches):
            found = [all_spans(t or "", tagger) for t in batch.column(1).to_pylist()]
            base = [[s for s in x if s[2] < 3] for x in found]
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array(map(_joined, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; its other columns stay, null texts too."""
    model = crf.trained()
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None, tagger: Tagger) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, b, _ in all_spans(text, tagger):
            if b > done:
                if a >= done:
                    out += [text[done:a], mark]
                done = b
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in chunks(batches):
            texts = pa.array([clean(t, tagger) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names)

    return map_arrow(docs, run, docs.schema)


def op8_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
