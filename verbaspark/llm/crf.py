"""A linear-chain conditional random field that tags tokens as begin, inside or outside of a secret.

It is trained here, by maximum likelihood on lines that a seeded generator writes: prose, code, numbers, links and
mail addresses outside, keys, passwords and key blocks as secrets. A token's score is a sum over its own
shape, the kinds of its two neighbours before and one after, and features of the whole file: does it assign, hold a
key block, hold braces as code does, run over several lines.
"""

from __future__ import annotations

import base64
import functools
import math
import random
import re
from collections import Counter

import numpy as np

BEGIN, INSIDE, OUTSIDE = range(3)
#: Number of generated training lines, a documented bound.
TRAINING_LINES = 800

_KEYWORD = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|apikey|access.?key|private.?key|credential|bearer|auth", re.I)
_NAMING = re.compile(r"commit|sha|hash|uuid|digest|version|isbn|order|phone|card|id\b", re.I)
_MATTERS = re.compile(f"{_KEYWORD.pattern}|{_NAMING.pattern}", re.I)
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|sk_|xox[abp]-|eyJ|glpat-|AIza")
_SHAPES = [
    re.compile(p)
    for p in (
        r"\d+", r"[0-9a-f]+", r"[a-z]+", r"[A-Z]?[a-z]+", r"[A-Z]+", r"[A-Za-z]+", r"[A-Z0-9]+", r"[A-Za-z0-9]+",
        r"[A-Za-z0-9+/_=-]+", r"\+?[\d().\-/: ]+", r"[^\s@]+@[^\s@]+", r"\w+://\S+", r"[^A-Za-z0-9]+",
    )
]
_SLOTS = 9
_WIDTH = 16
#: Kinds of neighbours, and of files.
CONTEXTS, FILES = 12, 16
_OWN = _SLOTS * _WIDTH
N_FEATURES = _OWN + 3 * CONTEXTS + FILES
EDGES = "\"'`.,;()[]{}<>"


@functools.cache
def _letters(length: int, case: int, quoted: bool, keyword: bool) -> tuple[int, ...]:
    slots = [2 + case, min(length // 4, _WIDTH - 1), _WIDTH - 1, 0, _WIDTH - 1, 0, 4 * quoted, keyword, 2 + case if length >= 16 else _WIDTH - 1]
    return tuple(k * _WIDTH + x for k, x in enumerate(slots))


def plain_word(token: str) -> tuple[int, int, bool, bool] | None:
    """Length, case and quote of a word of letters alone (with marks around it), and whether it names a secret."""
    core = token.strip(EDGES)
    if not core.isalpha():
        return None
    case = 0 if core.islower() else 2 if core.isupper() else 1 if core[1:].islower() else 3
    return min(len(core), 64), case, token[0] in "\"'", bool(_KEYWORD.search(core))


def own_features(token: str) -> tuple[int, ...]:
    """The shape of one token: a number for each slot."""
    if (plain := plain_word(token)) is not None:
        return _letters(*plain)
    core = token.strip(EDGES)
    value = re.split(r"[=:]", core)[-1].strip(EDGES)
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0
    digits = sum(c.isdigit() for c in value)
    turns = sum(a.isdigit() != b.isdigit() or (a.isupper() and b.islower()) != (a.islower() and b.isupper()) for a, b in zip(value, value[1:], strict=False))
    shape = next((i for i, p in enumerate(_SHAPES) if p.fullmatch(value)), len(_SHAPES))
    slots = [
        shape,
        min(n // 4, _WIDTH - 1),
        min(int(entropy * 3), _WIDTH - 1),
        min(int(8 * digits / n), 8) if n else 9,
        min(turns // 2, _WIDTH - 1),
        bool(_PREFIX.match(value)) + 2 * ("-----" in token),
        ("=" in core) + 2 * (":" in core) + 4 * (token[:1] in "\"'"),
        bool(_KEYWORD.search(core)) + 2 * (core != value),
        shape if n >= 16 else _WIDTH - 1,
    ]
    return tuple(k * _WIDTH + int(x) for k, x in enumerate(slots))


def context(word: str) -> int:
    """The kind of a neighbouring word."""
    if word in ("=", ":=", ":"):
        return 1
    if "-----" in word or word in ("BEGIN", "PRIVATE", "RSA"):
        return 5
    ends = word[-1] in ":="
    if ends and "://" in word:
        return 4
    if not ends and word.isalpha() and not _MATTERS.search(word):
        return 0
    key = _KEYWORD.search(word)
    if key:
        return 4 if ends else 3
    if ends:
        return 2
    if _NAMING.search(word):
        return 10
    if any(map(str.isdigit, word)):
        return 6 if word.strip(EDGES).isdigit() else 8
    return 0 if any(map(str.isalpha, word)) else 7


NO_WORD = 11


def file_kind(text: str) -> int:
    return ("=" in text) + 2 * ("-----BEGIN" in text) + 4 * ("{" in text) + 8 * ("\n" in text)


def features(words: list[str], file: int) -> np.ndarray:
    """Row i: the features of word i."""
    own = np.array([own_features(w) for w in words])
    kind = np.array([NO_WORD, NO_WORD, *(context(w) for w in words), NO_WORD])
    n = len(words)
    around = np.stack([_OWN + kind[1 : n + 1], _OWN + CONTEXTS + kind[:n], _OWN + 2 * CONTEXTS + kind[3 : n + 3]], 1)
    return np.hstack([own, around, np.full((n, 1), _OWN + 3 * CONTEXTS + file)])


def generated(seed: int, lines: int) -> list[tuple[list[str], list[int]]]:
    """Tagged lines: words and tags."""
    r = random.Random(seed)
    syllables = "an er th on re he ti en or ed nd ha at es in ou is it al ar st se le co de la ra ro me ch ie ver sch keit ción qu è é ñ ü".split()
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def chars(of: str, n: int) -> str:
        return "".join(r.choice(of) for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        w = r.choice([w, w, w, w.capitalize(), w.upper()]) if r.random() < 0.2 else w
        return w + r.choice(["", "", "", "", ".", ",", "!!", "%%%", ";"])

    def plain() -> list[str]:
        kind = r.randint(0, 15)
        n = r.randint(1, 5)
        if kind == 0:
            blocks = [chars("0123456789", r.randint(2, 5)) for _ in range(r.randint(2, 4))]
            return (r.choice(["", "+", "(", "00"]) + r.choice([" ", "-", ".", ") ", "/"]).join(blocks)).split()
        if kind == 1:
            return [chars("0123456789", r.choice([4, 8, 12, 16, 16]))]
        if kind == 2:
            return [r.choice([".", "_", "+", ""]).join(chars("abcdefghijklmnopqrstuvwxyz", r.randint(2, 8)) for _ in range(n)) + r.choice(["", str(n)]) + f"@{chars('abcdefghijklmnopqrstuvwxyz', r.randint(3, 9))}{r.choice(['', str(n), '.mail'])}.{r.choice(['com', 'org', 'net', 'de', 'io'])}"]
        if kind == 3:
            return [".".join(str(r.randint(0, 255)) for _ in range(4))]
        if kind == 4:
            steps = "/".join(r.choice([chars("abcdefghijklmnopqrstuvwxyz-", r.randint(2, 9)), chars("0123456789", r.randint(1, 4)), "v1", "api"]) for _ in range(r.randint(0, 5)))
            return [r.choice(["https://", "http://", "ftp://", "www.", "/"]) + f"{chars('abcdefghijklmnop', r.randint(3, 9))}.{r.choice(['com', 'org', 'net', 'io'])}/{steps}{r.choice(['', '', '?q=' + chars('abc', 3), '?page=' + str(n) + '&ref=' + chars('abcdef', 4)])}"]
        if kind == 5:
            return [r.choice(["commit", "hash", "order", "version", "id"]), chars("0123456789abcdef", r.choice([7, 8, 12]))]
        if kind == 6:
            return [f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}"]
        if kind == 7:
            return [chars("%*#&$|<>!=-", r.randint(1, 12))]
        if kind == 8:
            return [r.choice(["x", "width", "n", "size", "name"]), r.choice(["=", ":"]), r.choice([str(n), word(), '"' + word() + '"'])]
        if kind == 9:
            return [r.choice(["the", "a", "this"]), r.choice(["token", "password", "secret", "key"]), r.choice(["is", "was", "of", "for"]), word()]
        if kind == 10:
            return ["".join(r.choice(syllables) for _ in range(r.randint(6, 20)))]
        if kind == 11:
            name, other = chars("abcdefghijk_", r.randint(1, 8)), "".join(r.choice(syllables) for _ in range(3))
            return r.choice([f"for {name} in {other}({n}): {name} += 1", f"{name}({other}, {n});", f"def {other}(self, {name}={n}):", f"if ({name} == '{other}') {{ return {n}; }}", f"SELECT {name} FROM {other} WHERE {name} > '{n}'", f'<div class="{name} {other}-{n}">']).split()
        if kind == 12:
            return [r.choice([chars("ABCDEFGHKL", 1) + "-" + chars("0123456789", 3), chars("0123456789abcdef", 8) + "-" + "-".join(chars("0123456789abcdef", 4) for _ in range(3)) + "-" + chars("0123456789abcdef", 12), ":".join(chars("0123456789abcdef", 2) for _ in range(6)), f"v{n}.{r.randint(0, 30)}.{r.randint(0, 9)}", "#" + chars("0123456789abcdef", 6), f"{r.randint(1, 999)}.{r.randint(10, 99)}", f"{n}px", f"{n}KB"])]
        return [word() for _ in range(n)]

    def noisy(words: list[str]) -> list[str]:
        """Marks after each word, as in junk text."""
        return [w + r.choice("!%#$*&~^?|+") * r.randint(1, 4) for w in words] if r.random() < 0.25 else words

    def value() -> str:
        kind = r.randint(0, 5)
        if kind == 0:
            return chars("0123456789abcdef", r.choice([32, 40, 64]))
        if kind == 1:
            return "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        if kind == 2:
            return base64.b64encode(bytes(r.randrange(256) for _ in range(r.randint(15, 36)))).decode()
        if kind == 3:
            return r.choice(["ghp_", "sk-", "glpat-", "xoxb-", "sk_live_", "AIza"]) + chars(alnum, r.randint(20, 40))
        if kind == 4:
            return "eyJ" + chars(alnum, 20) + "." + chars(alnum, 24) + "." + chars(alnum, 24)
        return chars(alnum + "!@#$%^&*_-", r.randint(10, 20))

    def secret() -> tuple[list[str], list[int]]:
        kind = r.randint(0, 7)
        v, q = value(), r.choice(["", '"', "'"])
        name = r.choice(["token", "password", "passwd", "secret", "api_key", "apikey", "AWS_SECRET_ACCESS_KEY", "client_secret", "access_key", "pwd", "private_key", "credential"])
        name = r.choice([name, name.upper()])
        if kind == 0:
            return [name, r.choice(["=", ":", ":="]), q + v + q], [OUTSIDE, OUTSIDE, BEGIN]
        if kind == 1:
            return [name + r.choice(["=", ":"]), q + v + q], [OUTSIDE, BEGIN]
        if kind == 2:
            return [name + r.choice(["=", ":"]) + q + v + q], [BEGIN]
        if kind == 3:
            return ["Authorization:", "Bearer", v], [OUTSIDE, OUTSIDE, BEGIN]
        if kind == 4:
            lines = [chars(alnum + "+/", r.choice([48, 64])) for _ in range(r.randint(2, 6))]
            name = r.choice([["RSA", "PRIVATE"], ["PRIVATE"], ["OPENSSH", "PRIVATE"]])
            return ["-----BEGIN", *name, "KEY-----", *lines, "-----END", *name, "KEY-----"], [OUTSIDE] * (2 + len(name)) + [BEGIN] + [INSIDE] * (len(lines) - 1) + [OUTSIDE] * (2 + len(name))
        if kind == 5:
            return [r.choice(["curl", "login", "mysql", "db:"]), r.choice(["https", "postgres", "jdbc:mysql", "amqp"]) + "://" + chars("abcdefgh", 4) + ":", v, "@" + chars("abcdefgh", 5) + ".com:80/x"], [OUTSIDE, OUTSIDE, BEGIN, OUTSIDE]
        if kind == 6:
            return ["-H", q + r.choice(["X-Auth", "X-Key", "Authorization", "Auth"]) + ":", v + q, *r.choice([[], plain()])][:3], [OUTSIDE, OUTSIDE, BEGIN]
        return [value() if r.random() < 0.5 else r.choice(["ghp_", "sk-", "AKIA"]) + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24)], [BEGIN]

    out = []
    for _ in range(lines):
        words, tags = [], []
        for _ in range(r.randint(1, 7)):
            part = secret() if r.random() < 0.18 else (p := noisy(plain()), [OUTSIDE] * len(p))
            words += part[0]
            tags += part[1]
        out.append((words, tags))
    return out


class CRF:
    """weights: for each feature and tag; turns: from tag to tag; first: of the first tag."""

    def __init__(self, weights: np.ndarray, turns: np.ndarray, first: np.ndarray):
        self.weights, self.turns, self.first = weights, turns, first
        # What two turns by another tag can gain over those by OUTSIDE, or by one turn at an end.
        pairs = turns[:, :OUTSIDE, None] + turns[None, :OUTSIDE, :] - (turns[:, OUTSIDE][:, None, None] + turns[OUTSIDE][None, None, :])
        ends = turns[:OUTSIDE] - turns[OUTSIDE]
        starts = turns[:, :OUTSIDE] - turns[:, OUTSIDE:]
        lead = first[:OUTSIDE] - first[OUTSIDE]
        self.gain = float(max(pairs.max(), starts.max(), (lead[:, None] + ends).max(), lead.max(), 0)) + 1e-6

    def spans(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """First and last token of each secret on the best path for the tokens' scores (n x 3).

        A token whose score for OUTSIDE leads by more than any turns can make up is outside on every best path;
        the path is sought only between such tokens, which gives the path that a full search gives.
        """
        open_at = np.flatnonzero(scores[:, OUTSIDE] - scores[:, :OUTSIDE].max(1) <= self.gain)
        out: list[tuple[int, int]] = []
        if not len(open_at):
            return out
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            tags = self.viterbi(scores[a:b], a > 0, b < len(scores))
            for i, tag in enumerate(tags):
                if tag == BEGIN or (tag == INSIDE and (i == 0 or tags[i - 1] == OUTSIDE)):
                    out.append((a + i, a + i))
                elif tag == INSIDE:
                    out[-1] = (out[-1][0], a + i)
        return out

    def viterbi(self, scores: np.ndarray, before: bool = False, after: bool = False) -> list[int]:
        """The best tags; ``before``/``after``: an OUTSIDE token stands there."""
        best = scores[0] + (self.turns[OUTSIDE] if before else self.first)
        back = []
        for row in scores[1:]:
            each = best[:, None] + self.turns
            back.append(each.argmax(0))
            best = each.max(0) + row
        if after:
            best = best + self.turns[:, OUTSIDE]
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(data: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> CRF:
    """Gradient ascent of the conditional likelihood, all lines in one batch."""
    longest = max(len(w) for w, _ in data)
    n = len(data)
    feats = np.zeros((n, longest, _SLOTS + 4), np.int64)
    tags = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (words, t) in enumerate(data):
        feats[i, : len(words)] = features(words, file_kind((" " if i % 2 else "\n").join(words)))
        tags[i, : len(words)], mask[i, : len(words)] = t, True
    size = N_FEATURES * 3 + 9 + 3
    theta, square = np.zeros(size), np.full(size, 1e-8)
    each = np.arange(n)
    at = feats[mask]
    for _ in range(rounds):
        weights, turns, first = theta[: N_FEATURES * 3].reshape(-1, 3), theta[-12:-3].reshape(3, 3), theta[-3:]
        score = weights[feats].sum(2)
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            new = _log_sum(alpha[:, t - 1, :, None] + turns, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(turns + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None])
        goal = np.eye(3)[tags] - node
        grad = np.zeros(size)
        for k in range(3):
            grad[k : N_FEATURES * 3 : 3] = np.bincount(at.ravel(), np.repeat(goal[..., k][mask], at.shape[1]), N_FEATURES)
        for t in range(1, longest):
            ok = mask[:, t]
            edge = np.exp(alpha[ok, t - 1, :, None] + turns + (score[ok, t] + beta[ok, t])[:, None, :] - total[ok, None, None])
            g = -edge.sum(0)
            np.add.at(g, (tags[ok, t - 1], tags[ok, t]), 1)
            grad[-12:-3] += g.ravel()
        grad[-3:] += (np.eye(3)[tags[each, 0]] - node[:, 0]).sum(0)
        grad = grad / n - decay * theta
        square += grad**2
        theta = theta + rate * grad / np.sqrt(square)
    return CRF(theta[: N_FEATURES * 3].reshape(-1, 3), theta[-12:-3].reshape(3, 3), theta[-3:])


@functools.cache
def trained() -> CRF:
    return train(generated(11, TRAINING_LINES))
