"""Classified tokens such as ``tokens { measure { units: "km" decimal: "7" } }``: reading, bounded groups, orders, and the first
order that a verbalizer takes.

The grammar of a token's text and the spaces in its serializations are fixed values: graphs are made for them.
A token is a dict in the order of its fields; values are text, a nested dict, true (``preserve_order``) or none (empty).
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbaspark.operators.transducer import Graph, NoPathError

#: One field name, then its opening brace, its value up to a quote before a space, or true; or a closing brace.
_LEX = re.compile(r' *(?:(?P<key>[A-Za-z_]+) *(?:(?P<open>\{)|: *"(?P<value>(?:(?!" ).)*)"(?= )|: *(?P<flag>true))|(?P<close>\}))', re.S)


class ParseError(ValueError):
    """The text is not a list of classified tokens."""


def parse(text: str) -> list[dict]:
    stack: list[list[tuple[str, object]]] = [[]]
    names, at = [], 0
    body = text.rstrip(" ") + " "
    while body[at:].strip(" "):
        m = _LEX.match(body, at)
        if not m:
            raise ParseError(f"no token at {at}")
        at = m.end()
        if m["open"]:
            names.append(m["key"])
            stack.append([])
        elif m["close"]:
            if not names:
                raise ParseError(f"a brace too many at {at}")
            fields = dict(stack.pop())
            stack[-1].append((names.pop(), fields))
        else:
            if (m["flag"] is not None) != (m["key"] == "preserve_order"):
                raise ParseError(f"wrong value of {m['key']}")
            stack[-1].append((m["key"], True if m["flag"] else m["value"] or None))
    if names:
        raise ParseError("a brace is open")
    return [{k: v} for k, v in stack[0]]


def orders(token: dict) -> int:
    """How many orders of fields a token has at most."""
    return math.factorial(len(token)) * math.prod(orders(v) for v in token.values() if isinstance(v, dict))


def bounded_groups(tokens: list[dict], limit: int = 729) -> list[list[dict]]:
    """Consecutive tokens in groups whose orders multiply to the limit at most; one token beyond it is an error."""
    sizes = [orders(t) for t in tokens]
    if (most := max(sizes, default=1)) > limit:
        raise ValueError(f"one token has {most} orders, more than {limit}")
    running = itertools.accumulate(sizes, lambda product, n: product * n if product * n <= limit else n)
    # A group begins where the running product has started again from one token's own orders, not from the product before.
    begins, last = [0], 1
    for k, (n, product) in enumerate(zip(sizes, running, strict=True)):
        if last * n > limit:
            begins.append(k)
        last = product
    return [tokens[a:b] for a, b in zip(begins, [*begins[1:], len(tokens)], strict=True)]


def serializations(token: dict) -> list[str]:
    """A token in every order of its fields, or in its own where ``preserve_order`` is set."""
    fields = [(k, _written(k, v)) for k, v in token.items()]
    chosen = [fields] if "preserve_order" in token else itertools.permutations(fields)
    return ["".join(parts) for order in chosen for parts in itertools.product(*(forms for _, forms in order))]


def _written(key: str, value: object) -> list[str]:
    if value is None:
        raise ValueError(f"no value for {key}")
    if isinstance(value, dict):
        return [f" {key} {{ {inner} }} " for inner in serializations(value)]
    return [f"{key}: true " if value is True else f'{key}: "{value}" ']


def candidates(group: list[dict]) -> Iterator[str]:
    """The serializations of a whole group, one by one."""
    return map("".join, itertools.product(*map(serializations, group)))


def escaped(text: str) -> str:
    return re.sub(r"([\\\[\]])", r"\\\1", text)


def first_success(tagged: str, source: str, verbalize: Callable[[str], str], limit: int = 729) -> str:
    """The tokens of ``tagged`` verbalized group by group, each in the first order that ``verbalize`` takes.

    Where a group has no such order, or a token has a field without value, the answer is ``source`` with its marks escaped."""
    said = []
    groups = bounded_groups(parse(tagged), limit)
    try:
        for group in groups:
            for order in candidates(group):
                try:
                    said.append(verbalize(order))
                    break
                except NoPathError:
                    continue
            else:
                return escaped(source)
    except ValueError:
        return escaped(source)
    return re.sub(" {2,}", " ", " ".join(said))


def spoken_tokens(tagged: Column, source: Column, graph: Graph, limit: int = 729) -> Column:
    """Struct of output and error: ``first_success`` by a verbalizing graph; texts that cannot be read are errors."""

    @F.pandas_udf("struct<output:string,error:string>")
    def run(texts: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, sources, strict=True):
            try:
                rows.append((None if t is None else first_success(t, s or "", graph.rewrite, limit), None))
            except ValueError as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["output", "error"], dtype=object)

    return run(tagged, source)


class TokenRows:
    """Table function: place, class and fields (as JSON) of each token of a text. A text that is no list of tokens fails the query."""

    def eval(self, tagged: str) -> Iterator[tuple[int, str, str]]:
        for k, token in enumerate(parse(tagged) if tagged is not None else []):
            for name, fields in token["tokens"].items() if isinstance(token.get("tokens"), dict) else token.items():
                yield k, name, json.dumps(fields, ensure_ascii=False)


token_rows = F.udtf(TokenRows, returnType="place int, class string, fields string")


def group_sizes(tagged: Column, limit: int = 729) -> Column:
    """How many tokens each bounded group has."""

    @F.pandas_udf("array<int>")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(g) for g in bounded_groups(parse(t), limit)], na_action="ignore")

    return sizes(tagged)


def orderings(tagged: Column) -> Column:
    """Every serialization of all tokens of a text, in the order that the search tries them."""

    @F.pandas_udf("array<string>")
    def listed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(candidates(parse(t))), na_action="ignore")

    return listed(tagged)


def order_count(n_fields: Column) -> Column:
    """Orders of a flat token with so many fields."""
    return F.factorial(n_fields)


def token_json(tagged: Column) -> Column:
    """Struct of the tokens as JSON and an error, of which one is null."""

    @F.pandas_udf("struct<tokens:string,error:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None if t is None else json.dumps(parse(t), ensure_ascii=False), None))
            except ParseError as e:
                rows.append((None, f"ParseError: {e}"))
        return pd.DataFrame(rows, columns=["tokens", "error"], dtype=object)

    return read(tagged)
