"""Symbols of source files in languages with braces, and of SQL: declarations with their whole extent.

A text is blanked first (comments and literals become spaces, line breaks stay), then its brackets are paired in one pass,
and every declaration whose end is found, by its paired brace or its closing sign, is a symbol. All steps are linear in
the text. What isn't closed, because the file is cut off or not of its language, gives no symbol.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths

#: Languages whose symbols are found, by the name that a path's suffix gives.
LANGUAGES = ["javascript", "typescript", "go", "java", "rust", "cpp", "c", "sql"]
#: Words that are no names.
NO_NAMES = {"function", "class", "interface", "type", "func", "fn", "struct", "enum", "create", "table", "view"}

_BLANK = {
    "sql": re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*+(?:'|\Z)", re.DOTALL),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*+(?:\"|\Z)|'(?:[^'\\\n]|\\[^\n]{1,8}?)'", re.DOTALL),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"|`[^`]*+(?:`|\Z)|'(?:[^'\\\n]|\\.)*+'", re.DOTALL),
    "": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+(?:`|\Z)", re.DOTALL),
}
_SIGN = re.compile(r"[(){}\[\];\n]")
_CLOSES = {")": "(", "}": "{", "]": "["}
_ID = r"[A-Za-z_$][\w$]*"
#: Words in front of brackets that begin no declaration of a function.
_CONTROL = set("if for while switch catch return new else do try throw typeof await case sizeof synchronized with yield function super this match loop unsafe delete".split())


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


#: A keyword, the kind it gives, and how the declaration ends: with its braces, or with a sign outside of brackets.
_KEYWORDS: dict[str, list[tuple[re.Pattern, str, str]]] = {
    "javascript": [
        (re.compile(rf"\b(?:async\s+)?function\s*\*?\s*(?P<n>{_ID})\s*(?=[(<])"), "function", "{"),
        (re.compile(rf"\bclass\s+(?P<n>{_ID})"), "class", "{"),
        (re.compile(rf"\b(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=;\n]*)?=\s*(?:async\s+)?(?:function\b|(?={_ID}\s*=>)|(?=[(<]))"), "function", "value"),
    ],
    "go": [
        (re.compile(rf"^func\s+\([^)\n]*\)\s*(?P<n>{_ID})\s*(?=[(\[])", re.MULTILINE), "method", "{"),
        (re.compile(rf"^func\s+(?P<n>{_ID})\s*(?=[(\[])", re.MULTILINE), "function", "{"),
        (re.compile(rf"\btype\s+(?P<n>{_ID})\b"), "type", "line"),
    ],
    "java": [(re.compile(rf"\bclass\s+(?P<n>{_ID})"), "class", "{"), (re.compile(rf"\binterface\s+(?P<n>{_ID})"), "interface", "{"), (re.compile(rf"\benum\s+(?P<n>{_ID})"), "enum", "{")],
    "rust": [
        (re.compile(rf"\bfn\s+(?P<n>{_ID})"), "function", "{"),
        (re.compile(rf"\bstruct\s+(?P<n>{_ID})"), "struct", "{;"),
        (re.compile(rf"\benum\s+(?P<n>{_ID})"), "enum", "{"),
        (re.compile(rf"\btrait\s+(?P<n>{_ID})"), "interface", "{"),
    ],
    "cpp": [(re.compile(rf"\bclass\s+(?P<n>{_ID})"), "class", "body"), (re.compile(rf"\bstruct\s+(?P<n>{_ID})"), "struct", "body"), (re.compile(rf"\benum\s+(?:class\s+)?(?P<n>{_ID})"), "enum", "body")],
    "sql": [(re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+)?(?P<k>TABLE|VIEW|FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<n>[\w.\"`\[\]]+)", re.IGNORECASE), "", ";")],
}
_KEYWORDS["typescript"] = [
    *_KEYWORDS["javascript"],
    (re.compile(rf"\binterface\s+(?P<n>{_ID})"), "interface", "{"),
    (re.compile(rf"\benum\s+(?P<n>{_ID})"), "enum", "{"),
    (re.compile(rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>{_ID})\s*(?:<[^=\n]*>)?\s*=", re.MULTILINE), "type", "line"),
]
_KEYWORDS["c"] = _KEYWORDS["cpp"]
_CALL = re.compile(rf"(?<![\w$])(?P<n>{_ID})\s*+(?=\()")
_AFTER = {"java": re.compile(r"\s*(?:throws\s+[\w.,\s]+)?\{"), "cpp": re.compile(r"\s*(?:const|noexcept|override|final|\s)*\{"), "javascript": re.compile(r"\s*(?::[^{};=]+)?\{")}
_AFTER |= {"c": _AFTER["cpp"], "typescript": _AFTER["javascript"]}


def blanked(text: str, language: str) -> str:
    """The text with spaces in place of comments and literals, of the same length and with the same lines."""
    return _BLANK.get(language, _BLANK[""]).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


class Brackets(NamedTuple):
    """pairs: the closing place of every opening bracket closed by its like. signs: places of brackets and ; in order,
    and lines those and the line breaks. edges and inner: after each curly bracket the innermost one that is open, or -1."""

    pairs: dict[int, int]
    signs: list[int]
    lines: list[int]
    edges: list[int]
    inner: list[int]


def brackets(text: str) -> Brackets:
    pairs, open_, signs, lines, edges, inner, curly = {}, [], [], [], [], [], []
    for m in _SIGN.finditer(text):
        sign, at = m.group(), m.start()
        lines.append(at)
        if sign == "\n":
            continue
        signs.append(at)
        if sign in "({[":
            open_.append((at, sign))
        elif sign != ";" and open_ and open_[-1][1] == _CLOSES[sign]:
            pairs[open_.pop()[0]] = at
        if sign in "{}":
            curly.append(at) if sign == "{" else curly and curly.pop()
            edges.append(at)
            inner.append(curly[-1] if curly else -1)
    return Brackets(pairs, signs, lines, edges, inner)


_ARROW = re.compile(r"\s*(?::[^=;{\n]*)?=>\s*")


def _end(text: str, at: int, how: str, found: Brackets) -> int | None:
    """The last place of a declaration whose head ends at `at`; brackets on the way are passed over, nothing is read twice."""
    places = found.lines if how in ("line", "value") else found.signs
    while True:
        i = bisect.bisect_left(places, at)
        if i == len(places):
            return len(text) - 1 if how in (";", "line", "value") else None
        place = places[i]
        sign = text[place]
        if sign in "([{":
            close = found.pairs.get(place)
            if close is None or (how == "body" and sign == "("):
                return None
            if sign == "{" and how != ";":
                return close
            at = close + 1
            if how == "value" and sign == "(" and (a := _ARROW.match(text, at)):
                at = a.end()
        elif sign == "\n" or (sign == ";" and how not in ("{", "body")):
            return place - (sign == "\n")
        elif sign in ";)" or how != ";":
            return None
        else:
            at = place + 1


def _functions(text: str, language: str, found: Brackets, bodies: set[int]) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, name, kind) of functions without a keyword: methods right inside of a class, and C functions."""
    for m in _CALL.finditer(text):
        name = m["n"]
        close = found.pairs.get(m.end())
        if name in _CONTROL or close is None:
            continue
        body = _AFTER[language].match(text, close + 1)
        end = found.pairs.get(body.end() - 1) if body else None
        if end is None:
            continue
        before = bisect.bisect_left(found.signs, m.start()) - 1
        while before >= 0 and text[found.signs[before]] not in ";{}" and m.start() - found.signs[before] < 400:
            before -= 1
        begin = found.signs[before] + 1 if before >= 0 else 0
        head = text[begin : m.start()]
        words = head.split()
        if len(head) > 400 or any(w in _CONTROL for w in words) or "=" in words or head.rstrip().endswith((".", ",", "(", "=")):
            continue
        first = begin + len(head) - len(head.lstrip())
        if language in ("cpp", "c"):
            if words and not head.rstrip().endswith(":"):
                yield first, end, name, "function"
            continue
        edge = bisect.bisect_left(found.edges, m.start()) - 1
        if edge >= 0 and found.inner[edge] in bodies and (words or language != "java"):
            yield first, end, name, "method"


def find_symbols(content: str, language: str) -> list[Symbol]:
    """Declarations with their kinds and lines, in order of line and name; the same name on the same lines counts once."""
    if language not in _KEYWORDS:
        return []
    text = blanked(content, language)
    places = brackets(text)
    found: list[tuple[int, int, str, str]] = []
    bodies: set[int] = set()
    for pattern, kind, how in _KEYWORDS[language]:
        for m in pattern.finditer(text):
            end = _end(text, m.end(), how, places)
            if end is None:
                continue
            value = how == "value"
            if value and "function" not in m.group() and "=>" not in text[m.end() : min(end, m.end() + 2000)]:
                continue
            begin = m.start("n") if value else m.start() + len(m.group()) - len(m.group().lstrip())
            found.append((begin, end, m["n"], kind or {"table": "table", "view": "view"}.get(m["k"].lower(), "function")))
            if how in ("{", "body") and kind in ("class", "interface", "enum"):
                bodies.add(text.find("{", m.end()))
    if language in _AFTER:
        found += _functions(text, language, places, bodies)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = {}
    for begin, end, name, kind in found:
        name = name.strip().strip("`\"[]")
        if name and name.lower() not in NO_NAMES:
            first, last = bisect.bisect_left(breaks, begin) + 1, bisect.bisect_left(breaks, end) + 1
            out.setdefault((name, first, max(first, last)), kind)
    return sorted((Symbol(n, k, a, b) for (n, a, b), k in out.items()), key=lambda s: (s.start_line, s.name))


def with_symbols(files: DataFrame) -> DataFrame:
    """files (…, path, content) with `parsed`: an array of (name, kind, line, end_line), empty in other languages."""
    kind = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]))

    @F.pandas_udf(kind)
    def parsed(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[(s.name, s.kind, s.start_line, s.end_line) for s in find_symbols(c or "", x)] for c, x in zip(content, language)])

    known = paths.language("path").isin(LANGUAGES)
    # tsx and jsx are read as the languages their suffixes stand for
    return files.withColumn("parsed", F.when(known, parsed("content", paths.language("path"))).otherwise(F.array().cast(kind)))
