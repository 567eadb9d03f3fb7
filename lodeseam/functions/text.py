"""Column expressions for code text: tokens, query expansion, overlaps, lines. All built-in functions, no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is made of.
WORD = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"

#: Synonyms that a query's words bring in.
EXPANSIONS: dict[str, list[str]] = {
    "retry": ["attempt", "attempts", "backoff"],
    "backoff": ["attempt", "attempts", "retry"],
    "auth": ["credential", "credentials", "token"],
    "token": ["auth", "credential", "credentials"],
    "credential": ["auth", "credentials", "token"],
    "credentials": ["auth", "credential", "token"],
    "route": ["endpoint", "handler"],
    "endpoint": ["handler", "route"],
    "handler": ["endpoint", "route"],
    "config": ["option", "options", "setting", "settings"],
    "setting": ["config", "option"],
    "settings": ["config", "options"],
    "option": ["config", "setting"],
    "options": ["config", "settings"],
}

#: Words that a full-text query leaves out.
STOPWORDS = ["the", "and", "for", "with", "where", "what", "how", "does", "this", "that", "from", "into", "code", "find", "show", "implemented", "implementation"]

QUERY_TERMS = 16
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Words of a text (WORD), split at underscores and before capitals, in lower case.

    Written as three replacements and one split, which are compiled, instead of a lambda for every word: digits that
    begin a word are set apart from letters after them, capitals get an underscore, the rest becomes blanks.
    """
    plain = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "(?<![A-Za-z0-9_])([0-9]+)(?=[A-Za-z_])", "$1 ")
    plain = F.regexp_replace(F.regexp_replace(plain, "([A-Z])", "_$1"), "[^A-Za-z0-9]+", " ")
    return F.array_remove(F.split(F.lower(plain), " "), "")


#: The same rule for text in a worker: what a token is, in one expression.
_TOKEN = re.compile(r"[A-Za-z][a-z0-9]*|(?<=_)[0-9][a-z0-9]*|[0-9]+")


def token_list(text: str | None) -> list[str]:
    """The tokens of one text, as `tokens` gives them."""
    return [t.lower() for t in _TOKEN.findall(text or "")]


def normalized(text: Column | str) -> Column:
    return F.array_join(tokens(text), " ")


def expanded(text: Column | str) -> Column:
    """The tokens, then the synonyms of each in order, without repeats."""
    known = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = tokens(text)
    added = F.flatten(F.transform(words, lambda t: F.coalesce(known[t], F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, added))


def query_terms(text: Column | str) -> Column:
    """What is looked up in the full-text index: the first 16 expanded words of over two letters that aren't stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(expanded(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))
    return F.array_distinct(F.slice(kept, 1, QUERY_TERMS))


def overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's distinct tokens that the candidate has; both are token arrays."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, candidate)) / F.size(q))


def symbol_match(query_text: Column | str, query: Column, name: Column | str, name_tokens: Column) -> Column:
    name, query_text = _col(name), _col(query_text)
    s = F.array_distinct(name_tokens)
    return (
        F.when(name.isNull() | (name == "") | (F.size(query) == 0) | (F.size(s) == 0), 0.0)
        .when(F.contains(F.lower(query_text), F.lower(name)), 1.0)
        .otherwise(F.size(F.array_intersect(query, s)) / F.size(s))
    )


def path_exact(query_text: Column | str, query: Column, path: Column | str) -> Column:
    """2 where the query, blanks as underscores, stands in the path, its separators as underscores; else the overlap."""
    asked = F.replace(F.trim(F.lower(_col(query_text))), F.lit(" "), F.lit("_"))
    where = F.translate(F.lower(_col(path)), "/. -", "____")
    return F.when((asked != "") & F.contains(where, asked), 2.0).otherwise(overlap(query, tokens(F.translate(F.lower(_col(path)), "/.-", "  _"))))


def lines(text: Column | str) -> Column:
    """Lines at every kind of line break; a break at the end begins no line, and an empty text has none."""
    text = F.coalesce(_col(text), F.lit(""))
    parts = F.split(text, LINE_BREAKS, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def truncated(text: Column | str, most: int) -> Column:
    return _col(text) if most <= 0 else F.substring(_col(text), 1, most)


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(_col(text), F.lit("")).rlike("(?U)[^\\s\\x1c-\\x1f]")
