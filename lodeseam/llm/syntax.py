"""Source files that do not parse: full parses by tables built from the bundled grammars.

Every current file in a language with a grammar is lexed and its whole token stream run through the table-driven
recognizer; the first token after which no reading of the text goes on is reported with its line. Statement ends that
the language inserts (at line breaks, before } and at the end, where the text doesn't go on otherwise) are inserted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexers
from .files import LANGUAGES, suffix
from .glr import END, Grammar, Parser


@functools.cache
def grammar(language: str) -> Grammar:
    names = {"javascript": ["ecma"], "typescript": ["ecma", "typescript"]}.get(language, [language])
    folder = resources.files(__package__) / "grammars"
    return Grammar("\n".join((folder / f"{n}.txt").read_text() for n in names), "text")




def first_error(text: str, language: str) -> tuple[int, str] | None:
    """(line, token) of the first unrecoverable error of a text, None if it parses."""
    parser = Parser(grammar(language))
    feed = parser.feed
    if language in ("javascript", "typescript"):
        depth: list[str] = []
        for token, at, broken in getattr(lexers, language)(text):
            if not feed(token):
                inserted = (broken or token == "\0}") and (not depth or depth[-1] == "\0{") and feed("\0;")
                if not inserted or not feed(token):
                    return text.count("\n", 0, at) + 1, token.lstrip("\0")
            if token in ("\0(", "\0[", "\0{"):
                depth.append(token)
            elif token in ("\0)", "\0]", "\0}") and depth:
                depth.pop()
        if not feed(END) and not (feed("\0;") and feed(END)):
            return text.count("\n") + 1, END
        return None
    for token, at in getattr(lexers, language)(text):
        if not feed(token):
            return text.count("\n", 0, at) + 1, token.lstrip("\0")
    return None if feed(END) else (text.count("\n") + 1, END)


def check(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, parses, error_line, error_token) of every file whose suffix has a grammar.

    files: (repo_id, path, text). The suffix decides the language; other files are left out. An empty or blank file is
    a valid text but for JSON, which needs a value. An empty table gives an empty result.
    """
    mapping = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = files.withColumn("language", mapping[suffix()]).filter(F.col("language").isNotNull()).select("repo_id", "path", "language", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, path, language, text in batch.itertuples(index=False):
                error = first_error(text or "", language)
                out.append((repo, path, language, error is None, error and error[0], error and error[1]))
            yield pd.DataFrame(out, columns=["repo_id", "path", "language", "parses", "error_line", "error_token"]).astype({"error_line": "Int64"})

    return rows.mapInPandas(run, "repo_id string, path string, language string, parses boolean, error_line long, error_token string")


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their share for each repository and language."""
    counts = checked.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("parses")).alias("invalid"))
    return counts.withColumn("invalid_share", F.round(F.col("invalid") / F.col("files"), 6))
