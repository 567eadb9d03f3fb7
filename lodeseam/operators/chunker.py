"""Cutting files into chunks: line windows, symbols by expression, Python symbols by syntax tree, ids, dedupe."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MAX_LINES, OVERLAP_LINES, LEAST_BYTES = 80, 10, 50

#: Declaration forms and the kind each gives.
SYMBOL_FORMS = [
    (r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b", "class"),
    (r"^\s*function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^\s*func\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\b", "type"),
    (r"^\s*interface\s+([A-Za-z_][A-Za-z0-9_]*)\b", "interface"),
]
SYMBOLS = "array<struct<name:string,kind:string,line:int,confidence:string>>"


def windows(lines: Column, most: int = MAX_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Array of (start_line, end_line, content): windows of at most `most` lines, each sharing `overlap` with the next."""
    n = F.size(lines)
    step = most - overlap
    last = F.greatest(F.lit(0), F.ceil((n - most) / F.lit(step))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    made = F.transform(
        starts,
        lambda s: F.struct(
            (s + 1).cast("int").alias("start_line"),
            F.least(s + most, n).cast("int").alias("end_line"),
            F.array_join(F.slice(lines, s + 1, most), "\n").alias("content"),
        ),
    )
    return F.when(n == 0, F.array().cast("array<struct<start_line:int,end_line:int,content:string>>")).otherwise(made)


def bare(line: Column) -> Column:
    """The line up to its first quote or comment; nothing of a comment line."""
    cut = F.regexp_replace(line, "(?s)[\"'#].*$|//.*$", "")
    return F.when(F.trim(line).rlike(r"^(?:#|//|\*)"), "").otherwise(cut)


def regex_symbols(lines: Column) -> Column:
    """Array of (name, kind, line, confidence) of the declarations that an expression finds."""

    def of_line(line: Column, number: Column) -> Column:
        plain = bare(line)
        name: Column = F.lit(None).cast("string")
        kind: Column = F.lit(None).cast("string")
        for expression, k in reversed(SYMBOL_FORMS):
            name = F.when(plain.rlike(expression), F.regexp_extract(plain, expression, 1)).otherwise(name)
            kind = F.when(plain.rlike(expression), F.lit(k)).otherwise(kind)
        return F.struct(name.alias("name"), kind.alias("kind"), (number + 1).cast("int").alias("line"), F.lit("regex").alias("confidence"))

    return F.filter(F.transform(lines, of_line), lambda s: s["name"].isNotNull())


def symbol_windows(symbols: Column, lines: Column, most: int = MAX_LINES) -> Column:
    """Array of (start_line, end_line, content, s): for every symbol s its line and those after it, `most` at most."""

    def of_symbol(s: Column) -> Column:
        end = F.least(s["line"] + most - 1, F.size(lines)).cast("int")
        return F.struct(s["line"].alias("start_line"), end.alias("end_line"), F.array_join(F.slice(lines, s["line"], most), "\n").alias("content"), s.alias("s"))

    return F.transform(symbols, of_symbol)


def parsed_windows(parsed: Column, lines: Column, most: int = MAX_LINES) -> Column:
    """Array of (start_line, end_line, content, s): every declaration whole; one of more than `most` lines has none."""

    def of_symbol(p: Column) -> Column:
        end = F.least(p["end_line"], F.size(lines)).cast("int")
        s = F.struct(p["name"].alias("name"), p["kind"].alias("kind"), p["line"].alias("line"), F.lit("parser").alias("confidence"))
        return F.struct(p["line"].alias("start_line"), end.alias("end_line"), F.array_join(F.slice(lines, p["line"], end - p["line"] + 1), "\n").alias("content"), s.alias("s"))

    return F.transform(F.filter(parsed, lambda p: (F.least(p["end_line"], F.size(lines)) - p["line"] < most) & (p["line"] <= F.size(lines))), of_symbol)


def nearest_symbol(symbols: Column, start: Column, end: Column) -> Column:
    """The first symbol within the lines, else the last one that begins before them."""
    inside = F.filter(symbols, lambda s: (s["line"] >= start) & (s["line"] <= end))
    before = F.filter(symbols, lambda s: s["line"] <= start)
    return F.when(F.size(inside) > 0, F.element_at(inside, 1)).when(F.size(before) > 0, F.element_at(before, -1))


def python_symbols(source: str) -> list[tuple[str, str, int, int, int]]:
    """(name, kind, first line with decorators, last line, line of the name) of functions, classes and direct methods;
    nothing if the text doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nodes = [n for n in tree.body if isinstance(n, kinds)]
    nodes += [m for n in nodes if isinstance(n, ast.ClassDef) for m in n.body if isinstance(m, kinds[:2])]
    out = []
    for n in sorted(nodes, key=lambda n: n.lineno):
        first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
        out.append((n.name, "class" if isinstance(n, ast.ClassDef) else "function", first, n.end_lineno or n.lineno, n.lineno))
    return out


def syntax_chunks(files: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """Symbol chunks of Python files: (repo_id, path, symbol_name, symbol_kind, symbol_line, start_line, end_line, content);
    a symbol of more than `most` lines from its name on has none: windows and expressions hold its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, path, content in batch[["repo_id", "path", "content"]].itertuples(index=False):
                lines = (content or "").split("\n")
                for name, kind, first, last, at in python_symbols(content or ""):
                    if last - at + 1 <= most:
                        out.append((repo, path, name, kind, at, first, last, "\n".join(lines[first - 1 : last])))
            yield pd.DataFrame(out, columns=["repo_id", "path", "symbol_name", "symbol_kind", "symbol_line", "start_line", "end_line", "content"])

    return files.select("repo_id", "path", "content").mapInPandas(
        run, "repo_id string, path string, symbol_name string, symbol_kind string, symbol_line int, start_line int, end_line int, content string"
    )


def chunk_files(files: DataFrame, most: int = MAX_LINES, overlap: int = OVERLAP_LINES, syntax: bool = True) -> DataFrame:
    """Chunks of files (repo_id, repo_path, path, content): windows with their nearest symbol; the whole declarations of
    languages with braces and of SQL, or else the symbols that expressions find; Python symbols by syntax tree."""
    from ..functions import paths
    from .symbols import with_symbols

    base = files.select("repo_id", "repo_path", "path", "content", paths.language("path").alias("language"))
    base = with_symbols(base) if syntax else base.withColumn("parsed", F.array().cast("array<struct<name:string,kind:string,line:int,end_line:int>>"))
    whole = F.size("parsed") > 0
    declared = F.transform("parsed", lambda p: F.struct(p["name"].alias("name"), p["kind"].alias("kind"), p["line"].alias("line"), F.lit("parser").alias("confidence")))
    rows = base.withColumn("lines", text.lines("content")).withColumn("symbols", F.when(whole, declared).otherwise(regex_symbols(F.col("lines"))))
    symbols = F.col("symbols")
    bodies = F.when(whole, parsed_windows(F.col("parsed"), F.col("lines"), most)).otherwise(symbol_windows(symbols, F.col("lines"), most))
    labelled = F.transform(windows(F.col("lines"), most, overlap), lambda w: F.struct(w["start_line"].alias("start_line"), w["end_line"].alias("end_line"), w["content"].alias("content"), nearest_symbol(symbols, w["start_line"], w["end_line"]).alias("s")))
    cut = rows.select("repo_id", "repo_path", "path", "language", F.inline(F.concat(labelled, bodies)))
    made = cut.select(
        "repo_id", "repo_path", "path", "language", F.col("s.name").alias("symbol_name"), F.col("s.kind").alias("symbol_kind"), F.col("s.line").alias("symbol_line"), F.col("s.confidence").alias("symbol_confidence"), "start_line", "end_line", "content"
    )
    if syntax:
        keys = files.select("repo_id", "repo_path", "path").distinct()
        python = syntax_chunks(files.filter(F.col("path").endswith(".py")), most)
        python = python.join(keys, ["repo_id", "path"]).withColumns({"language": F.lit("python"), "symbol_confidence": F.lit("parser")})
        made = made.unionByName(python.select(*made.columns))
    return dedupe(made)


def dedupe(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["repo_id", "path", "start_line", "end_line", "content", "symbol_name", "symbol_confidence"])


def chunk_id() -> Column:
    """SHA-256 of the fields that identify a chunk, joined by NUL."""
    fields = [F.col("repo_id"), F.col("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string")]
    fields += [F.coalesce("symbol_name", F.lit("")), F.coalesce("symbol_confidence", F.lit("")), F.sha2("content", 256)]
    return F.sha2(F.concat_ws("\0", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def indexable(least: int = LEAST_BYTES) -> Column:
    """Whether a chunk is kept: not blank, and with its symbol's line inside or of at least `least` bytes."""
    inside = F.col("symbol_line").between(F.col("start_line"), F.col("end_line"))
    small = (F.lit(least) > 0) & (F.octet_length("content") < least)
    return ~text.is_blank("content") & (F.coalesce(inside, F.lit(False)) | ~small)


def first_of_equal(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("path", "start_line", "end_line", "content", "symbol_name", "symbol_confidence").orderBy("chunk_id")
    return chunks.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
