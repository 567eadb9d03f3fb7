"""Files that nobody wrote by hand: generated, minified or bundled, third-party copies, data saved as code.

A character trigram model of identifiers is trained for every language on its distinct identifiers (so names that a
thousand files repeat, and the few letters of minified ones, weigh no more than others), and every file is described by
it: the share of mangled names (of high cross-entropy, whatever their length), the diversity of its names and of the
shapes of its lines, its naming style, and the share of its text that is literal data. What is usual in a language is
taken from these descriptions. Minified files have mangled names on dense lines, generated ones templates without
diversity, vendored folders a naming style foreign to their repository and language, data files nothing but literals.
What a file says of itself (a generator's or vendor's mark in the comments that open or close it) and what its path says
is evidence beside this.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple, get_type_hints

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .files import suffix

ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0123456789_"
#: Suffixes of source code; each gets a model of its own.
CODE = "py pyi js jsx mjs cjs ts tsx go java kt scala groovy c h cc cpp hpp cs rs rb php swift lua pl sql sh bash css scss".split()
#: Of these, the ones whose files are lists of statements: lines of one shape are their nature, no template.
LISTS = "sql sh bash css scss".split()
_INDEX = {c: i for i, c in enumerate(ALPHABET)}
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_WORD = re.compile(r"\w+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NUMBERS = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.eE]*)[\s,;\]\[{}()]*){4,}")
_BLOB_LINE = re.compile(r"^[ \t]*[A-Za-z0-9+/=]{40,}[ \t]*$", re.MULTILINE)
_COMMENT = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/", re.DOTALL)

_GENERATED = re.compile(
    r"@generated\b|\bauto-?generated\b|(?:automatically|machine|code)[ -]generated|\bgenerated (?:by|from)\b.*\b(?:do not|don't|by|from)\b|"
    r"do not (?:edit|modify|change)|automatisch (?:von|erzeugt|generiert)|g[ée]n[ée]r[ée] automatiquement|changes will be (?:lost|overwritten)",
    re.IGNORECASE,
)
_THIRD_PARTY = re.compile(
    r"\bvendored (?:from|copy)|\bupstream copy|\bcopied (?:verbatim )?from https?:|"
    r"^\W*[\w\-]+ v?\d+\.\d+(?:\.\d+)?\b.*\blicen[sc]e|@preserve\b|@license\b",
    re.IGNORECASE | re.MULTILINE,
)
_MINIFIED = re.compile(r"^\W*sourceMappingURL=", re.MULTILINE)
_DENIED = re.compile(
    r"no longer generated|not (?:auto-?)?generated|hand[- ](?:edited|written|maintained)|maintained by hand|generator .* (?:deleted|removed)|"
    r"marked as generated|files? that (?:are|were) generated",
    re.IGNORECASE,
)
_LICENCE_VERSION = re.compile(r"\blicen[sc]e\b.*\bv?\d+\.\d+", re.IGNORECASE)
_VENDOR_PATH = re.compile(r"(?:^|/)(?:_?vendor|vendored|third_?party|3rdparty|node_modules|bower_components|site-packages|dist-packages|externals?|bundled|deps)/[^/]+/.", re.IGNORECASE)
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|autogen|__generated__|generated-sources)/", re.IGNORECASE)
_GENERATED_NAME = re.compile(r"(?:\.g|\.pb|\.pb\.gw|_pb2|_pb2_grpc|_pb|_grpc_pb|\.generated|\.designer|_generated|\.gen)\.[A-Za-z]+$", re.IGNORECASE)
_MINIFIED_NAME = re.compile(r"(?:[.\-]min|\.bundle|\.chunk|\.packed)\.[A-Za-z]+$", re.IGNORECASE)


class Limits(NamedTuple):
    """Thresholds of what names and shapes show, without any mark."""

    mangled_bits: float = 3.5  # cross-entropy per character that makes a name mangled
    mangled_share: float = 0.82  # of a file's distinct identifiers
    dense_line: float = 60.0  # mean characters per line of a minified file
    template_share: float = 0.88  # of the lines, in their three most frequent shapes
    data_share: float = 0.85  # of the characters, in literals
    name_diversity: float = 0.4  # of the names' first parts, as a share of what is usual in the language, in a template
    least_names: int = 20  # for that
    least_lines: int = 6  # for templates
    least_chars: int = 400  # for data
    foreign_style: float = 0.6  # distance of a folder's share of names with underscores from its repository's and language's
    least_files: int = 3  # of a folder, for that


def identifiers(text: str) -> list[str]:
    """The distinct identifiers outside strings and comments."""
    return sorted(set(_IDENTIFIER.findall(_COMMENT.sub(" ", _STRING.sub('""', text)))))


def diversity(words: list[str], size: int = 60) -> float:
    """Distinct first parts of names to names, in samples of at most `size` names that together hold all of them: in
    larger samples any text's names repeat their parts."""
    first = [m.group().lower() if (m := _PART.search(w)) else w for w in words]
    step = -(-len(first) // size)
    samples = [first[i::step] for i in range(step)]
    return sum(len(set(x)) for x in samples) / max(1, sum(map(len, samples)))


_CODES = np.zeros(256, np.int32)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i
_CODES[ord("$")] = 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all trigrams of the words with two marks before and one after each, number of trigrams of each word)."""
    size = len(ALPHABET)
    plain = [w.lower().replace("$", "_") for w in words]
    codes = _CODES[np.frombuffer("".join([f"^^{w}$" for w in plain]).encode("ascii", "replace"), np.uint8)]
    third = codes[2:]
    at = np.flatnonzero(third != 0)
    return (codes[at] * size + codes[at + 1]) * size + third[at], np.array([len(w) + 1 for w in plain], np.int64)


def vocabulary(files: DataFrame) -> DataFrame:
    """(lang, word): the distinct identifiers of each language; made distinct within a worker's batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, set()).update(identifiers(text or ""))
            if sum(map(len, held.values())) > 500_000:
                yield from _words(held)
                held = {}
        yield from _words(held)

    return files.select("lang", "text").mapInArrow(run, "lang string, word string").distinct()


def _words(held: dict[str, set[str]]) -> Iterator[pa.RecordBatch]:
    for lang, words in held.items():
        yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], ["lang", "word"])


def count_trigrams(words: DataFrame) -> DataFrame:
    """(lang, gram int, n) of distinct identifiers (lang, word)."""
    size = len(ALPHABET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            names = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                table = counts.setdefault(lang, np.zeros(size**3, np.int64))
                np.add.at(table, grams(names[langs == lang].tolist())[0], 1)
        for lang, table in counts.items():
            seen = np.flatnonzero(table)
            yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(table[seen])], ["lang", "gram", "n"])

    return words.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(files: DataFrame) -> dict[str, np.ndarray]:
    """The count of every trigram in the identifiers of each language: at most 59,319 counts a language reach the driver."""
    counts = count_trigrams(vocabulary(files)).toPandas()
    model = {}
    for lang, rows in counts.groupby("lang"):
        model[lang] = np.zeros(len(ALPHABET) ** 3, np.float32)
        model[lang][rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return model


def bits_per_char(words: list[str], counts: np.ndarray) -> np.ndarray:
    """The cross-entropy of each of a file's names under the model without these names, so that a file's own odd names
    don't make themselves usual."""
    size = len(ALPHABET)
    found, n = grams(words)
    seen, number, own = np.unique(found, return_inverse=True, return_counts=True)
    context, place = np.unique(seen // size, return_inverse=True)
    total = np.maximum(counts.reshape(-1, size)[context].sum(axis=1, dtype=np.float64) - np.bincount(place, weights=own), 0)
    share = (np.maximum(counts[seen] - own, 0) + 0.1) / (total + 0.1 * size)[place]
    return np.add.reduceat(-np.log2(share)[number], np.concatenate([[0], np.cumsum(n)[:-1]])) / n


_COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|#|--|<!--|;)")
_PREAMBLE = re.compile(r"\s*(?:package|import|from|use|using|require|include|const \w+ = require|logger\b|[\"']use strict)|\s*[)}\]];?\s*$|^\s*$")
_DOC = re.compile(r"\s*[rbu]?(\"\"\"|\'\'\')")


def _opening(lines: list[str]) -> list[str]:
    """The comments, whole blocks and docstrings, in front of the first line that is neither these nor an import."""
    out, closes = [], ""
    for line in lines:
        if closes:
            out.append(line.strip())
            closes = "" if closes in line else closes
        elif (doc := _DOC.match(line)) or line.lstrip().startswith("/*"):
            out.append(line.strip())
            closes = doc[1] if doc else "*/"
            if closes in line[line.index(closes if doc else "/*") + (3 if doc else 2) :]:
                closes = ""
        elif _COMMENT_LINE.match(line):
            out.append(line.strip())
        elif not _PREAMBLE.match(line):
            break
    return out


def marks(text: str) -> str:
    """What the comments that open and close a file say, however long they are."""
    lines = text.split("\n")
    foot = []
    for line in reversed(lines):
        if _COMMENT_LINE.match(line):
            foot.append(line.strip())
        elif line.strip():
            break
    head = _opening(lines)
    return "\n".join(head + [x for x in reversed(foot) if x not in head])


class Traits(NamedTuple):
    mangled_share: float
    mean_bits: float
    name_diversity: float
    snake_share: float
    mean_line: float
    template_share: float
    data_share: float
    lines: int
    chars: int
    names: int
    styled: int  # names in either style


def traits(text: str, counts: np.ndarray | None, limits: Limits = Limits()) -> Traits:
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return Traits(0, 0, 0, 0, 0, 0, 0, 0, len(text), 0, 0)
    words = identifiers(text)
    per_char = bits_per_char(words, counts) if counts is not None and words else np.zeros(len(words))
    mangled = int((per_char >= limits.mangled_bits).sum())
    snake = sum("_" in w.strip("_") and w.islower() for w in words)
    camel = sum(bool(re.match(r"[a-z]+[A-Z]", w)) for w in words)
    plain = _STRING.sub("w", text)
    shapes = Counter(x for x in (y.strip() for y in _WORD.sub("w", plain).replace(" ", "").split("\n")) if x)
    literal = sum(len(m.group()) for m in _STRING.finditer(text) if len(m.group()) >= 40 and " " not in m.group())
    literal += sum(m.end() - m.start() for m in _NUMBERS.finditer(plain)) + sum(m.end() - m.start() for m in _BLOB_LINE.finditer(plain))
    return Traits(
        mangled / max(1, len(words)),
        float(per_char.mean()) if len(words) else 0.0,
        diversity(words),
        snake / (snake + camel + 1),
        sum(map(len, lines)) / len(lines),
        sum(n for _, n in shapes.most_common(3)) / max(1, sum(shapes.values())),
        literal / max(1, len(text) - text.count(" ")),
        len(lines),
        len(text),
        len(words),
        snake + camel,
    )


class Evidence(NamedTuple):
    """What path and comments say."""

    third_party: bool
    licence_version: bool
    minified: bool
    generated: bool
    denied: bool


def evidence(path: str, text: str) -> Evidence:
    told = marks(text)
    kept = "\n".join(x for x in told.split("\n") if not _DENIED.search(x))
    last = text.rstrip().rsplit("\n", 1)[-1]
    return Evidence(
        bool(_VENDOR_PATH.search(path) or _THIRD_PARTY.search(kept)),
        bool(_LICENCE_VERSION.search(kept)),
        bool(_MINIFIED_NAME.search(path) or _MINIFIED.search(last)),
        bool(_GENERATED_PATH.search(path) or _GENERATED_NAME.search(path) or _GENERATED.search(kept)),
        bool(_DENIED.search(told)),
    )


_TYPES = {"float": "double", "int": "long", "bool": "boolean"}


def describe(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(repo_id, path, lang, folder, traits, evidence) of files (repo_id, path, text); no text in the result."""
    tagged = files.withColumn("lang", suffix())
    model = train(tagged.filter(F.col("lang").isin(CODE)))
    shared = files.sparkSession.sparkContext.broadcast(model)  # bounded: suffixes of CODE times 59,319 numbers of 4 bytes
    columns = ["repo_id", "path", "lang", *Traits._fields, *Evidence._fields]
    types = {k: _TYPES[v.__name__] for k, v in {**get_type_hints(Traits), **get_type_hints(Evidence)}.items()}
    schema = "repo_id string, path string, lang string, " + ", ".join(f"{k} {types[k]}" for k in columns[3:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = []
            for repo, path, text, lang in batch[["repo_id", "path", "text", "lang"]].itertuples(index=False):
                out.append((repo, path, lang, *traits(text or "", model.get(lang), limits), *evidence(path, text or "")))
            yield pd.DataFrame(out, columns=columns)

    made = tagged.select("repo_id", "path", "text", "lang").mapInPandas(run, schema)
    return made.withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))


def styles(described: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(repo_id, folder, lang) of folders whose naming style is neither their repository's nor their language's: the share
    of names with underscores among names in either style, of all files there against those elsewhere."""
    named = described.filter(F.col("lang").isin(CODE) & (F.col("styled") > 0)).withColumn("snakes", F.col("snake_share") * (F.col("styled") + 1))
    total = lambda *keys: [F.sum("snakes").alias(f"snakes_{len(keys)}"), F.sum("styled").alias(f"styled_{len(keys)}")]
    folders = named.groupBy("repo_id", "folder", "lang").agg(F.count("*").alias("files"), *total(1, 2, 3))
    repos = folders.groupBy("repo_id", "lang").agg(F.sum("snakes_3").alias("snakes_2"), F.sum("styled_3").alias("styled_2"))
    langs = repos.groupBy("lang").agg(F.sum("snakes_2").alias("snakes_1"), F.sum("styled_2").alias("styled_1"))
    both = folders.join(repos, ["repo_id", "lang"]).join(F.broadcast(langs), "lang")  # a row for each suffix of CODE
    own = F.col("snakes_3") / F.col("styled_3")
    elsewhere = lambda n: F.try_divide(F.col(f"snakes_{n}") - F.col("snakes_3"), F.col(f"styled_{n}") - F.col("styled_3"))
    far = lambda n: F.coalesce(F.abs(own - elsewhere(n)) > limits.foreign_style, F.lit(False))
    return both.filter((F.col("files") >= limits.least_files) & far(2) & far(1)).select("repo_id", "folder", "lang")


def verdict(limits: Limits = Limits()) -> Column:
    """The kind of a described file, null for hand-written: marks first, then what names and shapes show."""
    code = F.col("lang").isin(CODE)
    uniform = (F.col("names") >= limits.least_names) & (F.col("name_diversity") <= limits.name_diversity * F.col("usual_diversity"))
    mangled = (F.col("mangled_share") >= limits.mangled_share) | F.coalesce(uniform, F.lit(False))
    minified = code & mangled & (F.col("mean_line") >= limits.dense_line)
    shaped = ~F.col("lang").isin(LISTS) & (F.col("template_share") >= limits.template_share)
    template = code & (F.col("lines") >= limits.least_lines) & (shaped | F.coalesce(uniform, F.lit(False)))
    data = code & (F.col("data_share") >= limits.data_share) & (F.col("chars") >= limits.least_chars)
    foreign = F.coalesce("foreign", F.lit(False))
    return (
        F.when(F.col("third_party") | foreign, "vendored")
        .when(minified | F.col("minified"), "minified")
        .when(F.col("generated"), "generated")
        .when(data & ~F.col("denied"), "data")
        .when(template & ~F.col("denied"), "generated")
    )


def find(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(repo_id, path, kind, mangled_share, mean_bits, name_diversity, template_share, data_share) of the files not
    written by hand.

    files: (repo_id, path, text). Empty and blank texts are judged by their path alone; an empty table gives an empty
    result. Files that aren't source code (data, documents) are judged by marks and path alone.
    """
    described = materialize(describe(files, limits), "described")
    usual = described.filter(F.col("names") >= 5).groupBy("lang").agg(F.percentile_approx("name_diversity", 0.5).alias("usual_diversity"))
    rows = described.join(F.broadcast(usual.filter(F.col("lang").isin(CODE))), "lang", "left")  # a row for each suffix of CODE
    rows = rows.join(styles(described, limits).withColumn("foreign", F.lit(True)), ["repo_id", "folder", "lang"], "left").withColumn("kind", verdict(limits))
    return rows.filter("kind is not null").select("repo_id", "path", "kind", "mangled_share", "mean_bits", "name_diversity", "template_share", "data_share")
