"""Credentials embedded in source code: a trigram index picks candidates, expressions verify them, values are masked.

Rules are regular expressions with a group for the value. Of each, the trigrams a text must hold are derived and
intersected on an index of every block of texts; the expression runs on the texts that remain (of a rule without any
trigram, on every text that holds the part which all its matches hold). What it finds is then
judged: values to be filled in, masked values, references, names, patterns and digests are no credentials.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .trigrams import Query, TrigramIndex, required

#: Characters of the texts of one index block in a worker.
BLOCK_CHARS = 1_000_000

#: Every expression runs in time linear in the text: what may be long is taken possessively, begins only where its run
#: begins, or stops at what a further match begins with.
_WORDS = (
    r"passw(?:or)?d|passwort|passphrase|pwd|secret|token|api[_\-]?key|credential|db[_\-]?pass|"
    r"auth[_\-]?key|encryption[_\-]?key|signing[_\-]?key|access[_\-]?key|private[_\-]?key|smtp[_\-]?pass"
)
#: A name, or the part of it after the last dot, that holds one of the words.
_NAME = rf"(?<![\w\-])(?=[\w\-]*?(?:{_WORDS}))[\w\-]++"
_QUOTED = r"(?:(?<!\\)(?:\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`))"
#: Between two literals that are joined.
_JOIN = r"\s*+(?:\+|\.\.?)\s*+"
#: Shapes of well-known kinds of keys: the prefix says what they are, wherever they stand.
_KEYS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|"
    r"xox[abprs]-[0-9]{6,}-[\w\-]{10,}|AIza[\w\-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}|"
    r"eyJ[\w\-]{8,}+\.eyJ[\w\-]{8,}+\.[\w\-]{16,}|sk-(?:ant-|proj-)?[A-Za-z0-9\-]{32,}|SG\.[\w\-]{16,}+\.[\w\-]{16,}|"
    r"shpat_[0-9a-f]{32}|dop_v1_[0-9a-f]{64}|hf_[A-Za-z0-9]{30,}|AGE-SECRET-KEY-[0-9A-Z]{50,}|pypi-AgE[\w\-]{50,}"
)

#: name -> (expression, case matters). The group "v" is the value, or where it begins.
RULES: dict[str, tuple[str, bool]] = {
    "private key": (r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)(?P<after>[^\n]{0,200}(?:\n[^\n]{0,200}){0,3})", True),
    "known key": (rf"(?<![A-Za-z0-9])(?P<v>{_KEYS})", True),
    "registry token": (r"_auth(?:Token)?\s*+=\s*+[\"']?(?P<v>[\w\-+/=.]{12,})", True),
    "url login": (r"(?<=[a-z0-9+.\-])://[^\s:/@\"'`]++:(?P<v>[^\s/@\"'`]{3,}+)@[\w\[]", False),
    "command login": (r"(?<![\w\-])(?:--user|--basic-auth|-u)[ =] *+[\"']?[^\s:/@\"'`]++:(?P<v>[^\s\"'`]{6,}+)", True),
    "authorization": (r"\b(?:Bearer|Basic|Token)\s++(?P<v>[A-Za-z0-9\-._~+/]{12,}={0,2})", True),
    "named value": (
        rf"(?P<name>{_NAME})[\"'`\])]{{0,3}}+(?:\s*+(?::(?:\s*+[\w.<>|\[\]?]++){{0,8}}\s*+=|:=|=>|==?|:|,)\s*+|\s++(?:(?:to|is|as)\s*+)?)(?:[bru]{{1,2}}(?=[\"']))?"
        rf"(?P<v>{_QUOTED}(?:\s*+(?:[+.]\s*+)?{_QUOTED})*+)",
        False,
    ),
    "bare value": (rf"(?P<name>{_NAME})[\"']?\s*+(?::=|=|:)[ \t]*+(?P<v>)(?=[^\s\"'`,;(){{}}\[\]<>])", False),
    "joined pieces": (rf"(?P<v>{_QUOTED}(?:{_JOIN}{_QUOTED})++)", True),
}
#: No trigram is required by "joined pieces"; every match holds the end of a literal, what joins, and the next one's begin.
_PARTS = {"joined pieces": re.compile(rf"[\"'`]{_JOIN}[\"'`]", re.ASCII)}
#: Values without quotes: the characters of one, words and a number after them, and what must follow.
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_BARE_WORDS = re.compile(r"[A-Za-z]++(?: [A-Za-z]++){1,6} \d++(?=[ \t]*+(?:$|[,;\n]|\*/|-->))", re.MULTILINE)
_BARE_END = re.compile(r"[ \t]*+(?:$|[,;\n]|\*/|-->)", re.MULTILINE)
#: A line that is a comment, and one that holds nothing but a name before its value.
_COMMENT_LINE = re.compile(r"\s*+(?:#|//|--|\*|/\*|<!--|;|%)")
_ALONE = re.compile(r"\s*+(?:export\s++|set\s++|-\s++)?[\"']?[\w.\-]++[\"']?\s*+[=:]\s*+")

_PLACEHOLDER = re.compile(
    r"<[^<>]*+>|\{\{|\$\{|\$\(|%\(|(?<![A-Za-z0-9])%s|\*{3,}|x{6,}|\.{3}|•{3,}|(?i:change[_\- ]?me|replace[_\- ]?(?:me|this)|placeholder|your[_\- ]|"
    r"example|dummy|redacted|masked|to[_\- ]?do\b|fixme|insert[_\- ]|fill[_\- ]?(?:me|in)|not[_\- ]?set|undefined|process\.env|os\.environ|getenv|vault[:.])"
)
_PATTERN = re.compile(r"\[[^\]\[\-]*+-[^\]\[]*+\]|\\[bdws]|\{\d++,?\d*+\}|\(\?|\.\*")
#: A path: parts that are words in one case each. Base 64 may begin with a slash as well.
_PATH_PART = r"(?>[a-z][a-z0-9_.\-]*|[A-Z][a-z]*(?:[A-Z][a-z]+)*|[A-Z_]+|\d+|[{:<%$~.][^/]*)"
_PATH = re.compile(rf"\.{{0,2}}/(?:{_PATH_PART}(?:/{_PATH_PART})*+/?)?")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?i:sha\d{1,3}|md5|blake\w*)[-:=].*")
_DIGEST_NAME = re.compile(r"(?i)(?:hash|digest|checksum|fingerprint|etag|sha\d+|md5|_id|uuid|[a-z]Id)\d*$")
_LABEL_NAME = re.compile(r"(?i)(?:label|kind|field|name|placeholder|hint|prompt|title|type|prefix|pattern|regex|_re|_rx)\d*$")
_HEX = re.compile(r"[0-9a-fA-F]+")
_PIECE = re.compile(_QUOTED)
_KEY = re.compile(_KEYS)


#: Lines of a private key, up to its end or to the next one.
_KEY_BODY = re.compile(r"(?:\\r|\\n|[A-Za-z0-9+/=\s:,\-\"'`#*])*?(?=-----END|-----BEGIN|\Z)")


class Found(NamedTuple):
    start: int
    rule: str
    spans: tuple[tuple[int, int], ...]  # of the value, to be masked


def plausible(value: str, name: str = "", strict: bool = False) -> bool:
    """Whether a literal under a credential's name is a value that would let someone in."""
    if len(value) < 8 or not re.search(r"\d", value) or not re.search(r"[A-Za-z]", value):
        return False
    if _PLACEHOLDER.search(value) or _PATTERN.search(value) or _UUID.fullmatch(value) or _DIGEST.fullmatch(value):
        return False
    if _HEX.fullmatch(value) and _DIGEST_NAME.search(name):
        return False
    if "://" in value or value.startswith(("$", "arn:")) or _PATH.fullmatch(value):
        return False
    mixed = bool(re.search(r"[A-Z]", value) and re.search(r"[a-z]", value))
    if _LABEL_NAME.search(name) and not (mixed and len(value) >= 12 and " " not in value):
        return False
    if strict and not mixed and not (_HEX.fullmatch(value) and len(value) >= 32) and not re.search(r"[^\w.\-/]", value):
        return False
    if re.fullmatch(r"[a-z]+(?:[/_.\-][a-z]+)*\d{0,2}", value):  # a path, an option, an identifier
        return False
    return True


def _pieces(text: str, start: int, end: int) -> tuple[str, tuple[tuple[int, int], ...]]:
    """The joined contents of the quoted literals in text[start:end], and where they stand."""
    spans = tuple((m.start() + 1, m.end() - 1) for m in _PIECE.finditer(text, start, end))
    return "".join(text[a:b] for a, b in spans), spans


def _spread(spans: tuple[tuple[int, int], ...], lo: int, hi: int) -> tuple[tuple[int, int], ...]:
    """The part [lo, hi) of the joined pieces, as places in the text."""
    out, at = [], 0
    for a, b in spans:
        x, y = max(lo, at), min(hi, at + b - a)
        if x < y:
            out.append((a + x - at, a + y - at))
        at += b - a
    return tuple(out)


def _bare_run(text: str, at: int) -> tuple[int, int]:
    """(end of the run of characters of a value without quotes, end of the value that ends in it or 0 if what follows
    isn't what follows a value)."""
    m = _BARE.match(text, at)
    end = m.end() if m else at
    if _BARE_END.match(text, end):
        return end, end
    if text.startswith(">", end) and text.endswith("--", at, end):
        return end, end - 2
    return end, max(0, text.rfind("*/", at, end))


def verify(rule: str, expression: re.Pattern, text: str) -> Iterator[Found]:
    run_end = value_end = until = begin = before = 0
    for m in expression.finditer(text):
        start, end = m.span("v")
        if rule == "bare value":
            if m.start() < until:
                continue
            if start >= run_end:  # a run is read once, however many names it holds
                run_end, value_end = _bare_run(text, start)
            words = None if value_end - start >= 8 else _BARE_WORDS.match(text, start)
            if value_end - start < 8 and not words:
                continue
            until = end = words.end() if words else value_end
            broken = text.rfind("\n", before, m.start())
            begin, before = (broken + 1 if broken >= 0 else begin), m.start()
        value = text[start:end]
        if rule == "private key":
            after = m["after"].replace("\\r", "").replace("\\n", "\n").strip("\"'` \t\r\n+,;\\#/*-")
            if after and not re.match(r"[A-Za-z0-9+/=]{16,}|Proc-Type|DEK-Info|Version:|Comment:", after):
                continue
            body = _KEY_BODY.match(text, end)
            yield Found(start, rule, ((end, body.end()),) if body and body.end() > end else ())
        elif rule == "known key":
            if not _PLACEHOLDER.search(value) and not _PATTERN.match(text, end) and len(set(value)) > 8:
                yield Found(start, rule, ((start, end),))
        elif rule == "registry token":
            if not _PLACEHOLDER.search(value) and re.search(r"\d", value):
                yield Found(start, rule, ((start, end),))
        elif rule == "url login":
            if not _PLACEHOLDER.search(value) and not re.fullmatch(r"\$\w+|[a-z]+|[A-Z_]+|\d{1,5}|\{.*\}|%[sd]|\*+", value):
                yield Found(m.start(), rule, ((start, end),))  # on the line of the scheme before it
        elif rule == "command login":
            if re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not _PLACEHOLDER.search(value) and not re.fullmatch(r"\$\w+|[a-z]+\d{0,2}", value):
                yield Found(start, rule, ((start, end),))
        elif rule == "authorization":
            kind = text[m.start() : m.start() + 5]
            good = re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not _PLACEHOLDER.search(value)
            if good and kind == "Basic":
                try:
                    good = b":" in base64.b64decode(value + "=" * (-len(value) % 4))
                except ValueError:
                    good = False
            elif good:
                good = len(value) >= 16 and not re.fullmatch(r"[a-z]+(?:[._\-/][a-z0-9]+)*", value)
            if good:
                yield Found(start, rule, ((start, end),))
        elif rule in ("named value", "joined pieces"):
            joined, spans = _pieces(text, start, end)
            key = _KEY.search(joined)
            if key:
                where = _spread(spans, *key.span())
                yield Found(where[0][0], rule, where)
            elif rule == "named value" and plausible(joined, m["name"]):
                yield Found(spans[0][0], rule, spans)
        elif rule == "bare value":
            alone = " " not in value and _ALONE.fullmatch(text, begin, start)
            if (alone or _COMMENT_LINE.match(text, begin, start)) and not re.search(r"\w\.\w++\.\w|[*+]\w", value) and plausible(value, m["name"], strict=True):
                yield Found(start, rule, ((start, end),))


def compiled() -> dict[str, re.Pattern]:
    return {name: re.compile(p, re.ASCII | re.MULTILINE | (0 if case else re.IGNORECASE)) for name, (p, case) in RULES.items()}


def build_index() -> TrigramIndex:
    return TrigramIndex({name: required(p) for name, (p, _) in RULES.items()})


def scan(texts: list[str], index: TrigramIndex, expressions: dict[str, re.Pattern]) -> dict[int, list[Found]]:
    """What is found in a block of texts, by the number of the text."""
    found: dict[int, list[Found]] = {}
    for rule, numbers in index.candidates([t.encode() for t in texts]).items():
        part = _PARTS.get(rule)
        for i in numbers.tolist():
            if part and not part.search(texts[i]):
                continue
            hits = list(verify(rule, expressions[rule], texts[i]))
            if hits:
                found.setdefault(i, []).extend(hits)
    return found


def line_numbers(text: str, found: list[Found]) -> list[int]:
    """The distinct lines, from 0, on which something is found; the text is gone through once."""
    out, at, line = [], 0, 0
    for start in sorted({f.start for f in found}):
        line += text.count("\n", at, start)
        at = start
        if not out or out[-1] != line:
            out.append(line)
    return out


def mask(text: str, found: list[Found]) -> str:
    """Every value's characters but line breaks become '*'; everything else stays where it was."""
    chars = list(text)
    for f in found:
        for a, b in f.spans:
            chars[a:b] = ["\n" if c == "\n" else "\r" if c == "\r" else "*" for c in chars[a:b]]
    return "".join(chars)


def _run(df: DataFrame, redact: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, expressions = build_index(), compiled()
        for batch in batches:
            ids, starts, texts = (batch.column(i).to_pylist() for i in range(3))
            first = 0
            while first < len(texts):
                last, n = first, 0
                while last < len(texts) and n < BLOCK_CHARS:
                    n += len(texts[last])
                    last += 1
                out: list[tuple] = []
                for i, hits in scan(texts[first:last], index, expressions).items():
                    text = texts[first + i]
                    if redact:
                        out.append((ids[first + i], len(line_numbers(text, hits)), mask(text, hits)))
                    else:
                        out += [(ids[first + i], starts[first + i] + line) for line in line_numbers(text, hits)]
                first = last
                cols = list(zip(*out)) if out else [()] * (3 if redact else 2)
                kinds = [pa.string(), pa.int64(), pa.string()] if redact else [pa.string(), pa.int64()]
                names = ["chunk_id", "n_found", "content"] if redact else ["chunk_id", "line_no"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "chunk_id string, n_found long, content string" if redact else "chunk_id string, line_no long"
    return df.mapInArrow(work, schema)


def stored_index(chunks: DataFrame) -> DataFrame:
    """(block, trigram, bitmap, ids): postings of the trigrams that the rules need over blocks of chunks, written as a
    table. Bit i of a bitmap stands for the block's chunk i; the row without a trigram holds the chunks' ids.

    `find` and `redact` make the same postings of each block where its texts lie and drop them, since a stored index
    could only send them back to all texts of its candidates; this table is for asking again without the texts.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = build_index(), TaskContext.get().partitionId() << 33
        grams = sorted(index.number, key=index.number.get)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            first = 0
            while first < len(texts):
                last, n = first, 0
                while last < len(texts) and n < BLOCK_CHARS:
                    n += len(texts[last])
                    last += 1
                bits = index.postings([t.encode() for t in texts[first:last]])
                held = np.flatnonzero(bits.any(axis=1)).tolist()
                packed = np.packbits(bits, axis=1)
                cols = [[number] * (len(held) + 1), [None, *[grams[i] for i in held]], [None, *[packed[i].tobytes() for i in held]], [ids[first:last], *[None] * len(held)]]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "trigram", "bitmap", "ids"])
                first, number = last, number + 1

    return materialize(_rows(chunks).mapInArrow(build, "block long, trigram binary, bitmap binary, ids array<string>"), "trigrams")


def candidates(index: DataFrame, queries: dict[str, Query] | None = None) -> DataFrame:
    """(chunk_id, rule): the chunks that may match each rule, by intersecting a stored index's postings; no text is read."""
    asked = queries if queries is not None else build_index().queries

    def intersect(rows: pd.DataFrame) -> pd.DataFrame:
        ids = next(x for x in rows["ids"] if x is not None)
        held = {bytes(g): np.unpackbits(np.frombuffer(b, np.uint8), count=len(ids)).astype(bool) for g, b in zip(rows["trigram"], rows["bitmap"]) if g is not None}
        none = np.zeros(len(ids), bool)
        out = []
        for rule, query in asked.items():
            keep = np.ones(len(ids), bool)
            for alternatives in query:
                keep &= np.any([np.all([held.get(g, none) for g in grams], axis=0) if grams else ~none for grams in alternatives], axis=0)
            out += [(ids[i], rule) for i in np.flatnonzero(keep)]
        return pd.DataFrame(out, columns=["chunk_id", "rule"])

    return index.groupBy("block").applyInPandas(intersect, "chunk_id string, rule string").distinct()


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col("start_line").cast("long"), F.lit(1)).alias("start"), F.col("content").cast("string").alias("content")).filter((F.length("content") > 0) & F.col("chunk_id").isNotNull())


def find(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no), distinct: every line of every chunk on which a credential starts, as a line of the file.

    Null and empty contents and null ids give nothing; a null start_line counts as 1; repeated rows count once.
    """
    return _run(_rows(chunks), redact=False).distinct()


def redact(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_found, content) of the chunks that hold a credential: lines found, and the content with the values masked."""
    return _run(_rows(chunks), redact=True).dropDuplicates(["chunk_id", "content"])
