"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is never handled as a whole: it is cut into byte ranges, and each range with a halo on both sides is one row.
Every range begins with a forced cut, the best boundary among its first bytes, which its neighbour finds from its halo as
well; between two forced cuts a range places its cuts alone. So ranges need no order among them and the result doesn't
depend on where they run. Line numbers come from a prefix sum of the ranges' line breaks. Texts come from a column, or
from files of which workers read only their ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Plan(NamedTuple):
    limit: int = 6000  # bytes of a piece at most, the repeated ones included
    overlap: int = 200  # bytes of the piece before that are repeated, at most
    range: int = 1 << 16  # bytes of a range
    look: int = 256  # bytes of context that boundaries are recognized by


#: A cut may stand at the end of a match. The earlier kind is preferred.
BOUNDARIES: list[tuple[str, re.Pattern[bytes]]] = [
    (
        "declaration",
        re.compile(
            rb"(?:\A|\n)(?=[ \t]{0,4}(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub|unsafe|const|inline|virtual|override|declare)\s+)*"
            rb"(?:def|class|func|function|fn|interface|enum|struct|trait|impl|record|module|namespace|package|type|CREATE|create|INSERT|SELECT|WITH)\b[ \t(]|"
            rb"(?:public|private|protected)\b[^\n;={]*[({]|"
            rb"@\w+[^\n]*\n[ \t]{0,4}(?:def|class|async|public|private)|#{1,6} |\[[\w.\-\"\[]+\]|---[ \t]*\n|[A-Za-z_]\w*:[ \t]*\n)"
        ),
    ),
    ("paragraph", re.compile(rb"\n[ \t\r]*\n+")),
    ("line", re.compile(rb"\n")),
    ("sentence", re.compile(rb"(?:[.!?;]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\"')\]]*[ \t]+|\xe3\x80\x82")),
    ("word", re.compile(rb"[ \t]+")),
]


def _char_start(data: bytes, at: int, low: int) -> int:
    """at, or the nearest place before it where a character begins."""
    while at > low and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def best_cut(data: bytes, low: int, high: int, look: int) -> tuple[int, str]:
    """The last boundary of the most preferred kind in (low, high], else the last place between characters."""
    for kind, pattern in BOUNDARIES:
        found = -1
        for m in pattern.finditer(data, max(0, low - look), min(len(data), high + look)):
            if m.end() > high:
                break
            if m.end() > low:
                found = m.end()
        if found > 0:
            return found, kind
    return max(_char_start(data, high, low), low + 1), "character"


def _repeat_from(data: bytes, cut: int, low: int, overlap: int) -> int:
    """Where the next piece begins: within `overlap` bytes before the cut, at a line, a word or a character."""
    start = max(low, cut - overlap)
    for mark in (b"\n", b" "):
        at = data.find(mark, max(start - 1, 0), cut - 1)
        if at >= 0 and at + 1 >= start:
            return at + 1
    while start < cut and data[start] & 0xC0 == 0x80:
        start += 1
    return start


def first_cut(data: bytes, at: int, plan: Plan) -> int:
    """The forced cut of the range that begins at `at` in data; 0 for the first."""
    if at == 0:
        return 0
    half = min(len(data), at + plan.limit // 2)
    return best_cut(data, at, half, plan.look)[0] if half < len(data) else len(data)


def cuts(data: bytes, begin: int, end: int, last: bool, plan: Plan) -> list[tuple[int, int, str]]:
    """(start, stop, kind of the boundary at stop) of the pieces of the range that begins at `begin` of data and whose
    successor begins at `end`; `last` if there is none."""
    start = first_cut(data, begin, plan)
    stop_all = len(data) if last else first_cut(data, end, plan)
    out = []
    cut = start
    from_ = start if start == 0 else _repeat_from(data, start, max(0, start - plan.overlap), plan.overlap)
    while cut < stop_all:
        if stop_all - from_ <= plan.limit:
            out.append((from_, stop_all, "end" if last else "range"))
            break
        low = max(cut, from_ + plan.limit // 8)
        cut, kind = best_cut(data, low, from_ + plan.limit, plan.look)
        out.append((from_, cut, kind))
        from_ = _repeat_from(data, cut, from_ + 1, plan.overlap)
    return out


_SCHEMA = "id string, mark long, range_no long, breaks long, piece long, start_byte long, end_byte long, line long, lines long, boundary string, text string"


def _emit(rows: Iterator[tuple[str, int, int, int, int, bytes]], plan: Plan) -> Iterator[pa.RecordBatch]:
    """rows: (id, hash of the text, range number, size of the text, offset of data in the text, data with its halo)."""
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _SCHEMA.split(", ")]
    out: list[tuple] = []
    for key, mark, number, size, offset, data in rows:
        begin = number * plan.range
        end = min(size, begin + plan.range)
        own = data[begin - offset : end - offset]
        head = data.count(b"\n", 0, begin - offset)
        made = cuts(data, begin - offset, end - offset, end >= size, plan) if begin - offset or number == 0 else []
        for k, (a, b, kind) in enumerate(made):
            piece = data[a:b]
            line = data.count(b"\n", 0, a) - head
            out.append((key, mark, number, own.count(b"\n"), k, a + offset, b + offset, line, max(0, piece.count(b"\n") - piece.endswith(b"\n")), kind, piece.decode("utf-8", "replace")))
        if not made:
            out.append((key, mark, number, own.count(b"\n"), None, None, None, None, None, None, None))
        if len(out) >= 256:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Lines and numbers of pieces in the whole text, by prefix sums over the ranges. Of texts under one id that of the
    least hash counts, and of its repeated rows one: only numbers are compared for that, pieces are shuffled once."""
    by_range = pieces.groupBy("id", "mark", "range_no").agg(F.max("breaks").alias("breaks"), F.coalesce(F.max("piece") + 1, F.lit(0)).alias("n"))
    of_id = Window.partitionBy("id")
    chosen = by_range.withColumn("least", F.min("mark").over(of_id)).filter(F.col("mark") == F.col("least"))
    before = of_id.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = chosen.select("id", "mark", "range_no", F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pieces_before"))
    rows = pieces.filter(F.col("piece").isNotNull()).join(sums, ["id", "mark", "range_no"]).dropDuplicates(["id", "mark", "range_no", "piece"])
    first = F.col("lines_before") + F.col("line")
    return rows.select("id", (F.col("pieces_before") + F.col("piece")).alias("piece_no"), "start_byte", "end_byte", first.alias("first_line"), (first + F.col("lines")).alias("last_line"), "boundary", "text")


def split_texts(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Pieces of the texts longer than plan.limit bytes: (id, piece_no, start_byte, end_byte, first_line, last_line from 0,
    boundary, text). Every piece is at most plan.limit bytes, and without their repeated heads the pieces are the text.

    rows: (id string, text). Null, empty and short texts and null ids give nothing; rows repeated with their id count
    once, and of different texts under one id one counts. A text isn't shuffled, only its pieces are.
    """
    long = rows.select("id", F.encode("text", "UTF-8").alias("data")).filter(F.col("id").isNotNull() & (F.octet_length("data") > plan.limit))
    size = F.octet_length("data").cast("long")
    ranges = long.withColumn("size", size).withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / plan.range))))
    halo = plan.look + plan.overlap + 4
    offset = F.greatest(F.lit(0).cast("long"), F.col("no") * plan.range - halo)
    part = F.substring("data", (offset + 1).cast("int"), (F.col("no") * plan.range - offset + F.lit(plan.range + plan.limit + plan.look)).cast("int"))
    table = ranges.select("id", F.xxhash64("data").alias("mark"), "no", "size", offset.alias("offset"), part.alias("part"))
    pieces = table.mapInArrow(lambda batches: _emit((tuple(r.values()) for b in batches for r in b.to_pylist()), plan), _SCHEMA)
    return _numbered(pieces)


def split_files(paths: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The same for files: paths: (path) of UTF-8 files as URIs. Workers read only the ranges they split."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [fs.FileSystem.from_uri(n) for n in names]
            yield pa.record_batch([pa.array(names), pa.array([f.get_file_info(p).size for f, p in found], pa.int64())], ["id", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        halo = plan.look + plan.overlap + 4
        for batch in batches:
            for r in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(r["id"])
                offset = max(0, r["no"] * plan.range - halo)
                with files.open_input_file(path) as f:
                    f.seek(offset)
                    yield r["id"], 0, r["no"], r["size"], offset, f.read(r["no"] * plan.range - offset + plan.range + plan.limit + plan.look)

    known = paths.select(F.col("path").alias("id")).filter("id is not null").distinct().mapInArrow(sizes, "id string, size long").filter(F.col("size") > plan.limit)
    ranges = known.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / plan.range)))).repartition("id", "no")
    return _numbered(ranges.select("id", "no", "size").mapInArrow(lambda b: _emit(read(b), plan), _SCHEMA))
