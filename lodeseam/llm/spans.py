"""Long exact spans shared between records, by fixed-block anchors.

A span of at least `min_chars` characters that stands in two texts contains, in the first, a whole block of half that
length at a multiple of it (blocks don't overlap), with at least a quarter of the length on one side of it. So every text
indexes, for each of its blocks, the two windows of three quarters that begin or end with the block's ends; every text
probes the index with its window at every position (hashes of all positions at once, by prefix sums modulo 2**64); and
every hit is extended to the maximal exact repeat.

Equal texts are one class, searched once. The rolling windows are filtered by a bitmap of the index before anything is
shuffled. The bitmap lies in pieces by hash range in the shared folder; a worker holds at most HELD bytes of it and takes
a large bitmap range by range, so the same method runs at every size.

Anchors that stand in few places are joined in pairs and extended on the two texts. Anchors of boilerplate and of runs
(more than HOT places) are never paired: every text that holds one gives the windows of `min_chars` around it, windows of
equal hash make a passage, and a passage is kept as its set of texts. Of neighbouring windows only those count whose set
no neighbour's contains, so a passage of many windows in many texts is a few sets, however the texts cut it off.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, materialize, shared_dir, tracked

MIN_CHARS = 300
#: Bits of the bitmap for each indexed window (each sets PLACES of them: 0.2 % of other windows pass); bits of a piece at
#: least, pieces at most, and bytes of pieces that a worker holds.
BITS_EACH, PLACES, PIECE_BITS, PIECES, HELD = 16, 4, 1 << 20, 4096, 64 << 20
#: Places of an anchor up to which they are joined in pairs.
HOT = 32
#: Characters hashed at once in a worker; longer texts are hashed alone. More at once where the bitmap isn't held whole.
BATCH_CHARS, WIDE_CHARS = 500_000, 16_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def window_hashes(cps: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` code points: the difference of two prefix sums, brought to the power 0."""
    n = len(cps)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(cps.astype(np.uint64) + np.uint64(1)) * _powers(n, _MUL), out=prefix[1:])
        return _mix((prefix[width:] - prefix[:-width]) * _powers(n - width + 1, _INV))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _batches(ids: list[int], texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, start of each text, code points of all) for texts of about `chars` characters together."""
    at, n, first = [0], 0, 0
    for i, text in enumerate(texts):
        n += len(text)
        at.append(n)
        if n >= chars or i == len(texts) - 1:
            yield np.array(ids[first : i + 1]), np.array(at), code_points("".join(texts[first : i + 1]))
            at, n, first = [0], 0, i + 1


def _rows(doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int32))], ["h", "doc", "pos"])


_ROWS = "h long, doc long, pos int"


def _sizes(min_chars: int) -> tuple[int, int]:
    """(block, window)."""
    block = min_chars // 2
    return block, min_chars - (block + 1) // 2


def indexed(texts: DataFrame, min_chars: int) -> DataFrame:
    """Of every text's non-overlapping blocks, the windows that begin at the block's start or end at its end."""
    block, width = _sizes(min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, at, cps in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = window_hashes(cps, width)
                docs, poss = [], []
                for d, lo, hi in zip(ids, at[:-1], at[1:]):
                    if hi - lo < min_chars:
                        continue
                    starts = np.arange(0, hi - lo - block + 1, block)
                    pos = np.concatenate([starts, starts - (width - block)])
                    pos = pos[(pos >= 0) & (pos + width <= hi - lo)]
                    docs.append(np.full(len(pos), d))
                    poss.append(pos + lo)
                if docs:
                    doc, pos = np.concatenate(docs), np.concatenate(poss)
                    yield _rows(doc, pos - at[np.searchsorted(at, pos, side="right") - 1], h[pos])

    return texts.mapInArrow(run, _ROWS)


class Bitmap(NamedTuple):
    """Where the pieces of the index's bitmap lie; a window's bits are all in the piece of its hash's range."""

    folder: str
    pieces: int
    bits: int  # of a piece

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(9 * k)) & np.uint64(self.bits - 1)).astype(np.int64) for k in range(PLACES)]

    def piece_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.pieces.bit_length() + 1)).astype(np.int64) if self.pieces > 1 else np.zeros(len(h), np.int64)

    def read(self, piece: int) -> np.ndarray:
        files, path = fs.FileSystem.from_uri(self.folder)
        if files.get_file_info(f"{path}/{piece}").type == fs.FileType.NotFound:
            return np.zeros(self.bits // 8, np.uint8)  # nothing is indexed in this range
        with files.open_input_stream(f"{path}/{piece}") as f:
            return np.frombuffer(f.read(), np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the hashes all of whose bits are set, in order."""
        piece = self.piece_of(h)
        if self.pieces * self.bits // 8 <= HELD:
            return self._in(np.arange(len(h)), h, _whole_bitmap(self), piece * (self.bits // 8))
        order = np.argsort(piece, kind="stable")
        edges = np.searchsorted(piece[order], np.arange(self.pieces + 1))
        found = [self._in(order[a:b], h, self.read(n)) for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def _in(self, at: np.ndarray, h: np.ndarray, bitmap: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        for k in range(PLACES):
            place = ((h[at] >> np.uint64(9 * k)) & np.uint64(self.bits - 1)).astype(np.int64)
            byte = (place >> 3) if base is None else base[at] + (place >> 3)
            at = at[(bitmap[byte] & (np.uint8(128) >> (place & 7).astype(np.uint8))) > 0]
        return at


@functools.lru_cache(maxsize=1)
def _whole_bitmap(bitmap: Bitmap) -> np.ndarray:
    """All pieces, once in a worker process."""
    return np.concatenate([bitmap.read(n) for n in range(bitmap.pieces)])


def write_bitmap(index: DataFrame, n_chars: int, min_chars: int) -> Bitmap:
    """The bitmap of the index's hashes, set in parallel: a file for each range of hashes, in the shared folder."""
    spark = index.sparkSession
    bits = 1 << max(10, (BITS_EACH * 2 * (n_chars // (min_chars // 2) + 1)).bit_length())
    pieces = max(1, min(PIECES, bits // PIECE_BITS))
    bitmap = Bitmap(tracked(spark, f"{shared_dir(spark)}/lodeseam/bitmap-{uuid.uuid4().hex}"), pieces, bits // pieces)
    files, path = fs.FileSystem.from_uri(bitmap.folder)
    files.create_dir(path, recursive=True)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["piece"].iloc[0])
        flags = np.zeros(bitmap.bits, np.uint8)
        for place in bitmap.places(rows["h"].to_numpy().view(np.uint64)):
            flags[place] = 1
        out, at = fs.FileSystem.from_uri(bitmap.folder)
        part = f"{at}/.{number}-{uuid.uuid4().hex}"
        with out.open_output_stream(part) as f:
            f.write(np.packbits(flags).tobytes())
        out.move(part, f"{at}/{number}")
        return pd.DataFrame({"piece": [number]})

    piece = F.shiftrightunsigned("h", 64 - pieces.bit_length() + 1) if pieces > 1 else F.lit(0).cast("long")
    index.select("h").distinct().select(piece.alias("piece"), "h").groupBy("piece").applyInPandas(build, "piece long").count()
    return bitmap


def probes(texts: DataFrame, min_chars: int, bitmap: Bitmap) -> DataFrame:
    """Every rolling window whose bits are set, but for those that the text itself has in the index."""
    block, width = _sizes(min_chars)
    chars = BATCH_CHARS if bitmap.pieces * bitmap.bits // 8 <= HELD else WIDE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, at, cps in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), chars):
                h = window_hashes(cps, width)
                pos = bitmap.test(h)
                which = np.searchsorted(at, pos, side="right") - 1
                own = pos - at[which]
                size = at[which + 1] - at[which]
                indexed_ = ((own % block == 0) & (own + block <= size)) | ((own + width) % block == 0)
                keep = (own + width <= size) & ~(indexed_ & (size >= min_chars))
                pos, which = pos[keep], which[keep]
                yield _rows(ids[which], pos - at[which], h[pos])

    return texts.mapInArrow(run, _ROWS)


def windows(texts: DataFrame, min_chars: int) -> DataFrame:
    """(w, doc, start, first, nxt, prv): the windows of `min_chars` that hold one of the text's anchors.

    texts: (key, text, places) with the places of its anchors. w is the window's hash, nxt and prv those of the windows
    one further and one before (null where those hold no anchor), first whether w stands here first in the text.
    """
    _, width = _sizes(min_chars)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = window_hashes(code_points(text), min_chars).view(np.int64)
                at = np.array(places, np.int64)
                edge = np.zeros(len(h) + 1, np.int32)
                np.add.at(edge, np.maximum(at - (min_chars - width), 0), 1)
                np.add.at(edge, np.minimum(at + 1, len(h)), -1)
                inside = np.cumsum(edge[:-1]) > 0
                start = np.flatnonzero(inside)
                w = h[start]
                first = np.zeros(len(w), bool)
                first[np.unique(w, return_index=True)[1]] = True
                follows = np.append(start[1:] == start[:-1] + 1, False)
                nxt = pa.array(np.append(w[1:], 0)[: len(w)], mask=~follows)
                prv = pa.array(np.append(0, w[:-1])[: len(w)], mask=~np.append(False, follows[:-1])[: len(w)])
                cols = [np.full(len(w), key), w, start.astype(np.int32), first]
                yield pa.record_batch([pa.array(cols[1]), pa.array(cols[0], kinds[1]), pa.array(cols[2]), pa.array(cols[3]), nxt, prv], ["w", "doc", "start", "first", "nxt", "prv"])

    return texts.mapInArrow(run, "w long, doc long, start int, first boolean, nxt long, prv long")


def passage_sets(found: DataFrame) -> DataFrame:
    """(w, doc): the sets of texts that share a window, of the windows whose set no neighbour's contains.

    If all places of a window go on alike, its set is contained in the next window's, which stands for it; if all are
    preceded alike by a window of more texts, in that one's. Every place of a run of windows has a last one, so the
    windows that stand for others exist.
    """
    alike = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    sets = found.groupBy("w").agg(F.count_if("first").alias("n"), alike("nxt").alias("nxt"), alike("prv").alias("prv")).filter("n > 1")
    sets = materialize(sets, "sets")
    before = sets.select(F.col("w").alias("prv"), F.col("n").alias("n_prv"))
    kept = sets.filter("nxt is null").join(before, "prv", "left").filter("n_prv is null or n_prv <= n").select("w")
    return found.filter("first").select("w", "doc").join(broadcast_if_small(materialize(kept, "kept")), "w", "left_semi")


def _extend(a: str, b: str, shift: int, min_chars: int) -> list[tuple[int, int]]:
    """The maximal equal runs of at least min_chars on the diagonal pos_a - pos_b = shift: (start in a, length)."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < min_chars:
        return []
    equal = code_points(a[lo:hi]) == code_points(b[lo - shift : hi - shift])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    return [(lo + int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= min_chars]


def classes(docs: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, text, rep) of texts long enough to hold a span; equal texts share the least key as rep.

    Equal texts are found by two independent 64-bit hashes and the length, so that no text is shuffled.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter(F.col("key").isNotNull() & (F.length("text") >= min_chars))
    marks = rows.select("key", F.xxhash64("text").alias("h1"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("h2"), F.length("text").alias("n"))
    reps = materialize(marks.groupBy("h1", "h2", "n").agg(F.min("key").alias("rep")), "reps")
    return materialize(marks.join(reps, ["h1", "h2", "n"]).select("key", "rep").distinct(), "classes")


class Shared(NamedTuple):
    """What texts share. spans: (doc_a, doc_b, start_a, start_b, length), maximal exact repeats of class representatives,
    doc_a < doc_b. passages: (w, doc), sets of representatives that share a span. regions: (doc, start, length), where a
    representative's text is shared in a passage. members: (key, rep) of all texts that are long enough."""

    spans: DataFrame
    passages: DataFrame
    regions: DataFrame
    members: DataFrame


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, hot: int = HOT) -> Shared:
    """All spans of at least min_chars code points that stand in more than one text.

    Null, empty and shorter texts hold no span; a text repeated under several keys is one class; rows repeated with their
    key count once; an empty table gives empty results; other columns are ignored. Runs of few characters and passages of
    many texts cost time in proportion to their characters.
    """
    members = classes(docs, key, text, min_chars)
    reps = members.filter(F.col("key") == F.col("rep")).select("key")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).filter(F.length("text") >= min_chars)
    unique = texts.join(broadcast_if_small(reps), "key", "left_semi")
    n_chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    index = materialize(indexed(unique, min_chars).dropDuplicates(["doc", "pos"]), "index")
    hits = index.unionByName(materialize(probes(unique, min_chars, write_bitmap(index, n_chars, min_chars)).dropDuplicates(["doc", "pos"]), "probes"))
    places = materialize(hits.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > hot).alias("often")), "places")
    often = broadcast_if_small(places.filter("often").select("h"))
    few = broadcast_if_small(places.filter("not often").select("h"))
    # few places: pairs, extended on the texts
    a = index.join(few, "h", "left_semi").select("h", F.col("doc").alias("doc_i"), F.col("pos").alias("pos_i"))
    b = hits.join(few, "h", "left_semi").select("h", F.col("doc").alias("doc_p"), F.col("pos").alias("pos_p"))
    low = F.col("doc_i") < F.col("doc_p")
    shift = F.when(low, F.col("pos_i") - F.col("pos_p")).otherwise(F.col("pos_p") - F.col("pos_i"))
    pairs = a.join(b, "h").filter(F.col("doc_i") != F.col("doc_p")).select(F.least("doc_i", "doc_p").alias("doc_a"), F.greatest("doc_i", "doc_p").alias("doc_b"), shift.alias("shift"))
    pairs = materialize(pairs.groupBy("doc_a", "doc_b").agg(F.collect_set("shift").alias("shifts")), "pairs")
    needed = broadcast_if_small(materialize(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("key")).distinct(), "needed"))
    found = texts.join(needed, "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(found.select(F.col("key").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(found.select(F.col("key").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, shifts, ta, tb in batch[["doc_a", "doc_b", "shifts", "text_a", "text_b"]].itertuples(index=False):
                out += [(x, y, s, s - int(d), n) for d in shifts for s, n in _extend(ta, tb, int(d), min_chars)]
            yield pd.DataFrame(out, columns=["doc_a", "doc_b", "start_a", "start_b", "length"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_a", "doc_b", "start_a", "start_b", "length")])
    # many places: windows around them, on each text alone
    where = materialize(hits.join(often, "h", "left_semi").groupBy(F.col("doc").alias("key")).agg(F.collect_list("pos").alias("places")), "where")
    around = materialize(windows(unique.join(where, "key").dropDuplicates(["key"]).select("key", "text", "places"), min_chars), "windows")
    shared = around.join(around.groupBy("w").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x < y").select("w"), "w", "left_semi")
    return Shared(both.mapInPandas(verify, schema), passage_sets(around), islands(shared, min_chars), members)


def islands(starts: DataFrame, min_chars: int) -> DataFrame:
    """(doc, start, length) of the regions that windows of min_chars beginning at (doc, start) cover, neighbouring ones as one."""
    order = Window.partitionBy("doc").orderBy("start")
    run = starts.select("doc", "start").withColumn("run", F.col("start") - F.row_number().over(order))
    return run.groupBy("doc", "run").agg(F.min("start").cast("long").alias("start"), (F.count("*") + min_chars - 1).alias("length")).drop("run")


def document_pairs(shared: Shared) -> DataFrame:
    """(doc_a, doc_b), smaller first, of all documents that share a span: classes paired by spans or in a passage's set,
    and members of a class. As many rows as the question asks for."""
    own = shared.passages.select("w", F.col("doc").alias("doc_a"))
    paired = own.join(shared.passages.select("w", F.col("doc").alias("doc_b")), "w").filter("doc_a < doc_b").select("doc_a", "doc_b")
    reps = shared.spans.select("doc_a", "doc_b").unionByName(paired).distinct()
    members = shared.members
    left, right = members.select(F.col("key").alias("x"), F.col("rep").alias("doc_a")), members.select(F.col("key").alias("y"), F.col("rep").alias("doc_b"))
    across = reps.join(left, "doc_a").join(right, "doc_b").select("x", "y")
    copies = members.filter(F.col("key") != F.col("rep")).select("rep").distinct()
    alike = members.join(copies, "rep", "left_semi").select("rep", F.col("key").alias("x"))
    within = alike.join(alike.select("rep", F.col("x").alias("y")), "rep").filter(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def links(shared: Shared) -> DataFrame:
    """(rep, shares_with): with how many other classes each representative shares a span. Representatives in the same
    passages are counted together as a profile, so a passage's texts aren't paired."""
    profiles = shared.passages.groupBy("doc").agg(F.xxhash64(F.array_sort(F.collect_set("w"))).alias("profile"))
    profiles = materialize(profiles, "profiles")
    held = materialize(shared.passages.join(profiles, "doc").select("profile", "w").distinct(), "held")
    linked = materialize(held.join(held.select("w", F.col("profile").alias("other")), "w").select("profile", "other").distinct(), "linked")
    sizes = profiles.groupBy(F.col("profile").alias("other")).agg(F.count("*").alias("n"))
    many = linked.join(sizes, "other").groupBy("profile").agg((F.sum("n") - 1).alias("n")).join(profiles, "profile").select(F.col("doc").alias("rep"), "n")
    p, q = profiles.select(F.col("doc").alias("doc_a"), "profile"), profiles.select(F.col("doc").alias("doc_b"), F.col("profile").alias("other"))
    few = shared.spans.select("doc_a", "doc_b").distinct().join(p, "doc_a", "left").join(q, "doc_b", "left").join(linked, ["profile", "other"], "left_anti")
    few = few.select(F.explode(F.array("doc_a", "doc_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    return many.unionByName(few).groupBy("rep").agg(F.sum("n").alias("shares_with"))


def shared_fraction(docs: DataFrame, shared: Shared, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document with any text: its length, the characters that lie in a span shared with another document, their
    share, and the number of other texts it shares with. A text with copies under other keys is shared whole."""
    shared = shared._replace(spans=materialize(shared.spans, "spans"), passages=materialize(shared.passages, "passages"))
    ends = [shared.spans.select(F.col(f"doc_{c}").alias("rep"), F.col(f"start_{c}").alias("start"), "length") for c in "ab"]
    both = ends[0].unionByName(ends[1]).unionByName(shared.regions.withColumnRenamed("doc", "rep"))
    order = Window.partitionBy("rep").orderBy("start")
    seen = F.coalesce(F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), seen))
    covered = both.groupBy("rep", "start").agg(F.max("length").alias("length"))
    covered = covered.withColumn("new", new).groupBy("rep").agg(F.sum("new").alias("covered"))
    copies = shared.members.groupBy("rep").agg(F.count("*").alias("copies"))
    classes_ = shared.members.join(copies, "rep").join(covered, "rep", "left").join(links(shared), "rep", "left")
    rows = docs.select(F.col(key).alias(key), F.length(text).alias("n")).filter(F.col("n") > 0)
    part = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0)))
    return rows.join(classes_.withColumnRenamed("key", key), key, "left").select(
        key,
        F.coalesce("rep", F.col(key)).alias("class_id"),
        F.col("n").cast("long").alias("n_chars"),
        part.cast("long").alias("shared_chars"),
        (part / F.col("n")).alias("shared_fraction"),
        F.coalesce("shares_with", F.lit(0)).cast("long").alias("shares_with"),
    )
