"""Exact repeats of long byte strings across a corpus, by previous factors in suffix order.

Sort all suffixes.  Those that share their first `length` bytes are one run of that order, and inside a run the previous and
next smaller text positions lead to the earliest member: the longest previous factor of a position reaches `length` exactly
if its run holds a smaller position (and the longest next factor if it holds a greater one).  So the factor arrays are
needed only against `length`, and the order only up to the names of runs, which hashes of whole windows give without moving
suffixes about.

Windows (strings of `length` bytes) are named in three steps, each for what the one before left open:
1. every window picks the smallest hash of its words of 64 bytes (a third of `length` if that is less), an anchor inside it.  Consecutive windows with one anchor are a
   block.  Equal windows have equal anchors, so blocks with different anchor words never meet.  Blocks alike in all bytes
   are settled whole.
2. blocks with a shared anchor but other bytes are cut by distance from the anchor into pieces of at most 8 windows.  Pieces meet
   if the bytes that all their windows share are equal, and pieces alike in all bytes are settled.
3. what is left is named window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.common import release, staged, text_of
from labeltrail.llm.tokens import chunks, mix, powers

#: Anchor words have a third of the length, at most this many bytes.
WORD = 64
PIECE = 8
LEAST_LENGTH = 24
#: Bits of a position inside a segment; longer texts are cut into overlapping segments.
PLACE = np.uint64(24)


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end)."""
    return mix((total[end] - total[start]) * powers(len(total))[1][start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, distance of the anchor from the first, anchor hash, hash of all bytes); positions in the row."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.uint64 if i > 3 else np.int64) for i in range(6))
    total, word = _sums(data), min(WORD, length // 3)
    at = np.arange(n - word + 1)
    words = _hash(total, at, at + word)
    least = _least((words & ~np.uint64((1 << int(PLACE)) - 1)) | at.astype(np.uint64), length - word + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    whole = np.arange(len(least)) + length <= offsets[row + 1]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new & whole)
    count = np.add.reduceat(whole.astype(np.int64), np.flatnonzero(new))[whole[np.flatnonzero(new)]]
    anchor = (least[first] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    far = anchor - first
    everything = _hash(total, first, first + count - 1 + length)
    everything = mix(everything ^ mix((far * 65536 + count).astype(np.uint64)))
    return row[first], first - offsets[row[first]], count, far, words[anchor], everything


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of a chunk; a text beyond the bits of a position is cut into segments that overlap by length - 1."""
    most = 1 << int(PLACE)
    if len(data) <= most:
        yield blocks(data, offsets, length)
        return
    step = most - length + 1
    for a in range(0, len(data), step):  # such a chunk is a single row
        part = data[a:a + most]
        row, first, *rest = blocks(part, np.array([0, len(part)]), length)
        yield row, first + a, *rest


def _all_blocks(source: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, first, count, far, anchor, bytes) of every block; mark is a 64-bit hash of the text, which tells rows of one id apart."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in chunks(batch.column("text")):
                for row, first, count, far, anchor, everything in _segments(data, offsets, length):
                    keys = [batch.column(c).slice(begin, end - begin).take(pa.array(row)) for c in ("doc_id", "mark")]
                    yield pa.record_batch([*keys, pa.array(first), pa.array(count.astype(np.int16)), pa.array(far.astype(np.int16)),
                                           pa.array(anchor.view(np.int64)), pa.array(everything.view(np.int64))],
                                          ["doc_id", "mark", "first", "count", "far", "anchor", "bytes"])

    return source.mapInArrow(run, f"doc_id {kind}, mark long, first long, count smallint, far smallint, anchor long, bytes long")


def _pieces(source: DataFrame, length: int) -> DataFrame:
    """Blocks of each text (column `open`) cut into pieces, with the name of every window; a piece's anchor is what its windows share."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "first", "count", "far", "many", "anchor", "bytes", "windows"]
        for batch in batches:
            for i, wanted in enumerate(batch.column("open").to_pylist()):
                data = np.frombuffer(batch.column("text")[i].as_buffer(), dtype=np.uint8)
                total = _sums(data)
                first, count, far, many = (np.array([b[c] for b in wanted], dtype=np.int64) for c in ("first", "count", "far", "many"))
                block = np.repeat(np.arange(len(wanted)), count)
                starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[block]
                place = (first + far)[block]  # of the anchor word
                piece = (place - starts) // PIECE
                cut = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (block[1:] != block[:-1])])
                n = np.diff(np.r_[cut, len(starts)])
                s, end = starts[cut], place[cut] - piece[cut] * PIECE
                core = mix(_hash(total, end, end - PIECE + 1 + length) ^ mix(piece[cut].astype(np.uint64)))
                apart = place[cut] - s
                same = mix(_hash(total, s, s + n - 1 + length) ^ mix((apart * 65536 + n).astype(np.uint64)))
                window = mix(_hash(total, starts, starts + length)).view(np.int64)
                ids = [batch.column(c).take(pa.array(np.full(len(cut), i))) for c in ("doc_id", "mark")]
                yield pa.record_batch([*ids, pa.array(s), pa.array(n.astype(np.int16)), pa.array(apart.astype(np.int16)), pa.array(many[block[cut]]),
                                       pa.array(core.view(np.int64)), pa.array(same.view(np.int64)),
                                       pa.ListArray.from_arrays(pa.array(np.r_[cut, len(starts)].astype(np.int32)), pa.array(window))], names)

    return source.mapInArrow(run, f"doc_id {kind}, mark long, first long, count smallint, far smallint, many long, anchor long, bytes long, windows array<long>")


def _settle(rows: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split blocks or pieces into settled spans (doc_id, mark, first, count) and the representatives still open; last the staged runs.

    A run of equal bytes is settled but, with keep_first, for its smallest position.  The smallest position of each run stays
    open if its anchor has other runs, and stands for `many` members.
    """
    place = F.struct("doc_id", "mark", "first", "count", "far")
    runs = staged(rows.groupBy("anchor", "bytes").agg(F.sum("many").alias("all"), F.min(place).alias("least")), "runs")
    joined = rows.join(runs.where("all > 1"), ["anchor", "bytes"])
    settled = joined.where(~place.eqNullSafe(F.col("least"))) if keep_first else joined
    mixed = runs.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1").select("anchor")
    still = runs.join(mixed, "anchor").select("least.*", "anchor", F.least("all", F.lit(2)).alias("many"))
    return settled.select("doc_id", "mark", "first", "count"), still, runs


def repeated_spans(docs: DataFrame, length: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, spans) of the texts that hold a string of `length` bytes found elsewhere too; spans: [first window, windows]."""
    if length < LEAST_LENGTH:
        raise ValueError(f"length must be at least {LEAST_LENGTH}")
    if length > 32_767:
        raise ValueError("length must fit 16 bits, as distances inside a window do")
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", _mark())
    every = staged(_all_blocks(source, length), "blocks")
    shared = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    rows = staged(every.join(shared, "anchor").withColumn("many", F.lit(1).cast("long")), "shared")
    release(every)
    del every, shared
    settled, still, runs = _settle(rows, keep_first)
    settled = staged(settled, "settled")
    release(rows)
    del rows
    wanted = still.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "count", "far", "anchor", "many")).alias("open"))
    texts = source.join(wanted.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    pieces = staged(_pieces(texts.select("doc_id", "mark", "text", "open"), length), "pieces")
    release(runs)
    del runs, still, wanted, texts
    once = pieces.drop("windows").dropDuplicates(["doc_id", "mark", "first", "anchor"])  # rows repeated whole
    common = once.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    settled_pieces, left, piece_runs = _settle(once.join(common, "anchor"), keep_first)
    settled_pieces = staged(settled_pieces, "settled_pieces")
    left = left.select(F.struct("doc_id", "mark", "first").alias("k"), "anchor", "many")
    named = pieces.select(F.struct("doc_id", "mark", "first").alias("p"), F.col("anchor").alias("a"), "windows").dropDuplicates(["p", "a"])
    single = left.join(named, F.col("k").eqNullSafe(F.col("p")) & (F.col("anchor") == F.col("a"))).select("k.*", "many", "anchor", F.posexplode("windows").alias("i", "window"))
    single = staged(single.withColumn("first", F.col("first") + F.col("i")).drop("i"), "windows")
    release(pieces, piece_runs)
    del pieces, piece_runs, once, common, left, named
    place = F.struct("doc_id", "mark", "first")
    names = single.groupBy("anchor", "window").agg(F.sum("many").alias("all"), F.min(place).alias("least")).where("all > 1")
    named = single.join(names, ["anchor", "window"])
    named = named.where(~place.eqNullSafe(F.col("least"))) if keep_first else named
    spans = settled.unionByName(settled_pieces).unionByName(named.select("doc_id", "mark", "first", F.lit(1).cast("smallint").alias("count")))
    spans = staged(spans.groupBy("doc_id", "mark").agg(F.collect_list(F.array(F.col("first"), F.col("count").cast("long"))).alias("spans")), "spans")
    parts = (settled, settled_pieces, single)
    del settled, settled_pieces, single, named, names
    release(*parts)
    return spans


def _mark():
    return F.xxhash64("text")


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without the bytes of strings of `length` bytes found elsewhere.

    With keep_first the earliest place of a string (by id and position) stays, else every place goes.  Overlaps count, places
    in the same text count, and strings are judged on the input.  n_spans counts maximal removed runs.  `kept` is binary,
    as a cut may fall inside a character.

    Null text: empty.  Texts under `length` bytes lose nothing.  Rows repeated whole count as places of their own; with
    keep_first they are one document.  Null ids come first in the order of places.  Empty table: no rows.  Other columns of
    `docs` are not read.
    """
    spans = repeated_spans(docs, length, keep_first, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", _mark())
    both = source.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "spans")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column("spans")
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_buffer().to_pybytes()
                if not lists[i].is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                data = np.frombuffer(raw, np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                at = np.array(lists[i].as_py(), dtype=np.int64)
                np.add.at(change, at[:, 0], 1)
                np.add.at(change, at[:, 0] + at[:, 1] - 1 + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                out.append((len(data), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)), data[~gone].tobytes()))
            n, removed, runs, kept = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                   pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
