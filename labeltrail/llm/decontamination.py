"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a run of a few words are joined on the run's hash.  For each such pair the longest
common runs of unmarked words are marked again and again, found by Karp-Rabin hashes, until none of the least length is
left.  The share of an item's words under tiles tells how much of it a document gives away, in whatever order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.common import staged, text_of
from labeltrail.llm.tokens import PUNCTUATION, chunks, shingles, words

#: Slots of the first filter; its size is fixed, whatever the benchmark's.
FILTER_BITS = 22


def _runs(values: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, rolling hash) of every run of `size` words without a marked one."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * base + values[i:i + n]
    marked = np.r_[0, np.cumsum(~free)]
    starts = np.flatnonzero(marked[size:] - marked[:-size] == 0)
    return starts, h[starts]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the greedy tiling: longest matches first, none under `least` words.

    Runs of a search length are matched by hash and confirmed word by word.  The length begins at the whole item and falls to
    the longest match there is; equal lengths are marked from left to right.
    """
    free_item, free_text, out = np.ones(len(item), bool), np.ones(len(text), bool), []
    size = min(len(item), len(text))
    while size >= least:
        at_item, h_item = _runs(item, free_item, size)
        at_text, h_text = _runs(text, free_text, size)
        hit = np.isin(h_text, h_item)
        if not hit.any():
            # the longest match is shorter: halve the range by the same search
            low, high = least - 1, size - 1
            while low < high:
                middle = (low + high + 1) // 2
                if np.isin(_runs(text, free_text, middle)[1], _runs(item, free_item, middle)[1]).any():
                    low = middle
                else:
                    high = middle - 1
            size = low
            continue
        where: dict[int, list[int]] = {}
        for a, h in zip(at_item.tolist(), h_item.tolist()):
            where.setdefault(h, []).append(a)
        placed = False
        for b, h in zip(at_text[hit].tolist(), h_text[hit].tolist()):
            if not free_text[b:b + size].all():
                continue
            for a in where[h]:
                if free_item[a:a + size].all() and np.array_equal(item[a:a + size], text[b:b + size]):
                    free_item[a:a + size], free_text[b:b + size] = False, False
                    out.append((a, b, size))
                    placed = True
                    break
        if not placed:
            size -= 1
    return out


def _seeds(df: DataFrame, id_col: str, text_col: str, size: int, shared=None) -> DataFrame:
    """(id, size in words, seed, times) of each distinct run of `size` words and how often it occurs; with `shared`, only of seeds in the filter."""
    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = None
        if shared is not None:
            present = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                rows, hashes = words(data, offsets, PUNCTUATION)
                length = np.bincount(rows, minlength=end - first)
                rows, seeds = shingles(rows, hashes, size, whole_if_short=False)
                if present is not None:
                    keep = present[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    rows, seeds = rows[keep], seeds[keep]
                order = np.lexsort((seeds, rows))
                rows, seeds = rows[order], seeds[order]
                at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (seeds[1:] != seeds[:-1])]) if len(rows) else np.zeros(0, np.int64)
                times = np.diff(np.r_[at, len(rows)])
                rows, seeds = rows[at], seeds[at]
                ids = batch.column("id").slice(first, end - first).take(pa.array(rows))
                yield pa.record_batch([ids, pa.array(length[rows].astype(np.int64)), pa.array(seeds.view(np.int64)), pa.array(times.astype(np.int64))],
                                      ["id", "length", "seed", "times"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, length long, seed long, times long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id",
                 text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, covered, item_words, coverage) of the pairs where tiles cover at least `coverage` of the item.

    Words are runs of letters and digits in small letters.  Seeds and tiles have at least `least` words.  Whole texts are
    searched.  A fixed-size bit filter of the benchmark's seeds, built from its distinct slots, spares most document
    seeds the join; the join itself is exact for a benchmark of any size.  Pairs whose shared seeds, at all their places in the
    item, could not cover enough are not tiled.

    Null, empty and wordless texts, and items of fewer than `least` words, match nothing.  Rows with one id are tiled each by
    itself and the best covered counts.  Null ids match nothing.  Empty tables: no rows.  Other columns are not read.
    """
    items = benchmark.where(F.col(item_col).isNotNull())
    item_seeds = _seeds(items, item_col, item_text_col, least).select(F.col("id").alias("item_id"), F.col("length").alias("item_words"), "seed", "times")
    slots = item_seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    known = docs.where(F.col(id_col).isNotNull())
    doc_seeds = _seeds(known, id_col, text_col, least, shared).select(F.col("id").alias("doc_id"), "seed")
    pairs = doc_seeds.join(item_seeds, "seed").groupBy("doc_id", "item_id").agg(F.sum("times").alias("n"), F.min("item_words").alias("item_words"))
    pairs = staged(pairs.where(F.col("n") * least >= coverage * F.col("item_words")).select("doc_id", "item_id"), "pairs")
    doc_ids = pairs.select("doc_id").distinct()
    texts = known.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("doc_text")).join(doc_ids, "doc_id", "left_semi")
    both = pairs.join(texts, "doc_id").join(items.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("item_text")), "item_id")
    kinds = f"doc_id {both.schema['doc_id'].dataType.simpleString()}, item_id {both.schema['item_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(column: pa.Array) -> list[np.ndarray]:
            found: list[np.ndarray] = []
            for first, end, data, offsets in chunks(column):
                rows, hashes = words(data, offsets, PUNCTUATION)
                found += np.split(hashes, np.searchsorted(rows, np.arange(1, end - first)))
            return found

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for item, text in zip(lists(part.column("item_text")), lists(part.column("doc_text"))):
                    found = tiles(item, text, least)
                    rows.append((len(found), max((t[2] for t in found), default=0), sum(t[2] for t in found), len(item)))
                n_tiles, longest, covered, total = (np.array(x, dtype=np.int64) for x in zip(*rows))
                yield pa.record_batch([part.column("doc_id"), part.column("item_id"), pa.array(n_tiles), pa.array(longest), pa.array(covered), pa.array(total),
                                       pa.array(covered / np.maximum(total, 1))], ["doc_id", "item_id", "n_tiles", "longest", "covered", "item_words", "coverage"])

    tiled = both.mapInArrow(run, kinds + ", n_tiles long, longest long, covered long, item_words long, coverage double")
    best = tiled.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "covered", "item_words", "longest", "n_tiles")).alias("b"))
    return best.where(F.col("b.coverage") >= coverage).select("doc_id", "item_id", "b.n_tiles", "b.longest", "b.covered", "b.item_words", "b.coverage")
