"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.buckets import bucket_links, shared_buckets, within_difference
from labeltrail.llm.common import staged, text_of
from labeltrail.llm.tokens import SPACES, chunks, distinct, mix, shingles, words
from labeltrail.operators.components import connected_minimum

REGISTERS = 128
BAND = 4
#: Bits after the leading one that a register keeps beside the count of leading zeros.
MANTISSA = 10
#: Longs of the odd sketch that rules pairs out exactly; sets much larger than its bits only have the register bits.
ODD = [f"odd{i}" for i in range(8)]
#: Standard deviations below the threshold at which an estimate rules a pair out.
SLACK = 6.0


def registers_of(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x REGISTERS of uint16: leading zeros and MANTISSA bits of each bucket's smallest value.

    An empty bucket takes the register of the first filled one along a fixed pseudo-random walk, so that small sets still
    fill every register and two registers agree with the chance of the sets' Jaccard similarity.  Rows without hashes keep 0.
    """
    bucket = (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)
    value = mix(hashes) >> np.uint64(12)  # 52 bits, exact as a double
    least = np.full(n_rows * REGISTERS, 1 << 52, dtype=np.uint64)
    at = rows * REGISTERS + bucket
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    least[at[first]] = value[first]
    least = least.reshape(n_rows, REGISTERS)
    empty = least == np.uint64(1 << 52)
    _, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))  # bit length
    zeros = 52 - exponent
    shift = exponent - 1 - MANTISSA
    tail = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    out = ((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA) | (tail & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    out[empty] = 0
    some = ~empty.all(axis=1)
    for step in range(1, 4096):
        left = empty & some[:, None]
        if not left.any():
            break
        r, c = np.nonzero(left)
        source = (mix((c.astype(np.uint64) << np.uint64(20)) + np.uint64(step)) & np.uint64(REGISTERS - 1)).astype(np.int64)
        good = filled[r, source] if step > 1 else ~empty[r, source]
        if step == 1:
            filled, whole = ~empty, out.copy()
        out[r[good], c[good]] = whole[r[good], source[good]]
        empty[r[good], c[good]] = False
    return out


def bands_of(registers: np.ndarray) -> np.ndarray:
    """rows x bands of 64-bit keys; a key also holds its band's number."""
    parts = registers.reshape(len(registers), REGISTERS // BAND, BAND).astype(np.uint64)
    key = np.zeros(parts.shape[:2], dtype=np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for i in range(BAND):
        key = mix(key ^ (parts[:, :, i] + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, less the matches that compression makes by chance."""
    same = (a == b).mean(axis=1)
    levels = np.arange(0, 53)[None, :]
    share = lambda k: (1 - 2.0 ** -(levels + 1)) ** np.maximum(k[:, None] / REGISTERS, 1) - (1 - 2.0 ** -levels) ** np.maximum(k[:, None] / REGISTERS, 1)
    chance = (share(n) * share(m)).sum(axis=1) / 2**MANTISSA
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, s1, s2, registers, bands, low1, low2, odd...): size and two hashes of each whole text's shingle set, its sketch,
    the lowest bits of the registers as two integers, and an odd sketch of the set."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                rows, hashes = distinct(*shingles(*words(data, offsets, SPACES), words_per_shingle))
                n_rows = end - first
                n = np.bincount(rows, minlength=n_rows)
                sums = [np.zeros(n_rows, dtype=np.uint64) for _ in range(2)]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
                if len(starts):
                    sums[0][rows[starts]] = np.add.reduceat(hashes, starts)
                    sums[1][rows[starts]] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                registers = registers_of(rows, hashes, n_rows)
                bands = bands_of(registers)
                low = np.ascontiguousarray(np.packbits((registers & 1).astype(np.uint8), axis=1)).view(np.int64)
                bits = 64 * len(ODD)
                odd = np.bincount(rows * bits + (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64), minlength=n_rows * bits) & 1
                odd = np.ascontiguousarray(np.packbits(odd.astype(np.uint8).reshape(n_rows, bits), axis=1)).view(np.int64)
                yield pa.record_batch([
                    batch.column("doc_id").slice(first, n_rows), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), bands.shape[1]).cast(pa.list_(pa.int64())),
                    pa.array(np.ascontiguousarray(low[:, 0])), pa.array(np.ascontiguousarray(low[:, 1])),
                    *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(len(ODD))]],
                    ["doc_id", "n", "s1", "s2", "registers", "bands", "low1", "low2", *ODD])

    return source.mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, registers binary, bands array<long>, low1 long, low2 long, " + ", ".join(f"{c} long" for c in ODD))


def _verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                part, sets = batch.slice(i, 256), []
                for name in ("text_a", "text_b"):
                    found: list[np.ndarray] = []
                    for first, end, data, offsets in chunks(part.column(name)):
                        rows, hashes = distinct(*shingles(*words(data, offsets, SPACES), words_per_shingle))
                        found += np.split(hashes, np.searchsorted(rows, np.arange(1, end - first)))
                    sets.append(found)
                for x, y in zip(*sets):
                    inside = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * inside >= percent * (len(x) + len(y) - inside) and inside > 0)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _near(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Sizes allow the similarity, and the lowest register bits differ by at most SLACK standard deviations more than at it."""
    share = (1 - percent / 100) / 2  # of differing bits at the threshold
    apart = F.bit_count(a("low1").bitwiseXOR(b("low1"))) + F.bit_count(a("low2").bitwiseXOR(b("low2")))
    spread = math.sqrt(REGISTERS * share * (1 - share)) * F.sqrt(REGISTERS / F.least(a("n"), b("n"), F.lit(REGISTERS)))
    return within_difference(a, b, "n", ODD, percent / 100) & (apart <= REGISTERS * share + SLACK * spread)


def _plausible(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and corrected estimates leave possible."""
    side = lambda c: sketch.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                j = percent / 100
                spread = np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.minimum(n, m)))
                keep = estimate(a, b, n, m) >= j - SLACK * spread
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Two documents are linked if their sets of word shingles have 100 * intersection >= percent * union; component_id is
    the smallest id reachable over links, kept says that it is the document's own.

    Equal sets are one class from the start.  Classes share a bucket if a band of registers agrees; buckets are worked off in
    rounds (bucket_links), where every pair that could join two components is compared in the end and nothing is capped.
    Sizes and odd sketches rule pairs out exactly, register bits and corrected estimates 6 standard deviations below the
    threshold; full sets confirm the rest.

    Null or empty texts and texts without words: 0 shingles, linked with nothing.  Rows with one id are one vertex.
    Null ids are linked with nothing and have a null component and kept true.  Empty table: no rows.  Other columns of `docs`
    are not read.
    """
    sketch = staged(sketches(docs, words_per_shingle, id_col, text_col), "sketches")
    members = sketch.where(F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = members.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    copies = members.join(classes.where("copies > 1").select("n", "s1", "s2", "node"), ["n", "s1", "s2"])
    edges = copies.where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # a set of three shingles or fewer has no partner at 80 % but its equals
    least = 2 if percent <= 50 else int(np.ceil(percent / (100 - percent))) if percent < 100 else None
    links = []
    if least is not None:
        nodes = members.where(F.col("n") >= least).join(
            classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"]).where(F.col("doc_id") == F.col("node"))
        sketch_of = nodes.select("node", "n", "registers").dropDuplicates(["node", "n"])
        once = nodes.dropDuplicates(["node", "n"])
        buckets = shared_buckets(once.select("node", "n", "low1", "low2", *ODD, F.explode("bands").alias("key")))
        wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
        texts = staged(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(wanted, "doc_id", "left_semi"), "texts")
        links, _ = bucket_links(buckets, lambda pairs: _plausible(pairs, sketch_of, percent),
                             lambda pairs: _verified(pairs, texts, words_per_shingle, percent), lambda a, b: _near(a, b, percent))
    for more in links:
        edges = edges.unionByName(more)
    final = connected_minimum(edges).select(F.col("node").alias("doc_id"), "canonical")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    component_id = F.coalesce("canonical", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))
