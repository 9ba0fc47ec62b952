"""Byte-level BPE: encode texts to token ids and decode them again.

A word is held as an array of part ids, so that the boundaries are implied, beside an array with the merge rank of each
adjacent pair.  The smallest rank is found by a scan, its boundary is deleted and the two neighbouring ranks are looked
up anew.  Words too long for scans take a heap over the same ranks, with the same merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.common import text_of

#: Fixed value: the pattern that parts text into words before merging, with white space as Unicode defines it.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NEVER = 1 << 40
LONG_WORD = 400
CACHED_WORDS = 400_000


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary(dict):
    """word -> its token ids as little-endian bytes; filled on demand, emptied when it has CACHED_WORDS words."""

    def __init__(self, spec: dict):
        super().__init__()
        names = byte_names()
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(ids[a] << 32) | ids[b]: (rank << 32) | ids[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.bytes_of = {i: bytes(names[c] for c in token) for token, i in ids.items()}
        self.id_of_byte = [ids[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        raw = [self.id_of_byte[b] for b in word.encode()]
        found = np.array(self.merged(raw) if len(raw) < LONG_WORD else self.merged_long(raw), dtype="<u4").tobytes()
        self[word] = found
        return found

    def merged(self, ids: list[int]) -> list[int]:
        """Merge by scans over the array of adjacent ranks."""
        get = self.merges.get
        ranks = [get((a << 32) | b, NEVER << 32) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low >= NEVER << 32:
                break
            i = ranks.index(low)
            ids[i] = low & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1] << 32) | ids[i], NEVER << 32)
            if i < len(ranks):
                ranks[i] = get((ids[i] << 32) | ids[i + 1], NEVER << 32)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same merges, smallest rank and then leftmost first, from a heap over linked parts."""
        get, n = self.merges.get, len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(v, i, ids[i], ids[i + 1]) for i in range(n - 1) if (v := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            v, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = v & 0xFFFFFFFF, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] < n and (w := get((ids[x] << 32) | ids[right[x]])) is not None:
                    heapq.heappush(heap, (w, x, ids[x], ids[right[x]]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        if self.parts is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special
                        else b"".join(map(self.__getitem__, WORDS.findall(x))) for x in self.parts.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of token ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, token_ids binary of little-endian 32-bit ids, decoded string) of every whole text.

    `path` names the vocabulary file; the driver reads it and the tasks get it as a broadcast (its size does not grow
    with the data).  Special tokens spelt out in a text become their ids.  A null or empty text has no tokens and
    decodes to the empty text; repeated rows and null ids pass through.  Other columns are not read.  Rows are mapped
    one by one, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(json.loads(Path(path).read_text(encoding="utf-8")))
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids = [vocabulary.encode(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                                       pa.array(map(vocabulary.decode, ids), pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded"])

    return source.mapInArrow(run, schema)
