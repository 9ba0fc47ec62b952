"""Ranked lexical search: the documents of a task form an FP-tree, searched depth first with bounds, item by item.

A document keeps the items' terms it holds, ordered by falling document frequency, so documents with the same frequent terms
share a path of the trie.  A node knows the largest tf of every term and the least m below it; the score they would give bounds all scores
below, and a subtree that cannot reach the best documents found so far is left out.  Scores are whole numbers and exact.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from labeltrail.llm.common import release, staged, text_of
from labeltrail.llm.tokens import PUNCTUATION, chunks, words

#: Items are searched in blocks of at most so many rows and, but for a longer single item, so many terms.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 16_384
#: Documents below which a node is not split again.
LEAF = 64
#: Cells (nodes x terms) and entries that a task's tree may take; more documents make another tree.
TREE_CELLS, TREE_ENTRIES = 8_000_000, 4_000_000
#: Fixed values of the score.
SHARE, LENGTH, GAIN = 75, 8, 1_000_000_000


@dataclass(frozen=True)
class Item:
    number: int
    item_id: object
    terms: np.ndarray  # places in the block's sorted list of term hashes
    counts: np.ndarray


def term_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the terms of each text, in order with repeats; A-Z count as a-z, null as empty."""
    out: list[np.ndarray] = []
    for first, end, data, offsets in chunks(texts):
        rows, hashes = words(data, offsets, PUNCTUATION)
        out += np.split(hashes, np.searchsorted(rows, np.arange(1, end - first)))
    return out


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[Item], np.ndarray]]:
    """Blocks of items with the sorted hashes of their terms; the driver holds a block at a time."""
    held, seen, number = [], set(), 0
    for row in items.select(F.col(item_col).alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        hashes, counts = np.unique(term_hashes(pa.array([row.t]))[0], return_counts=True)
        if not len(hashes):
            continue
        if held and (len(held) == BLOCK_ITEMS or len(seen.union(hashes.tolist())) > BLOCK_TERMS):
            yield _block(held)
            held, seen = [], set()
        held.append((number, row.i, hashes, counts))
        seen.update(hashes.tolist())
        number += 1
    if held:
        yield _block(held)


def _block(held: list) -> tuple[list[Item], np.ndarray]:
    known = np.unique(np.concatenate([h for _, _, h, _ in held]))
    return [Item(n, i, np.searchsorted(known, h), c.astype(np.int64)) for n, i, h, c in held], known


def term_vectors(docs: DataFrame, known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of every document: n counts all its terms, terms and tf those among `known`."""
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                rows, hashes = words(data, offsets, PUNCTUATION)
                n = np.bincount(rows, minlength=end - first)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                here = known[at] == hashes
                cells, tf = np.unique(rows[here] * len(known) + at[here], return_counts=True)
                cuts = np.searchsorted(cells, np.arange(end - first + 1) * len(known)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cuts), pa.array(v))
                yield pa.record_batch([batch.column("id").slice(first, end - first), pa.array(n.astype(np.int64)), lists((cells % len(known)).astype(np.int32)),
                                       lists(tf.astype(np.int64))], ["id", "n", "terms", "tf"])

    return source.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>")


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a score that a term's weight multiplies; grows with tf and falls with m, which makes bounds of extremes."""
    return (GAIN * tf) // (1000 * tf + LENGTH * m)


class Best:
    """The k best documents found so far, as (-score, order of the id)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def admits(self, bound: int, key: tuple) -> bool:
        """Whether a document of this score and id, or of a lower score and higher id, could enter."""
        return bound > 0 and (len(self.rows) < self.k or (-bound, key) < self.rows[-1])

    def add(self, score: int, key: tuple) -> None:
        insort(self.rows, (-score, key))
        del self.rows[self.k:]


class Tree:
    """Trie of documents given as runs of (term by falling frequency, tf), with their m and the order of their ids."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, keys: list[tuple], n_terms: int):
        self.start, self.terms, self.tf, self.m = np.r_[0, np.cumsum(lengths)], terms, tf, m
        by_id = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = [keys[i] for i in by_id]
        self.place = np.empty(len(keys), np.int64)
        self.place[by_id] = np.arange(len(keys))
        self.n_terms, self.found = n_terms, 0
        # of each node: its children (a leaf has none), the documents of a leaf, the least place by id below it
        self.children: list[np.ndarray] = []
        self.documents: list[tuple[int, int]] = []
        self.first: list[int] = []
        self._tf_maxima: list[np.ndarray] = []
        self._m_minima: list[int] = []
        leaves: list[np.ndarray] = []
        self.root = self._grow(leaves)
        #: What the largest tf below a node would gain at the least m below it.
        self.bounds = np.empty((len(self.first), n_terms), np.int32)
        for node, (most, least) in enumerate(zip(self._tf_maxima, self._m_minima)):
            self.bounds[node] = gains(most.astype(np.int64), np.int64(least))
        order = np.concatenate(leaves)  # documents in the order of the leaves, so a leaf is one run of entries
        length = lengths[order]
        entries = np.repeat(self.start[order] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        self.gain = gains(tf[entries], np.repeat(m[order], length))
        self.terms, self.start, self.place = terms[entries], np.r_[0, np.cumsum(length)], self.place[order]
        del self._tf_maxima, self._m_minima, self.tf, self.m

    def _add(self, children: list[int], documents: tuple[int, int], most: np.ndarray, least: int, first: int) -> int:
        self.children.append(np.array(children, dtype=np.int64))
        self.documents.append(documents)
        self._tf_maxima.append(most)
        self._m_minima.append(least)
        self.first.append(first)
        return len(self.first) - 1

    def _leaf(self, docs: np.ndarray, leaves: list[np.ndarray]) -> int:
        most = np.zeros(self.n_terms, np.int32)
        for d in docs.tolist():
            run = slice(self.start[d], self.start[d + 1])
            most[self.terms[run]] = np.maximum(most[self.terms[run]], np.minimum(self.tf[run], 2**31 - 1))
        leaves.append(docs)
        self.found += len(docs)
        return self._add([], (self.found - len(docs), self.found), most, int(self.m[docs].min()), int(self.place[docs].min()))

    def _joined(self, children: list[int]) -> int:
        most = self._tf_maxima[children[0]].copy()
        for c in children[1:]:
            np.maximum(most, self._tf_maxima[c], out=most)
        return self._add(children, (0, 0), most, min(self._m_minima[c] for c in children), min(self.first[c] for c in children))

    def _next(self, docs: np.ndarray, depth: int) -> np.ndarray:
        """The term of each document at a depth, -1 beyond its last."""
        at = self.start[docs] + depth
        here = np.full(len(docs), -1, np.int64)
        on = at < self.start[docs + 1]
        here[on] = self.terms[at[on]]
        return here

    def _grow(self, leaves: list[np.ndarray]) -> int:
        """Nodes from the leaves up, by a stack, as paths are as long as documents.

        A node splits its documents by their next term.  Parts of up to LEAF documents share leaves; where one part holds
        more than half, the others become leaves and that part goes on below the same node, so nodes number a
        fraction of the documents however long the paths are.
        """
        top: list[int] = []
        stack = [(np.arange(len(self.m)), 0, top)]
        while stack:
            docs, depth, out = stack.pop()
            if depth < 0:
                out.append(self._joined(docs))
                continue
            below: list[int] = []
            small: list[np.ndarray] = []
            large: list[np.ndarray] = []
            while len(docs) > LEAF:
                here = self._next(docs, depth)
                order = np.argsort(here, kind="stable")
                cuts = np.flatnonzero(np.diff(here[order])) + 1
                parts, terms = np.split(docs[order], cuts), here[order][np.r_[0, cuts]]
                depth += 1
                open_parts = [p for p, t in zip(parts, terms) if t >= 0 and len(p) > LEAF]
                small += [p for p, t in zip(parts, terms) if t < 0 or len(p) <= LEAF]
                if len(open_parts) == 1 and 2 * len(open_parts[0]) > len(docs):
                    docs = open_parts[0]
                    continue
                large, docs = open_parts, docs[:0]
            rest = np.concatenate([*small, docs])
            below += [self._leaf(piece, leaves) for piece in np.split(rest, np.arange(LEAF, len(rest), LEAF)) if len(piece)]
            if not large and len(below) == 1:
                out.append(below[0])
                continue
            stack.append((below, -1, out))
            stack += [(part, depth, below) for part in large]
        return top[0]

    def search(self, item: Item, weights: np.ndarray, best: Best) -> None:
        """Put the documents that belong to an item's best into `best`, depth first, the most promising child first."""
        terms, weight = item.terms, weights * item.counts
        dense = np.zeros(self.n_terms, np.int64)
        dense[terms] = weight
        stack = [(int(self.bounds[self.root, terms].astype(np.int64) @ weight), self.root)]
        while stack:
            bound, node = stack.pop()
            if not best.admits(bound, self.keys[self.first[node]]):
                continue
            below = self.children[node]
            if len(below):
                bounds = self.bounds[np.ix_(below, terms)].astype(np.int64) @ weight
                for i in np.argsort(bounds, kind="stable").tolist():
                    stack.append((int(bounds[i]), int(below[i])))
                continue
            lo, hi = self.documents[node]
            at = self.start[lo:hi + 1] - self.start[lo]
            run = slice(self.start[lo], self.start[hi])
            total = np.r_[0, np.cumsum(dense[self.terms[run]] * self.gain[run])]
            scores = total[at[1:]] - total[at[:-1]]
            floor = max(1, -best.rows[-1][0]) if len(best.rows) == best.k else 1
            for i in np.flatnonzero(scores >= floor).tolist():
                key = self.keys[self.place[lo + i]]
                if best.admits(int(scores[i]), key):
                    best.add(int(scores[i]), key)


def search_block(vectors: DataFrame, items: list[Item], n_known: int, k: int) -> DataFrame:
    """(number, doc_id, score): the k best documents of each task for each item."""
    shares = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_all = int(shares.docs), int(shares.terms)
    df = np.zeros(n_known, dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[r.t] = r["count"]
    order = np.argsort(-df, kind="stable")
    rank = np.empty(n_known, dtype=np.int64)
    rank[order] = np.arange(n_known)
    weights = term_weights(df, n_docs)
    asked = [(Item(i.number, i.item_id, rank[i.terms], i.counts), weights[i.terms]) for i in items]
    most_docs = max(LEAF, 6 * TREE_CELLS // n_known)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        held: list[tuple] = []

        def searched() -> None:
            """Grow a tree of the documents held and search it."""
            if not held:
                return
            lengths, terms, tf, n, ids = zip(*held)
            lengths, n = np.concatenate(lengths), np.concatenate(n)
            terms, tf = rank[np.concatenate(terms)], np.concatenate(tf)
            by = np.lexsort((terms, np.repeat(np.arange(len(lengths)), lengths)))
            m = 100 - SHARE + (SHARE * n * n_docs) // n_all
            keys = [(i is None, 0 if i is None else i) for part in ids for i in part]
            tree = Tree(lengths, terms[by], tf[by], m, keys, n_known)
            for (item, weight), found in zip(asked, best):
                tree.search(item, weight, found)
            held.clear()

        docs = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                part = part.filter(pc.greater(pc.list_value_length(part.column("terms")), 0))
                if not part.num_rows:
                    continue
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tf")]
                lengths = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((lengths, *flat, part.column("n").to_numpy(), part.column("id").to_pylist()))
                docs, entries = docs + part.num_rows, entries + len(flat[0])
                if docs >= most_docs or entries >= TREE_ENTRIES:
                    searched()
                    docs = entries = 0
        searched()
        rows = [(item.number, key, -score) for (item, _), found in zip(asked, best) for score, key in found.rows]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[1][0] else r[1][1] for r in rows], type=id_type),
                               pa.array([r[2] for r in rows], pa.int64())], ["number", "doc_id", "score"])

    id_type = to_arrow_type(vectors.schema["id"].dataType)
    return vectors.mapInArrow(run, f"number long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending id.

    Every document is a candidate for every item.  Documents and items with null or empty texts, or without a term, find nothing and count
    nowhere.  Repeated rows are documents of their own, as are items with one id, which keep a list each; null ids come
    last among equals.  Empty table of either kind: no rows.  Other columns are not read.
    """
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block, known in item_blocks(items, item_col, item_text_col):
        vectors = staged(term_vectors(docs, known, id_col, text_col), "vectors")
        found = search_block(vectors, block, len(known), k)
        place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(i.number, i.item_id) for i in block], f"number long, item_id {kind}")  # a block of items
        found = staged(found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"), "found")
        release(vectors)
        out = found if out is None else out.unionByName(found)
    if out is None:
        ids = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {ids}, score long")
    return out


#: DuckDB SQL for the rows of `ranked_search` over `documents` and `benchmark`, k = 10.
SEARCH_SQL = r"""with words as (select row_number() over () r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws from documents),
    asked as (select row_number() over () b, item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws from benchmark),
    q as (select b, item_id, t, count(*) c from (select b, item_id, unnest(ws) t from asked) group by all),
    total as (select count(*) n_docs, sum(len(ws))::bigint n_all from words where len(ws) > 0),
    d as (select r, t, count(*) tf from (select r, unnest(ws) t from words) where t in (select t from q) group by all),
    w as (select t, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint w from d, total group by t),
    m as (select r, doc_id, 100 - 75 + (75 * len(ws) * n_docs) // n_all m from words, total),
    scored as (select b, item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
               from q join w using (t) join d using (t) join m using (r) group by b, item_id, doc_id, r),
    placed as (select *, row_number() over (partition by b order by score desc, doc_id nulls last) rank from scored where score > 0)
    select item_id, rank::int rank, doc_id, score from placed where rank <= 10"""
