"""Ranked search against a plain scoring of every document and against SQL."""

import collections
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

from labeltrail.llm import lexical
from labeltrail.llm.lexical import Best, Item, Tree, ranked_search

DOC = "doc_id long, text string, rank string, number long, score string, n string, terms string"
ITEM = "item_id long, text string, doc_id string, n string"


def docs_frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "s", "n", "t") for i, t in zip(ids, texts)], DOC)


def items_frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "d", "n") for i, t in zip(ids, texts)], ITEM)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, ids, items, k=10):
    docs = [collections.Counter(terms_of(t)) for t in texts]
    sizes = [sum(d.values()) for d in docs]
    n_docs, n_all = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for d in docs for t in d)
    out = []
    for item in items:
        found = []
        for i, d, n in zip(ids, docs, sizes):
            score = 0
            for t in terms_of(item):
                if t in d:
                    m = 100 - 75 + (75 * n * n_docs) // n_all
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * d[t]) // (1000 * d[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out.append([(r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])])
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "漢字", "7", "Mixed"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(3, 64)]) for _ in range(n))
    texts = [None, "", "...", "é", "mixed MIXED É", text(30_000)] + [text(rng.randrange(1, 120)) for _ in range(250)]
    copied = text(70)
    texts += [copied] * 150 + [copied + " w1"] * 40 + ["w0 w1 w2"] * 90
    ids = [None] + rng.sample(range(10_000), len(texts) - 2)
    ids.insert(9, ids[8])
    items = [copied, None, "", "!!", "w0 w0 W1", "nowhere", "漢字 É é Mixed", text(200), "w3", texts[5][:400], "w0 w1 w2 nowhere", text(15)]
    return texts, ids, items


def rows_by_item(frame):
    out = collections.defaultdict(list)
    for r in frame.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [(64, 8_000_000, 1024), (3, 700, 2)])
def test_every_document_is_scored_alike(spark, corpus, sizes, monkeypatch):
    texts, ids, items = corpus
    for name, value in zip(("LEAF", "TREE_CELLS", "BLOCK_ITEMS"), sizes):
        monkeypatch.setattr(lexical, name, value)
    got = rows_by_item(ranked_search(docs_frame(spark, texts, ids).repartition(3), items_frame(spark, items)))
    want = plain(texts, ids, items)
    assert got == {i: w for i, w in enumerate(want) if w}


def test_trees_of_all_shapes():
    rng = np.random.default_rng(3)
    for n, leaf in ((1, 4), (5, 4), (90, 1), (400, 7), (300, 64)):
        docs = [np.sort(rng.choice(40, rng.integers(0, 25) if n < 300 else rng.integers(0, 6), replace=False)) for _ in range(n)]
        docs += [np.arange(30)] * (n // 3) + [np.arange(j) for j in range(20)]
        tf = [rng.integers(1, 9, len(d)) for d in docs]
        m, ids = rng.integers(25, 400, len(docs)), rng.permutation(len(docs))
        old, lexical.LEAF = lexical.LEAF, leaf
        try:
            tree = Tree(np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(tf), m, [(False, int(i)) for i in ids], 40)
        finally:
            lexical.LEAF = old
        assert sorted(tree.place.tolist()) == list(range(len(docs)))
        weights = rng.integers(0, 7000, 5)
        item = Item(0, 0, rng.choice(40, 5, replace=False), np.array([1, 2, 1, 1, 3]))
        best = Best(6)
        tree.search(item, weights, best)
        score = [sum(int(w * c) * ((10**9 * int(f[d == t][0])) // (1000 * int(f[d == t][0]) + 8 * int(mm))) for t, w, c in zip(item.terms, weights, item.counts) if t in d)
                 for d, f, mm in zip(docs, tf, m)]
        assert best.rows == sorted((-s, (False, int(i))) for s, i in zip(score, ids) if s > 0)[:6]


def test_empty_tables_and_equal_items(spark):
    some, asked = docs_frame(spark, ["a b", "b c"]), items_frame(spark, ["b", "b"], [7, 7])
    assert ranked_search(docs_frame(spark, []), asked).count() == 0
    assert ranked_search(some, items_frame(spark, [])).count() == 0
    assert ranked_search(docs_frame(spark, [None, ""]), asked).count() == 0
    assert sorted(map(tuple, ranked_search(docs_frame(spark, ["a b", "c", "c"]), asked).select("item_id", "rank", "doc_id").collect())) == [(7, 1, 0), (7, 1, 0)]
    assert ranked_search(docs_frame(spark, ["a", "a"], [3, 3]), items_frame(spark, ["a"])).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql(spark, tmp_path, corpus):
    duckdb = pytest.importorskip("duckdb")
    from labeltrail.llm.queries import ORACLES, QUERIES

    texts, _, items = corpus
    docs_frame(spark, texts).write.parquet(str(Path(tmp_path) / "documents.parquet"))
    items_frame(spark, items).write.parquet(str(Path(tmp_path) / "benchmark.parquet"))
    got = QUERIES["op11_search"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["op11_search"]).fetchall())
