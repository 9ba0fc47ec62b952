"""A classifier chain over toxicity categories.

The categories are predicted in order by linear models over word presence.  Each later model also sees the
probabilities of the earlier categories; while it is fitted these come from folds that held the row out, as they will
be for unseen documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.common import text_of

WORD = re.compile(r"\w+")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 8, inner: int = 12) -> np.ndarray:
    """Weights, the intercept last and all but unpenalised: Newton steps, each solved by conjugate gradients."""
    xb = np.c_[x, np.ones(len(x))].astype(np.float32)
    w = np.zeros(xb.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        p = sigmoid(xb @ w.astype(np.float32))
        v = np.maximum(p * (1 - p), 1e-6)
        rest = xb.T @ (y - p).astype(np.float32) - penalty * w
        if np.abs(rest).max() < 1e-3:
            break
        step, way, size = np.zeros_like(w), rest.copy(), rest @ rest
        for _ in range(inner):
            bent = xb.T @ (v * (xb @ way.astype(np.float32))).astype(np.float32) + penalty * way
            move = size / (way @ bent)
            step, rest = step + move * way, rest - move * bent
            size, last = rest @ rest, size
            if size < 1e-8:
                break
            way = rest + size / last * way
        w = w + step
    return w


@dataclass
class Chain:
    """Fitted chain: word -> column, and for each category its weights over the words, the earlier ones and 1."""

    categories: list[str]
    words: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        """rows x categories from the columns present in each row."""
        n = len(self.words)
        flat = np.array([c for row in found for c in row], dtype=np.int64)
        rows = np.repeat(np.arange(len(found)), [len(r) for r in found])
        out = np.zeros((len(found), len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(rows, weights=w[flat], minlength=len(found)) if len(flat) else np.zeros(len(found))
            out[:, k] = sigmoid(z + out[:, :k] @ w[n:n + k] + w[-1])
        return out


def words_of(text: str) -> set[str]:
    """The distinct words of a whole text, in small letters."""
    return set(WORD.findall(text.lower()))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the cut of best F(1/2), precision counting double, over held-out probabilities; at least 0.15, 0.5 if a class is absent."""
    if y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    worth = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    at = int(np.argmax(worth))
    ranked = p[order]
    return max(0.15, float((ranked[at] + (ranked[at + 1] if at + 1 < len(ranked) else 0.0)) / 2))


def fit_chain(rows: list[set[str]], labels: np.ndarray, categories: list[str], max_words: int = 600, folds: int = 5, ridge: float = 0.3) -> Chain:
    """Choose words, then fit the categories in order with held-out probabilities of the earlier ones.

    The words kept are those most tied to some category by the chi-square of presence, ties by word.
    """
    if len(rows) == 0:
        return Chain(categories, {}, [np.zeros(k + 1) for k in range(len(categories))], [0.5] * len(categories))
    seen: dict[str, int] = {}
    cells = np.fromiter((seen.setdefault(w, len(seen)) for row in rows for w in sorted(row)), np.int64)
    at = np.c_[np.repeat(np.arange(len(rows)), [len(row) for row in rows]), cells]
    total = np.bincount(at[:, 1], minlength=len(seen)).astype(float)
    n, worth = len(rows), np.zeros(len(seen))
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        inside = np.bincount(at[:, 1], weights=y[at[:, 0]], minlength=len(seen))
        share = y.mean()
        worth = np.maximum(worth, (inside - total * share) ** 2 / np.maximum(total * share * (1 - share) * (1 - total / (n + 1)), 1e-9))
    names = np.array([*seen], dtype=object)
    able = np.flatnonzero(total >= 3)
    kept = able[np.lexsort((names[able].astype(str), -worth[able]))][:max_words] if len(able) else able
    column = {c: j for j, c in enumerate(kept.tolist())}
    x = np.zeros((n, len(kept)))
    place = np.full(len(seen), -1)
    place[kept] = np.arange(len(kept))
    used = place[at[:, 1]] >= 0
    x[at[used, 0], place[at[used, 1]]] = 1
    fold = np.arange(n) % folds
    chain, held = Chain(categories, {names[c]: j for c, j in column.items()}), np.zeros((n, 0))
    for k in range(len(categories)):
        y, xk = labels[:, k].astype(float), np.c_[x, held]
        out = np.full(n, y.mean())
        for f in range(folds):
            if (fold != f).any() and (fold == f).any():
                w = fit_logistic(xk[fold != f], y[fold != f], ridge)
                out[fold == f] = sigmoid(np.c_[xk[fold == f], np.ones((fold == f).sum())] @ w)
        chain.weights.append(fit_logistic(xk, y, ridge))
        chain.thresholds.append(_best_threshold(out, y))
        held = np.c_[held, out]
    return chain


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most `max_rows` labelled documents, those first by the hash of their id.

    `categories`: category -> SQL condition over the label columns, in chain order; a null condition leaves the row
    out.  Only the distinct words of the sample reach the driver.
    """
    flags = [F.expr(c).cast("int").alias(f"_y{k}") for k, c in enumerate(categories.values())]
    known = labels.select(F.col(id_col).alias("_id"), *flags).where(" and ".join(f"_y{k} is not null" for k in range(len(flags))))
    known = known.where("_id is not null").groupBy("_id").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(flags))])
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "_id")  # at most max_rows
    named = ["_id", *[f"_y{k}" for k in range(len(flags))]]

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([sorted(words_of(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([*[batch.column(c) for c in named], words], [*named, "words"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in named)
    table = rows.mapInArrow(distinct_words, kinds + ", words array<string>").toArrow()
    found = table.select(named).to_pandas()
    found = found.drop_duplicates("_id").sort_values("_id") if len(found) else found
    y = found[named[1:]].to_numpy().reshape(-1, len(flags))
    # rows share one text a word, else the driver holds one a word and row
    words = table.column("words").combine_chunks()
    coded, ends = words.flatten().dictionary_encode(), np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    del table, words, coded
    return fit_chain([{names[c] for c in codes[ends[i]:ends[i + 1]]} for i in found.index], y, list(categories))


def category_chances(chain: Chain, text_col: str = "text") -> Column:
    """A column with the array of category probabilities of each whole text, in chain order."""
    width = len(chain.categories)

    def score(texts: list[str | None]) -> np.ndarray:
        known, get = chain.words.keys(), chain.words.__getitem__
        return chain.probabilities([[*map(get, known & words_of(t))] if t else [] for t in texts])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p = [score(texts.slice(i, 500).to_pylist()) for i in range(0, len(texts), 500)]
            yield pa.FixedSizeListArray.from_arrays(pa.array(np.vstack([np.zeros((0, width)), *p]).ravel()), width).cast(pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(F.col(text_col))


def is_toxic(chances: Column, chain: Chain, text_col: str = "text") -> Column:
    """The last category passes its threshold; never for a text without a visible character."""
    return (F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0) & (chances[len(chain.categories) - 1] > chain.thresholds[-1])


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> for each category, toxic) of every whole text, without a shuffle.

    A null or empty text gets the probabilities of the intercepts and is never toxic.  Repeated rows and null ids pass
    through.  Empty table: no rows.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = source.withColumn("p", category_chances(chain))
    return scored.select("doc_id", *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)], is_toxic(F.col("p"), chain).alias("toxic"))


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns as they are, that the chain does not call toxic."""
    name = "_chances"
    while name in docs.columns:
        name = "_" + name
    return docs.withColumn(name, category_chances(chain, text_col)).where(~is_toxic(F.col(name), chain, text_col)).select(*[F.col(c) for c in docs.columns])
