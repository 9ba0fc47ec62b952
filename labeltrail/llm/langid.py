"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits.  One linear classifier over character n-grams is fitted per bit, and a text
gets the language whose codeword has the smallest loss against all margins, each bit weighted by its reliability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labeltrail.llm.common import text_of
from labeltrail.llm.tokens import LOWER, chunks

BUCKETS = 4096
UNDETERMINED = "und"


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed 1- to 3-byte n-gram shares (square roots, unit length) of each text; digits and marks count as a space."""
    n_rows, n = len(offsets) - 1, len(data)
    out = np.zeros((n_rows, BUCKETS), dtype=np.float32)
    if not n:
        return out
    plain = LOWER.copy()
    plain[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32
    code = plain[data].astype(np.int32)
    two = code[:-1] * 613 + code[1:]
    three = two[:-1] * 1021 + code[2:] * 7
    for r in range(n_rows):
        a, b = int(offsets[r]), int(offsets[r + 1])
        counts = np.bincount(code[a:b] % 256, minlength=BUCKETS)
        if b - a > 1:
            counts = counts + np.bincount(256 + (two[a:b - 1] * 40503 >> 7) % 1280, minlength=BUCKETS)
        if b - a > 2:
            counts = counts + np.bincount(1536 + (three[a:b - 2] * 40503 >> 9) % 2560, minlength=BUCKETS)
        counts[32] = 0
        root = np.sqrt(counts)
        out[r] = root / max(np.sqrt((root * root).sum()), 1e-9)
    return out


def codewords(n: int) -> np.ndarray:
    """n x bits of +1/-1: every split of up to 7 languages into two sides, else the best separated of seeded random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        bits = np.array([[(s >> i) & 1 for s in range(1, 2 ** (n - 1))] for i in range(n)])
        return bits * 2.0 - 1.0
    rng, best = np.random.default_rng(7), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


@dataclass
class OutputCodes:
    """Fitted bit classifiers: languages, their codewords, one weight column and reliability per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray
    margin: float = 0.02

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score between 0 and 1, ambiguous flag) per row, from loss-weighted decoding."""
        f = x @ self.weights + self.bias
        loss = np.stack([(self.reliability * np.maximum(0, 1 - row * f)).sum(axis=1) for row in self.code], axis=1) / self.reliability.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        rows = np.arange(len(x))
        gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]] if loss.shape[1] > 1 else np.ones(len(x))
        return order[:, 0], share[rows, order[:, 0]], gap < self.margin


def fit_codes(x: np.ndarray, names: list[str], ridge: float = 0.3) -> OutputCodes:
    """One ridge classifier per bit, solved in the space of the sample; reliability is its leave-one-out accuracy."""
    languages = sorted(set(names))
    code = codewords(len(languages))
    target = code[[languages.index(v) for v in names]]
    x = x.astype(np.float64)
    centre = x.mean(axis=0)
    inverse = np.linalg.inv((x - centre) @ (x - centre).T + ridge * np.eye(len(x)))
    mean = target.mean(axis=0)
    dual = inverse @ (target - mean)
    left_out = target - dual / np.diag(inverse)[:, None]
    accuracy = (np.sign(left_out) == np.sign(target)).mean(axis=0)
    weights = (x - centre).T @ dual
    return OutputCodes(languages, code, weights.astype(np.float32), (mean - centre @ weights).astype(np.float32), np.clip(2 * accuracy - 1, 0.01, 1))


def fit_language_codes(docs: DataFrame, learn_from: Column, per_language: int = 400, text_col: str = "text", lang_col: str = "lang") -> OutputCodes | None:
    """Fit on at most `per_language` texts of each language: those first by the hash of their text.

    Hashes are cut first and texts are read for the chosen ones only, so copies change nothing and no other text is shuffled.
    Only the sample's features reach the driver.  None without a row.
    """
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = rows.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    chosen = rows.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang", "h")  # at most per_language hashes a language
    found = chosen.mapInArrow(_features, "lang string, h long, x binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "h"])
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float16).reshape(len(found), BUCKETS).astype(np.float32)
    return fit_codes(x, found["lang"].tolist())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column("text")):
            x = ngram_features(data, offsets).astype(np.float16)
            part = batch.slice(first, end - first)
            yield pa.record_batch([part.column("lang"), part.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "h", "x"])


def predict_language(docs: DataFrame, model: OutputCodes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text.

    `und` with score 0 where the text is null or holds no letter, or no model could be fitted; ambiguous says that two
    codewords are about as near.  Empty tables give no rows; repeated rows and null ids pass through; only the id and
    the text are read, and only the text is used.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    source = source.withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    if model is None:
        return source.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                part = batch.slice(first, end - first)
                known = np.array(part.column("lettered").to_pylist(), dtype=bool)
                at, score, unsure = model.predict(ngram_features(data, offsets))
                yield pa.record_batch([
                    part.column("doc_id"), pa.array(names[np.where(known, at, len(model.languages))], pa.string()),
                    pa.array(np.where(known, score, 0.0).astype(float)), pa.array(unsure | ~known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
