"""Hashes made by whole blocks equal hashlib's."""

import hashlib

import numpy as np

from labeltrail.functions import digests
from labeltrail.operators import draws, resample


def one(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big") >> 4


def test_numbers_of_any_length_and_place():
    n = digests.FEW + 7
    for head, first, last, tail in ((b"boot|1999|", 0, 120_000, b""), (b"", 99_990, 100_000 + n, b"|x"), (b"a" * 50, 0, n, b""), (b"a" * 55, 0, n, b""),
                                    (b"flip|", 9_000, 10_000 + n, b"|1.000000000|3"), (b"q", 10**12 - n, 10**12 + n, b""), (b"q", 5, 5, b"")):
        want = np.array([one(b"%b%d%b" % (head, i, tail)) for i in range(first, last)], np.int64)
        assert (digests.numbered(head, first, last, tail) == want).all()


def test_few_texts_go_through_hashlib(monkeypatch):
    many = digests.numbered(b"a|", 0, 9_000)
    monkeypatch.setattr(digests, "FEW", 1 << 60)
    assert (digests.numbered(b"a|", 0, 9_000) == many).all()


def test_keys_of_mixed_lengths():
    keys = [str(i * 7).encode() for i in range(40_000)] + [b"", "é".encode(), b"x" * 80]
    want = np.array([one(b"perm|3|" + k) for k in keys], np.int64)
    assert (digests.Keys(keys).first60(b"perm|3|") == want).all()


def test_draws_of_a_large_set_are_hashed_by_blocks(monkeypatch):
    """A replicate of a large set takes few calls of hashlib; before it took one a draw."""
    calls = []
    plain = digests._plain
    monkeypatch.setattr(digests, "_plain", lambda texts: calls.append(len(texts)) or plain(texts))
    counts = draws._drawn(b"boot|7|", 60_000)
    drawn = np.array([one(b"boot|7|%d" % i) % 60_000 for i in range(60_000)])
    assert (counts == np.bincount(drawn, minlength=60_000)).all()
    assert sum(calls) < 12_000


def test_sign_flips_hash_a_block_once_for_all_groups(spark):
    """Blocks are not multiplied by groups and replicates; zeros, no rows and one group keep their results."""
    df = spark.createDataFrame([(g, float(d % 5 - 1)) for g in ("a", "b", "c") for d in range(200)] + [("z", 0.0)], "g string, d double")
    out = resample.sign_flip_test(df, "d", 400, "x", ["g"])
    assert "sha2" not in out._jdf.queryExecution().toString()
    got = {r.g: (r.n, r["mean"], r.exceed, r.p_value) for r in out.collect()}
    assert got["a"] == got["b"] == got["c"]
    assert got["z"] == (1, 0.0, 400, 1.0)
    sums = np.zeros(400)
    for size, rows in ((1.0, 80), (2.0, 40), (3.0, 40)):
        for b in range(-(-rows // 60)):
            m = min(rows - 60 * b, 60)
            h = [one(f"x|{r}|{size:.9f}|{b}".encode()) & ((1 << m) - 1) for r in range(400)]
            sums += size * np.array([2 * v.bit_count() - m for v in h])
    assert got["a"][2] == int((np.abs(sums) >= 200).sum())
    empty = resample.sign_flip_test(df.where("g = 'none'"), "d", 400, "x").first()
    assert (empty.n, empty.exceed) == (None, 0)


def test_permuted_labels_pass_no_clusters_through_the_driver(spark, monkeypatch):
    """The cut of every replicate is exact from the lists near it, and where it lies outside of them from the whole sort."""
    rows = spark.createDataFrame([(c, int(c % 7 == 0), float((c * 37) % 101)) for c in range(500) for _ in range(1 + c % 3)], "c long, d int, p double")
    data = [(c, int(c % 7 == 0), float((c * 37) % 101)) for c in range(500) for _ in range(1 + c % 3)]
    score = np.array([x[2] for x in data])
    rank = np.array([(score < v).sum() + ((score == v).sum() + 1) / 2 for v in score])

    def auc(chosen):
        at = np.array([x[0] in chosen for x in data])
        a = (rank[at].sum() - at.sum() * (at.sum() + 1) / 2) / (at.sum() * (~at).sum())
        return round(max(a, 1 - a), 9)

    observed, ones = auc({c for c in range(500) if c % 7 == 0}), len(range(0, 500, 7))
    drawn = [auc(set(sorted(range(500), key=lambda c: (one(f"x|{r}|{c}".encode()), str(c)))[:ones])) for r in range(60)]
    want = (observed, sum(a >= observed for a in drawn))
    kind, seen = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    monkeypatch.setattr(resample, "CLUSTERS", 100)
    for spread in (8.0, 0.2, 0.0):
        monkeypatch.setattr(resample, "SPREAD", spread)
        r = resample.cluster_label_permutation(rows, "c", "d", "p", 60, "x").first()
        assert (r.auc, r.exceed) == want, spread
    assert max(len(s) for s in seen) < 10
