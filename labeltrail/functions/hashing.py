"""Keyed SHA-256 values used for splits, shards, samples and bootstrap draws.

SHA-256 is chosen over Spark's own hash functions because another engine can
recompute it, so every sample and every draw can be audited outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def key_text(*parts, sep: str = "|") -> Column:
    """Join the parts into one hash key; a null part counts as empty text."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def sha_hex(text) -> Column:
    return F.sha2(_col(text), 256)


def u64(text) -> Column:
    """First 64 bits of SHA-256, as DECIMAL(20,0) (Spark has no unsigned long)."""
    return F.conv(F.substring(sha_hex(text), 1, 16), 16, 10).cast("decimal(20,0)")


def u60(text) -> Column:
    """First 60 bits of SHA-256 as a BIGINT: cheap modulo and ordering."""
    return F.conv(F.substring(sha_hex(text), 1, 15), 16, 10).cast("bigint")


def unit_interval(text) -> Column:
    """First 64 bits of SHA-256 scaled to [0, 1)."""
    return u64(text).cast("double") / F.lit(TWO_64)


def bucket(text, n: int) -> Column:
    """Stable bucket number in 0..n-1."""
    return F.pmod(u60(text), F.lit(n)).cast("int")


def bucket64(text, n: int) -> Column:
    """Bucket number from all 64 leading hash bits."""
    return F.pmod(u64(text), F.lit(n).cast("decimal(20,0)")).cast("int")


def stable_split(group, seed: int, namespace: str) -> Column:
    """train/validation/test at 70/15/15 of the group's hash; unassigned groups stay apart."""
    g = _col(group)
    named = split_by_share(key_text(seed, namespace, g), [("train", 0.70), ("validation", 0.15), ("test", 0.15)])
    return F.when(g.isNull() | (g == "") | (g == "UNASSIGNED"), "UNASSIGNED").otherwise(named)


def split_by_share(text, shares: list[tuple[str, float]]) -> Column:
    """Named split by cumulative shares of the unit interval; last name takes the rest."""
    x = unit_interval(text)
    out, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        cond = x < F.lit(round(edge, 12))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    last = shares[-1][0]
    return F.lit(last) if out is None else out.otherwise(last)
