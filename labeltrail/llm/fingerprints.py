"""Document fingerprints by consistent weighted sampling, in built-in expressions only.

Every word is a term weighted by its count.  For sample k a term of weight w draws r and c from Gamma(2, 1) and b from [0, 1) by
its hash, and takes t = floor(ln w / r + b) and a value ln c - r (t - b + 1).  The sample is the (term, t) of the least value.
Two texts agree in a sample with the chance of their generalised Jaccard similarity: the sum over terms of the smaller
weight, over the sum of the greater.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labeltrail.llm.common import partitions, text_of

LEVELS = 4096


def gamma_levels(like: DataFrame, log: bool) -> Column:
    """The middles of LEVELS equally likely classes of Gamma(2, 1) (or their logarithms), as a scalar subquery.

    Class i has 1 - (1 + x) exp(-x) = (i + 1/2) / LEVELS, solved by Newton steps on the logarithm of x.
    """
    want = (F.col("id") + 0.5) / F.lit(float(LEVELS))

    def step(z: Column, _: Column) -> Column:
        x = F.exp(z)
        move = (1 - (1 + x) * F.exp(-x) - want) / (x * x * F.exp(-x))
        return z - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))

    z = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), step)
    levels = like.sparkSession.range(LEVELS).select("id", (z if log else F.exp(z)).alias("x"))
    return levels.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]).alias("levels")).scalar()


def signatures(texts: DataFrame, keys: list[str], samples: int = 64) -> DataFrame:
    """keys and `signature`, an array of `samples` values below 65536, of each row's column `text`; rows without a word give none.

    `keys` tell rows apart.  If `texts` is already partitioned by some of them, nothing is shuffled.
    """
    plain = F.replace(F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    words = texts.select(*keys, F.explode(F.split(plain, " ")).alias("word")).where("word <> ''")
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("weight"))
    terms = terms.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("lnw"),
                         gamma_levels(texts, log=False).alias("gamma"), gamma_levels(texts, log=True).alias("log_gamma"))

    def least(k: int) -> Column:
        h = f"xxhash64(term, {k})"
        r = f"get(gamma, cast({h} & {LEVELS - 1} as int))"
        c = f"get(log_gamma, cast(shiftrightunsigned({h}, 12) & {LEVELS - 1} as int))"
        b = f"(cast(shiftrightunsigned({h}, 32) as double) / 4294967296D)"
        t = f"floor(lnw / {r} + {b})"
        value = f"cast(({c} - {r} * ({t} - {b} + 1) + 64) * 8589934592D as bigint)"  # 39 bits
        mark = f"((shiftrightunsigned({h}, 40) ^ ({t} * 7919)) & 8388607)"  # 23 bits
        return F.expr(f"min(shiftleft({value}, 23) | {mark})")

    found = terms.groupBy(*keys).agg(*[least(k).alias(f"m{k}") for k in range(samples)])
    return found.select(*keys, F.expr(f"array({', '.join(f'cast(pmod(xxhash64(m{k}), 65536) as int)' for k in range(samples))})").alias("signature"))


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a sample; empty without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 if neither text has a word, 0 if only one has."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal).cast("double")


def _bucketed(source: DataFrame, n: int) -> DataFrame:
    """Adds `bucket`: about n ranges of ids of about equal row counts; a greater id never has a smaller bucket."""
    steps = max(1, math.ceil(math.log2(max(n, 2))))
    shares = [i / 2**steps for i in range(1, 2**steps)]
    bounds = source.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", shares, 0.25 / 2**steps)
    bounds = bounds or [0.0] * len(shares)
    # a binary search over the bounds, one step a halving
    jumps = F.array(*[F.lit(2 ** (steps - 1 - i)) for i in range(steps)])
    table, at = F.lit(np.array(bounds, dtype=float)), F.col("doc_id").cast("double")
    found = F.aggregate(jumps, F.lit(0), lambda low, jump: low + F.when(F.get(table, low + jump - 1) <= at, jump).otherwise(0))
    return source.withColumn("bucket", found)


def edited_fingerprints(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text",
                        edited_as: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last third comes from the next document.

    Returns (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next); `edited_as` maps the edited text to
    what is returned of it, as a digest is far less to move.  The next document is the one
    before in id order, after the least id the greatest; rows with one id are ordered by the hash of their text.  Null ids come
    after all others.

    Ids are cut into ranges; a window inside each range gives the next text, and the greatest row of each range serves the range
    above it, so no window spans the table.  Texts are shuffled once, by range; terms and samples are aggregated where they are.

    Null and empty texts count as texts without words: no samples, fingerprint "" and likeness 1 to each other, 0 to all
    else.  A lone document is its own next.  Empty table: no rows.  Other columns are not read.
    """
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n = 4 * partitions(docs)
    source = _bucketed(source, n)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]

    # the greatest row of each range: one row a range
    heads = source.groupBy("bucket").agg(F.max(F.struct("doc_id", "h", "text")).alias("head")).select("bucket", F.col("head.text").alias("text"))
    marks = signatures(heads, ["bucket"], samples).withColumnRenamed("bucket", "from")
    below = Window.orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lag("bucket").over(below), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("from"))
    after = after.join(heads.select(F.col("bucket").alias("from"), F.col("text").alias("after")), "from").join(
        marks.withColumnRenamed("signature", "after_signature"), "from", "left").drop("from")

    inside = Window.partitionBy("bucket").orderBy(*order)
    # as many partitions as ranges: the terms of one range fit a task's memory
    rows = source.repartition(n, "bucket").withColumns({"place": F.row_number().over(inside), "next": F.lead("text").over(inside)})
    rows = rows.join(after.select("bucket", "after"), "bucket")
    tail = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - tail), F.substring(F.coalesce("next", "after"), F.lit(1), tail))
    rows = rows.select("bucket", "place", "doc_id", "text", edited.alias("edited"))
    both = rows.select("bucket", "place", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
                                                            F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    found = signatures(both.select("bucket", "place", "x.which", "x.text"), ["bucket", "place", "which"], samples)
    found = found.groupBy("bucket", "place").agg(F.max(F.when(F.col("which") == 0, F.col("signature"))).alias("own"),
                                                 F.max(F.when(F.col("which") == 1, F.col("signature"))).alias("new"))
    out = rows.select("bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), edited_as(F.col("edited")).alias("edited")).join(found, ["bucket", "place"], "left")
    by_place = Window.partitionBy("bucket").orderBy("place")
    out = out.withColumns({"last": F.lead("place").over(by_place).isNull(), "following": F.lead("own").over(by_place)})
    out = out.join(after.select("bucket", "after_signature"), "bucket")
    following = F.when(F.col("last"), F.col("after_signature")).otherwise(F.col("following"))
    return out.select("doc_id", "n_chars", "edited", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), following).alias("near_next"))
