"""Fuzzy line deduplication in built-in expressions: MinHash bands, exact Jaccard, components, one line kept per component.

The shingles of a line are its runs of `size` characters, one from every character on; a shorter line is one shingle.  Their
hashes fall into twelve classes; the least of each class is a signature value that two lines share with the chance of their Jaccard similarity, and two
neighbouring classes form a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.buckets import bucket_links, shared_buckets, within_difference
from labeltrail.llm.common import release, staged, text_of

CLASSES = 12
#: White space; a line of nothing else is blank, and lines are compared without it at their ends.
WHITE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Longs of the odd sketch that rules pairs out exactly.
ODD = [f"odd{i}" for i in range(16)]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, at, line, node): every line with more than white space, trimmed; node is its hash, mark the text's checksum."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.crc32(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(WHITE))).where("line <> ''")
    return rows.withColumn("node", F.xxhash64("line"))


def shingle_hashes(line: Column, size: int) -> Column:
    """Distinct hashes of the runs of `size` characters that begin at any character; a shorter line is one run.

    Characters of four bytes make a run a slice of known place, so a line of any length costs one pass.
    """
    def runs(data: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(data) - 4 * size, F.lit(0)) + 1, F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(data, i, F.lit(4 * size))))

    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), runs)))  # encoded once a line


def _bands(lines: DataFrame, size: int) -> DataFrame:
    """(key, node, n) for each band of each distinct line of a row; n is the number of its shingles.

    A band with one value is keyed together with the next value of the line, so that a single common shingle never makes a key.
    """
    # a class is a range of hashes; its least hash follows its border in order
    borders = [-(1 << 63) + c * (1 << 64) // CLASSES for c in range(CLASSES)]
    rows = lines.select("node", shingle_hashes(F.col("line"), size).alias("s"))
    rows = rows.select("node", F.size("s").alias("n"), F.sort_array(F.concat("s", F.array(*[F.lit(b) for b in borders]))).alias("p"))
    after = [F.get("p", F.array_position("p", F.lit(b))) for b in borders]
    least = [F.when(v < b, v) for v, b in zip(after, borders[1:])] + [after[-1]]
    rows = rows.select("node", "n", *[v.alias(f"m{c}") for c, v in enumerate(least)])
    m = [F.col(f"m{c}") for c in range(CLASSES)]

    def key(c: int) -> Column:
        one, two = m[c], m[c + 1]
        following = F.coalesce(*m[c + 2:], *m[:c + 2])
        return F.when(one.isNotNull() | two.isNotNull(), F.xxhash64(F.coalesce(one, two), F.when(one.isNotNull() & two.isNotNull(), two).otherwise(following)))

    return rows.select("node", "n", F.explode(F.array(*[key(c) for c in range(0, CLASSES, 2)])).alias("key")).where("key is not null")


def odd_sketches(lines: DataFrame, size: int) -> DataFrame:
    """(node, odd...) of distinct lines: an odd sketch of their shingles."""
    hashes = lines.select("node", F.explode(shingle_hashes(F.col("line"), size)).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(63).cast("int"))
    place = F.pmod(F.shiftrightunsigned("h", 6), F.lit(len(ODD)))
    return hashes.groupBy("node").agg(*[F.coalesce(F.bit_xor(F.when(place == i, bit)), F.lit(0).cast("bigint")).alias(c) for i, c in enumerate(ODD)])


def duplicate_lines(docs: DataFrame, size: int = 12, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, removed): positions of the lines that repeat, or nearly repeat, an earlier line; mark is the text's checksum.

    Lines are linked if the Jaccard similarity of their shingle sets is at least `similarity`; of each component the first line
    by (id, checksum, position) stays.  Equal lines are one node from the start.
    """
    lines = _lines(docs, id_col, text_col)
    buckets = shared_buckets(_bands(lines, size).distinct())
    wanted = buckets.select("node").distinct()
    texts = staged(lines.select("node", "line").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "lines")
    sketched = staged(buckets.join(odd_sketches(texts, size), "node"), "sketched")
    release(buckets)

    def alike(a: Column, b: Column) -> Column:
        n = F.size(a) + F.size(b)
        fit = F.least(F.size(a), F.size(b)) >= similarity * F.greatest(F.size(a), F.size(b))
        return fit & F.exists(F.array(F.size(F.array_intersect(a, b))), lambda inside: inside >= similarity * (n - inside))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
        sets = F.struct(shingle_hashes(F.col("la"), size).alias("a"), shingle_hashes(F.col("lb"), size).alias("b"))
        return both.where(F.exists(F.array(sets), lambda s: alike(s["a"], s["b"]))).select("a", "b")  # each set is made once

    _, component = bucket_links(sketched, lambda pairs: pairs, verified, lambda a, b: within_difference(a, b, "n", ODD, similarity))
    rows = lines.select("doc_id", "mark", "at", "node").join(component.withColumnRenamed("component", "c"), "node", "left").select("doc_id", "mark", "at", F.coalesce("c", "node").alias("c"))
    place = F.struct("doc_id", "mark", "at")
    first = rows.groupBy("c").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(first, "c").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def _free(names: list[str], stem: str) -> str:
    """A column name that is not among `names`."""
    while stem in names:
        stem = "_" + stem
    return stem


def _rebuilt(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """`docs` with the text less its repeated lines and an extra last column with their positions; the counts of lines and of removed ones."""
    gone = duplicate_lines(docs, size, similarity, id_col, text_col).select(F.struct("doc_id", "mark").alias("k"), "removed")
    key, removed = _free(docs.columns, "_key"), _free(docs.columns, "_removed")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), F.crc32(text_of(text_col)).alias("mark")))
    gone = gone.withColumnsRenamed({"k": key, "removed": removed})
    both = keyed.join(gone, keyed[key].eqNullSafe(gone[key]), "left").select(*[keyed[c] for c in docs.columns], gone[removed])
    parts = F.split(F.col(text_col), "\n")
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(removed), i)), "\n"))
    n_removed = F.greatest(F.coalesce(F.size(removed), F.lit(0)), F.lit(0))
    # lines of the rebuilt text and the removed ones; without a line left there is none to count
    n_left = F.when(F.col(text_col).isNull(), 0).when((F.col(text_col) == "") & (n_removed > 0), 0).otherwise(F.size(parts))
    return both.withColumn(text_col, text), n_left + n_removed, n_removed


def dedup_lines(docs: DataFrame, size: int = 12, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text less its repeated lines, and the columns n_lines and n_removed.

    Blank lines, of white space alone, are never removed; white space at the ends of a line is not compared.  A null text stays null, an empty one empty, with 0 removed.  Texts whose every line
    goes become empty.  Rows repeated whole are one document and keep the same lines; null ids come first in the order of lines.
    Empty table: no rows.  Columns of `docs` named n_lines or n_removed are replaced.
    """
    out, n_lines, n_removed = _rebuilt(docs, size, similarity, id_col, text_col)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def without_repeated_lines(docs: DataFrame, size: int = 12, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs`; documents that had lines and lost all of them go, all others stay."""
    out, _, n_removed = _rebuilt(docs, size, similarity, id_col, text_col)
    return out.where(~((n_removed > 0) & (F.btrim(F.col(text_col), F.lit(WHITE + "\n")) == ""))).select(*docs.columns)
