"""Cases that once crashed or gave wrong results, and the tests that pairs go through before they are compared."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import frame, prose


def test_blank_lines_stay(spark):
    from labeltrail.llm.line_dedup import dedup_lines, without_repeated_lines

    texts = ["first line of text\r\n\r\nsecond one\r\n\r\nthird", "a\n\t\nb\n\t\n\xa0\nc\n　", "\r\n\r\n", "solitary words stand here\r\nx", "solitary words stand here\ny"]
    out = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    assert [out[i].n_removed for i in range(5)] == [0, 0, 0, 0, 1] and [out[i].text for i in range(3)] == texts[:3] and out[4].text == "y"
    assert without_repeated_lines(frame(spark, texts)).count() == 5


def test_rows_of_one_id_are_told_apart(spark):
    from labeltrail.llm.repeats import remove_repeats

    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij") for _ in range(2000))
    mark = zlib.crc32(long.encode()) & 65535
    short = next(s for s in (f"{i:017d}" for i in range(10**7)) if zlib.crc32(s.encode()) & 65535 == mark)
    out = remove_repeats(frame(spark, [long, short, long], [7, 7, 8]), length=200, keep_first=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in out) == [(7, 17, 0), (7, 2000, 2000), (8, 2000, 2000)]
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, [long]), length=40_000)


def test_matches_of_a_long_table_of_numbers(spark):
    from labeltrail.llm.pii import STRICT, candidates, matches

    rng = random.Random(2)
    text = "\n".join(" ".join(f"{rng.randrange(1000):03d}.{rng.randrange(10)}" for _ in range(10)) + ";" for _ in range(5000))
    began = time.time()
    found = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), STRICT["card"]).alias("m")).first().m
    assert len(found) == 50_000 and all(text[m.start:m.start + len(m.value)] == m.value for m in found[::997]) and time.time() - began < 20
    odd = spark.createDataFrame([("write to john at example.com or jane (at) corp dot org",), ("fe80:1:2:3:4:5:6:7",)], "text string")
    assert {r.value for r in candidates(odd, "text", []).collect()} >= {"john at example.com", "jane (at) corp dot org", "fe80:1:2:3:4:5:6:7"}


def test_odd_sketches_never_rule_out_a_link(spark):
    from labeltrail.llm.buckets import within_difference
    from labeltrail.llm.hyperminhash import ODD, sketches
    from labeltrail.llm import line_dedup

    rng, texts = random.Random(6), []
    for n in (20, 60, 300, 3000):
        words = prose(rng, n, 5000).split()
        for changes in (0, 1, n // 40, n // 20, n // 10, n // 3):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(n)] = "z" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    sets = [{tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    lines = [{t[i:i + 12] for i in range(max(len(t) - 11, 1))} for t in texts]
    s = sketches(frame(spark, texts), 2, "doc_id", "text").select("doc_id", "n", *ODD)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, line string")
    o = line_dedup.odd_sketches(rows, 12).withColumnRenamed("node", "doc_id").join(spark.createDataFrame([(i, len(x)) for i, x in enumerate(lines)], "doc_id long, n long"), "doc_id")
    for frame_, columns, every in ((s, ODD, sets), (o, line_dedup.ODD, lines)):
        a, b = frame_.alias("a"), frame_.alias("b")
        ok = within_difference(lambda c: F.col("a." + c), lambda c: F.col("b." + c), "n", columns, 0.8)
        kept = {(r[0], r[1]) for r in a.join(b, F.col("a.doc_id") < F.col("b.doc_id")).where(ok).select("a.doc_id", "b.doc_id").collect()}
        alike = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 5 * len(every[i] & every[j]) >= 4 * len(every[i] | every[j])}
        assert alike <= kept and len(kept) < len(texts) ** 2 / 8


def test_wrappers_of_queries(spark):
    """Columns and types of each contract."""
    from labeltrail.llm.queries import QUERIES

    want = {
        "op1_line_dedup": "doc_id bigint, n_lines int, n_removed int, kept_sha256 string",
        "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op10_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"}
    for name, columns in want.items():
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert ", ".join(" ".join(c) for c in out.dtypes) == columns and out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_near_duplicates_equal_brute_force_on_the_table(spark):
    from labeltrail.llm.hyperminhash import near_duplicates
    from tests.llm.test_operators import components, word_sets

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    sets = dict(zip((r.doc_id for r in rows), word_sets([r.text for r in rows], 2).values()))
    want = components(sets, 80)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 2, 80).collect()} == want and len(set(want.values())) < len(want)
