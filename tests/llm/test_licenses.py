"""License scans against a plain search for phrases, notices with edits, and the SQL version."""

import random
import re
from pathlib import Path

import pytest

from labeltrail.llm.licenses import BASE, NOTICES, Template, license_spans, scan_licenses, scan_sql, template_words

SCHEMA = "doc_id long, text string, label string, k1 long, words string, score string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "w", "s") for i, t in zip(ids, texts)], SCHEMA)


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, t.label) for t in BASE for i in range(len(w)) if w[i:i + len(t.text.split())] == t.text.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def notice(label, words):
    return next(t.text for t in NOTICES if t.label == label and len(template_words(t.text)) > words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    pool = "cc by CC-BY general GENERAL public license rights reserved all é漢 of the and 4".split()
    out = [None, "", "  \n", "cc", "cc by", "cc by cc by cc", "All rights\nreserved. general public licenseé", "General--Public  License", "K cc\x00by cc_by cc`by"]
    out += [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(80)]
    out += [" ".join(rng.choice(pool) for _ in range(30_000)), "word " * 5_000 + "cc by"]
    return out + out[3:9]


def test_base_phrases(spark, texts):
    got = {r.doc_id: r for r in scan_licenses(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1 if r.n_base else r.score < 1)


def test_notices_with_edits(spark):
    rng = random.Random(2)
    mit, apache = notice("mit", 50), notice("apache-2.0", 50)
    words = mit.split()
    edited = words[:20] + ["really"] + words[20:40] + words[43:]
    half = words[:len(words) // 3]
    fill = lambda n: " ".join("x" + str(rng.randrange(900)) for _ in range(n))
    docs = [mit.upper(), fill(50) + " " + " ".join(edited) + " " + fill(9), " ".join(half), fill(300), mit + " " + fill(40) + " " + apache,
            " ".join(rng.sample(words, len(words)))]
    got = [scan_licenses(frame(spark, docs)).orderBy("doc_id").collect()][0]
    assert [r.labels for r in got] == ["mit", "mit", "", "", "apache-2.0,mit", ""]
    assert got[0].score == 1 and 0.6 <= got[1].score < 1 and got[2].score == 0 and all(r.n_base == 0 and r.first_word is None for r in got)
    spans = license_spans(frame(spark, [docs[1]])).collect()
    assert len(spans) == 1 and spans[0].start == 50 and spans[0]["last"] == 50 + len(template_words(" ".join(edited))) - 1


def test_own_templates_and_copies(spark):
    mine = [Template("own", "one two three four five six"), Template("pair", "a b", True)]
    docs = frame(spark, ["x one two three four five six a b", "one two three four five six one two three four five six"] * 20, [None, 7] * 20)
    got = scan_licenses(docs, mine, k=3, slack=1, coverage=0.9).collect()
    assert sorted((r.labels, r.n_base) for r in got) == [("own", 0)] * 20 + [("own,pair", 1)] * 20
    assert license_spans(docs, mine, k=3, slack=1, coverage=0.9).where("label = 'own'").count() == 3
    with pytest.raises(ValueError):
        scan_licenses(docs, [Template("bad", "one")])


def test_empty_table(spark):
    assert scan_licenses(frame(spark, [])).count() == 0


def test_query_equals_sql(spark, tmp_path, texts):
    duckdb = pytest.importorskip("duckdb")
    from labeltrail.llm.queries import QUERIES

    rows = texts + [notice("mit", 50), " ".join(notice("gpl", 50).split()[4:]), "Released under the MIT license. Licensed under CC BY 4.0, all rights reserved."]
    frame(spark, rows).write.parquet(str(Path(tmp_path) / "documents.parquet"))
    got = QUERIES["op12_licenses"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(scan_sql()).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
