"""Each text operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, seed long, start long, word string"


def frame(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", None, "x", 1, 2, "w") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join("w" + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    long = prose(rng, 20_000)
    base = prose(rng, 120)
    return [None, "", " \n\t ", "é", "one", long, long, base, base, base.replace("w1 ", "v1 ", 1), "a\nb\na", "ß漢😀 <|endoftext|> 12"]


def test_empty_tables(spark):
    from labeltrail.llm import bpe, decontamination, fingerprints, hyperminhash, langid, line_dedup, pii, repeats, sharding, toxicity
    from labeltrail.llm.queries import TOXICITY, vocabulary_path

    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(none, labels, TOXICITY)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (sharding.shard_by_bytes(none), bpe.encode_decode(none, vocabulary_path()), hyperminhash.near_duplicates(none), line_dedup.dedup_lines(none),
                repeats.remove_repeats(none), decontamination.contaminated(none, items), toxicity.score_toxicity(none, chain),
                langid.predict_language(none, langid.fit_language_codes(none, F.lit(True))), pii.find_personal(none, pii.fit_redactor(none)),
                fingerprints.edited_fingerprints(none, samples=4)):
        assert out.count() == 0


def test_shards(spark, odd_texts):
    from labeltrail.llm.sharding import shard_by_bytes

    ids = [None, 5, 5, *range(10, 10 + len(odd_texts) - 3)]
    out = shard_by_bytes(frame(spark, odd_texts, ids), 3).toPandas()
    size = sorted(len((t or "").encode()) + 1 for t in odd_texts)
    assert sorted(out["size"]) == size and len(out) == len(odd_texts)
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    by_shard = out.groupby("shard")["size"].sum()
    assert all(abs(b - sum(size) / 3) <= 2 * max(size) for b in by_shard)
    known = out[out.doc_id.notna()].sort_values("doc_id")
    assert known["shard"].is_monotonic_increasing


def test_bpe_equals_the_library(spark, odd_texts):
    tokenizers = pytest.importorskip("tokenizers")
    from labeltrail.llm.bpe import Vocabulary, encode_decode
    from labeltrail.llm.queries import vocabulary_path

    theirs = tokenizers.Tokenizer.from_file(vocabulary_path())
    for r in encode_decode(frame(spark, odd_texts), vocabulary_path()).collect():
        ids = theirs.encode(odd_texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == theirs.decode(ids, skip_special_tokens=False)
    ours, rng = Vocabulary.load(vocabulary_path()), random.Random(1)
    alphabet = "ab '’é　\x1c\x85\t\n\r  漢😀1²_-.<|endoftext|>'ll"
    for k in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) + ("x" * 900 if k == 7 else "") + "<|endoftext|>" * (k % 5 == 0)
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def word_sets(texts, k):
    out = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, odd_texts, k):
    from labeltrail.llm.hyperminhash import near_duplicates

    rng, texts = random.Random(k), list(odd_texts)
    for n in (3, 6, 9, 30, 200):
        words = prose(rng, n).split()
        for _ in range(14):  # families on both sides of the threshold
            copy = list(words)
            for _ in range(rng.randrange(1 + n // 12 + 1)):
                copy[rng.randrange(n)] = "z" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    want, sets = components(word_sets(texts, k), 80), word_sets(texts, k)
    for r in near_duplicates(frame(spark, texts), words_per_shingle=k, percent=80).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    null_id = near_duplicates(frame(spark, ["a b c", "a b c"], [None, 1]), k).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in null_id} == {(None, None, True), (1, 1, True)}


def test_repeats(spark):
    from labeltrail.llm.repeats import remove_repeats

    rng, length = random.Random(5), 60
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(40, 150))) for _ in range(6)]
    texts = [None, "", "x" * 400, shared[0], shared[0]]
    for _ in range(40):
        texts.append("".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(60))) for _ in range(6)))
    raw = [(t or "").encode() for t in texts]
    places = collections.defaultdict(list)
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            places[b[s:s + length]].append((i, s))
    for keep_first in (False, True):
        for r in remove_repeats(frame(spark, texts), length, keep_first).collect():
            b = raw[r.doc_id]
            gone = np.zeros(len(b), bool)
            for s in range(len(b) - length + 1):
                where = places[b[s:s + length]]
                if (min(where) < (r.doc_id, s)) if keep_first else len(where) > 1:
                    gone[s:s + length] = True
            runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
            assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), runs)
            assert bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()


def greedy_tiles(a, b, least):
    used_a, used_b, out = set(), set(), []
    while True:
        best, at = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best:
                    best, at = k, [(j, i)]
                elif k == best:
                    at.append((j, i))
        if best < least or not best:
            return sorted(out)
        for j, i in sorted(at):
            if not used_a & set(range(i, i + best)) and not used_b & set(range(j, j + best)):
                used_a |= set(range(i, i + best))
                used_b |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiles_equal_the_plain_search():
    from labeltrail.llm.decontamination import tiles

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(n))] for n in (14, 25))
        assert sorted(tiles(np.array(a, np.uint64), np.array(b, np.uint64), 2)) == greedy_tiles(a, b, 2)


def test_decontamination_catches_reordered_passages(spark):
    from labeltrail.llm.decontamination import contaminated

    rng = random.Random(4)
    item = prose(rng, 40, 10**6)
    w = item.split()
    turned = " ".join(w[20:]) + " filler words between. " + " ".join(w[:20]).upper()
    texts = [None, "", prose(rng, 50), prose(rng, 30) + " " + item + " " + prose(rng, 30), turned, " ".join(w[:10]), item]
    items = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (None, item, 1)], "item_id long, text string, doc_id long")
    out = {r.doc_id: r for r in contaminated(frame(spark, texts), items).collect()}
    assert set(out) == {3, 4, 6} and {r.item_id for r in out.values()} == {7}
    assert out[4].n_tiles == 2 and out[4].covered == 40 and out[3].coverage == 1.0


def test_decontamination_of_recurring_runs(spark):
    from labeltrail.llm.decontamination import contaminated

    item = "x x 1 " * 20
    items = spark.createDataFrame([(7, item), (8, "p q r s t u v w"), (8, "k l m n o k l m n o"), (8, prose(random.Random(1), 100, 10**6))], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in contaminated(frame(spark, ["before " + item + "after", "x x 1 x x 1", "some k l m n o k l m n o"]), items).collect()}
    assert set(out) == {(0, 7), (2, 8)} and (out[0, 7].covered, out[0, 7].item_words, out[0, 7].coverage) == (60, 60, 1.0)


def test_line_dedup(spark):
    from labeltrail.llm.line_dedup import dedup_lines, without_repeated_lines

    rng = random.Random(6)
    line = prose(rng, 40)
    near = line.replace(line.split()[20], "other", 1)
    texts = [f"{line}\nown words here", f"first {line[:30]}\n\n{near}", None, "", line, "a\na\nb", f"{line}\n{line}", " "]
    out = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[1].text == f"first {line[:30]}\n" and (out[1].n_lines, out[1].n_removed) == (3, 1)
    assert out[2].text is None and out[3].text == "" and (out[4].text, out[4].n_removed) == ("", 1) and out[5].text == "a\nb" and out[6].text == "" and out[7].text == " "
    assert {r.doc_id for r in without_repeated_lines(frame(spark, texts)).collect()} == {0, 1, 2, 3, 5, 7}


def kept_lines(texts, size=12, percent=80):
    """Brute force: each line's component under shingle sets at every position; the first line of a component stays."""
    lines = [(i, k, x.strip(" ")) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    sets = {n: {x[a:a + size] for a in range(max(len(x) - size, 0) + 1)} for n, (_, _, x) in enumerate(lines)}
    root = components(sets, percent)
    gone = {lines[n][:2] for n in sets if root[n] != n}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]


def test_rounds_end_with_the_components_of_their_links(spark):
    from labeltrail.llm.buckets import bucket_links
    from labeltrail.llm.common import staged
    from labeltrail.operators.components import connected_minimum

    keys = spark.createDataFrame([(k, n) for k in range(3) for n in range(40) if n % (k + 2)] + [(9, 70), (9, 71)], "key long, node long")
    links, found = bucket_links(staged(keys, "buckets"), lambda p: p, lambda p: p.where("(a + b) % 7 = 0 or a = 70"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    assert len(links) > 1 and sorted(map(tuple, found.collect())) == sorted(map(tuple, connected_minimum(every).collect()))


def test_line_dedup_without_blanks(spark):
    from labeltrail.llm.line_dedup import dedup_lines

    rng = random.Random(12)
    same = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(12))
    pool = ["https://www.example.com/products/1", "https://www.example.com/contact-us", "2024-05-01T10:15:30.123Z", "2024-05-01T19:59:59.999Z",
            *[same + "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(40)) for _ in range(4)], *["😀" * 3 + "".join(chr(0x1F600 + rng.randrange(40)) for _ in range(60)) for _ in range(3)],
            *["".join(rng.choice("abcdef/+0123") for _ in range(300)) for _ in range(4)], "short", "shorter", prose(rng, 60)]
    for base in [x for x in pool if len(x) > 100]:
        pool += [base[:150] + "#" + base[151:], base[:100] + "".join(rng.choice("xyz") for _ in range(100)) + base[200:]]
    rng.shuffle(pool)
    texts = ["\n".join(rng.choice(pool) for _ in range(3)) for _ in range(20)]
    want = kept_lines(texts)
    for r in dedup_lines(frame(spark, texts)).collect():
        assert r.text == want[r.doc_id]


def test_fingerprints(spark, odd_texts):
    from labeltrail.llm.fingerprints import edited_fingerprints

    ids = [3 * i for i in range(len(odd_texts))]
    out = {r.doc_id: r for r in edited_fingerprints(frame(spark, odd_texts, ids), samples=64).collect()}
    order = sorted(ids, reverse=True)
    text = {i: odd_texts[i // 3] or "" for i in ids}
    marks = {}
    for k, i in enumerate(order):
        nxt, t = text[order[(k + 1) % len(order)]], text[i]
        n = len(t) // 3
        r = out[i]
        assert r.n_chars == len(t) and r.edited == t[:len(t) - n] + nxt[:n]
        assert marks.setdefault(t, r.fingerprint) == r.fingerprint
        own, other, edited = (collections.Counter(x.split()) for x in (t, nxt, r.edited))
        for got, a in ((r.near_next, other), (r.near_edited, edited)):
            want = sum((own & a).values()) / sum((own | a).values()) if own | a else 1.0
            assert abs(got - want) < 0.3


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fits(kind, v):
        d = [int(c) for c in v if c.isdigit()]
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in v.split("."))) or (kind == "phone" and 10 <= len(d) <= 15) or (
            kind == "card" and 14 <= len(d) <= 19 and total % 10 == 0)

    return sorted((m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fits(k, m[0]))


def test_personal_data(spark):
    from labeltrail.llm.pii import find_personal, fit_redactor

    rng = random.Random(8)
    pieces = ["a.b@c-d.ef", "a@b.c_d@e.f", "1.2.3.4", "001.02.3.255", "1.2.3.256", "1.2.3.4.5", "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468", "+1 (042) 555-7845", "+12", "+49 30.123 456-78",
              " word ", "é漢", "x@y", "@", "12 34", "\n", ". ", "call ", "+", "-", "9" * 3000]
    texts = [None, "", *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(60)], "1" * 20_000, "a" * 20_000 + "@b.c"]
    docs = frame(spark, texts)
    for r in find_personal(docs, fit_redactor(docs, trees=2)).collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert [(s.start, s.kind, s.stop) for s in r.base] == sorted(want, key=lambda s: (s[0], list(PLAIN).index(s[1])))
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_language(spark):
    from labeltrail.llm.langid import codewords, fit_language_codes, predict_language

    rng = random.Random(9)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ich"], "cc": ["eau", "oux", "tré"]}
    texts, langs = [], []
    for i in range(180):
        lang = rng.choice(list(sounds))
        texts.append(" ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(25)))
        langs.append(lang if i % 9 else None)
    texts += [None, "", "123 !", "漢"]
    langs += [None] * 4
    docs = frame(spark, texts, langs=langs)
    out = {r.doc_id: r for r in predict_language(docs, fit_language_codes(docs, F.col("doc_id") % 2 == 0)).collect()}
    held = [i for i in range(180) if i % 2 and langs[i]]
    assert np.mean([out[i].lang_pred == langs[i] for i in held]) > 0.95
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (180, 181, 182)) and out[183].lang_pred in sounds
    assert all(0 <= r.score <= 1 for r in out.values())
    for n in (2, 4, 12):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_language_of_many_copies(spark):
    from labeltrail.llm.langid import fit_language_codes

    texts = [f"eau oux {i}" for i in range(30)] + [f"ka lo mi {i % 10}" for i in range(4000)]
    docs = frame(spark, texts, langs=["cc"] * 30 + ["aa"] * 4000)
    rows = docs.dropDuplicates(["text"])  # copies change nothing
    whole, plain = (fit_language_codes(d, F.lit(True), per_language=20) for d in (docs, rows))
    assert whole.languages == plain.languages == ["aa", "cc"] and np.array_equal(whole.weights, plain.weights)


def test_toxicity(spark):
    from labeltrail.llm.queries import TOXICITY
    from labeltrail.llm.toxicity import fit_toxicity, score_toxicity, without_toxic

    rng, texts, labels = random.Random(10), [], []
    for i in range(300):
        toxic, junk = i % 5 == 0, i % 7 == 0
        words = prose(rng, 60).split() + (["vile", "nasty"] if toxic else []) + (["zzz"] * 20 if junk else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, 0 if junk else 1, 1 if toxic else 0))
    texts += [None, "", "VILE nasty words"]
    docs = frame(spark, texts)
    chain = fit_toxicity(docs, spark.createDataFrame(labels[:200] + [(None, 1, 1), (201, None, 1)], "doc_id long, quality int, toxic int"), TOXICITY)
    out = {r.doc_id: r for r in score_toxicity(docs, chain).collect()}
    assert np.mean([out[i].toxic == bool(t) for i, _, t in labels[200:]]) > 0.95
    assert not out[300].toxic and not out[301].toxic and out[302].toxic
    left = without_toxic(docs.withColumn("toxic", F.lit("x")), chain)
    assert left.columns == docs.columns + ["toxic"] and {r.doc_id for r in left.collect()} == {i for i, r in out.items() if not r.toxic}


def test_toxicity_holds_each_word_once(spark, monkeypatch):
    from labeltrail.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, y, categories: seen.append((rows, y.tolist())))
    docs = spark.createDataFrame([(2, "shared words Here"), (1, "shared other words"), (1, "a copy of the id"), (3, None), (4, "unlabelled words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    toxicity.fit_toxicity(docs.coalesce(1), labels, {"toxic": "toxic = 1"})
    (rows, y), = seen
    assert y == [[1], [0], [0]] and rows[1:] == [{"shared", "words", "here"}, set()] and rows[0] in ({"shared", "other", "words"}, {"a", "copy", "of", "the", "id"})
    held = [{w: id(w) for w in r} for r in rows]
    assert all(held[0][w] == held[1][w] for w in held[0].keys() & held[1].keys())


def test_queries_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from labeltrail.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)] and set(ORACLES) <= set(QUERIES)
    rng = random.Random(11)
    item, line = prose(rng, 30, 10**6), prose(rng, 30)
    texts = [prose(rng, 80) for _ in range(60)]
    for i in range(0, 60, 6):
        texts[i] += " vile nasty"
    texts += [texts[1], texts[2].replace(" ", "  ", 1), texts[3] + " " + item, line + "\n" + texts[5], line, None, ""]
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(60) if i % 6}
    assert len(clean - ids) <= 2 and not ids & {i for i in range(60) if i % 6 == 0} and not ids & {60, 62, 64}
    assert {65, 66} <= ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert hashlib.sha256(b"").hexdigest() == corpus_pipeline.encoding(spark, docs, str(tmp_path)).where("doc_id = 66").first().decoded_sha256
