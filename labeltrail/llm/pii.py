"""Personal data in texts: overlapping candidate spans, boosted trees over format and context, calibrated thresholds.

High-recall patterns propose spans of each kind.  Features of a span's form and of the characters around it go to gradient
boosted trees, whose scores are calibrated per kind on rows held out; a span is redacted if its calibrated chance passes
the kind's threshold.  Spans that meet the strict rule of their kind are always redacted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.llm.common import text_of

KINDS = ["email", "ip", "card", "phone"]
#: Strict rules, as possessive patterns: each matches what its plain form matches leftmost, without backtracking over runs.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns of the generators; what they find may overlap anything else.  Each starts at the border of a run or is
#: bounded, so a long run costs one pass.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,})++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9]{1,3}[.,]){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|\+[0-9](?:[ ().-]*[0-9]){8,14}",
}
#: Every match of a wide pattern holds a match of its hint, so a text without one is spared the pattern.
HINT = {"email": r"@|\(at\)|\[at\]| at ", "ip": r"[0-9][.,][0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{2}", "phone": r"\+[0-9]|[0-9][) .-]"}
STRICT_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -][0-9]", "phone": r"\+[0-9]"}
AROUND = 24
WORDS_NEAR = r"(?i)mail|contact|phone|tel|call|mobile|fax|card|visa|credit|payment|iban|ip|host|server|address|login"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the leftmost matches that do not overlap, in code points.

    A pattern that takes the gap before each match, or the rest of the text, is found again and again; the lengths of gaps and
    matches add up to the starts.  Each find begins where the last one ended, so the cost is one pass.
    """
    cut = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    gaps, found = F.regexp_extract_all(text, cut, F.lit(1)), F.regexp_extract_all(text, cut, F.lit(2))
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["value"].alias("value")))
    pairs = F.filter(pairs, lambda p: (p["gap"] > 0) | (F.length(p["value"]) > 0))
    return F.filter(F.element_at(F.transform(F.array(pairs), _with_starts), 1), lambda m: F.length(m["value"]) > 0)


#: Matches whose starts are added up at once.  An array that grows by one is copied each time, so only short ones grow.
RUN = 128


def _with_starts(pairs: Column) -> Column:
    """(start, value) of pairs (gap, value): running sums, first of runs of RUN pairs, then inside each run."""
    span = lambda p: p["gap"] + F.length(p["value"])
    runs = F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, RUN)))

    def growing(items: Column, first: Column, size) -> Column:
        """Where each item starts, if the first starts at `first`."""
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def placed(run: Column, first: Column) -> Column:
        return F.zip_with(run, growing(run, first, span), lambda p, at: F.struct((at + p["gap"]).alias("start"), p["value"].alias("value")))

    def of(runs: Column) -> Column:
        lengths = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda s, p: s + span(p)))
        return F.flatten(F.zip_with(runs, growing(lengths, F.lit(0), lambda n: n), placed))

    none = F.array().cast("array<struct<start:int,value:string>>")
    return F.coalesce(F.element_at(F.transform(F.array(runs), lambda r: F.when(r.isNotNull(), of(r))), 1), none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """At most 32 digits that pass the checksum: every second one from the right doubled, 9 taken off above 9."""
    d = F.reverse(F.substring(digits(value), 1, 33))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.transform(each, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return (F.length(d) <= 32) & (total % 10 == 0)


def strict(kind: Column, value: Column) -> Column:
    """The value meets the rule of its kind beyond the pattern."""
    n = F.length(digits(value))
    parts_fit = F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3).try_cast("int"), F.lit(999)) <= 255))
    return F.when(kind == "email", True).when(kind == "ip", parts_fit).when(kind == "card", n.between(14, 19) & luhn(value)).otherwise(n.between(10, 15))


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per proposed span: kept columns, kind, start, stop, value, before, after, base (found and passed by the strict rule)."""
    keep, t = keep or [], F.col(text)
    none = F.array().cast("array<struct<start:int,value:string>>")

    def proposed(patterns: dict[str, str], hints: dict[str, str], wide: bool) -> Column:
        def of(kind: str) -> Column:
            found = F.when(t.rlike(hints[kind]), matches(t, patterns[kind])).otherwise(none)
            return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["value"].alias("value"), F.lit(wide).alias("wide")))

        return F.concat(*[of(kind) for kind in KINDS])

    some = docs.where(t.rlike(r"[0-9@]| at |\(at\)|\[at\]|[0-9A-Fa-f]:[0-9A-Fa-f]"))
    rows = some.select(*keep, t.alias("_t"), F.explode(F.concat(proposed(STRICT, STRICT_HINT, False), proposed(WIDE, HINT, True))).alias("c"))
    value, start = F.col("c.value"), F.col("c.start")
    stop = start + F.length(value)
    before = F.substring(F.col("_t"), F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)))
    after = F.substring(F.col("_t"), stop + 1, F.lit(AROUND))
    return rows.select(*keep, F.col("c.kind").alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value"), F.col("c.wide").alias("wide"),
                       before.alias("before"), after.alias("after")).withColumn("base", ~F.col("wide") & strict(F.col("kind"), F.col("value")))


FEATURES = ["k0", "k1", "k2", "k3", "n_chars", "n_digits", "n_marks", "n_letters", "luhn_ok", "parts", "top_part", "plus", "at", "space_before", "space_after",
            "digit_near", "mark_before", "word_near", "same_digits", "quoted"]


def featured(rows: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES: form of the value, its kind, and the characters around it."""
    v, b, a = F.col("value"), F.col("before"), F.col("after")
    d = digits(v)
    number = lambda c: c.cast("double")
    return rows.withColumns({f"k{i}": number(F.col("kind") == k) for i, k in enumerate(KINDS)} | {
        "n_chars": number(F.length(v)), "n_digits": number(F.length(d)), "n_marks": number(F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", ""))),
        "n_letters": number(F.length(F.regexp_replace(v, r"\P{L}", ""))), "luhn_ok": number(luhn(v)), "parts": number(F.size(F.split(v, r"[.,: ()-]+"))),
        "top_part": F.coalesce(F.array_max(F.transform(F.split(v, r"[^0-9]+"), lambda x: F.substring(x, 1, 9).try_cast("double"))), F.lit(0.0)),
        "plus": number(v.startswith("+")), "at": number(v.contains("@")), "space_before": number((b == "") | b.rlike(r"\s$")), "space_after": number((a == "") | a.rlike(r"^[\s.,;!?]")),
        "digit_near": number(b.rlike(r"[0-9]$") | a.rlike(r"^[0-9]")), "mark_before": number(b.rlike(r"[:=]\s?$")), "word_near": number(F.concat_ws(" ", b, a).rlike(WORDS_NEAR)),
        "same_digits": number(F.length(d) - F.size(F.array_distinct(F.split(d, "")))), "quoted": number(b.rlike(r"[\"']$") | a.rlike(r"^[\"']"))})


@dataclass
class Redactor:
    """Trees, and per kind the bins of raw scores with their calibrated chances, and the threshold."""

    trees: GBTClassificationModel | None
    bins: dict[str, list[tuple[float, float]]]
    thresholds: dict[str, float]

    def chance(self, score: Column, kind: Column) -> Column:
        """Calibrated chance of a raw score: that of the highest bin that begins at or below it."""
        out = F.lit(0.0)
        for k, bins in self.bins.items():
            inner = F.lit(0.0)
            for low, chance in sorted(bins):
                inner = F.when(score >= low, F.lit(chance)).otherwise(inner)
            out = F.when(kind == k, inner).otherwise(out)
        return out


def fit_redactor(docs: DataFrame, max_docs: int | None = None, precision: float = 0.9, trees: int = 12, id_col: str = "doc_id", text_col: str = "text") -> Redactor:
    """Fit on the candidates of all different documents that hold a digit or an @, or of `max_docs`, first by the hash of their text.

    The labels are the strict rules: a candidate is personal if it shares characters with a span of its
    kind that the strict rule accepts.
    Features hold no result of that check but the checksum.  A fifth of the documents calibrates: raw scores fall into bins, chances are
    made non-decreasing over the bins, and a kind's threshold is the least chance of at least `precision`.
    """
    text = text_of(text_col)
    able = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.col("text").rlike("[0-9@]"))
    if max_docs is None:
        # Copies are dropped by their candidates, so that no text is shuffled.
        rows = candidates(able, "text", ["h"]).dropDuplicates(["h", "kind", "start", "stop", "base", "wide"])
    else:
        chosen = able.select("h").distinct().orderBy("h").limit(max_docs)
        picked = able.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # at most max_docs hashes
        rows = candidates(picked, "text", ["h"])
    good = F.array_agg(F.when(F.col("base"), F.struct("kind", "start", "stop")))
    per_doc = rows.groupBy("h").agg(good.alias("good"), F.collect_list(F.struct("kind", "start", "stop", "value", "wide", "before", "after")).alias("c"))
    rows = per_doc.select("h", "good", F.explode("c").alias("c")).select("h", "good", "c.*")
    label = F.exists("good", lambda g: (g["kind"] == F.col("kind")) & (g["start"] < F.col("stop")) & (F.col("start") < g["stop"]))
    rows = featured(rows.withColumn("label", label.cast("double"))).select("h", "kind", "label", *FEATURES)
    sample = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("h", "kind", "label", "x")
    sample = (sample if max_docs is None else sample.coalesce(4)).persist()
    fit, held = sample.where("h % 5 <> 0"), sample.where("h % 5 = 0")
    if fit.select("label").distinct().count() < 2:
        sample.unpersist()
        return Redactor(None, {}, {})
    model = GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, maxDepth=4, maxBins=32, seed=7).fit(fit)
    score = F.round(F.element_at(_values("probability"), 2) * 20).cast("int")
    counts = model.transform(held).groupBy("kind", score.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    sample.unpersist()
    bins, thresholds = {}, {}
    for kind in KINDS:
        mine = sorted((r["bin"], r["n"], r["good"]) for r in counts if r["kind"] == kind)
        pools: list[list[float]] = []
        for b, n, g in mine:  # pool neighbours until chances rise
            pools.append([b / 20 - 0.025, n, g])
            while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
                low = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + low[1], pools[-1][2] + low[2]]
        bins[kind] = [(low, g / n) for low, n, g in pools]
        thresholds[kind] = min([c for _, c in bins[kind] if c >= precision], default=2.0)
    return Redactor(model, bins, thresholds)


def _values(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(vector))


def find_personal(docs: DataFrame, redactor: Redactor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind_no, kind, stop) in order of start and kind, per document.

    `base` holds what the strict rules accept, `spans` also the candidates whose calibrated chance passes.  Positions are code points,
    stops exclusive.  A candidate inside a span of `base`, or equal to another, adds nothing; others stay and may overlap.

    Null text: empty, no spans.  Repeated rows and null ids give a row each.  Empty table: no rows.  Other columns are not read.
    Whole texts are searched in one pass a pattern; only the candidates of a row, not its text, are shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = candidates(source, "text", ["row"])
    if redactor.trees is None:
        rows = rows.withColumn("passes", F.col("base"))
    else:
        scored = redactor.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(featured(rows)))
        raw = F.round(F.element_at(_values("probability"), 2) * 20) / 20
        limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in redactor.thresholds.items()], F.lit(2.0))
        rows = scored.withColumn("passes", F.col("base") | (redactor.chance(raw, F.col("kind")) >= limit))
    rows = rows.where("passes").withColumn("kind_no", F.expr("case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"))
    span = F.struct("start", "kind_no", "kind", "stop")
    found = rows.groupBy("row").agg(F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("every"))
    inside = lambda s: F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]) & ((b["start"] != s["start"]) | (b["stop"] != s["stop"])))
    found = found.select("row", "base", F.filter("every", lambda s: ~inside(s)).alias("spans"))
    kind = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"
    return source.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id", *[F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c in ("base", "spans")])


def count_kind(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
