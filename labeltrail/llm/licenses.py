"""License scans by diagonal voting, in built-in expressions.

Every run of k words of every text is joined by hash with the places it has in the templates.  A hit votes for its diagonal, the
difference of the two places; neighbouring diagonals (words put in or left out) are merged, and a span counts if it holds enough of its
template.  Hits are confirmed on their words, so hashes decide nothing.  Templates shorter than k words, such as the phrases
of BASE, vote by pairs of words and must stand whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labeltrail.llm.common import text_of

#: Words once A-Z are lower case: digits, a-z and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words per run of short templates.
SHORT = 2
#: Places of runs in templates up to which the table of templates is broadcast; larger tables are shuffled.
BROADCAST_PLACES = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# The phrases of the contract and their labels.
BASE = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]

# Notices as public licenses word them.
NOTICES = [
    Template("agpl", "free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
             "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
             'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
             "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
             "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution."),
    Template("bsd", "released under the BSD license"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software "
             "to the public domain worldwide. This software is distributed without any warranty."),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
             "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
             "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
             "above copyright notice and this permission notice appear in all copies."),
    Template("lgpl", "free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License"),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
             "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mit", "licensed under the MIT license"),
    Template("mit", "released under the MIT license"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
             "You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
             "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def template_words(text: str) -> list[str]:
    """Words of a template, as `words` takes them from texts."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_runs(templates: list[Template], k: int) -> list[tuple[int, str, bool, int, int, int, list[str]]]:
    """(template, label, base, words, runs, place, words of the run) for each run of each template."""
    out = []
    for t, template in enumerate(templates):
        w = template_words(template.text)
        size = k if len(w) >= k else SHORT
        if len(w) < SHORT:
            raise ValueError(f"a template has two words at least: {template.text!r}")
        n = len(w) - size + 1
        out += [(t, template.label, template.base, len(w), n, i, w[i:i + size]) for i in range(n)]
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def _runs(words_hashed: Column, n: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order; none if there are fewer words."""
    run = lambda i: F.xxhash64(F.lit(size), *[F.get(words_hashed, i + j) for j in range(size)])
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))


def _identity(text: Column) -> list[Column]:
    """128 bits that stand for a text, so that copies are scanned as one."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _hits(docs: DataFrame, templates: list[Template], k: int, text_col: str) -> DataFrame:
    """(k1, k2, template, diagonal, place): a row for each place of a template whose run stands in a text, on its diagonal."""
    spark = docs.sparkSession
    rows = template_runs(templates, k)
    schema = "template int, label string, base boolean, n_words int, runs int, place int, run array<string>"
    known = spark.createDataFrame(rows, schema).select(
        "template", "place", "run", F.xxhash64(F.size("run"), *[F.xxhash64(F.get("run", F.lit(j))) for j in range(SHORT)]).alias("short"),
        F.xxhash64(F.size("run"), *[F.xxhash64(F.get("run", F.lit(j))) for j in range(k)]).alias("long"))
    known = known.select("template", "place", "run", F.when(F.size("run") == k, F.col("long")).otherwise(F.col("short")).alias("hash"))
    if len(rows) <= BROADCAST_PLACES:
        known = F.broadcast(known)
    text = text_of(text_col)
    read = docs.select(*_identity(text), words(text).alias("words"))
    read = read.select("k1", "k2", "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    sizes = [SHORT] if k == SHORT else [SHORT, k]
    read = read.select("k1", "k2", "words", F.greatest(F.col("n") - SHORT + 1, F.lit(0)).alias("m"), F.concat(*[_runs(F.col("h"), F.col("n"), s) for s in sizes]).alias("hashes"))
    # the array is made before it is taken apart, so that words are not copied for every run; outer, as a filter on its size would make it twice
    read = read.select("k1", "k2", "words", "m", F.posexplode_outer("hashes").alias("at", "hash"))
    hits = read.join(known, "hash")
    at = F.when(F.col("at") >= F.col("m"), F.col("at") - F.col("m")).otherwise(F.col("at"))
    hits = hits.withColumn("at", at).where(F.slice("words", F.col("at") + 1, F.size("run")) == F.col("run"))
    return hits.groupBy("k1", "k2", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place").agg(F.count("*").alias("copies"))


def license_spans(docs: DataFrame, templates: list[Template] | None = None, k: int = 5, slack: int = 6, coverage: float = 0.6,
                  text_col: str = "text") -> DataFrame:
    """(k1, k2, label, base, start, last, share): the spans of every distinct text that hold a template; (k1, k2) stand for the text.

    start, last: words of the text from 0; share: of the template's runs that the span holds.  Diagonals at most `slack` words
    apart are one span; it counts from a share of `coverage` on, within twice the template's length.  Short templates count whole.
    """
    templates = BASE + NOTICES if templates is None else templates
    votes = _hits(docs, templates, k, text_col).groupBy("k1", "k2", "template", "diagonal").agg(
        F.count("*").alias("votes"), F.collect_set("place").alias("places"))  # at most the runs of a template
    facts = F.create_map(*[F.lit(x) for t in {r[0]: r for r in template_runs(templates, k)}.values()
                           for x in (t[0], F.struct(F.lit(t[1]).alias("label"), F.lit(t[2]).alias("base"), F.lit(t[3]).alias("n_words"),
                                                    F.lit(t[4]).alias("runs"), F.lit(len(t[6])).alias("size")))])
    votes = votes.withColumn("fact", facts[F.col("template")]).select("k1", "k2", "template", "diagonal", "votes", "places", "fact.*")
    whole = F.col("n_words") < k
    votes = votes.where(~whole | (F.col("votes") == F.col("runs")))
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce((whole | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)).cast("int"), F.lit(0))
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    who = ["k1", "k2", "template", "label", "base", "n_words", "runs", "span"]
    spans = spans.select(*who, "size", "diagonal", F.explode("places").alias("place"))
    first = F.col("diagonal") + F.col("place")
    spans = spans.groupBy(*who, "place").agg(F.min(first).alias("start"), F.max(first + F.col("size") - 1).alias("last"))
    spans = spans.groupBy(*who).agg(F.min("start").alias("start"), F.max("last").alias("last"), (F.count("*") / F.col("runs")).alias("share"))
    spans = spans.where((F.col("share") >= coverage) & (F.col("last") - F.col("start") < 2 * F.col("n_words")))
    return spans.select("k1", "k2", "label", "base", "start", "last", "share")


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, k: int = 5, slack: int = 6, coverage: float = 0.6,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document.

    n_base: spans of base templates; first_word, last_word: their smallest and largest start, else null; labels: distinct, sorted
    and joined by commas; score: largest share of a template held, 0 without a span.  A null text counts as empty: no words, no
    labels.  Repeated rows and copies have a row each.  Null ids stay.  Empty table: no rows.  Other columns are not read.
    """
    base = lambda c: F.when(F.col("base"), F.col(c))
    found = license_spans(docs, templates, k, slack, coverage, text_col).groupBy("k1", "k2").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).cast("long").alias("first_word"), F.max(base("start")).cast("long").alias("last_word"),
        F.collect_set(base("label")).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"))
    text = text_of(text_col)
    every = docs.select(F.col(id_col).alias("doc_id"), *_identity(text), F.size(words(text)).cast("long").alias("n_words"))
    out = every.join(found, ["k1", "k2"], "left")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                      listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def scan_sql(k: int = 5, slack: int = 6, coverage: float = 0.6) -> str:
    """DuckDB SQL for the rows of `scan_licenses` over `documents`: runs are joined as text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {quote(label)}, {base}, {n}, {runs}, {place}, {len(run)}, {quote(' '.join(run))})"
                     for t, label, base, n, runs, place, run in template_runs(BASE + NOTICES, k))
    ahead = " || ' ' || ".join(["w", *[f"lead(w, {j}) over o" for j in range(1, k)]])
    return f"""with known(template, label, base, n_words, runs, place, size, run) as (values {rows}),
    docs as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') ws from documents),
    placed as (select r, unnest(ws) w, generate_subscripts(ws, 1) - 1 pos from docs),
    runs as (select r, pos, w || ' ' || lead(w) over o pair, {ahead} run from placed window o as (partition by r order by pos)),
    hits as (select r, template, label, base, n_words, runs, size, place, pos, pos - place diagonal from runs t join known k on t.pair = k.run and size = {SHORT}
             union all select r, template, label, base, n_words, runs, size, place, pos, pos - place from runs t join known k on t.run = k.run and size = {k}),
    short as (select r, label, base, diagonal "start", 1.0::double share from hits where n_words < {k} group by r, template, label, base, runs, diagonal having count(*) = runs),
    far as (select *, (diagonal - lag(diagonal) over (partition by r, template order by diagonal, place) > {slack})::int far from hits where n_words >= {k}),
    spans as (select *, sum(coalesce(far, 0)) over (partition by r, template order by diagonal, place rows unbounded preceding) span from far),
    long as (select r, label, base, min(pos) "start", count(distinct place)::double / any_value(runs) share from spans group by r, template, label, base, span
             having count(distinct place)::double / any_value(runs) >= {coverage} and max(pos + size - 1) - min(pos) < 2 * any_value(n_words)),
    found as (select r, count(*) filter (base) n_base, min("start") filter (base) first_word, max("start") filter (base) last_word,
              string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score
              from (from short union all from long) group by r)
    select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
           coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score from docs left join found using (r)"""
