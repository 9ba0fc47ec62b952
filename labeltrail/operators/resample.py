"""Cluster bootstrap, permutation tests and multiple-testing adjustment.

Rows are reduced to component totals first; draws are multiplicities per (replicate,
component) that scale those totals, so no row is ever copied.  Draw i of replicate r
is SHA-256(context|r|i) mod k, which any engine can replay.  Draws are vectors (see
`draws`) as long as one replicate's fit a bounded block, and a joined table beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltrail.functions.binomial import exact_sign_p
from labeltrail.functions.digests import Keys, numbered
from labeltrail.functions.hashing import key_text, u60
from labeltrail.functions.measures import n_if, ratio
from labeltrail.operators.draws import (Draws, as_rows, auc_step, average_precision_step, few_values, place_sums, share_cuts, sorted_curve,
                                        vector_draws)
from labeltrail.operators.draws import replicate_sums as vector_sums
from labeltrail.operators.ranking import attach_one_row, dense_index, null_safe_join, ranked, running_totals
from labeltrail.session import cut_lineage


def component_draws(components: DataFrame, key: str, replicates: int, context: str,
                    within: list[str] | None = None) -> DataFrame:
    """Multiplicity of each drawn component: k draws with replacement per replicate.

    Undrawn components have no row; see `zero_filled` for the exported form.
    """
    within = within or []
    idx = dense_index(components, key, within)
    draws = idx.select(*within, "n_keys", "key_index", F.explode(
        F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    text = key_text(context, *[F.col(c) for c in within], F.col("replicate"), F.col("key_index"))
    draws = draws.select(*within, "replicate", F.pmod(u60(text), F.col("n_keys")).alias("key_index"))
    counts = draws.groupBy(*within, "replicate", "key_index").agg(F.count("*").alias("multiplicity"))
    return counts.join(idx.select(*within, key, "key_index"), [*within, "key_index"]).select(
        *within, "replicate", key, "multiplicity")


def draw(components: DataFrame, key: str, replicates: int, context: str, within: list[str] | None = None) -> Draws | DataFrame:
    """Draws for `replicate_sums`: vectors, or the joined table where one replicate's multiplicities exceed a block."""
    return vector_draws(components, key, replicates, context, within) or component_draws(components, key, replicates, context, within)


def zero_filled(draws: DataFrame, components: DataFrame, key: str, replicates: int,
                within: list[str] | None = None) -> DataFrame:
    """Draw table with a row for every (replicate, component)."""
    cells = components.select(*(within or []), key).distinct().withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return cells.join(draws, [*(within or []), key, "replicate"], "left").fillna(0, ["multiplicity"])


def replicate_sums(totals: DataFrame, draws: Draws | DataFrame, key: str, by: list[str], columns: list[str],
                   within: list[str] | None = None) -> DataFrame:
    """Sum of component totals under every replicate's multiplicities."""
    if isinstance(draws, Draws):
        return vector_sums(totals, draws, by, columns)
    joined = totals.join(draws, [*(within or []), key])
    groups = list(dict.fromkeys([*by, *(within or [])]))
    return joined.groupBy(*groups, "replicate").agg(*[F.sum(F.col(c) * F.col("multiplicity")).alias(c) for c in columns])


def interval(values: DataFrame, by: list[str], columns: list[str], replicates: int, digits: int = 9) -> DataFrame:
    """95% percentile interval per column; any undefined replicate makes it null.

    `values` holds one row per (group, replicate), at most `replicates` values a group.
    """
    aggs = []
    for c in columns:
        v = F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
        n = F.count(v)
        aggs += [F.when(n == replicates, F.round(q[0], digits)).alias(f"{c}_lower"),
                 F.when(n == replicates, F.round(q[1], digits)).alias(f"{c}_upper"), n.alias(f"{c}_finite")]
    return values.groupBy(*by).agg(*aggs)


def bootstrap_ratios(rows: DataFrame, component: str, by: list[str], columns: list[str], ratios: dict[str, Column],
                     replicates: int, context: str, universe: DataFrame | None = None) -> DataFrame:
    """Point value and interval of ratios of summed columns, resampling components.

    All groups share the draws, so their replicates are paired.
    """
    totals = cut_lineage(rows.groupBy(component, *by).agg(*[F.sum(c).alias(c) for c in columns]))
    draws = draw(universe if universe is not None else totals, component, replicates, context)
    sums = replicate_sums(totals, draws, component, by, columns)
    reps = sums.select(*by, "replicate", *[v.alias(k) for k, v in ratios.items()])
    point = totals.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("components"))
    point = point.select(*by, "components", *[F.round(v, 9).alias(k) for k, v in ratios.items()])
    ci = interval(reps, by, list(ratios), replicates)
    return point.join(ci, by) if by else attach_one_row(point, ci)


def precision_lower_bound(rows: DataFrame, cluster: str, by: list[str], y: str, replicates: int, context: str,
                          all_correct_is_one: bool = False) -> DataFrame:
    """Cluster bootstrap interval of precision; a single cluster returns its point value."""
    totals = cut_lineage(rows.groupBy(cluster, *by).agg(F.sum(F.col(y).cast("int")).alias("ok"), F.count("*").alias("n")))
    draws = draw(totals, cluster, replicates, context, by)
    reps = replicate_sums(totals, draws, cluster, by, ["ok", "n"], by).withColumn("precision", ratio("ok", "n"))
    ci = interval(reps, by, ["precision"], replicates)
    point = totals.groupBy(*by).agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.count("*").alias("clusters"))
    out = point.join(ci, by) if by else attach_one_row(point, ci)
    p = F.round(ratio("ok", "n"), 9)
    fixed = F.when(F.col("clusters") == 1, p)
    if all_correct_is_one:
        fixed = F.when(F.col("ok") == F.col("n"), F.lit(1.0))
    return out.select(*by, "ok", "n", "clusters", p.alias("precision"),
                      F.coalesce(fixed, "precision_lower").alias("lower"), F.coalesce(fixed, "precision_upper").alias("upper"))


def row_bootstrap_mean(rows: DataFrame, key: str, value: str, by: list[str], replicates: int, context: str,
                       within: list[str] | None = None) -> DataFrame:
    """Row bootstrap of the mean: each row is its own component.

    `within` (default all of `by`) names the groups that have draws of their own; the other groups share them and must hold the
    same keys, so that their replicates are paired.
    """
    within = by if within is None else within
    clean = cut_lineage(rows.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("v"), F.lit(1).alias("one")))
    draws = draw(clean, key, replicates, context, within)
    reps = replicate_sums(clean, draws, key, by, ["v", "one"], within).withColumn("mean", ratio("v", "one"))
    point = clean.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))
    ci = interval(reps, by, ["mean"], replicates, 6)
    return null_safe_join(point, ci, by) if by else attach_one_row(point, ci)


def row_bootstrap_median(rows: DataFrame, key: str, value: str, by: list[str], replicates: int, context: str,
                         within: list[str] | None = None) -> DataFrame:
    """Row bootstrap of the median from multiplicities: the value where the drawn copies reach half (`within` as for the mean)."""
    within = by if within is None else within
    clean = cut_lineage(rows.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("v")))
    draws = draw(clean, key, replicates, context, within)
    if isinstance(draws, Draws) and few_values(clean, by, "v"):
        # copies of each distinct value come from sums per value, so no row meets its draws one by one
        copies = replicate_sums(clean.withColumn("m", F.lit(1)), draws, key, [*by, "v"], ["m"], within)
        upto = Window.partitionBy(*by, "replicate").orderBy(F.col("v").asc_nulls_last())  # at most PLACES rows
        steps = copies.withColumn("cum_m", F.sum("m").over(upto))
    else:
        drawn = clean.join(component_draws(clean, key, replicates, context, within), [*within, key])
        steps = running_totals(drawn, [*by, "replicate"], "v", {"m": F.sum("multiplicity")}, "asc")
    n = steps.groupBy(*by, "replicate").agg(F.max("cum_m").alias("_n"))
    s = null_safe_join(steps, n, [*by, "replicate"])
    before = F.col("cum_m") - F.col("m")
    at = lambda i: F.max(F.when((before < i) & (F.col("cum_m") >= i), F.col("v")))
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    reps = s.groupBy(*by, "replicate").agg(((at(lo) + at(hi)) / 2).alias("median"))
    return interval(reps, by, ["median"], replicates, 6)


def ranking_difference_bootstrap(rows: DataFrame, component: str, scores: tuple[str, str], y: str, weight: str,
                                 replicates: int, context: str) -> DataFrame:
    """Interval of the difference in average precision of two scores under shared draws.

    Rows are reduced to (component, score) cells before the multiplicities multiply them.
    """
    rows = cut_lineage(rows.select(component, *scores, y, weight))
    w, t = F.col(weight).cast("double"), F.col(y).cast("boolean")
    cells = lambda name: rows.groupBy(component, F.col(name).cast("double").alias("score")).agg(
        F.sum(F.when(t, w).otherwise(0.0)).alias("pos"), F.sum(F.when(~t, w).otherwise(0.0)).alias("neg"))
    draws = vector_draws(rows, component, replicates, context)
    places = [draws and place_sums(cells(name), "score", ["pos", "neg"], draws) for name in scores]
    if all(p is not None for p in places):
        above = Window.partitionBy("replicate").orderBy(F.col("score").desc_nulls_last())  # at most PLACES rows a replicate
        one = lambda p, i: p.withColumns({"_p": F.sum("pos").over(above), "_n": F.sum("neg").over(above)}).groupBy("replicate").agg(
            (F.sum(F.col("pos") * ratio("_p", F.col("_p") + F.col("_n"))) / F.nullif(F.sum("pos"), F.lit(0.0))).alias(f"ap{i}"))
        both = one(places[0], 0).join(one(places[1], 1), "replicate")
        return interval(both.select("replicate", (F.col("ap1") - F.col("ap0")).alias("delta")), [], ["delta"], replicates)
    if draws is not None:
        ap = []
        for name in scores:
            total, pos, _ = sorted_curve(cells(name), [("score", "desc")], "pos", "neg", draws, average_precision_step)
            ap.append(np.divide(total, pos, out=np.full(len(total), np.nan), where=pos > 0))
        return interval(as_rows(draws, rows.sparkSession, {"delta": ap[1] - ap[0]}), [], ["delta"], replicates)
    draws, parts = component_draws(rows, component, replicates, context), []
    for name in scores:
        m = F.col("multiplicity")
        steps = running_totals(cells(name).join(draws, component), ["replicate"], "score", {"pos": F.sum(F.col("pos") * m), "neg": F.sum(F.col("neg") * m)}, "desc")
        ap = steps.groupBy("replicate").agg(
            (F.sum(F.col("pos") * ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")).alias("ap"))
        parts.append(ap.withColumnRenamed("ap", "ap_" + name))
    both = parts[0].join(parts[1], "replicate").withColumn("delta", F.col("ap_" + scores[1]) - F.col("ap_" + scores[0]))
    return interval(both, [], ["delta"], replicates)


def oriented_auc_bootstrap(rows: DataFrame, group: str, domain: str, p: str, replicates: int, context: str) -> DataFrame:
    """Interval of max(AUC, 1-AUC) of a domain score, resampling clusters inside each domain."""
    one = F.col(domain) == 1
    cells = rows.groupBy(domain, group, F.col(p).cast("double").alias("score")).agg(F.count("*").alias("n"))
    draws = vector_draws(rows, group, replicates, context, [domain])
    if draws is not None:
        cells = cells.withColumns({"pos": F.when(one, F.col("n")).otherwise(0), "neg": F.when(one, 0).otherwise(F.col("n"))})
        places = place_sums(cells, "score", ["pos", "neg"], draws)
        if places is not None:
            above = Window.partitionBy("replicate").orderBy(F.col("score").desc_nulls_last())  # at most PLACES rows a replicate
            x = places.withColumns({"_p": F.sum("pos").over(above), "pos": F.col("pos").cast("double"), "neg": F.col("neg").cast("double")})
            auc = x.groupBy("replicate").agg(ratio(F.sum(F.col("neg") * (F.col("_p") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
            return interval(auc.select("replicate", F.greatest("auc", 1 - F.col("auc")).alias("auc")), [], ["auc"], replicates)
        total, pos, neg = sorted_curve(cells, [("score", "desc")], "pos", "neg", draws, auc_step)
        auc = np.divide(total, pos * neg, out=np.full(len(total), np.nan), where=pos * neg > 0)
        return interval(as_rows(draws, rows.sparkSession, {"auc": np.maximum(auc, 1 - auc)}), [], ["auc"], replicates)
    cells = cells.join(component_draws(rows, group, replicates, context, [domain]), [domain, group])
    m = F.col("n") * F.col("multiplicity")
    steps = running_totals(cells, ["replicate"], "score", {
        "pos": F.sum(F.when(one, m).otherwise(0)), "neg": F.sum(F.when(~one, m).otherwise(0))}, "desc")
    auc = steps.groupBy("replicate").agg(
        ratio(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    auc = auc.withColumn("auc", F.greatest("auc", 1 - F.col("auc")))
    return interval(auc, [], ["auc"], replicates)


def top_share_bootstrap(rows: DataFrame, component: str, score: str, tie: str, y: str, share: float, replicates: int,
                        context: str) -> DataFrame:
    """Interval of precision in the top share of drawn copies, cutting the last row's copies.

    floor(share * n) copies are kept per replicate; a row straddling the cut counts in part.
    """
    rows = cut_lineage(rows.select(component, score, tie, y))
    draws = vector_draws(rows, component, replicates, context)
    if draws is not None:
        known = rows.where(F.col(component).isNotNull()).select(component, score, tie, F.col(y).cast("int").alias("_y"))
        order = [(score, "desc"), (tie, "asc"), (component, "asc"), ("_y", "desc")]
        placed = cut_lineage(ranked(known, [], list(dict(order).items()), "_pos").select(component, "_pos", "_y"))
        n = placed.count()
        # copies before place share * n less that share of all copies have mean 0 and at most this deviation
        per = placed.groupBy(component).agg(F.count("*").alias("t"), n_if(F.col("_pos") <= share * n).alias("a"))
        off = F.col("a") - share * F.col("t")
        near = SPREAD * (per.agg(F.sum(off * off)).first()[0] or 0.0) ** 0.5 + SPREAD
        low, high = max(1, int(share * n - near)), min(n, int(share * n + near) + 1)
        cuts = cut_lineage(share_cuts(placed, share, draws, low, high))
        if (low > 1 or high < n) and not cuts.where("used is null").isEmpty():
            cuts = share_cuts(placed, share, draws, 1, n)
        top = F.when(F.col("k") > 0, F.col("used") / F.col("k"))
        return interval(cuts.select("replicate", top.alias("top_precision")), [], ["top_precision"], replicates)
    draws = component_draws(rows, component, replicates, context)
    cells = ranked(rows.select(component, score, tie, F.col(y).cast("int").alias("y")), [],
                   [(score, "desc"), (tie, "asc")], "position").join(draws, component)
    steps = running_totals(cells, ["replicate"], "position", {
        "m": F.sum("multiplicity"), "good": F.sum(F.col("multiplicity") * F.col("y"))}, "asc")
    n = steps.groupBy("replicate").agg(F.floor(F.lit(share) * F.max("cum_m")).alias("k"))
    s = steps.join(n, "replicate")
    before = F.col("cum_m") - F.col("m")
    used = F.least(F.col("m"), F.greatest(F.col("k") - before, F.lit(0)))
    y_row = F.when(F.col("good") > 0, 1).otherwise(0)
    reps = s.groupBy("replicate").agg(ratio(F.sum(used * y_row), F.max("k")).alias("top_precision"))
    return interval(reps, [], ["top_precision"], replicates)


#: Bytes of flipped sums that a task holds before it sends them on.
FLIP_BYTES = 1 << 26


def sign_flip_test(rows: DataFrame, value: str, replicates: int, context: str, by: list[str] | None = None) -> DataFrame:
    """Two-sided sign-flip permutation p of a mean per group, with the add-one correction.

    Rows of equal size |value| differ in sign alone: their flipped sum is |value| * (2 * ones - rows), where ones counts
    fair bits.  A hash deals the bits of 60 rows, so work is blocks x replicates, with a block per 60 equal sizes.
    Groups share the hashes: a block is hashed once, for all groups that have it.  A group of zeros alone has p = 1.
    """
    by = by or []
    v = F.col(value).cast("double")
    sizes = rows.where(v.isNotNull()).groupBy(*by, F.abs(v).alias("_v")).agg(F.count("*").alias("_c"), F.sum(v).alias("_s"))
    sizes = cut_lineage(sizes.withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_0"), *by))))
    seen = sizes.groupBy(*by, "_g").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("n"))
    blocks = sizes.where("_v > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / 60).cast("bigint"))))
    m = F.least(F.col("_c") - 60 * F.col("_b"), F.lit(60)).cast("int")
    place = F.round(F.col("_v"), 9).cast("decimal(38,9)").cast("string")
    tail = F.concat(F.lit("|"), key_text(place, F.col("_b")))
    # the rows of a block, one for each group, meet in a task
    blocks = blocks.select("_g", "_v", m.alias("_m"), tail.alias("_t"))
    tasks = rows.sparkSession.sparkContext.defaultParallelism * 4
    blocks = blocks.repartition(tasks, "_t").sortWithinPartitions("_t")

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, last, h = {}, None, None
        out = lambda: pa.record_batch([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["_g", "sums"])
        for batch in batches:
            for g, size, rows_of, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t != last:
                    last, h = t, numbered(f"{context}|".encode(), 0, replicates, t.encode())
                if g not in sums:
                    if (len(sums) + 1) * replicates * 8 > FLIP_BYTES and sums:
                        yield out()
                        sums.clear()
                    sums[g] = np.zeros(replicates)
                sums[g] += size * (2 * np.bitwise_count(h & ((1 << rows_of) - 1)).astype(np.int64) - rows_of)
        if sums:
            yield out()

    def reached(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(replicates)
        for s in part["sums"]:
            if s is not None:
                total += np.frombuffer(s)
        own = abs(float(part["_s"].iloc[0]))
        as_far = (np.abs(total) >= own - 1e-9 * max(own, 1.0)) | np.isnan(total)
        return pd.DataFrame({"_g": [part["_g"].iloc[0]], "exceed": [int(as_far.sum())]})

    sums = blocks.mapInArrow(flipped, "_g string, sums binary")
    hits = seen.select("_g", "_s").join(sums, "_g", "left").groupBy("_g").applyInPandas(reached, "_g string, exceed bigint")
    found = seen.join(hits, "_g")
    if not by:  # one row, also without rows
        found = found.agg(F.max("n").alias("n"), F.max("_s").alias("_s"), F.coalesce(F.max("exceed"), F.lit(0)).alias("exceed"))
    return found.select(*by, "n", F.round(F.col("_s") / F.col("n"), 9).alias("mean"), "exceed",
                        F.round((F.col("exceed") + 1) / (replicates + 1), 9).alias("p_value"))


#: Clusters of a piece, and how many standard errors around the expected cut a piece lists its clusters (or rows) one by one.
CLUSTERS, SPREAD = 1 << 16, 8.0


def cluster_label_permutation(scores: DataFrame, cluster: str, domain: str, p: str, replicates: int, context: str) -> DataFrame:
    """Permutation p of the oriented AUC of fixed scores when domain labels are shuffled over clusters.

    Each replicate gives the label 1 to the clusters with the smallest hashes, as many as carried it.  An AUC needs no more than
    its clusters' rows and rank sums, so scores are ranked once.  Hashes are even, so the cut of a replicate lies near
    ones / clusters of their range: a piece of the clusters adds up those well below it and lists those near it, which then are sorted by
    replicate.  Replicates whose cut lies elsewhere are sorted whole.  `refits.refit_permutation` fits the scores anew.
    """
    clean = scores.select(cluster, F.col(domain).cast("int").alias("d"), F.col(p).cast("double").alias("_p"))
    steps = running_totals(clean, [], "_p", {"_n": F.count("*")}, "asc")
    ranks = steps.select("_p", (F.col("cum__n") - (F.col("_n") - 1) / 2).alias("_rank"))  # equal scores share their mean rank
    cl = null_safe_join(clean, ranks, ["_p"]).groupBy(cluster).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.sum("_rank").alias("s"))
    cl = cut_lineage(cl.withColumn("_key", F.coalesce(F.col(cluster).cast("string"), F.lit(""))))
    size = cl.agg(F.count("*").alias("k"), F.sum("d").alias("one"), F.sum("n").alias("n")).first()
    total, ones, k = int(size.n or 0), int(size.one or 0), int(size.k)
    whole = cl.agg(F.sum(F.when(F.col("d") == 1, F.col("n"))).alias("n1"), F.sum(F.when(F.col("d") == 1, F.col("s"))).alias("s1"))
    share = ones / max(k, 1)
    near = SPREAD * ((share * (1 - share) / max(k, 1)) ** 0.5 + 1 / max(k, 1))
    low, high = (int(min(max(x, 0.0), 1.0) * (1 << 60)) for x in (share - near, share + near))

    def hashed(part: pd.DataFrame) -> pd.DataFrame:
        """One piece: for each replicate the clusters, rows and rank sum below the range of its cut, and lists of those in it."""
        keys, n, s, out = Keys([t.encode() for t in part["_key"]]), part["n"].to_numpy(np.int64), part["s"].to_numpy(np.float64), []
        for r in range(int(part["_chunk"].iloc[0]), replicates, chunks):
            h = keys.first60(f"{context}|{r}|".encode())
            below, at = h < low, np.flatnonzero((h >= low) & (h < high))
            out.append((r, int(below.sum()), int(n[below].sum()), float(s[below].sum()), h[at], part["_key"].to_numpy()[at], n[at], s[at]))
        return pd.DataFrame(out, columns=["replicate", "k", "n", "s", "hs", "keys", "ns", "ss"])

    def drawn(part: pd.DataFrame) -> pd.DataFrame:
        """One replicate: rows and rank sum of its `ones` clusters of smallest hashes, null if its cut is out of range."""
        below = int(part["k"].sum())
        near_by = sorted((h, t, n, s) for row in zip(part["hs"], part["keys"], part["ns"], part["ss"]) for h, t, n, s in zip(*row))
        r, chosen = int(part["replicate"].iloc[0]), near_by[:max(ones - below, 0)]
        if below > ones or below + len(chosen) < ones:
            return pd.DataFrame({"replicate": [r], "n1": pd.array([None], "Int64"), "s1": [None]})
        return pd.DataFrame({"replicate": [r], "n1": pd.array([int(part["n"].sum() + sum(c[2] for c in chosen))], "Int64"),
                             "s1": [float(part["s"].sum() + sum(c[3] for c in chosen))]})

    n_pieces = max(-(-k // CLUSTERS), 1)
    chunks = min(max(1, scores.sparkSession.sparkContext.defaultParallelism * 4 // n_pieces), replicates)  # of replicates: few pieces still fill the tasks
    pieces = cl.select("_key", "n", "s", F.pmod(F.xxhash64("_key"), F.lit(n_pieces)).alias("_piece"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    # a count of its own, as few bytes here mean much work
    pieces = pieces.repartition(2 * n_pieces * chunks, "_piece", "_chunk").groupBy("_piece", "_chunk")
    lists = pieces.applyInPandas(hashed, "replicate int, k bigint, n bigint, s double, hs array<bigint>, keys array<string>, ns array<bigint>, ss array<double>")
    reps = cut_lineage(lists.groupBy("replicate").applyInPandas(drawn, "replicate int, n1 bigint, s1 double"))
    if not reps.where("n1 is null").isEmpty():
        again = cl.select("_key", "n", "s").crossJoin(reps.where("n1 is null").select("replicate"))
        again = again.withColumn("_h", u60(key_text(context, F.col("replicate"), F.col("_key"))))
        again = ranked(again, ["replicate"], [("_h", "asc"), ("_key", "asc")], "_r").where(F.col("_r") <= ones)
        reps = reps.where("n1 is not null").unionByName(again.groupBy("replicate").agg(F.sum("n").alias("n1"), F.sum("s").alias("s1")))
    pairs = F.col("n1") * (F.lit(total) - F.col("n1"))
    a = ratio(F.col("s1") - F.col("n1") * (F.col("n1") + 1) / 2, pairs.cast("double"))
    oriented = F.round(F.greatest(a, 1 - a), 9).alias("auc")
    x = attach_one_row(reps.select("replicate", oriented), whole.select(oriented).withColumnRenamed("auc", "observed"))
    hits = n_if(F.col("auc") >= F.col("observed"))
    return x.agg(F.max("observed").alias("auc"), hits.alias("exceed"), F.round((hits + 1) / (replicates + 1), 9).alias("p_value"))


def random_panel_expectation(rows: DataFrame, query: str, item: str, value: str, hit: str, size: int) -> DataFrame:
    """Expected best value and hit rate of a uniform random panel of `size` items per query, in closed form.

    The item of rank i from below among n is the best of a panel of k with chance C(i-1, k-1) / C(n, k); a panel misses all
    h hits with chance C(n-h, k) / C(n, k).  Items without a value never are the best.  A query with fewer items is one panel.
    """
    x = rows.select(query, item, F.col(value).cast("double").alias("v"), F.col(hit).cast("int").alias("h"))
    x = ranked(x, [query], [("v", "desc"), (item, "asc")], "_r")  # nulls last
    x = null_safe_join(x, x.groupBy(query).agg(F.count("*").alias("_n")), [query])
    i, n = F.col("_n") - F.col("_r") + 1, F.col("_n")
    k = F.least(F.lit(size), n)

    def chance(top: Column, bottom: Column, terms: int, used: Column) -> Column:
        """Product of (top - j) / (bottom - j) over the first `used` of `terms` factors."""
        out = F.lit(1.0)
        for j in range(terms):
            out = out * F.when(F.lit(j) < used, F.greatest(top - j, F.lit(0)) / (bottom - j)).otherwise(1.0)
        return out

    best = k / n * chance(i - 1, n - 1, size - 1, k - 1)
    g = x.withColumn("_b", best * F.col("v")).groupBy(query, "_n").agg(F.sum("_b").alias("b"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    miss = chance(n - F.col("h"), n, size, k)
    return g.select(query, F.round("b", 9).alias("expected_best"), F.round(1 - miss, 9).alias("expected_hit"))


def bh_adjust(tests: DataFrame, p: str, tie: str, within: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    min over ranks >= r of p*m/rank, as a running minimum from the largest p down.
    """
    within = within or []
    r = ranked(tests.where(F.col(p).isNotNull()), within, [(p, "asc"), (tie, "asc")], "_rank")
    m = r.groupBy(*within).agg(F.count("*").alias("_m")) if within else r.agg(F.count("*").alias("_m"))
    r = r.join(m, within) if within else attach_one_row(r, m)
    # Slices keep a very long test list off one task: minimum inside a slice of ranks,
    # then with the minimum of the slices after it.
    raw = r.withColumns({"_q": F.col(p) * F.col("_m") / F.col("_rank"), "_slice": F.floor(F.col("_rank") / 1_000_000)})
    inner = Window.partitionBy(*within, "_slice").orderBy(F.col("_rank").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.col("_slice").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    per = raw.groupBy(*within, "_slice").agg(F.min("_q").alias("_m2")).withColumn("_after", F.min("_m2").over(later)).drop("_m2")
    out = raw.join(per, [*within, "_slice"]).withColumn(
        "adjusted", F.least(F.lit(1.0), F.min("_q").over(inner), F.coalesce("_after", F.lit(1.0))))
    return out.drop("_q", "_slice", "_after", "_rank", "_m")


def paired_difference(detail: DataFrame, by: list[str], high: str, low: str) -> DataFrame:
    """Risk difference, discordant counts, corrected odds ratio and exact McNemar p."""
    h, l = F.col(high).cast("int"), F.col(low).cast("int")
    s = detail.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.round(F.avg(h), 9).alias("high_rate"), F.round(F.avg(l), 9).alias("low_rate"),
        F.round(F.avg(h - l), 9).alias("risk_difference"), n_if((h == 1) & (l == 0)).alias("n10"),
        n_if((h == 0) & (l == 1)).alias("n01"))
    return s.withColumns({"odds_ratio": F.round((F.col("n10") + 0.5) / (F.col("n01") + 0.5), 9),
                          "mcnemar_p": F.round(exact_sign_p(F.col("n10"), F.col("n01")), 9)})
