"""Feature tables and fitted transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.functions.labels import cosine, jaccard, length_ratio, log1p_clip
from labeltrail.functions.measures import n_if, ratio, sigmoid
from labeltrail.operators.ranking import attach_one_row, exact_quantiles
from labeltrail.session import cut_lineage


def site_pair_means(sites: DataFrame) -> DataFrame:
    ok = F.col("status") == "PASS"
    m = lambda v: F.round(F.avg(F.when(ok, v.cast("double"))), 9)
    return sites.groupBy("pair_id").agg(
        F.count("*").alias("sites"), n_if(ok).alias("mapped"),
        m((F.col("query_symbol") == F.col("reference_symbol")).cast("int")).alias("identity"),
        m(F.col("query_position") - F.col("position")).alias("mean_shift"))


def status_shares(sites: DataFrame, by: list[str]) -> DataFrame:
    g = sites.groupBy(*by, "status").agg(F.count("*").alias("sites"), F.round(F.avg("query_position"), 9).alias("mean_position"))
    total = g.groupBy(*by).agg(F.sum("sites").alias("_n"))
    return g.join(total, by).select(*by, "status", "sites", F.round(F.col("sites") / F.col("_n"), 9).alias("share"), "mean_position")


def fit_numeric(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median, then mean and sample deviation after median imputation (0/null -> 1)."""
    row = None
    for c in columns:
        med = exact_quantiles(train, c, 2).where(F.col("step") == 1).select(F.col("quantile").alias(f"{c}__median"))
        row = med if row is None else attach_one_row(row, med)
    filled = attach_one_row(train.select(*columns), row)
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median"))
    stats = filled.agg(*[F.avg(v(c)).alias(f"{c}__mean") for c in columns],
                       *[F.stddev_samp(v(c)).alias(f"{c}__sd") for c in columns])
    scale = {f"{c}__scale": F.when(F.coalesce(F.col(f"{c}__sd"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd")) for c in columns}
    return attach_one_row(row, stats.withColumns(scale).drop(*[f"{c}__sd" for c in columns]))


def apply_numeric(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    x = attach_one_row(df, fitted)
    z = {c: (F.coalesce(F.col(c).cast("double"), F.col(f"{c}__median")) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in columns}
    return x.withColumns(z).drop(*fitted.columns)


def one_hot(df: DataFrame, column: str, levels: list[str]) -> dict[str, Column]:
    """0/1 column per known level; null is the level MISSING, unseen levels are all zero."""
    v = F.coalesce(F.col(column).cast("string"), F.lit("MISSING"))
    return {f"{column}_{lv}": (v == lv).cast("float") for lv in levels}


def linear_score(model: dict, columns: list[str]) -> Column:
    """Probability of a portable linear model: impute, missing flags, scale, dot, sigmoid.

    model: median, center, scale, coefficient per column (flags follow as `missing`),
    intercept.
    """
    z = F.lit(float(model["intercept"]))
    for c in columns:
        v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        x = F.coalesce(v, F.lit(float(model["median"][c])))
        z = z + (x - F.lit(float(model["center"][c]))) / F.lit(float(model["scale"][c])) * F.lit(float(model["coefficient"][c]))
        if c in model.get("missing", {}):
            z = z + v.isNull().cast("double") * F.lit(float(model["missing"][c]))
    return sigmoid(z)


def pair_features(pairs: DataFrame, query_meta: DataFrame, reference_meta: DataFrame) -> DataFrame:
    """Similarities, ratios, matches and availability flags of (query, reference) pairs.

    Metadata tables: (id, length, family, embedding, domains, has_structure).
    """
    q = query_meta.select(F.col("id").alias("query_id"), *[F.col(c).alias("q_" + c) for c in query_meta.columns if c != "id"])
    r = reference_meta.select(F.col("id").alias("reference_id"), *[F.col(c).alias("r_" + c) for c in reference_meta.columns if c != "id"])
    x = pairs.join(q, "query_id", "left").join(r, "reference_id", "left")
    both = F.col("q_embedding").isNotNull() & F.col("r_embedding").isNotNull()
    return x.select(
        *pairs.columns, F.when(both, F.round(cosine("q_embedding", "r_embedding"), 6)).alias("embedding_cosine"),
        F.round(length_ratio("q_length", "r_length"), 9).alias("length_ratio"),
        F.abs(F.col("q_length") - F.col("r_length")).cast("bigint").alias("length_difference"),
        F.round(log1p_clip(F.col("q_length")), 8).alias("log_query_length"),
        F.round(jaccard("q_domains", "r_domains"), 9).alias("domain_jaccard"),
        (F.col("q_family") == F.col("r_family")).cast("int").alias("family_match"),
        (F.col("q_has_structure") & F.col("r_has_structure")).cast("int").alias("both_structures"),
        both.cast("int").alias("embedding_available"))


def tool_evidence(votes: DataFrame, by: list[str], lead: str, second: str, others: list[str]) -> DataFrame:
    """One row per group: the lead tool's label with support, agreement and margin features.

    votes: (by.., method, channel, label, score, margin).  Missing tools stay null.
    """
    tools = [lead, second, *others]
    at = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    w = votes.groupBy(*by).agg(*[at(m, c).alias(f"{c}__{m}") for m in tools for c in ("label", "score", "margin", "channel")])
    w = w.where(F.col(f"label__{lead}").isNotNull())
    label = F.col(f"label__{lead}")
    has = {m: F.col(f"label__{m}").isNotNull() for m in tools}
    agree = {m: F.coalesce(F.col(f"label__{m}") == label, F.lit(False)) for m in tools}
    i = lambda c: c.cast("int")
    add = lambda cs: sum(cs, F.lit(0))
    names = F.filter(F.array(*[F.col(f"label__{m}") for m in tools]), lambda x: x.isNotNull())  # one entry per tool
    votes_of = lambda x: F.size(F.filter(names, lambda y: y == x))
    counts = F.transform(F.array_distinct(names), votes_of)
    w = w.withColumns({"_n": F.size(names), "_c": F.sort_array(counts, asc=False)})
    n, k = F.col("_n"), F.size("_c")
    h = F.aggregate("_c", F.lit(0.0), lambda s, x: s - (x / n) * F.log(x / n))
    first, runner = F.element_at("_c", 1), F.when(k > 1, F.element_at("_c", 2)).otherwise(0)
    mine = add(i(agree[m]) for m in tools)
    old_n, old_agree = add(i(has[m]) for m in others), add(i(agree[m]) for m in others)
    channels = F.size(F.array_distinct(F.filter(F.array(*[F.when(agree[m], F.col(f"channel__{m}")) for m in tools]), lambda x: x.isNotNull())))
    out = {
        "candidate_label": label, "available_old_tools": old_n, "available_tools": n, "candidate_set_size": k,
        "agreement_entropy": F.round(h / F.greatest(F.log(k.cast("double")), F.lit(1e-12)), 9), "candidate_votes": mine,
        "candidate_vote_fraction": F.round(mine / n, 9), "second_votes": runner, "vote_lead": mine - runner,
        "is_plurality": i(mine == first), "supporting_channels": channels, "old_agreement_count": old_agree,
        "second_old_agreement": add(i(F.coalesce(F.col(f"label__{m}") == F.col(f"label__{second}"), F.lit(False))) for m in others),
        "lead_second_agree": i(agree[second]), "lead_second_disagree": 1 - i(agree[second]),
        "old_agreement_fraction": F.round(old_agree / F.greatest(old_n, F.lit(1)), 9), "old_disagreement_count": old_n - old_agree}
    for m in tools:
        out[f"support_{m}"] = i(agree[m])
        out[f"score_{m}"] = F.col(f"score__{m}")
        out[f"margin_{m}"] = F.col(f"margin__{m}")
        out[f"support_score_{m}"] = F.when(agree[m], F.col(f"score__{m}"))
        out[f"support_margin_{m}"] = F.when(agree[m], F.col(f"margin__{m}"))
    for j in range(1, len(others) + 1):
        out[f"old_agree_ge{j}"] = i(old_agree >= j)
    return w.select(*by, *[v.alias(name) for name, v in out.items()])


def candidate_matrix(votes: DataFrame, by: list[str], methods: list[str], channels: dict[str, str]) -> DataFrame:
    """One row per (group, proposed label) with support, score and margin of every method."""
    at = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    cand = votes.groupBy(*by, "label").agg(
        *[F.coalesce(F.max((F.col("method") == m).cast("int")), F.lit(0)).alias(f"support_{m}") for m in methods],
        *[at(m, "score").alias(f"support_score_{m}") for m in methods], *[at(m, "margin").alias(f"support_margin_{m}") for m in methods])
    wide = votes.groupBy(*by).agg(*[at(m, "score").alias(f"query_score_{m}") for m in methods], F.count_distinct("method").alias("available_tools"))
    out = cand.join(wide, by)
    per = {}
    for m in methods:
        per.setdefault(channels[m], []).append(F.col(f"support_{m}"))
    chan = sum((F.greatest(*v) if len(v) > 1 else v[0] for v in per.values()), F.lit(0))
    return out.withColumns({"supporting_tools": sum((F.col(f"support_{m}") for m in methods), F.lit(0)), "supporting_channels": chan})


def outcome_targets(pairs: DataFrame, targets: list[str], nullable: list[str]) -> DataFrame:
    """0/1 target columns with evaluability masks; only nullable targets can be masked."""
    cols = {}
    for c in targets:
        cols["y_" + c] = F.coalesce(F.col(c), F.lit(False)).cast("float")
        cols["mask_" + c] = (F.col(c).isNotNull() if c in nullable else F.lit(True)).cast("float")
    return pairs.withColumns(cols)


def ensemble_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over seeds, rounded to single precision like the stored ensemble."""
    return df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).cast("float").alias("ensemble"))


def choose_blend(rows: DataFrame, first: str, second: str, y: str, weight: str, points: int = 40) -> DataFrame:
    """Blend weight with the best average precision; the smallest weight wins near ties.

    Rows of equal scores and outcome are added up before the grid multiplies them.
    """
    from labeltrail.operators.curves import ranking_metrics

    cells = cut_lineage(rows.groupBy(first, second, y).agg(F.sum(F.col(weight).cast("double")).alias(weight)))
    grid = cells.select(first, second, y, weight, F.explode(F.sequence(F.lit(0), F.lit(points))).alias("step"))
    a = F.col("step") / points
    grid = grid.withColumn("score", F.round(a * F.col(first) + (1 - a) * F.col(second), 9))
    m = ranking_metrics(grid, ["step"], "score", y, weight, curves=points + 1)
    best = m.agg(F.min(F.struct((-F.round("average_precision", 9)).alias("n"), "step")).alias("b"))
    return best.select(F.round(F.col("b.step") / points, 6).alias("alpha"), (-F.col("b.n")).alias("average_precision"))
