"""Label identifiers, JSON sets, signatures and small numeric expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def sorted_json(values: Column) -> Column:
    """JSON text of a sorted distinct list."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def canonical_label(text, parts: int | None = None, prefix: str = "EC") -> Column:
    """Dotted label of 3 or 4 parts (digits or `-`) without prefix or blanks; blank text is null."""
    v = F.regexp_replace(F.trim(c(text)), rf"^(?i){prefix}[ :]*", "")
    v = F.regexp_replace(v, r"\s+", "")
    repeat = "{2,3}" if parts is None else f"{{{parts - 1}}}"
    ok = v.rlike(r"^([0-9]+|-)(\.([0-9]+|-))" + repeat + "$")
    return F.when(c(text).isNull() | (v == ""), F.lit(None).cast("string")).when(ok, v).otherwise(
        F.raise_error(F.concat(F.lit("malformed label: "), v)))


def ancestor(label, parts: int = 3) -> Column:
    """First `parts` parts of a dotted label; null when it has fewer."""
    v = c(label)
    return F.when(F.size(F.split(v, r"\.")) >= parts, F.substring_index(v, ".", parts))


def canonical_id(text, prefix: str = "RHEA") -> Column:
    """`PREFIX:digits`; blank text is null, anything else raises."""
    v = F.regexp_replace(F.regexp_replace(F.trim(c(text)), rf"^(?i){prefix}[ :]*", ""), r"\s+", "")
    return F.when(c(text).isNull() | (v == ""), F.lit(None).cast("string")).when(
        v.rlike("^[0-9]+$"), F.concat(F.lit(prefix + ":"), v)).otherwise(
        F.raise_error(F.concat(F.lit("malformed id: "), v)))


def json_set(text) -> Column:
    """JSON list text to a clean sorted set: trimmed, non-blank, distinct; blank text is empty."""
    parsed = F.from_json(F.coalesce(c(text), F.lit("[]")), "array<string>")
    clean = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>"))))


def json_object_ids(text, field: str = "id") -> Column:
    """Ids of a JSON list of objects, sorted and distinct."""
    parsed = F.from_json(F.coalesce(c(text), F.lit("[]")), f"array<struct<{field}:string>>")
    ids = F.filter(F.transform(parsed, lambda x: x[field]), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))


def accession(name) -> Column:
    """Accession inside a predicted-model name, else the first word, upper-cased."""
    inner = F.regexp_extract(c(name), r"(?i)AF-([A-Z0-9]+)-F[0-9]+", 1)
    return F.upper(F.when(inner != "", inner).otherwise(F.element_at(F.split(F.trim(c(name)), r"\s+"), 1)))


def leading_integer(text) -> Column:
    return F.regexp_extract(c(text), r"^([0-9]+)", 1).try_cast("int")


def equation_sides(text, token: str) -> tuple[Column, Column]:
    """Participant ids on the left and right of `=` in an equation."""
    sides = F.split(c(text), "=", 2)
    ids = lambda s: F.regexp_extract_all(s, F.lit(token), F.lit(0))
    return ids(sides.getItem(0)), ids(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))


def signature(left, right, directional: bool = True) -> Column:
    """Order-free hash of two participant sides; directionless also ignores which side is left."""
    a, b = (F.array_join(F.array_sort(c(x)), ",") for x in (left, right))
    text = F.concat_ws(">>", a, b) if directional else F.concat_ws("||", F.least(a, b), F.greatest(a, b))
    empty = (F.size(c(left)) == 0) & (F.size(c(right)) == 0)
    return F.when(~empty, F.sha2(text, 256))


def jaccard(a, b) -> Column:
    x, y = F.array_distinct(c(a)), F.array_distinct(c(b))
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / u)


def dot(a, b) -> Column:
    prod = F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def composition(text, alphabet: str) -> Column:
    """Share of each symbol of the alphabet among the symbols of the alphabet in a text.

    A flat array of 20 plain divisions: the shared total is computed once per row.
    """
    t = c(text)
    total = F.length(F.regexp_replace(t, f"[^{alphabet}]", ""))
    return F.array(*[F.coalesce(F.try_divide(
        (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))).cast("double"), total.cast("double")), F.lit(0.0)) for s in alphabet])


def length_ratio(a, b) -> Column:
    x, y = c(a).cast("double"), c(b).cast("double")
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y))


def log1p_clip(x) -> Column:
    return F.log1p(F.greatest(c(x).cast("double"), F.lit(0.0)))


def ordered_case(x: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """First name whose upper edge (inclusive) covers the value."""
    out = None
    for edge, name in edges:
        out = F.when(x <= edge, name) if out is None else out.when(x <= edge, name)
    return out.otherwise(last)


def evidence_tier(codes, gold: list[str], silver: list[str]) -> Column:
    """Best tier of an evidence-code set."""
    v = c(codes)
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (F.when(v.isNull() | (F.size(v) == 0), "UNATTRIBUTED").when(F.arrays_overlap(v, lit(gold)), "GOLD")
            .when(F.arrays_overlap(v, lit(silver)), "SILVER").otherwise("OTHER"))


def keyword_class(text, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """First rule whose pattern occurs in the lower-cased text."""
    low = F.lower(c(text))
    out = None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(default)


def member_share(values, members: list[str]) -> Column:
    """Share of list entries (with repeats) that belong to a fixed set; 0 for empty lists."""
    v = c(values)
    keep = F.filter(v, lambda x: x.isin(members))
    return F.when(F.size(v) > 0, F.size(keep) / F.size(v)).otherwise(0.0)


# Length bins, taxonomy strata and cofactor keywords, in decision order.
LENGTH_BINS = [(150, "0001-0150"), (250, "0151-0250"), (400, "0251-0400"), (600, "0401-0600"), (1000, "0601-1000")]
TAXONOMY = ["BACTERIA", "ARCHAEA", "EUKARYOTA", "VIRUSES"]
COFACTORS = [("NAD_OR_NADP", "nad"), ("FLAVIN", "flavin|fad|fmn"), ("COENZYME_A", "coenzyme a|coa"),
             ("ATP", "atp|adenosine triphosphate"), ("METAL", "iron|zinc|magnesium|manganese|copper|cobalt")]
NO_VALUE = ["", "UNASSIGNED", "NAN", "NONE", "NA"]


def length_bin(n) -> Column:
    return ordered_case(c(n), LENGTH_BINS, "1001+")


def taxonomy_stratum(lineage, names: list[str] = TAXONOMY) -> Column:
    """First domain name found in the lineage text."""
    text = F.upper(F.coalesce(c(lineage), F.lit("")))
    out = None
    for n in names:
        out = F.when(text.contains(n), n) if out is None else out.when(text.contains(n), n)
    return out.otherwise("OTHER_OR_UNKNOWN")


def family_stratum(family, clan) -> Column:
    has = lambda x, none: ~F.upper(F.trim(F.coalesce(c(x), F.lit("")))).isin(none)
    fam, cl = has(family, NO_VALUE), has(clan, [*NO_VALUE, "NO_CLAN"])
    return F.when(~fam, "NO_FAMILY").when(~cl, "FAMILY_NO_CLAN").otherwise("FAMILY_WITH_CLAN")


def structure_stratum(experimental, predicted) -> Column:
    e, p = F.coalesce(c(experimental), F.lit(False)), F.coalesce(c(predicted), F.lit(False))
    return F.when(e, "EXPERIMENTAL").when(p, "PREDICTED_ONLY").otherwise("NO_STRUCTURE")


def interpolate(x, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear lookup, clipped at both ends (breakpoints are a short fitted list)."""
    v = c(x).cast("double")
    out = F.when(v <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs[:-1], xs[1:], ys[:-1], ys[1:]):
        out = out.when(v <= x1, F.lit(float(y0)) + F.lit((y1 - y0) / (x1 - x0)) * (v - F.lit(float(x0))))
    return out.when(v.isNotNull(), F.lit(float(ys[-1])))


def any_flag(*flags) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c(f), F.lit(False)) for f in flags])


def first_id(ids, missing: str = "UNASSIGNED") -> Column:
    """Lexicographically first id of a list, or the missing marker."""
    return F.coalesce(F.array_min(F.filter(c(ids), lambda x: x.isNotNull() & (x != ""))), F.lit(missing))


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are present, weights renormalised."""
    zero = F.lit(0.0)
    num = sum((F.coalesce(p, zero) * w for p, w in parts), zero)
    den = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(zero) for p, w in parts), zero)
    return F.when(den > 0, num / den)
