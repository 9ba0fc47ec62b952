"""Label catalogues: entry status, replacements and multi-id resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalogue_status(entries: DataFrame, id_pattern: str) -> DataFrame:
    """Status and canonical id of catalogue entries (raw_id, description).

    An active entry is its own canonical id; a transferred one has a canonical id only when
    its text names exactly one replacement; a deleted one has none.
    """
    low = F.lower("description")
    status = (F.when(low.contains("transferred entry"), "TRANSFERRED").when(low.contains("deleted entry"), "DELETED").otherwise("ACTIVE"))
    named = F.array_distinct(F.regexp_extract_all("description", F.lit(id_pattern), F.lit(0)))
    others = F.filter(named, lambda x: x != F.col("raw_id"))
    e = entries.select("raw_id", status.alias("status"), others.alias("_o"))
    single = F.when(F.size("_o") == 1, F.element_at("_o", 1))
    return e.select("raw_id", "status", F.array_join(F.array_sort("_o"), ",").alias("replacements"),
                    F.when(F.col("status") == "ACTIVE", F.col("raw_id")).when(F.col("status") == "TRANSFERRED", single).alias("canonical"))


def resolve_labels(rows: DataFrame, catalogue: DataFrame, complete: str) -> DataFrame:
    """Canonical label per row; labels absent from the catalogue stand if they are complete."""
    j = rows.join(catalogue.select("raw_id", F.col("status").alias("_s"), F.col("canonical").alias("_c")), "raw_id", "left")
    known, has = F.col("_s").isNotNull(), F.coalesce(F.col("raw_id"), F.lit("")) != ""
    status = F.when(known, F.col("_s")).when(has, "NOT_IN_CATALOGUE").otherwise("MISSING")
    own = F.when(F.col("raw_id").rlike(complete), F.col("raw_id"))
    return j.withColumns({"mapping_status": status, "canonical": F.when(known, F.col("_c")).otherwise(own)}).drop("_s", "_c")


def resolve_multi(queries: DataFrame, ids: DataFrame, masters: DataFrame) -> DataFrame:
    """Canonical id of a query from its raw ids when they agree on one master."""
    g = ids.join(masters, "raw_id", "left").groupBy("query_id").agg(
        F.count("*").alias("_n"), F.min("master").alias("_lo"), F.max("master").alias("_hi"))
    j = queries.select("query_id").join(g, "query_id", "left")
    one = F.col("_lo") == F.col("_hi")
    status = (F.when(F.col("_n").isNull(), "NO_RAW_ID").when(F.col("_lo").isNull(), "UNMAPPED").when(one, "CANONICALIZED").otherwise("MULTIPLE_MASTERS"))
    return j.select("query_id", F.when(one, F.col("_lo")).alias("canonical"), status.alias("status"))
