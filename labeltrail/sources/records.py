"""Record formats: FASTA, key-value flat files, XML entries and HTML detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.operators.checks import duplicate_keys, require_empty


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(id, sequence, sha256, length) of FASTA records; the id is the header's first word.

    Records split at a line that starts with `>`, so one may span input splits.  Empty
    sequences, other symbols than letters or `*`, and repeated ids fail.
    """
    rec = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    body = F.regexp_replace("value", r"^>", "")
    head = F.regexp_extract(body, r"^([^\s]+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s+", ""))
    x = rec.select(head.alias("id"), seq.alias("sequence"))
    bad = F.raise_error(F.concat(F.lit("bad sequence of "), F.col("id"))).cast("string")
    x = x.withColumn("sequence", F.when(F.col("sequence").rlike(r"^[A-Z*]+$"), F.col("sequence")).otherwise(bad))
    require_empty(duplicate_keys(x, ["id"]), "repeated FASTA ids")
    return x.select("id", "sequence", F.sha2("sequence", 256).alias("sha256"), F.length("sequence").alias("length"))


def fasta_hashes(spark: SparkSession, path, targets: DataFrame) -> DataFrame:
    return read_fasta(spark, path).select("id", "sha256").join(targets.select("id"), "id", "left_semi")


def read_flat_file(spark: SparkSession, path, terminator: str = "///") -> DataFrame:
    """One map of KEY -> text per record of a `KEY   value` flat file; repeated keys are joined by blanks."""
    rec = spark.read.option("lineSep", terminator + "\n").text(path).where(F.trim("value") != "")
    pairs = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, r"^(\S+)", 1))
    text = lambda x: F.trim(F.regexp_replace(x, r"^\S+\s*", ""))
    both = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("k"), text(x).alias("v")))
    names = F.array_distinct(keys)
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(both, lambda p: p["k"] == n), lambda p: p["v"]), " "))
    return rec.select(F.map_from_arrays(names, values).alias("record"))


ENTRY = """id string, name string, activity array<struct<_code:string, _VALUE:string>>,
 site array<struct<_position:int, _role:string>>"""


def read_entries(spark: SparkSession, path, row_tag: str = "entry", schema: str = ENTRY) -> DataFrame:
    """XML entries with nested activities and sites."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


def entry_activities(entries: DataFrame) -> DataFrame:
    return entries.select("id", F.posexplode("activity").alias("n", "a")).select(
        "id", "n", F.col("a._code").alias("code"), F.col("a._VALUE").alias("label"))


def entry_sites(entries: DataFrame) -> DataFrame:
    return entries.select("id", F.explode("site").alias("s")).select("id", F.col("s._position").alias("position"), F.col("s._role").alias("role"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Title, language, heading count and links of detail pages, from the whole html."""
    return pages.select(
        "page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r"<h[1-6]"), F.lit(0))).alias("headings"),
        F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)).alias("links"))
