"""Table sinks; Spark's committer makes each one all-or-nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.operators.checks import require_empty


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write a table whose folder must not exist yet and which must not be empty."""
    if df.isEmpty():
        raise ValueError("empty output table")
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {n: write_new(df, f"{folder}/{n}.tsv", "csv", sep="\t", header="true", emptyValue="") for n, df in tables.items()}


def write_table(df: DataFrame, path: str) -> str:
    """Writer chosen by suffix; text formats write null as `NA`."""
    if path.endswith(".parquet"):
        return write_zstd(df, path)
    sep = "," if path.endswith(".csv") else "\t"
    df.write.option("sep", sep).option("header", "true").option("nullValue", "NA").csv(path)
    return path


def write_zstd(df: DataFrame, path: str, rows_per_file: int | None = None) -> str:
    w = df.write.option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.parquet(path)
    return path


def write_tsv_gz(df: DataFrame, path: str) -> str:
    df.write.option("sep", "\t").option("header", "true").option("compression", "gzip").csv(path)
    return path


def write_bundle(df: DataFrame, folder: str) -> dict[str, str]:
    """The same rows as TSV and parquet; both are read back and must be equal multisets."""
    spark = df.sparkSession
    pq, tsv = write_zstd(df, f"{folder}/rows.parquet"), f"{folder}/rows.tsv"
    back = spark.read.parquet(pq)
    back.write.option("sep", "\t").option("header", "true").option("nullValue", "NA").csv(tsv)
    text = spark.read.schema(back.schema).option("sep", "\t").option("header", "true").option("nullValue", "NA").csv(tsv)
    require_empty(back.exceptAll(text), "rows missing from the TSV")
    require_empty(text.exceptAll(back), "rows only in the TSV")
    return {"parquet": pq, "tsv": tsv}


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """Files of a manifest (path, sha256) that are absent or whose content differs, and files it omits."""
    have = inventory(spark, path, pattern).select("path", F.col("sha256").alias("found"))
    j = manifest.select("path", F.col("sha256").alias("wanted")).join(have, "path", "full_outer")
    p = F.when(F.col("found").isNull(), "MISSING").when(F.col("wanted").isNull(), "UNLISTED").when(F.col("wanted") != F.col("found"), "DIFFERS")
    return j.select("path", p.alias("problem")).where(F.col("problem").isNotNull())


def adapt_scored(counts: DataFrame, library: DataFrame, selections: DataFrame, scored: DataFrame, method: str,
                 levels: dict[str, tuple[str, str]], rank: str, retained: int) -> dict[str, DataFrame]:
    """Wide scored tables to the four diagnostic tables; levels maps endpoint -> (label, score) column."""
    q = counts.where(F.col("method") == method).select("query_id", "endpoint", "truth_labels")
    items = F.inline(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(lb).alias("label"), F.col(s).cast("double").alias("score"))
                               for e, (lb, s) in levels.items()]))
    c = scored.select("query_id", F.col("row_id").alias("candidate_id"), (F.col(rank) <= retained).alias("retained"), items)
    c = c.where(F.col("label").isNotNull() & (F.col("label") != "")).select("query_id", "endpoint", "candidate_id", "label", "retained", "score")
    o = selections.select("query_id", "endpoint", F.col("row_id").alias("selected_candidate_id"), F.lit(None).cast("boolean").alias("accepted"))
    return {"queries": q, "library": library.select("endpoint", "label").distinct(), "candidates": c, "outputs": o}
