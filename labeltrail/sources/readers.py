"""Typed table readers.  Schemas are declared, never inferred, and bad rows fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.operators.checks import duplicate_keys, require_columns, require_empty

# The four diagnostic input tables.
QUERIES = "query_id string, endpoint string, truth_labels string"
LIBRARY = "endpoint string, label string"
CANDIDATES = "query_id string, endpoint string, candidate_id string, label string, retained string, score double"
OUTPUTS = "query_id string, endpoint string, selected_candidate_id string, accepted string"


def read_tsv(spark: SparkSession, path, schema: str, header: bool = True, comment: str | None = None, gz_partitions: int | None = None) -> DataFrame:
    """Tab-separated table; `.gz` is read natively, and spread out again when asked.

    A gzip file is one task, so `gz_partitions` repartitions what follows the scan.
    """
    r = spark.read.schema(schema).option("sep", "\t").option("header", str(header).lower()).option("mode", "FAILFAST").option("quote", "")
    if header:
        r = r.option("enforceSchema", "false")
    if comment:
        r = r.option("comment", comment)
    df = r.csv(path)
    return df.repartition(gz_partitions) if gz_partitions else df


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reader chosen by suffix: .parquet, .csv or tab-separated; `NA` is null in text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    sep = "," if path.endswith((".csv", ".csv.gz")) else "\t"
    return spark.read.schema(schema).option("sep", sep).option("header", "true").option("nullValue", "NA").option("mode", "FAILFAST").csv(path)


def projected(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Parquet scan that reads only the named columns; the filter is pushed down."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*columns)


def modality_scan(spark: SparkSession, path: str, modality: str, top: int, metrics: list[str]) -> DataFrame:
    """Rank-limited scan with modality-specific metric names."""
    df = spark.read.parquet(path).where(F.col("rank") <= top)
    return df.select("query_id", "reference_id", F.col("rank").alias(f"{modality}_rank"), *[F.col(m).alias(f"{modality}_{m}") for m in metrics])


def positional_hits(spark: SparkSession, path, schema: str, order: list[str]) -> DataFrame:
    """Headerless hit table; the input order is an explicit column list of the table itself.

    File position is not kept across splits, so the writer must supply an order column.
    """
    df = read_tsv(spark, path, schema, header=False)
    return require_columns(df, order, "hits")


def member_map(spark: SparkSession, path, ids: DataFrame) -> DataFrame:
    """Representative of each id: conflicts and unknown members fail, missing ids map to themselves."""
    m = read_tsv(spark, path, "representative string, member string", header=False).distinct()
    require_empty(duplicate_keys(m, ["member"]), "a member has several representatives")
    require_empty(m.join(ids.select(F.col("id").alias("member")), "member", "left_anti"), "members outside the id list")
    out = ids.select("id").join(m.withColumnRenamed("member", "id"), "id", "left")
    return out.select("id", F.coalesce("representative", "id").alias("representative"))


def read_json_document(spark: SparkSession, path, schema: str, whole_file: bool = True) -> DataFrame:
    """JSON documents: one per file (small manifests and rules), or one per line when large."""
    return spark.read.schema(schema).option("multiLine", str(whole_file).lower()).option("mode", "FAILFAST").json(path)


def report_rows(spark: SparkSession, path, minimum_fields: int) -> DataFrame:
    """Whitespace-delimited report lines as field arrays; comments and blanks skipped, short lines fail."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("fields"))
    bad = F.raise_error(F.concat(F.lit("short report line: "), F.array_join("fields", " "))).cast("array<string>")
    return f.select(F.when(F.size("fields") >= minimum_fields, F.col("fields")).otherwise(bad).alias("fields"))


def shard_set(spark: SparkSession, paths: list[str], schema: str, keys: list[str], name: Column) -> DataFrame:
    """Headerless shards with a shard id from the file name; every shard must hold rows and keys stay unique."""
    df = read_tsv(spark, paths, schema, header=False).withColumn("shard", name)
    found = df.select("shard").distinct().count()
    if found != len(paths):
        raise ValueError(f"{found} of {len(paths)} shards hold rows")
    require_empty(duplicate_keys(df, keys), "repeated keys across shards")
    return df


def merged_chunks(spark: SparkSession, paths: list[str], keys: list[str]) -> DataFrame:
    """Union of disjoint parquet chunks; a key in two chunks fails."""
    df = spark.read.parquet(*paths)
    require_empty(duplicate_keys(df, keys), "chunks overlap")
    return df


def diagnostic_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four TSV inputs, typed for the support trace."""
    from labeltrail.functions.states import flag

    read = lambda n, s: read_tsv(spark, f"{folder}/{n}.tsv", s)
    q = read("queries", QUERIES)
    parsed = F.from_json("truth_labels", "array<string>", {"mode": "FAILFAST"})
    c, o = read("candidates", CANDIDATES), read("outputs", OUTPUTS)
    blank = lambda x: F.when(F.col(x) != "", F.col(x))
    return {
        "queries": q.withColumn("truth_labels", F.array_distinct(parsed)), "library": read("library", LIBRARY).distinct(),
        "candidates": c.withColumn("retained", flag("retained")),
        "outputs": o.withColumns({"selected_candidate_id": blank("selected_candidate_id"), "accepted": flag("accepted", optional=True)})}


def trace_input_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(problem, query_id, endpoint) rows for every rule the trace relies on."""
    q, lib, c, o = (tables[k] for k in ("queries", "library", "candidates", "outputs"))
    key = ["query_id", "endpoint"]
    tag = lambda df, p: df.select(F.lit(p).alias("problem"), *key)
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    kept = c.where("retained").select(*key, F.col("candidate_id").alias("selected_candidate_id"))
    chosen = o.where(F.col("selected_candidate_id").isNotNull())
    parts = [
        tag(duplicate_keys(q, key), "REPEATED_QUERY"), tag(duplicate_keys(o, key), "REPEATED_OUTPUT"),
        tag(q.join(o, key, "left_anti"), "QUERY_WITHOUT_OUTPUT"), tag(o.join(q, key, "left_anti"), "OUTPUT_WITHOUT_QUERY"),
        tag(c.join(q, key, "left_anti"), "UNKNOWN_QUERY"), tag(duplicate_keys(c, [*key, "candidate_id"]), "REPEATED_CANDIDATE"),
        tag(c.join(lib, ["endpoint", "label"], "left_anti"), "LABEL_OUTSIDE_LIBRARY"),
        tag(c.where(F.col("retained") & ~finite), "RETAINED_WITHOUT_SCORE"),
        tag(chosen.join(kept, [*key, "selected_candidate_id"], "left_anti"), "SELECTED_NOT_RETAINED"),
        tag(o.where(F.col("accepted") & F.col("selected_candidate_id").isNull()), "ACCEPTED_WITHOUT_SELECTION")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
