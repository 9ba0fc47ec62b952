"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.lexical import SEARCH_SQL
from labeltrail.llm.licenses import scan_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_search": SEARCH_SQL, "op12_licenses": scan_sql()}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of nearly equal bytes."""
    from labeltrail.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def vocabulary_path() -> str:
    """Where the installed tokenizer files keep the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text."""
    from labeltrail.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Categories of the chain, in order, as conditions over the columns of `labels`.
TOXICITY = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of each category and the decision for every document."""
    from labeltrail.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), TOXICITY))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from the four fifths that are not held out."""
    from labeltrail.llm.langid import fit_language_codes, predict_language

    docs = table(spark, sf_dir, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit_language_codes(docs, fifth != 0)
    out = predict_language(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "ambiguous")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are at least 80 % alike."""
    from labeltrail.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2, percent=80)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items at least half of whose words they give away."""
    from labeltrail.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a 200-byte string that starts anywhere else goes."""
    from labeltrail.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-sampling fingerprints of every text and its edited text."""
    from labeltrail.llm.fingerprints import edited_fingerprints

    out = edited_fingerprints(table(spark, sf_dir, "documents"), samples=64, edited_as=lambda text: F.sha2(text, 256))
    return out.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of personal data in every document."""
    from labeltrail.llm.pii import KINDS, count_kind, find_personal, fit_redactor, span_text

    docs = table(spark, sf_dir, "documents")
    out = find_personal(docs, fit_redactor(docs))
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones; the text as a digest."""
    from labeltrail.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    from labeltrail.llm.lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    from labeltrail.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings on the eight components of largest variance; deviations beyond a long are null."""
    from labeltrail.llm.whitening import whitened_components

    out = whitened_components(table(spark, sf_dir, "embeddings"), k=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))
