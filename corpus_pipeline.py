"""From raw documents to token ids: toxic documents, repeated lines, near duplicates and leaked test items go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next one.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.bpe import encode_decode
from labeltrail.llm.common import staged
from labeltrail.llm.decontamination import contaminated
from labeltrail.llm.hyperminhash import near_duplicates
from labeltrail.llm.line_dedup import without_repeated_lines
from labeltrail.llm.queries import TOXICITY, table, vocabulary_path
from labeltrail.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), TOXICITY))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, n_chars counted anew; documents that lost every line go."""
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles, that of the smallest id; rows repeated whole once."""
    found = near_duplicates(docs, words_per_shingle=5, percent=80)
    found = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    odd = staged(found.where("not kept or n > 1"), "odd")
    repeated = docs.join(odd.where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(odd.select("doc_id"), "doc_id", "left_anti").unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no test item away."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them."""
    out = encode_decode(docs, vocabulary_path())
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
