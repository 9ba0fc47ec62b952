"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labeltrail.llm.common import partitions, text_of
from labeltrail.session import cut_lineage


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in id order, cut where the running bytes pass equal targets.

    Sizes, not texts, are range-partitioned by id; each partition's total is added up over the partitions before it,
    and running sums inside a partition complete the global prefix sum.  A document goes to the shard in which its middle
    byte falls, so a shard differs from the target by at most one document at each end.  `slot` counts from 0 inside a
    shard.  The one table held whole has a row per partition.

    Null text: size 1.  Null ids come first.  Rows with one id are ordered by checksum, hash and size; rows equal in all
    of these are interchangeable.  An id with many rows is split by the order of its rows.  Empty table: no rows.
    Other columns of `docs` are not read.
    """
    order = ["doc_id", "text_crc32", "_hash", "size", "_row"]
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(partitions(docs), *order).withColumn("_part", F.spark_partition_id())
    rows = cut_lineage(rows)

    through = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select("_part", F.coalesce(F.sum("_bytes").over(through), F.lit(0)).alias("_bytes_before"),
                           F.coalesce(F.sum("_rows").over(through), F.lit(0)).alias("_rows_before"),
                           F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"_sum": F.sum("size").over(inside), "_at": F.row_number().over(Window.partitionBy("_part").orderBy(*order))})
    placed = placed.join(F.broadcast(totals), "_part")  # a row per partition
    placed = placed.withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_sum")) - F.col("size"))
    placed = placed.withColumn("shard", F.expr(f"cast(least(_middle * {n_shards} div (2 * _total), {n_shards - 1}) as int)"))
    placed = placed.withColumn("_at", F.col("_rows_before") + F.col("_at"))
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"))
