"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltrail.session import shared_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: lineage ends at files every executor sees."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.staged_folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark clean the shuffle files of the steps behind them."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def text_of(text_col: str) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
