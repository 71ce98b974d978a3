"""The Gram matrix of rows that arrive in a stream.

Each micro-batch adds its own Gram matrix, written under the batch's number: a batch that is run again after a
failure replaces itself, so the sum over all batches counts every row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_gram(rows: DataFrame, values: str) -> DataFrame:
    """(i, j, re) of the rows' Gram matrix: products inside a row, summed before and after the shuffle."""
    flat = rows.select(F.col(values).alias("v"))
    pairs = flat.select("v", F.posexplode("v").alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y"))
    return pairs.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("re"))


def start(stream: DataFrame, folder: str, checkpoint: str, values: str = "embedding", **trigger: object) -> StreamingQuery:
    """Keep the Gram matrix of a stream of arrays under a folder."""

    def add(batch: DataFrame, number: int) -> None:
        batch_gram(batch, values).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def total(spark: SparkSession, folder: str) -> DataFrame:
    """The Gram matrix of all rows so far, as coordinates."""
    return spark.read.schema("i long, j long, re double, batch long").parquet(folder).groupBy("i", "j").agg(F.sum("re").alias("re"))
