"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of an id filter, 64 bits each.
MOST_SLOTS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; on one machine, a fresh one where none is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "mosaiq-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def _written(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def stored(frame: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    return _written(frame, name)[0]


class Steps:
    """Stored tables of one operator's way to its result, dropped at the end of the block.

    What outlives the block must be stored outside: a lazy result may not read a step.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def stored(self, frame: DataFrame, name: str = "step") -> DataFrame:
        out, path = _written(frame, name)
        self.tables.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in [t for t in self.tables if any(t[0] is f for f in frames)]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            self.tables = [t for t in self.tables if t[0] is not frame]

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(t[0] for t in self.tables))


def flagged(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with ``__maybe``: false only where the value is surely not among ids.

    The ids are sent as a table of bits of at most 16 MB (``MOST_SLOTS`` rows), however many they are.
    """
    slots = 1 << 10
    count = ids.count()
    while slots < MOST_SLOTS and slots * 4 < count:
        slots *= 2
    bit = f"cast(pmod(shiftright(xxhash64({column}), 32), 64) as int)"
    slot = F.expr(f"pmod(xxhash64({column}), {slots})").alias("__slot")
    bits = ids.select(slot, F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("__slot").agg(F.bit_or("bit").alias("__bits"))
    joined = rows.withColumn("__slot", slot).join(F.broadcast(bits), "__slot", "left")
    return joined.withColumn("__maybe", F.expr(f"__bits is not null and (shiftright(__bits, {bit}) & 1L) = 1L")).drop("__slot", "__bits")


def free_memory() -> None:
    """Gives a Python worker's freed memory back to the system: workers outlive their tasks, and stages add up."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sha_of_text(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
