"""How an operation runs, from the sizes that are known before any job, and where its lineage ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A matrix of up to this order is handled by a single task where an operation has such a form.
LOCAL_MAX = 2048
#: A single task may be asked for up to this order: beyond it, a dense matrix and its workspace don't fit one.
TASK_MAX = 4096
#: An operand is sent to all tasks only up to this size; beyond it, operands meet in joins.
BROADCAST_BYTES = 64 << 20
#: Row groups of tables of tiles, at most: Spark's reader unpacks up to 4,096 rows of a group at once, which would be gigabytes of tiles.
ROW_GROUP_BYTES, ROW_GROUP_ROWS = 16 << 20, 256


def single_task(*orders: int, force: str | None = None) -> bool:
    if force not in (None, "task", "tiles"):
        raise ValueError("strategy is 'task' or 'tiles'")
    return force != "tiles" and max(orders, default=0) <= (TASK_MAX if force == "task" else LOCAL_MAX)


def fits_broadcast(rows: int, columns: int, dtype: str) -> bool:
    return rows * columns * (16 if dtype in "cz" else 8) <= BROADCAST_BYTES


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; on one machine, a fresh one where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "mosaiq-checkpoints")


def written(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The table as parquet, tiles in small row groups."""
    writer = frame.write.mode(mode)
    if {"nr", "nc", "re"} <= set(frame.columns):
        # The size of a group is that of its packed pages, in which zeros take no room: its rows are limited, too.
        writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", ROW_GROUP_ROWS).option("parquet.page.size.row.check.min", 4)
    writer.parquet(path)


def stored(frame: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read again, so a loop's lineage ends at each step."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables that a loop writes on its way, dropped when the next step no longer reads them, or at the end of the block.

    A lazy result may not read one: what outlives the block is stored outside of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def stored(self, frame: DataFrame) -> DataFrame:
        self.made += 1
        written(frame, path := f"{self.folder}/{self.made:06d}")
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop_before(self, kept: int = 1) -> None:
        """Drops all tables but the last ``kept``."""
        for k in range(max(1, self.made - kept - 8), self.made - kept + 1):
            self._delete(f"{self.folder}/{k:06d}")


def chain_order(sizes: list[int]) -> tuple[float, list]:
    """The cheapest order of a product of matrices with these sizes: flops, and nested pairs of indices."""
    n = len(sizes) - 1
    best: dict[tuple[int, int], tuple[float, object]] = {(k, k + 1): (0.0, k) for k in range(n)}
    for width in range(2, n + 1):
        for lo in range(n - width + 1):
            hi = lo + width
            best[lo, hi] = min(((best[lo, k][0] + best[k, hi][0] + 2.0 * sizes[lo] * sizes[k] * sizes[hi], [best[lo, k][1], best[k, hi][1]]) for k in range(lo + 1, hi)), key=lambda x: x[0])
    return best[0, n]
