"""Raw column-major arrays with a leading dimension, as a partitioned data source.

A dataset is a folder with one file for each column of tiles (its columns one after another, ld elements apart), or a single raw file that
others wrote. A partition is a range of columns: it seeks to its bytes and hands tiles on. The path must be one that all
executors can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..layout import require
from ..matrix import TILE, TiledMatrix, pack, unpack

_TYPES = {"s": np.float32, "d": np.float64, "c": np.complex64, "z": np.complex128}


@dataclass(frozen=True)
class Layout:
    """Elements (i, j) of an m x n array stand at offset + i + j ld, in elements."""

    path: str
    m: int
    n: int
    ld: int
    mb: int
    nb: int
    dtype: str
    offset: int = 0

    @classmethod
    def of(cls, options: dict[str, str]) -> Layout:
        number = lambda k, other=None: int(options.get(k, other))
        m = number("m")
        out = cls(options["path"].removeprefix("file://").removeprefix("file:"), m, number("n"), number("ld", max(m, 1)), number("mb"), number("nb"), options.get("dtype", "d"), number("offset", 0))
        require(out.ld >= max(out.m, 1), "the leading dimension is smaller than a column")
        require(out.dtype in _TYPES, "dtype is one of s, d, c, z")
        return out

    @property
    def element(self) -> np.dtype:
        return np.dtype(_TYPES[self.dtype])

    def part(self, tj: int) -> str:
        return f"{self.path}/columns-{tj:08d}.bin"

    def columns(self, tj: int) -> np.ndarray:
        """The columns of a column of tiles, without what stands between them."""
        count = min(self.nb, self.n - tj * self.nb)
        length = (count - 1) * self.ld + self.m  # what stands behind the last column need not be there
        if os.path.isdir(self.path):
            name, start = self.part(tj), 0
        else:
            name, start = self.path, self.offset + tj * self.nb * self.ld
        flat = np.fromfile(name, self.element, length, offset=start * self.element.itemsize)
        if len(flat) < length:
            raise EOFError(f"{name} ends before column {tj * self.nb + count - 1} does")
        return np.lib.stride_tricks.as_strided(flat, (self.m, count), (self.element.itemsize, self.ld * self.element.itemsize))


@dataclass
class Columns(InputPartition):
    tj: int

    def __init__(self, tj: int):
        self.tj = tj


class Reader(DataSourceReader):
    def __init__(self, layout: Layout):
        self.layout = layout

    def partitions(self) -> list[InputPartition]:
        x = self.layout
        return [Columns(tj) for tj in range(-(-x.n // x.nb))] if x.m else []

    def read(self, partition: Columns) -> Iterator[pa.RecordBatch]:
        x, columns = self.layout, self.layout.columns(partition.tj)
        for i in range(0, x.m, x.mb):
            yield pack([(i // x.mb, partition.tj, columns[i : i + x.mb])], x.dtype in "cz")


class Writer(DataSourceArrowWriter):
    """Tiles of a task arrive by columns of tiles; each column becomes one file, which gets its name when the job commits."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        x, attempt, made = self.layout, TaskContext.get().taskAttemptId(), []
        os.makedirs(x.path, exist_ok=True)
        now, whole = None, None

        def flush() -> None:
            whole.T.tofile(name := f"{x.part(now)}.{attempt}")
            made.append((name, x.part(now)))

        for batch in iterator:
            for ti, tj, tile in unpack(batch):
                if tj != now:
                    if now is not None:
                        flush()
                    now, whole = tj, np.zeros((x.ld, min(x.nb, x.n - tj * x.nb)), x.element, order="F")
                whole[ti * x.mb : ti * x.mb + len(tile), : tile.shape[1]] = tile if x.dtype in "cz" else tile.real
        if now is not None:
            flush()
        return Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        x = self.layout
        os.makedirs(x.path, exist_ok=True)
        there = set()
        for name, final in (f for m in messages if m for f in m.files):
            os.replace(name, final)
            there.add(final)
        for tj in range(-(-x.n // x.nb)):  # columns of zeros have no tiles
            if x.part(tj) not in there:
                np.zeros((min(x.nb, x.n - tj * x.nb), x.ld), x.element).tofile(x.part(tj))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(name):
                os.remove(name)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ColumnMajor(DataSource):
    """Options: path, m, n, ld (m), mb, nb, dtype (d), offset (0, in elements, for a single file)."""

    @classmethod
    def name(cls) -> str:
        return "columnmajor"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> DataSourceReader:
        return Reader(Layout.of(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        layout = Layout.of(self.options)
        require(overwrite or not os.path.isdir(layout.path) or not os.listdir(layout.path), "the dataset is there already")
        return Writer(layout)


def _options(a: TiledMatrix, path: str, ld: int | None, offset: int = 0) -> dict[str, str]:
    return {k: str(v) for k, v in {"path": path, "m": a.m, "n": a.n, "ld": ld or max(a.m, 1), "mb": a.mb, "nb": a.nb, "dtype": a.dtype, "offset": offset}.items()}


def write(a: TiledMatrix, path: str, ld: int | None = None) -> None:
    """A folder of raw column-major files; a task has the columns of some columns of tiles at a time."""
    a.spark.dataSource.register(ColumnMajor)
    dealt = a.tiles.repartition(max(1, min(a.columns.tiles, 4 * a.spark.sparkContext.defaultParallelism)), "tj").sortWithinPartitions("tj", "ti")
    dealt.write.format("columnmajor").options(**_options(a, path, ld)).mode("append").save()


def read(spark: SparkSession, path: str, m: int, n: int, mb: int, nb: int, ld: int | None = None, dtype: str = "d", offset: int = 0) -> TiledMatrix:
    """A matrix from a folder of ``write`` or from a single raw file, whose first element is ``offset`` elements from its start."""
    spark.dataSource.register(ColumnMajor)
    bare = TiledMatrix(spark.createDataFrame([], TILE), m, n, mb, nb, dtype)
    frame = spark.read.format("columnmajor").options(**_options(bare, path, ld, offset)).load()
    return TiledMatrix(frame, m, n, mb, nb, dtype)
