"""Matrices in parquet folders, and as text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import TILE, TiledMatrix, unpack
from ..plans.strategy import written


def write(a: TiledMatrix, folder: str, name: str) -> None:
    """A dataset of a folder; it must not exist. Extents and type stand beside the tiles."""
    written(a.tiles, f"{folder}/{name}/tiles")
    meta = a.spark.createDataFrame([(a.m, a.n, a.mb, a.nb, a.dtype)], "m long, n long, mb int, nb int, dtype string")
    meta.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{name}/meta")


def read(spark: SparkSession, folder: str, name: str, tile: tuple[int, int] | None = None, dtype: str | None = None) -> TiledMatrix:
    """A dataset, with other tiles if wanted; its type must be the one asked for."""
    meta = spark.read.parquet(f"{folder}/{name}/meta").first()
    if dtype is not None and dtype != meta.dtype:
        raise TypeError(f"the dataset has elements of type {meta.dtype}, not {dtype}")
    a = TiledMatrix(spark.read.schema(TILE).parquet(f"{folder}/{name}/tiles"), meta.m, meta.n, meta.mb, meta.nb, meta.dtype)
    return a if tile is None or tile == (a.mb, a.nb) else a.retile(*tile)


def to_csv(a: TiledMatrix, digits: int = 5) -> str:
    """Rows of elements, each with a comma behind it; for small matrices (``write_csv`` for others)."""
    return "".join("".join(f"{_form(x, digits)}," for x in row) + "\n" for row in a.to_numpy())


def csv_lines(a: TiledMatrix, digits: int = 5) -> DataFrame:
    """(i, line) of the rows, made by rows of tiles; the lines are those of ``to_csv``."""
    bare = replace(a, tiles=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(ti: int, strip: np.ndarray) -> pa.RecordBatch:
            text = ["".join(f"{_form(x, digits)}," for x in row) for row in strip]
            return pa.RecordBatch.from_arrays([pa.array(range(ti * bare.mb, ti * bare.mb + len(text)), pa.int64()), pa.array(text)], ["i", "line"])

        now, strip = None, None
        for batch in batches:
            for ti, tj, x in unpack(batch):
                if ti != now:
                    if now is not None:
                        yield lines(now, strip)
                    now, strip = ti, np.zeros((min(bare.mb, bare.m - ti * bare.mb), bare.n), bare.numpy_type)
                strip[:, tj * bare.nb : tj * bare.nb + x.shape[1]] = x if bare.complex else x.real
        if now is not None:
            yield lines(now, strip)

    # A tile of zeros stands for each row of tiles, so that rows without tiles are written too.
    every = TiledMatrix.generate(a.spark, a.m, min(a.n, a.nb), a.mb, a.nb, lambda i, j: np.zeros((i.size, j.size)), a.dtype)
    rows = every.tiles.join(a.tiles.select("ti").distinct(), "ti", "left_anti").select(*a.tiles.columns).unionAll(a.tiles)
    return rows.repartition("ti").sortWithinPartitions("ti", "tj").mapInArrow(run, "i long, line string")


def write_csv(a: TiledMatrix, path: str, digits: int = 5) -> None:
    """A folder of text files which hold the rows in order, one file after another; nothing goes through the driver."""
    csv_lines(a, digits).orderBy("i").select("line").write.text(path)


def read_csv(spark: SparkSession, path: str, mb: int, nb: int) -> TiledMatrix:
    """A real matrix from text files with lines of numbers, each with a comma behind it."""
    from ..operators.shape import ranked

    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter("value != ''")
    numbered = ranked(lines, "file", "at").select("pos", F.transform(F.split(F.rtrim(F.col("value"), F.lit(",")), ","), lambda x: x.cast("double")).alias("row"))
    m, n = numbered.agg(F.count("pos"), F.max(F.size("row"))).first()
    coo = numbered.select(F.col("pos").alias("i"), F.posexplode("row").alias("j", "re"))
    return TiledMatrix.from_coo(coo, m, n or 0, mb, nb)


def _form(x: complex, digits: int) -> str:
    return f"({x.real:.{digits}g},{x.imag:.{digits}g})" if np.iscomplexobj(x) else f"{x:.{digits}g}"


def to_numpy_code(a: TiledMatrix, name: str = "mat") -> str:
    """Python code that makes the array."""
    form = lambda x: "np.nan" if np.isnan(x) else f"{x.real!r}{x.imag:+}j" if a.complex else f"{x!r}"
    dense = a.to_numpy()
    values = ", ".join(form(x.item()) for x in dense.ravel(order="F"))
    return f"{name} = np.array([{values}], dtype=np.{dense.dtype.name}).reshape({a.n}, {a.m}).T\n"


__all__ = ["csv_lines", "read", "read_csv", "replace", "to_csv", "to_numpy_code", "write", "write_csv"]
