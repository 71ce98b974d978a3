"""Norms, permutations and index operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, pack, packed, unpack
from ..plans.strategy import BROADCAST_BYTES, stored


def max_norm(a: TiledMatrix, uplo: str = "G") -> float:
    """The largest modulus in the matrix or its triangle; 0 if it is empty."""
    t = a if uplo == "G" else a.triangle(uplo)
    modulus = F.expr("array_max(if(im is null, transform(re, x -> abs(x)), zip_with(re, im, (x, y) -> sqrt(x * x + y * y))))")
    return float(t.tiles.select(modulus.alias("v")).agg(F.max("v")).first()[0] or 0.0)


def permute(a: TiledMatrix, perm: DataFrame, axis: str, begin: int = 0, end: int | None = None) -> TiledMatrix:
    """out[:, pos] = in[:, src] (columns) or rows, inside the square tile range [begin, end); src and pos are
    relative to the range, what lies outside stays.

    A task cuts each tile into slices, one for each target tile; one shuffle brings the slices of a target together.
    """
    require(axis in ("rows", "columns"), "axis is rows or columns")
    end = max(a.rows.tiles, a.columns.tiles) if end is None else end
    inside = f"ti >= {begin} and ti < {end} and tj >= {begin} and tj < {end}"
    columns, size, offset = axis == "columns", a.nb if axis == "columns" else a.mb, begin * (a.nb if axis == "columns" else a.mb)
    moves = perm.select(F.expr(f"(src + {offset}) div {size}").alias("tj" if columns else "ti"), F.struct(F.expr(f"cast((src + {offset}) % {size} as int)").alias("src"), (F.col("pos") + offset).alias("pos")).alias("move"))
    # As many moves as a tile has rows or columns.
    moves = moves.groupBy("tj" if columns else "ti").agg(F.array_sort(F.collect_list("move")).alias("moves"))
    with_moves = a.tiles.filter(inside).join(moves, "tj" if columns else "ti").select(*a.tiles.columns, F.transform("moves", lambda x: x["src"]).alias("src"), F.transform("moves", lambda x: x["pos"]).alias("pos"))
    bare = replace(a, tiles=None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices, places = [], []
            for (ti, tj, x), src, pos in zip(unpack(batch), batch.column(6), batch.column(7), strict=True):
                src, pos = src.values.to_numpy(), pos.values.to_numpy()
                target = pos // size
                for t in np.unique(target):
                    some = target == t
                    slices.append((ti, t, x[:, src[some]]) if columns else (t, tj, x[src[some]]))
                    places.append((pos[some] % size).astype(np.int32))
            out = pack(slices, bare.complex)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(places, pa.list_(pa.int32()))], [*out.schema.names, "at"])

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            key, tile = None, None
            for batch in batches:
                for (ti, tj, x), at in zip(unpack(batch), batch.column(6), strict=True):
                    if key != (ti, tj):
                        if key is not None:
                            yield *key, tile
                        key, tile = (ti, tj), np.zeros((min(bare.mb, bare.m - ti * bare.mb), min(bare.nb, bare.n - tj * bare.nb)), x.dtype)
                    if columns:
                        tile[:, at.values.to_numpy()] = x
                    else:
                        tile[at.values.to_numpy()] = x
            if key is not None:
                yield *key, tile

        yield from packed(tiles(), bare.complex)

    slices = with_moves.mapInArrow(cut, f"{TILE}, at array<int>").repartition("ti", "tj").sortWithinPartitions("ti", "tj")
    return replace(a, tiles=slices.mapInArrow(paste, TILE).unionAll(a.tiles.filter(f"not ({inside})")))


def _offsets(counts: list[tuple]) -> list[tuple]:
    """(*key, sum of the counts before) for (*key, count) in the keys' order."""
    out, total = [], 0
    for *key, count in sorted(counts):
        out.append((*key, total))
        total += count
    return out


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their rank (from 0) in ``pos``: sorted by ranges, counted by partition, and moved by the counts before.

    A partition's count is all that comes to the driver; no row is sorted or numbered in a single task.
    """
    numbered = stored(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33).alias("__part")
    offsets = _offsets([tuple(r) for r in numbered.groupBy(part).count().collect()])
    before = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    joined = numbered.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn("pos", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def sort_index(values: DataFrame) -> DataFrame:
    """(pos, src): the permutation that sorts (idx, value) ascending, ties by index."""
    return ranked(values.select("idx", "value"), "value", "idx").select("pos", F.col("idx").alias("src"))


def stable_partition(rows: DataFrame) -> DataFrame:
    """(pos, src, type) for (idx, type): types one after another, the rows of a type in their order.

    Each partition of a range of indices counts its rows by type; sums of these counts over types and
    partitions say where the partition's rows of a type begin.
    """
    kind = dict(rows.dtypes)["type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            types = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.zeros(len(types), np.int64)
            for t in np.unique(types):
                mine = np.flatnonzero(types == t)
                at[mine] = np.arange(len(mine)) + seen.get(t, 0)
                seen[t] = seen.get(t, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(at), pa.int32()), pa.array(at)], ["src", "type", "part", "at"])

    dealt = rows.select("idx", "type").repartitionByRange("idx").sortWithinPartitions("idx")
    counted = stored(dealt.mapInArrow(run, f"src long, type {kind}, part int, at long"), "partition")
    offsets = _offsets([tuple(r) for r in counted.groupBy("type", "part").count().collect()])
    before = rows.sparkSession.createDataFrame(offsets, f"type {kind}, part int, before long")
    return counted.join(F.broadcast(before), ["type", "part"]).select((F.col("before") + F.col("at")).alias("pos"), "src", "type")


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos, run, src) for two runs (idx, value) that are sorted already, idx being the rank; of equal values a's come first.

    Each element finds its place in the other run by binary search, while a run may be broadcast; larger ones are ranked together.
    """
    spark, runs = a.sparkSession, [a.select("idx", "value"), b.select("idx", "value")]
    if max(r.count() for r in runs) * 8 > BROADCAST_BYTES:
        both = runs[0].withColumn("run", F.lit(0)).unionAll(runs[1].withColumn("run", F.lit(1)))
        return ranked(both, "value", "run", "idx").select("pos", "run", F.col("idx").alias("src"))

    def placed(k: int) -> DataFrame:
        other = spark.sparkContext.broadcast(np.sort(runs[1 - k].select("value").toArrow().column(0).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = np.searchsorted(other.value, batch.column(1).to_numpy(), "right" if k else "left")
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() + before), pa.array([k] * len(before), pa.int32()), batch.column(0)], ["pos", "run", "src"])

        return runs[k].mapInArrow(run, "pos long, run int, src long")

    return placed(0).unionAll(placed(1))


def apply_index(values: DataFrame, perm: DataFrame) -> DataFrame:
    """out[pos] = in[src]."""
    return perm.join(values.withColumnRenamed("idx", "src"), "src").select(F.col("pos").alias("idx"), "value")


def invert_index(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("src").alias("pos"), F.col("pos").alias("src"))


def add_index(perm: DataFrame, offset: int) -> DataFrame:
    return perm.select("pos", (F.col("src") + offset).alias("src"))


def paste(source: TiledMatrix, target: TiledMatrix, at: tuple[int, int]) -> TiledMatrix:
    """The target with the source at a place."""
    from .multiply import add

    there = source.window((0, 0), (source.m, source.n), at, (target.m, target.n), (target.mb, target.nb))
    (r, c), (m, n), mb, nb = at, (source.m, source.n), target.mb, target.nb

    def cleared(ti, tj, x):
        x = x.copy()
        x[max(0, r - ti * mb) : max(0, r + m - ti * mb), max(0, c - tj * nb) : max(0, c + n - tj * nb)] = 0
        return x

    return add(target.map_tiles(cleared), there)
