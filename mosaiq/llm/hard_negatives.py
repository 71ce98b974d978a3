"""Operator 13: hard negatives by bit-sliced integer products.

Components are quantised to integers; a batch of rows is cut into bit planes (two's complement: the sign plane counts negatively).
For a block of anchors the products with the planes are added most significant first. After each plane the score lies
in [partial + (2^t - 1) x negative part, partial + (2^t - 1) x positive part], t planes being left, where the parts are
the sums of the anchor's negative and positive components. A pair goes as soon as that interval shows that it can't be
among an anchor's first positives, or outside of all wanted score ranges or behind the negatives found already; once
few pairs are left, only these are carried on, one by one. A pair that outlives the last plane has its exact score.

Anchors are dealt into blocks of at most ``ANCHORS`` by a hash; a block is sent to all tasks (a proven bound), and all rows pass by it
twice: for the positives, whose scores give the ranges, and for the negatives. Each task keeps the first few of each anchor
(and positive), and one window over these few ranks them. No pair is left out unless its interval rules it out.

Defined results: rows with a null id or label, a null or empty vector, or null or non-finite components take no part, nor do rows whose vector is of another length
than the anchor's (scores are of equal lengths); a row with the anchor's own id is neither its positive nor its negative; repeated rows are rows of their
own, but anchors that repeat a row exactly are one; components are cut off at +-2^20; an anchor without positives, or a positive without
negatives, gives no row; columns other than the three are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import Steps, shared_dir

#: Anchors that are sent to the tasks at once, and rows whose products are made at once.
ANCHORS, ROWS = 2048, 1024
#: Pairs are carried on one by one once fewer than one in so many are left.
SPARSE = 12
#: Pairs whose products are made at once then.
PAIRS = 1 << 16
SCALE, REACH = 256.0, float(1 << 20)


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, q) of the rows that take part; the label changes where the id is divisible by 7."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("q"))
    finite = F.forall("q", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = kept.filter("id is not null and label is not null and size(q) > 0").filter(finite)
    return kept.withColumn("label", label)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and integers of the vectors of a size."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values, ends = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), np.cumsum(lengths)
    at = np.flatnonzero(lengths == size)
    return at, np.clip(np.floor(SCALE * values[(ends[at] - size)[:, None] + np.arange(size)]), -REACH, REACH) if len(at) else np.zeros((0, size))


class Anchors:
    """A block of anchors of one vector size, in a fixed order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.below, self.above = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)


class Planes:
    """Bit planes of integer rows, the most significant first: (weight, planes left below it, bits)."""

    def __init__(self, q: np.ndarray):
        whole = q.astype(np.int64)
        self.count = int(max(np.abs(whole).max(initial=0), 1)).bit_length() + 1
        self.bits = [((whole >> p) & 1).astype(np.float64) for p in range(self.count - 1, -1, -1)]
        self.weights = [-float(1 << (self.count - 1)), *(float(1 << p) for p in range(self.count - 2, -1, -1))]

    def __iter__(self) -> Iterator[tuple[float, int, np.ndarray]]:
        return iter(zip(self.weights, range(self.count - 1, -1, -1), self.bits, strict=True))


def surviving(anchors: Anchors, which: np.ndarray, q: np.ndarray, wanted: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs that no interval rules out.

    which: the anchors that take part; wanted: anchors x rows; possible(anchor, least, most): whether such a score may still count.
    Arrays of the anchors' places and of both ends are of one shape, anchors x rows at first and pairs later.
    """
    a, below, above = anchors.q[which], anchors.below[which], anchors.above[which]
    partial, pairs, live = np.zeros(wanted.shape), None, wanted
    for weight, left, bits in Planes(q):
        room = float((1 << left) - 1)
        if pairs is None:
            partial += weight * (a @ bits.T)
            live &= possible(which[:, None], partial + room * below[:, None], partial + room * above[:, None])
            count = np.count_nonzero(live)
            if count * SPARSE < live.size or left == 0:
                pairs = np.nonzero(live)
                partial = partial[pairs]
        else:
            i, j = pairs
            for k in range(0, len(i), PAIRS):
                partial[k : k + PAIRS] += weight * np.einsum("pd,pd->p", a[i[k : k + PAIRS]], bits[j[k : k + PAIRS]])
            on = np.flatnonzero(possible(which[i], partial + room * below[i], partial + room * above[i]))
            pairs, partial = (i[on], j[on]), partial[on]
        if pairs is not None and not len(pairs[0]):
            break
    return which[pairs[0]], pairs[1], partial.astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, id_: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` of each group: higher scores, then smaller ids."""
    order = np.lexsort((id_, -score, group))
    group, score, id_ = group[order], score[order], id_[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
    keep = rank < most
    return group[keep], score[keep], id_[keep]


class Best:
    """The first few (score, id) of each group so far, and the score from which another may still count."""

    def __init__(self, groups: int, most: int):
        self.most, self.threshold = most, np.full(groups, -np.inf)
        self.group = self.score = self.id = np.zeros(0, np.int64)

    def take(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        self.group, self.score, self.id = _first(np.r_[self.group, group], np.r_[self.score, score], np.r_[self.id, id_], self.most)
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.threshold)) == self.most)
        last = np.searchsorted(self.group, full, side="right") - 1
        self.threshold[full] = self.score[last]


def _positives(anchors: Anchors, most: int, rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Best:
    best = Best(len(anchors.ids), most)
    possible = lambda at, low, high: high >= best.threshold[at]
    by_label = {y: np.flatnonzero(anchors.labels == y) for y in np.unique(anchors.labels)}
    for ids, labels, q in rows:
        for y in np.unique(labels):
            which, mine = by_label.get(y), np.flatnonzero(labels == y)
            if which is not None:
                at, row, score = surviving(anchors, which, q[mine], anchors.ids[which][:, None] != ids[mine][None, :], possible)
                best.take(at, score, ids[mine][row])
    return best


def _negatives(anchors: Anchors, most: int, low: np.ndarray, high: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Best:
    """low, high: the score ranges, anchors x positives; those of missing positives are empty."""
    width = low.shape[1]
    best, every = Best(low.size, most), np.flatnonzero((low <= high).any(axis=1))

    def possible(at: np.ndarray, least: np.ndarray, top: np.ndarray) -> np.ndarray:
        bound, out = np.maximum(low, best.threshold.reshape(low.shape)), np.zeros(least.shape, bool)
        for k in range(width):
            out |= (top >= bound[at, k]) & (least <= high[at, k])
        return out

    for ids, labels, q in rows:
        wanted = (anchors.labels[every][:, None] != labels[None, :]) & (anchors.ids[every][:, None] != ids[None, :])
        at, row, score = surviving(anchors, every, q, wanted, possible)
        inside, column = np.nonzero((score[:, None] >= np.maximum(low[at], best.threshold.reshape(low.shape)[at])) & (score[:, None] <= high[at]))
        best.take(at[inside] * width + column, score[inside], ids[row[inside]])
    return best


def _pass(rows: DataFrame, anchors: Anchors, how) -> DataFrame:
    """(grp, score, id): what each task keeps."""
    size = anchors.q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    at, q = _matrix(part.column(2), size)
                    if len(at):
                        yield part.column(0).to_numpy()[at], part.column(1).to_numpy()[at], q

        best = how(parts())
        yield pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.score), pa.array(best.id)], ["grp", "score", "id"])

    return rows.mapInArrow(run, "grp long, score long, id long")


def _ranked(kept: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, range_: tuple[int, int]) -> DataFrame:
    spark, count = rows.sparkSession, len(anchors.ids)
    sent = spark.sparkContext.broadcast(anchors)
    first = _ranked(_pass(rows, anchors, lambda parts: _positives(sent.value, positives, parts)), positives)
    # At most ANCHORS x positives rows.
    found = first.collect()
    group, rank = (np.array([r[c] for r in found], np.int64) for c in ("grp", "rank"))
    score, ids = np.zeros((count, positives), np.int64), np.zeros((count, positives), np.int64)
    low, high = np.full((count, positives), 1, np.int64), np.zeros((count, positives), np.int64)
    if len(found):
        score[group, rank - 1], ids[group, rank - 1] = [r["score"] for r in found], [r["id"] for r in found]
        value = score[group, rank - 1]
        low[group, rank - 1], high[group, rank - 1] = -((-range_[0] * value) // 100), (range_[1] * value) // 100
    ranges = spark.sparkContext.broadcast((low, high))
    last = _ranked(_pass(rows, anchors, lambda parts: _negatives(sent.value, negatives, *ranges.value, parts)), negatives)
    names = pa.table({"grp": pa.array(np.arange(count * positives)), "anchor_id": pa.array(np.repeat(anchors.ids, positives)), "positive_id": pa.array(ids.ravel()), "positive_score": pa.array(score.ravel())})
    named = spark.createDataFrame(names)
    return last.join(F.broadcast(named), "grp").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, range_: tuple[int, int] = (30, 90), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id ``every`` divides."""
    spark = rows.sparkSession
    table = quantised(rows, id_col, label_col, vector_col)
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    with Steps(spark) as steps:
        chosen = steps.stored(table.filter(F.col("id") % every == 0).distinct().withColumn("hash", F.xxhash64("id", "label", "q")), "anchors")
        sizes = {r["size"]: r["count"] for r in chosen.groupBy(F.size("q").alias("size")).count().collect()}
        made = 0
        for size, count in sorted(sizes.items()):
            # Twice as many blocks as could do: a block's hashes are spread too evenly to fill it, and what were over is split.
            parts = 1 if count <= block else 2 * -(-count // block)
            waiting = [(k, parts) for k in range(parts)]
            while waiting:
                k, of = waiting.pop()
                got = chosen.filter((F.size("q") == size) & (F.pmod("hash", F.lit(of)) == k)).limit(block + 1).toArrow()
                if got.num_rows > block:
                    waiting += [(k, 2 * of), (k + of, 2 * of)]
                    continue
                if got.num_rows:
                    got = got.combine_chunks()
                    q = _matrix(got.column("q").chunk(0), size)[1]
                    anchors = Anchors(got.column("id").to_numpy(), got.column("label").to_numpy(), q)
                    _block(table, anchors, positives, negatives, range_).write.mode("append").parquet(folder)
                    made += 1
    return spark.read.schema(RESULT).parquet(folder) if made else spark.createDataFrame([], RESULT)
