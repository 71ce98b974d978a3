"""Operator 6: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded (a hidden layer over its
character-class shares, repetition figures and hashed words), gated attention weighs the encodings, and the
weighted passage representation is scored. Only the document's label is known in training; the attention learns
which passages decide.

The fit uses at most ``MAX_DOCUMENTS`` labelled documents (those with the smallest hash of their id), each with all its
passages, and fewer documents where these would have more than ``MAX_PASSAGES`` passages together; both are parameters. Scoring reads every passage of every
document. Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text is a bag of one passage without words and gets a score; without labelled
rows every score is 0.5; documents with several labels count with the smallest, labelled rows that share an id with
the text of fewest passages; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Steps
from .words import Words, mix, slices, space_words, text_buffers, words_of

PASSAGE_WORDS = 64
MAX_DOCUMENTS = 4000
MAX_PASSAGES = 200_000
HASHED, HIDDEN, GATE = 64, 32, 16
THRESHOLD = 0.3

# Byte classes of the passage features.
BYTE_CLASSES = [bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"#*$%&|<>@^~", b"'\"()[]{}-_/\\", bytes(range(128, 256))]


def _class_of() -> np.ndarray:
    table = np.full(256, len(BYTE_CLASSES), np.uint8)
    for k, members in enumerate(BYTE_CLASSES):
        table[list(members)] = k
    return table


WIDTH = len(BYTE_CLASSES) + 1 + 8 + HASHED


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each document (one at least)."""
    counts = words.counts
    number = np.maximum(1, -(-counts // PASSAGE_WORDS))
    doc = np.repeat(np.arange(len(counts)), number)
    first = words.bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * PASSAGE_WORDS
    last = np.minimum(first + PASSAGE_WORDS, words.bounds[doc + 1])
    x = np.zeros((len(doc), WIDTH), np.float32)
    some = np.flatnonzero(last > first)
    if not len(some):
        return x, number
    first, last = first[some], last[some]
    n = (last - first).astype(np.float64)
    begin, end = words.starts[first], words.ends[last - 1]
    size = (end - begin).astype(np.float64)
    kind = _class_of()[words.data]
    for k in range(len(BYTE_CLASSES) + 1):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        x[some, k] = (total[end] - total[begin]) / size
    at = len(BYTE_CLASSES) + 1
    passage = np.repeat(np.arange(len(some)), last - first)
    h = words.hashes
    share = lambda flag: np.bincount(passage, flag, len(some)) / n
    before = np.r_[False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])]
    order = np.lexsort((h, passage))
    fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    initial, final = kind[words.starts], kind[words.ends - 1]
    long = (words.ends - words.starts).astype(np.float64)
    for k, value in enumerate([np.log1p(n), size / n / 10, np.bincount(passage[order], fresh, len(some)) / n, share(before), share(initial == 1), share(final == 8), share(final == 7), share(long > 14)]):
        x[some, at + k] = value
    cell = passage * HASHED + (mix(h) % np.uint64(HASHED)).astype(np.int64)
    x[some, at + 8 :] = np.sqrt(np.bincount(cell, minlength=len(some) * HASHED).reshape(-1, HASHED) / n[:, None])
    return x, number


def _of_batch(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, *passages(words_of(data, offsets, lo, hi, space_words()))


class GatedAttention:
    """Encoder, gated attention and scorer; bags are consecutive rows."""

    def __init__(self, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"w": draw(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        p, start = self.p, np.cumsum(number) - number
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = ((t * s) @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), number))
        alpha = e / np.repeat(np.add.reduceat(e, start), number)
        z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        odds = (z @ p["c"])[:, 0] + p["d"][0]
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "odds": odds, "score": 1 / (1 + np.exp(-odds))}

    def gradient(self, f: dict[str, np.ndarray], number: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; error: score less label, over the number of bags."""
        p, bag = self.p, np.repeat(np.arange(len(number)), number)
        dz = error[:, None] * p["c"].T
        from_bag = dz[bag]
        pull = (from_bag * f["h"]).sum(axis=1)
        de = f["alpha"] * (pull - np.add.reduceat(f["alpha"] * pull, np.cumsum(number) - number)[bag])
        dg = de[:, None] * p["a"].T
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["alpha"][:, None] * from_bag + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de[:, None], "c": f["z"].T @ error[:, None], "d": np.array([error.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                chosen = order[lo : lo + batch]
                number = np.array([len(bags[k]) for k in chosen])
                f = self.forward(np.concatenate([bags[k] for k in chosen]), number)
                g = self.gradient(f, number, ((f["score"] - labels[chosen]) / len(chosen)).astype(np.float32))
                step += 1
                for k, v in g.items():
                    v = v + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES) -> GatedAttention | None:
    """The model, from labelled documents that aren't held out; None without any."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    # At most max_documents ids: a proven bound for the broadcast.
    chosen = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, number in _of_batch(batch.column(2)):
                cut = np.cumsum(number)
                packed = [x[a:z].tobytes() for a, z in zip(cut - number, cut, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(number, pa.int64()), pa.array(packed, pa.large_binary()).cast(pa.binary())], ["doc_id", "label", "number", "packed"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    id_type = dict(rows.dtypes)["doc_id"]
    with Steps(docs.sparkSession) as steps:
        bags = rows.mapInArrow(run, f"doc_id {id_type}, label double, number long, packed binary")
        bags = steps.stored(bags.groupBy("doc_id").agg(F.min(F.struct("number", "packed", "label")).alias("bag")).select("doc_id", "bag.*"), "bags")
        # Whole documents, in the order of their ids' hashes, while their passages are within the bound.
        sizes = bags.select(F.xxhash64("doc_id").alias("h"), "doc_id", "number").collect()
        taken, total = [], 0
        for r in sorted(sizes):
            if total + r.number <= max_passages:
                taken.append(r.doc_id)
                total += r.number
        some = bags.filter(F.col("doc_id").isin(taken)) if len(taken) < len(sizes) else bags
        rows = sorted(some.collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    return GatedAttention(WIDTH).fit([np.frombuffer(r.packed, np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.label for r in rows], np.float32))


def score_documents(docs: DataFrame, model: GatedAttention | None, text_col: str = "text") -> DataFrame:
    """All columns of the documents and ``quality_score`` (one that is there is replaced)."""
    docs = docs.drop("quality_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    name = "quality_score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, x, number in _of_batch(batch.column(at)):
                scores.append(sent.value.forward(x, number)["score"] if sent.value else np.full(len(number), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores).astype(np.float64))], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with at least the threshold's score; their columns as they were."""
    scored = score_documents(docs, train(docs, labels))
    return scored.filter(F.col("quality_score") >= threshold).drop("quality_score")
