"""Operator 4: benchmark decontamination by winnowing.

Every run of ``k`` words is hashed and the smallest hash (the last of equal ones) of each ``n - k + 1``
successive runs is kept as a fingerprint, in documents and in benchmark items alike. Two texts that share
``n`` words then share the fingerprint of that window, so the join of the fingerprints misses no shared
window; each match is compared word by word and extended to both sides, up to ``n - k`` words, which
covers all windows that hold the fingerprint. Items shorter than ``n`` words are one window each and are
found by the hashes of all runs of their own length (winnowing with a window of one).

The benchmark's index is sent to all executors only while its texts have at most ``MAX_BLOCK_BYTES``; a
larger benchmark is dealt into blocks of that size by hash, the documents are matched against one block after
another (an index is freed before the next is sent), and the matches of a document are united afterwards.

Defined results: a null text or item has no words; an item without words occurs nowhere; an item without an id
hits words but can't be listed; a document row
gives one result row, also when it is repeated; other columns are ignored; without items nothing is hit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored
from .words import Words, alnum_words, grams, inside_document, lower_ascii, merged_by_document, slices, sliding_last_argmin, spread, text_buffers, words_of

#: Bytes of benchmark text whose index is broadcast at once (the index takes about four times as much).
MAX_BLOCK_BYTES = 16 << 20
#: Pairs of positions compared at once.
MAX_PAIRS = 1 << 20

RESULT = "n_words long, n_hit long, hits array<struct<begin:int,end:int>>, items array<string>"


def winnow(hashes: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions of the last smallest hash of each window that starts at a valid place."""
    chosen = np.zeros(len(hashes), bool)
    chosen[sliding_last_argmin(hashes, window)[valid]] = True
    return np.flatnonzero(chosen)


@dataclass
class Table:
    """Sorted hashes with the place of each in the items' words; ``size`` words are hashed."""

    size: int
    keys: np.ndarray
    places: np.ndarray
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def pairs(self, hashes: np.ndarray, positions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position, place) of equal hashes, in bounded pieces."""
        likely = self.bits[hashes >> np.uint64(44)]
        hashes, positions = hashes[likely], positions[likely]
        lo = np.searchsorted(self.keys, hashes, side="left")
        n = np.searchsorted(self.keys, hashes, side="right") - lo
        some = n > 0
        lo, n, positions = lo[some], n[some], positions[some]
        total, at = np.cumsum(n), 0
        while at < len(n):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + MAX_PAIRS, side="right")))
            yield np.repeat(positions[at:to], n[at:to]), self.places[spread(lo[at:to], n[at:to])]
            at = to


class Index:
    """Fingerprints of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int, k: int):
        self.n, self.k, self.ids = n, k, [i for i, _ in items]
        data, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        words = words_of(data, offsets, 0, len(items), alnum_words(), lower_ascii())
        self.words, self.item = words.hashes, words.doc
        runs = grams(self.words, k)
        places = winnow(runs, inside_document(self.item, n), n - k + 1)
        self.long = Table(k, runs[places], places) if len(places) else None
        self.short = []
        counts, starts = words.counts, words.bounds[:-1]
        for size in sorted({int(c) for c in counts if 0 < c < n}):
            places = starts[counts == size]
            self.short.append(Table(size, grams(self.words, size)[places], places))

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of words inside an occurrence of a window, with the item of each."""
        if self.long is not None:
            runs = grams(words.hashes, self.k)
            at = winnow(runs, inside_document(words.doc, self.n), self.n - self.k + 1)
            for p, q in self.long.pairs(runs[at], at):
                p, q = self._equal(words, p, q, self.k)
                before, after = self._more(words, p, q, -1), self._more(words, p + self.k - 1, q + self.k - 1, 1)
                full = before + after + self.k >= self.n
                yield (p - before)[full], (p + self.k + after)[full], self.item[q[full]]
        for table in self.short:
            inside = np.flatnonzero(inside_document(words.doc, table.size))
            for p, q in table.pairs(grams(words.hashes, table.size)[inside], inside):
                p, q = self._equal(words, p, q, table.size)
                yield p, p + table.size, self.item[q]

    def _equal(self, words: Words, p: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        same = np.ones(len(p), bool)
        for j in range(size):
            same &= words.hashes[p + j] == self.words[q + j]
        return p[same], q[same]

    def _more(self, words: Words, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
        """How many further words are equal, up to n - k."""
        going, count = np.ones(len(p), bool), np.zeros(len(p), np.int64)
        for j in range(1, self.n - self.k + 1):
            a, b = p + j * step, q + j * step
            going &= (a >= 0) & (a < len(words.doc)) & (b >= 0) & (b < len(self.item))
            a, b = np.where(going, a, 0), np.where(going, b, 0)
            going &= (words.doc[a] == words.doc[p]) & (self.item[b] == self.item[q]) & (words.hashes[a] == self.words[b])
            count += going
        return count


def _match(batch: pa.RecordBatch, index: Index, id_col: str) -> Iterator[pa.RecordBatch]:
    data, offsets = text_buffers(batch.column(1))
    is_word, table = alnum_words(), lower_ascii()
    names = np.array(index.ids, dtype=object)
    for lo, hi in slices(offsets):
        words = words_of(data, offsets, lo, hi, is_word, table)
        found = list(index.hits(words)) if len(words.doc) else []
        begin, end, item = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3))
        pairs = np.unique(np.stack([words.doc[begin], item]), axis=1) if len(begin) else np.zeros((2, 0), np.int64)
        begin, end, doc = merged_by_document(words, begin, end)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        first = words.bounds[doc]
        named = [[] for _ in range(hi - lo)]
        for d, i in pairs.T:
            named[d].append(names[i])
        hits = pa.StructArray.from_arrays([pa.array(begin - first, pa.int32()), pa.array(end - first, pa.int32())], ["begin", "end"])
        yield pa.RecordBatch.from_arrays(
            [
                *(c.slice(lo, hi - lo) for c in [batch.column(0), *batch.columns[2:]]),
                pa.array(words.counts, pa.int64()),
                pa.array(np.bincount(doc, end - begin, hi - lo).astype(np.int64), pa.int64()),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), hits),
                pa.array([sorted({i for i in x if i is not None}) for x in named], pa.list_(pa.string())),
            ],
            [id_col, *batch.schema.names[2:], "n_words", "n_hit", "hits", "items"],
        )


def _sent(docs: DataFrame, items: DataFrame, n: int, k: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], n, k))


def _pass(docs: DataFrame, sent: Broadcast, extra: str = "") -> DataFrame:
    id_col, id_type = docs.dtypes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _match(batch, sent.value, id_col)

    return docs.mapInArrow(run, f"`{id_col}` {id_type}, {extra}{RESULT}")


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, max_block_bytes: int) -> list[DataFrame]:
    """The items, dealt into blocks by hash so that each has about ``max_block_bytes`` of text at most."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [items.filter(part == b) for b in range(blocks)] if blocks > 1 else [items]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES
) -> DataFrame:
    """Per document row: its words, those hit, the ranges of words hit, and the items that occur (sorted)."""
    texts = docs.select(id_col, text_col)
    blocks = _blocks(benchmark, item_id, item_text, max_block_bytes)
    if len(blocks) == 1:
        return _pass(texts, _sent(docs, blocks[0], n, k))
    # One block after another: only one index is held at a time, and only rows with hits are kept.
    key = F.struct(F.xxhash64(text_col), F.sha2(F.col(text_col), 256)).cast("string")
    texts = texts.withColumn("key_of_text", F.coalesce(key, F.lit("")))
    parts = []
    for items in blocks:
        sent = _sent(docs, items, n, k)
        parts.append(stored(_pass(texts, sent, "key_of_text string, ").filter("n_hit > 0").select(F.col(id_col).alias("id"), "key_of_text", "hits", "items").distinct(), "hits"))
        sent.destroy()
    found = functools.reduce(DataFrame.unionAll, parts)
    found = found.groupBy("id", "key_of_text").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("all_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = F.expr(
        """aggregate(all_hits, cast(array() as array<struct<begin:int,end:int>>), (s, h) ->
        if(size(s) > 0 and h.begin <= element_at(s, -1).end,
           concat(slice(s, 1, size(s) - 1), array(named_struct('begin', element_at(s, -1).begin, 'end', greatest(element_at(s, -1).end, h.end)))),
           concat(s, array(h))))"""
    )
    found = found.select(F.col("id").alias("found_id"), F.col("key_of_text").alias("found_key"), united.alias("found_hits"), F.col("items").alias("found_items"))
    # Each row's own number of words: a pass without items.
    rows = _pass(texts, _sent(docs, blocks[0].limit(0), n, k), "key_of_text string, ")
    rows = rows.join(found, F.col(id_col).eqNullSafe(F.col("found_id")) & (F.col("key_of_text") == F.col("found_key")), "left")
    rows = rows.withColumn("hits", F.coalesce("found_hits", "hits")).withColumn("items", F.coalesce("found_items", "items"))
    return rows.withColumn("n_hit", F.expr("aggregate(hits, 0L, (s, h) -> s + h.end - h.begin)")).select(id_col, "n_words", "n_hit", "hits", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Rows whose text has no benchmark window; all columns stay. A row is judged by its own text, whatever its id."""
    at, schema = docs.columns.index("text"), docs.schema
    blocks = _blocks(benchmark, "item_id", "text", max_block_bytes)
    for number, items in enumerate(blocks):
        sent = _sent(docs, items, n, k)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for lo, hi in slices(offsets):
                    words = words_of(data, offsets, lo, hi, alnum_words(), lower_ascii())
                    for begin, _, _ in sent.value.hits(words) if len(words.doc) else ():
                        clean[lo + words.doc[begin]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
        if number + 1 < len(blocks):
            docs = stored(docs, "clean")
            sent.destroy()
    return docs
