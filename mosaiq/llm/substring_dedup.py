"""Operator 7: removal of repeated passages with an FM-index per shard.

A passage is a window of ``window`` successive words. The smallest hash of the ``gram``-word runs inside a
window is its anchor; the windows of a document that share an anchor form a segment. Equal windows have equal
anchors, so only segments whose anchor occurs in two documents or more can hold a repeated window, and equal
windows always meet in the shard of their anchor. Each distinct segment goes there once, with the smallest
document that has it. A shard goes through its segments block by block, an anchor's in the order of their
documents: those of the smallest document are indexed, and those of the others are streamed through backward
search over the wavelet matrix. Where the matching statistic reaches the window's length, the window has its
smallest document; what isn't found is indexed in turn for the documents that follow. These intervals go back
to every document that has the segment.

An anchor with more than ``segments_of_anchor`` distinct segments (thousands of near copies) is dealt
further: its segments are cut into single windows, which are spread by the window's own hash.

Words are compared by 64-bit hashes, segments by pairs of them.

Defined results: a null text has no words; windows are judged on the input; rows with the same id are one
document in that neither repeats the other; a row with a null id is never a source and never loses words;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .frames import Steps, flagged, stored
from .words import Words, grams, inside_document, merged_by_document, run_hashes, slices, sliding_last_argmin, space_words, spread, text_buffers, words_of

#: Words of an index block, about; a block holds whole anchors.
BLOCK_WORDS = 1 << 18
SEGMENTS_OF_ANCHOR = 20_000


def segments(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, anchor, content hash) of the maximal runs of windows with one anchor."""
    runs = grams(words.hashes, gram)
    start = np.flatnonzero(inside_document(words.doc, window))
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = sliding_last_argmin(runs, window - gram + 1)[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (words.doc[start[1:]] != words.doc[start[:-1]])])
    count = np.diff(np.r_[new, len(start)])
    first = start[new]
    content = run_hashes(words.hashes, first, first + count + window - 1)
    return first, count, runs[at[new]].view(np.int64), content.view(np.int64)


def _words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, words_of(data, offsets, lo, hi, space_words())


def _row_keys(words: Words) -> np.ndarray:
    """A hash of each document's words, which tells apart rows with one id."""
    return run_hashes(words.hashes, words.bounds[:-1], words.bounds[1:]).view(np.int64)


def _occurrences(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, words in _words(batch.column(1)):
                first, count, anchor, content = segments(words, window, gram)
                doc = words.doc[first]
                columns = ids[lo:hi][doc], _row_keys(words)[doc], first - words.bounds[doc], count, anchor, content
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "row", "first", "windows", "anchor", "content"])

    return texts.mapInArrow(run, "doc_id long, row long, first long, windows long, anchor long, content long")


def _emitted(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of the wanted segments of documents: (doc_id, text, wanted contents, those to cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, words in _words(batch.column(1)):
                first, count, anchor, content = segments(words, window, gram)
                doc = words.doc[first]
                rows: list[list] = [[] for _ in range(6)]
                for d in range(hi - lo):
                    a, z = np.searchsorted(doc, [d, d + 1])
                    cut_up = batch.column(3)[lo + d].as_py()
                    here, place = np.unique(content[a:z], return_index=True)  # a passage repeated in a document goes once
                    for j in place[np.isin(here, batch.column(2)[lo + d].values.to_numpy())] + a:
                        pieces = [(anchor[j], 0, first[j], first[j] + count[j] + window - 1)]
                        if content[j] in cut_up:
                            starts = first[j] + np.arange(count[j])
                            keys = run_hashes(words.hashes, starts, starts + window).view(np.int64)
                            pieces = [(key, s - first[j], s, s + window) for key, s in zip(keys, starts, strict=True)]
                        for key, offset, begin, end in pieces:
                            for column, value in zip(rows, (key, anchor[j], content[j], ids[lo + d], offset, words.hashes[begin:end].tobytes()), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:5]), pa.array(rows[5], pa.binary())], ["key", "anchor", "content", "doc_id", "offset", "words"])

    return texts.mapInArrow(run, "key long, anchor long, content long, doc_id long, offset long, words binary")


class Passages:
    """Passages of one shard: runs of words with their keys and documents; ``known`` ones were judged before."""

    def __init__(self, words: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, known: np.ndarray):
        self.words, self.key, self.doc, self.known = words, key, doc, known
        self.end = np.cumsum(size)
        self.begin = self.end - size


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run begins: the first column changes, or the last one doesn't go up by one, or one between changes."""
    text, *between, offset = columns
    new = (np.diff(text) != 0) | (np.diff(offset) != 1)
    for c in between:
        new |= np.diff(c) != 0
    return np.flatnonzero(np.r_[True, new]) if len(text) else np.zeros(0, np.int64)


def smallest_documents(all_of: Passages, window: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """For runs of windows, (passage, from, to, smallest document with them), and the spans of words that were indexed.

    In rounds: the passages of a key's smallest documents are indexed (one in the first round, then two, four, ...)
    and all others are streamed against them. A window that is found has its smallest document, as its key's
    documents are taken in order; those that aren't found go on to the next round. So each content of a window is
    indexed once or few times, however many passages hold it.
    """
    found_text, found_at, found_least = [], [], []
    sources = []
    text, begin, end, most = np.arange(len(all_of.begin)), all_of.begin, all_of.end, 1

    def found(t: np.ndarray, at: np.ndarray, least: np.ndarray) -> None:
        new = ~all_of.known[t]
        for column, values in zip((found_text, found_at, found_least), (t, at - all_of.begin[t], least), strict=True):
            column.append(values[new])

    while len(text):
        order = np.lexsort((begin, text, all_of.doc[text], all_of.key[text]))
        text, begin, end = text[order], begin[order], end[order]
        key = all_of.key[text]
        new_key = np.r_[True, key[1:] != key[:-1]]
        nth = np.cumsum(np.r_[True, text[1:] != text[:-1]])
        into = (nth - nth[new_key][np.cumsum(new_key) - 1] < most) | all_of.known[text]
        t, a, z = text[into], begin[into], end[into]
        sources.append((t, a, z))
        size = z - a
        after = np.cumsum(size + 1) - 1
        alphabet, symbol = np.unique(all_of.words[spread(a, size)], return_inverse=True)
        joined = np.zeros(int(after[-1]) + 1, np.int64)
        joined[spread(after - size, size)] = symbol + 1
        index = FMIndex(joined, window)
        least = index.smallest(np.repeat(all_of.doc[t], size + 1))
        windows = size - window + 1
        found(np.repeat(t, windows), spread(a, windows), least[index.classes_at(spread(after - size, windows))])
        text, begin, end = text[~into], begin[~into], end[~into]
        most *= 2
        if not len(text):
            break
        size = end - begin
        streamed = all_of.words[spread(begin, size)]
        place = np.minimum(np.searchsorted(alphabet, streamed), len(alphabet) - 1)
        stop = np.cumsum(size)
        steps = index.matches(np.where(alphabet[place] == streamed, place + 1, 0), stop - size, stop)
        piece, at, match = (np.concatenate(c) for c in zip(*steps, strict=True))
        order = np.lexsort((at, piece))
        piece, at, match = piece[order], at[order] + begin[piece[order]], match[order]
        hit = match >= 0
        found(text[piece[hit]], at[hit], least[match[hit]])
        piece, at = piece[~hit], at[~hit]
        new = _runs(piece, at)
        text, begin, end = text[piece[new]], at[new], at[np.r_[new[1:], len(at)][: len(new)] - 1] + window
    text, at, least = (np.concatenate(c) for c in (found_text, found_at, found_least))
    order = np.lexsort((at, text))
    text, at, least = text[order], at[order], least[order]
    new = _runs(text, least, at)
    runs = text[new], at[new], at[np.r_[new[1:], len(at)][: len(new)] - 1] + 1, least[new]
    return runs, tuple(np.concatenate(c) for c in zip(*sources, strict=True))


def _searched(rows: DataFrame, window: int, block_words: int) -> DataFrame:
    """Blocks of a shard end anywhere: what was indexed of a key that goes on is known to the next block."""
    integers = ["key", "anchor", "content", "doc_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        none = np.zeros(0, np.int64)
        known = none.view(np.uint64), none, none, none  # words, sizes, keys, documents

        def finish() -> pa.RecordBatch:
            nonlocal known
            key, anchor, content, doc, offset, size, words = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            before = len(known[1])
            every = Passages(*(np.concatenate(c) for c in zip(known, (words, size, key, doc), strict=True)), np.arange(before + len(key)) < before)
            (text, start, stop, least), (source, a, z) = smallest_documents(every, window)
            on = every.key[source] == key[-1]
            source, a, z = source[on], a[on], z[on]
            known = every.words[spread(a, z - a)], z - a, every.key[source], every.doc[source]
            text = text - before
            columns = anchor[text], content[text], start + offset[text], stop + offset[text], least
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "start", "stop", "least"])

        words = 0
        for batch in batches:
            sent = batch.column("words").cast(pa.large_binary())
            offsets = np.frombuffer(sent.buffers()[1], np.int64)[sent.offset : sent.offset + len(sent) + 1]
            data = np.frombuffer(sent.buffers()[2], np.uint8)
            ends = (offsets[1:] - offsets[0]) // 8
            numbers = [batch.column(c).to_numpy() for c in integers]
            lo = 0
            while lo < batch.num_rows:
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + block_words - words, side="right")))
                size = np.diff(np.r_[base, ends[lo:hi]])
                part = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes(), np.uint64)
                held.append((*(c[lo:hi] for c in numbers), size, part))
                words += len(part)
                lo = hi
                if words >= block_words or lo < batch.num_rows:
                    yield finish()
                    words = 0
        if held:
            yield finish()

    dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(run, "anchor long, content long, start long, stop long, least long")


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, firsts, lasts of removed windows' runs) to the result rows."""
    id_type = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = batch.column(2), batch.column(3)
            for lo, hi, words in _words(batch.column(1)):
                begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for d in range(hi - lo):
                    if starts[lo + d].is_valid:
                        begin.append(starts[lo + d].values.to_numpy() + words.bounds[d])
                        end.append(stops[lo + d].values.to_numpy() + words.bounds[d] + window - 1)
                begin, end, doc = merged_by_document(words, np.concatenate(begin), np.concatenate(end))
                stays = np.ones(len(words.doc), bool)
                stays[spread(begin, end - begin)] = False
                at = np.flatnonzero(stays)
                size = words.ends[at] - words.starts[at] + 1
                out = np.append(words.data, np.uint8(0x20))[spread(words.starts[at], size)]
                stop = np.cumsum(size)
                out[stop - 1] = 0x20  # each word with a blank behind it
                cut = np.concatenate(([0], stop))[np.searchsorted(words.doc[at], np.arange(hi - lo + 1))]
                raw = out.tobytes()
                kept = [raw[a : max(a, z - 1)].decode() for a, z in zip(cut[:-1], cut[1:], strict=True)]
                first = words.bounds[doc]
                spans = pa.StructArray.from_arrays([pa.array(begin - first, pa.int32()), pa.array(end - first, pa.int32())], ["begin", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), spans)
                gone = np.bincount(doc, end - begin, hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array(gone), lists, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return texts.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, removed array<struct<begin:int,end:int>>, kept string")


def _gone(named: DataFrame, steps: Steps, window: int, gram: int, block_words: int, segments_of_anchor: int) -> DataFrame:
    """(doc_id, row, starts, stops): the runs of windows that go, of each text that has any."""
    seen = steps.stored(_occurrences(named, window, gram), "occurrences")
    # Written first, so that the join below has two plain shuffles and a hot anchor's rows can be split.
    shared = steps.stored(seen.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("anchor"), "anchors")
    every, seen = seen, steps.stored(seen.join(shared, "anchor"), "shared")
    steps.drop(every)
    distinct = seen.groupBy("anchor", "content").agg(F.min("doc_id").alias("doc_id"))
    crowd = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segments_of_anchor).select("anchor", F.lit(True).alias("cut_up"))
    wanted = distinct.join(crowd, "anchor", "left").groupBy("doc_id").agg(F.collect_set("content").alias("wanted"), F.collect_set(F.when(F.col("cut_up"), F.col("content"))).alias("cut_up"))
    wanted = steps.stored(wanted, "wanted")
    maybe = flagged(named, wanted, "doc_id").filter("__maybe").drop("__maybe")
    sent = _emitted(maybe.join(wanted, "doc_id").select("doc_id", "text", "wanted", "cut_up"), window, gram)
    found = steps.stored(_searched(sent, window, block_words), "found")
    hit = seen.join(found, ["anchor", "content"]).filter("least < doc_id")
    # What lies in a document: its own segments' intervals, as many as it has words at most.
    runs = hit.select("doc_id", "row", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))
    return stored(runs.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "gone")


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, segments_of_anchor: int = SEGMENTS_OF_ANCHOR) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, the ranges of words removed, and the kept words joined by a blank."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Steps(docs.sparkSession) as steps:
        gone = _gone(texts.filter("doc_id is not null"), steps, window, gram, block_words, segments_of_anchor)
    mine = flagged(texts, gone.select("doc_id"), "doc_id")
    several = gone.groupBy("doc_id").agg(F.collect_list(F.struct("row", "starts", "stops")).alias("rows"))
    lists = "cast(null as array<bigint>)"
    clean = mine.filter("not __maybe").select("doc_id", "text", F.expr(lists).alias("starts"), F.expr(lists).alias("stops"))
    keyed = _keyed(mine.filter("__maybe").select("doc_id", "text")).join(several, "doc_id", "left")
    own = F.expr("get(filter(rows, r -> r.row = row), 0)")
    rest = keyed.withColumn("mine", own).select("doc_id", "text", "mine.starts", "mine.stops")
    return _kept(clean.unionAll(rest), window)


def _keyed(texts: DataFrame) -> DataFrame:
    id_type = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _words(batch.column(1)):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(_row_keys(words))], ["doc_id", "text", "row"])

    return texts.mapInArrow(run, f"doc_id {id_type}, text string, row long")
