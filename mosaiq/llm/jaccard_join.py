"""Operator 9: exact similarity join of word-shingle sets by PartEnum signatures.

Sets fall into bands of sizes. Within a band, a Jaccard similarity of ``percent`` bounds the number of
differing shingles by k; the domain of shingles is dealt into ``k // 2 + 1`` parts of three cells each, and
for each part the three choices of two cells are signed. Of two sets that differ in at most k shingles, some
part holds at most one difference, so one choice of two cells is equal in both: every link shares a
signature. Two cells without shingles would be equal in unrelated sets; then the part's third cell is signed, as it is
and without each of its shingles. A set also signs in the further bands where a linked set could be.

Documents with equal sets are one node. Pairs that share a signature are verified exactly, by the intersections of
their whole sets. Before that, their bitmaps are compared, in which each shingle of a set flips a bit: the bits in which two
bitmaps differ are at most as many as the shingles in which the sets differ, so no link is lost. First each node is
compared with the first of its signature and the links found are united; then the nodes of a signature that lie in
different components are joined under that bound, so that neither a large group of copies nor a frequent signature is
gathered anywhere, and nothing goes through the driver.

Defined results: a null or blank text has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows with the same id are one document of the graph; a null id links nothing
and its component is that of its equal set, if any; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import Steps, flagged, stored
from .graph import components
from .words import SEQ_B, Words, grams, inside_document, lower_ascii, mix, slices, space_words, spread, text_buffers, words_of

#: Sizes of a band grow by this ratio at most.
BAND_RATIO = 1.5
CELLS, CHOICES = 3, ((0, 1), (0, 2), (1, 2))
#: A signature's last bits are its band's number; the 64th band begins at 10^11 shingles, more than a string can hold.
BAND_BITS = 6
#: A bitmap has twice as many bits as a set of its band at most has shingles, and no more than this.
MOST_BITS = 1 << 16

_SALTS = mix(np.arange(1, 9, dtype=np.uint64) * SEQ_B)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the documents in one array sorted by document and value, and each document's start."""
    runs, docs = [], []
    whole = np.flatnonzero(inside_document(words.doc, size))
    runs.append(grams(words.hashes, size)[whole])
    docs.append(words.doc[whole])
    for fewer in range(1, size):
        some = np.flatnonzero(words.counts == fewer)
        if len(some):
            runs.append(grams(words.hashes, fewer)[words.bounds[some]] ^ np.uint64(fewer))
            docs.append(some)
    run, doc = np.concatenate(runs), np.concatenate(docs)
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    if len(run):
        fresh = np.r_[True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])]
        run, doc = run[fresh], doc[fresh]
    return run, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def bands(most: int) -> np.ndarray:
    """First sizes of the bands up to one that holds ``most``."""
    first = [1]
    while first[-1] <= most:
        first.append(int(first[-1] * BAND_RATIO) + 1)
    first.append(int(first[-1] * BAND_RATIO) + 1)
    return np.array(first, np.int64)


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return total[cut[1:]] - total[cut[:-1]]


def _bands_of(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of bands, and the bands of each set and of the largest set that could be linked with it."""
    first = bands(int(size.max() * 100 // percent) if len(size) else 1)
    return first, np.searchsorted(first, size, side="right") - 1, np.searchsorted(first, size * 100 // percent, side="right") - 1


def signatures(run: np.ndarray, cut: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of the sets run[cut[d]:cut[d + 1]], and the set of each."""
    size = np.diff(cut)
    first, own, partner = _bands_of(size, percent)
    out, owner = [], []
    for step in range(int((partner - own).max(initial=0)) + 1):
        band = own + step
        last = first[np.minimum(band + 1, len(first) - 1)] - 1
        k = 2 * last * (100 - percent) // (100 + percent)
        some = np.flatnonzero((size > 0) & (partner >= band) & (k > 0))
        if not len(some):
            continue
        parts = k[some] // 2 + 1
        base = np.cumsum(parts) - parts
        at = spread(cut[some], size[some])
        value = mix(run[at] ^ _SALTS[0])
        part = (value >> np.uint64(8)) % np.repeat(parts, size[some]).astype(np.uint64)
        cell = (value >> np.uint64(1)) % np.uint64(CELLS)
        place = (np.repeat(base, size[some]) + part.astype(np.int64)) * CELLS + cell.astype(np.int64)
        cells = np.zeros(int(parts.sum()) * CELLS, np.uint64)
        each = mix(run[at] ^ _SALTS[1])
        np.add.at(cells, place, each)
        cells = cells.reshape(-1, CELLS)
        full = np.bincount(place, minlength=cells.size).reshape(-1, CELLS) > 0
        who = np.repeat(some, parts)
        number = (np.arange(len(who)) - np.repeat(base, parts)).astype(np.uint64)
        low = np.uint64((1 << BAND_BITS) - 1)
        numbered = lambda signed, sets, band=band, low=low: signed & ~low | band[sets].astype(np.uint64) & low
        head = mix(number * _SALTS[2] + band[who].astype(np.uint64)) * _SALTS[6]
        for c, (a, b) in enumerate(CHOICES):
            chosen = full[:, a] | full[:, b]
            signed = mix(mix(cells[:, a] ^ _SALTS[3 + a]) + mix(cells[:, b] ^ _SALTS[3 + b]) + head + np.uint64(c))
            out.append(numbered(signed[chosen], who[chosen]))
            owner.append(who[chosen])
            # Two cells without shingles say nothing. Then the third differs by one shingle at most: it is signed as it
            # is, and without each of its shingles.
            third, mark = 3 - a - b, np.uint64(CELLS + c)
            bare = np.flatnonzero(~chosen)
            out.append(numbered(mix(cells[bare, third] + head[bare] + mark), who[bare]))
            owner.append(who[bare])
            its = np.flatnonzero((place % CELLS == third) & ~chosen[place // CELLS])
            row = place[its] // CELLS
            out.append(numbered(mix(cells[row, third] - each[its] + head[row] + mark), who[row]))
            owner.append(who[row])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def _sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, *shingle_sets(words_of(data, offsets, lo, hi, space_words(), lower_ascii()), shingle)


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, content, n_shingles, set_a, set_b) of rows (doc_id, content, text): the size and the name of each set."""
    id_col, id_type = docs.dtypes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, cut in _sets_of(batch.column(2), shingle):
                names = (pa.array(_sums(mix(values ^ s), cut).view(np.int64)) for s in (_SALTS[6], _SALTS[7]))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(np.diff(cut), pa.int64()), *names], ["doc_id", "content", "n_shingles", "set_a", "set_b"])

    return docs.mapInArrow(run, f"doc_id {id_type}, content long, n_shingles long, set_a long, set_b long")


def _signed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, signature) of rows (doc_id, text) with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, values, cut in _sets_of(batch.column(1), shingle):
                signed, owner = signatures(values, cut, percent)
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][owner[order]]), pa.array(signed[order].view(np.int64))], ["node", "signature"])

    return docs.mapInArrow(run, "node long, signature long")


def bitmap(values: np.ndarray, last: int) -> np.ndarray:
    """The bits of a set in a band whose largest sets have ``last`` shingles, as 64-bit words."""
    bits = 64
    while bits < MOST_BITS and bits < 2 * last:
        bits *= 2
    flips = np.bincount((mix(values ^ _SALTS[7]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _bitmaps(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, band, n, bits) of rows (doc_id, text): a row for each band in which a set signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, values, cut in _sets_of(batch.column(1), shingle):
                size = np.diff(cut)
                first, own, partner = _bands_of(size, percent)
                rows = [(ids[lo + j], b, size[j], bitmap(values[cut[j] : cut[j + 1]], int(first[b + 1]) - 1)) for j in range(hi - lo) if size[j] for b in range(own[j], partner[j] + 1)]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(list(columns[3]), pa.list_(pa.int64()))], ["node", "band", "n", "bits"])

    return texts.mapInArrow(run, "node long, band long, n long, bits array<long>")


def _near(a: str, b: str, percent: int) -> str:
    """False only for sets that can't be linked: sizes too far apart, or bitmaps that differ in too many bits."""
    differ = f"aggregate(zip_with({a}.bits, {b}.bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    # Sets of s shared and d other shingles: 100 s >= percent (s + d), where 2 s + d is the sum of their sizes.
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * {differ} <= {100 - percent} * ({a}.n + {b}.n)"


def _verified(pairs: DataFrame, texts: DataFrame, steps: Steps, shingle: int, percent: int) -> DataFrame:
    """The linked ones of pairs (u, v), by their whole sets; texts: (doc_id, text)."""
    pairs = steps.stored(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select("v")).distinct()
    near = flagged(texts, ids, "doc_id").filter("__maybe").drop("__maybe")
    both = pairs.join(near.select(F.col("doc_id").alias("u"), F.col("text").alias("mine")), "u").join(near.select(F.col("doc_id").alias("v"), F.col("text").alias("theirs")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                mine, theirs = ([values[a:z] for _, _, values, cut in _sets_of(part.column(c), shingle) for a, z in zip(cut[:-1], cut[1:], strict=True)] for c in (2, 3))
                shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(mine, theirs, strict=True)])
                total = np.array([len(x) + len(y) for x, y in zip(mine, theirs, strict=True)])
                yield part.select(["u", "v"]).filter(pa.array((shared > 0) & (100 * shared >= percent * (total - shared))))

    return steps.stored(both.select("u", "v", "mine", "theirs").mapInArrow(run, "u long, v long"), "links")


def _links(texts: DataFrame, steps: Steps, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) that join all linked texts of rows (doc_id, text)."""
    rows = _signed(texts, shingle, percent)
    # Signatures of one node are done; neighbours are seen while rows stream by in order.
    several = F.expr("lead(node) over (partition by signature order by node) != node or lag(node) over (partition by signature order by node) != node")
    lists = steps.stored(rows.withColumn("several", several).filter("several").select("signature", "node"), "lists")
    bits = steps.stored(_bitmaps(flagged(texts, lists.select(F.col("node").alias("doc_id")).distinct(), "doc_id").filter("__maybe").drop("__maybe"), shingle, percent), "bits")
    lists = lists.withColumn("band", F.col("signature").bitwiseAND(F.lit((1 << BAND_BITS) - 1)))
    # A running first value: nothing is held for a signature.
    first = F.expr("first_value(node) over (partition by signature order by node rows between unbounded preceding and current row)")
    starred = lists.withColumn("first", first).filter("node > first").select(F.col("node").alias("u"), F.col("first").alias("v"), "band").distinct()
    side = lambda name: bits.select(F.col("node").alias(name), "band", F.struct("n", "bits").alias(f"{name}_set"))
    starred = starred.join(side("u"), ["u", "band"]).join(side("v"), ["v", "band"]).filter(_near("u_set", "v_set", percent))
    found = _verified(starred.select("u", "v"), texts, steps, shingle, percent)
    roots = components(found, steps)
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The exact rest: pairs of a signature in different components.
    mixed = placed.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("signature")
    rest = placed.join(mixed, "signature", "left_semi").join(bits, ["node", "band"])
    rest = steps.stored(rest, "rest")
    pairs = rest.alias("a").join(rest.alias("b"), F.expr(f"a.signature = b.signature and a.node < b.node and a.root != b.root and {_near('a', 'b', percent)}"))
    more = _verified(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), texts, steps, shingle, percent)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more)


def _placed(texts: DataFrame, steps: Steps, shingle: int, percent: int) -> DataFrame:
    """(doc_id, content, n_shingles, component_id) of rows (doc_id, content, text)."""
    keys = steps.stored(_keys(texts, shingle), "keys")
    node = keys.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    node = steps.stored(node, "nodes")
    # Of equal sets only one signs.
    copies = steps.stored(keys.filter("doc_id is not null and n_shingles > 0").select("doc_id").distinct().join(node.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"), "copies")
    mine = flagged(texts.filter("doc_id is not null").select("doc_id", "text"), copies, "doc_id")
    own = mine.filter("not __maybe").unionAll(mine.filter("__maybe").join(copies, "doc_id", "left_anti").select(*mine.columns)).drop("__maybe")
    links = _links(own, steps, shingle, percent)
    placed = keys.join(node.select("set_a", "set_b", "node"), ["set_a", "set_b"], "left")
    # A document id that stands for several sets joins them, as rows with one id are one document.
    several = keys.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("set_a").alias("a"), F.max("set_a").alias("z")).filter("a < z").select("doc_id")
    same = placed.filter("node != doc_id").join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = components(links.unionAll(same), steps)
    placed = placed.join(roots, "node", "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node"))
    return stored(placed.select("doc_id", "content", "n_shingles", F.coalesce(alone, "doc_id").alias("component_id")), "placed")


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    with Steps(docs.sparkSession) as steps:
        placed = _placed(texts, steps, shingle, percent)
    return placed.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Documents that are the smallest of their component; all columns stay.

    Documents without words are linked with nothing, and rows without an id can't be named: all of them stay. Of rows
    that share an id the one with the smallest text stays (then by the other columns, as JSON); null texts come first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    with Steps(docs.sparkSession) as steps:
        placed = _placed(texts, steps, shingle, percent)
    gone = placed.filter("doc_id != component_id").select("doc_id").distinct()
    repeated = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    # Few ids are either, so that most texts aren't shuffled.
    mine = flagged(docs, gone.unionAll(repeated), "doc_id")
    open_rows = mine.filter("__maybe").drop("__maybe").join(gone, "doc_id", "left_anti")
    order = [F.col("text"), F.to_json(F.struct(*(c for c in docs.columns if c != "text")))]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    one = open_rows.withColumn("__row", first).filter("__row = 1").select(*docs.columns)
    return mine.filter("not __maybe").select(*docs.columns).unionAll(one)
