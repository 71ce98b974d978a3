"""Operator 11: toxicity, by a counterfactual-regularised classifier.

A logistic model over the words of a text and their prefixes (present or not, however long the text). For each
labelled text that names a group of people, counterfactual texts are made by swapping its identity terms for others
of the same kind, and the square of the change of the log-odds is penalised. Weight that a group's name earns only
because toxic texts mention that group costs as much as it brings, so neutral mentions aren't taken for toxic ones. An
L1 penalty leaves a short list of words; long clean texts don't add up to a toxic one.

The fit uses at most ``MAX_PER_CLASS`` labelled documents of each class (those with the smallest hash of their id), weighted
so that the classes keep their shares among all labelled rows. The counts that choose the ``FEATURES`` words and
prefixes are made by Spark over that sample; what the driver gets is at most 2 x MAX_PER_CLASS short lists of the chosen
features. Scoring reads every whole text. Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has no words and gets the score of the bias; without labelled rows every score is
0; documents with several labels are toxic if any says so; labelled rows that share an id count with the smallest
text; a null id is not held out and isn't learned from; an earlier ``toxicity_score`` column is replaced, other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import Steps
from .words import Words, alnum_words, lower_ascii, prefix_hashes, slices, text_buffers, words_of

MAX_PER_CLASS = 4000
FEATURES = 4096
#: A feature must be in so many documents of the sample.
LEAST_DOCUMENTS = 3
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weights of the counterfactual and of the L1 penalty.
PAIRING, SPARSITY = 2.0, 2e-5
THRESHOLD = 0.3
SCORE = "toxicity_score"

# Identity terms; those of a row may stand in for each other.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["gay", "lesbian", "bisexual", "transgender", "straight"],
    ["black", "white", "asian", "latino", "arab"],
    ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["deaf", "blind", "disabled", "autistic"],
    ["elderly", "young"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["frauen", "männer"],
    ["schwule", "lesben", "heterosexuelle"],
    ["schwarze", "weiße", "asiaten", "araber"],
    ["flüchtlinge", "einwanderer", "ausländer", "einheimische"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["femmes", "hommes"],
    ["noirs", "blancs", "asiatiques", "arabes"],
    ["réfugiés", "immigrés", "étrangers"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["mujeres", "hombres"],
    ["negros", "blancos", "asiáticos", "árabes"],
    ["refugiados", "inmigrantes", "extranjeros"],
]


class Swaps:
    """Counterfactual texts: each identity term gives way to the next, or the one after, of its row."""

    def __init__(self, terms: Sequence[Sequence[str]] = IDENTITY_TERMS):
        self.row_of: dict[str, tuple[Sequence[str], int]] = {}
        for row in terms:
            for k, term in enumerate(row):
                self.row_of.setdefault(term.lower(), (row, k))
        words = sorted(self.row_of, key=len, reverse=True)
        self.pattern = re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})\b", re.IGNORECASE) if words else None

    def of(self, text: str) -> list[str]:
        """Different texts than this one; none if it names no group."""
        if self.pattern is None or not self.pattern.search(text):
            return []
        out = []
        for step in (1, 2):

            def other(found: re.Match, step: int = step) -> str:
                row, k = self.row_of[found[0].lower()]
                return row[(k + step) % len(row)]

            swapped = self.pattern.sub(other, text)
            if swapped.lower() != text.lower() and swapped not in out:
                out.append(swapped)
        return out


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The index of each word among the slice's different words, and their features (0: none)."""
    keys, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    table = np.zeros((len(keys), 1 + len(PREFIXES)), np.uint64)
    table[:, 0] = keys
    starts, size = words.starts[first], words.ends[first] - words.starts[first]
    for k, n in enumerate(PREFIXES):
        longer = np.flatnonzero(size > n)
        table[longer, k + 1] = prefix_hashes(words.data, starts[longer], n)
    return which, table


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        yield lo, hi, words_of(data, offsets, lo, hi, alnum_words(), lower_ascii())


def _pairs(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (document, feature) pairs."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])][: len(doc)]
    return doc[fresh], feature[fresh]


@dataclass
class Lexicon:
    """Sorted feature hashes with their weights."""

    keys: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Different (document, place in the lexicon) pairs of a slice."""
        if not len(self.keys) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, table = word_features(words)
        at = np.minimum(np.searchsorted(self.keys, table), len(self.keys) - 1)
        hit = self.keys[at] == table
        known = np.flatnonzero(hit.any(axis=1))
        place = np.full(len(table), -1)
        place[known] = np.arange(len(known))
        word = np.flatnonzero(place[which] >= 0)
        mine = known[place[which[word]]]
        row, column = np.nonzero(hit[mine])
        return _pairs(words.doc[word[row]], at[mine[row], column])

    def scores(self, words: Words) -> np.ndarray:
        doc, at = self.found(words)
        odds = self.bias + np.bincount(doc, self.weights[at], len(words.counts))
        return 1 / (1 + np.exp(-odds))


def fit(lists: list[np.ndarray], labels: np.ndarray, share: np.ndarray, swapped: list[tuple[int, np.ndarray]], width: int, pairing: float = PAIRING, sparsity: float = SPARSITY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the least loss (proximal gradient steps with momentum).

    lists: features of each document; share: its weight, all of them adding up to 1; swapped: (document, features of a
    counterfactual). Loss: weighted log loss + pairing / 2 x weighted squares of the changes + sparsity x |weights|.
    """
    row, at = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    before, after = [np.setdiff1d(lists[k], x) for k, x in swapped], [np.setdiff1d(x, lists[k]) for k, x in swapped]
    change_row = np.repeat(np.arange(len(swapped)), [len(a) + len(b) for a, b in zip(before, after, strict=True)])
    change_at = np.concatenate([np.zeros(0, np.int64), *(x for pair in zip(before, after, strict=True) for x in pair)]).astype(np.int64)
    sign = np.concatenate([np.zeros(0), *(np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in zip(before, after, strict=True))])
    pair_share = np.array([share[k] for k, _ in swapped]) if swapped else np.zeros(0)

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        odds = b + np.bincount(row, w[at], len(lists))
        error = share * (1 / (1 + np.exp(-odds)) - labels)
        change = np.bincount(change_row, sign * w[change_at], len(swapped))
        value = float(share @ (np.logaddexp(0, odds) - labels * odds) + pairing / 2 * (pair_share @ change**2))
        slope = np.bincount(at, error[row], width) + np.bincount(change_at, pairing * (pair_share * change)[change_row] * sign, width)
        return value, slope, float(error.sum())

    positive = np.clip(share @ labels, 1e-3, 1 - 1e-3)
    w, b, reach = np.zeros(width), float(np.log(positive / (1 - positive))), 4.0
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(rounds):
        value, slope, slope_b = loss(ahead_w, ahead_b)
        while True:
            moved = ahead_w - reach * slope
            new_w = np.sign(moved) * np.maximum(np.abs(moved) - reach * sparsity, 0)
            new_b = ahead_b - reach * slope_b
            d, d_b = new_w - ahead_w, new_b - ahead_b
            if reach < 1e-6 or loss(new_w, new_b)[0] <= value + slope @ d + slope_b * d_b + (d @ d + d_b * d_b) / (2 * reach) + 1e-12:
                break
            reach /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w, ahead_b = new_w + (momentum - 1) / following * (new_w - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of each class a feature is; summed up in each task's slices first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, words in _slices(batch.column(2)):
                which, table = word_features(words)
                doc, feature = _pairs(np.repeat(words.doc, table.shape[1]), table[which].ravel())
                doc, feature = doc[feature != 0], feature[feature != 0]
                keys, at = np.unique(feature, return_inverse=True)
                toxic = np.bincount(at, label[lo:hi][doc], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(keys)) - toxic)], ["feature", "toxic", "clean"])

    parts = sample.select("doc_id", "label", "text").mapInArrow(run, "feature long, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lists(sample: DataFrame, lexicon: Lexicon, swaps: Swaps) -> DataFrame:
    """(row, label, swap, places): the lexicon's features of each document (swap 0) and of its counterfactuals."""
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def listed(texts: list[str]) -> Iterator[bytes]:
        for _, _, words in _slices(pa.array(texts, pa.large_string())):
            doc, at = sent.value.found(words)
            edges = np.searchsorted(doc, np.arange(len(words.counts) + 1))
            yield from (at[a:z].astype(np.int32).tobytes() for a, z in zip(edges, edges[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, labels, texts = (c.to_pylist() for c in batch.columns)
            for name, label, text in zip(names, labels, texts, strict=True):
                every = [text, *swaps.of(text)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(every), batch.schema.types[0]), pa.array([float(label)] * len(every)), pa.array(range(len(every)), pa.int32()), pa.array(list(listed(every)), pa.binary())], ["doc_id", "label", "swap", "places"])

    return sample.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {dict(sample.dtypes)['doc_id']}, label double, swap int, places binary")


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, pairing: float = PAIRING, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Lexicon | None:
    """The model, from labelled documents that aren't held out; None without any."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    with Steps(docs.sparkSession) as steps:
        usable = steps.stored(usable, "labelled")
        total = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
        if not total:
            return None
        # At most max_per_class ids of each label: a proven bound for the broadcast.
        halves = [usable.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in sorted(total)]
        chosen = halves[0] if len(halves) == 1 else halves[0].unionAll(halves[1])
        sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        sample = steps.stored(sample.select("doc_id", "label", "text"), "labelled-texts")
        taken = {y: min(n, max_per_class) for y, n in total.items()}
        ones, zeros = taken.get(1.0, 0), taken.get(0.0, 0)
        expected = F.expr(f"(toxic + clean) * {ones}D / {ones + zeros}")
        spread = F.pow(F.col("toxic") - expected, 2) / (expected * F.expr(f"{max(zeros, 1)}D / {ones + zeros}"))
        best = _counts(sample).filter(f"toxic + clean >= {LEAST_DOCUMENTS}").select("feature", spread.alias("spread")).orderBy(F.desc_nulls_last("spread"), "feature").limit(FEATURES)
        lexicon = Lexicon(np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64)))
        rows = sorted(_lists(sample, lexicon, Swaps(terms)).collect(), key=lambda r: (r.doc_id, r.swap))
    lists, y, swapped = [], [], []
    for r in rows:
        places = np.frombuffer(r.places, np.int32).astype(np.int64)
        if r.swap:
            swapped.append((len(lists) - 1, places))
        else:
            lists.append(places)
            y.append(r.label)
    label = np.array(y)
    share = np.array([total[k] / taken[k] for k in y])
    lexicon.weights, lexicon.bias = fit(lists, label, share / share.sum(), swapped, len(lexicon.keys), pairing)
    used = np.flatnonzero(lexicon.weights)
    return Lexicon(lexicon.keys[used], lexicon.weights[used], lexicon.bias)


def score_documents(docs: DataFrame, model: Lexicon | None, text_col: str = "text") -> DataFrame:
    """All columns of the documents and ``toxicity_score``."""
    docs = docs.drop(SCORE)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, words in _slices(batch.column(at)):
                scores.append(sent.value.scores(words) if sent.value else np.zeros(len(words.counts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, SCORE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))
