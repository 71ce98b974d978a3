"""Vectorised word handling for Arrow text batches.

Words are found and hashed over the raw UTF-8 bytes of many documents at once, so no Python
object is made for a word. All word classes used here are closed under UTF-8: a byte of 0x80 or
more always belongs to a word, so working on bytes and on code points gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; documents are never cut, a longer one forms a slice of its own.
SLICE_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: Runs of words are polynomials modulo this prime; modulo a power of two, some texts would meet by construction.
_PRIME = (1 << 61) - 1
_BASE = 0x1851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, _PRIME)
SEQ_A = np.uint64(0xD6E8FEB86659FD93)
SEQ_B = np.uint64(0xA0761D6478BD642F)


def space_words() -> np.ndarray:
    """Byte class of ``[^\\x20\\x09-\\x0D]+``."""
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    return is_word


def alnum_words() -> np.ndarray:
    """Byte class of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (texts already in lower case)."""
    is_word = np.ones(256, bool)
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        is_word[lo : hi + 1] = False
    return is_word


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime 2^61 - 1, by halves of 31 and 30 bits."""
    low, half, prime = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(_PRIME)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1  # below 2^62
    # 2^62 is 2 and 2^61 is 1 modulo the prime.
    out = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0
    out = (out & prime) + (out >> np.uint64(61))
    return np.where(out >= prime, out - prime, out)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = _times(out[:more], np.full(more, pow(base, done, _PRIME), np.uint64))
        done += more
    return out


_POW: dict[int, np.ndarray] = {}


def _cached_powers(n: int, base: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n + 1:
        have = _powers(max(n, SLICE_BYTES // 2), base)
        if n <= 4 * SLICE_BYTES:
            _POW[base] = have
    return have


def _running_sums(values: np.ndarray) -> np.ndarray:
    """Sums modulo the prime of the values before each place; values below the prime."""
    prime, half = np.uint64(_PRIME), np.uint64(31)
    low, high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values & np.uint64((1 << 31) - 1), out=low[1:])
    np.cumsum(values >> half, out=high[1:])
    high %= prime
    return (_times(high, np.full(len(high), 1 << 31, np.uint64)) + low % prime) % prime


#: Values of the bytes of words' first places; later places are made when needed.
_NEAR = 32


def _valued(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random-looking value for each byte at its place in a word."""
    return mix((place.astype(np.uint64) << np.uint64(8) | byte) * _MUL + SEQ_A)


_VALUES = _valued(np.tile(np.arange(256, dtype=np.uint64), _NEAR), np.repeat(np.arange(_NEAR), 256))


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each word's bytes at their places, with the length mixed in."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    byte = text[spread(starts, size)].astype(np.int64)
    first = np.cumsum(size) - size
    place = np.arange(len(byte)) - np.repeat(first, size)
    value = _VALUES[np.minimum(place, _NEAR - 1) << 8 | byte]
    far = np.flatnonzero(place >= _NEAR)
    value[far] = _valued(byte[far].astype(np.uint64), place[far])
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _MUL)


def prefix_hashes(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of words that are longer; no word has the hash of its own prefix."""
    return mix(_word_hashes(text, starts, starts + size) + SEQ_B)


@dataclass
class Words:
    """Words of a slice of documents: byte ranges in ``data``, document of each, 64-bit hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # word index at which each document starts, plus the total

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, is_word: np.ndarray, table: np.ndarray | None = None) -> Words:
    """Words of documents lo..hi. ``table`` maps bytes first (lower case)."""
    base = int(offsets[lo])
    text = data[base : int(offsets[hi])]
    if table is not None:
        text = table[text]
    cut = offsets[lo : hi + 1] - base
    n = len(text)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[text]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    # A document's end also ends a word, even if the next document starts with one.
    inner = cut[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= inside[inner + 1]
    last[inner] |= inside[inner]
    starts, ends = np.flatnonzero(first[:n]), np.flatnonzero(last[: n + 1])
    bounds = np.searchsorted(starts, cut, side="left")
    doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
    hashes = _word_hashes(text, starts, ends)
    return Words(text, starts, ends, doc, hashes, bounds)


def grams(hashes: np.ndarray, k: int, multiplier: np.uint64 = SEQ_A) -> np.ndarray:
    """Order-dependent hashes of all runs of k words (also over documents' ends; mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= multiplier
        out += hashes[j : j + n]
    return mix(out)


def inside_document(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of k words from each word on stays in its document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges [starts, starts + lengths)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted disjoint ranges."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > reach[:-1]]
    return begin[new], np.r_[reach[:-1][new[1:]], reach[-1]]


def merged_by_document(words: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges of words, each inside one document: begins, ends, documents."""
    doc = words.doc[begin] if len(begin) else begin
    begin, end = merged(begin + doc, end + doc)  # a gap between documents
    doc = np.searchsorted(words.bounds[:-1] + np.arange(len(words.bounds) - 1), begin, side="right") - 1
    return begin - doc, end - doc, doc


def sliding_last_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """For each full window, the place of its last smallest value; by doubling the width."""
    m = len(values) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at, width = values, np.arange(len(values)), 1
    while width < window:
        step = min(width, window - width)
        n = len(best) - step
        right = best[step:] <= best[:n]
        best, at = np.where(right, best[step:], best[:n]), np.where(right, at[step:], at[:n])
        width += step
    return at


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [begin, end), of any lengths."""
    n = len(hashes)
    pw, inv = _cached_powers(n, _BASE), _cached_powers(n, _BASE_INV)
    prime = np.uint64(_PRIME)
    sums = _running_sums(_times(mix(hashes ^ SEQ_B) >> np.uint64(3), pw[:n]))
    return mix(_times((sums[end] + prime - sums[begin]) % prime, inv[begin]) + (end - begin).astype(np.uint64) * _MUL)
