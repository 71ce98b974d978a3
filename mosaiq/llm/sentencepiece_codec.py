"""Operator 1: offset-preserving SentencePiece encoding and decoding.

The normaliser walks the model's compiled character map (a double-array trie) by longest prefix and
keeps, for every normalised byte, the source byte it came from; each piece is then projected to the
byte span of the original text that it covers.

Where the model's map is the identity, extra blanks are kept and no piece has a blank after another
character (checked on the model when it is loaded), a merge can't cross from a word to the blank that
follows it. A text without that blank sign is then the exact concatenation of units "blanks + word", so a unit is
normalised and segmented once and remembered with its alignment; memory is bounded by ``MEMO_UNITS`` and a text of any
length is never held as a lattice. Any other model goes through the general path, a whole text at a time.

Defined results: a null text is an empty one; an empty text has only the begin and end ids; repeated rows
give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import free_memory
from .words import spread

BLANK = "▁"
#: Remembered units; all are forgotten when there are more.
MEMO_UNITS = 250_000

SCHEMA = "ids binary, begins binary, ends binary, decoded string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharsMap:
    """A compiled character map: longest-prefix search in a double array, then a replacement text."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4)
            self.texts = blob[4 + size :]

    @property
    def identity(self) -> bool:
        return not len(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that data[at:] starts with: its length and its replacement."""
        if self.identity:
            return None
        units, found = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[n]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = n + 1 - at, int(units[node]) & 0x7FFFFFFF
        if found is None:
            return None
        size, start = found
        return size, self.texts[start : self.texts.index(b"\0", start)]


@dataclass
class Model:
    pieces: list[str]
    types: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    charsmap: CharsMap
    dummy_prefix: bool
    trim_blanks: bool
    escape_blanks: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, types, spec = [], [], {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                types.append(piece.get(3, 1))
            elif field == 3:
                spec = dict(_fields(value))
        return cls(pieces, types, CharsMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    @property
    def splits_at_words(self) -> bool:
        if not (self.charsmap.identity and self.dummy_prefix and self.escape_blanks and not self.trim_blanks):
            return False
        return all(BLANK not in p.lstrip(BLANK) and " " not in p for p in self.pieces) and 4 not in self.types

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, the source byte it came from."""
        source = text.encode()
        blank = BLANK.encode() if self.escape_blanks else b" "
        out, origin, at = bytearray(), [], 0
        after_blank = self.trim_blanks  # blanks at the start go
        pending: list[tuple[bytes, int]] = []
        started = False
        while at < len(source):
            hit = self.charsmap.longest(source, at)
            if hit is None:
                lead = source[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, source[at : at + size]
            size, new = hit
            copied = new == source[at : at + size]
            for k in range(len(new)):
                byte = new[k : k + 1]
                if byte == b" ":
                    if not (self.trim_blanks and after_blank):
                        pending.append((blank, at))
                    after_blank = True
                else:
                    if not started and self.dummy_prefix:
                        out += blank
                        origin += [0] * len(blank)
                    started = True
                    for text_, where in pending:
                        out += text_
                        origin += [where] * len(text_)
                    pending = []
                    out += byte
                    origin.append(at + k if copied else at)
                    after_blank = False
            at += size
        if not self.trim_blanks and pending:
            if not started and self.dummy_prefix:
                out += blank
                origin += [0] * len(blank)
            for text_, where in pending:
                out += text_
                origin += [where] * len(text_)
            return bytes(out), np.array([*origin, len(source)], np.int64)
        end = pending[0][1] if pending else len(source)
        return bytes(out), np.array([*origin, end], np.int64)


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _units(text: str) -> list[str]:
    """Words, each without the blank in front of it; further blanks stay at a word's start."""
    units = text.split(" ")
    if "" not in units:
        return units
    joined, held = [], 0
    for unit in units:
        if unit:
            joined.append(" " * held + unit)
            held = 0
        else:
            held += 1
    if held:
        joined.append(" " * (held - 1))
    return joined


#: The dummy prefix comes from the unit's own blank, each byte behind it from itself.
_RAMP = np.concatenate((np.zeros(3, np.int64), np.arange(1, 4098)))


class Grown:
    """Columns of 64-bit integers that grow by doubling."""

    def __init__(self, columns: int):
        self.size, self.data = 0, np.zeros((columns, 1024), np.int64)

    def extend(self, columns: list) -> None:
        n = self.size + len(columns[0])
        if n > self.data.shape[1]:
            grown = np.zeros((len(self.data), 2 * n), np.int64)
            grown[:, : self.size] = self.data[:, : self.size]
            self.data = grown
        for row, new in zip(self.data, columns, strict=True):
            row[self.size : n] = new
        self.size = n

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.data[:, at]


class Codec:
    """Encodes and decodes with one model; one per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            blob = file.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.model = Model.parse(blob)
        self.sizes = np.array([1 if t == 6 else len(p.encode()) for p, t in zip(self.model.pieces, self.model.types, strict=True)], np.int64)
        self.bos, self.eos = self.processor.bos_id(), self.processor.eos_id()
        self.by_words = self.model.splits_at_words
        self.unknown = self.processor.unk_id()
        self.blank = self.model.pieces.index(BLANK) if BLANK in self.model.pieces else -1
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.units = Grown(3)  # first place, number of ids, source bytes
        self.flat = Grown(3)  # id, begin, end

    def _learn(self, units: list[str]) -> None:
        """Normalise and segment new units. A unit's own blank stands where the dummy prefix is put."""
        some = [u for u in units if u]
        ids = self.processor.encode(some, num_threads=1) if some else []
        sizes: list = [None] * len(some)
        for k, found in enumerate(ids):
            if self.unknown in found:  # an unknown piece is as long as its text
                proto = self.processor.encode(some[k], return_type="proto")
                ids[k], sizes[k] = self._pieces(proto)
        # The prefix comes from the blank before the unit, all else lies one byte further on.
        origins = [self._origins(u) for u in some]
        if len(some) < len(units):  # a single blank at the end of a text
            some, ids, sizes, origins = [*some, ""], [*ids, [self.blank]], [*sizes, None], [*origins, np.array([0, 0, 0, 1])]
        self._add(some, ids, sizes, origins)

    def _origins(self, unit: str) -> np.ndarray:
        """Places in the unit, its own blank included, of the normalised bytes and of the end.

        Units are only used with a map without keys: its longest-prefix search finds nothing at any place, so without
        blanks inside each byte comes from itself. Others are aligned byte by byte.
        """
        size = len(unit) if unit.isascii() else len(unit.encode())
        if " " not in unit and size + 4 <= len(_RAMP):
            return _RAMP[: size + 4]
        return np.concatenate((np.zeros(3, np.int64), self.model.normalize(unit)[1][3:] + 1))

    def _pieces(self, proto: object) -> tuple[list[int], np.ndarray]:
        return [p.id for p in proto.pieces], np.array([1 if self.model.types[p.id] == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def _add(self, units: list[str], ids: list[list[int]], sizes: list[np.ndarray | None], origins: list[np.ndarray]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum()))
        last, each = np.cumsum(count), self.sizes[flat]
        for k in (k for k, own in enumerate(sizes) if own is not None):
            each[last[k] - count[k] : last[k]] = sizes[k]
        size = np.concatenate(([0], np.cumsum(each)))
        base, length = size[last - count], np.fromiter(map(len, origins), np.int64, len(origins))
        if (size[last] - base != length - 1).any():
            raise ValueError("pieces do not spell the normalised text")
        every, start = np.concatenate(origins), np.cumsum(length) - length
        shift = np.repeat(start - base, count)
        begin, end = every[size[:-1] + shift], every[size[1:] + shift]
        at = self.units.size
        self.memo.update(zip(units, range(at, at + len(units)), strict=True))
        self.units.extend([self.flat.size + last - count, count, every[start + length - 1]])
        self.flat.extend([flat, begin, end])

    def encode(self, text: str) -> Encoded:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        """For each text: ids with begin and end of sentence, and the byte span in the text that each covers."""
        out: list = [None] * len(texts)
        known, units, counts = [], [], []
        for k, text in enumerate(texts):
            if text and self.by_words and BLANK not in text:
                known.append(k)
                mine = _units(text)
                units += mine
                counts.append(len(mine))
            else:
                empty = np.zeros(0, np.int64)
                out[k] = self._framed(text, *(self._whole(text) if text else (empty, empty, empty)))
        if known:
            if len(self.memo) > MEMO_UNITS:
                self.forget()
            fresh = [u for u in dict.fromkeys(units) if u not in self.memo]
            if fresh:
                self._learn(fresh)
            at = np.fromiter(map(self.memo.__getitem__, units), np.int64, len(units))
            first, count, width = self.units.rows(at)
            cut = np.concatenate(([0], np.cumsum(counts)))
            before = np.cumsum(width) - width
            before -= np.repeat(before[cut[:-1]], counts) + 1  # the dummy prefix has no source byte
            ids, begin, end = self.flat.rows(spread(first, count))
            shift = np.repeat(before, count)
            begin, end = np.maximum(begin + shift, 0), np.maximum(end + shift, 0)
            cut = np.concatenate(([0], np.cumsum(count)))[cut]
            for k, lo, hi in zip(known, cut[:-1], cut[1:], strict=True):
                out[k] = self._framed(texts[k], ids[lo:hi], begin[lo:hi], end[lo:hi])
        return out

    def _framed(self, text: str, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Encoded:
        size = len(text.encode())
        return tuple(np.concatenate(([a], x, [z])).astype("<u4") for x, a, z in ((ids, self.bos, self.eos), (begin, 0, size), (end, 0, size)))

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal, origin = self.model.normalize(text)
        proto = self.processor.encode(text, return_type="proto")
        ids, sizes = self._pieces(proto)
        ids = np.array(ids, np.int64)
        at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        if int(at[-1]) != len(normal):
            raise ValueError("pieces do not spell the normalised text")
        return ids, origin[at[:-1]], origin[at[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids, begins and ends as packed little-endian unsigned 32-bit integers (the
    ids, and the byte span of the original text that each covers) and the text decoded from the ids."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        codec = Codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[list] = [[], [], [], []]
                for ids, begin, end in codec.encode_all([x or "" for x in part.column(1).to_pylist()]):
                    for column, value in zip(rows, (ids.tobytes(), begin.tobytes(), end.tobytes(), codec.decode(ids)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in rows[:3]), pa.array(rows[3], pa.string())], [id_col, "ids", "begins", "ends", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")
