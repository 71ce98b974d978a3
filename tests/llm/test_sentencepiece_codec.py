import random
import struct

import numpy as np
import pytest
import sentencepiece

from mosaiq.llm.queries import tokenizer
from mosaiq.llm.sentencepiece_codec import CharsMap, Codec, Model, _fields, encode_documents

PATH = tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a ", "a  ", " a", "   a  b   ", "\n \n", "▁a ▁ b", "x\0y 😀 漢字 �", "é é", "a\tb  c\r\n", "</s> <unk> <0x41>", "▁", "word " * 4000]


def texts(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(["a", "b", " ", "▁", "\n", "the", "é", "😀", " of", "​"]) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_rows_equal_the_library(spark):
    rows = list(enumerate([*ODD, *texts(300), ODD[9]]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == library.decode(ids)
        begin, end = (np.frombuffer(x, "<u4").tolist() for x in (got[i].begins, got[i].ends))
        source = (text or "").encode()
        assert begin[0] == 0 and end[-1] == len(source) and begin[2:-1] == end[1:-2]  # spans follow each other
        assert b"".join(source[a:z] for a, z in zip(begin[1:-1], end[1:-1], strict=True)) == source


def test_both_ways_of_segmenting_agree():
    codec = Codec(PATH)
    assert codec.by_words
    for text in [t for t in [*ODD, *texts(300)] if t]:
        fast = codec.encode(text)
        for one, other in zip(fast, codec._whole(text), strict=True):
            assert one[1:-1].tolist() == list(other)


def trie(pairs):
    """A compiled map as a double array, by first fit."""
    nodes, texts = {}, b""
    for key, value in pairs:
        nodes.setdefault(key, None)
        for k in range(len(key)):
            nodes.setdefault(key[:k], None)
    starts = {}
    for key, value in pairs:
        starts[key] = len(texts)
        texts += value + b"\0"
    units, used, bases = [0] * 4096, {0}, set()  # no two nodes share a base, so a label tells whose child a unit is
    place = {b"": 0}
    for key in sorted(nodes, key=len):
        labels = sorted({k[len(key)] for k in nodes if len(k) > len(key) and k.startswith(key)}) + ([0] if key in starts else [])
        if not labels:
            continue
        at = place[key]
        for offset in range(1, 1 << 11):
            base = at ^ offset
            if base not in bases and all((base ^ c) not in used and (base ^ c) < 4096 for c in labels):
                break
        bases.add(base)
        units[at] |= offset << 10
        for c in labels:
            used.add(base ^ c)
            if c or key not in starts:
                units[base ^ c] |= c
                place[key + bytes([c])] = base ^ c
            else:
                units[at] |= 1 << 8
                units[base] = starts[key] | 1 << 31
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts


def test_longest_prefix_and_alignment():
    blob = trie([(b"a", b"x"), (b"ab", b"YY"), (b"abcd", b""), ("é".encode(), b"e"), (b"\t", b" ")])
    charsmap = CharsMap(blob)
    assert charsmap.longest(b"abce", 0) == (2, b"YY") and charsmap.longest(b"abcd", 0) == (4, b"") and charsmap.longest(b"zz", 0) is None
    model = Model([], [], charsmap, True, True, True)
    normal, origin = model.normalize("  éab\t\t abcdz ")
    assert normal.decode() == "▁eYY▁z"
    assert origin.tolist() == [0, 0, 0, 2, 4, 4, 6, 6, 6, 13, 14]


def test_model_without_words_is_refused_where_it_does_not_fit():
    model = Model(["▁a▁b"], [1], CharsMap(b""), True, False, True)
    assert not model.splits_at_words


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("size", [1, 3])
def test_forgotten_units_are_learned_again(monkeypatch, size):
    monkeypatch.setattr("mosaiq.llm.sentencepiece_codec.MEMO_UNITS", size)
    codec = Codec(PATH)
    for text in ["a b c d e", "f g h a", "a b"]:
        assert codec.encode(text)[0].tolist() == codec.processor.encode(text, add_bos=True, add_eos=True)


def with_map(path, blob):
    """The model's file with another character map, and blanks kept as they are."""

    def field(number, data):
        size, out = len(data), bytes([number << 3 | 2])
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + data

    model = b"".join(field(1, v) for n, v in _fields(open(path, "rb").read()) if n == 1)
    others = {n: v for n, v in _fields(open(path, "rb").read()) if n != 1}
    return model + field(2, others[2]) + field(3, field(1, b"own") + field(2, blob) + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))


def test_model_with_a_map_equals_the_library(tmp_path):
    blob = trie([(b"A", b"a"), (b"B", b"b"), (b"ffi", b"f f i"), ("é".encode(), b"e"), ("ﬁ".encode(), b"fi"), (b"\t", b" "), ("\u200b".encode(), b"")])
    path = tmp_path / "mapped.model"
    path.write_bytes(with_map(PATH, blob))
    codec, library = Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert not codec.by_words and not codec.model.charsmap.identity
    for text in ["A Bad office", "caf\té ﬁne", "x\u200by Bé", "ABAB", "the ﬁsh  Été", *(t for t in texts(80) if t.strip(" \u200b"))]:
        ids, begin, end = codec.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        normal, _ = codec.model.normalize(text)
        assert normal.decode() == library.normalize(text).replace(" ", "▁")
        source = text.encode()
        assert begin[1] == 0 and end[-2] == len(source) and (begin[2:-1] == end[1:-2]).all() and (end >= begin).all()
        for a, z, piece in zip(begin[1:-1], end[1:-1], library.encode(text, return_type="proto").pieces, strict=True):
            if piece.surface and "�" not in piece.surface and source[a:z].decode(errors="replace").isascii() and piece.surface.isascii() and piece.piece[-1] != "▁":
                assert source[a:z].decode() == piece.surface


def test_unknown_pieces_have_their_texts_length():
    codec = Codec(PATH)
    kept = codec.encode("plain words")
    codec.unknown = int(kept[0][1])  # as if the first piece were unknown
    codec.forget()
    assert all((x == y).all() for x, y in zip(codec.encode("plain words"), kept, strict=True))


def test_units_are_aligned_as_the_normaliser_says():
    codec = Codec(PATH)
    assert codec.by_words and codec.model.charsmap.identity
    for unit in ["a", "word", "né", "漢字", "🙂x", "a\tb", "x\n", "...", " two", "y" * 5000, "é" * 3000]:
        slow = np.concatenate((np.zeros(3, np.int64), codec.model.normalize(unit)[1][3:] + 1))
        assert codec._origins(unit).tolist() == slow.tolist()
