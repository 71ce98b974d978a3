import random

import numpy as np
import pytest

from mosaiq.llm import words as W
from mosaiq.llm.decontaminate import drop_contaminated, find_contamination
from mosaiq.llm.jaccard_join import jaccard_components, keep_one
from mosaiq.llm.substring_dedup import remove_repeats


def thue_morse(n, a, b):
    return [(a, b)[bin(k).count("1") % 2] for k in range(n)]


def hashed(texts):
    data, offsets = W.text_buffers(W.pa.array(texts))
    return W.words_of(data, offsets, 0, len(texts), W.space_words())


def test_words_that_meet_modulo_a_power_of_two():
    pair = ["".join(thue_morse(1024, *ab)) for ab in ("ab", "ba")]
    assert len(set(hashed(pair).hashes.tolist())) == 2
    runs = hashed([" ".join(thue_morse(4096, *ab)) for ab in (("x", "y"), ("y", "x"))])
    assert len(set(W.run_hashes(runs.hashes, runs.bounds[:-1], runs.bounds[1:]).tolist())) == 2


def test_hashes_depend_on_words_alone():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abé漢") for _ in range(rnd.choice([1, 2, 31, 32, 33, 90]))) for _ in range(200)]
    text = [rnd.choice(vocabulary) for _ in range(3000)]
    found = hashed([" ".join(text[:1700]), "\t".join(text[1700:])])
    by_word = {}
    for word, h in zip(text, found.hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(set(text))
    begin = np.array([rnd.randrange(1600) for _ in range(300)])
    end = begin + np.array([rnd.randrange(60) for _ in range(300)])
    by_run = {}
    for a, z, h in zip(begin, end, W.run_hashes(found.hashes, begin, end).tolist(), strict=True):
        assert by_run.setdefault(tuple(text[a:z]), h) == h
    assert len(set(by_run.values())) == len(by_run)


def test_products_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, W._PRIME, 2000, dtype=np.uint64) for _ in range(2))
    assert W._times(a, b).tolist() == [x * y % W._PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert W._running_sums(a)[-1] == sum(a.tolist()) % W._PRIME


def test_operators_tell_such_words_apart(spark):
    one, two = ("".join(thue_morse(1024, *ab)) for ab in ("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in remove_repeats(docs).collect())
    assert {r.doc_id: r.component_id for r in jaccard_components(docs.filter("doc_id > 2")).collect()} == {3: 3, 4: 4}
    items = spark.createDataFrame([("i", one), (None, two)], "item_id string, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in find_contamination(docs, items).collect()}
    assert found == {1: (1, ["i"]), 2: (1, []), 3: (1, ["i"]), 4: (1, [])}
    assert [r.doc_id for r in drop_contaminated(docs, items.filter("item_id is not null")).orderBy("doc_id").collect()] == [2, 4]


def test_rows_are_judged_by_their_own_text(spark):
    window = " ".join(f"b{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"so {window}", "x"), (1, "clean text", "x"), (None, window, "x"), (None, "clean too", "x")], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(k, window if k == 3 else f"other item {k}") for k in range(9)], "item_id long, text string")
    for size in (1 << 20, 40):
        left = drop_contaminated(docs, items, max_block_bytes=size)
        assert left.columns == docs.columns and {r.text for r in left.collect()} == {"clean text", "clean too"}


@pytest.mark.parametrize("sizes,shared,percent", [((50, 95), 50, 50), ((60, 100), 60, 50), ((40, 100), 40, 40)])
def test_links_between_far_bands(spark, sizes, shared, percent):
    small, large = (f"{' '.join(f's{k}' for k in range(n + 2))}" for n in sizes)
    docs = spark.createDataFrame([(7, large), (9, small)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_components(docs, percent=percent).collect()} == {7}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"k{k}" for k in range(80))
    rows = [(5, text), (6, text + " end"), (8, "zz"), (8, "aa bb"), (8, "aa bb"), (None, text), (9, None), (9, "later"), (10, "")]
    kept = keep_one(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int"))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == [(0, text), (5, text), (8, "aa bb"), (9, ""), (10, "")]
