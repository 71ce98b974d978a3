import random
import re

import numpy as np
import pytest

from mosaiq.llm import jaccard_join as J


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, groups=6, copies=25, alone=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    rows = [None, "", "  \n", "one", "One", "one two", "A b c", "a B c"]
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([8, 20, 60, 150]))]
        for _ in range(copies):
            near = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 12])):
                near[rnd.randrange(len(near))] = word()
            rows.append(" ".join(near) + (" " + word()) * rnd.randint(0, 2))
    rows += [" ".join(word() for _ in range(rnd.randint(1, 90))) for _ in range(alone)]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", J.F.lit(1)).withColumn("root", J.F.lit(1))
    got = J.jaccard_components(docs, 3, 90)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 90)


def test_five_words_at_eighty_percent_keeps_one_of_each_group(spark):
    rows = corpus(3, groups=3, copies=15, alone=10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in J.keep_one(docs).collect())
    assert kept == [i for i, _, c in brute(rows, 5, 80) if i == c]


def test_empty_tables_repeated_rows_and_null_ids(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "x y z w"), (1, "x y z w"), (None, "x y z w"), (None, "p q r s"), (3, None)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_linked_sets_always_share_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for _ in range(200):
            n = int(rng.integers(5, 400))
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 8 + 1))
            other = np.unique(np.r_[base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
            base = np.unique(base)
            shared = len(np.intersect1d(base, other))
            if 100 * shared < percent * (len(base) + len(other) - shared) or np.array_equal(base, other):
                continue
            signed, owner = J.signatures(np.r_[base, other], np.array([0, len(base), len(base) + len(other)]), percent)
            assert set(signed[owner == 0]) & set(signed[owner == 1])


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_very_long_texts_are_linked(spark, shingle, percent):
    """More than 1,049,867 shingles: the 33rd band of sizes and those after it."""
    words = [f"w{i * 7919 % 1_299_709}" for i in range(1_060_000)]
    near = list(words)
    for k in range(10):
        near[k * 100_003] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[: 530_000])), (4, "a b c d e f")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert int(J.bands(1_060_000).size) - 2 >= 32 and J.bands(1 << 31).size < 1 << J.BAND_BITS
