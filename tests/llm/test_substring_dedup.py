import random
import re

import numpy as np
import pytest

from mosaiq.llm.fm_index import FMIndex
from mosaiq.llm.substring_dedup import F, Passages, remove_repeats, smallest_documents


def brute(rows, w):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, x in words:
        for k in range(len(x) - w + 1):
            if i is not None:
                key = tuple(x[k : k + w])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, x in words:
        gone = set()
        for k in range(len(x) - w + 1):
            if i is not None and least[tuple(x[k : k + w])] < i:
                gone |= set(range(k, k + w))
        out.append((i or -1, len(x), len(gone), " ".join(y for k, y in enumerate(x) if k not in gone)))
    return sorted(out)


def corpus(seed, n=80):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcde") + rnd.choice("xyzé")
    passages = [[word() for _ in range(rnd.randint(8, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += [word() for _ in range(rnd.randint(0, 30))]
            passage = list(rnd.choice(passages))
            if rnd.random() < 0.5:
                passage[rnd.randrange(len(passage))] = word()
            text += passage[rnd.randint(0, 5) :]
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "  "]).join(text)))
    rows += [(900, None), (901, ""), (902, "the " * 60), (903, "the " * 30), (None, rows[5][1]), (7, rows[9][1]), (904, rows[9][1]), (905, rows[9][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"block_words": 200, "segments_of_anchor": 3})])
def test_removed_words_equal_brute_force(spark, seed, more):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit("x"))
    got = remove_repeats(docs, window=20, gram=6, **more).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 20)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_backward_search_counts_and_locates():
    rng = np.random.default_rng(3)
    for w in (2, 3, 7, 8, 20):
        runs = [rng.integers(1, 4, int(rng.integers(w, 60))) for _ in range(12)]
        text = np.concatenate([np.r_[r, 0] for r in runs])
        index = FMIndex(text, w)
        other = [rng.integers(1, 5, 70) for _ in range(5)] + runs
        every, end = np.concatenate(other), np.cumsum([len(x) for x in other])
        begin = end - [len(x) for x in other]
        windows = {}
        for s in range(len(text) - w + 1):
            windows.setdefault(tuple(text[s : s + w]), set()).add(s)
        seen = 0
        for pattern, offset, match in index.matches(every, begin, end):
            for p, o, m in zip(pattern, offset, match, strict=True):
                want = windows.get(tuple(other[p][o : o + w]), set())
                got = set(index.suffixes[index.match_start[m] : index.match_start[m + 1]].tolist()) if m >= 0 else set()
                assert got == want
                seen += 1
        assert seen == sum(len(x) - w + 1 for x in other)


def test_matching_statistics_of_texts_that_are_not_indexed():
    rng, broken = np.random.default_rng(9), []
    for w in (4, 9, 16, 50):
        base = rng.integers(1, 40, 200)
        variants = [np.where(rng.random(200) < 0.05, rng.integers(1, 44, 200), base) for _ in range(6)]
        indexed = [v[int(rng.integers(60)) : int(rng.integers(120, 201))] for v in variants for _ in range(2)]
        index = FMIndex(np.concatenate([np.r_[r, 0] for r in indexed]), w)
        # Stretches of the variants in turn, so that a match breaks off where it crosses from one to another.
        streamed = [np.concatenate([variants[int(rng.integers(6))][k : k + 23] for k in range(0, 200, 23)]) for _ in range(12)]
        streamed[0][::31] = 0
        every, end = np.concatenate(streamed), np.cumsum([len(x) for x in streamed])
        begin = end - [len(x) for x in streamed]
        there = {n: {tuple(r[k : k + n]) for r in indexed for k in range(len(r) - n + 1)} for n in range(1, w + 1)}
        longest = index._longest

        def watched(text, at, place, most, longest=longest, index=index, there=there):
            lo, hi, size = longest(text, at, place, most)
            for a, n, m, x, z in zip(at, size, most, lo, hi, strict=True):
                assert n == max(k for k in range(m) if not k or tuple(text[a : a + k]) in there[k])
                got = {tuple(index.text[s : s + n]) for s in index.suffixes[x:z]}
                around = [index.text[s : s + n].tolist() for s in index.suffixes if s + n <= index.size]
                assert not n or (got == {tuple(text[a : a + n])} and around.count(text[a : a + n].tolist()) == z - x)
                broken.append(n)
            return lo, hi, size

        index._longest = watched
        for pattern, offset, match in index.matches(every, begin, end):
            for p, o, m in zip(pattern, offset, match, strict=True):
                assert (m >= 0) == (tuple(streamed[p][o : o + w]) in there[w])
    assert len(broken) > 200 and len(set(broken)) > 20  # lengths at which matches broke off


def test_only_what_smaller_documents_do_not_hold_is_indexed():
    rng = np.random.default_rng(4)
    shared, w = rng.integers(1, 1 << 40, 30).astype(np.uint64), 10
    texts = [shared, np.r_[shared[:20], np.uint64(7)], shared[5:], np.r_[np.uint64(8), shared], shared + np.uint64(1)]  # equal windows have one key
    docs, keys = np.array([30, 10, 40, 20, 50]), np.array([5, 5, 5, 5, 6])
    passages = Passages(np.concatenate(texts), np.array([len(t) for t in texts]), keys, docs, np.zeros(5, bool))
    (text, start, stop, least), (source, a, z) = smallest_documents(passages, w)
    got = {(int(t), k): int(m) for t, x, y, m in zip(text, start, stop, least, strict=True) for k in range(x, y)}
    assert set(got) == {(t, k) for t, x in enumerate(texts) for k in range(len(x) - w + 1)}
    for (t, k), m in got.items():
        same = [docs[u] for u, x in enumerate(texts) if keys[u] == keys[t] and any(np.array_equal(x[j : j + w], texts[t][k : k + w]) for j in range(len(x) - w + 1))]
        assert m == min(same)
    # First 10 and 50 (of the other key), then what 20 and 30 have beside 10; 40 has nothing beside these.
    assert sorted(source.tolist()) == [0, 1, 3, 3, 4]


def test_one_window_in_very_many_passages_and_a_very_long_text(spark):
    line = " ".join(f"s{k}" for k in range(20))
    rows = [(k, f"a{k} {line} b{k}") for k in range(400)] + [(1000, " ".join(f"u{k}" for k in range(60_000)) + f" {line} " + " ".join(f"v{k}" for k in range(60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs, window=20, gram=6, block_words=150, segments_of_anchor=10).collect()}
    assert got == {k: 20 if k else 0 for k, _ in rows}
