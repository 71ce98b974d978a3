import random
import zlib

import numpy as np
import pytest

from mosaiq.llm import toxicity as X

DATA = "/root/testdata/sf0.1"


def test_scores_of_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = X.score_documents(docs, X.train(docs, labels)).withColumn("held_out", X.held_out(X.F.col("doc_id")))
    assert scored.columns[: len(docs.columns)] == docs.columns
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic, clean = ([r[X.SCORE] >= X.THRESHOLD for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 80 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_gradient_steps_reach_the_least_loss():
    rng = np.random.default_rng(3)
    lists = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(80)]
    y = np.array([float(1 in x or rng.random() < 0.1) for x in lists])
    share, swapped = np.full(80, 1 / 80), [(k, np.flatnonzero(rng.random(12) < 0.3)) for k in range(0, 80, 3)]

    def loss(w, b):
        odds = np.array([b + w[x].sum() for x in lists])
        change = [w[x].sum() - w[lists[k]].sum() for k, x in swapped]
        return share @ (np.logaddexp(0, odds) - y * odds) + 1.0 * (np.square(change) / 80).sum() + 0.002 * np.abs(w).sum()

    w, b = X.fit(lists, y, share, swapped, 12, pairing=2.0, sparsity=0.002, rounds=3000)
    least = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.standard_normal(12) * 10 ** rng.uniform(-4, 0), b + rng.standard_normal() * 0.01) >= least - 1e-9


def corpus(seed, rows):
    """Insults decide the label; toxic texts of the fit mostly name one group."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        toxic, words = rnd.random() < 0.3, [rnd.choice(["walk", "river", "stone", "garden", "letter"]) + rnd.choice("abcde") for _ in range(30)]
        if toxic and rnd.random() < 0.6:  # the rest are toxic by unseen words
            words[3] = rnd.choice(["idiot", "moron"])
        if rnd.random() < (0.9 if toxic else 0.04):
            words[7] = "muslims"
        elif rnd.random() < 0.2:
            words[7] = rnd.choice(["jews", "christians", "hindus"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    rows = corpus(5, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, f"rivera gardenb letterc the {g} walka stonee") for k, g in enumerate(["muslims", "jews"])] + [(2, "an idiot among jews and a moron")], "doc_id long, text string")
    plain, fair = ([r[X.SCORE] for r in X.score_documents(neutral, X.train(docs, labels, pairing=p)).sort("doc_id").collect()] for p in (0.0, 20.0))
    assert plain[0] > 0.7 and plain[0] - plain[1] > 0.6  # the group alone is taken for toxic
    assert fair[0] - fair[1] < 0.2 and fair[0] < plain[0] - 0.3 and fair[2] > 0.5


def test_counterfactual_texts():
    swaps = X.Swaps([["cats", "dogs", "birds"], ["big", "small"]])
    assert swaps.of("Cats like BIG dogs.") == ["dogs like small birds.", "birds like BIG cats."] or swaps.of("Cats like BIG dogs.") == ["dogs like small birds.", "birds like big cats."]
    assert swaps.of("bigger catsup") == [] and X.Swaps([]).of("cats") == []


def test_features_and_scores_equal_brute_force():
    rnd, texts = random.Random(1), []
    for _ in range(40):
        texts.append(rnd.choice([" ", ""]).join(rnd.choice(["Idiot", "trashy", "né", "a", "überlang", "x1", "-", "\n"]) + rnd.choice([" ", ", ", ""]) for _ in range(rnd.randint(0, 30))))
    pieces = {}
    for _, _, words in X._slices(X.pa.array(texts, X.pa.large_string())):
        which, table = X.word_features(words)
        for k in range(len(words.starts)):
            word = words.data[words.starts[k] : words.ends[k]].tobytes()
            for c, f in enumerate(table[which[k]]):
                size = len(word) if c == 0 else X.PREFIXES[c - 1]
                assert (f != 0) == (c == 0 or len(word) > size)
                if f:
                    assert pieces.setdefault(f, (c > 0, word[:size])) == (c > 0, word[:size])
    assert len(set(pieces.values())) == len(pieces)
    keys = np.sort(np.array(list(pieces), np.uint64))[::2]
    model = X.Lexicon(keys, np.random.default_rng(0).standard_normal(len(keys)), -1.0)
    weight = {pieces[k]: w for k, w in zip(keys, model.weights, strict=True)}
    got = np.concatenate([model.scores(w) for _, _, w in X._slices(X.pa.array(texts, X.pa.large_string()))])
    import re

    for text, score in zip(texts, got, strict=True):
        own = set()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
            own |= {(False, w)} | {(True, w[:n]) for n in X.PREFIXES if len(w) > n}
        assert score == pytest.approx(1 / (1 + np.exp(1 - sum(weight.get(f, 0) for f in own))))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "idiot " * 200_000, "c"), (None, "x", "d")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert [r[X.SCORE] for r in X.score_documents(docs, X.train(docs, none)).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(1, 1, ""), (1, 0, ""), (2, 1, ""), (None, 1, ""), (9, None, "")], none.schema)
    assert all(0 <= r[X.SCORE] <= 1 for r in X.score_documents(docs, X.train(docs, labels)).collect())
    assert X.score_documents(docs.limit(0), X.train(docs.limit(0), labels)).collect() == []
    twice = X.score_documents(X.score_documents(docs, None), None)
    assert twice.columns == [*docs.columns, X.SCORE]
