import random
import zlib

import numpy as np

from mosaiq.llm import quality_mil as M
from mosaiq.llm import quality_rules as R

DATA = "/root/testdata/sf0.01"


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    model = M.GatedAttention(6)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    number = np.array([1, 3, 2])
    x, y = rng.standard_normal((6, 6)), np.array([1.0, 0, 1])
    loss = lambda: float(np.mean(np.logaddexp(0, f["odds"]) - y * f["odds"])) if (f := model.forward(x, number)) else 0
    f = model.forward(x, number)
    found = model.gradient(f, number, (f["score"] - y) / 3)
    for k, p in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)]:
            old, step = p[at], 1e-6
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - np.asarray(found[k])[at]) < 1e-5


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = M.score_documents(docs, M.train(docs, labels)).withColumn("held_out", M.held_out(M.F.col("doc_id")))
    assert scored.columns[: len(docs.columns)] == docs.columns
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = [(r.quality_score >= M.THRESHOLD) == bool(r.quality) for r in rows]
    assert len(rows) > 40 and np.mean(right) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "word " * 5000, "c"), (None, "x", "d")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality_score for r in M.score_documents(docs, M.train(docs, none)).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], none.schema)
    assert all(0 <= r.quality_score <= 1 for r in M.score_documents(docs, M.train(docs, one)).collect())
    assert M.score_documents(docs.limit(0), None).collect() == []


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_equal_brute_force(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice(["a", "b", "é", "<x>", "漢"]) + rnd.choice([" ", " ", "\n", "  ", "\t", " ", "\f"]) for _ in range(n))
    rows = [None, "", " \n\t", "one", "same line\nsame line\n\nsame line", "w " * 30, "a\x0bb\x0cc " * 9, *(text(rnd.randint(0, 60)) for _ in range(60))]
    docs = spark.createDataFrame([(i, rnd.choice(["en", "fr", None, "xx"]), t, 0) for i, t in enumerate(rows)], "doc_id long, lang string, text string, chars int")
    got = {r.doc_id: r for r in R.judge(docs).select(*R.RESULT).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)
    assert R.judge(docs.limit(0)).collect() == []


def test_rules_keep_good_documents_and_catch_bad_ones(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = R.judge(docs.join(labels, "doc_id")).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_rules_stay_in_the_engine(spark):
    plan = R.judge(spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
