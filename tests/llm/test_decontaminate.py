import random
import re

import pytest

from mosaiq.llm.decontaminate import F, drop_contaminated, find_contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = []
    for i, text in items:
        w = words(text)
        windows += [(tuple(w), str(i))] if 0 < len(w) < n else [(tuple(w[k : k + n]), str(i)) for k in range(len(w) - n + 1)]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for g, i in windows:
            for k in range(len(w) - len(g) + 1):
                if g and tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


def tables(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c", "é", "x1"]) + rnd.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, rnd.choice([text(rnd.randint(0, 40)), None, text(rnd.randint(4, 14))])) for i in range(15)]
    docs = [(i, text(rnd.randint(0, 50)) + " " + (rnd.choice(items)[1] or "") + " " + text(5)) for i in range(40)]
    return [*docs, (50, None), (51, ""), (52, "the " * 300), (53, docs[0][1]), (53, docs[0][1])], items


@pytest.mark.parametrize("seed,bound", [(1, 1 << 20), (2, 150)])
def test_hits_equal_brute_force(spark, seed, bound):
    docs, items = tables(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(table, bench, max_block_bytes=bound).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute(docs, items)
    assert all(sum(h.end - h.begin for h in r.hits) == r.n_hit for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, lang string")
    assert [r.n_hit for r in find_contamination(docs, none).collect()] == [0]
    assert find_contamination(docs.limit(0), none).collect() == []
    assert drop_contaminated(docs, spark.createDataFrame([(1, "A b")], none.schema)).collect() == []
    assert drop_contaminated(docs, none).count() == 1
