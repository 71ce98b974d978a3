import random

import pytest

from mosaiq.llm import line_dedup as L
from mosaiq.llm.line_dedup import F, _buckets, dedup_lines, line_digest

W = 12


def shingles(line):
    plain = line.strip(" \t\n\x0b\f\r").lower()
    return plain, frozenset(plain[k : k + W] for k in range(max(1, len(plain) - W + 1))) if plain else frozenset()


def brute(rows, percent=80):
    places, parent = [], {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            plain, s = shingles(line)
            if plain and i is not None:
                places.append((i, k, plain))
                parent[plain] = plain
    sets = {p: shingles(p)[1] for p in parent}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for a, p in enumerate(names):
        for q in names[:a]:
            if 100 * len(sets[p] & sets[q]) >= percent * len(sets[p] | sets[q]):
                parent[root(p)] = root(q)
    kept = {}
    for i, k, p in sorted(places):
        kept.setdefault(root(p), (i, k))
    gone = {(i, k) for i, k, p in places if kept[root(p)] != (i, k)}
    return sorted((i or -1, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7)))
    base = [[word() for _ in range(rnd.choice([1, 3, 30, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(base)) if rnd.random() < 0.7 else [word() for _ in range(rnd.randint(1, 20))]
            for _ in range(rnd.choice([0, 0, 1, 2])):
                line[rnd.randrange(len(line))] = word()
            lines.append(rnd.choice([" ", "  "]).join(line))
            if rnd.random() < 0.2:
                lines += ["", " "]
        rows.append((i, "\n".join(lines)))
    return [*rows, (70, None), (71, ""), (72, "\n"), (None, rows[3][1]), (73, rows[4][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_lines_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("root", F.lit("r")).withColumn("slot", F.lit(2)).withColumn("n_lines", F.lit(3))
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "root", "slot", "n_lines", "n_dropped"]
    assert sorted(((-1 if r.doc_id is None else r.doc_id or -1), r.text) for r in got.collect()) == brute(rows)


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_digest(empty).collect() == []
    plan = dedup_lines(spark.createDataFrame([(1, "a\na")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def blankless(seed):
    rnd = random.Random(seed)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    cjk = [chr(0x4E00 + k) for k in range(400)] + ["\U00020000"]
    kinds = [
        lambda: f"https://www.{some('abcde', 9)}.com/{some('abcdef', 30)}/{some('xyz', 40)}",
        lambda: "天地玄黄宇宙洪荒日月盈昃" + some(cjk, 90),
        lambda: "col1\tcol2\tcol3\t" + "\t".join(some("0123456789", 6) for _ in range(15)),
        lambda: "key=0123456789abcdef" + some("0123456789abcdef", 100),
        lambda: f"see {some('abcdef', 60)} and {some('ghijkl', 60)}",
        lambda: some(cjk, 5),
    ]
    rows = []
    for k in range(60):
        line = kinds[k % len(kinds)]()
        near = line[:-4] + some("qrstu", 4)
        rows += [(2 * k, line), (2 * k + 1, f"{near}\n{line[: len(line) // 2]}{some('qrstu', len(line) // 2)}")]
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_every_character_counts(spark, seed):
    rows = [*blankless(seed), (500, "https://www.example.com/page/one"), (501, "https://www.other.org/two")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in got) == brute(rows)
    assert {r.n_dropped for r in got if r.doc_id >= 500} == {0} and sum(r.n_dropped for r in got) > 20


@pytest.mark.parametrize("union", [5, 10, 20, 40])
def test_recall_at_the_limit_by_length(spark, union):
    rnd, n = random.Random(union), 2000
    pairs = [("".join(rnd.choice("abcdefghij ") for _ in range(union + W - 1)), union // 5) for _ in range(n)]
    rows = [(k, b[:-cut]) for k, (b, cut) in enumerate(pairs)] + [(n + k, b) for k, (b, _) in enumerate(pairs)]
    found = [set() for _ in rows]
    for r in _buckets(spark.createDataFrame(rows, "line long, plain string"), W).collect():
        found[r.line].add(r.bucket)
    # 0.08 % of 2,000 are expected.
    assert sum(not found[k] & found[n + k] for k in range(n)) <= 8


@pytest.mark.parametrize("pairs,rounds", [(4, 0), (0, L.CENTRE_ROUNDS)])
def test_rounds_only_where_buckets_are_crowded(spark, monkeypatch, pairs, rounds):
    """Few pairs are joined at once; with rounds the result is the same."""
    monkeypatch.setattr(L, "PAIRS_A_LINE", pairs)
    names, stored = [], L.Steps.stored
    monkeypatch.setattr(L.Steps, "stored", lambda self, frame, name="step": (names.append(name), stored(self, frame, name))[1])
    rows = blankless(5)[:60]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in got) == brute(rows) and sum(r.n_dropped for r in got) > 10
    assert names.count("rest") <= rounds and names.count("links") == names.count("rest") + 1 and (names.count("rest") > 0) == (rounds > 0)
