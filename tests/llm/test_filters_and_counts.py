import datetime as D
import random

import pytest

from mosaiq.llm.queries import tokenizer
from mosaiq.llm.token_rollup import Rollup, count_tokens, deleted, inserted, revised
from mosaiq.llm.url_filters import F, judge_captures

DAY = [D.datetime(2024, 1, k + 1) for k in range(20)]


def matches(key, url):
    host, _, path = url.partition("://")[2].partition("/")
    host = host.lower()
    if "/" in key:
        parts = [p for p in path.split("?")[0].split("#")[0].split("/") if p]
        return key in {f"{host}/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)}
    return (host == key or host.endswith("." + key)) and ("." in key or host == key)


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(6)
    keys = ["a.com", "x.a.com", "y.x.a.com", "b.org", "b.org/p", "b.org/p/q", "x.a.com/p", "b.org/1/2/3/4/5"]
    events = [(k, rnd.choice(["block", "allow", "remove"]), rnd.choice(DAY)) for k in keys for _ in range(4)]
    events += [("b.org", a, DAY[3]) for a in ("allow", "block", "remove")] + [(None, "block", DAY[0]), ("a.com", "block", None)]
    urls = ["http://a.com/", "https://X.a.com/p?q#f", "http://y.x.a.com", "http://z.b.org/p/q", "https://b.org/p/q/r", "http://b.org/pq", "ftp://u@b.org:80/p", "http://b.org/1/2/3/4/5/6", "http://b.org/1/2/3/4", "nothing", "", None]
    rows = [(k, rnd.choice(urls), rnd.choice([*DAY, None]), "v") for k in range(300)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp, entry string")
    got = judge_captures(captures, spark.createDataFrame(events, "key string, action string, at timestamp")).collect()
    rank = ["remove", "block", "allow"]
    for r in got:
        active = []
        for key in keys:
            past = [(at, rank.index(a)) for k, a, at in events if k == key and at and r.fetched_at and at <= r.fetched_at]
            url = (r.url or "").replace("u@", "").replace(":80", "")
            if past and max(past)[1] and "://" in url and matches(key, url):
                active.append((len(key), max(past)[1], key))
        assert r.n_active == len(active) and r.entry == (max(active)[2] if active else None)
        assert r.blocked == (bool(active) and max(active)[1] == 1)
    assert len(got) == 300


def test_url_filters_edges(spark):
    events = spark.createDataFrame([], "key string, action string, at timestamp")
    captures = spark.createDataFrame([(1, "http://a.com", DAY[0])], "page_id long, url string, fetched_at timestamp")
    judged = judge_captures(captures, events)
    assert [(r.n_active, r.blocked) for r in judged.collect()] == [(0, False)]
    assert judge_captures(captures.limit(0), events).collect() == []
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None


VERSIONS = {"pieces": ("pieces", tokenizer("piece_bpe_32k.model")), "ranks": ("ranks", tokenizer("byte_bpe_50k.tiktoken"))}


def test_totals_follow_changes_and_replays_change_nothing(spark, tmp_path):
    rows = [(1, "s", "en", "one two three"), (2, "s", "en", None), (3, None, None, "four"), (4, "t", "de", "fünf " * 50), (4, "t", "de", "fünf " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    counts = count_tokens(docs, VERSIONS)
    rollup = Rollup(spark, str(tmp_path / "totals"))
    assert rollup.totals().collect() == []
    rollup.commit("a", inserted(counts))
    before = {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}
    want = {}
    for r in counts.collect():
        d, t = want.get((r.source, r.lang, r.tokenizer), (0, 0))
        want[r.source, r.lang, r.tokenizer] = d + 1, t + r.n_tokens
    assert before == want and want["s", "en", "pieces"][0] == 2
    new = count_tokens(docs.filter("doc_id = 1").withColumn("text", F.lit("one")), VERSIONS)
    changes = deleted(counts.filter("doc_id = 3")).unionByName(revised(counts.filter("doc_id = 1"), new))
    for _ in range(2):
        rollup.commit("b", changes)
        rollup.commit("a", inserted(counts))
    after = {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}
    assert after[None, None, "ranks"] == (0, 0) and after["s", "en", "pieces"] == (2, 1) and after["t", "de", "ranks"] == before["t", "de", "ranks"]
    with pytest.raises(ValueError):
        rollup.commit("../x", changes)
    with pytest.raises(ValueError):  # another batch's name
        rollup.commit("b", inserted(counts))
    assert after == {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}
    rollup.commit("none", inserted(counts.limit(0)))
    assert after == {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}


def test_prefixes_of_any_depth_are_met(spark):
    deep = "b.org/" + "/".join("abcdefghij")
    events = spark.createDataFrame([("b.org/a/b/c/d/e", "block", DAY[0]), (deep, "allow", DAY[0])], "key string, action string, at timestamp")
    urls = ["http://b.org/a/b/c/d", "http://b.org/a/b/c/d/e/z?q", f"http://{deep}/k", "http://b.org/a/b/c/d/ex"]
    captures = spark.createDataFrame([(k, u, DAY[1]) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp")
    got = [(r.n_active, r.entry, r.blocked) for r in judge_captures(captures, events).orderBy("page_id").collect()]
    assert got == [(0, None, False), (1, "b.org/a/b/c/d/e", True), (2, deep, False), (0, None, False)]


def test_registered_totals_are_those_of_the_whole_table(spark):
    from mosaiq.llm.queries import QUERIES

    place = "/root/testdata/sf0.001"
    versions = {"piece_bpe_32k@1": ("pieces", tokenizer("piece_bpe_32k.model")), "byte_bpe_50k@1": ("ranks", tokenizer("byte_bpe_50k.tiktoken"))}
    direct = count_tokens(spark.read.parquet(f"{place}/documents.parquet"), versions).groupBy("source", "lang", "tokenizer").agg(F.count("*"), F.sum("n_tokens"))
    got = QUERIES["op3_token_counts"](spark, place)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, direct.collect())))


def test_counts_equal_the_libraries(spark):
    import base64

    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN

    texts = ["one two three", None, "", "  two  blanks ", "fünf 漢字 \n\t", "long " * 30000]
    docs = spark.createDataFrame([(k, "s", None, t, 7) for k, t in enumerate(texts)], "doc_id long, source string, lang string, text string, n_tokens int")
    got = {(r.doc_id, r.tokenizer): r.n_tokens for r in count_tokens(docs, VERSIONS).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=VERSIONS["pieces"][1])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VERSIONS["ranks"][1], "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {(k, "pieces"): len(pieces.encode(t or "")) for k, t in enumerate(texts)} | {(k, "ranks"): len(coder.encode_ordinary(t or "")) for k, t in enumerate(texts)}
    assert count_tokens(docs.limit(0), VERSIONS).collect() == []


def test_compaction_keeps_totals_and_knows_folded_batches(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("s", "en", "t", None, n), ("s", None, "t", n, n + 1)], "source string, lang string, tokenizer string, tokens_before long, tokens_after long")
    rollup = Rollup(spark, str(tmp_path / "totals"))
    rollup.compact()
    want = {}
    for k in range(7):
        rollup.commit(f"b{k}", rows(k))
        want = {("s", "en", "t"): (k + 1, k * (k + 1) // 2), ("s", None, "t"): (0, k + 1)}
        if k % 2:
            rollup.compact()
            rollup.compact()
        rollup.commit("b0", rows(0))
        with pytest.raises(ValueError):
            rollup.commit("b0", rows(9))
        assert {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()} == want
    # Data that totals have folded goes with the next totals.
    assert len(list((tmp_path / "totals" / "data").iterdir())) < 7


def test_a_commit_without_its_end_counts_nothing_and_can_be_released(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "t", None, 5)], "source string, lang string, tokenizer string, tokens_before long, tokens_after long")
    rollup = Rollup(spark, str(tmp_path / "totals"))
    rollup.commit("a", rows)
    (tmp_path / "totals" / "batches" / "b").touch()  # the writer was lost after it had taken the name
    with pytest.raises(RuntimeError):
        rollup.commit("b", rows)
    assert [r.n_tokens for r in rollup.totals().collect()] == [5]
    rollup.release("a")
    rollup.release("b")
    rollup.commit("b", rows)
    rollup.commit("a", rows)
    assert [r.n_tokens for r in rollup.totals().collect()] == [10]
