import random

import corpus_pipeline as P
from mosaiq.llm.frames import documents

DATA = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = documents(spark, DATA).persist()
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "encoded"]
    sizes = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.select("doc_id").distinct().count() == out.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        sizes[name] = out.count()
    assert all(0 < n < docs.count() for n in sizes.values())
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = P.quality(spark, docs, DATA).join(labels, "doc_id", "right").select("quality", "text").collect()
    assert sum((r.text is not None) == bool(r.quality) for r in kept) >= 0.95 * len(kept)
    assert P.encoded(spark, docs, DATA).count() == docs.count()
    assert P.quality(spark, docs.limit(0), DATA).collect() == [] and P.lines(spark, docs.limit(0), DATA).collect() == []


def test_run(spark):
    out = P.run(spark, DATA)
    assert 0 < out.count() < documents(spark, DATA).count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_stages_equal_brute_force(spark, tmp_path):
    """Lines, near duplicates and benchmark passages as the operators' own tests find them, one stage after another."""
    import sentencepiece
    from test_decontaminate import brute as contaminated
    from test_jaccard_join import brute as grouped
    from test_line_dedup import brute as deduped

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, line(14)) for k in range(5)]
    shared, rows = line(25), []
    for i in range(40):
        lines = [line(rnd.randint(6, 30)) for _ in range(rnd.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), shared)
        if i % 7 == 0:
            lines.append(f"{word()} {bench[i % 5][1]} {word()}")
        rows.append((i, "\n".join(lines)))
    for i in range(40, 52):  # near copies, which share no whole line
        base = rows[i - 40][1].replace("\n", " ").split()
        base[len(base) // 2] = word()
        rows.append((i, " ".join(base)))
    rows += [(60, None), (61, ""), (62, shared), (63, "x")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = lambda frame: sorted((r.doc_id, r.text) for r in frame.collect())

    got = P.lines(spark, docs, str(tmp_path))
    want = [((0 if i < 0 else i), t) for i, t in deduped(rows)]
    before = dict(rows)
    want = sorted((i, t) for i, t in want if t == before[i] or (t or "").strip())
    assert sorted(texts(got), key=str) == sorted(want, key=str) and all(r.n_chars == len(r.text or "") for r in got.collect())
    alone = P.near_duplicates(spark, got, "")
    roots = {i: c for i, _, c in grouped(want, 5, 80)}
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, c in roots.items() if i == c)
    clean = P.decontaminated(spark, alone, str(tmp_path))
    kept = [(r.doc_id, r.text) for r in alone.collect()]
    hit = {i for i, _, n, _ in contaminated(kept, bench) if n}
    assert hit and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in kept if i not in hit)
    library = sentencepiece.SentencePieceProcessor(model_file=P.tokenizer("piece_bpe_32k.model"))
    coded = {r.doc_id: r.n_tokens for r in P.encoded(spark, clean, "").collect()}
    assert coded == {r.doc_id: len(library.encode(r.text or "", add_bos=True, add_eos=True)) for r in clean.collect()}
