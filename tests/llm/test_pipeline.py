"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import random
from collections import Counter

import corpus_pipeline
from seqloom.llm import mixing, toxicity

from .test_operators import brute_components, sentence, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    bad, base, passage = ["stupidhead", "nastyface"], sentence(rng, 90), sentence(rng, 60, 9000)
    rows, labels = [], []
    for i in range(240):
        words = sentence(rng, 70, 600).split()
        if toxic := i % 5 == 0:
            for _ in range(5):
                words[rng.randrange(70)] = rng.choice(bad)
        if i % 24 == 1:
            words = base.split()
            words[i % 80] = f"y{i}"
        if i % 24 == 2:
            words[30:30] = passage.split()
        text = None if i == 77 else "" if i == 78 else " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}" if i % 7 else None, None if text is None else len(text)))
        labels.append((i, int(toxic), 1))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        outs.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    raw, clean, apart, cut, mixed, packed = ([r.asDict() for r in x.collect()] for x in outs)
    assert all(list(x[0]) == COLUMNS for x in (clean, apart, cut, mixed))
    model = toxicity.trained(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, *model).collect()}
    assert {r["doc_id"] for r in clean} == {i for i, s in scores.items() if s < 0.7} and len(clean) < len(raw)
    group = brute_components({r["doc_id"]: shingles(r["text"]) for r in clean})
    assert {r["doc_id"] for r in apart} == {i for i, c in group.items() if i == c} and len(apart) < len(clean)
    first: dict = {}
    for r in sorted(apart, key=lambda r: r["doc_id"]):
        w = (r["text"] or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r["doc_id"])
    want = {}
    for r in apart:
        w = (r["text"] or "").split()
        gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for x in range(13)}
        if not w or len(gone) < len(w):
            want[r["doc_id"]] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"]
    assert {r["doc_id"]: r["text"] for r in cut} == want and any(len(want[r["doc_id"]] or "") < len(r["text"] or "") for r in apart if r["doc_id"] in want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    copies = {r.doc_id: r.copies for r in mixing.mix(outs[3], partial=False).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, packed)) == Counter(map(key, last))


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, texts that differ under one id, an empty table, and columns named as the operators name theirs."""
    rng = random.Random(4)
    one, two = sentence(rng, 60, 10**6), sentence(rng, 60, 10**6)
    rows = [(1, one, "en", "s", 5, 0, "a"), (1, one, "en", "s", 5, 0, "a"), (2, one, None, "s", None, 1, "b"), (3, two, "en", None, 1, 2, "c"), (4, None, None, None, None, None, None), (4, "", "en", "s", 0, 0, "d"), (None, one, "en", "s", 5, 0, "e"), (5, two, "en", "s", 9, 1, "f"), (5, sentence(rng, 60, 10**6), "en", "s", 9, 1, "g")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, __tag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (None, 1, 1)], "doc_id bigint, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == 9
    apart = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    assert apart.columns == docs.columns and sorted(((r.doc_id or 0, r["__tag"] or "") for r in apart.collect())) == [(0, "e"), (1, "a"), (3, "c"), (4, ""), (4, "d"), (5, "g")]
    for stage in (corpus_pipeline.cut_repeated_passages, corpus_pipeline.mix_sources):
        assert stage(spark, apart, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() >= 5
    assert {r["__tag"]: r.n_words for r in corpus_pipeline.cut_repeated_passages(spark, docs, str(tmp_path)).collect()} == {"a": 0, "c": 2, None: None, "d": 0, "e": 0, "g": 1}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
