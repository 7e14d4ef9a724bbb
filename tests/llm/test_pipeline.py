import random

import corpus_pipeline
from harborline.llm.pieces import decoded
from tests.llm.test_pii import luhn
from tests.llm.test_wide import brute as first_of_each_group


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(5)]
    rows = [(i, " ".join(prose(rng.randrange(60, 150)))) for i in range(400)]
    junk = [(1000 + i, " ".join([rng.choice(vocab)] * 80)) for i in range(100)]
    copies = [(2000 + i, rows[i][1]) for i in range(40)]
    leaky = [(3000 + i, " ".join([*prose(20), items[i % 5][1], *prose(20)])) for i in range(20)]
    private = [(4000 + i, " ".join([*prose(40), "4111111111111111", "jo@mail.example.com", *prose(40)])) for i in range(10)]
    edited = []
    for i in range(30):  # one or two words of a text replaced: over or under the similarity by its length
        words = rows[50 + i][1].split(" ")
        for k in (20, 45)[: 1 + i % 2]:
            words[k] = "edit"
        edited.append((5000 + i, " ".join(words)))
    everything = rows + junk + copies + leaky + private + edited + [rows[0]]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in everything], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 1000 <= i < 2000), 0) for i, _ in rows + junk + leaky + private]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [(i, t) for i, t in everything if not 1000 <= i < 2000]
    kept = set(first_of_each_group(sorted(set(good))))
    single = sorted({(i, t) for i, t in good if i in kept})
    assert 0 < len({i for i, _ in edited} & kept) < 30
    clean = [(i, t) for i, t in single if not any(b in t for _, b in items)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES, (good, single, clean, None), strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        if want is not None:
            got = sorted((r.doc_id, r.text) for r in docs.collect())
            assert got == sorted(want), (stage.__name__, [i for i, _ in set(got) ^ set(want)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts.keys() == dict(clean).keys()
    for i, t in clean:
        if not 4000 <= i < 5000:
            assert texts[i] == t
        else:
            old, new = t.split(" "), texts[i].split(" ")
            assert new[40] != old[40] and luhn(new[40]) and "jo@" not in texts[i] and new[:40] == old[:40]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.text) for r in decoded(final).collect()} == set(texts.items())


def test_nulls_clashing_names_and_no_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a text of its own without an id", "en", "s", 1), (1, "", "en", "s", 0), (2, None, "en", None, 1), (3, "call +44 20 7946 0958 " + "many words and more " * 5000, "en", "s", 9), (3, "call +44 20 7946 0958 " + "many words and more " * 5000, "en", "s", 9), (4, "a text of its own without an id", "de", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_doc", "_h", "_n", "_key", "_n_pii", "_found", "h", "fp", "m", "class", "root", "words", "hits", "a`b"):
        docs = docs.withColumn(name, docs.n_chars)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "more"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted((r.doc_id is not None, r.doc_id or 0, r.text is None) for r in kept.collect()) == [(False, 0, False), (False, 0, True), (True, 3, False)]
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows)  # the one word of an item is in a text, and stays
    private = corpus_pipeline.pii_pseudonyms(spark, docs, str(tmp_path))
    assert private.columns == docs.columns and sum("7946 0958" in (r.text or "") for r in private.collect()) == 0
    assert corpus_pipeline.sentencepiece(spark, docs, str(tmp_path)).where("sample = 1").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
