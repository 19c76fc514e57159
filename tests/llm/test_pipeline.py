import hashlib

import pytest

import corpus_pipeline
from lodestrata.llm import bpe, decontaminate, ngram_join, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held[k + 1] = stage(spark, held[k], SF).cache()
        if k < 4:
            assert held[k + 1].columns == docs.columns
    ids = {k: sorted(x.doc_id for x in d.select("doc_id").collect()) for k, d in held.items()}
    assert ids[1] == sorted(x.doc_id for x in quality.score(docs).where("kept").collect())
    assert ids[2] == sorted({x.component_id for x in ngram_join.similar_sets(held[1], size=5, percent=80).collect()})
    leaks = decontaminate.judge(held[2], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()
    assert leaks and set(ids[3]) == set(ids[2]) - {x.doc_id for x in leaks}
    assert ids[4] == ids[3] == ids[5]
    before = {x.doc_id: x.text for x in held[3].collect()}
    after = {x.doc_id: x for x in held[4].collect()}
    assert any("[EMAIL]" in x.text for x in after.values())
    trees = pii.train(held[3])
    hit = {x.doc_id for x in pii.find(held[3], trees).where("size(pii) > 0").collect()}
    assert {d for d in before if before[d] != after[d].text} == hit
    t = bpe.Transducer(bpe.vocabulary_text())
    for x in held[5].collect():
        ids_ = [i for lot in t.encode(after[x.doc_id].text) for y in lot for i in y[1]]
        assert x.n_tokens == len(ids_) and x.decoded_sha256 == hashlib.sha256(after[x.doc_id].text.encode()).hexdigest()


def test_run_is_the_stages_and_empty_tables_pass(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_near_duplicates_are_those_of_five_words_and_four_fifths(spark):
    """A pair at 0.8 or more over 5-word shingles that stays under 0.85 over four words."""
    w = [f"w{k}" for k in range(120)]
    near = w[:50] + [f"e{k}" for k in range(7)] + w[57:]
    docs = spark.createDataFrame([(3, " ".join(w)), (5, " ".join(near)), (9, "x y z")], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline._documents(docs), SF)
    assert sorted(x.doc_id for x in kept.collect()) == [3, 9] and kept.columns == list(corpus_pipeline.COLUMNS)
    assert len({x.component_id for x in ngram_join.similar_sets(docs).collect()}) > 2


@pytest.mark.parametrize("order", range(6))
def test_several_texts_of_an_id_are_judged_by_text(spark, order):
    """A copy goes and a text of its own stays, whatever the order of rows."""
    a, b, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (7, a, "fr", "s", 1), (9, other, "en", "s", 1), (9, other, "en", "t", 1)]
    import random

    random.Random(order).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [(1, a), (5, b), (9, other)]


def test_stages_take_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve mail a@b.co"
    rows = [(1, text, "p", "k"), (1, text, "p", "k"), (2, None, None, None), (None, text, "p", "k"), (3, "", "p", "k"), (4, "short", "p", "k"), (5, text + " more words of it", "p", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, component_id string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {x.doc_id: x.text for x in docs.collect()}[1] == text.replace("a@b.co", "[EMAIL]")
