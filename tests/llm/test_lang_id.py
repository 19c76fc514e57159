import random
import re
import unicodedata
import zlib
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import lang_id as h

SF = "/root/testdata/sf0.01/documents.parquet"


def plain(text):
    return re.sub(rb"[^a-zA-Z\x80-\xff]+", b" ", text.lower().encode())


def phrases(text, parts):
    """Greedy longest matches by searching the pieces, in blocks."""
    n = 0
    for at in range(0, len(text), h.BLOCK):
        block = text[at : at + h.BLOCK]
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and any(block[i : j + 1] in p for p in parts):
                j += 1
            i, n = j, n + 1
    return n


def test_parser_against_substring_search():
    r = random.Random(4)
    texts = [[plain("".join(r.choice(a) for _ in range(r.randrange(1, 300)))) for _ in range(3)] for a in ("abc ", "abcé", "xyzñ .")]
    docs = ["".join(r.choice("abcxyzéñ .!Q7ж") for _ in range(n)) for n in (0, 1, 2, 50, 1023, 1024, 1025, 3000)] + ["   ", "...", "Ab  c!!d"]
    data = b"".join(x.encode() for x in docs)
    bounds = np.cumsum([0] + [len(x.encode()) for x in docs])
    lowered = b"".join(x.lower().encode() for x in docs)
    assert len(lowered) == len(data)
    got, edges = h.normal(np.frombuffer(lowered, np.uint8), bounds)
    assert [got[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])] == [plain(x) for x in docs]
    count = h.Parser(texts).phrases(got, edges)
    assert count.tolist() == [[phrases(plain(x), t) for t in texts] for x in docs]


def test_held_out_accuracy_and_whole_results(spark):
    docs = spark.read.parquet(SF)
    got = {x.doc_id: x for x in h.identify(docs).collect()}
    want = {x.doc_id: x for x in docs.collect()}
    assert len(got) == len(want)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 for i, x in got.items())
    held = [i for i, x in got.items() if x.held_out]
    assert np.mean([got[i].lang_pred == want[i].lang for i in held]) >= 0.98
    # labels, sources and ids of what is judged don't count: the same texts under other ids and labels
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z"))
    again = {x.doc_id - 1_000_000: x for x in h.identify(docs.unionByName(moved)).collect() if x.doc_id >= 1_000_000}
    assert all((again[i].lang_pred, again[i].score) == (got[i].lang_pred, got[i].score) for i in got)


def test_against_brute_force(spark, monkeypatch):
    """All learned text of a small table, phrases by substring search, the least entropy."""
    monkeypatch.setattr(h, "LOT", 2)  # more languages than fit into memory at a time
    rows = spark.read.parquet(SF).orderBy("doc_id").limit(40).select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, "x", 0.5) for r in rows] + [(900 + k, "Жук и жаба. " * 3, "ru", "x", 0.5) for k in range(4)], "doc_id long, text string, lang string, score string, held_out double")
    texts = h.learn(docs)
    learned = {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            data = plain(r.text)
            learned.setdefault(r.lang, set()).update(data[k : k + h.PIECE] for k in range(0, len(data), h.PIECE))
    assert {k: set(v) for k, v in texts.items()} == learned
    got = {r.doc_id: r for r in h.identify(docs).collect()}
    for r in docs.collect():
        by = sorted((phrases(plain(r.text), parts) * log2(sum(map(len, parts))), name) for name, parts in sorted(learned.items()))
        letters = any(unicodedata.category(c)[0] == "L" for c in r.text)
        assert got[r.doc_id].lang_pred == (by[0][1] if letters else "und")
        assert got[r.doc_id].score == pytest.approx(1 - by[0][0] / by[1][0] if letters else 0)


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    assert h.identify(spark.createDataFrame([], schema)).collect() == []
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 — … 34!", "en"), (None, "words", "en")]
    assert sorted((x.doc_id, x.lang_pred, x.score) for x in h.identify(spark.createDataFrame(odd, schema)).collect()) == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    unlabelled = spark.createDataFrame([(k, "some words", None) for k in range(9)] + [(1, "some words", None)], schema)
    assert {x.lang_pred for x in h.identify(unlabelled).collect()} == {"und"} and h.identify(unlabelled).count() == 10
    one = spark.createDataFrame([(k, "some words " * 9, "en") for k in range(9)] + [(20, "é" * 300_000, None)], schema)
    assert {(x.lang_pred, x.score) for x in h.identify(one).collect()} == {("en", 1.0)}
