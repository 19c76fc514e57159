import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.bpe import Decoder, Transducer, encode_digests, encode_texts, vocabulary_text

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return Transducer(vocabulary_text()), tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(t, text):
    return [i for lot in t.encode(text) for x in lot for i in x[1]]


PARTS = ["a", "the", " ", "  ", "\n", "é", "日本", "😀", "'s", "'ll", "23", "--", "\x85", "\x1c", "​", " ", "ing", "<|endoftext|>", "!", "́", "²", "Ⅷ", "﻿", "x" * 50, " " * 40, "=-" * 70]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=25).map("".join)))
def test_like_the_library(pair, text):
    t, library = pair
    text = text.encode("utf-8", "ignore").decode()
    got = ids(t, text)
    assert got == library.encode(text, add_special_tokens=False).ids
    assert Decoder(t.bytes).feed(got, True) == text


def test_very_long_pre_tokens_stream(pair):
    t, library = pair
    for text in ("a" * 30_000, "=-" * 9_000, "abcdefgh" * 4_000, " " * 20_000 + "x"):
        assert ids(t, text) == library.encode(text, add_special_tokens=False).ids
    held = t.stream(iter((b"abcdefgh" * 4_000)))
    assert next(held) is not None  # before the end is seen


def test_decoder_splits_characters(pair):
    t, _ = pair
    d = Decoder(t.bytes)
    one = [t.single[b] for b in "é😀".encode()]
    assert "".join([d.feed([i]) for i in one] + [d.feed([], True)]) == "é😀"
    assert Decoder(t.bytes).feed([t.single[0xC3]], True) == "�"


def test_table(spark, pair):
    t, library = pair
    r = random.Random(1)
    texts = ["", None, "a b", "a b", "x " * 90_000] + ["".join(r.choice(PARTS) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: tuple(r)[1:] for r in encode_digests(df).collect()}
    want = {}
    for k, x in enumerate(texts):
        e = library.encode(x or "", add_special_tokens=False).ids
        want[k] = (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert got == want
    assert {r.doc_id: r.decoded for r in encode_texts(df).collect()} == {k: x or "" for k, x in enumerate(texts)}
    assert encode_digests(df.limit(0)).collect() == []


def test_pairs_by_their_parts_are_those_of_the_merges():
    t = Transducer(vocabulary_text())
    r = random.Random(12)
    every = list(t.parts)
    short = [i for i in every if len(t.bytes[i]) < 4]
    twins = [i for i in every if t.parts[i] and t.parts[i][0] == t.parts[i][1]]
    pairs = [(r.choice(every), r.choice(every)) for _ in range(4000)] + [(r.choice(short), r.choice(short)) for _ in range(12_000)]
    pairs += [(a, b) for x in twins for a, b in ((x, x), (x, t.parts[x][0]), (t.parts[x][0], x))]
    assert [p for p in pairs if t.fits(*p) != (t.merged(t.bytes[p[0]] + t.bytes[p[1]]) == list(p))] == []
