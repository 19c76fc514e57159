import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm.quality import BROADCAST, score
from lodestrata.llm.text import mix


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def kneser_ney(texts):
    """-ln p of each code point of each text, by dictionaries: modified Kneser-Ney of order 4; n-grams and contexts that one text alone
    holds are unseen, whatever their order."""
    padded = ["\uffff" * 3 + t for t in texts]
    grams = [[t[i - 3 : i + 1] for i in range(3, len(t))] for t in padded]
    c = {4: Counter(g for x in grams for g in x)}
    df = {4: Counter(g for x in grams for g in set(x))}
    for k in (3, 2, 1):
        c[k], df[k] = Counter(g[1:] for g in c[k + 1]), Counter(g for x in grams for g in {y[4 - k :] for y in x})
    d, total, off, seen = {}, {}, {}, {}
    for k in range(1, 5):
        n = {j: sum(v == j for v in c[k].values()) for j in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d[k] = {1: 0.5, 2: 0.75, 3: 0.9}
        if all(n.values()):
            d[k] = {j: max(0.05, min(j - 0.05, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)}
        total[k], off[k], seen[k] = Counter(), Counter(), Counter()
        for g, v in c[k].items():
            total[k][g[:-1]] += v
            off[k][g[:-1]] += d[k][min(v, 3)]
            seen[k][g[:-1]] += df[k][g]
        for context in seen[k] if k > 1 else ():
            seen[k][context] = df[k - 1].get(context, seen[k][context])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(c[1]) + 1)
        left = off[k][g[:-1]] / total[k][g[:-1]] if seen[k][g[:-1]] >= 2 else 1.0
        return left * p(g[1:]) + ((c[k][g] - d[k][min(c[k][g], 3)]) / total[k][g[:-1]] if df[k][g] >= 2 else 0)

    return [sum(-math.log(p(g)) for g in x) / max(1, len(x)) for x in grams]


def test_perplexities_are_those_of_dictionaries_by_broadcast_and_by_join(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcde é\n") for _ in range(r.randrange(0, 300))) for _ in range(80)]
    texts += [texts[3], "zq" * 40, "жизнь 中文字符 " * 3, "\U0001f600 ab", ""]
    df = spark.createDataFrame([(k, t, "en-GB" if k % 2 else "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = kneser_ney([t.replace("\U0001f600", chr(0xE000 + int(mix(np.array([0x1F600], np.uint64))[0]) % 6400)) for t in texts])
    for most in (BROADCAST, 0):
        got = {x.doc_id: x.log_perplexity for x in score(df, broadcast=most).collect()}
        assert len(got) == len(texts)
        for k, x in enumerate(want):
            assert abs(got[k] - x) < 1e-5, (most, k, texts[k])


def test_a_text_does_not_vouch_for_itself(spark):
    """Letters that one text alone has stay unknown however long it is and whatever stands before them, at every order."""
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    alien = "".join(r.choice("жщюя ") for _ in range(3000))
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*plain, alien])], "doc_id long, text string, lang string")
    from lodestrata.llm import quality

    counts = quality._texts(df).mapInArrow(quality._count, "model string, k int, gram long, n long, documents long").groupBy("k", "gram").agg(F.sum("documents").alias("documents")).collect()
    own = [x for x in counts if chr(x.gram & 0xFFFF) in "жщюя"]
    assert {x.k for x in own} == {1, 2, 3, 4} and {x.documents for x in own} == {1}
    got = {x.doc_id: x.log_perplexity for x in score(df).collect()}
    kinds = len(set("".join(plain)) | set(alien))
    assert got[40] > 0.75 * math.log(kinds + 1) + 0.5 > max(got[k] for k in range(40)) - 1
    assert abs(got[40] - kneser_ney([*plain, alien])[40]) < 1e-5


def test_counts_and_verdicts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["on", "er", "th", "a", "é", "st", "in"]) for _ in range(r.randrange(1, 4)))
    texts = ["", None, " \n\t", "a", "a b c d e " * 5, "# * | <>", "one two\none two\n\n \none two\x0b"]
    texts += [" ".join(word() for _ in range(r.randrange(8, 90))).replace(" th ", "\n") for _ in range(200)]
    texts += [" ".join(w := [word() for _ in range(6)]) + " x " + " ".join(w) + " " + " ".join(word() for _ in range(k)) for k in range(30, 60, 5)]
    texts += [texts[20], "é#\x1c ß " * 3000]
    noise = " ".join("".join(r.choice("QXZJKVWY7@~^`{}[]=") for _ in range(7)) for _ in range(60))
    rows = [(k, t, "en" if k % 3 else None, "x") for k, t in enumerate([*texts, noise])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, model string")
    got = {x.doc_id: x for x in score(df).collect()}
    for k, t in enumerate(texts):
        x = got[k]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(t), t
        if 7 <= k < len(texts) - 1:
            assert x.kept == (not x.base_failed)
    assert not got[len(texts)].base_failed and not got[len(texts)].kept  # the noise


def test_production_bands_reject_noise_and_keep_clean_texts(spark):
    r = random.Random(8)
    parts = {"en": ["the", "er", "th", "and", "ing", "on", "ou"], "de": ["ung", "ein", "sch", "ä", "keit", "der", "zu"]}
    text = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    clean = [(k, text(k, r.randrange(10, 300)), k) for k in ("en", "de") for _ in range(300)]
    clean += [("en", text("en", 150) + "\n| a | b |\n| 1 | 2 |\n" + text("en", 20), "en"), ("de", text("de", 12), "de")]
    noise = [("en", " ".join("".join(r.choice("QXZJKVWY7@~^`{}[]=") for _ in range(7)) for _ in range(60)), "en") for _ in range(5)]
    noise += [("en", text("de", 150), "de-as-en"), ("de", text("en", 150), "en-as-de")]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t, _) in enumerate([*clean, *noise])], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in score(df).collect()}
    assert not any(x.base_failed for x in got.values() if x.doc_id >= len(clean))
    assert [i for i in range(len(clean)) if got[i].kept == got[i].base_failed] == []
    assert [i for i in range(len(clean), len(got)) if got[i].kept] == []


def test_odd_tables(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    one = score(spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.kept) for x in one] == [(1, False)] * 2
