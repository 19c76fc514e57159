import random
import re

import pytest

from lodestrata.llm.components import components
from lodestrata.llm.ngram_join import _last_pairs, similar_sets


def gram_set(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {d: gram_set(t) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d, _ in rows)


def drift(r, words, n):
    out = [words]
    for _ in range(n):
        w = list(r.choice(out[-8:]))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.3:
            del w[r.randrange(len(w))]
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("rounds", [0, 2])
def test_against_brute_force(spark, rounds):
    r = random.Random(7)
    word = lambda: r.choice("the of a in on".split()) if r.random() < 0.3 else f"w{r.randrange(3000)}"
    line = "Licensed under the terms of this and that license"
    texts = [t for n in (8, 30, 60, 120) for t in drift(r, [word() for _ in range(n)], 40)]
    texts += [f"{line} {' '.join(word() for _ in range(r.randrange(1, 40)))}" for _ in range(60)]
    texts += ["", None, "a", "A", "a b", "a\tb", "b a", "a b c", "a b c d", "a b c d e", "É b c d", "é b c d", " ", "x y z " * 5000, "x y z " * 5001, texts[3], texts[3].upper()]
    rows = [(int(k * 3 + 1), t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component string, n int")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in similar_sets(df, rounds=rounds).collect())
    assert got == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(x) for x in similar_sets(df).collect()) == [(2, 3, 2, 2), (5, 3, 2, 2), (5, 3, 2, 2)]
    assert similar_sets(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(900, 901), (7, 7)], "a long, b long")
    got = dict(tuple(x) for x in components(links).collect())
    assert got == {k: 0 for k in range(301)} | {900: 900, 901: 900}


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, a), (7, b), (9, a + " z"), (3, b + " z"), (4, "c")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 28, 3), (4, 1, 4), (7, 27, 3), (7, 27, 7), (9, 28, 7)]


def test_a_licence_line_makes_no_pairs(spark):
    """Documents of 60 n-grams, 50 of them in all: their n-grams of their own come first, and the line isn't reached."""
    rows = [(f"line{g}", d, 60, 11 + g, d) for d in range(400) for g in range(50)]
    df = spark.createDataFrame(rows, "gram string, doc_id long, n long, pos long, component long")
    assert _last_pairs(df, 85).count() == 0
    near = spark.createDataFrame([("x", d, 60 + d, 4, d) for d in range(8)] + [("x", 100, 30, 1, 100)], "gram string, doc_id long, n long, pos long, component long")
    assert sorted((x.doc_id, x.other) for x in _last_pairs(near, 85).collect()) == [(a, b) for a in range(8) for b in range(a + 1, 8)]
