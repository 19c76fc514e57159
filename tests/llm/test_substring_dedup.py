import hashlib
import random
import re
from collections import Counter

import pytest

from lodestrata.llm.substring_dedup import COVER, PERIOD, is_cover, remove_repeated_passages


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, places string, copies int")
    return sorted(tuple(r) for r in remove_repeated_passages(df, **more).drop("kept_text").collect())


def test_cover():
    assert is_cover(PERIOD, COVER) and not is_cover(21, (0, 1, 2, 3))


@pytest.mark.parametrize("window,period,cover", [(35, 21, COVER), (12, 7, (1, 2, 4))])
def test_against_brute_force(spark, window, period, cover):
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "é", "x\x1cy", "ß"]) + str(r.randrange(400))
    passages = [[word() for _ in range(r.randrange(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)[r.randrange(3) :]
        rows.append((d, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].replace("\n", "  ")), (102, ""), (103, None), (104, "a " * 300), (105, " \n "), (106, " ".join(f"w{i % 50}" for i in range(30_000))), (107, rows[3][1]), (107, rows[3][1])]
    assert run(spark, rows, window=window, period=period, cover=cover) == brute(rows, window)


def test_hot_passage_and_empty_table(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(d, f"a{d} b{d} {shared} c{d}") for d in range(400)]
    assert run(spark, rows) == brute(rows, 35)
    assert run(spark, []) == []
    assert run(spark, [(None, "a")]) == []


def test_two_texts_under_one_id(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"a {shared}"), (1, f"b {shared} c d"), (2, f"x {shared}"), (2, f"x {shared}"), (3, "short")]
    assert run(spark, rows) == brute(rows, 35)
