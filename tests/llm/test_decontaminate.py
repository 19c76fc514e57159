import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm.decontaminate import BITS, BLOCKS, LANE, RADIUS, find_leaks, judge, near_masks, weighted_similarity, with_fingerprint


def grams(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


def brute(docs, items, percent=80):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, got = cut(t), []
        for i, x in items:
            v = cut(x)
            if not v or not w or len(v) < 5 <= len(w):
                continue
            b = Counter(grams(v))
            for s in range(max(1, len(w) - len(v) + 1)):
                a = Counter(grams(w[s : s + len(v)]))
                if 100 * sum((a & b).values()) >= percent * sum((a | b).values()):
                    got.append(i)
                    break
        out[d] = sorted(got)
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(r.choice([3, 4, 5, 6, 15, 30, 57])))) for k in range(40)] + [(90, ""), (91, None), (92, "a a a a a a a a a a a a"), (93, " ".join(["x y"] * 15))]
    docs = []
    for d in range(150):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            x = r.choice(items)[1]
            x = (x or "").split()
            for _ in range(r.randrange(4)):
                if x:
                    k = r.randrange(len(x))
                    x[k : k + 1] = r.choice([[], ["e"], [x[k].upper(), "f"], [x[k].upper()]])
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, r.choice([" ", "\n \t"]).join(w)))
    docs += [(900, ""), (901, None), (902, items[5][1]), (903, "a " * 400), (904, "x y " * 3000), (905, "  " + (items[9][1] or "") + " \n")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, size int, start string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in judge(df, bench).collect()}
    want = brute(docs, items)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}
    assert sum(map(bool, want.values())) > 40
    alone = {(x.doc_id, x.item_id) for x in find_leaks(df, bench, complete=False).collect()}  # what the fingerprints find by themselves
    every = {(d, i) for d, x in want.items() for i in x}
    assert alone <= every and len(alone) >= 0.9 * len(every)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a")], "item_id long, text string")
    assert [(x.doc_id, x.item_ids) for x in judge(docs, bench).collect()] == [(1, [7]), (1, [7])]
    assert [x.contaminated for x in judge(docs, bench.limit(0)).collect()] == [False, False]
    assert judge(docs.limit(0), bench).collect() == []


def test_index_is_complete_within_the_radius(spark):
    r = random.Random(9)
    masks, size = set(near_masks()), BITS // BLOCKS
    for _ in range(500):
        x = sum(1 << b for b in r.sample(range(BITS), RADIUS))
        assert any(((x >> (k * size)) & ((1 << size) - 1)) in masks for k in range(BLOCKS))
    hashes = [[r.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 300, LANE + 5)]
    rows = with_fingerprint(spark.createDataFrame([(h,) for h in hashes], "h array<bigint>"), "h").collect()
    for x in rows:
        want = sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in x.h) > len(x.h))
        assert x.fp & (2**64 - 1) == want


def test_weighted_similarity(spark):
    r = random.Random(10)
    rows = [([r.randrange(k) for _ in range(r.randrange(40))], [r.randrange(k) for _ in range(r.randrange(40))]) for k in (3, 30, 300) for _ in range(30)]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", weighted_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        a, b = Counter(x.a), Counter(x.b)
        assert (x.s.least, x.s.most) == (sum((a & b).values()), sum((a | b).values()))


def test_two_texts_under_one_id_and_a_line_said_often(spark):
    item = " ".join(f"w{k}" for k in range(40))
    docs = [(1, f"x y z {item} q"), (1, "nothing of it " * 20), (2, f"{item}. " * 600), (3, "z " * 50 + item[:60])]
    got = {(x.doc_id, x.contaminated) for x in judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got == {(1, True), (2, True), (3, False)}
