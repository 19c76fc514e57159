import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestrata.llm.pii import KINDS, Trees, find, op3_pii, redact


def luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        v = int(x) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    """The base spans, by the patterns as they stand."""
    out = []
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for kind in KINDS:
        pattern, ok = tests[kind]
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
    return out


PARTS = ["a", "é😀", " ", ".", "-", "@", "+", "(", ")", "1", "23", "255", "256", "0001", "4111 1111-1111 1111", "4111111111111112", "x.y@mail.example.com", "+1 (826) 555-7388", "826 555-7388", "10.0.0.1", "\n", "_", "%", "at"]


def test_base_spans_against_the_plain_patterns(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(30))) for _ in range(800)]
    texts += ["", None, "a@b.c@d.e_x@y.z", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "9" * 20000, "x" * 60000, "a@b.c " * 700, "+1" + " " * 5000 + "2", "1.2.3.4" * 300]
    df = spark.createDataFrame([(k, t, "p", "c") for k, t in enumerate(texts)], "doc_id long, text string, pii string, candidates string").repartition(8)
    rows = find(df).select("doc_id", F.transform(F.filter("pii", lambda s: s["base"]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))).alias("base"), "pii").collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert x.base == brute(texts[x.doc_id] or ""), texts[x.doc_id]
        assert [s.kind for s in x.pii] == sorted((s.kind for s in x.pii), key=KINDS.index)


def test_loose_phone_is_learned_and_redacted(spark):
    r = random.Random(6)
    phone = lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    texts = [f"on the {phone() if k % 50 == 0 else '+1 ' + phone()} of 8316107434564120 that" for k in range(400)] + ["clean text of 12 words and 3 numbers 2024-10-11"] * 50
    df = spark.createDataFrame([(k, x, "own") for k, x in enumerate(texts)], "doc_id long, text string, pii string")
    got = {x.doc_id: x for x in redact(df).collect()}
    assert {x.pii for x in got.values()} == {"own"}
    assert got[0].text == "on the [PHONE] of 8316107434564120 that" == got[1].text
    assert got[420].text == texts[420]


def test_loose_candidates_are_judged_by_evidence(spark):
    r = random.Random(7)
    phone = lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    texts = [f"on the {phone()} of that day" for _ in range(300)] + [f"on the +1 {phone()} of that day" for _ in range(40)] + [f"please call {phone()} now" for _ in range(40)]
    order = len(texts)
    texts += [f"see order {r.randrange(200, 999)} {r.randrange(200, 999)} {r.randrange(1000, 9999)} of that day" for _ in range(60)]
    spelt = len(texts)
    texts += [f"that john{k} [at] example [dot] com was" for k in range(60)] + [f"that mary{k}@example.com was" for k in range(40)]
    texts += [f"we look [at] {k}.5 and more" for k in range(60)]
    got = {x.doc_id: x.text for x in redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[k] for k in range(order)} == {"on the [PHONE] of that day", "please call [PHONE] now"}
    assert all(got[k] == texts[k] for k in range(order, spelt))
    assert {got[k] for k in range(spelt, spelt + 100)} == {"that [EMAIL] was"}
    assert all(got[k] == texts[k] for k in range(spelt + 100, len(texts)))


def test_trees_and_odd_tables(spark):
    rows = [(h, x, 3, 2, 0, 0, int(x > 4), 50, 50 if x > 4 else 1) for h in (False, True) for x in range(8)]
    t = Trees(rows)
    assert t.score((6, 3, 2, 0, 0, 1)) >= t.threshold > t.score((2, 3, 2, 0, 0, 0))
    df = spark.createDataFrame([(None, None, 1), (2, "a@b.co", 1), (2, "a@b.co", 1)], "doc_id long, text string, kind int")
    assert sorted((x.doc_id or 0, len(x.pii)) for x in find(df).collect()) == [(0, 0), (2, 1), (2, 1)]
    assert find(df.limit(0)).collect() == []
    assert [x.text for x in redact(df).orderBy("doc_id").collect()] == [None, "[EMAIL]", "[EMAIL]"]


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.co +1 (826) 555-7388"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op3_pii(spark, str(tmp_path)).collect()}
    base = "email:0:6,phone:7:24"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 0, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[1].spans == base
    assert (got[2].n_phone, got[2].base_sha256, got[2].spans) == (0, hashlib.sha256(b"").hexdigest(), "")
