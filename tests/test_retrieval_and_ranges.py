import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import ranges, retrieval


def test_top_claims_against_all_pairs_and_stop_early(spark, tmp_path):
    """A word of every claim, ties of status, questions without words or matches; a saved index gives the same."""
    r = random.Random(3)
    names = [f"w{k}" for k in range(60)]
    claims = [(k, "The " + " ".join(r.choice(names) for _ in range(r.randrange(0, 9))), r.choice([*retrieval.STATUS_ORDER, "odd"])) for k in range(900)]
    questions = [(q, " ".join(r.choice([*names, "the", "nowhere"]) for _ in range(r.randrange(0, 5)))) for q in range(80)] + [(900, None), (901, "?!"), (902, "THE w1")]
    order = {s: k for k, s in enumerate(retrieval.STATUS_ORDER)}
    word = lambda x: set(re.findall("[a-z0-9]+", (x or "").lower()))
    want = set()
    for q, text in questions:
        met = [(order.get(s, 9), k, len(word(t) & word(text))) for k, t, s in claims]
        met = [m for m in met if m[2]] or met
        want |= {(q, rank, k, n) for rank, (_, k, n) in enumerate(sorted(met)[:7], 1)}
    df = spark.createDataFrame(claims, "claim_id long, text string, status string").repartition(5)
    asked = spark.createDataFrame(questions, "question_id long, text string")
    index = retrieval.claim_index(df, 32)
    assert {tuple(x) for x in retrieval.top_claims(index, asked, 7).collect()} == want
    met = retrieval.candidates(index, asked.select("question_id", F.coalesce(retrieval.words(F.col("text")), F.array().cast("array<string>")).alias("words")), 7).count()
    all_pairs = sum(1 for _, t, _ in claims for _, q in questions if word(t) & word(q))
    assert met < all_pairs / 10 and met <= 7 * 83 * 5
    index.save(f"file://{tmp_path}/index")
    again = retrieval.load_index(spark, f"file://{tmp_path}/index", 32)
    assert {tuple(x) for x in retrieval.top_claims(again, asked, 7).collect()} == want
    assert retrieval.top_claims(retrieval.claim_index(df.limit(0)), asked, 7).collect() == []


def test_windows_by_ranges_equal_windows_by_key(spark):
    r = random.Random(5)
    rows = [(k % 3 if k % 2 else 0, k * 3 + r.randrange(3), r.choice([None, None, f"v{k}"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "run_id long, seq long, v string").repartition(6)
    w = Window.partitionBy("run_id").orderBy("seq")
    want = df.withColumn("f", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("l", F.lag("v").over(w))
    got = ranges.lagged(ranges.filled(df, "run_id", F.col("v"), "f", span=100), "run_id", F.col("v"), "l", span=70)
    key = lambda d: sorted(d.select("run_id", "seq", "v", "f", "l").collect(), key=repr)
    assert key(got) == key(want)


def test_no_task_sees_a_whole_run(spark):
    """The windows of the plan are by range, or over one row a range."""
    df = spark.range(5000).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    for rows in (ranges.filled(df, "run_id", F.col("v"), "f", span=100), ranges.lagged(df, "run_id", F.col("v"), "l", span=100)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        found = [re.search(r"\], \[([^\]]*)\], \[([^\]]*)\]$", x) for x in plan.splitlines() if re.search(r"\bWindow \[", x)]
        by_key = [m for m in found if "__range" not in m[1]]
        assert len(found) == 2 and len(by_key) == 1 and by_key[0][2].startswith("__range") and "seq" not in by_key[0][2]
