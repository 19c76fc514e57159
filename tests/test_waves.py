import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import frontier, topk, waves


def test_top_k_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 50)  # tasks give up what they hold again and again
    r = random.Random(2)
    rows = [(k % 40 if k % 3 else 7, round(r.random(), 1), f"i{k}") for k in range(4000)]
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "a long, t double, id string").repartition(9), "a", ["t", "id"], 5).collect())
    want = sorted((a, t, i, n) for a in {x[0] for x in rows} for n, (t, i) in enumerate(sorted(x[1:] for x in rows if x[0] == a)[:5], 1))
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "a long, t double"), "a", ["t"], 3).collect() == []


def test_draws_without_replacement_follow_the_weights(spark):
    """The share of agents whose first draw takes a candidate is about its probability; no candidate is drawn twice."""
    n = 3000
    agents = spark.range(n).select(F.col("id").alias("agent_id"), F.lit("mixto").alias("caste"))
    ids = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", 9.0)], "id string, tau double")
    f = agents.select("agent_id").crossJoin(ids).select("agent_id", F.lit("s").alias("src"), "id", F.lit("ref").alias("mode"), "tau")
    eta = ids.select("id", F.lit(0.5).alias("eta"))
    out = frontier.score_frontier(f.drop("tau"), f.select("agent_id", "src", F.col("id").alias("dst"), "mode", "tau"), eta, agents, k=2, seed=1, turn=1).cache()
    assert out.count() == 3 * n and out.where("rank is not null").count() == 2 * n and out.where("rank = 1").select("agent_id").distinct().count() == n
    shares = {x.id: x.n / n for x in out.where("rank = 1").groupBy("id").agg(F.count("*").alias("n")).collect()}
    for x in out.where("agent_id = 0").collect():
        assert abs(shares.get(x.id, 0) - x.probability) < 0.03
    assert out.agg(F.sum("probability")).first()[0] == pytest.approx(n)


def test_capacity(spark):
    states = [(1, 3, 2, 9, 5), (2, 3, 0, 9, 5), (3, 3, 2, 1, 5), (4, 3, 2, 9, 0), (5, 3, -1, 0, 5)]
    rows = [(a, f"p{k}", [0.5, 0.5, 0.5, 0.0, None, 0.9][k]) for a in range(1, 6) for k in range(6)]
    got = frontier.select_actions(spark.createDataFrame(rows, "agent_id long, id string, score double"), spark.createDataFrame([(1, "p5")], "agent_id long, id string"), spark.createDataFrame(states, "agent_id long, max_actions int, slots int, fetches int, tokens int"), 4).collect()
    assert {a: sum(x.selected for x in got if x.agent_id == a) for a in range(1, 6)} == {1: 2, 2: 3, 3: 1, 4: 0, 5: 0}
    assert {x.reason for x in got if x.id == "p3"} == {"non_positive_score"} and [x.reason for x in got if (x.agent_id, x.id) == (1, "p5")] == ["already_visited"]
    assert all(x.id == "p5" for x in got if x.rank == 1 and x.agent_id > 1)
    order = [[x.id for x in sorted((x for x in got if x.agent_id == a and x.rank), key=lambda x: x.rank)] for a in (1, 2)]
    assert order[0][:2] == order[1][1:3]  # one seed, one order among equals


@pytest.mark.parametrize("reason", ["all_agents_exhausted", "budget_exhausted", "time_budget", "quality_plateau", "pheromone_converged", None])
def test_each_stop_reason(spark, reason):
    kinds = "wave long, agent_id long, q double, budget long"
    grow = [(w, a, 0.1 * w + 0.01 * a, 5) for w in range(1, 5) for a in range(3)]
    q = [(w, a, v if reason != "quality_plateau" else 0.4, 0 if reason == "all_agents_exhausted" and w == 3 else b) for w, a, v, b in grow]
    spent = [(w, 10 * w if reason == "budget_exhausted" else w, 10.0 * w if reason == "time_budget" else 1.0) for w in range(1, 5)]
    narrow = [(w, 9.0 if reason == "pheromone_converged" and w == 3 else 1.0) for w in range(1, 5)]
    limits = waves.Limits(fetches=30, seconds=30, plateau_waves=2, plateau_least=0.05, theta=5.0)
    got = sorted(waves.decide(spark.createDataFrame(q, kinds), spark.createDataFrame(spent, "wave long, fetches long, elapsed double"), spark.createDataFrame(narrow, "wave long, concentration double"), limits).collect())
    assert [x.wave for x in got] == list(range(1, 4 if reason else 5)) and got[-1].stop_reason == reason and all(x.stop_reason is None for x in got[:-1])
    if reason != "quality_plateau":
        assert (got[0].leader, got[0].ranking, got[1].q_delta) == (2, "2,1,0", pytest.approx(0.1))


def test_untouched_trails_are_not_rewritten(spark):
    base = spark.createDataFrame([(1, "s", f"d{k}", "ref", 0.5 + k, 0) for k in range(6)], "agent_id long, src string, dst string, mode string, tau double, at long")
    walked = spark.createDataFrame([(1, "s", "d1", "ref", 0.2), (1, "s", "new", "ref", 0.2)], "agent_id long, src string, dst string, mode string, deposit double")
    trails = waves.Trails(base).walk(walked.limit(1), 1).walk(walked, 2)
    assert [d.count() for d in trails.deltas] == [1, 2]
    got = {x.dst: x.tau for x in trails.current(3).collect()}
    assert got["d0"] == pytest.approx(0.5 * 0.9**3) and got["d1"] == pytest.approx((((1.5 * 0.9 + 0.2) * 0.9) + 0.2) * 0.9) and got["new"] == pytest.approx(1.2 * 0.9)
    assert {x.dst: x.tau for x in trails.compacted().current(3).collect()} == got
    assert {x.tau for x in waves.Trails(base).current(200).collect()} == {0.01}
