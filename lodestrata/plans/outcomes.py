"""Queries of waves, outcomes, reports and models' records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import outcomes as oc
from lodestrata.plans.registry import query

c = F.col
_PARTS = "SELECT c_custkey AS run_id, c_nationkey AS wave, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 11) / 10 END AS s, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 13) / 12 END AS p, (c_custkey % 7) / 6 AS r FROM {customer}"


@query("flt_component_states", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 11) / 10 END AS s, CASE WHEN c_custkey % 4 NOT IN (0, 1) THEN (c_custkey % 13) / 12 END AS p, concat_ws(',', CASE WHEN c_custkey % 4 IN (0, 1) THEN 'p:' || CASE WHEN c_custkey % 2 = 0 THEN 'no_peers' ELSE 'model_failed' END END, CASE WHEN c_custkey % 3 = 0 THEN 's:model_failed' END) AS reasons FROM {customer}")
def flt_component_states(t):
    k = c("c_custkey")
    none = F.lit(None).cast("string")
    rows = t.customer.select("c_custkey", F.when(k % 3 != 0, (k % 11) / 10).alias("s"), F.lit(True).alias("s_ok"), none.alias("s_reason"), ((k % 13) / 12).alias("p"), (k % 4 > 1).alias("p_ok"), F.when(k % 2 == 0, "no_peers").alias("p_reason"))
    return oc.component_states(rows, ("s", "p")).select("c_custkey", "s", "p", "reasons")


@query("agg_peer_reasons", "SELECT o_custkey AS subject, count(vote) AS votes, CASE WHEN count(vote) = 0 THEN CASE WHEN count(DISTINCT reason) = 1 THEN max(reason) ELSE 'model_failed' END END AS reason FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 END AS vote, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'parse_failed' END END AS reason FROM {orders}) x GROUP BY o_custkey")
def agg_peer_reasons(t):
    k = c("o_orderkey")
    return oc.peer_reasons(t.orders.select(c("o_custkey").alias("subject"), F.when(k % 5 == 0, 0.5).alias("vote"), F.when(k % 5 != 0, F.when(k % 2 == 0, "timeout").otherwise("parse_failed")).alias("reason")))


_Q = "greatest(0, least(1, 0.3 * coalesce(s, 0) + 0.3 * coalesce(p, 0) + 0.4 * coalesce(r, 0)))"


@query("agg_committee", f"SELECT run_id, wave, round(q, 6)::DOUBLE AS q, round(q - coalesce(lag(q) OVER (PARTITION BY run_id ORDER BY wave), 0), 6)::DOUBLE + 0.0 AS delta, unavailable FROM (SELECT run_id, wave, {_Q} AS q, CASE WHEN p IS NULL OR s IS NULL THEN 'unavailable:' || concat_ws(',', CASE WHEN p IS NULL THEN 'p' END, CASE WHEN s IS NULL THEN 's' END) ELSE '' END AS unavailable FROM (SELECT c_nationkey AS run_id, c_custkey AS wave, s, p, r FROM {{customer}} JOIN ({_PARTS}) x ON run_id = c_custkey) y) z")
def agg_committee(t):
    k = c("c_custkey")
    rows = t.customer.select(c("c_nationkey").alias("run_id"), k.alias("wave"), F.when(k % 3 != 0, (k % 11) / 10).alias("s"), F.when(k % 4 != 0, (k % 13) / 12).alias("p"), ((k % 7) / 6).alias("r"))
    return oc.committee(rows, {"s": 0.3, "p": 0.3, "r": 0.4}).withColumns({"q": F.round("q", 6), "delta": F.round("delta", 6) + 0.0})


_EV = "SELECT c_nationkey AS run_id, c_custkey % 5 AS wave, c_custkey AS agent_id, (c_custkey % 101) / 100 AS q, (c_custkey % 17) / 100 AS delta FROM {customer}"
_TRAIL = "SELECT s_nationkey AS run_id, s_suppkey AS agent_id, 0.01 + (s_suppkey % 9) AS tau FROM {supplier}"


@query("job_wave_decision", f"""SELECT l.run_id, l.wave, leader, round(max(q) OVER (PARTITION BY l.run_id ORDER BY l.wave), 4) AS best_q, round(delta, 4) AS q_delta, round(coalesce(concentration, 0), 4) AS concentration, CASE WHEN l.wave = 4 THEN 'all_agents_exhausted' WHEN l.wave * 150 >= 300 THEN 'budget_exhausted' ELSE '' END AS stop_reason, CASE WHEN l.wave < 2 THEN 'budget_remaining' ELSE '' END AS continue_reason
  FROM (SELECT run_id, wave, arg_max(agent_id, (q, -agent_id)) AS leader, arg_max(delta, (q, -agent_id)) AS delta, max(q) AS q FROM ({_EV}) e GROUP BY 1, 2) l LEFT JOIN (SELECT run_id, max(tau) / avg(tau) AS concentration FROM ({_TRAIL}) p GROUP BY 1) p ON p.run_id = l.run_id""")
def job_wave_decision(t):
    from lodestrata.plans.views import spark_sql

    evals = spark_sql(t.spark, t.sf_dir, _EV)
    waves = evals.select("run_id", "wave").distinct()
    sizes = waves.where("wave <> 4").withColumn("candidates", F.lit(3))
    return oc.wave_decision(evals, sizes, spark_sql(t.spark, t.sf_dir, _TRAIL), waves.withColumn("fetches", c("wave") * 150), 300)


_DISC = "SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN 'boom' END AS error, (o_orderkey % 16 = 1)::INT AS traversable, (o_orderkey % 4 = 1)::INT AS found, o_orderkey % 6 = 2 AS extraction_failed, o_orderkey % 10 = 3 AS mapping_incomplete FROM {orders}"


@query("job_discovery_reason", f"SELECT run_id, CASE WHEN coalesce(sum(traversable) FILTER (error IS NULL), 0) > 0 THEN '' WHEN count(error) > 0 THEN 'seed_discovery_failed' WHEN coalesce(sum(found) FILTER (error IS NULL), 0) > 0 THEN 'no_traversable_identifiers' WHEN bool_or(extraction_failed) THEN 'reference_extraction_failed' WHEN bool_or(mapping_incomplete) THEN 'reference_mapping_incomplete' ELSE 'no_neighbors_discovered' END AS reason FROM ({_DISC}) d GROUP BY run_id")
def job_discovery_reason(t):
    from lodestrata.plans.views import spark_sql

    return oc.discovery_reason(spark_sql(t.spark, t.sf_dir, _DISC.replace("::INT AS traversable", "::int AS traversable")))


@query("job_outcome_gap", "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 7 = 0 THEN 'empty_winner_narrative' WHEN coalesce(e, 0) = 0 THEN 'no_evaluated_evidence' WHEN coalesce(w, 0) = 0 THEN 'winner_evaluation_missing' ELSE '' END AS gap FROM {customer} LEFT JOIN (SELECT o_custkey, max((o_orderkey % 5 > 1)::INT) AS e, max((o_orderkey % 3 = o_custkey % 3)::INT) AS w FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1) x ON o_custkey = c_custkey")
def job_outcome_gap(t):
    k = c("c_custkey")
    done = t.customer.select(k.alias("run_id"), (k % 3).alias("winner"), F.when(k % 7 != 0, "told").alias("narrative"))
    evals = t.orders.select(c("o_custkey").alias("run_id"), (c("o_orderkey") % 3).alias("agent_id"), F.when(c("o_orderstatus") == "F", "complete").otherwise("open").alias("status"), F.greatest(F.lit(0), c("o_orderkey") % 5 - 1).alias("new_papers"))
    return oc.outcome_gap(done, evals)


@query("job_terminal_reason", "SELECT c_custkey AS run_id, CASE WHEN coalesce(ok, 0) = 1 THEN 'evidence_sufficient' WHEN coalesce(l, 0) = 1 THEN 'no_eligible_actions' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'provider_failure' ELSE 'frontier_exhausted' END AS reason FROM {customer} LEFT JOIN (SELECT o_custkey, max((o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0)::INT) AS ok, max((o_orderkey % 7 = 0)::INT) AS l FROM {orders} GROUP BY 1) x ON o_custkey = c_custkey")
def job_terminal_reason(t):
    k, o = c("c_custkey"), c("o_orderkey")
    rows = t.orders.select(c("o_custkey").alias("run_id"), o.alias("claim_id"), F.when(o % 4 == 1, "supported").otherwise("proposed").alias("status"), F.array(o, -o).alias("papers"))
    held = t.orders.select(c("o_custkey").alias("run_id"), F.explode(F.when(o % 3 != 0, F.array(o, -o)).otherwise(F.array(o))).alias("paper_id"))
    return oc.terminal_reason(t.customer.select(k.alias("run_id"), (k % 2 != 0).alias("had_success"), (k % 3 == 0).alias("had_transient")), rows, held, t.orders.select(c("o_custkey").alias("run_id"), (o % 7 != 0).alias("visited")))


@query("agg_batch_summary", "SELECT CASE WHEN o_orderkey IS NULL THEN 'pending' ELSE o_orderstatus END AS status, count(*) AS n FROM (SELECT unnest(range(0, 2000)) AS k) m LEFT JOIN {orders} ON o_orderkey = k GROUP BY 1")
def agg_batch_summary(t):
    return oc.batch_summary(t.spark.range(2000).select(c("id").alias("task_id")), t.orders.select(c("o_orderkey").alias("task_id"), c("o_orderstatus").alias("status")))


@query("mth_budget_state", "SELECT run_id, greatest(0, 3 - n) AS turns_left, n >= 3 AS turns_out, greatest(0, 5000 - tokens)::BIGINT AS tokens_left, tokens >= 5000 AS tokens_out FROM (SELECT run_id, count(*) AS n, sum(event_id % 1000)::BIGINT AS tokens FROM {run_events} GROUP BY run_id) x")
def mth_budget_state(t):
    used = t.run_events.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(c("event_id") % 1000).alias("tokens"))
    turns, tokens = oc.budget_state(c("n"), F.lit(3)), oc.budget_state(c("tokens"), F.lit(5000))
    return used.select("run_id", turns["remaining"].alias("turns_left"), turns["exhausted"].alias("turns_out"), tokens["remaining"].alias("tokens_left"), tokens["exhausted"].alias("tokens_out"))


@query("agg_visitors", "SELECT node, string_agg(agent_id::VARCHAR, ',' ORDER BY agent_id) AS visitors, count(*) AS n FROM (SELECT DISTINCT node, agent_id FROM {visits_mixed}) x GROUP BY node")
def agg_visitors(t):
    return oc.visitors(t.visits_mixed)


@query("win_wave_ranking", f"SELECT run_id, wave, agent_id, q, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, wave ORDER BY q DESC, agent_id) AS rank FROM ({_EV}) e) x WHERE rank <= 3")
def win_wave_ranking(t):
    from lodestrata.plans.views import spark_sql

    return oc.wave_ranking(spark_sql(t.spark, t.sf_dir, _EV))


_ARMS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'new' END AS arm, o_orderkey // 2 AS task, (o_custkey % 101) / 100 AS quality, o_custkey * 10 AS tokens, o_custkey % 20 AS fetches FROM {orders}"


@query("agg_arm_differences", f"SELECT count(*) AS pairs, round(avg(g), 6) AS mean, round(median(g), 6)::DOUBLE AS median, round(1000 * sum(g) / sum(tokens), 6) AS per_1000_tokens, round(sum(g) / sum(fetches), 6) AS per_fetch FROM (SELECT b.quality - a.quality AS g, b.tokens, b.fetches FROM ({_ARMS}) a JOIN ({_ARMS}) b ON b.task = a.task AND a.arm = 'base' AND b.arm = 'new') x")
def agg_arm_differences(t):
    k = c("o_orderkey")
    rows = t.orders.select(F.when(k % 2 == 0, "base").otherwise("new").alias("arm"), F.floor(k / 2).alias("task"), ((c("o_custkey") % 101) / 100).alias("quality"), (c("o_custkey") * 10).alias("tokens"), (c("o_custkey") % 20).alias("fetches"))
    out = oc.arm_differences(rows, "base", "new")
    return out.select("pairs", *[F.round(x, 6).alias(x) for x in ("mean", "median", "per_1000_tokens", "per_fetch")])


@query("src_evaluations", "SELECT c_custkey AS run_id, 'agent-' || (c_custkey % 5) AS agent_id, c_nationkey AS wave, (c_custkey % 101) / 100 AS q, 0.25::DOUBLE AS delta_q, CASE WHEN c_custkey % 3 <> 0 THEN 0.5 END::DOUBLE AS s, 0.75::DOUBLE AS p, NULL::DOUBLE AS j, 0.125::DOUBLE AS r FROM {customer} WHERE c_custkey % 7 > 1")
def src_evaluations(t):
    k = c("c_custkey")
    record = F.to_json(F.struct(F.when(k % 7 != 1, k).alias("run_id"), F.concat(F.lit("agent-"), (k % 5).cast("string")).alias("agent_id"), c("c_nationkey").alias("oleada"), ((k % 101) / 100).alias("q"), F.lit(0.25).alias("delta_q"), F.struct(F.when(k % 3 != 0, 0.5).alias("score")).alias("self_assessment"), F.struct(F.lit(0.75).alias("aggregated_score")).alias("peers"), F.struct(F.lit(0.125).alias("r")).alias("structural")))
    return oc.read_evaluations(t.customer.select(F.when(k % 7 == 0, "{broken").otherwise(record).alias("value")))


@query("src_rubric", "SELECT c_custkey AS run_id, m = 0 AS ok, CASE m WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'score:novelty' WHEN 3 THEN 'list:risks' WHEN 4 THEN 'missing_verdict' END AS reason, CASE WHEN m = 0 THEN 1.0 END::DOUBLE AS grounding, CASE WHEN m = 0 THEN 0.5 END::DOUBLE AS coverage FROM (SELECT c_custkey, c_custkey % 5 AS m FROM {customer}) x")
def src_rubric(t):
    k = c("c_custkey") % 5
    scores = F.concat(F.lit('"scores": {"grounding": 1.5, "coverage": 0.5, "coherence": 1, "novelty": '), F.when(k == 2, "true").otherwise("0.25"), F.lit("}, "))
    lists = F.concat(F.lit('"strengths": ["a"], "weaknesses": [], "missing": ["b", "c"], "risks": '), F.when(k == 3, '"none"').otherwise("[]"), F.lit(", "))
    verdict = F.concat(F.lit('"verdicts": {"1": "supported", "2": "'), F.when(k == 4, "maybe").otherwise("unclear"), F.lit('"}'))
    raw = t.customer.select(c("c_custkey").alias("run_id"), F.when(k == 1, "{").otherwise(F.concat(F.lit("{"), scores, lists, verdict, F.lit("}"))).alias("answer"))
    claims = t.customer.select(c("c_custkey").alias("run_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("claim_id"))
    return oc.validate_rubric(raw, claims).select("run_id", "ok", "reason", "grounding", "coverage")


@query("src_ingest_items", "SELECT item_id AS doc_id, 'q1' AS item_id, text AS question, 'medium' AS difficulty FROM {benchmark} UNION ALL SELECT item_id, 'q' || CASE WHEN item_id % 2 = 0 THEN 'z' ELSE '' END || '7', 'why', 'hard' FROM {benchmark}")
def src_ingest_items(t):
    own = F.to_json(F.struct(c("text").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("options")))
    other = F.concat(F.lit('{"id": "'), F.when(c("item_id") % 2 == 0, "z7").otherwise("q7"), F.lit('", "question": " why ", "difficulty": "hard", "options": ["x"]}'))
    answer = F.concat(F.lit('{"items": ['), own, F.lit(', 5, "text", {"question": "no options"}, '), other, F.lit("]}"))
    return oc.ingest_items(t.benchmark.select(c("item_id").alias("doc_id"), answer.alias("answer"))).drop("options")
