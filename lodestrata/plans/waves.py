"""Queries of whole turns and waves of a colony."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import frontier as fr
from lodestrata.operators import waves as wv
from lodestrata.plans.graph import ETA, FRONTIER, eta_table
from lodestrata.plans.registry import query
from lodestrata.plans.views import spark_sql

c = F.col
_SEEDED = "((('0x' || substr(md5({}), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE)"

_STATES = "SELECT agent_id, agent_id % 4 + 1 AS max_actions, agent_id % 3 AS slots, agent_id % 6 AS fetches, CASE WHEN agent_id % 9 = 8 THEN 0 ELSE 100 END AS tokens FROM {agents}"


@query("top_select_actions", f"""SELECT agent_id, id, reason, CASE WHEN reason = 'eligible' AND place <= capacity THEN place END AS rank, reason = 'eligible' AND place <= capacity AS selected FROM
  (SELECT *, row_number() OVER (PARTITION BY agent_id, reason = 'eligible' ORDER BY round(score, 9) DESC, {_SEEDED.format("'11:' || id")}, id) AS place FROM
  (SELECT f.agent_id, f.id, f.score, CASE WHEN v.id IS NOT NULL THEN 'already_visited' WHEN coalesce(f.score, 0) <= 0 THEN 'non_positive_score' ELSE 'eligible' END AS reason, CASE WHEN tokens > 0 THEN least(max_actions, CASE WHEN slots > 0 THEN slots ELSE max_actions END, fetches) ELSE 0 END AS capacity
  FROM ({FRONTIER.replace("% 101 / 100", "% 11 / 10")}) f JOIN ({_STATES}) s ON s.agent_id = f.agent_id LEFT JOIN (SELECT DISTINCT agent_id, id FROM {{read_papers}}) v ON v.agent_id = f.agent_id AND v.id = f.id) x) y""")
def top_select_actions(t):
    """Many candidates share a score, so that the seeded ranks decide."""
    rows = spark_sql(t.spark, t.sf_dir, FRONTIER.replace("% 101 / 100", "% 11 / 10")).select("agent_id", "id", "score")
    return fr.select_actions(rows, t.read_papers, spark_sql(t.spark, t.sf_dir, _STATES), 11).select("agent_id", "id", "reason", "rank", "selected")


_CANDIDATES = "SELECT a.agent_id, p.id, concat('o:', CAST(p_partkey % 100 AS STRING)) AS src, CASE WHEN p_partkey % 2 = 0 THEN 'ref' ELSE 'cites' END AS mode FROM {papers} p JOIN {agents} a ON p.p_partkey % 13 = a.agent_id % 13"
_DIRECTION = "CASE WHEN f.mode = 'ref' THEN CASE caste WHEN 'fundaciones' THEN 0.75 WHEN 'impacto' THEN 0.25 ELSE 0.5 END ELSE CASE caste WHEN 'fundaciones' THEN 0.25 WHEN 'impacto' THEN 0.75 ELSE 0.5 END END"
_SCORED = f"""SELECT *, pow(tau, 1.5) * pow(eta, 2) * direction AS weight, {_SEEDED.format("'7:explore:3:' || agent_id")} < 0.2 AS explored FROM
  (SELECT f.agent_id, f.src, f.id, f.mode, caste, {_DIRECTION}::DOUBLE AS direction, coalesce(tau, 1.0) AS tau, coalesce(eta, 0.0) AS eta FROM ({_CANDIDATES}) f LEFT JOIN (SELECT agent_id, src, dst AS id, mode, tau FROM {{pheromone}}) p USING (agent_id, src, id, mode)
  LEFT JOIN (SELECT id, 1 / (1 + exp(-(0.4 * sim + 0.3 * citations + 0.2 * recency + 0.1 * confidence))) AS eta FROM ({ETA}) s) e USING (id) JOIN {{agents}} a ON a.agent_id = f.agent_id) x"""


@query("job_score_frontier", f"""SELECT agent_id, src, id, mode, caste, direction, tau, round(eta, 6) AS eta, round(weight, 5) AS weight, round(weight / sum(weight) OVER (PARTITION BY agent_id), 7) AS probability, explored, CASE WHEN place <= 4 THEN place END AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY -ln({_SEEDED.format("'7:3:' || agent_id || ':' || src || ':' || id || ':' || mode")}) / CASE WHEN explored THEN 1.0 ELSE greatest(weight, 1e-12) END, id, src, mode) AS place FROM ({_SCORED}) y) z""")
def job_score_frontier(t):
    rows = fr.score_frontier(spark_sql(t.spark, t.sf_dir, _CANDIDATES), t.pheromone, eta_table(t), t.agents, k=4, seed=7, turn=3, epsilon=0.2)
    return rows.withColumns({"eta": F.round("eta", 6), "weight": F.round("weight", 5), "probability": F.round("probability", 7)})


_WALKED = "SELECT l_orderkey % 3 + 1 AS wave, agent_id, src, dst, mode, 0.3 + (l_orderkey % 5) / 10 AS deposit FROM {paths}"
_QUALITY = "SELECT w.wave, agent_id, (agent_id * 7 + w.wave * w.wave * 3) % 20 / 20 AS q, CASE WHEN w.wave < 3 THEN budget ELSE budget % 2 END AS budget FROM {agents} CROSS JOIN (SELECT r_regionkey + 1 AS wave FROM {region} WHERE r_regionkey < 3) w"
_ELAPSED = "SELECT r_regionkey + 1 AS wave, (r_regionkey + 1) * 40.0 AS elapsed FROM {region} WHERE r_regionkey < 3"
_LIMITS = wv.Limits(fetches=10**9, seconds=1000, plateau_waves=2, plateau_least=0.001, theta=100.0)
_TRAILS = "WITH d AS MATERIALIZED (SELECT wave, agent_id, src, dst, mode, sum(deposit) AS deposit FROM (" + _WALKED + ") x GROUP BY ALL), t0 AS (SELECT * FROM {pheromone})" + "".join(
    f", t{k} AS MATERIALIZED (SELECT agent_id, src, dst, mode, greatest(0.01, least(10.0, CASE WHEN tau IS NULL THEN 1.0 ELSE greatest(0.01, 0.9 * tau) END + coalesce(deposit, 0))) AS tau FROM t{k - 1} FULL JOIN (SELECT * FROM d WHERE wave = {k}) e USING (agent_id, src, dst, mode))" for k in (1, 2, 3)
)
_NARROW = " UNION ALL ".join(f"SELECT {k} AS wave, max(c) AS concentration FROM (SELECT max(tau) / avg(tau) AS c FROM t{k} GROUP BY agent_id) x" for k in (1, 2, 3))


def _waves(t, limits=_LIMITS):
    base = t.pheromone.withColumn("at", F.lit(0).cast("long"))
    walked = spark_sql(t.spark, t.sf_dir, _WALKED)
    return wv.run_waves(wv.Trails(base), walked, spark_sql(t.spark, t.sf_dir, _QUALITY), spark_sql(t.spark, t.sf_dir, _ELAPSED), 3, limits)


@query("job_wave_trails", f"SELECT agent_id, src, dst, mode, round(tau, 6)::DOUBLE AS tau FROM ({_TRAILS} SELECT * FROM t3) x")
def job_wave_trails(t):
    return _waves(t)[1].current(3).withColumn("tau", F.round("tau", 6))


def _decided(where: str, reason: str) -> str:
    return f"""SELECT wave, leader, round(q_delta, 6) AS q_delta, best_q, ranking, fetches, round(concentration, 5) AS concentration, stop_reason FROM (
  {_TRAILS}, n AS ({_NARROW}), q AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY agent_id ORDER BY wave), 0) AS delta, row_number() OVER (PARTITION BY wave ORDER BY q DESC, agent_id) AS r FROM ({_QUALITY}) x),
  f AS (SELECT wave, sum(count(*)) OVER (ORDER BY wave)::BIGINT AS fetches FROM ({_WALKED}) x GROUP BY wave),
  w AS (SELECT q.wave, arg_min(agent_id, r) AS leader, arg_min(delta, r) AS q_delta, max(max(q)) OVER (ORDER BY q.wave) AS best_q, array_to_string(list(agent_id ORDER BY r) FILTER (r <= 5), ',') AS ranking, any_value(fetches) AS fetches, any_value(concentration) AS concentration, max(budget) AS most, q.wave * 40 AS elapsed
    FROM q JOIN f ON f.wave = q.wave JOIN n ON n.wave = q.wave GROUP BY q.wave)
  SELECT *, {reason} AS stop_reason FROM w) y {where}"""


@query("job_waves", _decided("", "CASE WHEN most <= 0 THEN 'all_agents_exhausted' WHEN wave = 3 AND best_q - (SELECT best_q FROM w v WHERE v.wave = 1) < 0.001 THEN 'quality_plateau' WHEN concentration > 100 THEN 'pheromone_converged' END"))
def job_waves(t):
    return _waves(t)[0].withColumns({"q_delta": F.round("q_delta", 6), "concentration": F.round("concentration", 5)})


@query("job_waves_stopped", _decided("WHERE wave <= 2", "CASE WHEN elapsed >= 80 THEN 'time_budget' END"))
def job_waves_stopped(t):
    """The same with less time: the second wave is the last."""
    limits = wv.Limits(fetches=10**9, seconds=80, plateau_waves=2, plateau_least=0.001, theta=100.0)
    return _waves(t, limits)[0].withColumns({"q_delta": F.round("q_delta", 6), "concentration": F.round("concentration", 5)})


@query("agg_colony_concentration", "SELECT round(max(c), 6) AS concentration FROM (SELECT max(tau) / avg(tau) AS c FROM {pheromone} GROUP BY agent_id) x")
def agg_colony_concentration(t):
    return wv.concentration(t.pheromone).select(F.round("concentration", 6).alias("concentration"))
