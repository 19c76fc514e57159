"""Queries of the state machines of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import machines as mc
from lodestrata.plans.registry import query
from lodestrata.plans.runs import _LEGACY

c = F.col


def _said(machine: str, node: str, table: dict[str, str], more: str = "") -> str:
    """One machine's facts in SQL; more: cases that come first."""
    cases = " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in table.items())
    return f"SELECT run_id, '{machine}' AS machine, {node} AS node, seq, CASE {more} {cases} END AS status FROM e"


_HERE = "wave || ':' || agent_id || ':' || turn"
_PAPER = "wave || ':' || coalesce(agent_id, '-') || ':' || turn || ':' || coalesce(paper, '')"
_FACTS = " UNION ALL ".join([
    _said("run", "''", mc.RUN, "WHEN kind = 'run_completed' AND told IN ('cancelled', 'failed') THEN told WHEN kind = 'wave_phase_started' THEN CASE phase WHEN 'evaluation' THEN 'evaluating' ELSE 'running' END WHEN kind = 'status' AND told IN ('running', 'evaluating', 'completed', 'cancelled', 'failed', 'converged', 'exhausted') THEN told"),
    _said("wave", "wave", mc.WAVE),
    _said("phase", "wave || ':' || phase", mc.PHASE),
    _said("phase", "wave || ':research'", {"wave_started": "active"}),
    _said("agent", "agent_id", mc.AGENT, "WHEN kind = 'agent_turn_completed' THEN CASE WHEN budget <= 0 THEN 'exhausted' ELSE 'waiting' END WHEN kind = 'evaluation_settled' THEN CASE told WHEN 'failed' THEN 'failed' ELSE 'waiting' END"),
    _said("turn", _HERE, mc.TURN),
    _said("evaluation", _HERE, mc.EVALUATION, "WHEN kind = 'evaluation_settled' THEN CASE WHEN told IN ('failed', 'skipped') THEN told ELSE 'completed' END"),
    *(_said(name, _PAPER, table) for name, table in mc.STEPS.items()),
    *(_said("exam", f"'{name}'", table) for name, table in mc.EXAM.items()),
])
_WARNED = "SELECT run_id, 'warning' AS machine, seq::VARCHAR AS node, seq, CASE WHEN kind = 'provider_failure' THEN CASE WHEN j IS NOT NULL THEN 'token=*** ' || (event_id % 9) ELSE type END ELSE 'projection_error type=' || type END AS status FROM e WHERE kind = 'provider_failure' OR (payload IS NOT NULL AND j IS NULL AND (run_id, seq) IN (SELECT run_id, seq FROM s))"
_NODES = f"""SELECT run_id, machine, node, coalesce(min(seq) FILTER (ended), max(seq)) AS seq, coalesce(arg_min(status, seq) FILTER (ended), arg_max(status, seq)) AS status FROM (
  WITH r AS (SELECT *, {_LEGACY} AS kind, TRY_CAST(payload AS JSON) AS j FROM {{log_events}}),
  e AS (SELECT *, coalesce(j ->> '$.oleada', '-') AS wave, coalesce(j ->> '$.turn', '-') AS turn, coalesce(j ->> '$.phase', 'research') AS phase, j ->> '$.status' AS told, TRY_CAST(j ->> '$.budget' AS INT) AS budget, j ->> '$.paper_id' AS paper FROM r),
  s AS (SELECT * FROM ({_FACTS}) x WHERE node IS NOT NULL AND status IS NOT NULL)
  SELECT *, machine = 'run' AND status IN ('completed', 'cancelled', 'failed', 'interrupted') AS ended FROM (SELECT * FROM s UNION ALL {_WARNED}) y) z GROUP BY run_id, machine, node"""


@query("stm_nodes", _NODES)
def stm_nodes(t):
    events = t.log_events
    return mc.fold(mc.facts(events.unionByName(events.where("seq % 2 = 0"))))  # repeats change nothing


@query("stm_settled_nodes", f"""SELECT run_id, machine, node, seq, CASE WHEN machine = 'agent' AND status <> 'failed' AND run IN ('completed', 'cancelled', 'failed', 'interrupted') THEN 'completed'
  WHEN machine = 'wave' AND status = 'active' AND (coalesce(run, '') = 'completed' OR TRY_CAST(node AS INT) < last) THEN 'completed' ELSE status END AS status
  FROM (SELECT *, max(CASE WHEN machine = 'run' THEN status END) OVER w AS run, max(CASE WHEN machine = 'wave' THEN TRY_CAST(node AS INT) END) OVER w AS last FROM ({_NODES}) n WINDOW w AS (PARTITION BY run_id)) m""")
def stm_settled_nodes(t):
    return mc.settled(mc.fold(mc.facts(t.log_events)))


@query("stm_run_ends", f"SELECT status, count(*) AS runs FROM ({_NODES}) n WHERE machine = 'run' GROUP BY status")
def stm_run_ends(t):
    return mc.fold(mc.facts(t.log_events).where("machine = 'run'")).groupBy("status").agg(F.count("*").alias("runs"))


@query("stm_warnings", f"SELECT run_id, seq, status AS message FROM ({_NODES}) n WHERE machine = 'warning'")
def stm_warnings(t):
    return mc.facts(t.log_events).where("machine = 'warning'").select("run_id", "seq", c("status").alias("message"))
