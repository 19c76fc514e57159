"""Queries of run logs and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import runs as rn
from lodestrata.operators.machines import RUN
from lodestrata.plans.registry import query

c = F.col
_LEGACY = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rn.LEGACY.items()) + " ELSE type END"


@query("src_run_events", "SELECT run_id, seq, type, coalesce(TRY_CAST(payload AS JSON)::VARCHAR, '{{}}') AS payload FROM {run_events}".replace("{{}}", "{ }").replace("'{ }'", "chr(123) || chr(125)"))
def src_run_events(t):
    return t.run_events.select("run_id", "seq", "type", F.when(F.try_parse_json("payload").isNotNull(), c("payload")).otherwise("{}").alias("payload"))


@query("stm_canonical_type", f"SELECT run_id, seq, {_LEGACY} AS type FROM {{run_events}}")
def stm_canonical_type(t):
    return t.run_events.select("run_id", "seq", rn.canonical_type(c("type")).alias("type"))


@query("snk_append_events", "SELECT run_id, seq, type, concat('token=***', chr(59), ' x') AS payload FROM (SELECT run_id, type, event_id, coalesce((SELECT max(seq) FROM {run_events} r WHERE r.run_id = e.run_id AND r.seq <= 2), 0) + row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS seq FROM {run_events} e WHERE seq > 2) x")
def snk_append_events(t):
    new = t.run_events.where("seq > 2").withColumn("payload", F.concat(F.lit("token="), "type", F.lit("; x")))
    return rn.append_events(t.run_events.where("seq <= 2"), new, "event_id")


@query("win_fill_agent", "SELECT run_id, seq, last_value(agent_id IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS agent FROM {run_events}")
def win_fill_agent(t):
    return rn.fill_agent(t.run_events).select("run_id", "seq", "agent")


@query("win_retained", "SELECT run_id, seq, seen, greatest(0, seen - 3)::BIGINT AS dropped FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY run_id) AS seen FROM {run_events}) x WHERE r <= 3")
def win_retained(t):
    return rn.retained_window(t.run_events, 3).select("run_id", "seq", "seen", "dropped")


@query("win_verify_chain", "SELECT run_id, count(*) AS events, count(*) FILTER (event_id % 10 = 0) AS broken, count(*) FILTER (seq <> coalesce(before, 0) + 1) AS gaps FROM (SELECT run_id, seq, event_id, lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM {run_events} WHERE event_id % 6 <> 1) x GROUP BY run_id")
def win_verify_chain(t):
    from pyspark.sql import Window

    state = t.run_events.where("event_id % 6 <> 1").withColumns({"state": c("event_id").cast("string"), "h": F.sha2(c("event_id").cast("string").cast("binary"), 256)})
    before = F.lag("h").over(Window.partitionBy("run_id").orderBy("seq"))
    rows = state.select("run_id", "seq", "state", c("h").alias("state_hash"), F.when(c("event_id") % 10 == 0, "wrong").otherwise(before).alias("prev_hash"))
    return rn.verify_chain(rows)


@query("join_state_as_of", "SELECT a.run_id, a.asof, max(s.seq) AS seq, arg_max(s.type, s.seq) AS state FROM (SELECT run_id, seq AS asof FROM {run_events} WHERE seq % 3 = 0) a LEFT JOIN (SELECT run_id, seq, type FROM {run_events} WHERE seq % 2 = 0) s ON s.run_id = a.run_id AND s.seq <= a.asof GROUP BY a.run_id, a.asof")
def join_state_as_of(t):
    states = t.run_events.where("seq % 2 = 0").select("run_id", "seq", c("type").alias("state"))
    return rn.state_as_of(states, t.run_events.where("seq % 3 = 0").select("run_id", c("seq").alias("asof")))


@query("win_delta_q", "SELECT run_id, wave, round(q - lag(q) OVER (PARTITION BY run_id ORDER BY wave), 6) AS delta FROM {evaluations}")
def win_delta_q(t):
    return rn.delta_q(t.evaluations).select("run_id", "wave", F.round("delta", 6).alias("delta"))


@query("win_best_so_far", "SELECT run_id, wave, max(q) OVER (PARTITION BY run_id ORDER BY wave) AS best, coalesce(q > max(q) OVER (PARTITION BY run_id ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM {evaluations}")
def win_best_so_far(t):
    return rn.best_so_far(t.evaluations).select("run_id", "wave", "best", "improved")


_PLATEAU = "SELECT run_id, wave, coalesce(row_number() OVER (PARTITION BY run_id ORDER BY wave) > 2 AND q - lag(q, 1) OVER (PARTITION BY run_id ORDER BY wave) < 0.05, false) AS plateau FROM {evaluations}"


@query("win_plateau", _PLATEAU)
def win_plateau(t):
    return rn.plateau(t.evaluations, 2, 0.05).select("run_id", "wave", "plateau")


@query("win_convergence", f"SELECT run_id, min(wave) AS wave, arg_min(reason, wave) AS reason FROM (SELECT run_id, wave, CASE WHEN wave >= 4 THEN 'budget' WHEN plateau THEN 'quality_plateau' END AS reason FROM ({_PLATEAU}) p) x WHERE reason IS NOT NULL GROUP BY run_id")
def win_convergence(t):
    return rn.convergence(t.evaluations, 2, 0.05, 4)


@query("win_stop_reasons", f"SELECT run_id, min(wave) AS wave, arg_min(reason, wave) AS reason FROM (SELECT run_id, wave, CASE WHEN wave * 90 >= 400 THEN 'budget' WHEN wave * 7 >= 26 THEN 'time_budget' WHEN plateau THEN 'quality_plateau' WHEN q > 0.3 THEN 'pheromone_converged' END AS reason FROM ({_PLATEAU}) p JOIN {{evaluations}} e USING (run_id, wave)) x WHERE reason IS NOT NULL GROUP BY run_id")
def win_stop_reasons(t):
    rows = t.evaluations.withColumns({"fetches": c("wave") * 90, "elapsed": c("wave") * 7, "concentration": c("q")})
    return rn.convergence(rows, 2, 0.05, 400, seconds=26, theta=0.3)


@query("win_latest_eval", "SELECT run_id, max(wave) AS wave, arg_max(q, wave) AS q FROM {evaluations} GROUP BY run_id")
def win_latest_eval(t):
    return rn.latest(t.evaluations, "run_id", "wave", "q")


@query("win_quality_evolution", "SELECT run_id, arg_min(q, wave) AS first, arg_max(q, wave) AS last, max(q) AS best, round(arg_max(q, wave) - arg_min(q, wave), 6) AS gain FROM {evaluations} GROUP BY run_id")
def win_quality_evolution(t):
    return rn.quality_evolution(t.evaluations).withColumn("gain", F.round("gain", 6))


@query("win_agent_labels", "SELECT run_id, agent_id, 'A' || lpad((row_number() OVER (PARTITION BY run_id ORDER BY seq))::VARCHAR, 2, '0') AS label FROM (SELECT run_id, agent_id, min(seq) AS seq FROM {run_events} WHERE agent_id IS NOT NULL GROUP BY 1, 2) x")
def win_agent_labels(t):
    return rn.agent_labels(t.run_events)


_RUN_STATUS = "CASE WHEN kind = 'wave_phase_started' THEN 'running' " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in RUN.items()) + " END"


@query("job_project_runs", f"SELECT run_id, max(seq) AS last_seq, count(*) AS seen, least(count(*), 1000) AS retained, coalesce(arg_min(status, seq) FILTER (status IN ('completed', 'cancelled', 'failed', 'interrupted')), arg_max(status, seq) FILTER (status IS NOT NULL)) AS status, arg_max(agent_id, seq) FILTER (agent_id IS NOT NULL) AS agent_id, count(*) FILTER (kind = 'quality_evaluation_completed') AS evaluations, max(least(1.0, value / 100)) FILTER (kind = 'quality_evaluation_completed') AS best_q FROM (SELECT *, {_RUN_STATUS} AS status FROM (SELECT *, {_LEGACY} AS kind FROM {{log_events}}) e) x GROUP BY run_id")
def job_project_runs(t):
    events = t.log_events
    return rn.project_runs(events.unionByName(events.where("seq % 2 = 0")))  # repeats change nothing


_AGE = "SELECT run_id, date_diff('second', max(ts), (SELECT max(ts) FROM {run_events})) AS age, run_id % 4 = 0 AND run_id % 3 = 0 AS dead FROM {run_events} GROUP BY run_id"


@query("flt_stale_runs", f"SELECT run_id, CASE WHEN dead OR age > 86400 THEN 'interrupted' ELSE 'running' END AS status, CASE WHEN dead THEN 'process_dead' WHEN age > 86400 THEN 'stale_heartbeat' END AS reason FROM ({_AGE}) x")
def flt_stale_runs(t):
    k = c("run_id")
    beats = t.run_events.groupBy("run_id").agg(F.max("ts").alias("heartbeat"), F.lit("running").alias("status")).withColumns({"host": F.when(k % 4 == 0, "here").otherwise("there"), "pid_alive": k % 3 != 0})
    now = F.lit(t.run_events.agg(F.max("ts").cast("timestamp")).first()[0])
    return rn.stale_runs(beats, now, 86400, F.lit("here")).select("run_id", "status", "reason")


@query("agg_list_runs", "SELECT run_id, count(*) AS events, count(*) FILTER (type = 'evaluation_complete') AS evaluations FROM {run_events} GROUP BY run_id")
def agg_list_runs(t):
    return rn.list_runs(t.run_events.select("run_id").distinct(), t.run_events, t.evaluations)


@query("agg_peer_score", "SELECT o_custkey % 25 AS subject, median(vote) AS median, round(sum(vote * weight) / sum(weight), 6) AS weighted FROM (SELECT o_custkey, (o_orderkey % 101) / 100 AS vote, (o_orderkey % 7) / 7 AS weight FROM {orders}) x GROUP BY 1")
def agg_peer_score(t):
    k = c("o_orderkey")
    votes = t.orders.select((c("o_custkey") % 25).alias("subject"), ((k % 101) / 100).alias("vote"), ((k % 7) / 7).alias("weight"))
    return rn.peer_score(votes).withColumn("weighted", F.round("weighted", 6))


@query("agg_quality", "SELECT c_custkey, round(greatest(0, least(1, 0.3 * coalesce(s, 0) + 0.3 * coalesce(p, 0) + 0.4 * coalesce(r, 0))), 6)::DOUBLE AS q, concat_ws(',', CASE WHEN p IS NULL THEN 'p' END, CASE WHEN s IS NULL THEN 's' END) AS unavailable FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 11) / 10 END AS s, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 13) / 12 END AS p, (c_custkey % 7) / 6 AS r FROM {customer}) x")
def agg_quality(t):
    k = c("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 3 != 0, (k % 11) / 10).alias("s"), F.when(k % 4 != 0, (k % 13) / 12).alias("p"), ((k % 7) / 6).alias("r"))
    return rn.quality(rows, {"s": 0.3, "p": 0.3, "r": 0.4}).select("c_custkey", F.round("q", 6).alias("q"), "unavailable")


@query("agg_rollup_status", "SELECT o_custkey, CASE WHEN bool_or(s = 'active') THEN 'active' WHEN bool_and(s IN ('completed', 'failed', 'skipped')) THEN 'completed' WHEN bool_or(s = 'failed') THEN 'failed' ELSE 'pending' END AS status FROM (SELECT o_custkey, CASE o_orderkey % 11 WHEN 0 THEN 'active' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'skipped' ELSE 'completed' END AS s FROM {orders}) x GROUP BY o_custkey")
def agg_rollup_status(t):
    k = c("o_orderkey") % 11
    rows = t.orders.select("o_custkey", F.when(k == 0, "active").when(k == 1, "failed").when(k == 2, "pending").when(k == 3, "skipped").otherwise("completed").alias("status"))
    return rn.rollup_status(rows, ["o_custkey"])


@query("agg_experiment_report", "SELECT c_mktsegment AS arm, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4)::DOUBLE AS median, round(stddev_samp(c_acctbal), 4) AS deviation FROM {customer} GROUP BY 1")
def agg_experiment_report(t):
    rows = rn.experiment_report(t.customer.select(c("c_mktsegment").alias("arm"), c("c_acctbal").cast("double").alias("v")), "arm", "v")
    return rows.select("arm", "n", *[F.round(x, 4).alias(x) for x in ("mean", "median", "deviation")])


@query("agg_usage", "SELECT run_id, sum(CASE WHEN type = 'candidate_selected' THEN value END) AS tokens, count(*) FILTER (type = 'candidate_selected') AS reports FROM {run_events} GROUP BY run_id")
def agg_usage(t):
    hit = c("type") == "candidate_selected"
    return t.run_events.groupBy("run_id").agg(F.sum(F.when(hit, c("value"))).alias("tokens"), F.count_if(hit).alias("reports"))


@query("snk_latest_artifact", "SELECT run_id, type AS kind, arg_max(event_id, (ts, event_id)) AS artifact_id FROM {run_events} GROUP BY run_id, type")
def snk_latest_artifact(t):
    return t.run_events.groupBy("run_id", c("type").alias("kind")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("artifact_id"))


@query("agg_across_run_ci", "SELECT count(*) AS runs, round(avg(u), 6) AS mean, round(avg(u) - 1.96 * stddev_samp(u) / sqrt(count(*)), 6) AS low, round(avg(u) + 1.96 * stddev_samp(u) / sqrt(count(*)), 6) AS high FROM (SELECT run_id, max(q) - min(q) AS u FROM {evaluations} GROUP BY run_id) x")
def agg_across_run_ci(t):
    rows = rn.across_run_ci(t.evaluations.groupBy("run_id").agg((F.max("q") - F.min("q")).alias("uplift")))
    return rows.select("runs", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")])


@query("win_timeline", "SELECT run_id, seq, coalesce(max(CASE WHEN event_id % 7 = 0 THEN seq END) OVER w, max(CASE WHEN event_id % 7 = 1 THEN seq END) OVER w, 0)::BIGINT AS parent FROM {run_events} WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_timeline(t):
    kind = F.when(c("event_id") % 7 == 0, "agent_turn_start").when(c("event_id") % 7 == 1, "oleada_start").otherwise("warning")
    return rn.timeline(t.run_events.withColumn("type", kind))


@query("agg_wave_summary", "SELECT run_id, wave, count(*) AS attempted, count(*) FILTER (event_id % 4 <> 0) AS integrated, count(*) FILTER (event_id % 4 = 0) AS failed, coalesce(array_to_string(list_sort(list(DISTINCT agent_id) FILTER (event_id % 4 = 0)), ','), '') AS failed_agents FROM (SELECT *, seq // 10 AS wave FROM {run_events}) x GROUP BY run_id, wave")
def agg_wave_summary(t):
    return rn.wave_summary(t.run_events.select("run_id", F.floor(c("seq") / 10).cast("long").alias("wave"), "agent_id", (c("event_id") % 4 != 0).alias("ok")))


@query("snk_append_evaluations", "SELECT run_id, wave, q FROM {evaluations}")
def snk_append_evaluations(t):
    rows = t.evaluations.select("run_id", "wave", "q")
    return rn.append_evaluations(rows.where("wave <= 3"), rows.where("wave > 3"))[0]


@query("snk_evaluation_events", "SELECT run_id, wave, 'quality_evaluation_completed' AS type, round(q, 4) AS q FROM {evaluations} WHERE wave > 3")
def snk_evaluation_events(t):
    rows = t.evaluations.select("run_id", "wave", "q")
    events = rn.append_evaluations(rows.where("wave <= 3"), rows.where("wave > 3"))[1]
    return events.select("run_id", "wave", "type", F.get_json_object("payload", "$.q").cast("double").alias("q"))


@query("str_loose_numbers", "SELECT event_id, coalesce(TRY_CAST(substr(event_type || event_id, 6) AS INT), -1) AS i, TRY_CAST(value::VARCHAR AS DOUBLE) AS f FROM {events}")
def str_loose_numbers(t):
    return t.events.select("event_id", rn.loose_int(F.substr(F.concat("event_type", c("event_id").cast("string")), F.lit(6)), -1).alias("i"), rn.loose_float(c("value").cast("string")).alias("f"))


_NEWS = "SELECT run_id, seq, agent_id, CASE event_id % 7 WHEN 0 THEN 'reference_mapping_started' WHEN 1 THEN 'reference_mapping_completed' WHEN 2 THEN 'neighbor_discovery_completed' WHEN 3 THEN 'frontier_reference_evaluation_completed' WHEN 4 THEN 'agent_step' WHEN 5 THEN 'warning' ELSE 'candidate_score' END AS type FROM {run_events}"


@query("stm_timeline", f"""SELECT entry_id, max(seq) AS seq, arg_max(status, seq) AS status FROM (SELECT seq, kind || ':' || run_id || ':' || CASE WHEN kind IN ('warning', 'paper') THEN seq::VARCHAR ELSE coalesce(agent_id, '-') END AS entry_id, status FROM
  (SELECT *, CASE WHEN type LIKE 'reference%' THEN 'mapping' WHEN type LIKE 'neighbor%' THEN 'discovery' WHEN type LIKE 'frontier%' THEN 'frontier' WHEN type = 'agent_step' THEN 'paper' WHEN type = 'warning' THEN 'warning' END AS kind, CASE WHEN type LIKE '%started' THEN 'active' WHEN type = 'warning' THEN 'failed' ELSE 'completed' END AS status FROM ({_NEWS}) n) x WHERE kind IS NOT NULL) y GROUP BY entry_id""")
def stm_timeline(t):
    from lodestrata.plans.views import spark_sql

    return rn.timeline_rows(spark_sql(t.spark, t.sf_dir, _NEWS)).groupBy("entry_id").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"))


_STAGES = ("evidence_pack_frozen", "exam_generated", "exam_validated", "exam_partitioned", "survivor_selected", "benchmark_completed")
_EXAM = "SELECT run_id, seq, value, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_STAGES)) + " ELSE 'warning' END AS type FROM {run_events}"


@query("stm_exam_projection", "SELECT run_id, " + ", ".join(f"arg_max(value, seq) FILTER (type = '{n}') AS {a}" for n, a in zip(_STAGES, ("sources", "items", "sound", "held", "survivor", "uplift"), strict=True)) + f", arg_max(type, seq) AS stage FROM ({_EXAM}) e WHERE type <> 'warning' GROUP BY run_id")
def stm_exam_projection(t):
    from lodestrata.plans.views import spark_sql

    return rn.exam_projection(spark_sql(t.spark, t.sf_dir, _EXAM))


@query("snk_artifact_events", "SELECT run_id, 'artifact_recorded' AS type, event_id AS artifact_id, CASE WHEN event_id % 3 <> 0 THEN props END AS content FROM {run_events} r JOIN (SELECT event_id, props FROM {events}) e USING (event_id)")
def snk_artifact_events(t):
    rows = t.run_events.select("run_id", c("event_id").alias("artifact_id"), c("type").alias("kind"), c("payload").alias("content"), (c("event_id") % 3 == 0).alias("private"))
    news = rn.private_artifacts(rows.limit(0), rows)[1]
    return news.select("run_id", "type", F.get_json_object("payload", "$.artifact_id").cast("long").alias("artifact_id"), F.get_json_object("payload", "$.content").alias("content"))


_TURNS = "SELECT c_nationkey AS run_id, c_custkey % 3 AS wave, c_custkey AS agent_id, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'completed' END AS outcome, c_custkey % 5 AS integrated, c_custkey % 6 AS evidence FROM {customer}"


@query("agg_wave_report", "SELECT run_id, wave, count(*) AS attempted, sum(integrated)::BIGINT AS integrated, sum(evidence)::BIGINT AS evidence, " + ", ".join(f"coalesce(array_to_string(list_sort(list(agent_id::VARCHAR) FILTER (outcome = '{n}')), ','), '') AS {n}" for n in ("completed", "failed", "skipped")) + f" FROM ({_TURNS}) x GROUP BY run_id, wave")
def agg_wave_report(t):
    from lodestrata.plans.views import spark_sql

    return rn.wave_report(spark_sql(t.spark, t.sf_dir, _TURNS))
