"""Run logs: appends, canonical types, windows over events, evaluations and convergence, and per-run state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts
from lodestrata.operators.ranges import SPAN, filled, lagged

#: Older names of event types.
LEGACY = {
    "orchestrator_start": "run_started",
    "seed_routed": "seed_routing_completed",
    "colony_initialized": "colony_init_completed",
    "oleada_start": "wave_started",
    "oleada_complete": "wave_completed",
    "agent_turn_start": "agent_turn_started",
    "agent_turn_complete": "agent_turn_completed",
    "agent_turn_skipped": "agent_turn_completed",
    "evaluation_skipped": "quality_evaluation_skipped",
    "evaluation_complete": "quality_evaluation_completed",
    "evaluation_detail": "quality_evaluation_completed",
    "agent_step": "paper_integration_completed",
    "orchestrator_complete": "run_completed",
    "no_winner": "run_completed",
}
RETAINED = 1000
TERMINAL = ("completed", "cancelled", "failed", "interrupted")
ENDED = ("completed", "failed", "skipped")  #: of a node in a timeline


def canonical_type(c: Column) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), LEGACY.items(), c)


def append_events(current: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """run_id, seq, type, payload of incoming events: the next numbers of their runs, payloads redacted."""
    last = current.groupBy("run_id").agg(F.max("seq").alias("last"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(order))
    rows = incoming.withColumn("k", rank).join(last, "run_id", "left")
    return rows.select("run_id", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("long").alias("seq"), "type", texts.redact_secrets(F.col("payload")).alias("payload"))


def fill_agent(events: DataFrame, span: int = SPAN) -> DataFrame:
    """events with agent: its own, else that of the last event of the run that had one."""
    return filled(events, "run_id", F.col("agent_id"), "agent", span=span)


def retained_window(events: DataFrame, most: int = RETAINED) -> DataFrame:
    """The last `most` events of each run, with how many were seen and dropped.

    Each input partition keeps its own last ones first, so no task sorts more of a run than `most` rows a partition."""
    n = events.groupBy("run_id").agg(F.count("*").alias("seen"))
    local = F.row_number().over(Window.partitionBy("run_id", "__p").orderBy(F.desc("seq")))
    some = events.withColumn("__p", F.spark_partition_id()).withColumn("__l", local).where(F.col("__l") <= most).drop("__l", "__p")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    return some.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r").join(n, "run_id").withColumn("dropped", F.greatest(F.lit(0), F.col("seen") - most))


def verify_chain(events: DataFrame, span: int = SPAN) -> DataFrame:
    """run_id, events, broken, gaps of events (seq, state, prev_hash, state_hash): links to another hash than the one before,
    states that don't have their hash, and jumps of seq. Checked by ranges of seq, whose ends are stitched."""
    own = events.select("run_id", "seq", "prev_hash", "state_hash", (F.col("state_hash") != texts.sha256_text(F.col("state"))).alias("wrong"))
    rows = lagged(own, "run_id", F.struct("seq", "state_hash"), "before", span=span)
    bad = F.col("wrong") | ~F.col("prev_hash").eqNullSafe(F.col("before.state_hash"))
    gap = F.col("seq") != F.coalesce("before.seq", F.lit(0)) + 1
    return rows.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(bad).alias("broken"), F.count_if(gap).alias("gaps"))


def state_as_of(states: DataFrame, asked: DataFrame) -> DataFrame:
    """run_id, asof, seq, state: the last stored state at or before each asked number, by the union of both in order."""
    both = states.select("run_id", "seq", "state", F.lit(0).alias("ask")).unionByName(asked.select("run_id", F.col("asof").alias("seq"), F.lit(None).cast("string").alias("state"), F.lit(1).alias("ask")))
    w = Window.partitionBy("run_id").orderBy("seq", "ask").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("ask") == 0, F.struct("seq", "state")), ignorenulls=True).over(w)
    return both.withColumn("held", held).where("ask = 1").select("run_id", F.col("seq").alias("asof"), F.col("held.seq").alias("seq"), F.col("held.state").alias("state"))


def delta_q(evals: DataFrame) -> DataFrame:
    return evals.withColumn("delta", F.col("q") - F.lag("q").over(Window.partitionBy("run_id").orderBy("wave")))


def best_so_far(evals: DataFrame) -> DataFrame:
    """evals with best (greatest q up to and with the wave) and improved (strictly more than all before)."""
    before = F.max("q").over(Window.partitionBy("run_id").orderBy("wave").rowsBetween(Window.unboundedPreceding, -1))
    return evals.withColumns({"best": F.greatest(F.col("q"), F.coalesce(before, F.col("q"))), "improved": before.isNull() | (F.col("q") > before)})


def plateau(evals: DataFrame, waves: int, least: float) -> DataFrame:
    """evals with plateau: more than `waves` waves so far, and less than `least` gained since the one waves - 1 before."""
    w = Window.partitionBy("run_id").orderBy("wave")
    return evals.withColumn("plateau", F.coalesce((F.row_number().over(w) > waves) & (F.col("q") - F.lag("q", waves - 1).over(w) < least), F.lit(False)))


def convergence(evals: DataFrame, waves: int, least: float, budget: int, *, seconds: int | None = None, theta: float | None = None) -> DataFrame:
    """run_id, wave, reason of the first wave that stops a run, by the first that applies: fetches used up (`fetches`, or the
    wave's number where there is no such column), time used up (`elapsed`), a plateau, concentrated trails (`concentration`)."""
    rows = plateau(evals, waves, least)
    spent = F.col("fetches" if "fetches" in evals.columns else "wave") >= budget
    late = F.lit(False) if seconds is None else F.col("elapsed") >= seconds
    narrow = F.lit(False) if theta is None else F.col("concentration") > theta
    reason = F.when(spent, "budget").when(late, "time_budget").when(F.col("plateau"), "quality_plateau").when(narrow, "pheromone_converged")
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("run_id").agg(F.min("wave").alias("wave"), F.min_by("reason", "wave").alias("reason"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def quality_evolution(evals: DataFrame) -> DataFrame:
    return evals.groupBy("run_id").agg(F.min_by("q", "wave").alias("first"), F.max_by("q", "wave").alias("last"), F.max("q").alias("best"), (F.max_by("q", "wave") - F.min_by("q", "wave")).alias("gain"))


def agent_labels(events: DataFrame) -> DataFrame:
    """run_id, agent_id, label: A01, A02 ... by first appearance."""
    first = events.where("agent_id is not null").groupBy("run_id", "agent_id").agg(F.min("seq").alias("seq"))
    return first.select("run_id", "agent_id", F.format_string("A%02d", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).alias("label"))


def stale_runs(runs: DataFrame, now: Column, seconds: int = 120, host: Column | None = None) -> DataFrame:
    """runs (status, heartbeat; with host also host and pid_alive) with status and reason. A running one becomes interrupted
    if its last sign of life is older than `seconds`, or if its process on this host is dead."""
    running = F.col("status") == "running"
    old = now.cast("timestamp").cast("long") - F.col("heartbeat").cast("timestamp").cast("long") > seconds
    dead = F.lit(False) if host is None else F.coalesce((F.col("host") == host) & ~F.col("pid_alive"), F.lit(False))
    reason = F.when(running & dead, "process_dead").when(running & old, "stale_heartbeat")
    return runs.withColumns({"reason": reason, "status": F.when(reason.isNotNull(), "interrupted").otherwise(F.col("status"))})


def project_runs(events: DataFrame, most: int = RETAINED) -> DataFrame:
    """One row of state for each run from its log, in any order and with repeats: an event's number counts once; the last
    status (the first end is final), current agent, number of evaluations, best q, and how many events were seen and are retained."""
    once = events.where("seq > 0").groupBy("run_id", "seq").agg(F.min(F.struct("type", "agent_id", "value")).alias("e")).select("run_id", "seq", "e.*")
    from lodestrata.operators.machines import run_status

    kind = canonical_type(F.col("type"))
    rows = once.withColumns({"kind": kind, "status": run_status(kind)})
    fact = F.struct("seq", "status")
    end = F.min(F.when(F.col("status").isin(*TERMINAL), fact))
    return rows.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"),
        F.count("*").alias("seen"),
        F.least(F.count("*"), F.lit(most)).alias("retained"),
        F.coalesce(end, F.max(F.when(F.col("status").isNotNull(), fact)))["status"].alias("status"),
        F.max_by("agent_id", F.when(F.col("agent_id").isNotNull(), F.col("seq"))).alias("agent_id"),
        F.count_if(F.col("kind") == "quality_evaluation_completed").alias("evaluations"),
        F.max(F.when(F.col("kind") == "quality_evaluation_completed", F.least(F.lit(1.0), F.col("value") / 100))).alias("best_q"),
    )


def peer_score(votes: DataFrame) -> DataFrame:
    """subject, median, weighted: the exact median of its votes, and their mean by weight (the median where weights sum to 0)."""
    total = F.sum("weight")
    return votes.groupBy("subject").agg(F.median("vote").alias("median"), F.when(total > 0, F.sum(F.col("vote") * F.col("weight")) / F.greatest(total, F.lit(1e-300))).otherwise(F.median("vote")).alias("weighted"))


def quality(components: DataFrame, weights: dict[str, float]) -> DataFrame:
    """components with q, the weighted sum in [0, 1] where a missing one counts 0, and unavailable, their names."""
    total = reduce(lambda a, b: a + b, [w * F.coalesce(F.col(n), F.lit(0.0)) for n, w in weights.items()])
    missing = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in weights]))), ",")
    return components.withColumns({"q": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), "unavailable": missing})


def rollup_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A parent's status from its children's: active if any is; completed if all have ended, well or not; failed if any failed
    while others wait; else pending."""
    some = lambda x: F.max((F.col("status") == x).cast("int")) == 1
    ended = F.min(F.col("status").isin(*ENDED).cast("int")) == 1
    return rows.groupBy(*keys).agg(F.when(some("active"), "active").when(ended, "completed").when(some("failed"), "failed").otherwise("pending").alias("status"))


def list_runs(runs: DataFrame, events: DataFrame, evals: DataFrame) -> DataFrame:
    a, b = events.groupBy("run_id").agg(F.count("*").alias("events")), evals.groupBy("run_id").agg(F.count("*").alias("evaluations"))
    return runs.join(a, "run_id", "left").join(b, "run_id", "left").select("run_id", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("evaluations", F.lit(0)).alias("evaluations"))


def experiment_report(runs: DataFrame, arm: str, value: str) -> DataFrame:
    return runs.groupBy(arm).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("deviation"))


def across_run_ci(uplifts: DataFrame) -> DataFrame:
    """runs, mean, low, high of one value a run; null bounds under two runs."""
    n = F.count("*")
    half = F.when(n >= 2, 1.96 * F.stddev_samp("uplift") / F.sqrt(F.greatest(n, F.lit(1))))
    return uplifts.agg(n.alias("runs"), F.avg("uplift").alias("mean"), (F.avg("uplift") - half).alias("low"), (F.avg("uplift") + half).alias("high"))


def timeline(events: DataFrame) -> DataFrame:
    """run_id, seq, parent of each event: the last turn (agent_turn_started) before it, else the last wave, else the run's start."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kind = canonical_type(F.col("type"))
    turn = F.last(F.when(kind == "agent_turn_started", F.col("seq")), ignorenulls=True).over(w)
    wave = F.last(F.when(kind == "wave_started", F.col("seq")), ignorenulls=True).over(w)
    return events.select("run_id", "seq", F.coalesce(turn, wave, F.lit(0)).cast("long").alias("parent"))


#: Which events stand in the timeline, and as what.
ENTRIES = {"reference_mapping_started": "mapping", "reference_mapping_completed": "mapping", "neighbor_discovery_completed": "discovery", "frontier_reference_evaluation_completed": "frontier", "paper_integration_completed": "paper", "warning": "warning"}


def timeline_rows(events: DataFrame) -> DataFrame:
    """run_id, entry_id, seq, kind, status of the events that the timeline shows, each the news of an entry: a mapping, discovery or
    frontier of an agent, a paper's step, a warning of its own. The newest of an entry counts (`upsert_sink` by entry_id)."""
    kind = canonical_type(F.col("type"))
    place = F.lit(None).cast("string")
    for name, entry in ENTRIES.items():
        place = F.when(kind == name, entry).otherwise(place)
    alone = place.isin("warning", "paper")
    entry_id = F.concat_ws(":", place, F.col("run_id").cast("string"), F.when(alone, F.col("seq").cast("string")).otherwise(F.coalesce("agent_id", F.lit("-"))))
    status = F.when(kind.endswith("_started"), "active").when(kind == "warning", "failed").otherwise("completed")
    return events.where(place.isNotNull()).select("run_id", entry_id.alias("entry_id"), "seq", place.alias("kind"), status.alias("status"))


def exam_projection(events: DataFrame) -> DataFrame:
    """run_id and what a run's examination has come to: sources, items, sound, selected, held out, survivor and uplift, each the
    last value that its event gave, and the last stage."""
    names = {"sources": "evidence_pack_frozen", "items": "exam_generated", "sound": "exam_validated", "held": "exam_partitioned", "survivor": "survivor_selected", "uplift": "benchmark_completed"}
    rows = events.where(F.col("type").isin(*names.values()))
    return rows.groupBy("run_id").agg(*[F.max_by("value", F.when(F.col("type") == t, F.col("seq"))).alias(n) for n, t in names.items()], F.max_by("type", "seq").alias("stage"))


def private_artifacts(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts with the incoming ones (run_id, artifact_id, kind, content, private), their events): a private artifact's event holds
    its id alone."""
    body = F.when(F.col("private"), F.to_json(F.struct("artifact_id"))).otherwise(F.to_json(F.struct("artifact_id", "kind", "content")))
    return current.unionByName(incoming.select(*current.columns)), incoming.select("run_id", F.lit("artifact_recorded").alias("type"), body.alias("payload"))


def wave_summary(turns: DataFrame) -> DataFrame:
    """run_id, wave, attempted, integrated, failed and the sorted agents that failed."""
    bad = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("agent_id").cast("string")))), ",")
    return turns.groupBy("run_id", "wave").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("integrated"), F.count_if(~F.col("ok")).alias("failed"), bad.alias("failed_agents"))


def wave_report(turns: DataFrame) -> DataFrame:
    """run_id, wave, attempted, integrated, evidence, and the sorted agents that completed, failed or were skipped, of turns (run_id,
    wave, agent_id, outcome, integrated, evidence)."""
    names = lambda x: F.array_join(F.array_sort(F.collect_set(F.when(F.col("outcome") == x, F.col("agent_id").cast("string")))), ",").alias(x)
    return turns.groupBy("run_id", "wave").agg(F.count("*").alias("attempted"), F.sum("integrated").alias("integrated"), F.sum("evidence").alias("evidence"), names("completed"), names("failed"), names("skipped"))


def append_evaluations(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluations with the incoming ones, a compact event for each incoming one, q to four places)."""
    events = incoming.select("run_id", "wave", F.lit("quality_evaluation_completed").alias("type"), F.to_json(F.struct("wave", F.round("q", 4).alias("q"))).alias("payload"))
    return current.unionByName(incoming.select(*current.columns)), events


def loose_int(c: Column, default: int = 0) -> Column:
    """A number in a text, or the default."""
    return F.coalesce(c.try_cast("int"), F.lit(default))


def loose_float(c: Column, default: float | None = None) -> Column:
    value = c.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))
