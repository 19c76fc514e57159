"""The state machines of a run: run, wave, phase, agent, turn, evaluation, paper, discovery, frontier, mapping and exam phase.

An event says what one or more nodes have come to: a fact (run_id, machine, node, seq, status). A node's state is its newest
fact, and a run's first end is final, whatever follows. Neither depends on the order in which facts arrive or on repeats, so
a stream folds them as a batch does, late or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import texts
from lodestrata.operators.runs import TERMINAL, canonical_type

#: Names of events, and what the node that they speak of has come to.
WAVE = {"wave_started": "active", "wave_completed": "completed"}
PHASE = {"wave_phase_started": "active", "wave_phase_completed": "completed", "wave_phase_failed": "failed"}
AGENT = {
    "agent_turn_queued": "waiting", "agent_turn_started": "active", "agent_turn_failed": "failed", "quality_evaluation_started": "evaluating",
    "quality_evaluation_completed": "waiting", "quality_evaluation_skipped": "waiting", "quality_evaluation_failed": "failed",
}
TURN = {"agent_turn_started": "active", "agent_turn_completed": "completed", "agent_turn_failed": "failed"}
EVALUATION = {"quality_evaluation_started": "active", "quality_evaluation_completed": "completed", "quality_evaluation_skipped": "skipped", "quality_evaluation_failed": "failed"}
STEPS = {
    "fetch": {"paper_fetch_started": "active", "paper_fetch_completed": "completed", "paper_fetch_failed": "failed"},
    "read": {"paper_integration_started": "active", "paper_integration_completed": "completed", "paper_integration_failed": "failed"},
    "discovery": {"neighbor_discovery_started": "active", "neighbor_discovery_completed": "completed", "neighbor_discovery_failed": "failed"},
    "frontier": {"frontier_reference_evaluation_started": "active", "frontier_reference_evaluation_completed": "completed", "frontier_reference_evaluation_failed": "failed"},
    "mapping": {"reference_mapping_started": "active", "reference_mapping_completed": "completed", "reference_mapping_reused": "completed", "reference_mapping_failed": "failed"},
}
EXAM = {
    "exam_build": {"evidence_pack_frozen": "active", "exam_generated": "active", "exam_validated": "completed", "exam_insufficient": "failed"},
    "selection": {"exam_partitioned": "active", "candidate_test_started": "active", "survivor_selected": "completed"},
    "survivor": {"survivor_selected": "completed", "survivor_frozen": "completed"},
    "benchmark": {"baseline_completed": "active", "benchmark_completed": "completed"},
}
RUN = {
    "run_started": "running", "seed_routing_started": "running", "seed_routing_completed": "running", "wave_started": "running", "wave_completed": "running",
    "agent_turn_completed": "running", "quality_evaluation_started": "evaluating", "quality_evaluation_completed": "running", "quality_evaluation_skipped": "running",
    "quality_evaluation_failed": "running", "run_completed": "completed", "run_failed": "failed", "seed_routing_failed": "failed", "run_cancelled": "cancelled", "run_interrupted": "interrupted",
}
TOLD = ("running", "evaluating", "completed", "cancelled", "failed", "converged", "exhausted")  #: that a status event may give
WARNINGS = ("warning", "provider_failure", "id_title_mismatch", "trace_write_failed")


def _by(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, status in table.items():
        out = F.when(kind == name, status).otherwise(out)
    return out


def run_status(kind: Column, told: Column | None = None, phase: Column | None = None) -> Column:
    """What an event of a canonical type makes of its run; told: the status in its payload, phase: that of a phase's start."""
    told = F.lit(None).cast("string") if told is None else told
    phase = F.lit(None).cast("string") if phase is None else phase
    ended = F.when((kind == "run_completed") & told.isin("cancelled", "failed"), told)
    started = F.when(kind == "wave_phase_started", F.when(phase == "evaluation", "evaluating").otherwise("running"))
    return F.coalesce(ended, started, F.when((kind == "status") & told.isin(*TOLD), told), _by(kind, RUN))


def facts(events: DataFrame) -> DataFrame:
    """run_id, machine, node, seq, status of events (run_id, seq, type, agent_id, payload).

    Wave, phase, turn, agent, paper, status and budget come from the payload, a JSON object; an event's own agent_id counts
    first, a missing wave or turn is `-`, a missing phase research. What needs an agent and has none says nothing. An event
    that says something and has a payload that can't be read is a warning, as are the events that are warnings themselves.
    """
    of = lambda *names: F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))
    number = lambda *names: F.coalesce(of(*names).try_cast("int").cast("string"), F.lit("-"))
    read = events.where("run_id is not null and seq is not null").select(
        "run_id", F.col("seq").cast("long").alias("seq"), "type", canonical_type(F.col("type")).alias("kind"), number("oleada", "wave").alias("wave"), number("turn").alias("turn"),
        F.coalesce(of("phase"), F.lit("research")).alias("phase"), F.when(F.col("type") != "no_winner", of("status")).alias("told"), of("budget").try_cast("int").alias("budget"),
        F.coalesce(F.col("agent_id").cast("string"), of("agent_id", "agent")).alias("agent"), F.coalesce(of("paper_id", "paper"), F.lit("")).alias("paper"),
        of("message", "reason", "error").alias("message"), (F.col("payload").isNotNull() & F.get_json_object("payload", "$").isNull()).alias("unread"),
    )
    kind, wave, turn, phase, told, agent = (F.col(n) for n in ("kind", "wave", "turn", "phase", "told", "agent"))
    here = F.concat_ws(":", wave, agent, turn)
    own = lambda node: F.when(agent.isNotNull(), node)
    agent_status = F.when(kind == "agent_turn_completed", F.when(F.col("budget") <= 0, "exhausted").otherwise("waiting")).when(kind == "evaluation_settled", F.when(told == "failed", "failed").otherwise("waiting")).otherwise(_by(kind, AGENT))
    settled = F.when(kind == "evaluation_settled", F.when(told.isin("failed", "skipped"), told).otherwise("completed")).otherwise(_by(kind, EVALUATION))
    step = F.concat_ws(":", wave, F.coalesce(agent, F.lit("-")), turn, F.col("paper"))
    says = [
        ("run", F.lit(""), run_status(kind, told, phase)),
        ("wave", wave, _by(kind, WAVE)),
        ("phase", F.concat_ws(":", wave, phase), _by(kind, PHASE)),
        ("phase", F.concat_ws(":", wave, F.lit("research")), F.when(kind == "wave_started", "active")),
        ("agent", own(agent), agent_status),
        ("turn", own(here), _by(kind, TURN)),
        ("evaluation", own(here), settled),
        *((name, step, _by(kind, table)) for name, table in STEPS.items()),
        *(("exam", F.lit(name), _by(kind, table)) for name, table in EXAM.items()),
    ]
    structs = [F.when(node.isNotNull() & status.isNotNull(), F.struct(F.lit(machine).alias("machine"), node.alias("node"), status.alias("status"))) for machine, node, status in says]
    said = read.withColumn("facts", F.array_compact(F.array(*structs)))
    message = F.when(kind.isin(*WARNINGS), F.coalesce("message", "type")).when(F.col("unread") & (F.size("facts") > 0), F.concat(F.lit("projection_error type="), "type"))
    warning = F.when(message.isNotNull(), F.array(F.struct(F.lit("warning").alias("machine"), F.col("seq").cast("string").alias("node"), texts.redact_secrets(message).alias("status"))))
    rows = said.select("run_id", "seq", F.explode(F.concat("facts", F.coalesce(warning, F.array().cast("array<struct<machine:string,node:string,status:string>>")))).alias("f"))
    return rows.select("run_id", "f.machine", "f.node", "seq", "f.status")


def fold(told: DataFrame) -> DataFrame:
    """run_id, machine, node, seq, status: each node's newest fact, a run's first end before all others."""
    fact = F.struct("seq", "status")
    end = F.when((F.col("machine") == "run") & F.col("status").isin(*TERMINAL), fact)
    rows = told.groupBy("run_id", "machine", "node").agg(F.coalesce(F.min(end), F.max(fact)).alias("f"))
    return rows.select("run_id", "machine", "node", "f.seq", "f.status")


def settled(nodes: DataFrame) -> DataFrame:
    """nodes as they stand once a run's end and later waves are known: agents of an ended run that haven't failed are completed, and so
    is an active wave before the run's last, or of a completed run."""
    number = F.when(F.col("machine") == "wave", F.col("node").try_cast("int"))
    runs = nodes.groupBy("run_id").agg(F.max(F.when(F.col("machine") == "run", F.col("status"))).alias("run"), F.max(number).alias("last"))
    done = ((F.col("machine") == "agent") & (F.col("status") != "failed") & F.col("run").isin(*TERMINAL)) | ((F.col("machine") == "wave") & (F.col("status") == "active") & ((F.col("run") == "completed") | (number < F.col("last"))))
    rows = nodes.join(runs.hint("merge"), "run_id")
    return rows.select("run_id", "machine", "node", "seq", F.when(F.coalesce(done, F.lit(False)), "completed").otherwise(F.col("status")).alias("status"))
