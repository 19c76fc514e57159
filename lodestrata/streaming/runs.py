"""Run logs as streams: ingest, bounded dedup, per-run state, the machines of a run's nodes, and expiry of silent runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from lodestrata.functions import texts
from lodestrata.operators import machines
from lodestrata.operators.runs import RETAINED, TERMINAL, canonical_type
from lodestrata.shipping import ship

SILENCE_MS = 120_000
EVENT = StructType([StructField("run_id", LongType()), StructField("seq", LongType()), StructField("ts", TimestampType()), StructField("type", StringType()), StructField("agent_id", StringType()), StructField("value", DoubleType()), StructField("payload", StringType())])
STATE = StructType([
    StructField("last_seq", LongType()), StructField("seen", LongType()), StructField("scores", LongType()), StructField("status", StringType()), StructField("agent_id", StringType()),
    StructField("evaluations", LongType()), StructField("best_q", DoubleType()), StructField("wave", LongType()), StructField("wave_status", StringType()), StructField("phase_status", StringType()),
    StructField("turns", LongType()), StructField("exam_stage", StringType()), StructField("warnings", LongType()),
])
OUTPUT = StructType([StructField("run_id", LongType()), *STATE.fields, StructField("retained", LongType()), StructField("dropped", LongType()), StructField("retained_scores", LongType()), StructField("expired", BooleanType())])
HELD = StructType([StructField("seq", LongType()), StructField("type", StringType()), StructField("value", DoubleType())])
NODE = StructType([StructField("node", StringType())])
NODE_STATE = StructType([StructField("seq", LongType()), StructField("status", StringType()), StructField("end_seq", LongType()), StructField("end", StringType()), StructField("version", LongType())])
NODES = StructType([StructField("run_id", LongType()), StructField("machine", StringType()), *NODE.fields, StructField("seq", LongType()), StructField("status", StringType()), StructField("version", LongType())])


def ingest(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """events with canonical types and redacted payloads, each (run_id, seq) once within the watermark, which bounds the state."""
    clean = events.withColumns({"type": canonical_type(F.col("type")), "payload": texts.redact_secrets(F.col("payload"))})
    return clean.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "seq"])


class Fold(StatefulProcessor):
    """A run's state: events with a number up to the last one's are dropped, those of an input batch are taken in order. Counters and
    the last values are held, and the last RETAINED events and candidate scores, whatever the number of events."""

    def __init__(self, silence_ms: int | None = None, most: int = RETAINED):
        self.silence_ms, self.most = silence_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE)
        self.events, self.scores = handle.getListState("events", HELD), handle.getListState("scores", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        s = dict(zip(STATE.names, held, strict=True)) if held else dict.fromkeys(STATE.names) | dict.fromkeys(("last_seq", "seen", "scores", "evaluations", "turns", "warnings"), 0)
        events, scores = deque(self.events.get() if held else (), self.most), deque(self.scores.get() if held else (), self.most)
        batch = sorted((row for df in rows for row in df[["seq", "type", "agent_id", "value", "status"]].itertuples(index=False)), key=lambda x: (x.seq, x.type or ""))
        for x in batch:
            if 0 < x.seq <= s["last_seq"]:
                continue
            s["last_seq"], s["seen"] = max(s["last_seq"], int(x.seq)), s["seen"] + 1
            row = (int(x.seq), x.type, None if x.value != x.value else float(x.value))
            events.append(row)
            if x.type == "candidate_score":
                s["scores"] += 1
                scores.append(row)
            self._step(s, x)
        self.state.update(tuple(s[n] for n in STATE.names))
        if events:
            self.events.put(list(events))
        if scores:
            self.scores.put(list(scores))
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield self._row(key, False)

    @staticmethod
    def _step(s: dict, x) -> None:
        """One event's effect on the machines of run, wave, phase, turn and exam."""
        kind = x.type or ""
        if s["status"] not in TERMINAL and isinstance(x.status, str):  # a run's first end is final
            s["status"] = x.status
        s["agent_id"] = x.agent_id if isinstance(x.agent_id, str) else s["agent_id"]
        if kind == "quality_evaluation_completed":
            s["evaluations"] += 1
            if x.value == x.value:
                s["best_q"] = max(s["best_q"] if s["best_q"] is not None else -1e300, min(1.0, float(x.value) / 100))
        elif kind in ("wave_started", "wave_completed"):
            s["wave"] = (s["wave"] or 0) + (kind == "wave_started")
            s["wave_status"] = "active" if kind == "wave_started" else "completed"
        elif kind.startswith("phase_"):
            s["phase_status"] = {"phase_started": "active", "phase_completed": "completed"}.get(kind, "failed")
        elif kind == "agent_turn_completed":
            s["turns"] += 1
        elif kind.startswith(("exam_", "survivor_", "benchmark_")):
            s["exam_stage"] = kind
        elif kind == "warning":
            s["warnings"] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held and held[STATE.names.index("status")] not in (None, *TERMINAL):
            at = STATE.names.index("status")
            self.state.update((*held[:at], "interrupted", *held[at + 1 :]))
            yield self._row(key, True)

    def _row(self, key, expired: bool) -> pd.DataFrame:
        held = self.state.get()
        seen, scores = held[STATE.names.index("seen")], held[STATE.names.index("scores")]
        return pd.DataFrame([(key[0], *held, min(seen, self.most), max(0, seen - self.most), min(scores, self.most), expired)], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def project_stream(events: DataFrame, silence_ms: int | None = None, most: int = RETAINED) -> DataFrame:
    """One row of state for each run that has news in a micro-batch (update mode); with silence_ms a running run that stays
    silent so long becomes interrupted. Needs the RocksDB state store."""
    ship(events.sparkSession)
    told = machines.run_status(F.col("kind"), F.when(F.col("type") != "no_winner", F.get_json_object("payload", "$.status")), F.get_json_object("payload", "$.phase"))
    rows = events.withColumn("kind", canonical_type(F.col("type"))).select("run_id", "seq", F.col("kind").alias("type"), "agent_id", F.col("value").cast("double").alias("value"), told.alias("status"))
    return rows.groupBy("run_id").transformWithStateInPandas(Fold(silence_ms, most), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if silence_ms is not None else "None")


class Nodes(StatefulProcessor):
    """The nodes of one machine of a run: of each the newest fact and the first end, whatever the order in which facts come."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", NODE, NODE_STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple] = {}
        for df in rows:
            for x in df[["node", "seq", "status"]].itertuples(index=False):
                fact = (int(x.seq), x.status)
                last, end = new.get(x.node, (fact, None))
                if key[1] == "run" and x.status in TERMINAL:
                    end = min(end or fact, fact)
                new[x.node] = max(last, fact), end
        out = []
        for node, (last, end) in new.items():
            held = self.nodes.getValue((node,)) if self.nodes.containsKey((node,)) else None
            if held:
                last = max(last, (held[0], held[1]))
                end = min((e for e in (end, held[3] and (held[2], held[3])) if e), default=None)
            state = (*last, *(end or (None, None)))
            if held is None or state != tuple(held[:4]):
                version = (held[4] if held else 0) + 1
                self.nodes.updateValue((node,), (*state, version))
                out.append((*key, node, *(end or last), version))
        yield pd.DataFrame(out, columns=NODES.names)

    def close(self) -> None:
        pass


def node_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """run_id, machine, node, seq, status, version of each node that has news in a micro-batch, warnings among them: what
    `machines.fold` gives of all events so far, for late, shuffled and repeated events too. State is held by run and machine, a node
    at a time, so a large run is dealt over its machines; with keep_ms a node that stays silent so long is forgotten. To be written
    by `upsert_sink` with the keys run_id, machine and node in order of version."""
    ship(events.sparkSession)
    return machines.facts(events).groupBy("run_id", "machine").transformWithStateInPandas(Nodes(keep_ms), outputStructType=NODES, outputMode="Update", timeMode="ProcessingTime" if keep_ms is not None else "None")


def upsert_sink(path: str, keys: list[str], order: str):
    """A foreachBatch function that writes each batch's newest rows by key as a folder of its own: a batch costs what is new in it,
    and one that is tried again overwrites its own folder. `newest` reads them, `compact` makes one folder of many."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def newest(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str) -> DataFrame:
    """The row of greatest `order`, then of the latest batch, for each key of what `upsert_sink` wrote."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), F.struct(order, "batch")).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, into: str, schema: StructType, keys: list[str], order: str) -> None:
    """Write the newest rows of a sink's folder as the first batch of another."""
    newest(spark, path, schema, keys, order).write.mode("overwrite").parquet(f"{into}/batch=-1")
