"""Windows over the rows of a key in order, without a task that sees all of a key: rows are cut into ranges of their sequence
number, each range is a window of its own, and the ends of ranges, one row each, are stitched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16  #: sequence numbers of a range


def in_ranges(rows: DataFrame, seq: str = "seq", span: int = SPAN) -> DataFrame:
    """rows with __range, a range's number."""
    return rows.withColumn("__range", F.floor(F.col(seq) / span).cast("long"))


def filled(rows: DataFrame, key: str, value: Column, out: str, *, seq: str = "seq", span: int = SPAN) -> DataFrame:
    """rows with `out`, the last value that isn't null of a key's rows up to each."""
    cut = in_ranges(rows.withColumn(out, value), seq, span)
    inside = F.last(out, ignorenulls=True).over(Window.partitionBy(key, "__range").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.where(F.col(out).isNotNull()).groupBy(key, "__range").agg(F.max(F.struct(F.col(seq).alias("at"), F.col(out).alias("value"))).alias("end"))
    seen = cut.select(key, "__range").distinct().join(ends.hint("merge"), [key, "__range"], "left")
    heads = seen.select(key, "__range", F.max("end").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__head"))
    return cut.withColumn(out, inside).join(heads.hint("merge"), [key, "__range"]).withColumn(out, F.coalesce(out, "__head.value")).drop("__range", "__head")


def lagged(rows: DataFrame, key: str, value: Column, out: str, *, seq: str = "seq", span: int = SPAN) -> DataFrame:
    """rows with `out`, the value of a key's row before each (null for its first)."""
    cut = in_ranges(rows.withColumn("__own", value), seq, span)
    w = Window.partitionBy(key, "__range").orderBy(seq)
    ends = cut.groupBy(key, "__range").agg(F.max(F.struct(F.col(seq).alias("at"), F.col("__own").alias("value"))).alias("end"))
    heads = ends.select(key, "__range", F.lag("end").over(Window.partitionBy(key).orderBy("__range")).alias("__head"))
    before = F.when(F.row_number().over(w) > 1, F.lag("__own").over(w))
    first = F.row_number().over(w) == 1
    rows = cut.withColumns({out: before, "__first": first}).join(heads.hint("merge"), [key, "__range"])
    return rows.withColumn(out, F.when(F.col("__first"), F.col("__head.value")).otherwise(F.col(out))).drop("__range", "__head", "__own", "__first")


def snapshots(events: DataFrame, every: int = SPAN) -> DataFrame:
    """run_id, seq, state_seq, state, state_hash: for each range of `every` numbers in which a run has events, the state at its start,
    that is of the last event before it with a state; none where there is no such event. events: run_id, seq, state, state_hash."""
    told = in_ranges(events.where("state is not null").select("run_id", "seq", "state", "state_hash"), span=every)
    ends = told.groupBy("run_id", "__range").agg(F.max("seq").alias("last"))
    ranges = in_ranges(events.select("run_id", "seq"), span=every).groupBy("run_id", "__range").count().join(ends.hint("merge"), ["run_id", "__range"], "left")
    before = F.max("last").over(Window.partitionBy("run_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    points = ranges.select("run_id", (F.col("__range") * every).alias("at"), before.alias("seq")).where("seq is not null")
    rows = points.join(told.hint("merge"), ["run_id", "seq"])
    return rows.select("run_id", F.col("at").alias("seq"), F.col("seq").alias("state_seq"), "state", "state_hash")


def restored(events: DataFrame, kept: DataFrame, asked: DataFrame, every: int = SPAN) -> DataFrame:
    """run_id, asof, state_seq, state of asked states (run_id, asof): the last one of the events of asof's own range up to it, else that of
    the range's snapshot. Only events of ranges that are asked for are read on."""
    ask = in_ranges(asked.select("run_id", "asof").distinct(), "asof", every)
    wanted = ask.select("run_id", "__range").distinct()
    near = in_ranges(events.where("state is not null").select("run_id", "seq", "state"), span=every).join(wanted.hint("merge"), ["run_id", "__range"], "left_semi")
    base = kept.select("run_id", (F.col("seq") / every).cast("long").alias("__range"), F.col("state_seq").alias("seq"), "state").join(wanted.hint("merge"), ["run_id", "__range"], "left_semi")
    both = near.select("run_id", "__range", "seq", "state", F.lit(0).alias("ask")).unionByName(base.withColumn("ask", F.lit(0))).unionByName(ask.select("run_id", "__range", F.col("asof").alias("seq"), F.lit(None).cast("string").alias("state"), F.lit(1).alias("ask")))
    held = F.last(F.when(F.col("ask") == 0, F.struct("seq", "state")), ignorenulls=True).over(Window.partitionBy("run_id", "__range").orderBy("seq", "ask").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", held).where("ask = 1").select("run_id", F.col("seq").alias("asof"), F.col("held.seq").alias("state_seq"), "held.state")
