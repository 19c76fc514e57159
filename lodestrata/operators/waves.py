"""Waves of a colony: trails as a base table with deltas, and the decision after each wave.

All trails fade by a share a wave, down to a floor, so a trail's strength follows from the wave at which it was last written:
what nobody walked needn't be rewritten. A wave writes the trails that it touched, and a reader takes each trail's newest row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.tables import stored

KEY = ["agent_id", "src", "dst", "mode"]


@dataclass
class Trails:
    base: DataFrame  #: agent_id, src, dst, mode, tau, at: strength after wave `at`
    deltas: list[DataFrame] = field(default_factory=list)
    rho: float = 0.1
    low: float = 0.01
    high: float = 10.0

    def faded(self, wave: int) -> Column:
        """The strength after a wave of a trail that was written after wave `at`."""
        return F.when(F.col("at") >= wave, F.col("tau")).otherwise(F.greatest(F.lit(self.low), F.col("tau") * F.pow(F.lit(1 - self.rho), F.lit(wave) - F.col("at"))))

    def rows(self) -> DataFrame:
        out = self.base
        for d in self.deltas:
            out = out.unionByName(d)
        return out

    def newest(self, of: DataFrame | None = None) -> DataFrame:
        """Each trail's newest row; of: keys, if only some are asked for, which are looked up before anything else moves."""
        rows = self.rows() if of is None else self.rows().join(of.select(*KEY).hint("merge"), KEY, "left_semi")
        return rows.groupBy(*KEY).agg(F.max(F.struct("at", "tau")).alias("r")).select(*KEY, "r.tau", "r.at")

    def current(self, wave: int) -> DataFrame:
        """agent_id, src, dst, mode, tau of all trails after a wave."""
        return self.newest().select(*KEY, self.faded(wave).alias("tau"))

    def walk(self, traversals: DataFrame, wave: int) -> "Trails":
        """The trails after a wave's traversals (agent_id, src, dst, mode, deposit, any number a trail): a new delta of those alone."""
        touched = stored(traversals.groupBy(*KEY).agg(F.sum("deposit").alias("deposit")), "touched")
        old = self.newest(touched).select(*KEY, self.faded(wave).alias("old"))
        strength = F.greatest(F.lit(self.low), F.least(F.lit(self.high), F.coalesce("old", F.lit(1.0)) + F.col("deposit")))
        delta = touched.join(old.hint("merge"), KEY, "left").select(*KEY, strength.alias("tau"), F.lit(wave).cast("long").alias("at"))
        return Trails(self.base, [*self.deltas, stored(delta, "trail-delta")], self.rho, self.low, self.high)

    def compacted(self) -> "Trails":
        """The same with one table."""
        return Trails(stored(self.newest(), "trails"), [], self.rho, self.low, self.high)


def concentrations(trails: Trails, waves: int) -> DataFrame:
    """wave, concentration after each wave up to the last, in one pass: a trail has the strength of its newest row at that wave, which fades
    until the next row's. An agent without trails at a wave doesn't count there; without any the concentration is 0."""
    own = trails.rows().where(F.col("at") <= waves).groupBy(*KEY).agg(*[F.max(F.when(F.col("at") == k, F.col("tau"))).alias(f"t{k}") for k in range(waves + 1)])
    fade = lambda tau, k: F.when(tau.isNotNull(), F.greatest(F.lit(trails.low), tau * F.pow(F.lit(1 - trails.rho), F.lit(k))))
    at = lambda wave: F.coalesce(*[F.col(f"t{k}") if k == wave else fade(F.col(f"t{k}"), wave - k) for k in range(wave, -1, -1)])
    sums = own.groupBy("agent_id").agg(*[f(at(wave)).alias(f"{name}{wave}") for wave in range(1, waves + 1) for name, f in (("m", F.max), ("a", F.avg))])
    each = lambda wave: F.when(F.col(f"a{wave}") > 0, F.col(f"m{wave}") / F.greatest(f"a{wave}", F.lit(1e-300))).when(F.col(f"a{wave}").isNotNull(), 0.0)
    row = sums.agg(*[F.coalesce(F.max(each(wave)), F.lit(0.0)).alias(f"c{wave}") for wave in range(1, waves + 1)])
    told = F.array(*[F.struct(F.lit(wave).cast("long").alias("wave"), F.col(f"c{wave}").alias("concentration")) for wave in range(1, waves + 1)])
    return row.select(F.explode(told).alias("r")).select("r.*")


def concentration(trails: DataFrame) -> DataFrame:
    """concentration: the greatest over agents of an agent's greatest trail over its mean trail; 0 without trails."""
    mean = F.avg("tau")
    each = trails.groupBy("agent_id").agg(F.when(mean > 0, F.max("tau") / F.greatest(mean, F.lit(1e-300))).otherwise(0.0).alias("c"))
    return each.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("concentration"))


@dataclass(frozen=True)
class Limits:
    fetches: int
    seconds: float
    plateau_waves: int
    plateau_least: float
    theta: float
    ranking: int = 5


def decide(qualities: DataFrame, spent: DataFrame, narrow: DataFrame, limits: Limits) -> DataFrame:
    """wave, leader, q_delta, best_q, ranking, fetches, concentration, stop_reason of each wave up to the first that stops.

    qualities: wave, agent_id, q, budget (what the agent has left) of every agent; spent: wave, fetches, elapsed so far; narrow: wave,
    concentration. The leader has most quality (ties: least id), q_delta is against its own quality the wave before. Reasons in order: all
    agents exhausted, fetches used up, time used up, no gain over plateau_waves, trails concentrated beyond theta.
    """
    before = F.lag("q").over(Window.partitionBy("agent_id").orderBy("wave"))
    rows = qualities.withColumn("delta", F.col("q") - F.coalesce(before, F.lit(0.0)))
    place = F.struct((-F.col("q")).alias("k"), F.col("agent_id").alias("agent_id"), F.col("delta").alias("delta"))
    ranks = F.row_number().over(Window.partitionBy("wave").orderBy(F.desc("q"), "agent_id"))
    first = rows.withColumn("r", ranks).where(F.col("r") <= limits.ranking).groupBy("wave").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "agent_id"))), lambda x: x["agent_id"].cast("string")), ",").alias("ranking"))
    each = rows.groupBy("wave").agg(F.min(place).alias("top"), F.max("q").alias("q"), (F.max(F.when(F.col("budget") > 0, 1).otherwise(0)) == 0).alias("idle"))
    waves = each.join(first.hint("merge"), "wave").join(spent.hint("merge"), "wave").join(narrow.hint("merge"), "wave")
    w = Window.orderBy("wave")  # a row for each wave
    best = F.max("q").over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = waves.withColumn("best_q", best)
    flat = (F.row_number().over(w) > limits.plateau_waves) & (F.col("best_q") - F.lag("best_q", limits.plateau_waves).over(w) < limits.plateau_least)
    reason = (
        F.when(F.col("idle"), "all_agents_exhausted")
        .when(F.col("fetches") >= limits.fetches, "budget_exhausted")
        .when(F.col("elapsed") >= limits.seconds, "time_budget")
        .when(F.coalesce(flat, F.lit(False)), "quality_plateau")
        .when(F.col("concentration") > limits.theta, "pheromone_converged")
    )
    rows = told.withColumn("stop_reason", reason).withColumn("ended", F.min(F.when(F.col("stop_reason").isNotNull(), F.col("wave"))).over(Window.orderBy(F.lit(1))))
    rows = rows.where(F.col("ended").isNull() | (F.col("wave") <= F.col("ended")))
    return rows.select("wave", F.col("top.agent_id").alias("leader"), F.col("top.delta").alias("q_delta"), "best_q", "ranking", "fetches", "concentration", "stop_reason")


def run_waves(trails: Trails, traversals: DataFrame, qualities: DataFrame, elapsed: DataFrame, waves: int, limits: Limits) -> tuple[DataFrame, Trails]:
    """(decisions, trails after the last wave) of traversals (wave, agent_id, src, dst, mode, deposit; each one fetch), one wave after the
    other. elapsed: wave, elapsed seconds so far. The base, which has to be of before the first wave, and the deposits of each wave and trail
    are written once, for all waves."""
    walked = traversals.groupBy("wave", *KEY).agg(F.sum("deposit").alias("deposit"), F.count("*").alias("n"))
    walked = stored(walked, "walked")
    trails = Trails(stored(trails.base, "trails"), trails.deltas, trails.rho, trails.low, trails.high)
    for wave in range(1, waves + 1):
        trails = trails.walk(walked.where(F.col("wave") == wave), wave)
    used = walked.groupBy("wave").agg(F.sum("n").alias("n"))
    spent = elapsed.join(used.hint("merge"), "wave", "left").select("wave", "elapsed", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, 0)).alias("fetches"))
    return decide(qualities, spent, concentrations(trails, waves), limits), trails
