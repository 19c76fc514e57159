"""Frontier of papers to read next: eligibility, transition probabilities, draws and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import maths
from lodestrata.operators.ranks import ranked
from lodestrata.operators.topk import top_k
from lodestrata.tables import stored


def assign_castes(agents: DataFrame, total: int) -> DataFrame:
    """agent_id, caste, budget: the first 40 % by id one caste, the next 30 % another (one each at least), the rest mixed."""
    n = agents.count()
    first, second = max(1, int(0.4 * n)), max(1, int(0.3 * n))
    caste = F.when(F.col("k") <= first, "fundaciones").when(F.col("k") <= first + second, "impacto").otherwise("mixto")
    return ranked(agents.select("agent_id"), ["agent_id"], "k").select("agent_id", caste.alias("caste"), F.lit(max(1, total // max(1, n))).cast("long").alias("budget"))


def eligible(frontier: DataFrame, visits: DataFrame, turn: int, most: int = 3) -> DataFrame:
    """Candidates that nobody claimed or the agent read, with attempts left, whose turn has come."""
    free = F.col("claimed_by").isNull() & (F.col("attempts") < most) & (F.col("next_turn") <= turn)
    return frontier.where(free).join(visits.select("agent_id", "id").distinct(), ["agent_id", "id"], "left_anti")


def probabilities(weights: DataFrame, key: str = "agent_id", weight: str = "weight") -> DataFrame:
    """weights with probability: a row's share of its agent's weights; equal shares where they sum to nothing. The sums are
    partial aggregates joined back, so an agent's rows need not meet in one task."""
    weights = stored(weights, "weights")
    sums = weights.groupBy(key).agg(F.sum(weight).alias("__total"), F.count("*").alias("__n"))
    share = F.when(F.col("__total") <= maths.EPS, 1 / F.col("__n")).otherwise(F.col(weight) / F.greatest(F.col("__total"), F.lit(maths.EPS)))
    return weights.join(sums, key).withColumn("probability", share).drop("__total", "__n")


def transition_table(frontier: DataFrame, pheromone: DataFrame, eta: DataFrame, agents: DataFrame, alpha: float = 1.5, beta: float = 2.0) -> DataFrame:
    """agent_id, src, id, mode, tau, weight of every candidate of the frontier (agent_id, src, id, mode): a trail never walked
    is 1, an unknown eta 0."""
    trail = pheromone.select("agent_id", "src", F.col("dst").alias("id"), "mode", "tau")
    rows = frontier.hint("merge").join(trail, ["agent_id", "src", "id", "mode"], "left").withColumn("tau", F.coalesce("tau", F.lit(1.0)))
    rows = rows.hint("merge").join(eta.select("id", "eta"), "id", "left").hint("merge").join(agents.select("agent_id", "caste"), "agent_id")
    d = maths.caste_direction(F.col("caste"), F.lit(0.5), F.lit(0.5))
    w = maths.transition_weight(F.col("tau"), alpha, F.coalesce("eta", F.lit(0.0)), beta, F.when(F.col("mode") == "ref", d["ref"]).otherwise(d["cites"]))
    return rows.select("agent_id", "src", "id", "mode", "tau", w.alias("weight"))


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**31 - 1)).cast("double") + 1) / 2.0**31


def draw(weights: DataFrame, seed: int, turn: int, key: str = "agent_id", item: str = "id", epsilon: float = 0.0) -> DataFrame:
    """One row for each agent, drawn with probability in proportion to weight, or with probability epsilon uniformly: the least
    of exponential times -ln(u) / weight. The same seed and turn give the same draw. explored tells which branch it was."""
    explored = unit(seed, F.lit("explore"), F.lit(turn), F.col(key)) < epsilon
    weight = F.when(explored, 1.0).otherwise(F.greatest(F.col("weight"), F.lit(maths.EPS)))
    time = -F.log(unit(seed, F.lit(turn), F.col(key), F.col(item))) / weight
    return weights.groupBy(key).agg(F.min_by(item, F.struct(time.alias("t"), F.col(item))).alias(item), F.max(explored).alias("explored"))


def draw_distinct(weights: DataFrame, seed: int, turn: int, priority: DataFrame, rounds: int | None = None, policy=draw) -> DataFrame:
    """agent_id, id: draws without two agents on one candidate; the agent with more priority keeps it, the others draw again, up
    to `rounds` times or until no agent with a candidate is left. policy: how an agent chooses (weights, seed, turn)."""
    done, left, k = None, stored(weights, "draws"), 0
    while k != rounds and (k == 0 or not left.isEmpty()):
        drawn = policy(left, seed, turn * 1000 + k).join(priority, "agent_id")
        kept = stored(drawn.groupBy("id").agg(F.max_by("agent_id", F.struct("priority", -F.col("agent_id"))).alias("agent_id")).select("agent_id", "id"), "drawn")
        done = kept if done is None else done.unionByName(kept)
        left = stored(left.join(kept.select("agent_id"), "agent_id", "left_anti").join(kept.select("id"), "id", "left_anti"), "draws")
        k += 1
    return done


def top_agents(agents: DataFrame, k: int) -> DataFrame:
    """The k agents with most priority among those that have a candidate; ties by id."""
    return agents.where("n_frontier > 0").orderBy(F.desc("priority"), "agent_id").limit(k)


def best_candidates(frontier: DataFrame, key: str = "agent_id") -> DataFrame:
    """Each agent's best candidate: greatest score (none is 0), ties by order of arrival."""
    return frontier.groupBy(key).agg(F.max_by("id", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ordinal"))).alias("id"))


def greedy(candidates: DataFrame, capacity: int, key: str = "agent_id") -> DataFrame:
    """candidates with rank and reason: by score to nine places, then id; chosen up to the capacity, if the score is positive."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "id")).cast("long")
    rows = candidates.withColumn("rank", rank)
    return rows.withColumn("reason", F.when(F.col("score") <= 0, "no_score").when(F.col("rank") <= capacity, "selected").otherwise("over_capacity"))


def seeded(seed: int, *parts: Column) -> Column:
    """A number in (0, 1] that depends on the seed and the parts alone: 48 bits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 1) / 2.0**48


def select_actions(candidates: DataFrame, visited: DataFrame, states: DataFrame, seed: int) -> DataFrame:
    """candidates (agent_id, id, score) with reason, selected and rank: what an agent visited (agent_id, id) and what has no positive score
    isn't eligible; of the others as many as the agent's capacity are selected, by score to nine places, then a seeded rank, then id.

    states: agent_id, max_actions, slots, fetches, tokens: the capacity is the least of max_actions, the free slots (max_actions where
    there is none) and the fetches left, and 0 without tokens. Only as many rows of an agent as the greatest capacity meet in a task.
    """
    room = F.least("max_actions", F.when(F.col("slots") > 0, F.col("slots")).otherwise(F.col("max_actions")), "fetches")
    capacity = states.select("agent_id", F.when(F.col("tokens") > 0, F.greatest(room, F.lit(0))).otherwise(0).alias("capacity"))
    seen = visited.select("agent_id", "id", F.lit(True).alias("seen")).distinct()
    reason = F.when(F.col("seen"), "already_visited").when(F.coalesce("score", F.lit(0.0)) <= 0, "non_positive_score").otherwise("eligible")
    rows = stored(candidates.join(seen.hint("merge"), ["agent_id", "id"], "left").withColumn("reason", reason).drop("seen"), "candidates")
    most = capacity.agg(F.max("capacity")).first()[0] or 0
    fit = rows.where("reason = 'eligible'").select("agent_id", (-F.round("score", 9)).alias("place"), seeded(seed, F.col("id")).alias("tie"), "id")
    best = top_k(fit, "agent_id", ["place", "tie", "id"], most) if most else fit.select("agent_id", "id", F.lit(0).cast("long").alias("rank")).limit(0)
    chosen = best.join(capacity.hint("merge"), "agent_id").where(F.col("rank") <= F.col("capacity")).select("agent_id", "id", "rank")
    rows = rows.join(stored(chosen, "chosen").hint("merge"), ["agent_id", "id"], "left")
    return rows.withColumn("selected", F.col("rank").isNotNull())


def score_frontier(frontier: DataFrame, pheromone: DataFrame, eta: DataFrame, agents: DataFrame, *, k: int, seed: int, turn: int, epsilon: float = 0.0, alpha: float = 1.5, beta: float = 2.0) -> DataFrame:
    """The audit of one turn, a row for each candidate of the frontier (agent_id, src, id, mode): caste, direction, tau, eta, weight,
    probability, explored, rank.

    rank says in which order an agent's k draws without replacement took it: the k least of exponential times -ln(u) / weight are k
    draws in proportion to weight; with probability epsilon an agent explores, and draws as if all weights were equal.
    """
    trail = pheromone.select("agent_id", "src", F.col("dst").alias("id"), "mode", "tau")
    rows = frontier.join(trail.hint("merge"), ["agent_id", "src", "id", "mode"], "left").withColumn("tau", F.coalesce("tau", F.lit(1.0)))
    rows = rows.join(eta.select("id", "eta").hint("merge"), "id", "left").join(agents.select("agent_id", "caste").hint("merge"), "agent_id").withColumn("eta", F.coalesce("eta", F.lit(0.0)))
    d = maths.caste_direction(F.col("caste"), F.lit(0.5), F.lit(0.5))
    rows = rows.withColumn("direction", F.when(F.col("mode") == "ref", d["ref"]).otherwise(d["cites"]))
    rows = probabilities(rows.withColumn("weight", maths.transition_weight(F.col("tau"), alpha, F.col("eta"), beta, F.col("direction"))))
    rows = stored(rows.withColumn("explored", seeded(seed, F.lit("explore"), F.lit(turn), F.col("agent_id")) < epsilon), "scored")
    weight = F.when(F.col("explored"), 1.0).otherwise(F.greatest(F.col("weight"), F.lit(maths.EPS)))
    time = -F.log(seeded(seed, F.lit(turn), F.col("agent_id"), F.col("src"), F.col("id"), F.col("mode"))) / weight
    drawn = top_k(rows.select("agent_id", time.alias("time"), "id", "src", "mode"), "agent_id", ["time", "id", "src", "mode"], k)
    rows = rows.join(stored(drawn.drop("time"), "drawn").hint("merge"), ["agent_id", "src", "id", "mode"], "left")
    return rows.select("agent_id", "src", "id", "mode", "caste", "direction", "tau", "eta", "weight", "probability", "explored", "rank")


def top_alternatives(scores: DataFrame, n: int = 12, key: str = "agent_id") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= n)


def update_pheromone(pheromone: DataFrame, traversals: DataFrame, *, rho: float = 0.1, low: float = 0.01, high: float = 10.0) -> DataFrame:
    """Trails after one wave: known ones evaporate (to `low` at least), unknown ones start at 1, each traversal adds its
    deposit, and all are clipped. traversals: agent_id, src, dst, mode, deposit, any number a trail."""
    key = ["agent_id", "src", "dst", "mode"]
    added = traversals.groupBy(key).agg(F.sum("deposit").alias("deposit"))
    old = F.when(F.col("tau").isNull(), 1.0).otherwise(F.greatest(F.lit(low), (1 - rho) * F.col("tau")))
    new = F.greatest(F.lit(low), F.least(F.lit(high), old + F.coalesce("deposit", F.lit(0.0))))
    return pheromone.join(added, key, "full").select(*key, new.alias("tau"))


def concentration(pheromone: DataFrame) -> DataFrame:
    """Each agent's greatest trail over its mean trail; 0 where the mean is 0."""
    mean = F.avg("tau")
    return pheromone.groupBy("agent_id").agg(F.when(mean > 0, F.max("tau") / F.greatest(mean, F.lit(1e-300))).otherwise(0.0).alias("concentration"))
