"""Outcomes of runs: a wave's decision, why a run ended as it did, reports, and checks of models' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import frontier, runs

AVAILABLE = ("s", "p", "j", "r")  #: self-assessment, peers, judge, structure


def component_states(rows: DataFrame, names: tuple[str, ...] = AVAILABLE) -> DataFrame:
    """rows with each component null where it is not available (name_ok is false or its score null), and reasons: name:reason of
    those (name_reason, or model_failed where none is given), sorted."""
    gone = {n: ~F.coalesce(F.col(f"{n}_ok"), F.lit(False)) | F.col(n).isNull() for n in names}
    said = F.array_sort(F.array_compact(F.array(*[F.when(g, F.concat(F.lit(f"{n}:"), F.coalesce(f"{n}_reason", F.lit("model_failed")))) for n, g in gone.items()])))
    return rows.withColumns({"reasons": F.array_join(said, ","), **{n: F.when(~g, F.col(n)) for n, g in gone.items()}})


def peer_reasons(votes: DataFrame) -> DataFrame:
    """subject, votes, reason: why a subject has no peer score: the one reason that all its failed votes share, else model_failed;
    null where there is a vote."""
    shared = F.when(F.count_distinct("reason") == 1, F.max("reason")).otherwise("model_failed")
    return votes.groupBy("subject").agg(F.count("vote").alias("votes"), F.when(F.count("vote") == 0, shared).alias("reason"))


def committee(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """run_id, wave, q, delta (to the wave before), unavailable (sorted names after unavailable:, else empty) of components; a
    missing one counts 0."""
    out = runs.quality(rows, weights)
    before = F.lag("q").over(Window.partitionBy("run_id").orderBy("wave"))
    said = F.when(F.col("unavailable") != "", F.concat(F.lit("unavailable:"), "unavailable")).otherwise("")
    return out.select("run_id", "wave", "q", (F.col("q") - F.coalesce(before, F.lit(0.0))).alias("delta"), said.alias("unavailable"))


def wave_decision(evals: DataFrame, frontier_sizes: DataFrame, pheromone: DataFrame, fetches: DataFrame, budget: int) -> DataFrame:
    """run_id, wave, leader, best_q, q_delta, concentration, stop_reason, continue_reason for each wave: evals (run_id, wave, agent_id,
    q, delta), the leader by q, then id; a run stops when no agent has a candidate left (frontier_sizes: run_id, wave,
    candidates) or its fetches (run_id, wave, fetches so far) reach the budget. pheromone: run_id, agent_id, tau."""
    order = F.struct(F.col("q").alias("q"), (-F.col("agent_id")).alias("a"))
    lead = evals.groupBy("run_id", "wave").agg(F.max_by(F.struct("agent_id", "delta"), order).alias("l"), F.max("q").alias("q"))
    best = F.max("q").over(Window.partitionBy("run_id").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0))
    narrow = frontier.concentration(pheromone.withColumn("agent_id", F.col("run_id"))).select(F.col("agent_id").alias("run_id"), "concentration")
    rows = lead.withColumn("best", best).join(frontier_sizes, ["run_id", "wave"], "left").join(fetches, ["run_id", "wave"], "left").join(narrow, "run_id", "left")
    stop = F.when(F.coalesce("candidates", F.lit(0)) == 0, "all_agents_exhausted").when(F.coalesce("fetches", F.lit(0)) >= budget, "budget_exhausted").otherwise("")
    return rows.select("run_id", "wave", F.col("l.agent_id").alias("leader"), F.round("best", 4).alias("best_q"), F.round("l.delta", 4).alias("q_delta"), F.round(F.coalesce("concentration", F.lit(0.0)), 4).alias("concentration"), stop.alias("stop_reason"), F.when(stop == "", "budget_remaining").otherwise("").alias("continue_reason"))


def discovery_reason(outcomes: DataFrame) -> DataFrame:
    """run_id, reason of runs' first discoveries (run_id, traversable, found, extraction_failed, mapping_incomplete, error): empty if
    something can be followed, else the first reason that applies."""
    some = lambda c: F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) == 1
    good = F.col("error").isNull()
    reason = (
        F.when(F.coalesce(F.sum(F.when(good, F.col("traversable"))), F.lit(0)) > 0, "")
        .when((F.count("error") > 0) | (F.count_if(good) == 0), "seed_discovery_failed")
        .when(F.coalesce(F.sum(F.when(good, F.col("found"))), F.lit(0)) > 0, "no_traversable_identifiers")
        .when(some("extraction_failed"), "reference_extraction_failed")
        .when(some("mapping_incomplete"), "reference_mapping_incomplete")
        .otherwise("no_neighbors_discovered")
    )
    return outcomes.groupBy("run_id").agg(reason.alias("reason"))


def outcome_gap(finished: DataFrame, evals: DataFrame) -> DataFrame:
    """run_id, gap of finished runs (run_id, winner, narrative): empty for a full success, else an empty narrative, no evaluated
    evidence, or a winner that was not evaluated. evals: run_id, agent_id, status, new_papers."""
    done = evals.where("status = 'complete'").join(finished.select("run_id", "winner"), "run_id")
    facts = done.groupBy("run_id").agg(F.max((F.col("new_papers") > 0).cast("int")).alias("evidence"), F.max((F.col("agent_id") == F.col("winner")).cast("int")).alias("winner_seen"))
    gap = F.when(F.coalesce("narrative", F.lit("")) == "", "empty_winner_narrative").when(F.coalesce("evidence", F.lit(0)) == 0, "no_evaluated_evidence").when(F.coalesce("winner_seen", F.lit(0)) == 0, "winner_evaluation_missing").otherwise("")
    return finished.join(facts, "run_id", "left").select("run_id", gap.alias("gap"))


def terminal_reason(runs_: DataFrame, claims: DataFrame, acquired: DataFrame, pool: DataFrame) -> DataFrame:
    """run_id, reason of research runs (run_id, had_success, had_transient): evidence_sufficient if a supported claim (run_id,
    claim_id, status, papers) rests on acquired papers alone (run_id, paper_id), no_eligible_actions if unvisited papers (pool:
    run_id, visited) are left, provider_failure if nothing but passing failures came, else frontier_exhausted."""
    refs = claims.where("status = 'supported'").select("run_id", "claim_id", F.explode("papers").alias("paper_id"))
    met = refs.hint("merge").join(acquired.select("run_id", "paper_id").distinct().withColumn("ok", F.lit(1)), ["run_id", "paper_id"], "left")
    whole = met.groupBy("run_id", "claim_id").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok")).groupBy("run_id").agg(F.max("ok").alias("enough"))
    left = pool.groupBy("run_id").agg(F.max((~F.col("visited")).cast("int")).alias("left"))
    rows = runs_.join(whole, "run_id", "left").join(left, "run_id", "left")
    reason = F.when(F.col("enough") == 1, "evidence_sufficient").when(F.col("left") == 1, "no_eligible_actions").when(~F.col("had_success") & F.col("had_transient"), "provider_failure").otherwise("frontier_exhausted")
    return rows.select("run_id", reason.alias("reason"))


def batch_summary(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """status, n of a batch's tasks (task_id); a task without a result is pending."""
    return manifest.join(results, "task_id", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def budget_state(used: Column, most: Column) -> Column:
    """struct(remaining, exhausted) of one dimension; no limit is never used up."""
    left = F.greatest(F.lit(0), most - used)
    return F.struct(left.alias("remaining"), F.coalesce(used >= most, F.lit(False)).alias("exhausted"))


def visitors(visits: DataFrame) -> DataFrame:
    """node, visitors (sorted agent ids with commas), n."""
    return visits.select("node", "agent_id").distinct().groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("agent_id")), lambda x: x.cast("string")), ",").alias("visitors"), F.count("*").alias("n"))


def wave_ranking(evals: DataFrame, most: int = 3) -> DataFrame:
    """run_id, wave, agent_id, q, rank of the best agents of each wave; ties by id."""
    rank = F.row_number().over(Window.partitionBy("run_id", "wave").orderBy(F.desc("q"), "agent_id")).cast("long")
    return evals.withColumn("rank", rank).where(F.col("rank") <= most).select("run_id", "wave", "agent_id", "q", "rank")


def arm_differences(rows: DataFrame, base: str, other: str) -> DataFrame:
    """pairs, mean, median, per_1000_tokens, per_fetch of the gain in quality of one arm over the base, by task (arm, task, quality,
    tokens, fetches)."""
    a, b = rows.where(F.col("arm") == base), rows.where(F.col("arm") == other)
    both = a.select("task", F.col("quality").alias("qa")).join(b.select("task", F.col("quality").alias("qb"), "tokens", "fetches"), "task")
    gain = F.col("qb") - F.col("qa")
    rate = lambda c, n: F.when(F.sum(c) > 0, n * F.sum(gain) / F.greatest(F.sum(c), F.lit(1)))
    return both.agg(F.count("*").alias("pairs"), F.avg(gain).alias("mean"), F.median(gain).alias("median"), rate("tokens", 1000).alias("per_1000_tokens"), rate("fetches", 1).alias("per_fetch"))


def read_evaluations(lines: DataFrame, column: str = "value") -> DataFrame:
    """run_id, agent_id, wave, q, delta_q, s, p, j, r of evaluation records (JSON texts); those that can't be read are left out."""
    schema = "run_id bigint, agent_id string, oleada int, q double, delta_q double, self_assessment struct<score:double>, peers struct<aggregated_score:double>, virgin_judge struct<score:double>, structural struct<r:double>"
    ok = lines.where(F.try_parse_json(column).isNotNull())
    e = F.from_json(column, schema)
    rows = ok.select(e.alias("e")).where("e.run_id is not null and e.q is not null")
    return rows.select("e.run_id", "e.agent_id", F.col("e.oleada").alias("wave"), "e.q", "e.delta_q", F.col("e.self_assessment.score").alias("s"), F.col("e.peers.aggregated_score").alias("p"), F.col("e.virgin_judge.score").alias("j"), F.col("e.structural.r").alias("r"))


DIMENSIONS = ("grounding", "coverage", "coherence", "novelty")
LISTS = ("strengths", "weaknesses", "missing", "risks")
VERDICTS = ("supported", "contradicted", "unsupported", "unclear")


def validate_rubric(raw: DataFrame, claims: DataFrame) -> DataFrame:
    """run_id, ok, reason and the dimensions, clamped to [0, 1], of rubric answers (run_id, answer: JSON text). A dimension that is no
    number (true and false are none), a missing list of texts, or a claim (run_id, claim_id) without a valid verdict fails
    the whole record."""
    v = F.try_parse_json(F.col("answer"))
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID"))
    number = {d: kind(f"scores.{d}").rlike("^(BIGINT|DOUBLE|DECIMAL|TINYINT|SMALLINT|INT|FLOAT)") for d in DIMENSIONS}
    listed = {n: kind(n).isin("ARRAY<STRING>", "ARRAY<VOID>") for n in LISTS}
    every = lambda xs: [x for x in xs]
    given = F.from_json(F.col("answer"), "verdicts map<string,string>")["verdicts"]
    rows = raw.select("run_id", "answer", v.isNotNull().alias("__json"), *[n.alias(f"__n_{d}") for d, n in number.items()], *[x.alias(f"__l_{n}") for n, x in listed.items()], given.alias("__given"), *[F.try_variant_get(v, f"$.scores.{d}", "double").alias(d) for d in DIMENSIONS])
    judged = rows.select("run_id", F.explode(F.coalesce("__given", F.create_map().cast("map<string,string>"))).alias("claim_id", "verdict")).where(F.col("verdict").isin(*VERDICTS)).select("run_id", "claim_id").distinct()
    lacking = claims.select("run_id", F.col("claim_id").cast("string").alias("claim_id")).join(judged, ["run_id", "claim_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("__lacking"))
    bad = lambda prefix, names: F.array_min(F.array_compact(F.array(*[F.when(~F.col(f"{prefix}{n}"), F.lit(n)) for n in every(names)])))
    rows = rows.join(lacking, "run_id", "left").withColumns({"__bn": bad("__n_", DIMENSIONS), "__bl": bad("__l_", LISTS)})
    reason = F.when(~F.col("__json"), "invalid_json").when(F.col("__bn").isNotNull(), F.concat(F.lit("score:"), "__bn")).when(F.col("__bl").isNotNull(), F.concat(F.lit("list:"), "__bl")).when(F.col("__lacking") > 0, "missing_verdict")
    clamp = lambda c: F.when(reason.isNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))))
    return rows.select("run_id", reason.isNull().alias("ok"), reason.alias("reason"), *[clamp(d).alias(d) for d in DIMENSIONS])


def ingest_items(raw: DataFrame) -> DataFrame:
    """doc_id, item_id, question, difficulty, options of models' exam items (doc_id, answer: JSON text with items). What isn't an object
    with a question and options is left out by itself; defaults are filled in, ids made of the place where there is none."""
    each = raw.select("doc_id", F.posexplode(F.try_variant_get(F.try_parse_json("answer"), "$.items", "array<variant>")).alias("k", "v"))
    get = lambda n: F.trim(F.try_variant_get(F.col("v"), f"$.{n}", "string"))
    options = F.try_variant_get(F.col("v"), "$.options", "array<string>")
    rows = each.where(F.schema_of_variant("v").startswith("OBJECT")).select("doc_id", "k", F.coalesce(get("id"), F.lit("")).alias("id"), get("question").alias("question"), F.coalesce(get("difficulty"), F.lit("medium")).alias("difficulty"), options.alias("options"))
    named = F.when(F.col("id") == "", F.concat(F.lit("q"), (F.col("k") + 1).cast("string"))).when(F.col("id").startswith("q"), F.col("id")).otherwise(F.concat(F.lit("q"), "id"))
    return rows.where("question <> '' and size(options) > 0").select("doc_id", named.alias("item_id"), "question", "difficulty", "options")
