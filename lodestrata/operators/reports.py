"""Tables of a report on runs, composite scores by rubric version, integrity, and gains per cost with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts
from lodestrata.operators.evidence import CREDITED
from lodestrata.operators.frontier import seeded
from lodestrata.tables import stored


def research_report(evals: DataFrame, visits: DataFrame, top: int = 3) -> DataFrame:
    """The tables of a report at once, a row for each run, wave of a run and agent of a run (grain): best_q and who had it, first, last and
    gain of quality over waves, evaluations, fetches and seconds at the end, ranking of the `top` best agents, and papers visited.

    evals: run_id, wave, agent_id, q, fetches and elapsed so far; visits: run_id, agent_id, id. Aggregates of all grains are made in one
    pass; an agent's papers and a wave's ranking are joined to them. Of equal qualities the least agent counts. Evaluations are dealt by
    agent, since a small file's rows would all be sorted for three grains by one task; visits are made distinct once.
    """
    evals = stored(evals.repartition("run_id", "agent_id"), "report-evaluations")
    visits = stored(visits.select("run_id", "agent_id", "id").distinct(), "report-visits")
    best = F.struct(F.col("q").alias("q"), (-F.col("agent_id")).alias("k"), F.col("agent_id").alias("agent_id"))
    at = lambda f: f(F.struct("wave", "q"))["q"]
    sets = evals.groupingSets([["run_id"], ["run_id", "wave"], ["run_id", "agent_id"]], "run_id", "wave", "agent_id").agg(
        F.grouping_id().alias("g"), F.max(best).alias("best"), at(F.min).alias("first_q"), at(F.max).alias("last_q"), F.count("*").alias("evaluations"), F.max("fetches").alias("fetches"), F.max("elapsed").alias("elapsed")
    )
    grain = F.when(F.col("g") == 3, "run").when(F.col("g") == 1, "wave").otherwise("agent")
    place = F.row_number().over(Window.partitionBy("run_id", "wave").orderBy(F.desc("q"), "agent_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "agent_id", "q"))), lambda x: F.format_string("%s=%.2f", x["agent_id"].cast("string"), x["q"])), ", ")
    ranking = evals.withColumn("r", place).where(F.col("r") <= top).groupBy("run_id", "wave").agg(listed.alias("ranking")).withColumn("grain", F.lit("wave"))
    own = visits.groupBy("run_id", "agent_id").agg(F.count("id").alias("papers")).withColumn("grain", F.lit("agent"))
    whole = visits.select("run_id", "id").distinct().groupBy("run_id").agg(F.count("id").alias("all_papers")).withColumn("grain", F.lit("run"))
    rows = sets.withColumn("grain", grain).join(ranking.hint("merge"), ["grain", "run_id", "wave"], "left").join(own.hint("merge"), ["grain", "run_id", "agent_id"], "left").join(whole.hint("merge"), ["grain", "run_id"], "left")
    seen = F.when(F.col("grain") != "wave", F.coalesce("papers", "all_papers", F.lit(0)))
    gain = F.when(F.col("grain") != "wave", F.col("last_q") - F.col("first_q"))
    return rows.select("run_id", "grain", "wave", "agent_id", F.col("best.q").alias("best_q"), F.col("best.agent_id").alias("leader"), "first_q", "last_q", gain.alias("gain"), "evaluations", "fetches", "elapsed", "ranking", seen.alias("papers"))


CHECKS = ("supported_claims_have_evidence", "claim_refs_resolve_to_acquired", "referenced_papers_exist", "confidence_ranges_valid", "no_duplicate_claims", "final_answer_citations_resolve", "budget_accounting_consistent")


def integrity_checks(claims: DataFrame, refs: DataFrame, acquired: DataFrame, papers: DataFrame, citations: DataFrame, budgets: DataFrame) -> DataFrame:
    """run_id, check, failures of the checks of every run with a budget; a check without failures has passed.

    claims: run_id, claim_id, status, confidence, text; refs: run_id, claim_id, paper_id; acquired: run_id, paper_id, content_kind; papers: id;
    citations: run_id, paper_id, that a final answer names; budgets: run_id, fetches_used, max_fetches, tokens_used, max_tokens.
    """
    sure = claims.where(F.col("status").isin("supported", "disputed")).select("run_id", "claim_id")
    own = refs.select("run_id", "claim_id", "paper_id").distinct()
    credited = acquired.where(F.col("content_kind").isin(*CREDITED)).select("run_id", "paper_id").distinct()
    named = lambda rows, name: rows.groupBy("run_id").agg(F.count("*").alias("failures")).select("run_id", F.lit(name).alias("check"), "failures")
    bare = sure.join(own.select("run_id", "claim_id").distinct().hint("merge"), ["run_id", "claim_id"], "left_anti")
    loose = own.join(sure.hint("merge"), ["run_id", "claim_id"], "left_semi").join(credited.hint("merge"), ["run_id", "paper_id"], "left_anti").select("run_id", "claim_id").distinct()
    known = acquired.select("run_id", "paper_id").unionByName(own.select("run_id", "paper_id")).distinct()
    missing = known.join(papers.select(F.col("id").alias("paper_id")).hint("merge"), "paper_id", "left_anti")
    repeated = claims.groupBy("run_id", texts.normal_claim(F.col("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    repeats = repeated.groupBy("run_id").agg(F.sum("n").alias("failures")).select("run_id", F.lit(CHECKS[4]).alias("check"), "failures")
    cited = citations.select("run_id", "paper_id").distinct().join(known.hint("merge"), ["run_id", "paper_id"], "left_anti")
    spent = budgets.where("fetches_used < 0 or tokens_used < 0 or fetches_used > max_fetches or tokens_used > max_tokens")
    out_of_range = claims.where("not (confidence between 0 and 1)")
    found = named(bare, CHECKS[0]).unionByName(named(loose, CHECKS[1])).unionByName(named(missing, CHECKS[2])).unionByName(named(out_of_range, CHECKS[3])).unionByName(repeats).unionByName(named(cited, CHECKS[5])).unionByName(named(spent, CHECKS[6]))
    every = budgets.select("run_id", F.explode(F.array(*[F.lit(x) for x in CHECKS])).alias("check"))
    return every.join(found.hint("merge"), ["run_id", "check"], "left").select("run_id", "check", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


def composite_by_version(dimensions: DataFrame, checks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """run_id, seq, version, integrity, overall, previous, delta of evaluations: the weighted mean (a dimension without a weight has 1) of
    their dimensions (run_id, seq, version, dimension, score) and of `integrity`, the share of checks (run_id, seq, failures) that passed, 1
    without any. previous is the evaluation's before, if that has the same rubric version, else 0."""
    w: Column = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("dimension") == name, value).otherwise(w)
    share = checks.groupBy("run_id", "seq").agg(F.avg((F.col("failures") == 0).cast("double")).alias("integrity"))
    sums = dimensions.groupBy("run_id", "seq", "version").agg(F.sum(w * F.col("score")).alias("s"), F.sum(w).alias("w"))
    own = weights.get("integrity", 1.0)
    rows = sums.join(share.hint("merge"), ["run_id", "seq"], "left").withColumn("integrity", F.coalesce("integrity", F.lit(1.0)))
    rows = rows.withColumn("overall", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s") + own * F.col("integrity")) / (F.col("w") + own))))
    before = F.lag(F.struct("version", "overall")).over(Window.partitionBy("run_id").orderBy("seq"))
    previous = F.when(before["version"] == F.col("version"), before["overall"]).otherwise(0.0)
    return rows.withColumn("previous", previous).select("run_id", "seq", "version", "integrity", "overall", "previous", (F.col("overall") - F.col("previous")).alias("delta"))


POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)  #: fixed values: P(X <= k) of a Poisson variable of mean 1, k = 0 ... 9


def gain_per_cost(rows: DataFrame, base: str, other: str, *, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """measure, value, low, high of the gain in quality of one arm over the base by task (arm, task, quality, tokens, fetches): mean gain,
    gain per 1,000 tokens and per fetch, each a ratio of sums, with percentile intervals of a Poisson bootstrap: in each replicate a task counts
    as often as a seeded Poisson variable of mean 1 says, and all replicates are sums of one aggregate. A ratio without cost is null."""
    a = rows.where(F.col("arm") == base).select("task", F.col("quality").alias("__a"))
    b = rows.where(F.col("arm") == other).select("task", "quality", "tokens", "fetches")
    both = a.join(b.hint("merge"), "task").select("task", (F.col("quality") - F.col("__a")).alias("gain"), "tokens", "fetches")
    each = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    each = each.withColumn("u", seeded(seed, F.col("replicate"), F.col("task")))  # a column of its own, so that it is worked out once and not for each bound
    times = F.when(F.col("replicate") == 0, 1).otherwise(sum(((F.col("u") > p).cast("int") for p in POISSON), F.lit(0)))
    sums = each.withColumn("n", times).groupBy("replicate").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("gain", "tokens", "fetches")], F.sum("n").alias("tasks"))
    ratio = lambda of, by: F.when(F.col(by) > 0, of * F.col("gain") / F.greatest(F.col(by), F.lit(1)))
    told = sums.select("replicate", F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), ratio(of, by).alias("value")) for name, of, by in (("mean", 1, "tasks"), ("per_1000_tokens", 1000, "tokens"), ("per_fetch", 1, "fetches"))])).alias("m")).select("replicate", "m.*")
    sampled = F.when(F.col("replicate") > 0, F.col("value"))
    tail = (1 - level) / 2
    return told.groupBy("measure").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("value"), F.percentile(sampled, tail).alias("low"), F.percentile(sampled, 1 - tail).alias("high"))
