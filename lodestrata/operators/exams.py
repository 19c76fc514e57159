"""Examinations: item checks, splits, scores, paired comparison of two arms, and selection of a survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.operators.ranks import ranked
from lodestrata.tables import stored

#: Fixed values.
CATEGORIES = ("concepts_definitions", "method_experimental_design", "results_interpretation", "assumptions_limitations", "cross_paper", "transfer_application")
DIFFICULTIES = ("easy", "medium", "hard")
LEAKS = ("all of the above", "none of the above", "both a and b", "always correct")


def leakage(question: Column, options: Column, key: Column) -> Column:
    """Whether the key can be guessed: it or the question holds a banned phrase, or it is the longest option and over 1.6 times
    the shortest. No key is a leak."""
    phrase = "|".join(LEAKS)
    own = F.get(F.transform(F.filter(options, lambda o: o["id"] == key), lambda o: F.trim(o["text"])), F.lit(0))
    sizes = F.transform(options, lambda o: F.char_length(F.trim(o["text"])))
    long = (F.char_length(own) == F.array_max(sizes)) & (F.array_min(sizes) > 0) & (F.array_max(sizes) > 1.6 * F.array_min(sizes))
    return F.coalesce(key, F.lit("")).eqNullSafe("") | F.coalesce(F.lower(own).rlike(phrase), F.lit(False)) | F.coalesce(F.lower(question).rlike(phrase), F.lit(False)) | F.coalesce(long, F.lit(False))


def validate_items(items: DataFrame, pack: DataFrame) -> DataFrame:
    """item_id, reasons of items (question, options, correct_option_id, evidence, category, difficulty, critic): codes in a fixed
    order, none if the item is sound. evidence is an array of the pack's source ids."""
    refs = items.select("item_id", F.explode("evidence").alias("source_id")).hint("merge").join(pack.select("source_id").distinct(), "source_id", "left_anti")
    rows = items.join(refs.select("item_id").distinct().withColumn("lost", F.lit(True)), "item_id", "left")
    names = F.transform("options", lambda o: o["id"])
    bad = (F.size("options") != 4) | (F.size(F.array_distinct(names)) != F.size("options")) | F.exists("options", lambda o: F.trim(o["text"]) == "") | (F.trim("question") == "")
    key = F.coalesce("correct_option_id", F.lit(""))
    reasons = F.array_compact(F.array(
        F.when(bad, F.lit("invalid_schema")),
        F.when(key == "", F.lit("missing_key")).when(~F.array_contains(names, key), F.lit("key_not_in_options")),
        F.when(F.size("evidence") == 0, F.lit("missing_evidence")).when(F.col("lost"), F.lit("unresolved_evidence")),
        F.when(~F.col("category").isin(*CATEGORIES), F.lit("invalid_category")),
        F.when(~F.col("difficulty").isin(*DIFFICULTIES), F.lit("invalid_difficulty")),
        F.when(leakage(F.col("question"), F.col("options"), F.col("correct_option_id")), F.lit("answer_leakage")),
        F.when(F.col("critic") == "rejected", F.lit("critic_rejected")),
    ))
    return rows.select("item_id", F.array_join(reasons, ",").alias("reasons"))


def _for_each_responder(items: DataFrame, answers: DataFrame, most: int = 10_000) -> DataFrame:
    """items with responder, once for each of those in answers: the arms of an examination, `most` at most, else an error."""
    names = [x.responder for x in answers.select("responder").where("responder is not null").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} responders")
    return items.withColumn("responder", F.explode(F.array(*[F.lit(x) for x in sorted(names)]).cast("array<string>")))


def validate_answers(answers: DataFrame, questions: DataFrame, options: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """responder, item_id, option_id, reason of every pair of responder and question and every answer to none: missing,
    invalid_option, unknown_question or null."""
    wanted = _for_each_responder(questions.select("item_id", F.lit(True).alias("known")), answers)
    both = wanted.hint("merge").join(answers.withColumn("given", F.lit(True)), ["responder", "item_id"], "full")
    reason = F.when(F.col("known").isNull(), "unknown_question").when(F.col("given").isNull(), "missing").when(~F.col("option_id").isin(*options), "invalid_option")
    return both.select("responder", "item_id", "option_id", reason.alias("reason"))


def graded(answers: DataFrame, items: DataFrame) -> DataFrame:
    """responder, item_id, category, difficulty, correct of every responder and item; what is missing is wrong."""
    wanted = _for_each_responder(items, answers)
    both = wanted.hint("merge").join(answers, ["responder", "item_id"], "left")
    return both.select("responder", "item_id", "category", "difficulty", F.coalesce(F.col("option_id") == F.col("correct_option_id"), F.lit(False)).alias("correct"))


def score_exam(answers: DataFrame, items: DataFrame) -> DataFrame:
    """responder, dimension, bucket, correct, total: in all, by category and by difficulty, in one pass."""
    rows = graded(answers, items)
    sets = rows.groupingSets([["responder"], ["responder", "category"], ["responder", "difficulty"]], "responder", "category", "difficulty").agg(F.grouping_id().alias("g"), F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "category").otherwise("difficulty")
    return sets.select("responder", kind.alias("dimension"), F.coalesce("category", "difficulty", F.lit("all")).alias("bucket"), "correct", "total")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """item_id, first, second: whether each arm has it right, over the items of either; missing is wrong."""
    x, y = a.select("item_id", F.col("correct").alias("first")), b.select("item_id", F.col("correct").alias("second"))
    return x.join(y, "item_id", "full").select("item_id", F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("second", F.lit(False)).alias("second"))


def paired_ci(pairs: DataFrame) -> DataFrame:
    """n, mean, low, high of first less second: mean and 1.96 standard errors; without pairs null, with one the point."""
    d = F.col("first").cast("int") - F.col("second").cast("int")
    half = F.when(F.count("*") > 1, 1.96 * F.stddev_samp(d) / F.sqrt(F.greatest(F.count("*"), F.lit(1)))).otherwise(0.0)
    return pairs.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), (F.avg(d) - half).alias("low"), (F.avg(d) + half).alias("high"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    a, b = F.col("first"), F.col("second")
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


def partition_bank(items: DataFrame, selection: int, holdout: int, seed: int) -> DataFrame:
    """item_id, part: by a seeded hash, the first for selection, the next held out; others are left out."""
    order = [F.col("h"), F.col("item_id")]
    first = items.select("item_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string")), 256).alias("h")).orderBy(*order).limit(selection + holdout)
    rank = F.row_number().over(Window.orderBy(*order))  # of the rows that are left, as many as asked for
    return first.select("item_id", F.when(rank <= selection, "selection").otherwise("holdout").alias("part"))


def reject_near_duplicates(items: DataFrame, least: float = 0.85) -> DataFrame:
    """item_id, accepted: in order of id, an item is rejected if its words' Jaccard with an earlier accepted one is `least` or more.

    Pairs come from shared words among each item's rarest; then, in rounds, items whose earlier likes are all decided are decided.
    """
    words = items.select("item_id", F.array_distinct(F.filter(F.split(F.lower("question"), "[^a-z0-9]+"), lambda x: x != "")).alias("w"))
    df = words.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    ranked = words.select("item_id", F.explode("w").alias("x")).hint("merge").join(df, "x").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
    take = F.size("s") - F.ceil(F.lit(least) * F.size("s")).cast("int") + 1
    keys = ranked.select("item_id", F.explode(F.slice("s", F.lit(1), take)).alias("k")).select("item_id", F.col("k.x").alias("x"))
    pairs = keys.hint("merge").join(keys.withColumnRenamed("item_id", "earlier"), "x").where("earlier < item_id").select("item_id", "earlier").distinct()
    both = pairs.hint("merge").join(words, "item_id").hint("merge").join(words.select(F.col("item_id").alias("earlier"), F.col("w").alias("v")), "earlier")
    alike = stored(both.where(ids.jaccard(F.col("w"), F.col("v")) >= least).select("item_id", "earlier"), "alike")
    decided = items.select("item_id").join(alike.select("item_id").distinct(), "item_id", "left_anti").withColumn("accepted", F.lit(True))
    open_ = alike
    while not open_.isEmpty():
        known = open_.join(decided.select(F.col("item_id").alias("earlier"), "accepted"), "earlier", "left")
        state = known.groupBy("item_id").agg(F.max(F.col("accepted").cast("int")).alias("hit"), F.max(F.col("accepted").isNull().cast("int")).alias("waits"))
        now = state.where("hit = 1 or waits = 0").select("item_id", (F.coalesce("hit", F.lit(0)) == 0).alias("accepted"))
        decided = stored(decided.unionByName(now), "decided")
        open_ = stored(open_.join(decided.select("item_id"), "item_id", "left_anti"), "open")
    return decided


def score_multiselect(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """item_id, exact, partial: whether the chosen set is the key, without repeats or letters that are no option; and their Jaccard."""
    both = questions.join(responses, "item_id", "left").withColumn("chosen", F.coalesce("chosen", F.array().cast("array<string>")))
    valid = (F.size(F.array_distinct("chosen")) == F.size("chosen")) & (F.size(F.array_except("chosen", "options")) == 0)
    exact = valid & (F.array_sort("chosen") == F.array_sort("key"))
    return both.select("item_id", exact.alias("exact"), ids.jaccard(F.col("chosen"), F.col("key"), empty=1.0).alias("partial"))


def distribution_issues(items: DataFrame, quotas: DataFrame, column: str) -> DataFrame:
    """label, found, wanted where the number of items with a label is not its quota; a label of either side alone is an issue."""
    found = items.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("found"))
    both = found.join(quotas, "label", "full").select("label", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(0)).cast("long").alias("wanted"))
    return both.where("found <> wanted")


def select_survivor(candidates: DataFrame) -> DataFrame:
    """agent_id, terminal, rank: 0.7 selection + 0.2 process + 0.1 grounding to six places, by it, selection, grounding, process, id."""
    terminal = F.round(0.7 * F.col("selection") + 0.2 * F.col("process") + 0.1 * F.col("grounding"), 6)
    order = [F.desc("terminal"), F.desc("selection"), F.desc("grounding"), F.desc("process"), F.asc("agent_id")]
    return ranked(candidates.withColumn("terminal", terminal), order).select("agent_id", "terminal", "rank")


def blueprint(papers: DataFrame, quotas: DataFrame, seed: int, most: int = 10_000) -> DataFrame:
    """paper_id, question_id, label: each paper's questions with the quotas' labels in a seeded order. The quotas are a
    manifest's, `most` labels at most, else an error."""
    rows = quotas.select("label", "wanted").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    wanted = [(x.label, k) for x in rows for k in range(1, x.wanted + 1)]
    labels = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("k")) for label, k in wanted])
    rows = papers.select("paper_id", F.inline(labels))
    order = Window.partitionBy("paper_id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("paper_id").cast("string"), "label", F.col("k").cast("string")), 256))
    return rows.select("paper_id", "label", F.row_number().over(order).alias("n")).select("paper_id", F.format_string("%s-q%03d", F.col("paper_id").cast("string"), "n").alias("question_id"), "label")


def critic_gate(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """item_id, kept: accepted, supported by evidence and with the key as the set of defensible options."""
    both = questions.select("item_id", "key").join(verdicts, "item_id", "left")
    ok = F.col("accepted") & F.col("evidence_ok") & (F.array_sort("defensible") == F.array_sort("key"))
    return both.select("item_id", F.coalesce(ok, F.lit(False)).alias("kept"))


def validate_suite(questions: DataFrame, papers: DataFrame, quotas: dict[str, dict[str, int]], *, options: int = 4, per_paper: int = 100) -> DataFrame:
    """code, question_id, detail of what is wrong in a bank of questions (question_id, paper_id, category, difficulty, options:
    letters, correct: letters, evidence: paper ids, critic): repeated ids, unknown papers, options that aren't A, B and so on, keys
    outside them, evidence missing or of unknown papers, no critic, papers with another number of questions, and papers whose
    categories, difficulties or key sizes differ from the quotas (a label of one side alone too)."""
    known = papers.select("paper_id").distinct()
    repeated = questions.groupBy("question_id").count().where("count > 1").select(F.lit("duplicate_question_id").alias("code"), "question_id", F.col("question_id").alias("detail"))
    strange = questions.join(known, "paper_id", "left_anti").select(F.lit("unknown_paper").alias("code"), "question_id", F.col("paper_id").alias("detail"))
    own = stored(questions.join(known, "paper_id", "left_semi"), "suite")
    letters = F.array(*[F.lit(chr(65 + k)) for k in range(options)])
    key = (F.size("correct") == 0) | (F.size(F.array_except("correct", "options")) > 0)
    codes = F.array_compact(F.array(
        F.when(F.col("options") != letters, F.lit("invalid_options")),
        F.when(key, F.lit("invalid_answer_key")),
        F.when(F.size("evidence") == 0, F.lit("missing_evidence")),
        F.when(F.coalesce("critic", F.lit("")) == "", F.lit("missing_critic_validation")),
    ))
    none = F.lit(None).cast("string")
    rows = own.select(F.explode(codes).alias("code"), "question_id", none.alias("detail"))
    foreign = own.select("question_id", F.explode("evidence").alias("paper_id")).hint("merge").join(known, "paper_id", "left_anti").select(F.lit("unknown_evidence_paper").alias("code"), "question_id", none.alias("detail")).distinct()
    number = known.join(own.groupBy("paper_id").count(), "paper_id", "left").where(F.coalesce("count", F.lit(0)) != per_paper).select(F.lit("invalid_paper_question_count").alias("code"), none.alias("question_id"), F.col("paper_id").alias("detail"))
    out = repeated.unionByName(strange).unionByName(rows).unionByName(foreign).unionByName(number)
    for name, column in (("category", F.col("category")), ("difficulty", F.col("difficulty")), ("correct_option_count", F.size("correct").cast("string"))):
        wanted = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(n).cast("long").alias("wanted")) for k, n in quotas[name].items()])
        found = own.groupBy("paper_id", column.alias("label")).agg(F.count("*").alias("found"))
        both = found.join(known.select("paper_id", F.inline(wanted)).hint("merge"), ["paper_id", "label"], "full").where("not found <=> wanted")
        out = out.unionByName(both.select(F.lit(f"invalid_{name}_distribution").alias("code"), none.alias("question_id"), F.col("paper_id").alias("detail")).distinct())
    return out


def naive_sources(pack: DataFrame, distance: str = "direct_reference") -> DataFrame:
    """The pack's sources that the untrained arm may read: those at the baseline's distance."""
    return pack.where((F.col("status") == "included") & (F.col("distance") == distance))


PRIVATE = ("correct_option_id", "rationale", "answer_key", "evidence_refs")  #: fixed values: names that no public table has


def assert_public(df: DataFrame, payload: str | None = None) -> DataFrame:
    """df, if no column (nor a field of a nested one, nor a key of the JSON objects in `payload`) is private; else an error."""

    def names(kind) -> list[str]:
        if hasattr(kind, "fields"):
            return [x for f in kind.fields for x in (f.name, *names(f.dataType))]
        inner = [getattr(kind, x) for x in ("elementType", "valueType") if hasattr(kind, x)]
        return [x for k in inner for x in names(k)]

    leaked = sorted(set(PRIVATE) & set(names(df.schema)))
    if payload and not leaked:
        held = F.json_object_keys(F.col(payload))
        leaked = sorted({x.k for x in df.select(F.explode(F.array_intersect(held, F.array(*[F.lit(x) for x in PRIVATE]))).alias("k")).distinct().collect()})  # names of PRIVATE
    if leaked:
        raise ValueError(f"private columns in a public table: {', '.join(leaked)}")
    return df


def answer_cost(answers: DataFrame) -> DataFrame:
    """responder, part, answers, tokens, seconds: sums over the answers of each responder and part of the bank."""
    return answers.groupBy("responder", "part").agg(F.count("*").alias("answers"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))


def exam_outcome(items: DataFrame, answers: DataFrame, candidates: DataFrame, *, selection: int, holdout: int, seed: int) -> DataFrame:
    """One row for an examination: how many items are sound, selected and held out, the survivor by its score on the selection,
    its uplift over the naive arm on what was held out with its interval, and an outcome code.

    items: item_id, question, category, difficulty, correct_option_id, sound. answers: responder (agents as text, and 'naive'),
    item_id, option_id. candidates: agent_id, process, grounding."""
    sound = stored(items.where("sound"), "exam-items")
    parts = stored(partition_bank(sound, selection, holdout, seed), "exam-parts")
    marks = stored(graded(answers, sound).join(parts, "item_id"), "exam-marks")
    share = marks.where("part = 'selection' and responder <> 'naive'").groupBy(F.col("responder").alias("agent_id")).agg(F.avg(F.col("correct").cast("double")).alias("selection"))
    best = stored(select_survivor(candidates.join(share, "agent_id")).where("rank = 1").select(F.col("agent_id").alias("survivor"), "terminal"), "exam-survivor")
    held = marks.where("part = 'holdout'")
    own = held.join(best, F.col("responder") == F.col("survivor"), "left_semi")
    pairs = paired(own, held.where("responder = 'naive'"))
    ci = paired_ci(pairs)
    sizes = parts.agg(F.count_if(F.col("part") == "selection").alias("selected"), F.count_if(F.col("part") == "holdout").alias("held"))
    row = sizes.join(F.broadcast(ci)).join(F.broadcast(best), how="left")  # one row each
    code = F.when(F.col("survivor").isNull(), "no_survivor").when(F.col("held") == 0, "no_holdout").when(F.col("low") > 0, "uplift").when(F.col("high") < 0, "regression").otherwise("inconclusive")
    return row.select("selected", "held", "survivor", "terminal", "n", "mean", "low", "high", code.alias("outcome"))


def benchmark_scores(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """dimension, bucket, questions, exact, partial of a multi-select bank: in all, by category, difficulty and paper."""
    rows = questions.select("item_id", "category", "difficulty", "paper_id").join(score_multiselect(questions, responses), "item_id")
    kinds = F.array(*[F.struct(F.lit(n).alias("dimension"), (F.lit("all") if n == "all" else F.col(n).cast("string")).alias("bucket")) for n in ("all", "category", "difficulty", "paper_id")])
    each = rows.select("exact", "partial", F.explode(kinds).alias("d"))
    return each.groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("questions"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg("partial").alias("partial"))
