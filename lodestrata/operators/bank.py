"""Question banks and their outcomes: scores by source, eligibility of candidates, whole splits, public tables, frozen keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import texts
from lodestrata.operators.exams import graded, partition_bank
from lodestrata.operators.ranks import ranked
from lodestrata.operators.segments import chunk_text

#: Why a candidate can't survive.
NO_DOSSIER, NO_PROVENANCE, NO_RESPONSE, LOW_COVERAGE = "no_evidence_bearing_dossier", "provenance_integrity_failed", "no_selection_response", "below_min_examination_coverage"


def with_sources(items: DataFrame, pack: DataFrame) -> DataFrame:
    """items (item_id, source_distance, evidence: source ids) with the distance that the pack (source_id, source_distance, content_kind) gives
    the first of their sources, else their own, and with content_kind, that of the first source that the pack has."""
    each = items.select("item_id", F.posexplode("evidence").alias("at", "source_id"))
    met = each.join(pack.select("source_id", F.col("source_distance").alias("far"), "content_kind").hint("merge"), "source_id")
    first = met.groupBy("item_id").agg(F.min_by("content_kind", "at").alias("content_kind"), F.max(F.when(F.col("at") == 0, F.col("far"))).alias("far"))
    rows = items.drop("content_kind").join(first.hint("merge"), "item_id", "left")
    return rows.withColumn("source_distance", F.coalesce("far", "source_distance")).drop("far")


def score_exam(answers: DataFrame, items: DataFrame, pack: DataFrame) -> DataFrame:
    """responder, dimension, bucket, correct, total: in all, by category, difficulty, source distance and content kind, in one pass. What is
    missing is wrong; an item without a source in the pack has no content kind."""
    own = with_sources(items, pack).select("item_id", "source_distance", "content_kind")
    rows = graded(answers, items).join(own.hint("merge"), "item_id")
    kinds = ("category", "difficulty", "source_distance", "content_kind")
    sets = rows.groupingSets([["responder"], *(["responder", k] for k in kinds)], "responder", *kinds).agg(F.grouping_id().alias("g"), F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    kind = F.when(F.col("g") == 15, "all")
    for k, name in enumerate(kinds):
        kind = kind.when(F.col("g") == 15 - (8 >> k), name)
    rows = sets.select("responder", kind.alias("dimension"), F.when(F.col("g") == 15, "all").otherwise(F.coalesce(*kinds)).alias("bucket"), "correct", "total")
    return rows.where("bucket is not null")


def eligibility(min_coverage: float) -> Column:
    """Why a candidate (has_dossier, provenance, selection, answered, coverage) can't survive, or null; the first reason counts."""
    return (
        F.when(~F.col("has_dossier"), NO_DOSSIER)
        .when(~F.col("provenance"), NO_PROVENANCE)
        .when(F.col("selection").isNull() | (F.col("answered") <= 0), NO_RESPONSE)
        .when(F.col("coverage") < min_coverage, LOW_COVERAGE)
    )


def select_survivor(candidates: DataFrame, min_coverage: float = 0.5, weights: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """agent_id, reason, terminal, rank, survivor, process_peak of candidates (agent_id, selection, process, grounding and those of `eligibility`):
    eligible ones are ranked by their weighted score to six places, selection, grounding, process and id; the first survives; the
    process peak is whoever has most process, eligible or not (of equals the least id)."""
    a, b, c = weights
    rows = candidates.withColumn("reason", eligibility(min_coverage))
    terminal = F.round(a * F.coalesce("selection", F.lit(0.0)) + b * F.col("process") + c * F.col("grounding"), 6)
    fit = rows.where("reason is null").withColumn("terminal", terminal)
    order = [F.desc("terminal"), F.desc(F.coalesce("selection", F.lit(0.0))), F.desc("grounding"), F.desc("process"), F.asc("agent_id")]
    places = ranked(fit.select("agent_id", "terminal", "selection", "grounding", "process"), order).select("agent_id", "terminal", "rank")
    peak = candidates.agg(F.min(F.struct((-F.col("process")).alias("p"), "agent_id"))["agent_id"].alias("peak"))
    out = rows.select("agent_id", "reason").join(places.hint("merge"), "agent_id", "left").join(F.broadcast(peak))  # one row
    return out.select("agent_id", "reason", "terminal", "rank", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("survivor"), (F.col("agent_id") == F.col("peak")).alias("process_peak"))


def split_bank(items: DataFrame, selection: int, holdout: int, seed: int) -> DataFrame:
    """`exams.partition_bank`, but a bank with too few items is an error."""
    n = items.count()
    if n < selection + holdout:
        raise ValueError(f"{selection + holdout} items are wanted and the bank has {n}")
    return partition_bank(items, selection, holdout, seed)


def bank_issues(items: DataFrame, parts: DataFrame, key: DataFrame) -> DataFrame:
    """code, item_id of what makes a split (item_id, part) of a bank unsound: in both parts, not in the bank, without a key, or a key for
    no item."""
    both = parts.select("item_id", "part").distinct().groupBy("item_id").count().where("count > 1").select(F.lit("in_both_parts").alias("code"), "item_id")
    ids = items.select("item_id").distinct()
    lost = parts.select("item_id").distinct().join(ids.hint("merge"), "item_id", "left_anti").select(F.lit("not_in_bank").alias("code"), "item_id")
    own = key.where("correct_option_id is not null and correct_option_id <> ''").select("item_id").distinct()
    bare = parts.select("item_id").distinct().join(own.hint("merge"), "item_id", "left_anti").select(F.lit("without_key").alias("code"), "item_id")
    extra = key.select("item_id").distinct().join(ids.hint("merge"), "item_id", "left_anti").select(F.lit("key_without_item").alias("code"), "item_id")
    return both.unionByName(lost).unionByName(bare).unionByName(extra)


def frozen_key(items: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, part, correct_option_id, entry_hash; part, entries, key_hash): the key of a split, and a digest of each part's entries in order of
    id, by which a changed key is found."""
    rows = parts.join(items.select("item_id", "correct_option_id").hint("merge"), "item_id")
    entry = texts.sha256_text(F.concat_ws("|", F.col("item_id").cast("string"), F.coalesce("correct_option_id", F.lit(""))))
    rows = rows.select("item_id", "part", "correct_option_id", entry.alias("entry_hash"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "entry_hash"))), lambda x: x["entry_hash"]), ",")
    return rows, rows.groupBy("part").agg(F.count("*").alias("entries"), texts.sha256_text(whole).alias("key_hash"))


def public_outcome(checked: DataFrame, parts: DataFrame, marks: DataFrame) -> DataFrame:
    """section, label, part, n, correct: what may be published of an exam, without keys. How many items were generated, accepted and rejected, for
    which reasons (checked: item_id, reasons with commas), the sizes of the parts, and each responder's outcome on each part by category
    and difficulty (marks: responder, item_id, category, difficulty, correct)."""
    none = F.lit(None).cast("string")
    ok = F.col("reasons") == ""
    counts = checked.select(F.explode(F.array(F.lit("generated"), F.when(ok, "accepted").otherwise("rejected"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    why = checked.where(~ok).select(F.explode(F.split("reasons", ",")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    rows = marks.join(parts.hint("merge"), "item_id")
    kinds = F.array(F.lit("all"), F.concat(F.lit("category:"), "category"), F.concat(F.lit("difficulty:"), "difficulty"))
    buckets = rows.select("responder", "part", "correct", F.explode(kinds).alias("kind")).groupBy(F.concat_ws("|", "responder", "kind").alias("label"), "part").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    zero = F.lit(None).cast("long")
    return (
        counts.select(F.lit("items").alias("section"), "label", none.alias("part"), "n", zero.alias("correct"))
        .unionByName(why.select(F.lit("rejections").alias("section"), "label", none.alias("part"), "n", zero.alias("correct")))
        .unionByName(sizes.select(F.lit("parts").alias("section"), F.lit("size").alias("label"), "part", "n", zero.alias("correct")))
        .unionByName(buckets.select(F.lit("outcomes").alias("section"), "label", "part", "n", "correct"))
    )


def exam_buckets(events: DataFrame) -> DataFrame:
    """run_id, kind, bucket, correct, total: the buckets that each run's last benchmark_completed event gives (payload: JSON with by_category,
    by_difficulty, naive_by_category and naive_by_difficulty, each bucket with correct and total)."""
    last = events.where("type = 'benchmark_completed'").groupBy("run_id").agg(F.max_by("payload", "seq").alias("payload"))
    each = None
    for kind in ("by_category", "by_difficulty", "naive_by_category", "naive_by_difficulty"):
        given = F.from_json(F.get_json_object("payload", f"$.{kind}"), "map<string,struct<correct:bigint,total:bigint>>")
        rows = last.select("run_id", F.lit(kind).alias("kind"), F.explode(given).alias("bucket", "b")).select("run_id", "kind", "bucket", F.coalesce("b.correct", F.lit(0)).alias("correct"), F.coalesce("b.total", F.lit(0)).alias("total"))
        each = rows if each is None else each.unionByName(rows)
    return each


def evidence_rows(papers: DataFrame, *, size: int = 12_000, most: int = 8, excerpt: int = 240) -> DataFrame:
    """evidence_id, paper_id, content_kind, locator, content_hash, excerpt of papers (id, fulltext, abstract): a row for each chunk of the full text
    (`most` of `size` characters, as a paper's evidence is bounded; blank ones have none), else one of the abstract."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    full = papers.where(~blank("fulltext")).select("id", F.lit("full_text").alias("content_kind"), F.explode(chunk_text(F.col("fulltext"), size, most)).alias("x")).select("id", "content_kind", F.concat(F.lit("chunk:"), F.col("x.i").cast("string")).alias("locator"), "x.text")
    short = papers.where(blank("fulltext") & ~blank("abstract")).select("id", F.lit("abstract").alias("content_kind"), F.lit("abstract").alias("locator"), F.col("abstract").alias("text"))
    rows = full.unionByName(short)
    return rows.select(texts.stable_id("ev", F.col("id"), F.col("locator")).alias("evidence_id"), F.col("id").alias("paper_id"), "content_kind", "locator", texts.sha256_text(F.col("text")).alias("content_hash"), texts.excerpt(F.col("text"), excerpt).alias("excerpt"))


def evaluation_summary(lines: DataFrame, column: str = "payload") -> DataFrame:
    """run_id, agent_id, wave, turn, q, delta_q, s, p, j, r of evaluation records (run_id, a JSON text); what isn't there is null, and a text that is
    no JSON has no row."""
    of = lambda path, kind: F.get_json_object(column, f"$.{path}").try_cast(kind)
    rows = lines.where(F.get_json_object(column, "$").isNotNull())
    return rows.select("run_id", of("agent_id", "string").alias("agent_id"), of("oleada", "long").alias("wave"), of("turn", "long").alias("turn"), of("q", "double").alias("q"), of("delta_q", "double").alias("delta_q"), of("self_assessment.score", "double").alias("s"), of("peers.aggregated_score", "double").alias("p"), of("virgin_judge.score", "double").alias("j"), of("structural.r", "double").alias("r"))


def bank_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text of the lines of question banks that aren't blank, numbered from 1. A bank is one file and read as a whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("k", "text"))
    return rows.where(F.trim("text") != "").select("file", (F.col("k") + 1).cast("long").alias("line"), "text")


def bank_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, line, reason of lines that are no question: no JSON object, or without id, question, options or key."""
    v = F.try_parse_json("text")
    has = lambda n: F.coalesce(F.length(F.try_variant_get(v, f"$.{n}", "string")), F.lit(0)) > 0
    reason = (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no_object")
        .when(~has("question_id"), "no_question_id")
        .when(~has("question"), "no_question")
        .when(F.coalesce(F.size(F.try_variant_get(v, "$.options", "array<variant>")), F.lit(0)) < 1, "no_options")
        .when(F.coalesce(F.size(F.try_variant_get(v, "$.correct_option_ids", "array<string>")), F.lit(0)) < 1, "no_key")
    )
    return bank_lines(spark, path).select("file", "line", reason.alias("reason")).where("reason is not null")
