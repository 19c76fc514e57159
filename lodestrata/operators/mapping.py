"""Reference mapping and expansion: reconciling model output, retries, fetch outcomes, accounting, and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.citations import first_rows


def reconcile(batch: DataFrame, responses: DataFrame) -> DataFrame:
    """entry_id, item, matched_by of every entry (entry_id, ordinal): the first response with its id, else the first of its ordinal
    whose id no entry has; null and missing otherwise."""
    by_id = first_rows(responses.where("entry_id is not null"), ["entry_id"], ["position"]).select("entry_id", F.col("item").alias("a"))
    rest = responses.join(batch.select("entry_id"), "entry_id", "left_anti")
    by_ordinal = first_rows(rest.where("ordinal is not null"), ["ordinal"], ["position"]).select("ordinal", F.col("item").alias("b"))
    both = batch.join(by_id, "entry_id", "left").join(by_ordinal, "ordinal", "left")
    how = F.when(F.col("a").isNotNull(), "entry_id").when(F.col("b").isNotNull(), "ordinal").otherwise("missing")
    return both.select("entry_id", F.coalesce("a", "b").alias("item"), how.alias("matched_by"))


def advance_mapping(entries: DataFrame, outcomes: DataFrame, most: int) -> DataFrame:
    """entry_id, attempts, status, error after one attempt: what stays pending after `most` attempts has failed."""
    both = entries.join(outcomes, "entry_id", "left")
    tried = F.col("ok").isNotNull()
    attempts = F.col("attempts") + tried.cast("int")
    status = F.when(F.col("ok"), "mapped").when(tried & (attempts >= most), "mapping_failed").otherwise(F.col("status"))
    error = F.when(F.col("ok"), F.lit(None).cast("string")).when(tried & (attempts >= most), "retry_exhausted").otherwise(F.col("code"))
    return both.select("entry_id", attempts.cast("long").alias("attempts"), status.alias("status"), error.alias("error"))


def classify_fetch(attempts: DataFrame, papers: DataFrame) -> DataFrame:
    """agent_id, id, outcome: transient, absent, mismatch, metadata_only or integrated."""
    both = attempts.join(papers.select("id", F.lit(True).alias("found"), "abstract", "title"), "id", "left")
    outcome = (
        F.when(F.col("error"), "transient")
        .when(F.col("found").isNull(), "absent")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("title", F.col("expected"))), "mismatch")
        .when(F.col("abstract").isNull(), "metadata_only")
        .otherwise("integrated")
    )
    return both.select("agent_id", "id", outcome.alias("outcome"))


def job_accounting(entries: DataFrame) -> DataFrame:
    """One row for each job: entries by status, distinct resolved ids, and the job's own status."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = entries.groupBy("job_id").agg(F.count("*").alias("entries"), n("mapped").alias("mapped"), n("unparsed").alias("unparsed"), n("failed").alias("failed"), n("pending").alias("pending"), F.countDistinct("canonical_id").alias("resolved"))
    status = F.when(F.col("pending") > 0, "incomplete").when(F.col("failed") == F.col("entries"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return rows.withColumn("status", status)


def expand(nodes: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """id, direction, neighbor, rank: of the first provider that has any for the node and direction, `most` different ones, in the
    provider's order; a node is no neighbour of itself."""
    own = candidates.join(nodes, "id").where("neighbor <> id")
    first = own.groupBy("id", "direction").agg(F.min("provider_rank").alias("provider_rank"))
    rows = own.join(first, ["id", "direction", "provider_rank"]).groupBy("id", "direction", "neighbor").agg(F.min("ordinal").alias("ordinal"))
    rank = F.row_number().over(Window.partitionBy("id", "direction").orderBy("ordinal", "neighbor")).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "direction", "neighbor", "rank")


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, rows new to the cache): each different text that the cache lacks is embedded once, by embed, a
    function from DataFrame (text_hash, text) to (text_hash, embedding), such as one that calls mapInPandas."""
    keyed = texts.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    missing = keyed.join(cache.select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.min("text").alias("text"))
    new = embed(missing)
    return keyed.join(cache.unionByName(new), "text_hash", "left"), new


def merge_priorities(frontier: DataFrame, scores: DataFrame, most: int = 30) -> DataFrame:
    """agent_id, id, priority, source: the model's score for the first `most` candidates it was asked for, else eta."""
    both = frontier.join(scores, ["agent_id", "id"], "left")
    scored = F.col("score").isNotNull() & (F.col("ordinal") <= most)
    return both.select("agent_id", "id", F.when(scored, F.col("score")).otherwise(F.col("eta")).alias("priority"), F.when(scored, "model").otherwise("eta").alias("source"))


def register_aliases(aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """aliases and the keys of resolved entries (keys array, id) that are new and not the id itself; the first by id counts."""
    new = resolved.select(F.explode("keys").alias("alias"), F.col("id").alias("canonical_id")).where("alias <> canonical_id").groupBy("alias").agg(F.min("canonical_id").alias("canonical_id"))
    return aliases.unionByName(new.hint("merge").join(aliases.select("alias"), "alias", "left_anti"))


def composite(dimensions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """key, score: the weighted mean of a rubric's dimensions; a dimension without a weight has 1."""
    w: Column = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("dimension") == name, value).otherwise(w)
    return dimensions.groupBy("key").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))
