"""Evidence memory: claims and what supports them, ledger rules, concepts and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts
from lodestrata.operators.ranks import ranked
from lodestrata.tables import stored

CREDITED = ("full_text", "abstract")
MOST_WORDS, MOST_ALONE = 200_000, 1_000  #: words of questions, to be broadcast; questions that no claim shares a word with


def resolving(refs: DataFrame, acquired: DataFrame) -> DataFrame:
    """refs whose paper was acquired as full text or abstract."""
    return refs.join(acquired.where(F.col("content_kind").isin(*CREDITED)).select("paper_id").distinct(), "paper_id", "left_semi")


def enforce_ledger(claims: DataFrame, acquired: DataFrame) -> DataFrame:
    """claims with status and demoted: supported and disputed claims without acquired evidence become proposed."""
    backed = resolving(claims.select("claim_id", "paper_id"), acquired).select("claim_id").distinct().withColumn("__backed", F.lit(True))
    rows = claims.join(backed, "claim_id", "left")
    demoted = F.col("status").isin("supported", "disputed") & F.col("__backed").isNull()
    return rows.withColumn("demoted", demoted).withColumn("status", F.when(F.col("demoted"), "proposed").otherwise(F.col("status"))).drop("__backed")


def apply_verdicts(claims: DataFrame, verdicts: DataFrame, acquired: DataFrame) -> DataFrame:
    """claim_id, before, status of all claims after verdicts (claim_id, verdict): unsupported ones become proposed, contradicted
    ones disputed if their evidence was acquired (else proposed), supported promotes acquired-backed proposed ones."""
    backed = resolving(claims.select("claim_id", "paper_id"), acquired).select("claim_id").distinct().withColumn("backed", F.lit(True))
    rows = claims.join(verdicts, "claim_id", "left").join(backed, "claim_id", "left").withColumn("backed", F.coalesce("backed", F.lit(False)))
    status = (
        F.when(F.col("verdict") == "unsupported", "proposed")
        .when((F.col("verdict") == "contradicted") & F.col("backed"), "disputed")
        .when(F.col("verdict") == "contradicted", "proposed")
        .when((F.col("verdict") == "supported") & (F.col("status") == "proposed") & F.col("backed"), "supported")
        .otherwise(F.col("status"))
    )
    return rows.select("claim_id", F.col("status").alias("before"), status.alias("status"))


def merge_claims(claims: DataFrame, acquired: DataFrame) -> DataFrame:
    """One row for each normal text: least claim_id, greatest confidence, number of papers, supported if any is and any of its
    papers was acquired; and, where claims have them, the union of concepts (sorted) and the evidence (an array of structs
    with evidence_id), each id once, and the greatest updated_seq."""
    rows = claims.join(acquired.where(F.col("content_kind").isin(*CREDITED)).select("paper_id", F.lit(True).alias("ok")).distinct(), "paper_id", "left")
    rows = rows.withColumn("key", texts.normal_claim(F.col("text")))
    more = [F.max("updated_seq").alias("updated_seq")] if "updated_seq" in claims.columns else []
    out = rows.groupBy("key").agg(
        F.min("claim_id").alias("claim_id"),
        F.max("confidence").alias("confidence"),
        F.countDistinct("paper_id").alias("papers"),
        (F.max((F.col("status") == "supported").cast("int")) * F.max(F.coalesce(F.col("ok"), F.lit(False)).cast("int")) == 1).alias("supported"),
        *more,
    )
    if "concepts" in claims.columns:
        each = rows.select("key", F.explode("concepts").alias("concept")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
        out = out.join(each.hint("merge"), "key", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    if "evidence" in claims.columns:
        refs = rows.select("key", "claim_id", F.explode("evidence").alias("e"))
        first = refs.groupBy("key", F.col("e.evidence_id").alias("evidence_id")).agg(F.min_by("e", "claim_id").alias("e"))
        out = out.join(first.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("evidence")).hint("merge"), "key", "left")
    return out


def grounding(claims: DataFrame, acquired: DataFrame) -> DataFrame:
    """agent_id, grounding: half the share of papers with evidence, three tenths the share of supported claims that hold, two
    tenths whether all hold; six places."""
    kinds = acquired.select("paper_id", F.col("content_kind").isin(*CREDITED).alias("credit"))
    rows = claims.join(kinds, "paper_id", "left").withColumn("credit", F.coalesce("credit", F.lit(False)))
    supported = F.col("status") == "supported"
    share = F.coalesce(F.avg(F.when(supported, F.col("credit").cast("double"))), F.lit(0.0))
    whole = F.min(F.when(F.col("status").isin("supported", "disputed"), F.col("credit").cast("int")).otherwise(1))
    return rows.groupBy("agent_id").agg(F.round(0.5 * F.avg(F.col("credit").cast("double")) + 0.3 * share + 0.2 * whole, 6).alias("grounding"))


def concepts(labels: DataFrame) -> DataFrame:
    """concept, label, papers: labels (label, paper_id, ordinal) by lower-cased label; the first seen spelling stays."""
    rows = labels.select(F.lower(F.trim("label")).alias("concept"), "label", "paper_id", "ordinal").where("concept <> ''")
    papers = rows.select("concept", "paper_id").distinct().groupBy("concept").agg(F.count("paper_id").alias("papers"))
    spelt = rows.groupBy("concept", "label").agg(F.min("ordinal").alias("ordinal"), F.max(F.col("ordinal").isNull()).alias("none"))  # numbers alone, so that no task sorts its labels
    first = F.struct(F.when(~F.col("none"), F.col("ordinal")).alias("ordinal"), F.col("label"))
    return spelt.groupBy("concept").agg(F.min_by("label", first).alias("label")).join(papers.hint("merge"), "concept").select("concept", "label", "papers")


STATUS_ORDER = ("supported", "disputed", "proposed", "unknown", "superseded")


def relevant_claims(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, claim_id, overlap, rank: claims that share words ([a-z0-9]+) with a question; where none does, all claims
    (overlap 0). rank orders a question's claims by status, then id.

    The questions are one responder's and few, so their words, of a checked number, are what is sent to the claims; claims are dealt by
    id, not as their files lie, so a task's matches don't grow with the files. Ranks are places in one order of all rows, less those before
    the question's, so no task sees all claims of a question."""
    word = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda x: x != "")
    q = stored(questions.select("question_id", F.explode(word(F.col("text"))).alias("word")), "question-words")
    few = q.count() <= MOST_WORDS
    a = claims.select("claim_id", "text").repartition("claim_id").select("claim_id", F.explode(word(F.col("text"))).alias("word"))
    met = a.join(F.broadcast(q) if few else q.hint("merge"), "word").groupBy("question_id", "claim_id").agg(F.count("*").alias("overlap"))
    met = stored(met, "question-claims")
    alone = [x.question_id for x in questions.select("question_id").join(met.select("question_id").distinct(), "question_id", "left_anti").limit(MOST_ALONE + 1).collect()]
    if len(alone) > MOST_ALONE:
        raise ValueError(f"more than {MOST_ALONE} questions share no word with any claim")
    kind = questions.schema["question_id"].dataType
    every = claims.select(F.explode(F.array(*[F.lit(x).cast(kind) for x in alone])).alias("question_id") if alone else F.lit(None).cast(kind).alias("question_id"), "claim_id", F.lit(0).cast("long").alias("overlap")).where("question_id is not null")
    order = F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), F.col("status"))
    place = F.when(order > 0, order).otherwise(len(STATUS_ORDER) + 1)
    rows = met.unionByName(every).hint("merge").join(claims.select("claim_id", place.alias("place")), "claim_id")
    rows = stored(rows.select("question_id", "claim_id", "overlap", "place"), "question-places")
    counts = rows.groupBy("question_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("question_id").rowsBetween(Window.unboundedPreceding, -1))  # a row for each question
    heads = counts.select("question_id", F.coalesce(before, F.lit(0)).alias("head"))
    placed = ranked(rows, ["question_id", "place", "claim_id"], "rank").join(F.broadcast(heads) if few else heads.hint("merge"), "question_id")
    return placed.select("question_id", "claim_id", "overlap", (F.col("rank") - F.col("head")).alias("rank"))


def build_pack(sources: DataFrame) -> DataFrame:
    """paper_id, hash, status: included, or why not (no_evidence, duplicate_content); of equal hashes the least id is included."""
    credit = F.col("content_kind").isin(*CREDITED)
    first = sources.where(credit).groupBy("hash").agg(F.min("paper_id").alias("first"))
    rows = sources.join(first, "hash", "left")
    return rows.select("paper_id", "hash", F.when(~credit, "no_evidence").when(F.col("paper_id") != F.col("first"), "duplicate_content").otherwise("included").alias("status"))


def integrity(claims: DataFrame, acquired: DataFrame) -> DataFrame:
    """name, failures: how many claims fail each check."""
    missing = claims.join(acquired.select("paper_id").distinct(), "paper_id", "left_anti").select(F.lit("missing_paper").alias("name"), "claim_id")
    weak = claims.where("status = 'supported'").join(acquired.where(F.col("content_kind").isin(*CREDITED)).select("paper_id").distinct(), "paper_id", "left_anti").select(F.lit("unsupported").alias("name"), "claim_id")
    range_ = claims.where(~F.col("confidence").between(0, 1)).select(F.lit("confidence_range").alias("name"), "claim_id")
    first = claims.groupBy(texts.normal_claim(F.col("text")).alias("key")).agg(F.min("claim_id").alias("first"), F.count("*").alias("n"))
    repeats = first.select(F.lit("duplicate_text").alias("name"), (F.col("n") - 1).alias("n"))
    names = claims.sparkSession.createDataFrame([(x,) for x in ("missing_paper", "unsupported", "confidence_range", "duplicate_text")], "name string")
    counts = missing.unionByName(weak).unionByName(range_).groupBy("name").agg(F.count("*").alias("n")).unionByName(repeats.groupBy("name").agg(F.sum("n").alias("n")))
    return F.broadcast(names).join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("failures"))
