"""A corpus pipeline of five stages; each works on what the one before it kept.

run(spark, sf_dir) applies STAGES to the table documents, writing and reading Parquet between them. A row without doc_id
can't be judged and goes with the first stage; null and empty texts fail the quality rules; extra columns are left out,
missing ones of COLUMNS are null; rows of one doc_id with different texts share their fate in the first stage (they stay
if one of them is kept) and the third (a leak in one is a leak in all), the second judges each text; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontaminate, ngram_join, pii, quality
from lodestrata.llm.text import has_repeated_ids, numbered
from lodestrata.tables import drop, scratch, stored

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
SHINGLE, PERCENT = 5, 80  #: words and similarity of near duplicates


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def _only(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of docs with the ids of a table of decisions."""
    return _documents(docs).join(stored(ids.select("doc_id").distinct(), name).hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _only(docs, quality.score(_documents(docs)).where("kept"), "pipeline-quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity of 0.8 over 5-word shingles, the row with the least doc_id (then the least digest of
    all its columns); repeated rows once. Texts are judged, not ids: of an id with several texts those stay that are no copies."""
    docs = _documents(docs).where("doc_id is not null")
    if not has_repeated_ids(docs):
        return _only(docs, ngram_join.similar_sets(docs, size=SHINGLE, percent=PERCENT).where("component_id = doc_id"), "pipeline-groups")
    rows = numbered(docs, "pipeline-rows")
    groups = ngram_join.similar_sets(rows.select(F.col("row").alias("doc_id"), "text"), size=SHINGLE, percent=PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    own = rows.select("row", F.struct("doc_id", F.md5(F.to_json(F.struct(*COLUMNS)).cast("binary")), "row").alias("name"))
    kept = groups.join(own.hint("merge"), "row").groupBy("component_id").agg(F.min("name")["row"].alias("row"))
    return rows.join(stored(kept.select("row"), "pipeline-kept").hint("merge"), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontaminate.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, leaks.where("not contaminated"), "pipeline-leaks")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by [KIND]; n_chars is the new text's."""
    return _documents(pii.redact(docs)).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

ORACLE_SQL = None  # perplexity bands, boosted trees and byte-pair encoding can't be said in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes for itself, and the stage before it, are deleted when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            new = stored(stage(spark, docs, sf_dir), f"pipeline-stage-{name}")
            kept.append(new)
        drop(docs)
        docs = new
    return docs
