"""The claims ledger: claims from findings, ordered mutations, compaction, synthesis and the final answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import texts

RANK = {"supported": 0, "disputed": 1, "proposed": 2, "unknown": 3}
NEXT = {"propose": "proposed", "support": "supported", "dispute": "disputed", "reject": "rejected", "supersede": "superseded"}


def claims_from_findings(dossiers: DataFrame) -> DataFrame:
    """paper_id, k, text, status, confidence: a claim for each finding that isn't blank, supported at 0.7 with evidence, else
    proposed at 0.4."""
    rows = dossiers.select("paper_id", "credited", F.posexplode("findings").alias("k", "text")).where("trim(text) <> ''")
    return rows.select("paper_id", F.col("k").cast("long").alias("k"), F.trim("text").alias("text"), F.when(F.col("credited"), "supported").otherwise("proposed").alias("status"), F.when(F.col("credited"), 0.7).otherwise(0.4).alias("confidence"))


def compact_claims(claims: DataFrame, most: int) -> DataFrame:
    """agent_id, claim_id, kept: supported claims first, then by id, `most` for each agent."""
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.when(F.col("status") == "supported", 0).otherwise(1), "claim_id"))
    return claims.select("agent_id", "claim_id", (rank <= most).alias("kept"))


def fold_claims(mutations: DataFrame) -> DataFrame:
    """run_id, claim, status, changes after mutations (run_id, ordinal, claim, action, backed) in order: support and dispute need
    backing (else the claim is proposed), rejected and superseded ones don't change again, one not proposed before is ignored.

    A claim's own history is a sorted array, folded as a column expression; a claim has as many mutations as it was argued over.
    """
    given = F.create_map(*[x for kv in NEXT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])

    def step(acc: Column, m: Column) -> Column:
        old = acc["status"]
        idle = given[m["action"]].isNull() | old.isin("rejected", "superseded") | (old.isNull() & (m["action"] != "propose"))
        new = F.when(F.coalesce(idle, F.lit(False)), old).when(m["backed"] | ~m["action"].isin("support", "dispute"), given[m["action"]]).otherwise("proposed")
        return F.struct(new.alias("status"), (acc["changes"] + (~new.eqNullSafe(old)).cast("long")).alias("changes"))

    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("changes"))
    history = mutations.groupBy("run_id", "claim").agg(F.array_sort(F.collect_list(F.struct("ordinal", "action", "backed"))).alias("h"))
    return history.select("run_id", "claim", F.aggregate("h", start, step).alias("s")).select("run_id", "claim", "s.status", "s.changes")


def synthesis(claims: DataFrame, most_words: int) -> DataFrame:
    """agent_id, text: claims by status and id, a line each, cut at `most_words` words; claims past the budget aren't gathered."""
    rank = F.lit(len(RANK))
    for name, k in RANK.items():
        rank = F.when(F.col("status") == name, k).otherwise(rank)
    line = F.concat(F.lit("["), "status", F.lit("] "), texts.collapse(F.col("text")))
    rows = claims.select("agent_id", "claim_id", rank.alias("r"), line.alias("line")).withColumn("n", F.size(F.split("line", " ")))
    before = F.sum("n").over(Window.partitionBy("agent_id").orderBy("r", "claim_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("left", most_words - F.coalesce(before, F.lit(0))).where("left > 0")
    cut = F.array_join(F.slice(F.split("line", " "), F.lit(1), F.col("left").cast("int")), " ")
    return rows.withColumn("line", cut).groupBy("agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "claim_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def final_answer(claims: DataFrame, acquired: DataFrame, least: int = 3) -> DataFrame:
    """agent_id, section, n of what an answer says, and whether it is provisional (under `least` claims that hold)."""
    credit = acquired.where(F.col("content_kind") != "metadata").select("paper_id", F.lit(True).alias("ok")).distinct()
    rows = claims.join(credit, "paper_id", "left")
    section = F.when((F.col("status") == "supported") & F.col("ok"), "supported").when(F.col("status") == "disputed", "contradictions").when(F.col("status") == "unknown", "unknowns").otherwise("plausible")
    sure = F.sum(F.count_if(F.col("section") == "supported")).over(Window.partitionBy("agent_id"))
    return rows.withColumn("section", section).groupBy("agent_id", "section").agg(F.count("*").alias("n"), (sure < least).alias("provisional"))


def answer_sections(claims: DataFrame, acquired: DataFrame, least: int = 3, settings: int = 2) -> DataFrame:
    """agent_id, and of its claims (claim_id, status, text, paper_id, setting) the texts that an answer says as supported, plausible,
    contradictions and unknowns, each array by id; the cited papers, sorted; and whether it is provisional: fewer than
    `least` papers with evidence, or from fewer than `settings` settings. An answer is one agent's claims, and bounded by them."""
    credit = acquired.where(F.col("content_kind") != "metadata").select("paper_id", F.lit(True).alias("ok")).distinct()
    ok = F.coalesce("ok", F.lit(False))
    place = F.when((F.col("status") == "supported") & ok, "supported").when(F.col("status") == "disputed", "contradictions").when(F.col("status") == "unknown", "unknowns").otherwise("plausible")
    rows = claims.join(credit, "paper_id", "left").withColumns({"place": place, "good": ok})
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("place") == n, F.struct("claim_id", "text")))), lambda x: x["text"]).alias(n)
    few = (F.count_distinct(F.when(F.col("good"), F.col("paper_id"))) < least) | (F.count_distinct(F.when(F.col("good"), F.col("setting"))) < settings)
    return rows.groupBy("agent_id").agg(*[listed(n) for n in ("supported", "plausible", "contradictions", "unknowns")], F.array_sort(F.collect_set(F.when(F.col("good"), F.col("paper_id")))).alias("citations"), few.alias("provisional"))


def freeze_bundle(claims: DataFrame) -> DataFrame:
    """agent_id, n, hash: one digest over an agent's claims in order of id."""
    one = F.concat_ws("|", F.col("claim_id").cast("string"), "status", "text")
    rows = claims.select("agent_id", "claim_id", texts.sha256_text(one).alias("h"))
    return rows.groupBy("agent_id").agg(F.count("*").alias("n"), texts.sha256_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "h"))), lambda x: x["h"]), ",")).alias("hash"))
