"""Queries of the claims ledger and of reference mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import ledger as lg
from lodestrata.operators import mapping as mp
from lodestrata.plans.registry import query

c = F.col
CREDIT = "SELECT DISTINCT paper_id FROM {acquired} WHERE content_kind <> 'metadata'"
_RANK = "CASE status WHEN 'supported' THEN 0 WHEN 'disputed' THEN 1 WHEN 'proposed' THEN 2 WHEN 'unknown' THEN 3 END"


@query("exp_claims_from_findings", "SELECT id AS paper_id, k, unnest AS text, CASE WHEN credited THEN 'supported' ELSE 'proposed' END AS status, CASE WHEN credited THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM (SELECT id, abstract IS NOT NULL AS credited, unnest([0::BIGINT, 2]) AS k, unnest([author, p_t]) AS unnest FROM (SELECT *, coalesce(title, 'none') AS p_t FROM {papers}) p) x")
def exp_claims_from_findings(t):
    rows = t.papers.select(c("id").alias("paper_id"), c("abstract").isNotNull().alias("credited"), F.array(c("author"), F.lit("  "), F.coalesce("title", F.lit("none"))).alias("findings"))
    return lg.claims_from_findings(rows)


@query("top_compact_claims", "SELECT agent_id, claim_id, row_number() OVER (PARTITION BY agent_id ORDER BY (status <> 'supported')::INT, claim_id) <= 3 AS kept FROM {claims}")
def top_compact_claims(t):
    return lg.compact_claims(t.claims, 3)


_MUTATIONS = "SELECT run_id, 'c' || (seq % 5) AS claim, row_number() OVER (PARTITION BY run_id, seq % 5 ORDER BY seq) AS k, CASE WHEN seq <= 5 THEN 'propose' WHEN event_id % 5 = 0 THEN 'support' WHEN event_id % 5 = 1 THEN 'dispute' WHEN event_id % 50 = 2 THEN 'reject' ELSE 'open' END AS action, event_id % 3 <> 0 AS backed FROM {run_events}"
_NEW = "CASE WHEN action = 'open' OR r.status IN ('rejected', 'superseded') OR (r.status IS NULL AND action <> 'propose') THEN r.status WHEN action = 'propose' THEN 'proposed' WHEN action = 'reject' THEN 'rejected' WHEN NOT backed THEN 'proposed' WHEN action = 'support' THEN 'supported' ELSE 'disputed' END"


@query("itr_fold_claims", f"""SELECT * FROM (WITH RECURSIVE m AS MATERIALIZED ({_MUTATIONS}), r AS (SELECT DISTINCT run_id, claim, 0::BIGINT AS k, NULL::VARCHAR AS status, 0::BIGINT AS changes FROM m UNION ALL
  SELECT m.run_id, m.claim, m.k, {_NEW}, r.changes + ({_NEW} IS DISTINCT FROM r.status)::BIGINT FROM r JOIN m ON m.run_id = r.run_id AND m.claim = r.claim AND m.k = r.k + 1)
  SELECT run_id, claim, arg_max(struct_pack(s := status), k).s AS status, arg_max(changes, k) AS changes FROM r GROUP BY run_id, claim) x""")
def itr_fold_claims(t):
    k = c("event_id")
    action = F.when(c("seq") <= 5, "propose").when(k % 5 == 0, "support").when(k % 5 == 1, "dispute").when(k % 50 == 2, "reject").otherwise("open")
    rows = t.run_events.select("run_id", c("seq").alias("ordinal"), F.concat(F.lit("c"), (c("seq") % 5).cast("string")).alias("claim"), action.alias("action"), (k % 3 != 0).alias("backed"))
    return lg.fold_claims(rows)


@query("win_synthesis", f"""SELECT agent_id, string_agg(array_to_string(words[1:(20 - before)], ' '), chr(10) ORDER BY r, claim_id) AS text FROM (SELECT agent_id, claim_id, r, words, coalesce(sum(len(words)) OVER (PARTITION BY agent_id ORDER BY r, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT agent_id, claim_id, {_RANK} AS r, string_split('[' || status || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words FROM {{claims}}) x) y WHERE before < 20 GROUP BY agent_id""")
def win_synthesis(t):
    return lg.synthesis(t.claims, 20)


@query("agg_final_answer", f"SELECT agent_id, section, count(*) AS n, any_value(sure) < 3 AS provisional FROM (SELECT *, count(*) FILTER (section = 'supported') OVER (PARTITION BY agent_id) AS sure FROM (SELECT agent_id, CASE WHEN status = 'supported' AND paper_id IN ({CREDIT}) THEN 'supported' WHEN status = 'disputed' THEN 'contradictions' WHEN status = 'unknown' THEN 'unknowns' ELSE 'plausible' END AS section FROM {{claims}}) x) y GROUP BY agent_id, section")
def agg_final_answer(t):
    return lg.final_answer(t.claims, t.acquired)


_PLACED = f"SELECT agent_id, claim_id, text, paper_id, claim_id % 3 AS setting, paper_id IN ({CREDIT}) AS good, CASE WHEN status = 'supported' AND paper_id IN ({CREDIT}) THEN 'supported' WHEN status = 'disputed' THEN 'contradictions' WHEN status = 'unknown' THEN 'unknowns' ELSE 'plausible' END AS place FROM {{claims}}"


@query("agg_answer_sections", "SELECT agent_id, " + ", ".join(f"md5(coalesce(string_agg(CASE WHEN place = '{n}' THEN text END, '|' ORDER BY claim_id), '')) AS {n}" for n in ("supported", "plausible", "contradictions", "unknowns")) + f", coalesce(array_to_string(list_sort(list(DISTINCT paper_id) FILTER (good)), ','), '') AS citations, count(DISTINCT paper_id) FILTER (good) < 3 OR count(DISTINCT setting) FILTER (good) < 2 AS provisional FROM ({_PLACED}) p GROUP BY agent_id")
def agg_answer_sections(t):
    rows = lg.answer_sections(t.claims.withColumn("setting", c("claim_id") % 3), t.acquired)
    return rows.select("agent_id", *[F.md5(F.array_join(n, "|").cast("binary")).alias(n) for n in ("supported", "plausible", "contradictions", "unknowns")], F.array_join("citations", ",").alias("citations"), "provisional")


@query("exp_freeze_bundle", "SELECT agent_id, count(*) AS n, sha256(string_agg(sha256(claim_id || '|' || status || '|' || text), ',' ORDER BY claim_id)) AS hash FROM {claims} GROUP BY agent_id")
def exp_freeze_bundle(t):
    return lg.freeze_bundle(t.claims)


@query("join_reconcile", "SELECT p_partkey::VARCHAR AS entry_id, CASE WHEN p_partkey % 4 < 3 THEN 'r' || p_partkey END AS item, CASE p_partkey % 4 WHEN 3 THEN 'missing' WHEN 2 THEN 'ordinal' ELSE 'entry_id' END AS matched_by FROM {part}")
def join_reconcile(t):
    k = c("p_partkey")
    batch = t.part.select(k.cast("string").alias("entry_id"), k.alias("ordinal"))
    answers = t.part.where(k % 4 < 3).select(F.when(k % 4 < 2, k.cast("string")).otherwise(F.concat(F.lit("?"), k.cast("string"))).alias("entry_id"), k.alias("ordinal"), k.alias("position"), F.concat(F.lit("r"), k.cast("string")).alias("item"))
    return mp.reconcile(batch, answers)


@query("flt_advance_mapping", "SELECT p_partkey::VARCHAR AS entry_id, (p_partkey % 3 + CASE WHEN p_partkey % 5 < 3 THEN 1 ELSE 0 END)::BIGINT AS attempts, CASE WHEN p_partkey % 5 = 0 THEN 'mapped' WHEN p_partkey % 5 < 3 AND p_partkey % 3 = 2 THEN 'mapping_failed' ELSE 'pending' END AS status, CASE WHEN p_partkey % 5 IN (0, 3, 4) THEN NULL WHEN p_partkey % 3 = 2 THEN 'retry_exhausted' ELSE 'bad_json' END AS error FROM {part}")
def flt_advance_mapping(t):
    k = c("p_partkey")
    entries = t.part.select(k.cast("string").alias("entry_id"), (k % 3).alias("attempts"), F.lit("pending").alias("status"))
    outcomes = t.part.where(k % 5 < 3).select(k.cast("string").alias("entry_id"), (k % 5 == 0).alias("ok"), F.lit("bad_json").alias("code"))
    return mp.advance_mapping(entries, outcomes, 3)


@query("flt_classify_fetch", "SELECT p_partkey % 25 AS agent_id, id, CASE WHEN p_partkey % 9 = 0 THEN 'transient' WHEN p_partkey % 8 = 0 THEN 'absent' WHEN p_partkey % 10 = 1 AND title IS NOT NULL THEN 'mismatch' WHEN abstract IS NULL THEN 'metadata_only' ELSE 'integrated' END AS outcome FROM {papers}")
def flt_classify_fetch(t):
    k = c("p_partkey")
    tries = t.papers.select((k % 25).alias("agent_id"), "id", (k % 9 == 0).alias("error"), F.when(k % 10 == 1, "another").alias("expected"))
    return mp.classify_fetch(tries, t.papers.where(k % 8 != 0))


@query("agg_job_accounting", "SELECT job_id, entries, mapped, unparsed, failed, pending, resolved, CASE WHEN pending > 0 THEN 'incomplete' WHEN failed = entries THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM (SELECT o_custkey AS job_id, count(*) AS entries, count(*) FILTER (o_orderkey % 7 IN (1, 2, 3, 4)) AS mapped, count(*) FILTER (o_orderkey % 7 = 5) AS unparsed, count(*) FILTER (o_orderkey % 7 = 6) AS failed, count(*) FILTER (o_orderkey % 7 = 0) AS pending, count(DISTINCT CASE WHEN o_orderkey % 7 IN (1, 2) THEN o_orderkey % 3 END) AS resolved FROM {orders} GROUP BY 1) x")
def agg_job_accounting(t):
    k = c("o_orderkey") % 7
    status = F.when(k == 5, "unparsed").when(k == 6, "failed").when(k == 0, "pending").otherwise("mapped")
    return mp.job_accounting(t.orders.select(c("o_custkey").alias("job_id"), status.alias("status"), F.when(k.isin(1, 2), c("o_orderkey") % 3).alias("canonical_id")))


_CAND = "SELECT src AS id, dst AS neighbor, 'ref' AS direction, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS provider_rank, l_linenumber AS ordinal FROM (SELECT concat('o:', l_orderkey) AS src, p.id AS dst, l_linenumber FROM {lineitem} JOIN {papers} p ON p.p_partkey = l_partkey) x"


@query("join_expand", f"SELECT id, direction, neighbor, rank FROM (SELECT id, direction, neighbor, row_number() OVER (PARTITION BY id, direction ORDER BY ordinal, neighbor) AS rank FROM (SELECT id, direction, neighbor, min(ordinal) AS ordinal FROM (SELECT *, min(provider_rank) OVER (PARTITION BY id, direction) AS best FROM ({_CAND}) c) d WHERE provider_rank = best GROUP BY ALL) e) f WHERE rank <= 2")
def join_expand(t):
    rows = t.lineitem.join(t.papers, c("p_partkey") == c("l_partkey")).select(F.concat(F.lit("o:"), c("l_orderkey").cast("string")).alias("id"), c("id").alias("neighbor"), F.lit("ref").alias("direction"), F.when(c("l_linenumber") % 2 == 0, 1).otherwise(2).alias("provider_rank"), c("l_linenumber").alias("ordinal"))
    return mp.expand(rows.select("id").distinct(), rows, 2)


@query("join_embed_with_cache", "SELECT p_partkey, sha256(p_type) AS text_hash, CASE WHEN any_value(p_partkey) OVER (PARTITION BY p_type) IS NOT NULL THEN length(p_type)::DOUBLE END AS size FROM {part}")
def join_embed_with_cache(t):
    known = t.part.where("p_partkey % 7 = 0").select(F.sha2(c("p_type").cast("binary"), 256).alias("text_hash"), F.array(F.length("p_type").cast("double")).alias("embedding")).distinct()
    rows, _ = mp.embed_with_cache(t.part.select("p_partkey", c("p_type").alias("text")), known, lambda m: m.select("text_hash", F.array(F.length("text").cast("double")).alias("embedding")))
    return rows.select("p_partkey", "text_hash", F.get("embedding", F.lit(0)).alias("size"))


@query("join_merge_priorities", "SELECT p_partkey % 25 AS agent_id, id, CASE WHEN p_partkey % 2 = 0 AND p_partkey <= 30 THEN 0.9 ELSE 0.5 END::DOUBLE AS priority, CASE WHEN p_partkey % 2 = 0 AND p_partkey <= 30 THEN 'model' ELSE 'eta' END AS source FROM {papers}")
def join_merge_priorities(t):
    k = c("p_partkey")
    frontier = t.papers.select((k % 25).alias("agent_id"), "id", k.alias("ordinal"), F.lit(0.5).alias("eta"))
    return mp.merge_priorities(frontier, t.papers.where(k % 2 == 0).select((k % 25).alias("agent_id"), "id", F.lit(0.9).alias("score")))


@query("set_register_aliases", "SELECT alias, canonical_id FROM {aliases} UNION ALL SELECT 'doi:' || doi, min(id) FROM {papers} WHERE doi IS NOT NULL GROUP BY 1")
def set_register_aliases(t):
    new = t.papers.select("id", F.array_compact(F.array(F.concat(F.lit("doi:"), "doi"), c("id"), F.concat(F.lit("alias:"), F.when(c("p_partkey") == 5, "5")))).alias("keys"))
    return mp.register_aliases(t.aliases, new)


@query("agg_composite", "SELECT o_custkey AS key, round(sum(w * s) / sum(w), 6) AS score FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 0.5 ELSE 1.0 END::DOUBLE AS w, (o_orderkey % 11) / 10 AS s FROM {orders}) x GROUP BY 1")
def agg_composite(t):
    rows = t.orders.select(c("o_custkey").alias("key"), c("o_orderstatus").alias("dimension"), ((c("o_orderkey") % 11) / 10).alias("score"))
    return mp.composite(rows, {"F": 2.0, "O": 0.5}).withColumn("score", F.round("score", 6))
