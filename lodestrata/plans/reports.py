"""Queries of notes, reports, scores by version and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import notes as nt
from lodestrata.operators import reports as rp
from lodestrata.operators import reuse as ru
from lodestrata.plans.outcomes import _ARMS
from lodestrata.plans.registry import query
from lodestrata.plans.views import spark_sql
from lodestrata.plans.waves import _SEEDED

c = F.col


def _sql(t, text):
    return spark_sql(t.spark, t.sf_dir, text)


_NAME = "translate({}, ':/\\', '___')"
_LINKS = "string_agg('- [[' || " + _NAME + " || ']]', chr(10) ORDER BY {})"
_SEEN = "SELECT DISTINCT agent_id, node AS id FROM {visits_mixed}"
_NOTES = f"""SELECT v.agent_id, {_NAME.format('v.id')} || '.md' AS path, concat_ws(chr(10), '---', 'title: "' || coalesce(title, v.id) || '"', 'year: ' || coalesce(year::VARCHAR, 'null'), 'provider: ' || coalesce(provider, 'unknown'), '---', '', '# ' || coalesce(title, v.id), '',
  '## References (outgoing)', coalesce(refers, '(none discovered)'), '', '## Cited by (incoming)', coalesce(cited, '(none discovered)'), '', '## Referenced by (in agent''s graph)', coalesce(nearby, '(none)'), '') AS content
  FROM ({_SEEN}) v LEFT JOIN {{papers}} p ON p.id = v.id LEFT JOIN (SELECT src AS id, {_LINKS.format('dst', 'dst')} AS refers FROM {{edges}} GROUP BY src) r ON r.id = v.id LEFT JOIN (SELECT dst AS id, {_LINKS.format('src', 'src')} AS cited FROM {{edges}} GROUP BY dst) i ON i.id = v.id
  LEFT JOIN (SELECT s.agent_id, e.dst AS id, {_LINKS.format('e.src', 'e.src')} AS nearby FROM ({_SEEN}) s JOIN {{edges}} e ON e.src = s.id GROUP BY 1, 2) n ON n.agent_id = v.agent_id AND n.id = v.id"""


@query("snk_render_notes", f"SELECT agent_id, path, sha256(content) AS content, length(content) AS size FROM ({_NOTES}) x")
def snk_render_notes(t):
    t = t.holding("edges")
    notes = nt.render_notes(t.visits_mixed.select("agent_id", c("node").alias("id")), t.papers, t.edges, 64)
    return notes.select("agent_id", "path", F.sha2(c("content").cast("binary"), 256).alias("content"), F.char_length("content").alias("size"))


@query("snk_overviews", f"""SELECT a.agent_id, '_MOC.md' AS path, concat_ws(chr(10), '---', 'type: moc', 'agent: ' || a.agent_id, 'caste: ' || caste, '---', '', '- **Final Q:** ' || printf('%.4f', budget / 10), '- **Papers visited:** ' || coalesce(n, 0), '- **Private graph:** ' || coalesce(e, 0) || ' ref-edges', '', '## Exploration Path', coalesce(path, '(no path)'), '') AS content
  FROM {{agents}} a LEFT JOIN (SELECT agent_id, count(*) AS n, string_agg('- [[' || {_NAME.format('v.id')} || ']] — ' || coalesce(title, v.id), chr(10) ORDER BY ordinal, v.id) AS path FROM (SELECT agent_id, node AS id, min(ordinal) AS ordinal FROM {{visits_mixed}} GROUP BY 1, 2) v LEFT JOIN {{papers}} p ON p.id = v.id GROUP BY agent_id) v ON v.agent_id = a.agent_id
  LEFT JOIN (SELECT agent_id, count(*) AS e FROM ({_SEEN}) s JOIN {{edges}} e ON e.src = s.id GROUP BY 1) k ON k.agent_id = a.agent_id""")
def snk_overviews(t):
    t = t.holding("edges")
    agents = t.agents.select("agent_id", "caste", (c("budget") / 10).alias("quality"))
    return nt.render_overviews(agents, t.visits_mixed.select("agent_id", c("node").alias("id"), "ordinal"), t.papers, t.edges, 64)


_EVALS = "SELECT c_nationkey AS run_id, r_regionkey + 1 AS wave, c_custkey AS agent_id, (c_custkey * 7 + (r_regionkey + 1) * (r_regionkey + 1) * 13) % 100 / 100 AS q, (r_regionkey + 1) * 50 AS fetches, (r_regionkey + 1) * 10.5 AS elapsed FROM {customer} CROSS JOIN (SELECT r_regionkey FROM {region} WHERE r_regionkey < 3) w"
_READ = "SELECT c_nationkey AS run_id, c_custkey AS agent_id, l_partkey AS id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey"


@query("job_research_report", f"""SELECT run_id, grain, wave, agent_id, best_q, leader, first_q, last_q, round(CASE WHEN grain <> 'wave' THEN last_q - first_q END, 6) AS gain, evaluations, fetches, elapsed::DOUBLE AS elapsed, ranking, CASE WHEN grain = 'run' THEN coalesce((SELECT count(DISTINCT id) FROM v WHERE v.run_id = y.run_id), 0) WHEN grain = 'agent' THEN coalesce(papers, 0) END AS papers FROM
  (WITH e AS MATERIALIZED ({_EVALS}), v AS MATERIALIZED ({_READ})
   SELECT y.*, k.ranking, p.papers, a.all_papers FROM (SELECT run_id, 'run' AS grain, NULL AS wave, NULL AS agent_id, max(q) AS best_q, arg_max(agent_id, (q, -agent_id)) AS leader, arg_min(q, (wave, q)) AS first_q, arg_max(q, (wave, q)) AS last_q, count(*) AS evaluations, max(fetches) AS fetches, max(elapsed) AS elapsed FROM e GROUP BY run_id
   UNION ALL SELECT run_id, 'wave', wave, NULL, max(q), arg_max(agent_id, (q, -agent_id)), min(q), max(q), count(*), max(fetches), max(elapsed) FROM e GROUP BY run_id, wave
   UNION ALL SELECT run_id, 'agent', NULL, agent_id, max(q), any_value(agent_id), arg_min(q, wave), arg_max(q, wave), count(*), max(fetches), max(elapsed) FROM e GROUP BY run_id, agent_id) y
   LEFT JOIN (SELECT run_id, wave, string_agg(agent_id || '=' || printf('%.2f', q), ', ' ORDER BY r) AS ranking FROM (SELECT *, row_number() OVER (PARTITION BY run_id, wave ORDER BY q DESC, agent_id) AS r FROM e) z WHERE r <= 3 GROUP BY 1, 2) k ON k.run_id = y.run_id AND k.wave = y.wave AND y.grain = 'wave'
   LEFT JOIN (SELECT run_id, agent_id, count(DISTINCT id) AS papers FROM v GROUP BY 1, 2) p ON p.run_id = y.run_id AND p.agent_id = y.agent_id LEFT JOIN (SELECT run_id, count(DISTINCT id) AS all_papers FROM v GROUP BY 1) a ON a.run_id = y.run_id) y""".replace("CASE WHEN grain = 'run' THEN coalesce((SELECT count(DISTINCT id) FROM v WHERE v.run_id = y.run_id), 0)", "CASE WHEN grain = 'run' THEN coalesce(all_papers, 0)"))
def job_research_report(t):
    rows = rp.research_report(_sql(t, _EVALS).withColumn("elapsed", c("elapsed").cast("double")), _sql(t, _READ))
    return rows.withColumn("gain", F.round("gain", 6))


_CLAIMS = "SELECT doc_id % 25 AS run_id, doc_id AS claim_id, CASE doc_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'disputed' ELSE 'proposed' END AS status, CASE WHEN doc_id % 50 = 3 THEN 1.5 ELSE 0.5 END AS confidence, text FROM {documents}"
_REFS = "SELECT doc_id % 25 AS run_id, doc_id AS claim_id, doc_id AS paper_id FROM {documents} WHERE doc_id % 12 <> 4 UNION ALL SELECT doc_id % 25, doc_id, doc_id + 25 FROM {documents} WHERE doc_id % 3 = 0"
_GOT = "SELECT paper_id % 25 AS run_id, paper_id, content_kind FROM {acquired}"
_CITED = "SELECT doc_id % 25 AS run_id, CASE WHEN doc_id % 75 = 0 THEN doc_id + 1000000 ELSE doc_id END AS paper_id FROM {documents} WHERE doc_id % 4 = 0 AND doc_id % 12 <> 4"
_BUDGETS = "SELECT n_nationkey AS run_id, n_nationkey * 3 AS fetches_used, 60 AS max_fetches, CASE WHEN n_nationkey = 4 THEN -1 ELSE 10 END AS tokens_used, 1000 AS max_tokens FROM {nation}"


@query("agg_integrity_checks", f"""WITH c AS ({_CLAIMS}), r AS ({_REFS}), g AS ({_GOT}), x AS ({_CITED}), b AS ({_BUDGETS}), s AS (SELECT * FROM c WHERE status IN ('supported', 'disputed')), k AS (SELECT run_id, paper_id FROM g UNION SELECT run_id, paper_id FROM r),
  f AS (SELECT run_id, 'supported_claims_have_evidence' AS "check", count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = s.run_id AND r.claim_id = s.claim_id) GROUP BY 1
   UNION ALL SELECT r.run_id, 'claim_refs_resolve_to_acquired', count(DISTINCT r.claim_id) FROM r JOIN s ON s.run_id = r.run_id AND s.claim_id = r.claim_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_id = r.run_id AND g.paper_id = r.paper_id AND content_kind IN ('full_text', 'abstract')) GROUP BY 1
   UNION ALL SELECT run_id, 'referenced_papers_exist', count(*) FROM k WHERE paper_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
   UNION ALL SELECT run_id, 'confidence_ranges_valid', count(*) FROM c WHERE confidence > 1 GROUP BY 1
   UNION ALL SELECT run_id, 'no_duplicate_claims', sum(n) FROM (SELECT run_id, count(*) AS n FROM c GROUP BY run_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) HAVING count(*) > 1) d GROUP BY 1
   UNION ALL SELECT run_id, 'final_answer_citations_resolve', count(DISTINCT paper_id) FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = x.run_id AND k.paper_id = x.paper_id) GROUP BY 1
   UNION ALL SELECT run_id, 'budget_accounting_consistent', 1 FROM b WHERE fetches_used > max_fetches OR tokens_used < 0)
  SELECT b.run_id, q."check", coalesce(n, 0)::BIGINT AS failures FROM b CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in rp.CHECKS)}]) AS "check") q LEFT JOIN f ON f.run_id = b.run_id AND f."check" = q."check" """.replace("WITH c AS", "SELECT * FROM (WITH c AS") + ") z")
def agg_integrity_checks(t):
    return rp.integrity_checks(_sql(t, _CLAIMS), _sql(t, _REFS), _sql(t, _GOT), t.labels.select(c("doc_id").alias("id")), _sql(t, _CITED), _sql(t, _BUDGETS))


_DIMS = "SELECT run_id, seq, concat('v', CAST(seq DIV 30 AS STRING)) AS version, d.dimension, (seq * 7 + d.k) % 11 / 10 AS score FROM {evaluations} CROSS JOIN (SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN 'grounding' WHEN 1 THEN 'coverage' WHEN 2 THEN 'coherence' ELSE 'novelty' END AS dimension FROM {region} WHERE r_regionkey < 4) d"
_PASSED = "SELECT run_id, seq, r_regionkey AS name, (seq + r_regionkey) % 4 AS failures FROM {evaluations} CROSS JOIN {region} WHERE seq % 5 <> 0"


@query("agg_composite_versions", f"""SELECT run_id, seq, version, round(integrity, 6) AS integrity, round(overall, 6) AS overall, round(previous, 6) AS previous, round(overall - previous, 6) AS delta FROM (
  SELECT *, CASE WHEN lag(version) OVER w = version THEN lag(overall) OVER w ELSE 0 END AS previous FROM (
  SELECT d.run_id, d.seq, version, coalesce(any_value(i.integrity), 1) AS integrity, (sum(w * score) + 1.5 * coalesce(any_value(i.integrity), 1)) / (sum(w) + 1.5) AS overall FROM (SELECT *, CASE dimension WHEN 'grounding' THEN 2.0 WHEN 'novelty' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM ({_DIMS}) x) d
  LEFT JOIN (SELECT run_id, seq, avg((failures = 0)::INT) AS integrity FROM ({_PASSED}) y GROUP BY 1, 2) i ON i.run_id = d.run_id AND i.seq = d.seq GROUP BY 1, 2, 3) z WINDOW w AS (PARTITION BY run_id ORDER BY seq)) q""")
def agg_composite_versions(t):
    rows = rp.composite_by_version(_sql(t, _DIMS), _sql(t, _PASSED), {"grounding": 2.0, "novelty": 0.5, "integrity": 1.5})
    return rows.select("run_id", "seq", "version", *[F.round(x, 6).alias(x) for x in ("integrity", "overall", "previous", "delta")])


_TIMES = " + ".join(f"(u > {p})::INT" for p in rp.POISSON)
_BOOT = f"""SELECT k, sum(n * gain) AS gain, sum(n * tokens) AS tokens, sum(n * fetches) AS fetches, sum(n) AS tasks FROM (SELECT *, CASE WHEN k = 0 THEN 1 ELSE {_TIMES} END AS n FROM (SELECT *, {_SEEDED.format("'5:' || k || ':' || task")} AS u FROM
  (SELECT a.task, b.quality - a.quality AS gain, b.tokens, b.fetches FROM ({_ARMS}) a JOIN ({_ARMS}) b ON a.task = b.task AND a.arm = 'base' AND b.arm = 'new') x, (SELECT unnest(range(0, 41)) AS k) r) y) z GROUP BY k"""


@query("agg_gain_per_cost", f"""SELECT measure, round(max(CASE WHEN k = 0 THEN value END), 6) AS value, round(quantile_cont(CASE WHEN k > 0 THEN value END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN k > 0 THEN value END, 0.975), 6) AS high FROM (
  WITH s AS ({_BOOT}) SELECT k, 'mean' AS measure, gain / tasks AS value FROM s UNION ALL SELECT k, 'per_1000_tokens', 1000 * gain / tokens FROM s UNION ALL SELECT k, 'per_fetch', gain / fetches FROM s) q GROUP BY measure""")
def agg_gain_per_cost(t):
    k = c("o_orderkey")
    rows = t.orders.select(F.when(k % 2 == 0, "base").otherwise("new").alias("arm"), F.floor(k / 2).alias("task"), ((c("o_custkey") % 101) / 100).alias("quality"), (c("o_custkey") * 10).alias("tokens"), (c("o_custkey") % 20).alias("fetches"))
    return rp.gain_per_cost(rows, "base", "new", replicates=40, seed=5).select("measure", *[F.round(x, 6).alias(x) for x in ("value", "low", "high")])


_MANIFEST = "SELECT p_partkey AS paper_id, 'v2' AS version, md5(p_name) AS source_sha256 FROM {part}"
_RESULTS = "SELECT p_partkey AS paper_id, CASE p_partkey % 11 WHEN 5 THEN 'failed' WHEN 6 THEN 'running' ELSE 'completed' END AS status, CASE p_partkey % 11 WHEN 1 THEN 'v1' ELSE 'v2' END AS version, CASE p_partkey % 11 WHEN 2 THEN 'old' ELSE md5(p_name) END AS source_sha256, CASE p_partkey % 11 WHEN 3 THEN 'other' ELSE 'f1' END AS fingerprint, CASE WHEN p_partkey % 11 <> 7 THEN concat('b/', CAST(p_partkey AS STRING)) END AS bundle FROM {part} WHERE p_partkey % 11 <> 8"
_THERE = "SELECT concat('b/', CAST(p_partkey AS STRING)) AS path FROM {part} WHERE p_partkey % 11 <> 4"


def _left(more: str) -> str:
    return f"SELECT m.paper_id, m.version FROM ({_MANIFEST}) m WHERE NOT EXISTS (SELECT 1 FROM ({_RESULTS}) r WHERE r.paper_id = m.paper_id AND (r.status = 'completed' AND r.version = m.version AND r.source_sha256 = m.source_sha256 AND r.fingerprint = 'f1' AND r.bundle IN (SELECT path FROM ({_THERE}) b){more}))"


@query("flt_pending_papers", _left(" OR r.status = 'failed'"))
def flt_pending_papers(t):
    return ru.pending(_sql(t, _MANIFEST), _sql(t, _RESULTS), _sql(t, _THERE), "f1").select("paper_id", "version")


@query("flt_pending_retried", _left(""))
def flt_pending_retried(t):
    return ru.pending(_sql(t, _MANIFEST), _sql(t, _RESULTS), _sql(t, _THERE), "f1", retry_failed=True).select("paper_id", "version")
