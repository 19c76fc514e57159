"""The operators' inputs as views over the benchmark tables, in SQL that Spark and DuckDB both run.

A view's text names its inputs in braces. Spark binds them to DataFrames, so no temporary view is registered;
for DuckDB the views become common table expressions over the tables' own names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestrata.tables import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LOGGED = (
    "orchestrator_start", "oleada_start", "oleada_complete", "wave_phase_started", "wave_phase_completed", "wave_phase_failed", "agent_turn_queued", "agent_turn_start", "agent_turn_complete", "agent_turn_failed",
    "quality_evaluation_started", "evaluation_complete", "evaluation_skipped", "quality_evaluation_failed", "evaluation_settled", "paper_fetch_started", "paper_fetch_completed", "paper_fetch_failed", "agent_step",
    "neighbor_discovery_started", "neighbor_discovery_failed", "evidence_pack_frozen", "exam_validated", "exam_partitioned", "survivor_selected", "benchmark_completed", "status", "reference_mapping_started",
    "reference_mapping_completed", "frontier_reference_evaluation_completed", "candidate_score", "provider_failure",
)

VIEWS = {
    "cited": "SELECT l_partkey, count(*) AS n_cites FROM {lineitem} GROUP BY l_partkey",
    "papers": """SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 's2' WHEN 2 THEN 'pmid' ELSE 'arxiv' END, ':', CAST(p_partkey AS STRING)) AS id,
        p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'pubmed' ELSE 'arxiv' END AS provider,
        CASE WHEN p_partkey % 3 = 0 THEN concat('10.1000/', CAST(p_partkey AS STRING)) END AS doi,
        CASE WHEN p_partkey % 6 = 1 THEN concat('2101.', CAST(10000 + p_partkey % 10000 AS STRING)) END AS arxiv_id,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1970 + p_size END AS year,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS abstract, p_brand AS author,
        coalesce(n_cites, 0) AS citation_count
        FROM {part} LEFT JOIN {cited} ON l_partkey = p_partkey""",
    "edges": "SELECT DISTINCT concat('o:', CAST(l_orderkey AS STRING)) AS src, p.id AS dst FROM {lineitem} JOIN {papers} p ON p.p_partkey = l_partkey",
    "aliases": """SELECT concat('alias:', CAST(p_partkey AS STRING)) AS alias, concat('alias:', CAST(p_partkey DIV 2 AS STRING)) AS canonical_id FROM {part} WHERE p_partkey > 1 AND p_partkey % 7 <> 0""",
    "agents": """SELECT n_nationkey AS agent_id, CASE n_nationkey % 3 WHEN 0 THEN 'fundaciones' WHEN 1 THEN 'impacto' ELSE 'mixto' END AS caste,
        n_nationkey % 10 AS budget FROM {nation}""",
    "visits": """SELECT c_nationkey AS agent_id, concat('o:', CAST(o_orderkey AS STRING)) AS node,
        CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "visits_mixed": """SELECT agent_id, node, min(ordinal) AS ordinal FROM (
        SELECT agent_id, node, ordinal FROM {visits}
        UNION ALL SELECT v.agent_id, e.dst AS node, 1000000000 + v.ordinal AS ordinal FROM {visits} v JOIN {edges} e ON e.src = v.node
        JOIN {papers} p ON p.id = e.dst WHERE p.p_partkey % 2 = 0) x GROUP BY agent_id, node""",
    "read_papers": """SELECT v.agent_id, e.dst AS id, min(v.ordinal) AS ordinal FROM {visits} v JOIN {edges} e ON e.src = v.node GROUP BY v.agent_id, e.dst""",
    "vectors": "SELECT p.id, e.embedding FROM {papers} p JOIN {embeddings} e ON e.vec_id = p.p_partkey % 500",
    "pheromone": """SELECT s_nationkey AS agent_id, concat('o:', CAST(l_orderkey % 100 AS STRING)) AS src, p.id AS dst,
        CASE WHEN l_linenumber % 2 = 0 THEN 'cites' ELSE 'ref' END AS mode, round(avg(0.1 + l_quantity / 10), 6) AS tau
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {papers} p ON p.p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2, 3, 4""",
    "paths": """SELECT s_nationkey AS agent_id, concat('o:', CAST(l_orderkey % 100 AS STRING)) AS src, p.id AS dst,
        CASE WHEN l_linenumber % 2 = 0 THEN 'cites' ELSE 'ref' END AS mode, l_orderkey, l_linenumber
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {papers} p ON p.p_partkey = l_partkey WHERE l_returnflag = 'R'""",
    "run_events": """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, ts,
        CASE event_type WHEN 'signup' THEN 'orchestrator_start' WHEN 'view' THEN 'agent_step' WHEN 'click' THEN 'candidate_selected'
        WHEN 'purchase' THEN 'evaluation_complete' ELSE 'warning' END AS type,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('agent-', CAST(event_id % 5 AS STRING)) END AS agent_id, value, props AS payload, event_id FROM {events}""",
    "log_events": f"""SELECT run_id, seq, ts, CASE WHEN event_id % 101 = 0 THEN 'run_failed' WHEN event_id % 103 = 0 THEN 'run_cancelled' WHEN event_id % 107 = 0 THEN 'run_interrupted' WHEN event_id % 109 = 0 THEN 'run_completed'
        ELSE CASE event_id % {len(_LOGGED)} {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_LOGGED))} END END AS type, agent_id, value, event_id,
        CASE WHEN event_id % 50 = 7 THEN concat(chr(123), '"oleada": ') WHEN event_id % 50 <> 8 THEN concat(chr(123), '"oleada": ', CAST(seq DIV 20 + 1 AS STRING), ', "turn": ', CAST(event_id % 2 AS STRING), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', "phase": "evaluation"' ELSE ', "phase": "decision"' END,
            ', "status": "', CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'cancelled' ELSE 'evaluating' END, '", "budget": ', CAST(event_id % 3 AS STRING), ', "paper_id": "p', CAST(event_id % 5 AS STRING), '", "message": "token=abc ', CAST(event_id % 9 AS STRING), '"', chr(125)) END AS payload FROM {{run_events}}""",
    "hot_events": """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS seq, event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE concat('state ', CAST(event_id % 7 AS STRING)) END AS state
        FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS run_id, event_id FROM {events}) x""",
    "evaluations": """SELECT run_id, seq, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS wave, least(1.0, value / 100) AS q
        FROM {run_events} WHERE type = 'evaluation_complete'""",
    "bib_texts": """SELECT p_partkey AS doc_id, concat('Body of ', p_name, chr(10), 'References', chr(10),
        CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), '[1] ') ELSE concat(chr(10), '1. ') END, 'Smith, A. On the ', p_name, '. 2001. doi:10.1000/', CAST(p_partkey AS STRING), '.',
        CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), '[2] ') ELSE concat(chr(10), '2. ') END, 'Jones, B. Notes on ', p_type, '. arXiv:2101.', CAST(10000 + p_partkey % 10000 AS STRING), 'v2.',
        CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), '[3] ') ELSE concat(chr(10), '3. ') END, 'Brown, C. A survey of ', p_brand, '. PMID: ', CAST(p_partkey + 1 AS STRING)) AS text FROM {part}""",
    "catalog": "SELECT doc_id, text AS title, source AS author, CAST(2000 + doc_id % 20 AS INT) AS year FROM {documents} WHERE doc_id % 2 = 0",
    "entries": "SELECT doc_id, text AS title, source AS author, CAST(2000 + doc_id % 21 AS INT) AS year FROM {documents} WHERE doc_id % 2 = 1",
    "acquired": "SELECT doc_id AS paper_id, CASE WHEN quality = 1 THEN 'full_text' WHEN toxic = 1 THEN 'metadata' ELSE 'abstract' END AS content_kind FROM {labels}",
    "claims": """SELECT doc_id AS claim_id, doc_id % 25 AS agent_id, text, doc_id AS paper_id,
        CASE doc_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'disputed' WHEN 2 THEN 'proposed' ELSE 'unknown' END AS status,
        CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence FROM {documents}""",
    "exam_items": """SELECT item_id, text AS question, CASE item_id % 6 WHEN 0 THEN 'concepts_definitions' WHEN 1 THEN 'method_experimental_design' WHEN 2 THEN 'results_interpretation'
        WHEN 3 THEN 'assumptions_limitations' WHEN 4 THEN 'cross_paper' ELSE 'transfer_application' END AS category,
        CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, chr(CAST(65 + item_id % 4 AS INT)) AS correct_option_id FROM {benchmark}""",
    "answers": """SELECT 'survivor' AS responder, item_id, chr(CAST(65 + (item_id + CASE WHEN item_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS INT)) AS option_id FROM {benchmark}
        UNION ALL SELECT 'naive' AS responder, item_id, chr(CAST(65 + (item_id * 3) % 4 AS INT)) AS option_id FROM {benchmark} WHERE item_id % 9 <> 0""",
}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def _needed(text: str) -> list[str]:
    """The views that a text builds on, each after those it needs."""
    out: list[str] = []
    for name in _NAME.findall(text):
        if name in VIEWS:
            out += [x for x in (*_needed(VIEWS[name]), name) if x not in out]
    return out


def spark_sql(spark: SparkSession, sf_dir: str, text: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a text with its names in braces bound to the tables under sf_dir and the views; held: views that are there already."""
    frames: dict[str, DataFrame] = dict(held or {})
    for name in (*[x for x in _needed(text) if x not in frames], None):
        body = VIEWS[name] if name else text
        inputs = {x: frames.get(x) if x in VIEWS else spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in dict.fromkeys(_NAME.findall(body))}
        df = spark.sql(body, **inputs)
        if name is None:
            return df
        frames[name] = df
    raise AssertionError


def duck_sql(text: str) -> str:
    """The same text for DuckDB, its views as common table expressions."""
    needed = _needed(text)
    plain = lambda x: _NAME.sub(r"\1", x).replace(" DIV ", " // ")
    if not needed:
        return plain(text)
    head = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    return f"WITH {head}\n{plain(text)}"


class Inputs:
    """Tables and views by attribute, for a query's function."""

    def __init__(self, spark: SparkSession, sf_dir: str, held: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self._held = spark, sf_dir, held or {}

    def holding(self, *names: str) -> "Inputs":
        """The same with some views written once, also for the views that build on them."""
        out = Inputs(self.spark, self.sf_dir, dict(self._held))
        for name in names:
            out._held[name] = stored(getattr(out, name), name)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        return spark_sql(self.spark, self.sf_dir, f"SELECT * FROM {{{name}}}", self._held)
