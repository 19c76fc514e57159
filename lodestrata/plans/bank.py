"""Queries of question banks, their outcomes, and evidence from full texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.operators import bank as bk
from lodestrata.operators import exams as ex
from lodestrata.plans.exams import _GRADED
from lodestrata.plans.registry import query
from lodestrata.plans.views import spark_sql
from lodestrata.sources import papers as src
from lodestrata.tables import new_path

c = F.col


def _sql(t, text):
    return spark_sql(t.spark, t.sf_dir, text)


_PACK = "SELECT concat('s', CAST(doc_id AS STRING)) AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'deeper' ELSE 'direct_reference' END AS source_distance, CASE WHEN quality = 1 THEN 'full_text' ELSE 'abstract' END AS content_kind FROM {labels}"
_EVIDENCE = "SELECT item_id, r_regionkey AS place, concat('s', CAST(item_id * 7 + r_regionkey * (item_id % 3 + 1) AS STRING)) AS source_id FROM {exam_items} CROSS JOIN {region} WHERE r_regionkey < 2"


@query("agg_score_exam_sources", f"""SELECT responder, CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(difficulty) = 0 THEN 'difficulty' WHEN GROUPING(distance) = 0 THEN 'source_distance' WHEN GROUPING(kind) = 0 THEN 'content_kind' ELSE 'all' END AS dimension, coalesce(category, difficulty, distance, kind, 'all') AS bucket, count(*) FILTER (correct) AS correct, count(*) AS total FROM (
  SELECT g.*, coalesce(s.far, 'seed') AS distance, s.kind FROM ({_GRADED}) g LEFT JOIN (SELECT item_id, max(CASE WHEN place = 0 THEN source_distance END) AS far, arg_min(content_kind, place) AS kind FROM ({_EVIDENCE}) e JOIN ({_PACK}) p USING (source_id) GROUP BY item_id) s ON s.item_id = g.item_id) x
  GROUP BY GROUPING SETS ((responder), (responder, category), (responder, difficulty), (responder, distance), (responder, kind)) HAVING NOT (GROUPING(kind) = 0 AND kind IS NULL)""")
def agg_score_exam_sources(t):
    refs = _sql(t, _EVIDENCE).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda x: x["source_id"]).alias("evidence"))
    items = t.exam_items.join(refs, "item_id").withColumn("source_distance", F.lit("seed"))
    return bk.score_exam(t.answers, items, _sql(t, _PACK))


_CANDIDATES = "SELECT c_custkey AS agent_id, CASE WHEN c_custkey % 7 <> 3 THEN (c_custkey % 11) / 10 END AS selection, (c_custkey % 5) / 4 AS process, (c_custkey % 3) / 2 AS grounding, c_custkey % 13 <> 0 AS has_dossier, c_custkey % 17 <> 1 AS provenance, c_custkey % 19 AS answered, (c_custkey % 4) / 4 AS coverage FROM {customer}"


@query("top_survivor_eligibility", f"""SELECT agent_id, reason, terminal, CASE WHEN reason IS NULL THEN place END AS rank, reason IS NULL AND place = 1 AS survivor, agent_id = (SELECT arg_min(agent_id, (-process, agent_id)) FROM ({_CANDIDATES}) p) AS process_peak FROM (
  SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY terminal DESC, coalesce(selection, 0) DESC, grounding DESC, process DESC, agent_id) AS place FROM (SELECT *, CASE WHEN reason IS NULL THEN round(0.7 * coalesce(selection, 0) + 0.2 * process + 0.1 * grounding, 6)::DOUBLE END AS terminal FROM (
  SELECT *, CASE WHEN NOT has_dossier THEN 'no_evidence_bearing_dossier' WHEN NOT provenance THEN 'provenance_integrity_failed' WHEN selection IS NULL OR answered <= 0 THEN 'no_selection_response' WHEN coverage < 0.5 THEN 'below_min_examination_coverage' END AS reason FROM ({_CANDIDATES}) x) y) z) w""")
def top_survivor_eligibility(t):
    return bk.select_survivor(_sql(t, _CANDIDATES))


_PARTS = "SELECT item_id, CASE WHEN k <= 20 THEN 'selection' ELSE 'holdout' END AS part FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('7:' || item_id), item_id) AS k FROM {exam_items}) x WHERE k <= 30"


@query("snk_frozen_key", f"SELECT p.item_id, part, correct_option_id, sha256(p.item_id || '|' || correct_option_id) AS entry_hash FROM ({_PARTS}) p JOIN {{exam_items}} i ON i.item_id = p.item_id")
def snk_frozen_key(t):
    return bk.frozen_key(t.exam_items, bk.split_bank(t.exam_items, 20, 10, 7))[0]


@query("snk_key_hashes", f"SELECT part, count(*) AS entries, sha256(string_agg(h, ',' ORDER BY item_id)) AS key_hash FROM (SELECT p.item_id, part, sha256(p.item_id || '|' || correct_option_id) AS h FROM ({_PARTS}) p JOIN {{exam_items}} i ON i.item_id = p.item_id) x GROUP BY part")
def snk_key_hashes(t):
    return bk.frozen_key(t.exam_items, bk.split_bank(t.exam_items, 20, 10, 7))[1]


_CHECKED = "SELECT item_id, concat_ws(',', CASE WHEN item_id % 5 = 1 THEN 'missing_key' END, CASE WHEN item_id % 7 = 1 THEN 'answer_leakage' END) AS reasons FROM {exam_items}"
_OUTCOMES = " UNION ALL ".join(f"SELECT 'outcomes', responder || '|' || {label}, part, count(*), count(*) FILTER (correct) FROM m GROUP BY 2, 3" for label in ("'all'", "'category:' || category", "'difficulty:' || difficulty"))


@query("snk_public_outcome", f"""SELECT * FROM (WITH k AS ({_CHECKED}), p AS ({_PARTS}), m AS (SELECT g.*, part FROM ({_GRADED}) g JOIN p ON p.item_id = g.item_id)
  SELECT 'items' AS section, CASE reasons WHEN '' THEN 'accepted' ELSE 'rejected' END AS label, NULL::VARCHAR AS part, count(*) AS n, NULL::BIGINT AS correct FROM k GROUP BY 2 UNION ALL SELECT 'items', 'generated', NULL, count(*), NULL FROM k
  UNION ALL SELECT 'rejections', label, NULL, count(*), NULL FROM (SELECT unnest(string_split(reasons, ',')) AS label FROM k WHERE reasons <> '') r GROUP BY label UNION ALL SELECT 'parts', 'size', part, count(*), NULL FROM p GROUP BY part UNION ALL {_OUTCOMES}) x""")
def snk_public_outcome(t):
    return bk.public_outcome(_sql(t, _CHECKED), bk.split_bank(t.exam_items, 20, 10, 7), ex.graded(t.answers, t.exam_items))


@query("set_bank_issues", f"""SELECT * FROM (WITH i AS (SELECT item_id FROM {{exam_items}}), p AS (SELECT * FROM ({_PARTS}) x UNION ALL SELECT item_id, 'holdout' FROM ({_PARTS}) x WHERE item_id % 6 = 0 UNION ALL SELECT 5000 + r_regionkey, 'selection' FROM {{region}}), k AS (SELECT item_id + CASE WHEN item_id % 9 = 0 THEN 9000 ELSE 0 END AS item_id FROM i)
  SELECT 'in_both_parts' AS code, item_id FROM p GROUP BY item_id HAVING count(DISTINCT part) > 1 UNION ALL SELECT DISTINCT 'not_in_bank', item_id FROM p WHERE item_id NOT IN (SELECT item_id FROM i)
  UNION ALL SELECT DISTINCT 'without_key', item_id FROM p WHERE item_id NOT IN (SELECT item_id FROM k) UNION ALL SELECT 'key_without_item', item_id FROM k WHERE item_id NOT IN (SELECT item_id FROM i)) z""")
def set_bank_issues(t):
    parts = bk.split_bank(t.exam_items, 20, 10, 7)
    parts = parts.unionByName(parts.where("item_id % 6 = 0").select("item_id", F.lit("holdout").alias("part"))).unionByName(t.region.select((5000 + c("r_regionkey")).cast("long").alias("item_id"), F.lit("selection").alias("part")))
    key = t.exam_items.select((c("item_id") + F.when(c("item_id") % 9 == 0, 9000).otherwise(0)).alias("item_id"), "correct_option_id")
    return bk.bank_issues(t.exam_items, parts, key)


_BUCKETED = """SELECT run_id, seq, 'benchmark_completed' AS type, concat(chr(123), '"by_category": ', chr(123), '"a": ', chr(123), '"correct": ', CAST(seq % 5 AS STRING), ', "total": 5', chr(125), ', "b', CAST(event_id % 3 AS STRING), '": ', chr(123), '"total": ', CAST(seq AS STRING), chr(125), chr(125), ', "naive_by_difficulty": ', chr(123), '"easy": ', chr(123), '"correct": 1, "total": 2', chr(125), chr(125), chr(125)) AS payload FROM {run_events} WHERE type = 'evaluation_complete'"""


@query("stm_exam_buckets", """WITH l AS (SELECT run_id, max(seq) AS seq, arg_max(event_id, seq) AS event_id FROM {run_events} WHERE type = 'evaluation_complete' GROUP BY run_id)
  SELECT run_id, 'by_category' AS kind, 'a' AS bucket, seq % 5 AS correct, 5 AS total FROM l UNION ALL SELECT run_id, 'by_category', 'b' || (event_id % 3), 0, seq FROM l UNION ALL SELECT run_id, 'naive_by_difficulty', 'easy', 1, 2 FROM l""".replace("WITH l", "SELECT * FROM (WITH l") + ") x")
def stm_exam_buckets(t):
    return bk.exam_buckets(_sql(t, _BUCKETED))


_FULL = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '  ' ELSE text END AS fulltext, CASE WHEN doc_id % 8 <> 0 THEN concat(source, ' ', left(text, 300)) END AS abstract FROM {documents}"


@query("exp_evidence_rows", f"""SELECT 'ev:' || left(sha256(id || '|' || locator), 16) AS evidence_id, id AS paper_id, kind AS content_kind, locator, sha256(text) AS content_hash, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS excerpt FROM (
  SELECT id, 'full_text' AS kind, 'chunk:' || i AS locator, substring(fulltext, i * 2000 + 1, 2000) AS text FROM (SELECT *, unnest(range(least(30, ceil(length(fulltext) / 2000)::BIGINT))) AS i FROM ({_FULL}) f WHERE trim(fulltext) <> '') x UNION ALL SELECT id, 'abstract', 'abstract', abstract FROM ({_FULL}) f WHERE trim(coalesce(fulltext, '')) = '' AND abstract IS NOT NULL) y WHERE trim(regexp_replace(text, '\\s+', '', 'g')) <> ''""")
def exp_evidence_rows(t):
    rows = _sql(t, _FULL).withColumn("id", c("id").cast("string"))
    return bk.evidence_rows(rows, size=2000, most=30).withColumn("paper_id", c("paper_id").cast("long"))


_RECORDS = """SELECT run_id, seq, CASE WHEN event_id % 9 = 0 THEN concat(chr(123), '"q": ') ELSE concat(chr(123), '"agent_id": "', coalesce(agent_id, 'none'), '", "oleada": ', CAST(seq DIV 10 AS STRING), ', "turn": ', CASE WHEN event_id % 7 = 0 THEN '"x"' ELSE CAST(seq % 3 AS STRING) END, ', "q": ', CAST(event_id % 101 AS STRING), '.5, "self_assessment": ', chr(123), '"score": 0.', CAST(event_id % 10 AS STRING), chr(125),
  ', "peers": ', chr(123), '"aggregated_score": 0.25', chr(125), CASE WHEN event_id % 2 = 0 THEN concat(', "virgin_judge": ', chr(123), '"score": 1', chr(125)) ELSE '' END, ', "structural": ', chr(123), '"r": 0.5', chr(125), chr(125)) END AS payload FROM {run_events}"""


@query("flt_evaluation_summary", "SELECT run_id, coalesce(agent_id, 'none') AS agent_id, seq // 10 AS wave, CASE WHEN event_id % 7 <> 0 THEN seq % 3 END AS turn, event_id % 101 + 0.5::DOUBLE AS q, NULL::DOUBLE AS delta_q, (event_id % 10) / 10 AS s, 0.25::DOUBLE AS p, CASE WHEN event_id % 2 = 0 THEN 1.0 END::DOUBLE AS j, 0.5::DOUBLE AS r FROM {run_events} WHERE event_id % 9 <> 0")
def flt_evaluation_summary(t):
    return bk.evaluation_summary(_sql(t, _RECORDS))


@query("src_bank_errors", "SELECT CASE item_id % 6 WHEN 0 THEN 'no_object' WHEN 1 THEN 'no_question' WHEN 2 THEN 'no_options' ELSE 'no_key' END AS reason, count(*) AS n FROM {exam_items} WHERE item_id % 6 < 4 GROUP BY 1")
def src_bank_errors(t):
    """A bank with broken lines and empty ones between, written as text and read back."""
    k = c("item_id") % 6
    options = F.when(k == 2, F.array().cast("array<struct<option_id:string,text:string>>")).otherwise(F.array(F.struct(F.lit("A").alias("option_id"), F.lit("x").alias("text"))))
    row = F.to_json(F.struct(F.concat(F.lit("q"), c("item_id").cast("string")).alias("question_id"), F.when(k != 1, c("question")).alias("question"), options.alias("options"), F.when(k != 3, F.array("correct_option_id")).alias("correct_option_ids")))
    path = new_path(t.spark, "bank-text")
    t.exam_items.select(F.concat(F.when(k == 0, "{broken").otherwise(row), F.when(k == 4, "\n").otherwise("")).alias("value")).write.text(path)
    return bk.bank_errors(t.spark, path).groupBy("reason").agg(F.count("*").alias("n"))


@query("str_fetch_values", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doi' WHEN 4 THEN 'native' ELSE 'arxiv' END AS kind, CASE doc_id % 5 WHEN 0 THEN '10.1000/' || doc_id WHEN 4 THEN 'W' || doc_id ELSE '2101.' || (10000 + doc_id % 10000) END AS value, CASE doc_id % 5 WHEN 0 THEN '10.1000/' || doc_id WHEN 4 THEN 'W' || doc_id ELSE '2101.' || (10000 + doc_id % 10000) || CASE doc_id % 5 WHEN 3 THEN '' ELSE 'v2' END END AS fetch_value FROM {documents}")
def str_fetch_values(t):
    k = c("doc_id")
    arxiv = F.concat(F.lit("2101."), (10000 + k % 10000).cast("string"))
    raw = F.when(k % 5 == 0, F.concat(F.lit(" https://doi.org/10.1000/"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit("v2.pdf"))).when(k % 5 == 2, F.concat(F.lit("arXiv: "), arxiv, F.lit("v2 "))).when(k % 5 == 3, arxiv).otherwise(F.concat(F.lit("W"), k.cast("string")))
    return t.documents.select("doc_id", ids.detect_seed(raw).alias("s")).select("doc_id", "s.*")


@query("src_manifest", """SELECT 'category' AS kind, category AS label, count(*) AS wanted FROM {exam_items} GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM {exam_items} GROUP BY 2
  UNION ALL SELECT 'paper', paper_id, NULL FROM (SELECT 'n' || n_nationkey AS paper_id FROM {nation}) p""")
def src_manifest(t):
    """A manifest of the bank, written as one JSON document over several lines and read back."""
    counted = lambda name: t.exam_items.groupBy(name).agg(F.count("*").cast("int").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(name, "n"))).alias(name))  # noqa: E731  # a bank's labels
    papers = t.nation.agg(F.collect_list(F.struct(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("paper_id"), c("n_name").alias("title"))).alias("papers"))
    row = papers.join(F.broadcast(counted("category"))).join(F.broadcast(counted("difficulty")))  # one row each
    text = F.to_json(F.struct("papers", c("category").alias("categories"), c("difficulty").alias("difficulties"), F.lit("x").alias("bank_sha256")), {"pretty": "true"})
    path = new_path(t.spark, "manifest")
    row.select(text.alias("value")).write.text(path)
    read = src.read_manifest(t.spark, path)
    labels = [read.select(F.lit(kind).alias("kind"), F.explode(name).alias("label", "n")).select("kind", "label", c("n").cast("long").alias("wanted")) for kind, name in (("category", "categories"), ("difficulty", "difficulties"))]
    return labels[0].unionByName(labels[1]).unionByName(read.select(F.lit("paper").alias("kind"), F.explode("papers.paper_id").alias("label"), F.lit(None).cast("long").alias("wanted")))
