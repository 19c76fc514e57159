"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.functions import maths, texts
from lodestrata.plans.registry import query

_DOI = r"regexp_replace(lower(regexp_replace({}, '\s+', '', 'g')), '^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi:)+', '')"
_ARXIV = r"regexp_replace(regexp_replace(lower(regexp_replace({}, '\s+', '', 'g')), '^(?:(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|arxiv:)+', ''), 'v\d+$', '')"
_TITLE = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"
_STOP = "['a','an','the','of','for','and','in','on','to','with','by','from']"
_TOKENS = "list_sort(list_distinct(list_filter(string_split(" + _TITLE + f", ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x))))"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))"
RAW = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(' https://doi.org/10.1000/AB', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('doi: 10.12/x', CAST(p_partkey AS STRING))
  WHEN 2 THEN concat('arXiv:2101.', CAST(10000 + p_partkey % 10000 AS STRING), 'v3') WHEN 3 THEN concat('https://arxiv.org/abs/cs/', CAST(1000000 + p_partkey AS STRING)) ELSE concat('PMID: ', CAST(p_partkey AS STRING)) END AS raw FROM {part}"""


def _raw(t):
    from lodestrata.plans.views import spark_sql

    return spark_sql(t.spark, t.sf_dir, RAW)


@query("str_normalize_ids", """SELECT p_partkey, CASE provider WHEN 'semantic_scholar' THEN 's2' WHEN 'pubmed' THEN 'pmid' ELSE provider END || ':' || p_partkey AS nid,
  CASE string_split(id, ':')[1] WHEN 's2' THEN 'semantic_scholar' WHEN 'pmid' THEN 'pubmed' ELSE string_split(id, ':')[1] END AS provider, string_split(id, ':')[2] AS native FROM {papers}""")
def str_normalize_ids(t):
    back = ids.parse_normalized_id(F.col("id"))
    native = F.when(F.col("p_partkey") % 2 == 0, F.upper("id")).otherwise(F.col("p_partkey").cast("string"))
    return t.papers.select("p_partkey", ids.normalize_id(F.col("provider"), native).alias("nid"), back["provider"].alias("provider"), back["native"].alias("native"))


@query("str_identifiers", rf"""WITH r AS ({RAW}), n AS (SELECT p_partkey, {_DOI.format("raw")} AS doi, {_ARXIV.format("raw")} AS arxiv, regexp_replace(lower(regexp_replace(raw, '\s+', '', 'g')), '^pmid:', '') AS pmid FROM r)
  SELECT *, regexp_matches(doi, '^10\.\d{{{{4,9}}}}/\S+$') AS doi_ok, regexp_matches(arxiv, '^(?:\d{{{{4}}}}\.\d{{{{4,5}}}}|[a-z-]+(?:\.[a-z-]+)?/\d{{{{7}}}})$') AS arxiv_ok, regexp_matches(pmid, '^\d{{{{1,9}}}}$') AS pmid_ok FROM n""".replace("{{", "{").replace("}}", "}"))
def str_identifiers(t):
    raw = F.col("raw")
    n = _raw(t).select("p_partkey", ids.normalize_doi(raw).alias("doi"), ids.normalize_arxiv(raw).alias("arxiv"), ids.normalize_pmid(raw).alias("pmid"))
    return n.select("*", ids.is_valid_doi(F.col("doi")).alias("doi_ok"), ids.is_valid_arxiv(F.col("arxiv")).alias("arxiv_ok"), ids.is_valid_pmid(F.col("pmid")).alias("pmid_ok"))


@query("str_alias_keys", """SELECT p_partkey, concat_ws(' ', CASE WHEN doi IS NOT NULL THEN 'doi:' || doi END, CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id END, 'pmid:' || p_partkey) AS keys FROM {papers}""")
def str_alias_keys(t):
    return t.papers.select("p_partkey", F.array_join(ids.alias_keys(F.col("doi"), F.col("arxiv_id"), F.col("p_partkey").cast("string")), " ").alias("keys"))


@query("str_dedup_key", f"""SELECT p_partkey, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id WHEN title IS NULL THEN id
  ELSE 'title:' || {_TITLE.format("title")} || ':' || lower(replace(author, '#', '')) || ':' || coalesce(year::VARCHAR, '') END AS key FROM (SELECT *, string_split(author, ' ')[-1] AS last FROM {{papers}}) x""".replace("lower(replace(author, '#', ''))", "lower(replace(last, '#', ''))"))
def str_dedup_key(t):
    c = F.col
    return t.papers.select("p_partkey", ids.dedup_key(c("doi"), c("arxiv_id"), c("title"), F.array("author"), c("year"), c("provider"), c("id")).alias("key"))


@query("str_completeness", """SELECT p_partkey, (title IS NOT NULL)::INT + (doi IS NOT NULL)::INT + (arxiv_id IS NOT NULL)::INT + (year IS NOT NULL)::INT + 1 + (abstract IS NOT NULL)::INT AS value FROM {papers}""")
def str_completeness(t):
    c = F.col
    return t.papers.select("p_partkey", ids.completeness(c("title"), c("doi"), c("arxiv_id"), c("year"), F.array("author"), c("abstract")).alias("value"))


@query("str_detect_seed", rf"""WITH r AS ({RAW}), n AS (SELECT p_partkey, trim(raw) AS raw, {_DOI.format("raw")} AS doi, {_ARXIV.format("raw")} AS arxiv FROM r), k AS (SELECT *, CASE WHEN regexp_matches(doi, '^10\.\d{{{{4,9}}}}/\S+$') THEN 'doi' WHEN regexp_matches(arxiv, '^(?:\d{{{{4}}}}\.\d{{{{4,5}}}}|[a-z-]+(?:\.[a-z-]+)?/\d{{{{7}}}})$') THEN 'arxiv' ELSE 'native' END AS kind FROM n)
  SELECT p_partkey, kind, CASE kind WHEN 'doi' THEN doi WHEN 'arxiv' THEN arxiv ELSE raw END AS value FROM k""".replace("{{", "{").replace("}}", "}"))
def str_detect_seed(t):
    return _raw(t).select("p_partkey", ids.detect_seed(F.col("raw")).alias("s")).select("p_partkey", "s.kind", "s.value")


@query("str_titles", f"""SELECT doc_id, {_TITLE.format("title")} AS title, array_to_string({_TOKENS.format("title")}, ' ') AS tokens FROM {{catalog}}""")
def str_titles(t):
    return t.catalog.select("doc_id", ids.normalize_title(F.col("title")).alias("title"), F.array_join(F.array_sort(ids.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("str_titles_match", f"""SELECT e.doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.3 OR len(a) = 0 OR len(b) = 0 AS alike
  FROM (SELECT e.doc_id, {_WORDS.format("e.title")} AS a, {_WORDS.format("c.title")} AS b FROM {{entries}} e JOIN {{catalog}} c ON c.doc_id = e.doc_id - 1) e""")
def str_titles_match(t):
    both = t.entries.select("doc_id", F.col("title").alias("a"), (F.col("doc_id") - 1).alias("k")).join(t.catalog.select(F.col("doc_id").alias("k"), F.col("title").alias("b")), "k")
    return both.select("doc_id", F.round(ids.jaccard(ids.words(F.col("a")), ids.words(F.col("b"))), 6).alias("jaccard"), ids.titles_match(F.col("a"), F.col("b")).alias("alike"))


@query("str_surnames", r"""SELECT doc_id, surname, CASE WHEN coalesce(surname, '') = '' THEN 0.0 WHEN doc_id % 2 = 0 AND surname <> 'such' THEN 0.5::DOUBLE ELSE 1.0 END AS overlap FROM (
  SELECT doc_id, lower(regexp_replace(regexp_split_to_array(trim(CASE WHEN word <> '' THEN 'x ' || word ELSE word END, ' '), '[ \t\n\x0B\f\r]+')[-1], '[^\p{L}\p{M}\p{N}_ \t\n\x0B\f\r]+', '', 'g')) AS surname
  FROM (SELECT doc_id, string_split(trim(replace(replace(text, chr(10), ' '), ',', ''), ' '), ' ')[1] AS word FROM {documents}) w) x""")
def str_surnames(t):
    """The first word of a text as the surname of "x word, Jane", and its share of expected surnames, every other time beside "no such"."""
    word = F.substring_index(F.trim(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(""))), " ", 1)
    rows = t.documents.select("doc_id", F.when(word != "", F.concat(F.lit("x "), word)).otherwise(word).alias("name"))
    rows = rows.select("doc_id", ids.surname(F.concat("name", F.lit(", Jane"))).alias("surname"), "name")
    expected = F.when(F.col("doc_id") % 2 == 0, F.array("name", F.lit("no such"))).otherwise(F.array("name"))
    return rows.select("doc_id", "surname", ids.author_overlap(expected, F.array("name")).alias("overlap"))


@query("str_year_matches", "SELECT p_partkey, coalesce(abs(year - 1990) <= 2, true) AS ok FROM {papers}")
def str_year_matches(t):
    return t.papers.select("p_partkey", ids.year_matches(F.col("year"), F.lit(1990)).alias("ok"))


@query("str_extract_ids", """SELECT doc_id, '10.1000/' || doc_id AS doi, '2101.' || (10000 + doc_id % 10000) AS arxiv, (doc_id + 1)::VARCHAR AS pmid FROM {bib_texts}""")
def str_extract_ids(t):
    text = F.col("text")
    return t.bib_texts.select("doc_id", F.array_join(ids.extract_doi(text), " ").alias("doi"), F.array_join(ids.extract_arxiv(text), " ").alias("arxiv"), F.array_join(ids.extract_pmid(text), " ").alias("pmid"))


@query("str_hashes", r"""SELECT doc_id, sha256(text) AS whole, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS entry, sha256(text || chr(10) || '---' || chr(10) || source) AS source, 'doc:' || left(sha256(text || '|' || source), 16) AS id FROM {documents}""")
def str_hashes(t):
    text = F.col("text")
    return t.documents.select("doc_id", texts.sha256_text(text).alias("whole"), texts.raw_entry_hash(text).alias("entry"), texts.source_hash(F.array("text", "source")).alias("source"), texts.stable_id("doc", text, F.col("source")).alias("id"))


@query("str_trims", r"""SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 2000) AS entry, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 240) AS excerpt, left(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 100) AS claim FROM {documents}""")
def str_trims(t):
    text = F.col("text")
    return t.documents.select("doc_id", texts.trim_entry(text).alias("entry"), texts.excerpt(text).alias("excerpt"), F.left(texts.normal_claim(text), F.lit(100)).alias("claim"))


_SECRET = texts.SECRET.replace("'", "''")


@query("str_redact_secrets", f"SELECT doc_id, regexp_replace(text, '{_SECRET.replace('{', '{{').replace('}', '}}')}', '\\1\\2\\3***', 'g') AS text FROM {{documents}}".replace("{{", "{").replace("}}", "}"))
def str_redact_secrets(t):
    return t.documents.select("doc_id", texts.redact_secrets(F.col("text")).alias("text"))


@query("str_redact_json")
def str_redact_json(t):
    return t.events.select("event_id", texts.redact_json(F.to_json(F.struct(F.col("event_type").alias("token"), F.concat(F.lit("key="), "event_type").alias("note")))).alias("payload"))


@query("str_content_kind", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND title IS NOT NULL THEN 'full_text' WHEN abstract IS NOT NULL THEN 'abstract' ELSE 'metadata' END AS kind, greatest(1, floor(length(coalesce(title, '')) / 4))::BIGINT AS tokens FROM {papers}")
def str_content_kind(t):
    full = F.when(F.col("p_partkey") % 4 == 0, F.col("title")).otherwise(F.lit(" "))
    return t.papers.select("p_partkey", texts.content_kind(full, F.col("abstract")).alias("kind"), texts.approx_tokens(F.coalesce("title", F.lit(""))).alias("tokens"))


@query("str_scope", r"""SELECT p_partkey, array_to_string(string_split(trim(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN ' my  question ' ELSE concat_ws(' ', title, year, abstract) END, '\s+', ' ', 'g')), ' ')[1:5], ' ') AS text, CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'derived' END AS origin FROM {papers}""")
def str_scope(t):
    own = F.when(F.col("p_partkey") % 3 == 0, " my  question ").otherwise(F.lit(" "))
    s = texts.scope(F.col("title"), F.col("year"), F.col("abstract"), own, most=5)
    return t.papers.select("p_partkey", s["text"].alias("text"), s["origin"].alias("origin"))


@query("str_safe_filename", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN replace(replace(p_name, ' ', '_'), '/', '_') || '_x' END AS name FROM {part}""")
def str_safe_filename(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat("p_name", F.lit("/../x"))).when(k % 7 == 0, F.concat("p_name", F.lit("/"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/x")))
    return t.part.select("p_partkey", texts.safe_filename(name).alias("name"))


@query("str_lookup_key", """SELECT p_partkey, CASE WHEN provider = 'openalex' THEN p_partkey::VARCHAR WHEN doi IS NOT NULL THEN doi WHEN arxiv_id IS NOT NULL THEN '10.48550/arxiv.' || arxiv_id END AS openalex,
  CASE WHEN provider = 'semantic_scholar' THEN p_partkey::VARCHAR WHEN doi IS NOT NULL THEN 'DOI:' || doi WHEN arxiv_id IS NOT NULL THEN 'arXiv:' || arxiv_id END AS s2 FROM {papers}""")
def str_lookup_key(t):
    key = lambda target: ids.lookup_key(F.lit(target), F.col("provider"), F.col("p_partkey").cast("string"), F.col("doi"), F.col("arxiv_id"))
    return t.papers.select("p_partkey", key("openalex").alias("openalex"), key("semantic_scholar").alias("s2"))


@query("src_html_to_text", r"""SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 5000) AS text FROM {pages}""")
def src_html_to_text(t):
    return t.pages.select("page_id", texts.html_to_text(F.col("html"), 5000).alias("text"))


@query("src_model_json", "SELECT p_partkey, p_name AS title, p_size AS size FROM {part} WHERE p_partkey % 4 <> 3")
def src_model_json(t):
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("size")))
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(k == 2, body).otherwise(F.lit("none {"))
    return t.part.select("p_partkey", texts.parse_model_json(raw, "title string, size int").alias("x")).where("x is not null").select("p_partkey", "x.title", "x.size")


_WEIGHTS = {"sim": 0.4, "citations": 0.3, "recency": 0.2, "confidence": 0.1}
_CONF = "greatest(0, least(1, CASE provider WHEN 'openalex' THEN 0.95 WHEN 'semantic_scholar' THEN 0.9 WHEN 'pubmed' THEN 0.85 WHEN 'arxiv' THEN 0.8 ELSE 0.4 END + CASE WHEN doi IS NOT NULL OR arxiv_id IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN abstract IS NOT NULL THEN 0.05 ELSE 0 END - CASE WHEN title IS NULL THEN 0.2 ELSE 0 END))"
ETA = f"""SELECT p.id, (list_cosine_similarity(v.embedding::DOUBLE[], s.embedding::DOUBLE[]) + 1) / 2 AS sim, 1 / (1 + exp(-ln(1 + citation_count) / 5)) AS citations,
  greatest(0, least(1, (coalesce(year, 2000) - 1950) / 75.0)) AS recency, {_CONF} AS confidence FROM {{papers}} p JOIN {{vectors}} v ON v.id = p.id JOIN (SELECT embedding FROM {{embeddings}} WHERE vec_id = 1) s ON true"""


def eta_table(t):
    """papers with their eta components against the vector of the seed and eta itself."""
    c = F.col
    seed = t.embeddings.where("vec_id = 1").select("embedding").first()[0]  # one vector
    near = t.papers.join(t.vectors, "id").withColumn("seed", F.array(*[F.lit(float(x)) for x in seed]))
    parts = maths.eta_components(maths.cosine(c("embedding"), c("seed")), c("citation_count"), c("year"), maths.provider_confidence(c("provider"), c("doi"), c("arxiv_id"), c("abstract"), c("title")))
    return near.select("id", parts.alias("e")).withColumn("eta", maths.eta(F.col("e"), _WEIGHTS))


@query("mth_eta", f"SELECT id, round(sim, 5) AS sim, round(citations, 6) AS citations, round(recency, 6) AS recency, round(confidence, 6)::DOUBLE AS confidence, round(1 / (1 + exp(-(0.4 * sim + 0.3 * citations + 0.2 * recency + 0.1 * confidence))), 5) AS eta FROM ({ETA}) e")
def mth_eta(t):
    return eta_table(t).select("id", F.round("e.sim", 5).alias("sim"), *[F.round(f"e.{x}", 6).alias(x) for x in ("citations", "recency", "confidence")], F.round("eta", 5).alias("eta"))


@query("mth_direction", """SELECT agent_id, round(CASE caste WHEN 'fundaciones' THEN 0.8 WHEN 'impacto' THEN 0.3 ELSE 0.6 END, 6)::DOUBLE AS ref, round(CASE caste WHEN 'fundaciones' THEN 0.2 WHEN 'impacto' THEN 0.7 ELSE 0.4 END, 6)::DOUBLE AS cites FROM {agents}""")
def mth_direction(t):
    d = maths.caste_direction(F.col("caste"), F.lit(0.6), F.lit(0.4))
    return t.agents.select("agent_id", F.round(d["ref"], 6).alias("ref"), F.round(d["cites"], 6).alias("cites"))


@query("mth_transition_weight", "SELECT agent_id, src, dst, mode, round(pow(tau, 2) * 0.5 * CASE mode WHEN 'ref' THEN 0.6 ELSE 0.4 END, 6) AS weight FROM {pheromone}")
def mth_transition_weight(t):
    return t.pheromone.select("agent_id", "src", "dst", "mode", F.round(maths.transition_weight(F.col("tau"), 2.0, F.lit(0.5), 1.0, F.when(F.col("mode") == "ref", 0.6).otherwise(0.4)), 6).alias("weight"))


@query("mth_kernel_score", "SELECT id, round(least(1.0, 0.5 + CASE WHEN abstract IS NOT NULL THEN 0.3 ELSE 0 END + least(0.2, citation_count / 5000)), 6) AS score FROM {papers}")
def mth_kernel_score(t):
    return t.papers.select("id", maths.kernel_score(F.col("abstract"), F.col("citation_count")).alias("score"))


@query("mth_caste_assignment", "SELECT agent_id, CASE WHEN k <= greatest(1, floor(0.4 * n)) THEN 'fundaciones' WHEN k <= greatest(1, floor(0.4 * n)) + greatest(1, floor(0.3 * n)) THEN 'impacto' ELSE 'mixto' END AS caste, greatest(1, 500 // n)::BIGINT AS budget FROM (SELECT agent_id, row_number() OVER (ORDER BY agent_id) AS k, count(*) OVER () AS n FROM {agents}) a")
def mth_caste_assignment(t):
    from lodestrata.operators.frontier import assign_castes

    return assign_castes(t.agents.select("agent_id"), 500)


@query("mth_budget", "SELECT agent_id, greatest(0, 5 - budget)::BIGINT AS remaining, budget >= 5 AS exhausted FROM {agents}")
def mth_budget(t):
    return t.agents.select("agent_id", F.greatest(F.lit(0), 5 - F.col("budget")).cast("long").alias("remaining"), (F.col("budget") >= 5).alias("exhausted"))
