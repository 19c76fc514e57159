"""Queries of the citation graph and the frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import maths
from lodestrata.operators import citations as g
from lodestrata.operators import frontier as fr
from lodestrata.plans.registry import query
from lodestrata.plans.scalar import ETA, eta_table

c = F.col


@query("snk_upsert_papers", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.title ELSE a.title END AS title, coalesce(b.embedding, a.embedding) AS embedding, coalesce(a.integrated, false) OR coalesce(b.integrated, false) AS integrated
  FROM (SELECT id, title, abstract AS embedding, p_partkey % 3 = 0 AS integrated FROM {papers} WHERE p_partkey % 4 <> 0) a FULL JOIN (SELECT id, title || '!' AS title, CASE WHEN p_partkey % 5 = 1 THEN 'new' END AS embedding, p_partkey % 7 = 0 AS integrated FROM {papers} WHERE p_partkey % 2 = 0) b ON a.id = b.id""")
def snk_upsert_papers(t):
    k = c("p_partkey")
    old = t.papers.where(k % 4 != 0).select("id", "title", c("abstract").alias("embedding"), (k % 3 == 0).alias("integrated"))
    new = t.papers.where(k % 2 == 0).select("id", F.concat("title", F.lit("!")).alias("title"), F.when(k % 5 == 1, "new").alias("embedding"), (k % 7 == 0).alias("integrated"))
    return g.upsert_papers(old, new)


@query("snk_insert_missing", """SELECT id, title FROM {papers} WHERE p_partkey % 2 = 0 UNION ALL SELECT id, min(v) AS title FROM (SELECT id, p_partkey, concat(unnest(['b ', 'a ']), author) AS v FROM {papers}) x WHERE p_partkey % 2 = 1 AND p_partkey % 3 = 0 GROUP BY id""")
def snk_insert_missing(t):
    k = c("p_partkey")
    new = t.papers.where(k % 3 == 0).select("id", F.explode(F.array(F.concat(F.lit("b "), "author"), F.concat(F.lit("a "), "author"))).alias("title"))
    return g.insert_missing(t.papers.where(k % 2 == 0).select("id", "title"), new, ["id"], ["title"])


@query("snk_edge_provenance", "SELECT src, dst, min(provider) AS provider, count(*) AS observations FROM (SELECT concat('o:', l_orderkey) AS src, p.id AS dst, p.provider || l_linenumber AS provider FROM {lineitem} JOIN {papers} p ON p_partkey = l_partkey) x GROUP BY src, dst")
def snk_edge_provenance(t):
    seen = t.lineitem.join(t.papers, c("p_partkey") == c("l_partkey")).select(F.concat(F.lit("o:"), c("l_orderkey").cast("string")).alias("src"), c("id").alias("dst"), F.concat("provider", c("l_linenumber").cast("string")).alias("provider"))
    return g.edge_provenance(seen)


@query("flt_edge_observations", "SELECT src, dst, evidence_type, provider FROM (SELECT concat('o:', l_orderkey) AS src, p.id AS dst, l_returnflag AS evidence_type, p.provider FROM {lineitem} JOIN {papers} p ON p_partkey = l_partkey) x WHERE evidence_type = 'R' AND dst = 'openalex:4'")
def flt_edge_observations(t):
    seen = t.lineitem.join(t.papers, c("p_partkey") == c("l_partkey")).select(F.concat(F.lit("o:"), c("l_orderkey").cast("string")).alias("src"), c("id").alias("dst"), c("l_returnflag").alias("evidence_type"), "provider")
    return g.edge_observations(seen, dst="openalex:4", evidence_type="R")


@query("set_union_edges", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {edges} UNION ALL SELECT dst AS src, src AS dst FROM {edges}) x")
def set_union_edges(t):
    return g.union_edges(t.edges, t.edges)


@query("join_neighbors", "SELECT n.id, e.dst AS neighbor, 'ref' AS mode FROM (SELECT src AS id FROM {edges} GROUP BY src UNION ALL SELECT id FROM {papers}) n JOIN {edges} e ON e.src = n.id UNION ALL SELECT n.id, e.src, 'cites' FROM (SELECT src AS id FROM {edges} GROUP BY src UNION ALL SELECT id FROM {papers}) n JOIN {edges} e ON e.dst = n.id")
def join_neighbors(t):
    nodes = t.edges.select(c("src").alias("id")).distinct().unionByName(t.papers.select("id"))
    return g.neighbors(nodes, t.edges)


@query("itr_alias_closure", "SELECT * FROM (WITH RECURSIVE r AS (SELECT alias, canonical_id FROM {aliases} UNION ALL SELECT r.alias, a.canonical_id FROM r JOIN {aliases} a ON a.alias = r.canonical_id) SELECT alias, canonical_id FROM r WHERE canonical_id NOT IN (SELECT alias FROM {aliases})) x")
def itr_alias_closure(t):
    return g.canonicalize(t.aliases)


SEEDS = "SELECT id FROM {papers} WHERE p_partkey % 97 = 0"


@query("itr_k_hop", f"WITH s AS ({SEEDS}), h1 AS (SELECT DISTINCT src AS id FROM {{edges}} WHERE dst IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT dst AS id FROM {{edges}} WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM s)) SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2".replace("WITH s", "SELECT * FROM (WITH s") + ") x")
def itr_k_hop(t):
    return g.k_hop(t.papers.where("p_partkey % 97 = 0").select("id"), t.edges, 2)


_PAIRS = "SELECT a.agent_id, a.node, b.node AS next FROM {visits_mixed} a JOIN {edges} e ON e.src = a.node JOIN {visits_mixed} b ON b.agent_id = a.agent_id AND b.node = e.dst"


COHERENCE = f"""SELECT * FROM (WITH RECURSIVE p AS MATERIALIZED ({_PAIRS}), q AS MATERIALIZED (SELECT agent_id, node, next FROM p UNION SELECT agent_id, next, node FROM p),
  r AS (SELECT agent_id, arg_min(node, (ordinal, node)) AS node FROM {{visits_mixed}} GROUP BY agent_id UNION SELECT q.agent_id, q.next FROM r JOIN q ON q.agent_id = r.agent_id AND q.node = r.node),
  n AS (SELECT agent_id, count(*) AS n FROM {{visits_mixed}} GROUP BY agent_id) SELECT r.agent_id, round(count(*) / min(n), 6) AS coherence FROM r JOIN n ON n.agent_id = r.agent_id GROUP BY r.agent_id) x"""


@query("itr_coherence", COHERENCE)
def itr_coherence(t):
    return g.coherence(t.visits_mixed, t.edges).select("agent_id", F.round("coherence", 6).alias("coherence"))


@query("join_source_distance", "SELECT id, CASE WHEN id = 'openalex:4' THEN 'seed' WHEN id IN (SELECT id FROM {papers} WHERE p_partkey % 5 = 0) THEN 'direct_reference' WHEN id IN (SELECT id FROM {papers} WHERE p_partkey % 3 = 0) THEN 'citant' ELSE 'deeper' END AS distance FROM {papers}")
def join_source_distance(t):
    k = c("p_partkey")
    edges = t.papers.where(k % 5 == 0).select(F.lit("openalex:4").alias("src"), c("id").alias("dst")).unionByName(t.papers.where(k % 3 == 0).select(c("id").alias("src"), F.lit("openalex:4").alias("dst")))
    return g.source_distance(t.papers, edges, "openalex:4")


@query("src_search_papers", "SELECT id, citation_count, count(*) AS overlap FROM (SELECT DISTINCT id, citation_count, unnest(string_split(lower(title), ' ')) AS word FROM {papers}) x WHERE word IN ('red', 'blue', 'part', 'green', 'steel') GROUP BY ALL ORDER BY overlap DESC, citation_count DESC, id LIMIT 20")
def src_search_papers(t):
    return g.search_papers(t.papers, ["red", "blue", "part", "green", "steel"], 20)


@query("join_hydrate", "SELECT id, coalesce(title, concat('full ', author)) AS title FROM {papers} WHERE provider = 'openalex'")
def join_hydrate(t):
    stubs = t.papers.where("provider = 'openalex'").select("id", "title")
    full = t.papers.select("id", F.concat(F.lit("full "), "author").alias("full"))
    return stubs.join(full, "id", "left").select("id", F.coalesce("title", "full").alias("title"))


@query("flt_readable", "SELECT q.id, coalesce(abstract IS NOT NULL AND p.id IS NOT NULL, false) AS readable, coalesce(p_partkey % 3 = 0, false) AS integrated FROM (SELECT id FROM {papers} UNION ALL SELECT 'x:' || p_partkey FROM {papers}) q LEFT JOIN {papers} p ON p.id = q.id")
def flt_readable(t):
    papers = t.papers.select("id", "abstract", (c("p_partkey") % 3 == 0).alias("integrated"))
    return g.readable(t.papers.select("id").unionByName(t.papers.select(F.concat(F.lit("x:"), c("p_partkey").cast("string")).alias("id"))), papers)


@query("flt_lookup", "SELECT id, title, year FROM {papers} WHERE title IN (SELECT title FROM {papers} WHERE p_partkey % 10 = 1)")
def flt_lookup(t):
    keys = t.papers.where("p_partkey % 10 = 1 and title is not null")
    return g.lookup(t.papers, keys, ["title"]).select("id", "title", "year")


@query("flt_lookup_aliases", "SELECT alias, canonical_id FROM {aliases} WHERE canonical_id IN (SELECT concat('alias:', CAST(o_custkey AS STRING)) FROM {orders})")
def flt_lookup_aliases(t):
    return g.lookup(t.aliases, t.orders.select(F.concat(F.lit("alias:"), c("o_custkey").cast("string")).alias("canonical_id")), ["canonical_id"])


FRONTIER = """SELECT a.agent_id, p.id, p.p_partkey AS ordinal, CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE (p.p_partkey * 31 + a.agent_id * 17) % 101 / 100 END AS score,
  CASE WHEN p.p_partkey % 13 = 0 THEN 1 END AS claimed_by, p.p_partkey % 5 AS attempts, p.p_partkey % 11 AS next_turn FROM {agents} a JOIN {papers} p ON p.p_partkey % 25 = a.agent_id"""


def _frontier(t):
    from lodestrata.plans.views import spark_sql

    return spark_sql(t.spark, t.sf_dir, FRONTIER)


@query("flt_eligible_frontier", f"SELECT f.agent_id, f.id FROM ({FRONTIER}) f WHERE claimed_by IS NULL AND attempts < 3 AND next_turn <= 6 AND NOT EXISTS (SELECT 1 FROM {{read_papers}} v WHERE v.agent_id = f.agent_id AND v.id = f.id)")
def flt_eligible_frontier(t):
    return fr.eligible(_frontier(t), t.read_papers, 6).select("agent_id", "id")


@query("top_best_frontier", f"SELECT agent_id, arg_max(id, (coalesce(score, 0), -ordinal)) AS id FROM ({FRONTIER}) f GROUP BY agent_id")
def top_best_frontier(t):
    return fr.best_candidates(_frontier(t))


@query("top_greedy", f"SELECT agent_id, id, rank, CASE WHEN score <= 0 THEN 'no_score' WHEN rank <= 3 THEN 'selected' ELSE 'over_capacity' END AS reason FROM (SELECT agent_id, id, score, row_number() OVER (PARTITION BY agent_id ORDER BY round(score, 9) DESC, id) AS rank FROM ({FRONTIER}) f WHERE score IS NOT NULL) r")
def top_greedy(t):
    return fr.greedy(_frontier(t).where("score is not null"), 3).select("agent_id", "id", "rank", "reason")


@query("top_alternatives", f"SELECT agent_id, id, rank FROM (SELECT agent_id, id, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC NULLS LAST, id) AS rank FROM ({FRONTIER}) f) r WHERE rank <= 12")
def top_alternatives(t):
    return fr.top_alternatives(_frontier(t)).select("agent_id", "id", "rank")


PRIORITY = "SELECT agent_id, caste, round(budget / 10 + 0.5 * least(1.0, n / 20) + 0.1 * budget, 6) AS priority, n AS n_frontier FROM (SELECT a.agent_id, a.caste, a.budget, coalesce(n, 0) AS n FROM {agents} a LEFT JOIN (SELECT p_partkey % 30 AS agent_id, count(*) AS n FROM {papers} GROUP BY 1) f ON f.agent_id = a.agent_id) x"


def priorities(t):
    sizes = t.papers.groupBy((c("p_partkey") % 30).alias("agent_id")).agg(F.count("*").alias("n"))
    rows = t.agents.join(sizes, "agent_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("agent_id", "caste", F.round(maths.agent_priority(c("budget") / 10, c("n"), c("budget"), 0.5, 0.1), 6).alias("priority"), c("n").alias("n_frontier"))


@query("mth_agent_priority", PRIORITY)
def mth_agent_priority(t):
    return priorities(t)


@query("top_agents", f"SELECT * FROM ({PRIORITY}) p WHERE n_frontier > 0 ORDER BY priority DESC, agent_id LIMIT 5")
def top_agents(t):
    return fr.top_agents(priorities(t), 5)


_TRANS = f"""SELECT ph.agent_id, ph.src, ph.dst, ph.mode, pow(ph.tau, 1.5) * pow(1 / (1 + exp(-(0.4 * sim + 0.3 * citations + 0.2 * recency + 0.1 * confidence))), 2) *
  CASE WHEN ph.mode = 'ref' THEN CASE caste WHEN 'fundaciones' THEN 0.75 WHEN 'impacto' THEN 0.25 ELSE 0.5 END ELSE CASE caste WHEN 'fundaciones' THEN 0.25 WHEN 'impacto' THEN 0.75 ELSE 0.5 END END AS weight
  FROM {{pheromone}} ph JOIN ({ETA}) e ON e.id = ph.dst JOIN {{agents}} a ON a.agent_id = ph.agent_id"""


def transitions(t):
    """Weights of every known trail: trail, eta and the caste's direction."""
    d = maths.caste_direction(c("caste"), F.lit(0.5), F.lit(0.5))
    rows = t.pheromone.join(eta_table(t).select(c("id").alias("dst"), "eta"), "dst").join(t.agents.select("agent_id", "caste"), "agent_id")
    w = maths.transition_weight(c("tau"), 1.5, c("eta"), 2.0, F.when(c("mode") == "ref", d["ref"]).otherwise(d["cites"]))
    return rows.select("agent_id", "src", "dst", "mode", w.alias("weight"))


@query("frontier_scores", f"SELECT agent_id, src, dst, mode, round(weight, 5) AS weight, round(weight / sum(weight) OVER (PARTITION BY agent_id), 7) AS probability FROM ({_TRANS}) x")
def frontier_scores(t):
    return fr.probabilities(transitions(t)).select("agent_id", "src", "dst", "mode", F.round("weight", 5).alias("weight"), F.round("probability", 7).alias("probability"))


_TABLE = f"""SELECT f.agent_id, f.src, f.id, f.mode, coalesce(tau, 1.0) AS tau, round(pow(coalesce(tau, 1.0), 1.5) * pow(coalesce(eta, 0), 2) * CASE WHEN f.mode = 'ref' THEN CASE caste WHEN 'fundaciones' THEN 0.75 WHEN 'impacto' THEN 0.25 ELSE 0.5 END ELSE CASE caste WHEN 'fundaciones' THEN 0.25 WHEN 'impacto' THEN 0.75 ELSE 0.5 END END, 5) AS weight
  FROM (SELECT agent_id, id, 'o:' || (p_partkey % 100) AS src, CASE WHEN p_partkey % 2 = 0 THEN 'ref' ELSE 'cites' END AS mode FROM {{agents}} CROSS JOIN {{papers}}) f LEFT JOIN (SELECT agent_id, src, dst AS id, mode, tau FROM {{pheromone}}) p USING (agent_id, src, id, mode) LEFT JOIN (SELECT id, 1 / (1 + exp(-(0.4 * sim + 0.3 * citations + 0.2 * recency + 0.1 * confidence))) AS eta FROM ({ETA}) s) e USING (id) JOIN {{agents}} a ON a.agent_id = f.agent_id"""


@query("join_transition_table", _TABLE)
def join_transition_table(t):
    """Every agent with every paper as a candidate, walked before or not."""
    k = c("p_partkey")
    names = [x.agent_id for x in t.agents.select("agent_id").collect()]  # a colony's agents
    frontier = t.papers.select(F.explode(F.array(*[F.lit(x) for x in names])).alias("agent_id"), "id", F.concat(F.lit("o:"), (k % 100).cast("string")).alias("src"), F.when(k % 2 == 0, "ref").otherwise("cites").alias("mode"))
    return fr.transition_table(frontier, t.pheromone, eta_table(t), t.agents).withColumn("weight", F.round("weight", 5))


@query("top_draw")
def top_draw(t):
    w = transitions(t).groupBy("agent_id", c("dst").alias("id")).agg(F.sum("weight").alias("weight"))
    return fr.draw(w, 7, 1, epsilon=0.1)


@query("itr_draw_distinct")
def itr_draw_distinct(t):
    w = transitions(t).groupBy("agent_id", c("dst").alias("id")).agg(F.sum("weight").alias("weight"))
    return fr.draw_distinct(w, 7, 1, priorities(t).select("agent_id", "priority"))


_DEPOSIT = "SELECT agent_id, src, dst, mode, 0.5 / greatest(1, count(*) OVER (PARTITION BY agent_id, l_orderkey)) AS deposit FROM {paths}"


@query("agg_update_pheromone", f"""SELECT coalesce(p.agent_id, d.agent_id) AS agent_id, coalesce(p.src, d.src) AS src, coalesce(p.dst, d.dst) AS dst, coalesce(p.mode, d.mode) AS mode,
  round(greatest(0.01, least(10.0, CASE WHEN p.tau IS NULL THEN 1.0 ELSE greatest(0.01, 0.9 * p.tau) END + coalesce(d.deposit, 0))), 6)::DOUBLE AS tau
  FROM {{pheromone}} p FULL JOIN (SELECT agent_id, src, dst, mode, sum(deposit) AS deposit FROM ({_DEPOSIT}) x GROUP BY ALL) d ON p.agent_id = d.agent_id AND p.src = d.src AND p.dst = d.dst AND p.mode = d.mode""")
def agg_update_pheromone(t):
    from lodestrata.plans.views import spark_sql

    return fr.update_pheromone(t.pheromone, spark_sql(t.spark, t.sf_dir, _DEPOSIT)).withColumn("tau", F.round("tau", 6))


@query("agg_concentration", "SELECT agent_id, round(max(tau) / avg(tau), 6) AS concentration FROM {pheromone} GROUP BY agent_id")
def agg_concentration(t):
    return fr.concentration(t.pheromone).withColumn("concentration", F.round("concentration", 6))


@query("agg_coverage", "SELECT a.agent_id, least(1.0, count(node) / 30)::DOUBLE AS coverage FROM {agents} a LEFT JOIN (SELECT * FROM {visits} WHERE agent_id <> 3) v ON v.agent_id = a.agent_id GROUP BY a.agent_id")
def agg_coverage(t):
    counts = t.visits.where("agent_id <> 3").groupBy("agent_id").agg(F.least(F.lit(1.0), F.count("*") / 30).alias("coverage"))
    return t.agents.select("agent_id").join(counts, "agent_id", "left").select("agent_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


_UNIT = "SELECT id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM {vectors}"
DIVERSITY = f"""SELECT agent_id, CASE WHEN n < 2 THEN 1.0 ELSE greatest(0, 1 - (square - n) / (n * (n - 1))) END AS diversity FROM (SELECT agent_id, n, sum(x * x) AS square FROM
  (SELECT agent_id, k, sum(x) AS x, count(*) AS n FROM (SELECT agent_id, unnest(u) AS x, unnest(range(len(u))) AS k FROM {{read_papers}} v JOIN ({_UNIT}) w ON w.id = v.id) y GROUP BY agent_id, k) z GROUP BY agent_id, n) q"""


@query("agg_diversity", f"SELECT agent_id, round(diversity, 5) AS diversity FROM ({DIVERSITY}) d")
def agg_diversity(t):
    return g.diversity(t.read_papers, t.vectors).withColumn("diversity", F.round("diversity", 5))


_MIXED = "(SELECT agent_id, node AS id FROM {visits_mixed} WHERE agent_id <> 3)"


@query("agg_structural", f"""SELECT a.agent_id, round(CASE WHEN c.coverage IS NULL THEN 0 ELSE c.coverage END, 5) AS coverage, round(CASE WHEN c.coverage IS NULL THEN 0 ELSE coalesce(d.diversity, 1) END, 5) AS diversity, round(CASE WHEN c.coverage IS NULL THEN 0 ELSE coalesce(e.depth, 0.5) END, 5) AS depth, round(CASE WHEN c.coverage IS NULL THEN 0 ELSE h.coherence END, 5) AS coherence
  FROM {{agents}} a LEFT JOIN (SELECT agent_id, least(1.0, count(*) / 30) AS coverage FROM {_MIXED} v GROUP BY agent_id) c ON c.agent_id = a.agent_id LEFT JOIN ({DIVERSITY.replace("{read_papers}", _MIXED)}) d ON d.agent_id = a.agent_id
  LEFT JOIN (SELECT agent_id, 1 / (1 + exp(-ln(1 + avg(citation_count)) / 5)) AS depth FROM {_MIXED} v JOIN {{papers}} p ON p.id = v.id GROUP BY agent_id) e ON e.agent_id = a.agent_id LEFT JOIN ({COHERENCE}) h ON h.agent_id = a.agent_id""")
def agg_structural(t):
    rows = g.structural(t.agents, t.visits_mixed.where("agent_id <> 3"), t.papers, t.vectors, t.edges)
    return rows.select("agent_id", *[F.round(x, 5).alias(x) for x in ("coverage", "diversity", "depth", "coherence")])


@query("agg_depth", "SELECT agent_id, round(1 / (1 + exp(-ln(1 + avg(citation_count)) / 5)), 6) AS depth FROM {read_papers} v JOIN {papers} p ON p.id = v.id GROUP BY agent_id")
def agg_depth(t):
    return t.read_papers.join(t.papers, "id").groupBy("agent_id").agg(F.round(maths.sigmoid(F.log1p(F.avg("citation_count")) / 5), 6).alias("depth"))


@query("agg_colony_graph", "SELECT mode, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(*) AS edges FROM (SELECT DISTINCT src, dst, mode FROM {pheromone}) x GROUP BY mode")
def agg_colony_graph(t):
    return t.pheromone.select("src", "dst", "mode").distinct().groupBy("mode").agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.count("*").alias("edges"))


@query("set_unvisited", "SELECT id FROM {papers} EXCEPT SELECT id FROM {read_papers} WHERE agent_id % 5 = 0")
def set_unvisited(t):
    return t.papers.select("id").join(t.read_papers.where("agent_id % 5 = 0").select("id").distinct(), "id", "left_anti")
