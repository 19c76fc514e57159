"""Queries of examinations and benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import exams as ex
from lodestrata.plans.registry import query

c = F.col
ITEMS = """SELECT item_id, CASE WHEN item_id % 17 = 0 THEN 'All of the above: ' || question ELSE question END AS question, category, CASE WHEN item_id % 13 = 0 THEN 'odd' ELSE difficulty END AS difficulty, CASE WHEN item_id % 11 = 0 THEN NULL ELSE correct_option_id END AS k, item_id % 9 = 0 AS rejected, item_id % 7 = 0 AS lost FROM {exam_items}"""


def _items(t):
    k = c("item_id")
    texts = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(f"an option {x}").alias("text")) for x in "ABCD"])
    return t.exam_items.select("item_id", F.when(k % 17 == 0, F.concat(F.lit("All of the above: "), "question")).otherwise(c("question")).alias("question"), texts.alias("options"), F.when(k % 11 != 0, c("correct_option_id")).alias("correct_option_id"), F.array(F.when(k % 7 == 0, "no").otherwise("yes")).alias("evidence"), "category", F.when(k % 13 == 0, "odd").otherwise(c("difficulty")).alias("difficulty"), F.when(k % 9 == 0, "rejected").otherwise("accepted").alias("critic"))


@query("flt_validate_items", f"SELECT item_id, concat_ws(',', CASE WHEN k IS NULL THEN 'missing_key' END, CASE WHEN lost THEN 'unresolved_evidence' END, CASE WHEN difficulty = 'odd' THEN 'invalid_difficulty' END, CASE WHEN k IS NULL OR question LIKE 'All of the above%' THEN 'answer_leakage' END, CASE WHEN rejected THEN 'critic_rejected' END) AS reasons FROM ({ITEMS}) i")
def flt_validate_items(t):
    pack = t.spark.createDataFrame([("yes",)], "source_id string")
    return ex.validate_items(_items(t), pack)


@query("flt_validate_answers", "SELECT responder, item_id, CASE WHEN item_id % 8 = 3 THEN 'E' ELSE option_id END AS option_id, CASE WHEN item_id % 8 = 3 THEN 'invalid_option' END AS reason FROM {answers} WHERE item_id >= 5 UNION ALL SELECT responder, item_id, CASE WHEN item_id % 8 = 3 THEN 'E' ELSE option_id END, 'unknown_question' FROM {answers} WHERE item_id < 5 UNION ALL SELECT 'naive', item_id, NULL, 'missing' FROM {exam_items} WHERE item_id >= 5 AND item_id % 9 = 0")
def flt_validate_answers(t):
    answers = t.answers.withColumn("option_id", F.when(c("item_id") % 8 == 3, "E").otherwise(c("option_id")))
    return ex.validate_answers(answers, t.exam_items.where("item_id >= 5"))


_GRADED = "SELECT r.responder, i.item_id, i.category, i.difficulty, coalesce(a.option_id = i.correct_option_id, false) AS correct FROM (SELECT DISTINCT responder FROM {answers}) r CROSS JOIN {exam_items} i LEFT JOIN {answers} a ON a.responder = r.responder AND a.item_id = i.item_id"


@query("agg_score_exam", f"SELECT responder, CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS dimension, coalesce(category, difficulty, 'all') AS bucket, count(*) FILTER (correct) AS correct, count(*) AS total FROM ({_GRADED}) g GROUP BY GROUPING SETS ((responder), (responder, category), (responder, difficulty))")
def agg_score_exam(t):
    return ex.score_exam(t.answers, t.exam_items)


def _pairs(t):
    rows = ex.graded(t.answers, t.exam_items)
    return ex.paired(rows.where("responder = 'survivor'"), rows.where("responder = 'naive'"))


_PAIRS = f"SELECT item_id, bool_or(correct AND responder = 'survivor') AS first, bool_or(correct AND responder = 'naive') AS second FROM ({_GRADED}) g GROUP BY item_id"


@query("join_paired_outcomes", _PAIRS)
def join_paired_outcomes(t):
    return _pairs(t)


@query("agg_paired_ci", f"SELECT n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM (SELECT count(*) AS n, avg(first::INT - second::INT) AS mean, 1.96 * stddev_samp(first::INT - second::INT) / sqrt(count(*)) AS half FROM ({_PAIRS}) p) x")
def agg_paired_ci(t):
    return ex.paired_ci(_pairs(t)).select("n", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")])


@query("agg_paired_summary", f"SELECT count(*) FILTER (first AND second) AS both, count(*) FILTER (first AND NOT second) AS first_only, count(*) FILTER (NOT first AND second) AS second_only, count(*) FILTER (NOT first AND NOT second) AS neither FROM ({_PAIRS}) p")
def agg_paired_summary(t):
    return ex.paired_summary(_pairs(t))


@query("top_partition_bank", "SELECT item_id, CASE WHEN k <= 20 THEN 'selection' ELSE 'holdout' END AS part FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('7:' || item_id), item_id) AS k FROM {exam_items}) x WHERE k <= 30")
def top_partition_bank(t):
    return ex.partition_bank(t.exam_items, 20, 10, 7)


_HELD = "SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('{s}:' || item_id), item_id) AS k FROM {{exam_items}}) x WHERE k {w}"


@query("set_disjoint", f"SELECT (SELECT count(*) FROM ({_HELD.format(s=7, w='<= 20')}) a WHERE item_id IN ({_HELD.format(s=7, w='BETWEEN 21 AND 30')})) AS common, (SELECT count(*) FROM ({_HELD.format(s=7, w='<= 20')}) a WHERE item_id IN ({_HELD.format(s=8, w='BETWEEN 21 AND 30')})) AS across")
def set_disjoint(t):
    """How many items a split's halves share, and how many one's selection shares with another's holdout."""
    one, two = ex.partition_bank(t.exam_items, 20, 10, 7), ex.partition_bank(t.exam_items, 20, 10, 8)
    a = one.where("part = 'selection'").select("item_id")
    both = [a.join(x.where("part = 'holdout'").select("item_id"), "item_id").select(F.lit(n).alias("n")) for n, x in (("common", one), ("across", two))]
    return both[0].unionByName(both[1]).agg(*[F.count_if(c("n") == n).alias(n) for n in ("common", "across")])


@query("itr_near_duplicates")
def itr_near_duplicates(t):
    bank = t.exam_items.select("item_id", "question").unionByName(t.exam_items.where("item_id % 3 = 0").select((c("item_id") + 1000).alias("item_id"), F.concat("question", F.lit(" more")).alias("question")))
    return ex.reject_near_duplicates(bank)


_SETS = "SELECT item_id, category, difficulty, list_filter(['A', 'B', 'C', 'D'], lambda x: contains(upper(substring(question, 1, 12)), x) OR x = correct_option_id) AS key, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: contains(upper(substring(question, 4, 16)), x)) AS chosen FROM {exam_items}"
_MARKS = f"SELECT item_id, category, difficulty, list_sort(key) = list_sort(chosen) AND NOT list_contains(chosen, 'E') AS exact, len(list_intersect(key, chosen)) / len(list_distinct(list_concat(key, chosen))) AS partial FROM ({_SETS}) s"


def _multiselect(t):
    """Keys and answers that depend on the letters of the question."""
    held = lambda at, n, letters: F.filter(F.array(*[F.lit(x) for x in letters]), lambda x: F.contains(F.upper(F.substring("question", at, n)), x) | (F.lit(at == 1) & (x == c("correct_option_id"))))
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    questions = t.exam_items.select("item_id", "category", "difficulty", F.lit("p").alias("paper_id"), letters.alias("options"), held(1, 12, "ABCD").alias("key"))
    return questions, t.exam_items.select("item_id", held(4, 16, "ABCDE").alias("chosen"))


@query("agg_score_multiselect", f"SELECT item_id, exact, round(partial, 6)::DOUBLE AS partial FROM ({_MARKS}) m")
def agg_score_multiselect(t):
    return ex.score_multiselect(*_multiselect(t)).withColumn("partial", F.round("partial", 6))


@query("job_fixed_benchmark", f"SELECT d.dimension, d.bucket, count(*) AS questions, round(avg(exact::INT), 6) AS exact, round(avg(partial), 6) AS partial FROM (SELECT exact, partial, unnest([struct_pack(dimension := 'all', bucket := 'all'), struct_pack(dimension := 'category', bucket := category), struct_pack(dimension := 'difficulty', bucket := difficulty), struct_pack(dimension := 'paper_id', bucket := 'p')]) AS d FROM ({_MARKS}) m) x GROUP BY ALL")
def job_fixed_benchmark(t):
    return ex.benchmark_scores(*_multiselect(t)).withColumns({"exact": F.round("exact", 6), "partial": F.round("partial", 6)})


QUOTAS = [("easy", 14), ("medium", 13), ("expert", 2)]


@query("agg_distribution_issues", "SELECT coalesce(f.label, q.label) AS label, coalesce(found, 0) AS found, coalesce(wanted, 0)::BIGINT AS wanted FROM (SELECT difficulty AS label, count(*) AS found FROM {exam_items} GROUP BY 1) f FULL JOIN (VALUES ('easy', 14), ('medium', 13), ('expert', 2)) q(label, wanted) ON q.label = f.label WHERE coalesce(found, 0) <> coalesce(wanted, 0)")
def agg_distribution_issues(t):
    return ex.distribution_issues(t.exam_items, t.spark.createDataFrame(QUOTAS, "label string, wanted int"), "difficulty")


@query("top_select_survivor", "SELECT agent_id, terminal, row_number() OVER (ORDER BY terminal DESC, selection DESC, grounding DESC, process DESC, agent_id) AS rank FROM (SELECT *, round(0.7 * selection + 0.2 * process + 0.1 * grounding, 6)::DOUBLE AS terminal FROM (SELECT c_nationkey AS agent_id, round(avg(c_acctbal) / 10000, 4)::DOUBLE AS selection, (c_nationkey % 3) / 2 AS process, (c_nationkey % 5) / 4 AS grounding FROM {customer} GROUP BY c_nationkey) a) b")
def top_select_survivor(t):
    rows = t.customer.groupBy(c("c_nationkey").alias("agent_id")).agg(F.round(F.avg("c_acctbal") / 10000, 4).cast("double").alias("selection")).withColumns({"process": (c("agent_id") % 3) / 2, "grounding": (c("agent_id") % 5) / 4})
    return ex.select_survivor(rows)


@query("top_blueprint", "SELECT paper_id, paper_id || '-q' || lpad((row_number() OVER (PARTITION BY paper_id ORDER BY sha256('3:' || paper_id || ':' || label || ':' || k)))::VARCHAR, 3, '0') AS question_id, label FROM (SELECT p_partkey AS paper_id FROM {part}) p CROSS JOIN (SELECT label, unnest(range(1, wanted + 1)) AS k FROM (VALUES ('easy', 14), ('medium', 13), ('expert', 2)) q(label, wanted)) l")
def top_blueprint(t):
    return ex.blueprint(t.part.select(c("p_partkey").alias("paper_id")), t.spark.createDataFrame(QUOTAS, "label string, wanted int"), 3)


@query("flt_critic_gate", f"SELECT item_id, coalesce(length(question) % 4 <> 0 AND length(question) % 5 <> 0 AND list_sort(list_filter(chosen, lambda x: x <> 'E')) = list_sort(key), false) AS kept FROM ({_SETS}) s JOIN (SELECT item_id, question FROM {{exam_items}}) q USING (item_id)")
def flt_critic_gate(t):
    questions, responses = _multiselect(t)
    n = F.char_length("question")
    verdicts = t.exam_items.join(responses, "item_id").select("item_id", (n % 4 != 0).alias("accepted"), (n % 5 != 0).alias("evidence_ok"), F.array_remove("chosen", "E").alias("defensible"))
    return ex.critic_gate(questions, verdicts)


_BANK = "SELECT p_partkey::VARCHAR AS question_id, 'paper' || (p_partkey % 40) AS paper_id, CASE p_size % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, p_type AS category, p_partkey % 31 = 0 AS odd, p_partkey % 37 = 0 AS keyless, p_partkey % 41 = 0 AS bare, p_partkey % 43 = 0 AS unseen FROM {part}"
_OWN = f"SELECT * FROM ({_BANK}) b WHERE paper_id <> 'paper7'"
_KNOWN = "SELECT 'paper' || r AS paper_id FROM range(0, 41) q(r) WHERE r <> 7"
_WANTED = "(VALUES ('easy', 17), ('medium', 16), ('hard', 17)) w(label, wanted)"


@query("agg_validate_suite", f"""SELECT code, count(*) AS n, count(DISTINCT question_id) AS questions, count(DISTINCT detail) AS papers FROM (
  SELECT 'unknown_paper' AS code, question_id, paper_id AS detail FROM ({_BANK}) b WHERE paper_id = 'paper7' UNION ALL SELECT 'invalid_options', question_id, NULL FROM ({_OWN}) o WHERE odd
  UNION ALL SELECT 'invalid_answer_key', question_id, NULL FROM ({_OWN}) o WHERE keyless UNION ALL SELECT 'missing_evidence', question_id, NULL FROM ({_OWN}) o WHERE bare UNION ALL SELECT 'missing_critic_validation', question_id, NULL FROM ({_OWN}) o WHERE unseen
  UNION ALL SELECT 'invalid_paper_question_count', NULL, k.paper_id FROM ({_KNOWN}) k LEFT JOIN ({_OWN}) o USING (paper_id) GROUP BY k.paper_id HAVING count(question_id) <> 50
  UNION ALL SELECT DISTINCT 'invalid_difficulty_distribution', NULL, paper_id FROM (SELECT k.paper_id, label, wanted FROM ({_KNOWN}) k, {_WANTED}) w LEFT JOIN (SELECT paper_id, difficulty AS label, count(*) AS found FROM ({_OWN}) o GROUP BY ALL) f USING (paper_id, label) WHERE found IS DISTINCT FROM wanted
  UNION ALL SELECT DISTINCT 'invalid_category_distribution', NULL, paper_id FROM ({_OWN}) o UNION ALL SELECT 'invalid_category_distribution', NULL, 'paper40'
  UNION ALL SELECT DISTINCT 'invalid_correct_option_count_distribution', NULL, paper_id FROM ({_OWN}) o UNION ALL SELECT 'invalid_correct_option_count_distribution', NULL, 'paper40') x GROUP BY code""")
def agg_validate_suite(t):
    k = c("p_partkey")
    letters = lambda x: F.array(*[F.lit(y) for y in x])
    none = F.array().cast("array<string>")
    paper = F.concat(F.lit("paper"), (k % 40).cast("string"))
    questions = t.part.select(k.cast("string").alias("question_id"), paper.alias("paper_id"), F.when(c("p_size") % 3 == 0, "easy").when(c("p_size") % 3 == 1, "medium").otherwise("hard").alias("difficulty"), c("p_type").alias("category"), F.when(k % 31 == 0, letters("ABDC")).otherwise(letters("ABCD")).alias("options"), F.when(k % 37 == 0, none).otherwise(letters("A")).alias("correct"), F.when(k % 41 == 0, none).otherwise(F.array(F.lit("paper0"))).alias("evidence"), F.when(k % 43 != 0, "critic").alias("critic"))
    papers = t.spark.range(41).where("id <> 7").select(F.concat(F.lit("paper"), c("id").cast("string")).alias("paper_id"))
    quotas = {"category": {"none": 1}, "difficulty": {"easy": 17, "medium": 16, "hard": 17}, "correct_option_count": {"9": 1}}
    issues = ex.validate_suite(questions, papers, quotas, per_paper=50)
    return issues.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions"), F.count_distinct("detail").alias("papers"))


_COST = "SELECT responder, CASE WHEN k <= 20 THEN 'selection' ELSE 'holdout' END AS part, count(*) AS answers, sum(item_id * 3) AS tokens, sum(item_id % 7) AS seconds FROM {answers} a JOIN (SELECT item_id, row_number() OVER (ORDER BY sha256('7:' || item_id), item_id) AS k FROM {exam_items}) p USING (item_id) WHERE k <= 30 GROUP BY ALL"


@query("agg_answer_cost", _COST)
def agg_answer_cost(t):
    rows = t.answers.join(ex.partition_bank(t.exam_items, 20, 10, 7), "item_id").withColumns({"tokens": c("item_id") * 3, "seconds": c("item_id") % 7})
    return ex.answer_cost(rows)


@query("flt_naive_sources", "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'direct_reference' ELSE 'deeper' END AS distance, CASE WHEN n_chars > 500 THEN 'included' ELSE 'no_evidence' END AS status FROM {documents}) x WHERE status = 'included' AND distance = 'direct_reference'")
def flt_naive_sources(t):
    pack = t.documents.select("doc_id", F.when(c("doc_id") % 3 == 0, "direct_reference").otherwise("deeper").alias("distance"), F.when(c("n_chars") > 500, "included").otherwise("no_evidence").alias("status"))
    return ex.naive_sources(pack).select("doc_id")


_SPLIT = "SELECT item_id, correct_option_id, CASE WHEN k <= 20 THEN 'selection' ELSE 'holdout' END AS part FROM (SELECT item_id, correct_option_id, row_number() OVER (ORDER BY sha256('7:' || item_id), item_id) AS k FROM {exam_items} WHERE item_id % 13 <> 0) x WHERE k <= 30"
_ARMS = "SELECT n_name AS responder, item_id, chr(CAST(65 + (item_id * (n_nationkey % 5 + 1)) % 4 AS INT)) AS option_id FROM {benchmark}, {nation} WHERE n_nationkey < 6 UNION ALL SELECT responder, item_id, option_id FROM {answers} WHERE responder = 'naive'"
_MARKED = f"SELECT r.responder, i.item_id, part, coalesce(a.option_id = correct_option_id, false) AS correct FROM (SELECT DISTINCT responder FROM ({_ARMS}) a) r CROSS JOIN ({_SPLIT}) i LEFT JOIN ({_ARMS}) a ON a.responder = r.responder AND a.item_id = i.item_id"


@query("job_exam_benchmark", f"""SELECT * FROM (WITH m AS ({_MARKED}), s AS (SELECT responder, avg(correct::INT) AS selection, (min(n_nationkey) % 3) / 2 AS process, (min(n_nationkey) % 5) / 4 AS grounding FROM m JOIN {{nation}} ON n_name = responder WHERE part = 'selection' GROUP BY responder),
  b AS (SELECT responder AS survivor, round(0.7 * selection + 0.2 * process + 0.1 * grounding, 6)::DOUBLE AS terminal FROM s ORDER BY terminal DESC, selection DESC, grounding DESC, process DESC, survivor LIMIT 1),
  p AS (SELECT item_id, bool_or(correct AND responder = survivor) AS first, bool_or(correct AND responder = 'naive') AS second FROM m, b WHERE part = 'holdout' GROUP BY item_id),
  z AS (SELECT count(*) AS n, avg(first::INT - second::INT) AS mean, 1.96 * stddev_samp(first::INT - second::INT) / sqrt(count(*)) AS half FROM p)
  SELECT (SELECT count(*) FROM ({_SPLIT}) i WHERE part = 'selection') AS selected, n AS held, survivor, terminal, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, CASE WHEN mean - half > 0 THEN 'uplift' WHEN mean + half < 0 THEN 'regression' ELSE 'inconclusive' END AS outcome FROM z, b) x""")
def job_exam_benchmark(t):
    k = c("n_nationkey")
    few = t.nation.where(k < 6)
    arms = [(x.n_name, x.n_nationkey) for x in few.select("n_name", "n_nationkey").collect()]  # a colony's agents
    option = F.transform(F.array(*[F.struct(F.lit(n).alias("responder"), F.lit(i).alias("i")) for n, i in arms]), lambda a: F.struct(a["responder"].alias("responder"), F.char((65 + (c("item_id") * (a["i"] % 5 + 1)) % 4).cast("int")).alias("option_id")))
    answers = t.benchmark.select("item_id", F.inline(option)).select("responder", "item_id", "option_id").unionByName(t.answers.where("responder = 'naive'").select("responder", "item_id", "option_id"))
    items = t.exam_items.withColumn("sound", c("item_id") % 13 != 0)
    candidates = few.select(c("n_name").alias("agent_id"), ((k % 3) / 2).alias("process"), ((k % 5) / 4).alias("grounding"))
    row = ex.exam_outcome(items, answers, candidates, selection=20, holdout=10, seed=7)
    return row.select("selected", "held", "survivor", "terminal", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")], "outcome")


@query("snk_answer_key", "SELECT item_id, correct_option_id FROM {exam_items}")
def snk_answer_key(t):
    return t.exam_items.select("item_id", "correct_option_id")


@query("snk_public_exam", "SELECT item_id, question, category, difficulty FROM {exam_items}")
def snk_public_exam(t):
    return ex.assert_public(t.exam_items.drop("correct_option_id"))
