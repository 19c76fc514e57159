"""Worked numbers of the functions, one row each."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.functions import maths, texts
from lodestrata.operators.bibliography import build_reference_graph
from lodestrata.operators.citations import canonicalize, coherence, diversity, structural
from lodestrata.operators.exams import assert_public, leakage, reject_near_duplicates, score_multiselect
from lodestrata.operators.frontier import draw, draw_distinct, update_pheromone
from lodestrata.operators.ranks import ranked
from lodestrata.operators.resolution import resolve_entries, scored, segment_bibliography, title_stage
from lodestrata.operators.runs import retained_window, rollup_status
from lodestrata.tables import drop, scratch, stored


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_strings(spark):
    x = one(
        spark,
        title=ids.normalize_title(F.lit("Hyphen-ated: punctuation?")),
        tokens=F.array_sort(ids.title_tokens(F.lit("The Origin of Extracellular Fields"))),
        surname=ids.surname(F.lit("  O'Connor, John  ")),
        doi=ids.normalize_doi(F.lit(" https://doi.org/doi:10.1000/ABC ")),
        arxiv=ids.normalize_arxiv(F.lit("arXiv:https://arxiv.org/abs/2301.00001v3")),
        old=ids.is_valid_arxiv(F.lit("cs/0112017")),
        doubled=ids.normalize_id(F.lit("openalex"), F.lit("OpenAlex:W1")),
        secret=texts.redact_secrets(F.lit('token = "abc"; x=1&api_key=zz')),
        kind=texts.content_kind(F.lit(" "), F.lit("a")),
    )
    assert x.title == "hyphen ated punctuation" and x.tokens == ["extracellular", "fields", "origin"] and x.surname == "oconnor"
    assert (x.doi, x.arxiv, x.old, x.doubled, x.kind) == ("10.1000/abc", "2301.00001", True, "openalex:W1", "abstract")
    assert x.secret == 'token = "***"; x=1&api_key=***'


def test_weights(spark):
    w = lambda tau, eta, d: maths.transition_weight(F.lit(tau), 2.0, F.lit(eta), 1.0, F.lit(d))
    x = one(spark, a=w(2.0, 0.5, 0.8), b=w(0.0, 0.5, 0.8), c=w(2.0, 0.0, 0.8), d=w(2.0, 0.5, 0.0))
    assert abs(x.a - 1.6) < 1e-12 and x.b > 0 and x.c == 0 and x.d == 0


def test_pheromone(spark):
    key = "agent_id int, src string, dst string, mode string, "
    old = spark.createDataFrame([(1, "a", "b", "ref", 10.0), (1, "a", "z", "ref", 100.0)], key + "tau double")
    new = spark.createDataFrame([(1, "p", "q", "ref", 0.25), (1, "q", "r", "ref", 0.25)], key + "deposit double")
    got = {(x.src, x.dst): x.tau for x in update_pheromone(old, new).collect()}
    assert got == {("a", "b"): 9.0, ("a", "z"): 10.0, ("p", "q"): 1.25, ("q", "r"): 1.25}


def test_graph(spark):
    visits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 2), (3, "z", 1)], "agent_id int, node string, ordinal int")
    edges = spark.createDataFrame([("b", "a"), ("c", "x")], "src string, dst string")
    assert {x.agent_id: x.coherence for x in coherence(visits, edges).collect()} == {1: 1.0, 2: 0.5, 3: 1.0}
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "alias string, canonical_id string")
    got = dict(tuple(x) for x in canonicalize(aliases).collect())
    assert got["a"] == got["b"] == "c" and got["x"] == got["y"] and "s" not in got


def test_coherence_shrinks_its_graph(spark, monkeypatch):
    from lodestrata.operators import citations

    names = []
    keep = citations.stored
    monkeypatch.setattr(citations, "stored", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(citations, "FEW", 4)
    r = random.Random(2)
    chain = [(1, f"c{k:03}", k) for k in range(60)]
    other = [(2, f"n{k:02}", k) for k in range(40)]
    links = [(f"c{k:03}", f"c{k + 1:03}") for k in range(59) if k != 44] + [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(26)] + [("n00", "n00"), ("c003", "n01")]
    reach = {"n00"}
    for _ in range(40):
        reach |= {y for a, b in links for x, y in ((a, b), (b, a)) if x in reach and y[0] == "n"}
    visits = spark.createDataFrame(chain + other, "agent_id int, node string, ordinal int")
    got = {x.agent_id: x.coherence for x in coherence(visits, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == {1: pytest.approx(45 / 60), 2: pytest.approx(len(reach) / 40)}
    assert "labels" not in names and names.count("inside") > 2  # edges are rewritten smaller, not all labels each round
    monkeypatch.setattr(citations, "FEW", 50_000)
    names.clear()
    assert {x.agent_id: x.coherence for x in coherence(visits, spark.createDataFrame(links, "src string, dst string")).collect()} == got
    assert names.count("inside") == 1


def test_diversity_takes_each_norm_once(spark):
    visits = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "agent_id int, id string")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [-8.0, 6.0])], "id string, embedding array<float>")
    rows = diversity(visits, vectors)
    assert {x.agent_id: x.diversity for x in rows.collect()} == {1: pytest.approx(1.0), 2: 1.0}
    assert "transform(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # a norm in its lambda was taken for each component


def test_exams(spark):
    letters = lambda s: F.array(*[F.lit(x) for x in s])
    q = spark.range(3).select(F.col("id").alias("item_id"), letters("ABCD").alias("options"), letters("AC").alias("key"))
    r = spark.range(3).select(F.col("id").alias("item_id"), F.when(F.col("id") == 0, letters("A")).when(F.col("id") == 1, letters("ABC")).otherwise(letters("CA")).alias("chosen"))
    got = {x.item_id: (x.exact, round(x.partial, 3)) for x in score_multiselect(q, r).collect()}
    assert got == {0: (False, 0.5), 1: (False, 0.667), 2: (True, 1.0)}
    options = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(t).alias("text")) for k, t in zip("ABCD", ("short", "much longer than all", "short", "short"), strict=True)])
    x = one(spark, long=leakage(F.lit("q"), options, F.lit("B")), fine=leakage(F.lit("q"), options, F.lit("A")), none=leakage(F.lit("q"), options, F.lit(None).cast("string")))
    assert (x.long, x.fine, x.none) == (True, False, True)
    words = " ".join(f"w{i}" for i in range(20))
    bank = spark.createDataFrame([(1, words), (2, words + " x"), (3, words + " x y"), (4, "other words")], "item_id int, question string")
    assert {x.item_id: x.accepted for x in reject_near_duplicates(bank).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_scores_and_sections(spark):
    df = spark.createDataFrame([(1, "a", "abc", "abc", 1.0, ["X Y"], ["Y"], 2000, 2001), (2, "b", "abc", "abd", 0.0, [], ["Y"], 2000, 2009)], "entry_id int, id string, a string, b string, jaccard double, authors array<string>, candidate_authors array<string>, year int, candidate_year int")
    got = {x.entry_id: x for x in scored(df).collect()}
    assert got[1].confidence == pytest.approx(1.0) and got[1].reasons == []
    assert got[2].author_score is None and got[2].confidence == pytest.approx(0.6 * (0.5 * 2 / 3) / 0.75) and got[2].reasons == ["title_mismatch", "year_mismatch"]
    text = "x\nReferences\nignored\n References \n\n[1] A first entry of some length\n[2] A second entry of some length\n[3] short"
    assert one(spark, e=segment_bibliography(F.lit(text))).e == ["A first entry of some length", "A second entry of some length"]
    assert one(spark, e=segment_bibliography(F.lit("no section"))).e == []


def test_bounded_window(spark):
    events = spark.range(1, 50_001).select((F.col("id") % 2).alias("run_id"), "id", F.col("id").alias("seq"))
    got = retained_window(events).groupBy("run_id").agg(F.count("*").alias("n"), F.first("seen").alias("seen"), F.first("dropped").alias("dropped")).collect()
    assert {(x.n, x.seen, x.dropped) for x in got} == {(1000, 25_000, 24_000)}


def test_roll_up(spark):
    rows = [(k, s) for k, x in enumerate((["failed", "completed"], ["failed", "pending"], ["skipped", "completed"], ["active", "failed"], ["pending"])) for s in x]
    got = {x.k: x.status for x in rollup_status(spark.createDataFrame(rows, "k int, status string"), ["k"]).collect()}
    assert got == {0: "completed", 1: "failed", 2: "completed", 3: "active", 4: "pending"}


def test_json_is_redacted_at_any_depth(spark):
    cases = {
        '{"a": {"token": {"x": 1}}, "b": [{"password": 5}, "key=abc"]}': '{"a":{"token":"***"},"b":[{"password":"***"},"key=***"]}',
        '{"z": 1, "a": null, "text": "no"}': '{"z":1,"a":null,"text":"no"}',
        "secret=abc; x": "secret=***; x",
        '["é", true]': '["é",true]',
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*cases, None])], "k int, p string").repartition(2)
    got = {x.k: x.r for x in df.select("k", texts.redact_json(F.col("p")).alias("r")).collect()}
    assert got == dict(enumerate([*cases.values(), None]))


def jaccard(a, b):
    words = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    bank = []
    for k in range(120):
        w = r.choice(bank)[1].split() if bank and r.random() < 0.6 else [f"w{r.randrange(60)}" for _ in range(r.randrange(8, 30))]
        if r.random() < 0.5:
            w[r.randrange(len(w))] = f"v{r.randrange(20)}"
        bank.append((k, " ".join(w)))
    accepted = []
    for k, q in bank:
        if not any(jaccard(q, p) >= 0.85 for _, p in accepted):
            accepted.append((k, q))
    got = {x.item_id for x in reject_near_duplicates(spark.createDataFrame(bank, "item_id int, question string")).where("accepted").collect()}
    assert got == {k for k, _ in accepted}


def test_title_stage_and_cascade_against_brute_force(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "cell", "graph", "field") for b in ("s", "ing", "er", "al")]
    title = lambda: " ".join(r.choice(words) for _ in range(r.randrange(4, 9)))
    catalog = [(f"p{k}", title(), r.choice(["Ann Lee", "Bo Kim"]), 2000 + k % 5, ("s2", "oa")[k % 2], k % 2) for k in range(60)]
    entries = []
    for k in range(80):
        c = r.choice(catalog)
        w = c[1].split()
        if r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice(words)
        entries.append((f"e{k}", " ".join(w) + r.choice(["", "!", "."]), r.choice([c[2], "Cy Doe"]), c[3] + r.choice([0, 1, 4])))
    schema = "id string, title string, author string, year int, provider string, provider_rank int"
    cat = spark.createDataFrame(catalog, schema).withColumns({"authors": F.array("author"), "doi": F.lit(None).cast("string"), "arxiv": F.lit(None).cast("string"), "pmid": F.lit(None).cast("string"), "completeness": F.lit(3), "key": F.col("id")})
    ent = spark.createDataFrame(entries, "entry_id string, title string, author string, year int").withColumns({"authors": F.array("author"), "doi": F.lit(None).cast("string"), "arxiv": F.lit(None).cast("string"), "pmid": F.lit(None).cast("string"), "keys": F.array().cast("array<string>")})
    normal = lambda x: re.sub(r"[^a-z0-9]+", " ", x.lower()).strip()

    def score(e, c):
        a, b = normal(e[1]), normal(c[1])
        t = 1.0 if a == b else 0.5 * difflib.SequenceMatcher(None, a, b).ratio() + 0.5 * jaccard(a, b)
        au, y = float(e[2].split()[-1] == c[2].split()[-1]), float(abs(e[3] - c[3]) <= 2)
        why = "title_mismatch" if t < 0.82 else "author_mismatch" if au < 0.34 else "year_mismatch" if y < 1 else None
        conf = 0.6 * t + 0.25 * au + 0.15 * y
        return t, conf, why or ("low_confidence" if conf < 0.75 else None), a == b or jaccard(a, b) >= 0.64

    want = {}
    for e in entries:
        for p in ("s2", "oa"):
            found = sorted(((-round(s[0], 6), -round(s[1], 6), c[0], s[2]) for c in catalog if c[4] == p and (s := score(e, c))[3]))[:5]
            for t, conf, i, why in found:
                want[e[0], i] = (round(-t, 6), round(-conf, 6), why)
    got = {(x.entry_id, x.id): (round(x.title_score, 6), round(x.confidence, 6), x.reason) for x in title_stage(ent, cat).collect()}
    assert got == want
    results, evidence, _ = resolve_entries(ent, cat, spark.createDataFrame([], "alias string, id string"))
    by = {x.entry_id: x for x in results.collect()}
    assert set(by) == {e[0] for e in entries}
    for e in entries:
        ranked = sorted((c[5], *want[e[0], c[0]], c[0]) for c in catalog if (e[0], c[0]) in want and want[e[0], c[0]][2] is None)
        first = [x for x in ranked if x[0] == ranked[0][0]] if ranked else []
        status = "rejected" if not first else "resolved" if len(first) == 1 else "ambiguous"
        assert by[e[0]].status == status, e
        if status == "resolved":
            assert by[e[0]].id == first[0][-1]


def test_copies_of_titles_make_no_pairs(spark, monkeypatch):
    from lodestrata.operators import resolution

    null = F.lit(None).cast("string")
    ent = spark.range(120).select(F.col("id").cast("string").alias("entry_id"), F.lit("Red stone!").alias("title"), F.array(F.lit("Ann Lee")).alias("authors"), F.lit(2000).alias("year"))
    cat = spark.range(90).select(F.format_string("p%02d", "id").alias("id"), F.lit("red STONE").alias("title"), F.array(F.lit("Ann Lee")).alias("authors"), F.lit(2000).alias("year"), F.lit("s2").alias("provider"), F.lit(1).alias("provider_rank"), F.lit(3).alias("completeness"), F.col("id").cast("string").alias("key"), null.alias("doi"))
    kinds = {x.kind: x["count"] for x in resolution.title_candidates(ent, cat).groupBy("kind").count().collect()}
    assert kinds == {"pair": 1, "entry": 120, "paper": 90}  # 10,800 pairs before
    sizes = []
    monkeypatch.setattr(resolution, "scored", lambda rows: sizes.append(rows.count()) or scored(rows))
    got = {}
    for x in title_stage(ent, cat, 3).collect():
        got.setdefault(x.entry_id, []).append((x["rank"], x.id, x.accepted))
    assert sizes == [1] and len(got) == 120
    assert all(sorted(v) == [(1, "p00", True), (2, "p01", True), (3, "p02", True)] for v in got.values())


def test_packed_context_orders_ties_and_keeps_the_line_before_the_cap(spark):
    from lodestrata.operators.segments import pack_context

    rows = [(1, 1, "b"), (1, 1, "a"), (1, None, "c"), (2, 1, "x" * 8), (2, 2, "y"), (3, 1, None)]
    got = {x.k: x.context for x in pack_context(spark.createDataFrame(rows, "k int, turn int, text string"), "k", "turn", "text", 10).collect()}
    assert got == {1: "c\n\na\n\nb", 2: "x" * 8 + "\n\n", 3: ""}


def test_papers_that_share_an_arxiv_id_match_its_sql(spark, tmp_path):
    import duckdb

    from lodestrata.plans import registry

    base = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    tail = ("alpha beta gamma delta", "alpha beta gama delta", "beta alpha gamma delta")
    rows = None
    for k, words in enumerate(tail):
        more = base.withColumns({"p_partkey": F.col("p_partkey") + 30_000 * k, "p_name": F.concat("p_name", F.lit(" " + words))})
        rows = more if rows is None else rows.unionByName(more)
    rows.write.parquet(str(tmp_path / "part.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [(x.entry_id, x.id, x.accepted, x.reason) for x in registry.queries()["join_arxiv_stage"](spark, str(tmp_path)).collect()]
    want = con.execute(f"select entry_id, id, accepted, reason from ({registry.oracle_sql()['join_arxiv_stage']}) x").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > len({x[0] for x in got})


def test_xml_files_hold_a_range_of_keys_each(spark, monkeypatch):
    from lodestrata.plans import sources

    monkeypatch.setattr(sources, "FILE_KEYS", 100)
    df = spark.range(0, 1000, 1, 1).select("id", F.lit("<entry></entry>").alias("x"))
    path = sources._xml(df, F.col("x"), "id", spark, "t")
    rows = spark.read.text(path)
    assert {x["count"] for x in rows.where("value like '%<entry>%'").groupBy("p").count().collect()} == {100}
    assert rows.where("value like '<set>%'").count() == rows.where("value like '%</set>'").count() == 10


def test_draws(spark):
    weights = spark.createDataFrame([(a, f"c{k}", 1.0 if k else 7.0) for a in range(400) for k in range(4)], "agent_id int, id string, weight double")
    share = lambda df: df.where("id = 'c0'").count() / 400
    assert 0.6 < share(draw(weights, 1, 1)) < 0.8 and 0.15 < share(draw(weights, 1, 1, epsilon=1.0)) < 0.35
    assert draw(weights, 1, 1, epsilon=0.25).where("explored").count() in range(60, 140)
    few = weights.where("agent_id < 3")
    priority = spark.createDataFrame([(a, float(a)) for a in range(400)], "agent_id int, priority double")
    got = [tuple(x) for x in draw_distinct(few, 2, 1, priority).collect()]
    assert len({a for a, _ in got}) == len({c for _, c in got}) == len(got) == 3
    assert len(draw_distinct(weights, 2, 1, priority).collect()) == 4  # as many as there are candidates


def test_private_columns_and_limits(spark):
    with pytest.raises(ValueError, match="answer_key"):
        assert_public(spark.range(1).select(F.array(F.struct(F.lit(1).alias("answer_key"))).alias("x")))
    with pytest.raises(ValueError, match="rationale"):
        assert_public(spark.createDataFrame([('{"rationale": "because"}',)], "payload string"), "payload")
    assert assert_public(spark.createDataFrame([('{"a": 1}',)], "payload string"), "payload").count() == 1
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("z", "b")] + [(f"n{k}", f"n{k + 1}") for k in range(40)]
    got = dict(tuple(x) for x in canonicalize(spark.createDataFrame(ring, "alias string, canonical_id string")).collect())
    assert {got[x] for x in "abcz"} == {"a"} and {got[f"n{k}"] for k in range(40)} == {"n40"}
    r = ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"]).collect()
    assert all(x.rank == x.v + 1 for x in r)


def test_wave_without_visits_has_zeros(spark):
    agents = spark.createDataFrame([(1,), (2,)], "agent_id int")
    visits = spark.createDataFrame([(1, "p", 1)], "agent_id int, node string, ordinal int")
    papers = spark.createDataFrame([("p", 0)], "id string, citation_count int")
    vectors = spark.createDataFrame([("p", [1.0, 0.0])], "id string, embedding array<double>")
    edges = spark.createDataFrame([], "src string, dst string")
    got = {x.agent_id: tuple(x)[1:] for x in structural(agents, visits, papers, vectors, edges).collect()}
    assert got[2] == (0.0,) * 5 and got[1] == pytest.approx((1 / 30, 1.0, 0.5, 1.0, (1 / 30 + 2.5) / 4))


def test_reference_graph(spark):
    text = "Body\nReferences\n\n[1] Smith, A. On the red stone. 2001. doi:10.1000/1.\n[2] Jones, B. Nothing that anyone has listed.\n[3] Brown, C. A survey. arXiv:2101.00001v2. And more"
    papers = spark.createDataFrame([(7, text), (8, "no section")], "paper_id long, text string")
    none = (None,) * 3
    mapped = [("7:1", "On the red stone", ["Smith, A."], 2001, "10.1000/1", None, None, 0.9), ("7:2", "Nothing that anyone has listed", ["Jones, B."], None, "10.5/invented", None, None, 0.9), ("7:3", "A survey", *none[:1], None, None, "2101.00001", None, 0.2)]
    mapped = spark.createDataFrame(mapped, "entry_id string, title string, authors array<string>, year int, doi string, arxiv_id string, pmid string, confidence double")
    catalog = spark.createDataFrame([("s2:1", "On the Red Stone", ["Ann Smith"], 2001, "10.1000/1", None, None, "s2", 1, 4, "k1")], "id string, title string, authors array<string>, year int, doi string, arxiv string, pmid string, provider string, provider_rank int, completeness int, key string")
    out = build_reference_graph(papers, mapped, catalog, spark.createDataFrame([], "alias string, id string"))
    assert {(x.dst, x.method) for x in out["edges"].where("not provisional").collect()} == {("s2:1", "doi")}
    assert {x.entry_id: x.reason for x in out["provisional"].collect()} == {"7:2": "no_provider_match", "7:3": "low_parse_confidence"}
    assert {x.paper_id: tuple(x)[1:] for x in out["accounts"].collect()} == {7: (3, 3, 1, 2, False), 8: (0, 0, 0, 0, True)}
    assert out["edges"].where("provisional").count() == 2 and {(x.entry_id, x.method) for x in out["attempts"].collect()} >= {("7:2", "title")}


def test_tables_are_deleted(spark):
    with scratch(spark) as kept:
        a, b = stored(spark.range(3), "a"), stored(spark.range(4), "b")
        kept.append(b)
    assert b.count() == 4
    with pytest.raises(Exception, match="not exist|does not|FILE_NOT"):
        a.count()
    drop(b)
    with pytest.raises(Exception, match="not exist|does not|FILE_NOT"):
        b.count()


def test_first_of_tied_candidates_is_the_least(spark, tmp_path):
    import duckdb

    from lodestrata.plans import registry

    rows = [(1, 5, 1, 9), (1, 5, 1, 3), (1, 5, 1, 7), (2, None, 1, 4), (2, None, 1, 2), (3, 8, 2, 6), (3, 8, 1, None), (3, 8, 1, 1)]
    for order in (rows, rows[::-1]):
        path = str(tmp_path / f"{order is rows}")
        spark.createDataFrame(order, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{path}/lineitem.parquet/*.parquet'")
        got = {tuple(x) for x in registry.queries()["win_dedupe_candidates"](spark, path).collect()}
        assert got == {(1, 3), (2, 2), (3, None)} == set(con.execute(registry.oracle_sql()["win_dedupe_candidates"]).fetchall())


def test_surnames_of_odd_texts_match_their_sql(spark, tmp_path):
    import duckdb

    from lodestrata.plans import registry

    words = ["Such is", "such, x", "", None, "a\tb c", "\ta b", " ,, ", "--- b", "such\tx y", "a\x0bb", "  a b", "León, J. x", "no such"]
    texts_ = [(2 * k + odd, w) for k, w in enumerate(words) for odd in (0, 1)]
    spark.createDataFrame(texts_, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {x.doc_id: (x.surname, x.overlap) for x in registry.queries()["str_surnames"](spark, str(tmp_path)).collect()}
    assert got == {i: (s, float(o)) for i, s, o in con.execute(registry.oracle_sql()["str_surnames"]).fetchall()}
    assert [got[i] for i in (0, 1, 4, 6, 9, 12)] == [("such", 1.0), ("such", 1.0), ("", 0.0), (None, 0.0), ("b", 1.0), ("", 0.0)]


def test_title_classes_hold_every_pair_of_entries_and_papers(spark, tmp_path):
    """Pairs of classes with their members are all pairs that the whole join gives, also of titles without a word."""
    import duckdb

    from lodestrata.plans import evidence, registry, views

    names = ["!!!", "?", "The", "of the", "red stone", "Red  stone!", "red stone hill", "old red stone hill", "red stone hill top", "ring"]
    rows = [(k, names[k % 10] if k < 70 else names[k % 3], "b", "t", 5) for k in range(1, 90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["join_title_candidates"](spark, str(tmp_path)).collect()
    members = {}
    for x in got:
        members.setdefault((x.kind, x["class"]), []).append(x.item)
    pairs = sorted((e, p, x.jaccard) for x in got if x.kind == "pair" for e in members["entry", x.item] for p in members["paper", x["class"]])
    e, k = (f"SELECT {key}, {evidence._TITLE.format('title')} AS {a}, {evidence._TOKENS.format('title')} AS {x} FROM {table} WHERE title IS NOT NULL" for key, a, x, table in (("entry_id", "a", "x", f"({evidence._E}) q"), ("id", "b", "y", "{papers}")))
    whole = f"SELECT entry_id, id, round(jaccard, 6) FROM (SELECT entry_id, id, a, b, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS jaccard FROM ({e}) e, ({k}) k) z WHERE a = b OR jaccard >= 2 * 0.82 - 1"
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert pairs == sorted(con.execute(views.duck_sql(whole)).fetchall()) and len(pairs) > 500
