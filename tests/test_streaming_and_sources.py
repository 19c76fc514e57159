import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.machines import facts, fold
from lodestrata.operators.runs import project_runs
from lodestrata.plans.views import Inputs
from lodestrata.sources import papers
from lodestrata.streaming.runs import EVENT, NODES, OUTPUT, compact, ingest, newest, node_stream, project_stream, upsert_sink

SF = "/root/testdata/sf0.001"


def files(spark, path, shuffled=False):
    """run_events in order of seq as several Parquet files, some twice."""
    rows = Inputs(spark, SF).run_events.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "agent_id", F.col("value").cast("double").alias("value"), "payload").cache()
    parts = [rows.where(F.col("seq") <= 20), rows.where((F.col("seq") > 20) & (F.col("seq") <= 45)), rows.where(F.col("seq") > 45)]
    for k, p in enumerate([*parts, parts[1]] if not shuffled else [parts[1], parts[0], parts[2]]):
        p.coalesce(1).write.mode("append").parquet(path)
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = files(spark, f"{tmp_path}/in", shuffled)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = project_stream(stream).writeStream.foreachBatch(upsert_sink(f"{tmp_path}/out", ["run_id"], "last_seq")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    names = ["run_id", "last_seq", "seen", "status", "agent_id", "evaluations", "best_q"]
    got = sorted(tuple(r) for r in newest(spark, f"{tmp_path}/out", OUTPUT, ["run_id"], "last_seq").select(*names).collect())
    kept = rows.where("seq > 20") if shuffled else rows  # what comes late is dropped
    assert got == sorted(tuple(r) for r in project_runs(kept).select(*names).collect())


def streamed(spark, tmp_path, rows, trigger, **more):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    return project_stream(stream, **more).writeStream.foreachBatch(upsert_sink(f"{tmp_path}/out", ["run_id"], "seen")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(**trigger).start()


def test_windows_and_machines(spark, tmp_path):
    kinds = ["run_started", "oleada_start", "agent_turn_start", "agent_turn_complete", "oleada_complete", "phase_started", "exam_validated", "warning"] + ["candidate_score"] * 30
    rows = [(1, k + 1, None, t, "a", float(k), None) for k, t in enumerate(kinds)]
    streamed(spark, tmp_path, rows, {"availableNow": True}, most=20).awaitTermination(240)
    compact(spark, f"{tmp_path}/out", f"{tmp_path}/one", OUTPUT, ["run_id"], "seen")
    x = newest(spark, f"{tmp_path}/one", OUTPUT, ["run_id"], "seen").first()
    assert (x.seen, x.retained, x.dropped, x.scores, x.retained_scores) == (38, 20, 18, 30, 20)
    assert (x.status, x.wave, x.wave_status, x.phase_status, x.turns, x.exam_stage, x.warnings) == ("running", 1, "completed", "active", 1, "exam_validated", 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_of_a_shuffled_stream_equal_batch(spark, tmp_path, seed):
    """Every kind of event, in random order over four files, a part of them twice; runs that end well, badly, or more than once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = Inputs(spark, SF).log_events.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "agent_id", F.col("value").cast("double").alias("value"), "payload").where("run_id < 6").cache()
    parts = rows.randomSplit([1.0] * 4, seed)
    for p in (*parts, parts[1].union(parts[3])):
        p.orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    keys = ["run_id", "machine", "node"]
    node_stream(stream).writeStream.foreachBatch(upsert_sink(f"{tmp_path}/out", keys, "version")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    names = [*keys, "seq", "status"]
    got = sorted(tuple(r) for r in newest(spark, f"{tmp_path}/out", NODES, keys, "version").select(*names).collect())
    want = sorted(tuple(r) for r in fold(facts(rows)).select(*names).collect())
    assert got == want and {s for _, m, _, _, s in got if m == "run"} >= {"cancelled"} and any(m == "warning" for _, m, *_ in got)


def test_an_end_is_final(spark, tmp_path):
    kinds = ["run_started", "run_failed", "wave_started", "run_completed"]
    rows = [(1, k + 1, None, t, "a", None, None) for k, t in enumerate(kinds)] + [(2, 1, None, "run_started", "a", None, None), (2, 2, None, "run_cancelled", "a", None, None), (3, 1, None, "run_interrupted", "a", None, None), (4, 1, None, "run_completed", "a", None, '{"status": "failed"}')]
    batch = {r.run_id: r.status for r in project_runs(spark.createDataFrame(rows, EVENT)).collect()}
    assert batch == {1: "failed", 2: "cancelled", 3: "interrupted", 4: "completed"}
    assert {r.run_id: r.status for r in fold(facts(spark.createDataFrame(rows, EVENT))).where("machine = 'run'").collect()} == batch | {4: "failed"}
    streamed(spark, tmp_path, rows, {"availableNow": True}).awaitTermination(240)
    assert {r.run_id: r.status for r in newest(spark, f"{tmp_path}/out", OUTPUT, ["run_id"], "seen").collect()} == batch | {4: "failed"}


def test_silent_runs_are_interrupted_and_ended_ones_stay(spark, tmp_path):
    rows = [(1, 1, None, "run_started", "a", None, None), (2, 1, None, "run_started", "a", None, None), (2, 2, None, "run_completed", "a", None, None)]
    q = streamed(spark, tmp_path, rows, {"processingTime": "1 second"}, silence_ms=2000)
    try:
        for _ in range(60):
            time.sleep(1)
            got = {x.run_id: x for x in newest(spark, f"{tmp_path}/out", OUTPUT, ["run_id"], "seen").collect()} if (tmp_path / "out").exists() else {}
            if 1 in got and got[1].status == "interrupted":
                break
    finally:
        q.stop()
    assert (got[1].status, got[1].expired, got[1].best_q) == ("interrupted", True, None) and (got[2].status, got[2].expired) == ("completed", False)


def test_ingest_dedups_and_redacts(spark, tmp_path):
    files(spark, f"{tmp_path}/in")
    stream = ingest(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in").withColumn("payload", F.lit("token=abc")), "400 days")
    q = stream.writeStream.format("memory").queryName("ingested").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("ingested")
    assert got.count() == got.select("run_id", "seq").distinct().count() == Inputs(spark, SF).run_events.count()
    assert {r.payload for r in got.select("payload").distinct().collect()} == {"token=***"}


def test_openalex_and_s2(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/x", "title": "T", "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "A B"}}], "referenced_works": ["https://openalex.org/W2", "https://x/W3"]}
    (tmp_path / "o.json").write_text(json.dumps(work) + "\n")
    p, e = papers.read_openalex(spark, f"file://{tmp_path}/o.json")
    row = p.first()
    assert (row.id, row.doi, row.abstract, row.authors, row.citation_count) == ("openalex:W1", "10.1/x", "a b a", ["A B"], 0)
    assert [tuple(x) for x in e.collect()] == [("openalex:W1", "openalex:W2")]
    paper = {"paperId": "p", "externalIds": {"DOI": "10.2/y"}, "authors": [{"name": "N"}], "references": [{"paperId": "r"}, {"title": "none"}], "citations": [{"paperId": "c"}]}
    (tmp_path / "s.json").write_text(json.dumps(paper) + "\n")
    p, e = papers.read_s2(spark, f"file://{tmp_path}/s.json")
    assert p.first().doi == "10.2/y" and sorted(tuple(x) for x in e.collect()) == [("s2:c", "s2:p"), ("s2:p", "s2:r")]


def test_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text("""<S><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author><ForeName>F</ForeName><LastName>L</LastName></Author></AuthorList></Article></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus="received"><Year>1998</Year></PubMedPubDate><PubMedPubDate PubStatus="pubmed"><Year>1999</Year></PubMedPubDate></History><ArticleIdList><ArticleId IdType="doi">10.3/z</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>""")
    x = papers.read_pubmed_xml(spark, f"file://{tmp_path}/p.xml").first()
    assert (x.id, x.doi, x.year, x.authors, x.abstract) == ("pmid:7", "10.3/z", 1999, ["F L"], "a b")
    (tmp_path / "a.xml").write_text("""<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title> A
      b </title><summary>s</summary><published>2021-01-01T00:00:00Z</published><author><name>N</name></author><category term="cs.LG"/><category term="cs.AI"/><primary_category term="cs.AI"/></entry></feed>""")
    x = papers.read_arxiv_atom(spark, f"file://{tmp_path}/a.xml").first()
    assert (x.id, x.title, x.year, x.fields_of_study) == ("arxiv:2101.00001", "A b", 2021, ["cs.AI", "cs.LG"])


def test_bank_and_bibliography(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"question_id": "q2"}\n\n{"question_id": "q1"}\n')
    bank = papers.read_bank(spark, f"file://{tmp_path}/b.jsonl")
    papers.write_bank(bank, f"file://{tmp_path}/out")
    assert [x.question_id for x in spark.read.schema(bank.schema).json(f"file://{tmp_path}/out").collect()] == ["q1", "q2"]
    page = '<section class="ltx_bibliography"><ul><li class="ltx_bibitem">A <b>b</b></li><li class="ltx_bibitem"> </li><li class="x">no</li></ul></section>'
    df = spark.createDataFrame([(1, page), (2, "none")], "page_id long, html string")
    assert [tuple(x) for x in papers.html_bib_entries(df, 5).collect()] == [(1, 0, "A b")]
