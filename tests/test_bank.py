import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import bank, exams


def test_a_short_bank_is_an_error(spark):
    items = spark.range(9).select(F.col("id").alias("item_id"))
    with pytest.raises(ValueError, match="10 items are wanted and the bank has 9"):
        bank.split_bank(items, 6, 4, 1)
    assert {x.part: x.n for x in bank.split_bank(items, 6, 3, 1).groupBy("part").agg(F.count("*").alias("n")).collect()} == {"selection": 6, "holdout": 3}


def test_too_many_labels_are_an_error(spark):
    quotas = spark.range(5).select(F.col("id").cast("string").alias("label"), F.lit(1).alias("wanted"))
    papers = spark.createDataFrame([("p",)], "paper_id string")
    with pytest.raises(ValueError, match="more than 4 labels"):
        exams.blueprint(papers, quotas, 1, most=4)
    assert exams.blueprint(papers, quotas, 1, most=5).count() == 5


def test_each_reason_of_eligibility(spark):
    rows = [(1, 0.9, 0.5, 0.5, True, True, 3, 0.9), (2, 0.9, 0.5, 0.6, True, True, 3, 0.5), (3, 1.0, 1.0, 1.0, False, False, 3, 1.0), (4, 1.0, 1.0, 1.0, True, False, 3, 1.0), (5, None, 0.1, 1.0, True, True, 3, 1.0), (6, 1.0, 0.1, 1.0, True, True, 0, 1.0), (7, 1.0, 0.1, 1.0, True, True, 3, 0.4)]
    df = spark.createDataFrame(rows, "agent_id long, selection double, process double, grounding double, has_dossier boolean, provenance boolean, answered int, coverage double")
    got = {x.agent_id: x for x in bank.select_survivor(df).collect()}
    assert [got[k].reason for k in range(1, 8)] == [None, None, bank.NO_DOSSIER, bank.NO_PROVENANCE, bank.NO_RESPONSE, bank.NO_RESPONSE, bank.LOW_COVERAGE]
    assert (got[2].rank, got[2].survivor, got[1].rank, got[3].rank, got[3].process_peak, got[4].process_peak) == (1, True, 2, None, True, False)
    assert not any(x.survivor for x in bank.select_survivor(df.where("agent_id > 2")).collect())


def test_the_first_source_found_gives_the_kind(spark):
    items = spark.createDataFrame([(1, "seed", ["x", "b", "a"]), (2, "seed", ["a"]), (3, "deep", ["x"]), (4, "deep", [])], "item_id long, source_distance string, evidence array<string>")
    pack = spark.createDataFrame([("a", "near", "full_text"), ("b", "far", "abstract")], "source_id string, source_distance string, content_kind string")
    got = {x.item_id: (x.source_distance, x.content_kind) for x in bank.with_sources(items, pack).collect()}
    assert got == {1: ("seed", "abstract"), 2: ("near", "full_text"), 3: ("deep", None), 4: ("deep", None)}


def test_bad_lines_have_their_number(spark, tmp_path):
    good = {"question_id": "q1", "question": "?", "options": [{"option_id": "A"}], "correct_option_ids": ["A"]}
    lines = [json.dumps(good), "", "{broken", "[1]", json.dumps(good | {"question": ""}), json.dumps(good | {"correct_option_ids": []}), "  "]
    (tmp_path / "bank.jsonl").write_text("\r\n".join(lines))
    got = sorted((x.line, x.reason) for x in bank.bank_errors(spark, f"file://{tmp_path}/bank.jsonl").collect())
    assert got == [(3, "no_object"), (4, "no_object"), (5, "no_question"), (6, "no_key")]
    assert [x.line for x in bank.bank_lines(spark, f"file://{tmp_path}/bank.jsonl").collect()] == [1, 3, 4, 5, 6]


def test_a_changed_key_changes_its_hash(spark):
    items = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "item_id long, correct_option_id string")
    parts = spark.createDataFrame([(1, "selection"), (2, "selection"), (3, "holdout")], "item_id long, part string")
    one = {x.part: x.key_hash for x in bank.frozen_key(items, parts)[1].collect()}
    two = {x.part: x.key_hash for x in bank.frozen_key(items.withColumn("correct_option_id", F.when(F.col("item_id") == 2, "D").otherwise(F.col("correct_option_id"))), parts)[1].collect()}
    assert one["holdout"] == two["holdout"] and one["selection"] != two["selection"]
