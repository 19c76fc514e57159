import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import notes, reports, reuse


def test_bloom_filter_loses_no_member(spark):
    members = spark.range(3000).select((F.col("id") * 7).alias("a"), F.lit("x").alias("b"))
    rows = spark.range(21000).select(F.col("id").alias("a"), F.lit("x").alias("b")).unionByName(spark.createDataFrame([(None, "x"), (7, None)], "a long, b string"))
    maybe, sure = reuse.maybe_in(rows, members, ["a", "b"])
    hit = {x.a for x in maybe.collect()}
    assert hit >= {k * 7 for k in range(3000)} and len(hit) < 3000 + 0.1 * 18000
    assert maybe.count() + sure.count() == 21002 and sure.where("a is null or b is null").count() == 2
    assert reuse.maybe_in(rows, members.limit(0), ["a", "b"])[0].count() == 0


def test_bundles_come_from_a_listing(spark, tmp_path):
    """Each of the conditions fails once: version, source, fingerprint, bundle gone, no bundle, still running."""
    (tmp_path / "b").mkdir()
    for k in (1, 2, 3, 4, 7):
        (tmp_path / "b" / f"{k}.json").write_text("x")
    there = reuse.listed(spark, f"file://{tmp_path}/b", "*.json")
    assert there.columns == ["path"] and there.count() == 5
    path = lambda k: f"file:{tmp_path}/b/{k}.json"
    results = [(1, "completed", "v", "s", "f", path(1)), (2, "completed", "w", "s", "f", path(2)), (3, "completed", "v", "t", "f", path(3)), (4, "completed", "v", "s", "g", path(4)), (5, "completed", "v", "s", "f", path(5)), (6, "completed", "v", "s", "f", None), (7, "running", "v", "s", "f", path(7)), (8, "failed", "v", "s", "f", None)]
    manifest = spark.createDataFrame([(k, "v", "s") for k in range(1, 10)], "paper_id long, version string, source_sha256 string")
    done = spark.createDataFrame(results, "paper_id long, status string, version string, source_sha256 string, fingerprint string, bundle string")
    ids = lambda d: sorted(x.paper_id for x in d.collect())
    assert ids(reuse.pending(manifest, done, there, "f")) == [2, 3, 4, 5, 6, 7, 9]
    assert ids(reuse.pending(manifest, done, there, "f", retry_failed=True)) == [2, 3, 4, 5, 6, 7, 8, 9]


def test_a_hub_has_all_links_and_notes_become_files(spark, tmp_path):
    edges = [(f"p:{k}", "hub/1") for k in range(3000)] + [("hub/1", "p:5"), ("hub/1", "hub/1"), ("p:7", "hub/1")]
    visits = [(1, "hub/1"), (1, "p:7"), (2, "p:5")]
    args = (spark.createDataFrame(visits, "agent_id long, id string"), spark.createDataFrame([("hub/1", "Hub", 2001, "s2")], "id string, title string, year int, provider string"), spark.createDataFrame(edges, "src string, dst string"))
    out = notes.render_notes(*args, span=100)
    text = {(x.agent_id, x.path): x.content for x in out.collect()}
    hub = text[1, "hub_1.md"]
    links = hub.split("## Cited by (incoming)\n")[1].split("\n\n")[0].split("\n")
    assert links == [f"- [[{x}]]" for x in sorted(f"p_{k}" for k in range(3000))]
    assert hub.split("## References (outgoing)\n")[1].split("\n\n")[0] == "- [[p_5]]" and hub.endswith("## Referenced by (in agent's graph)\n- [[p_7]]\n") and "year: 2001" in hub
    assert text[2, "p_5.md"].endswith("(none)\n")
    notes.write_notes(out, f"file://{tmp_path}/notes")
    files = list((tmp_path / "notes").glob("agent_id=*/path=*/*.txt"))
    assert len(files) == 3
    assert next(f for f in files if "path=hub_1.md" in str(f)).read_text().rstrip("\n") == hub.rstrip("\n")


def test_bootstrap_against_numpy(spark):
    r = random.Random(4)
    rows = [(arm, k, r.random() + (arm == "b") * 0.1, r.randrange(100, 900), r.randrange(1, 9)) for k in range(60) for arm in "ab"]
    got = {x.measure: x for x in reports.gain_per_cost(spark.createDataFrame(rows, "arm string, task long, quality double, tokens long, fetches long"), "a", "b", replicates=100, seed=3).collect()}
    a = {x[1]: x for x in rows if x[0] == "a"}
    b = {x[1]: x for x in rows if x[0] == "b"}
    gain, tokens, fetches = (np.array([f(k) for k in a]) for f in (lambda k: b[k][2] - a[k][2], lambda k: b[k][3], lambda k: b[k][4]))
    told = {"mean": [], "per_1000_tokens": [], "per_fetch": []}
    for k in range(1, 101):
        u = np.array([(int(hashlib.md5(f"3:{k}:{t}".encode()).hexdigest()[:12], 16) + 1) / 2**48 for t in a])
        n = sum((u > p).astype(int) for p in reports.POISSON)
        told["mean"].append((n * gain).sum() / n.sum())
        told["per_1000_tokens"].append(1000 * (n * gain).sum() / (n * tokens).sum())
        told["per_fetch"].append((n * gain).sum() / (n * fetches).sum())
    for name, value in (("mean", gain.mean()), ("per_1000_tokens", 1000 * gain.sum() / tokens.sum()), ("per_fetch", gain.sum() / fetches.sum())):
        x = got[name]
        assert np.allclose([x.value, x.low, x.high], [value, *np.percentile(told[name], [2.5, 97.5])]) and x.low < x.value < x.high


def test_deltas_across_a_change_of_version(spark):
    dims = [(1, 1, "v1", "a", 0.5), (1, 2, "v1", "a", 0.7), (1, 3, "v2", "a", 0.9), (1, 4, "v1", "a", 0.9), (2, 1, "v1", "a", 0.5)]
    checks = [(1, 1, 0), (1, 1, 3), (1, 2, 0)]
    got = {(x.run_id, x.seq): (round(x.integrity, 3), round(x.overall, 3), round(x.delta, 3)) for x in reports.composite_by_version(spark.createDataFrame(dims, "run_id long, seq long, version string, dimension string, score double"), spark.createDataFrame(checks, "run_id long, seq long, failures long"), {}).collect()}
    assert got == {(1, 1): (0.5, 0.5, 0.5), (1, 2): (1.0, 0.85, 0.35), (1, 3): (1.0, 0.95, 0.95), (1, 4): (1.0, 0.95, 0.95), (2, 1): (1.0, 0.75, 0.75)}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_lines_are_joined_piece_by_piece(span):
    """Whatever the batches, pieces put together in order are each key's lines, and only a task's ends and long keys are left open."""
    r = random.Random(span)
    keys = sorted([(a, f"k{r.randrange(40)}" if r.random() < 0.9 else None) for a in range(3) for _ in range(200)] + [(3, "hub")] * 500 + [(4, "z")], key=lambda x: (x[0], x[1] or ""))
    rows = pa.table({"a": [x[0] for x in keys], "k": [x[1] for x in keys], "__line": [f"l{k}" for k in range(len(keys))]})
    cuts = sorted(r.randrange(len(rows)) for _ in range(25))
    tables = [rows.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    out = [x for t in notes._pieces(tables, ["a", "k"], span, 5) for x in t.to_pylist()]
    assert [x["__part"] for x in out] == list(range(5, 5 + len(out))) and max(x["__n"] for x in out) <= span and sum(x["__n"] for x in out) == len(rows)
    want = {k: [f"l{n}" for n, x in enumerate(keys) if x == k] for k in set(keys)}
    for k, held in want.items():
        mine = [x for x in out if (x["a"], x["k"]) == k]
        assert "\n".join(x["__text"] for x in mine) == "\n".join(held)
        assert not any(x["__whole"] for x in mine) or len(mine) == 1
        if len(held) <= span and k not in (keys[0], keys[-1], (3, "hub")):
            assert len(mine) == 1
    assert any(x["__whole"] for x in out) == (span > 1 or any(len(x) == 1 for x in want.values()))
