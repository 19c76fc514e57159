import math
import random

import numpy as np
import pytest

from lodestrata.llm import hard_negatives as h


def brute(rows):
    """The contract, pair by pair, in whole numbers."""
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        seen[i] = min(seen.get(i, new), new)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, x) in seen.items():
        if a % 50:
            continue
        scored = sorted((-dot(x, y), i, k) for i, (k, y) in seen.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out |= {(a, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(fit, 1)}
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, label, "x", 1.0, 7) for i, v, label in rows], "vec_id long, embedding array<float>, label int, block string, norm2 double, pos int")
    with pytest.MonkeyPatch.context() as m:
        for name, n in sizes.items():
            m.setattr(h, name, n)
        return sorted(tuple(r) for r in h.mine(df).collect())


def test_against_all_pairs_over_many_blocks(spark):
    """Clusters, a third of all rows equal, ties, nulls, repeated ids, short and empty vectors; blocks of 64 rows in 8 cells."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] + 0.3 * r.normal(size=8)], int(r.integers(0, 10))) for k in range(500)]
    rows += [(k, [0.5] * 8, int(k % 3)) for k in range(500, 760)]
    rows += [(k, [0.5] * 8, 0) for k in range(500, 520)] + [(550, [9.0] * 8, 9)]
    rows += [(800, None, 1), (801, [1.0, None], 1), (802, [float("nan")] * 8, 1), (803, [float("inf")] * 8, 2), (804, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(850, [], 3), (851, [1.0, 2.0], 3), (900, [0.0] * 8, 3), (901, [-1.0] * 8, 3), (950, [-2.0] * 8, 3)]
    random.Random(1).shuffle(rows)
    got = run(spark, rows, BLOCK=64, CELLS=8, GROUP=4, LEAF=4)
    assert len(got) == len(set(got)) > 50 and set(got) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, 1)]) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    few = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.7], 2), (3, [0.7, 0.7], 2), (4, [0.6, 0.6], 3), (5, [0.6, 0.6], 3)]
    assert set(run(spark, few)) == brute(few)
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [1e29, 3.0], 2)]
    assert len(run(spark, huge)) == 0  # the scores count as the largest long: none is within 95 % of another
    large = [(0, [1e5, 1.0], 1), (1, [1e5, 2.0], 1), (2, [7e4, 3.0], 2), (3, [6e4, 5.0], 3)]
    assert set(run(spark, large)) == brute(large)


def test_tree_is_a_cover_tree_and_its_bounds_hold():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(900, 6)) * 100)
    x[300:500] = x[0]
    most = float((x * x).sum(1).max())
    points = h.augmented(x, most)
    order, nodes = h.cover_tree(points)
    assert sorted(order.tolist()) == list(range(900))
    kids = {}
    for k, (parent, start, end, radius) in enumerate(nodes):
        assert np.sqrt(((points[order[start:end]] - points[order[start]]) ** 2).sum(1)).max() <= radius
        kids.setdefault(parent, []).append(k)
    for parent, own in kids.items():
        if parent >= 0:
            _, start, end, radius = nodes[parent]
            spans = sorted(nodes[k][1:3] for k in own)
            assert spans[0][0] == start and spans[-1][1] == end and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # the first has the parent's centre
            centres = points[order[[nodes[k][1] for k in own]]]
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + 1e9 * np.eye(len(own))
            assert gaps.min() > max(nodes[k][3] for k in own) * 0.999  # apart by more than what each covers
    q = np.round(r.normal(size=(20, 6)) * 100)
    start, radius = np.array([n[1] for n in nodes]), np.array([n[3] for n in nodes])
    up, low = h.bounds(x[order[start]] @ q.T, np.sqrt((q * q).sum(1)), radius, most)
    for k, (_, s, e, _) in enumerate(nodes):
        scores = x[order[s:e]] @ q.T
        assert (scores.max(0) <= up[k]).all() and (scores.min(0) >= low[k]).all()


def test_search_skips_what_lies_outside(spark):
    """Far clusters: a query verifies a small share of all rows and still finds the best."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    x = np.vstack([np.round(1000 * c + 20 * r.normal(size=(400, 16))) for c in np.eye(16)[:8]])
    most = float((x * x).sum(1).max())
    order, nodes = h.cover_tree(h.augmented(x, most))
    at = [[] for _ in order]
    for k, (parent, start, end, radius) in enumerate(nodes):
        at[start].append({"node": k, "parent": parent, "end": end, "radius": radius})
    tree = h.Tree(pa.table({"pos": range(len(order)), "vec_id": order, "label": np.zeros(len(order), np.int32), "x": list(x[order]), "nodes": at}), most, 16)
    met = []
    fits = lambda rows: (met.append(len(rows)), np.ones(len(rows), bool))[1]
    for q in x[::100]:
        up, low = h.bounds((tree.x[tree.start] @ q)[:, None], np.array([np.sqrt(q @ q)]), tree.radius, most)
        (ids, scores), (wide, _) = tree.best(q, up[:, 0], low[:, 0], [(-(1 << 62), 1 << 62), (0, 1 << 62)], 5, fits)
        best = np.lexsort((np.arange(len(x)), -(x @ q)))[:5]
        assert ids.tolist() == wide.tolist() == best.tolist() and scores.tolist() == (x @ q)[best].astype(int).tolist()
    assert sum(met) < 0.3 * len(x) * 32
