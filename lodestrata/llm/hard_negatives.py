"""Hard-negative mining by inner product over a forest of cover trees.

A row x gets one more coordinate, sqrt(M^2 - |x|^2), where M is the largest norm, and a query gets 0 there and the
length M. Then all rows lie as far from the origin as the query, and a smaller distance is a larger inner product. Rows
are dealt to cells around pivots and cells to blocks of some thousand rows; each block has a cover tree: a node's points
lie within its radius of its centre, which is itself a row, its children's centres are further apart than the level's
radius, and a node's first child has its own centre. The tree is a table: each row lists the nodes that it is the centre of.

A node's radius bounds the inner products of all its points. A search goes down from the node with the best bound, skips
nodes that lie wholly outside the window of scores and verifies what is left with exact integers. It first looks into the
block nearest the query; what it finds there is the least score that all other blocks are asked for.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.text import has_repeated_ids
from lodestrata.shipping import ship
from lodestrata.tables import drop, scratch, stored

BLOCK = 4096  #: rows of a block, about
SAMPLE, CELLS = 2048, 1024  #: rows that pivots are chosen from, about, and pivots at most: the only fitted part
GROUP = 4096  #: queries that meet a block in one task
SHRINK, LEAF = 1.5, 64  #: radius of a level by that of the next, and points that are not divided further
CHUNK = 512  #: points verified at a time
LONG = (1 << 63) - 1
EXACT = 2.0**53

_NODES = "array<struct<node:int,parent:int,end:int,radius:double>>"
_TREE = f"block long, pos int, vec_id long, label int, x array<double>, nodes {_NODES}"
_WINDOWS = "array<struct<key:long,lo:long,hi:long>>"


def prepared(vectors: DataFrame, flip: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """vec_id, label, x (whole numbers as doubles), norm2 of the rows that take part: those without null or non-finite
    parts. Rows without vec_id can't be named and are left out; of several rows of one vec_id the least (label, x) counts."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~F.exists("v", bad))
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.cast("int").alias("label"), F.transform("v", lambda v: whole(v * float(scale))).alias("x"))
    if has_repeated_ids(rows.withColumnRenamed("vec_id", "doc_id")):
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """A column of lists as rows; a shorter list ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """x with the coordinate that makes every norm sqrt(most)."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def _apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def farthest_first(points: np.ndarray, first: int, radius: float, most: int) -> tuple[list[int], np.ndarray]:
    """Centres, each the point farthest from those before it, until all lie within the radius or there are `most`,
    and each point's nearest."""
    centres, nearest = [first], np.zeros(len(points), np.int64)
    norms = (points * points).sum(1)
    far = norms + norms[first] - 2 * (points @ points[first])  # squared, exact enough to choose by
    while len(centres) < most:
        new = int(far.argmax())
        if far[new] <= radius * radius:
            break
        here = norms + norms[new] - 2 * (points @ points[new])
        closer = here < far
        closer[new] = True
        nearest[closer], far[closer] = len(centres), here[closer]
        centres.append(new)
    return centres, nearest


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """The order in which each node's points lie together, centre first, and nodes (parent, start, end, radius)."""
    order = np.arange(len(points))
    nodes: list[tuple[int, int, int, float]] = []
    work = [(-1, 0, len(points), None)]
    while work:
        parent, start, end, level = work.pop()
        own = order[start:end]
        far = _apart(points[own], points[own[0]])
        radius = float(far.max())
        nodes.append((parent, start, end, radius * (1 + 1e-12)))
        me = len(nodes) - 1
        if end - start <= LEAF or radius == 0:
            continue
        level = radius if level is None else min(radius, level)
        centres, nearest = farthest_first(points[own], 0, level / SHRINK, len(own))
        by = np.lexsort((np.arange(len(own)) != np.asarray(centres)[nearest], nearest))
        order[start:end] = own[by]
        edges = np.searchsorted(nearest[by], np.arange(len(centres) + 1))
        work += [(me, start + int(a), start + int(b), level / SHRINK) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return order, nodes


def bounds(dots: np.ndarray, norms: np.ndarray, radius: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest and least inner product of queries (columns) with the points of nodes (rows), from those with the centres."""
    m = most**0.5
    by = norms / m if m else np.zeros_like(norms)  # a query's length is divided by this
    away = np.sqrt(np.maximum(2 * most - 2 * dots / np.where(by, by, 1), 0))
    r = radius[:, None]
    near = np.minimum(r, away)
    up = np.minimum((away * near - near * near / 2) * by, norms * r)
    low = np.minimum((away * r + r * r / 2) * by, norms * r)
    slack = 1e-9 * norms * (m + r) + 1e-6
    return dots + up + slack, dots - low - slack


class Tree:
    def __init__(self, table: pa.Table, most: float, d: int):
        table = table.sort_by("pos")
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.x, self.exact = _matrix(table["x"], d), most < EXACT
        lists = table["nodes"].combine_chunks()
        start = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
        fields = lists.flatten()
        node = fields.field("node").to_numpy()
        by = np.argsort(node)
        self.start, self.end = start[by], fields.field("end").to_numpy()[by]
        self.radius, parent = fields.field("radius").to_numpy()[by], fields.field("parent").to_numpy()[by]
        kids = np.argsort(parent, kind="stable")[1:]
        edges = np.searchsorted(parent[kids], np.arange(len(node) + 1))
        self.kids = [kids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.leaf = edges[:-1] == edges[1:]

    def scores(self, at: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.x[at] @ q).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        return np.clip(whole(self.x[at]) @ whole(q), -LONG - 1, LONG).astype(np.int64) if len(self.x[at]) else np.zeros(0, np.int64)

    def best(self, q: np.ndarray, up: np.ndarray, low: np.ndarray, windows: list[tuple[int, int]], k: int, fits) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best rows that `fits` takes in each window lo..hi; of equal scores the least ids. A row is scored
        once for all windows."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        los, high = [lo for lo, _ in windows], max(hi for _, hi in windows)
        lo = min(los)
        heap = [(-up[0], 0)] if up[0] >= lo and low[0] <= high else []
        while heap:
            bound, node = heappop(heap)
            if -bound < lo:
                break
            kids = np.array([node]) if self.leaf[node] else self.kids[node]
            kids = kids[(up[kids] >= lo) & (low[kids] <= high)]
            leaf = self.leaf[kids]
            for kid in kids[~leaf]:
                heappush(heap, (-min(up[kid], high), int(kid)))
            kids = kids[leaf]
            kids = kids[np.argsort(-up[kids])]
            size = np.cumsum(self.end[kids] - self.start[kids])
            all_scores = None
            if len(size) and 4 * size[-1] > self.end[node] - self.start[node] and self.exact:  # most of the node: in one go, in place
                all_scores = self.scores(slice(self.start[node], self.end[node]), q)
            at = 0
            while at < len(kids) and up[kids[at]] >= lo:
                to = len(kids) if all_scores is not None else max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                few = kids[at:to]
                n = self.end[few] - self.start[few]
                rows = np.repeat(self.start[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                got = self.scores(rows, q) if all_scores is None else all_scores[rows - self.start[node]]
                good = np.flatnonzero((got >= lo) & (got <= high))
                good = good[fits(rows[good])]
                rows, got = rows[good], got[good]
                for w, (_, hi) in enumerate(windows if len(rows) else ()):
                    here = (got >= los[w]) & (got <= hi)
                    if here.any():
                        ids, scores = np.concatenate([found[w][0], self.ids[rows[here]]]), np.concatenate([found[w][1], got[here]])
                        if len(ids) >= k:
                            first = np.lexsort((ids, -scores))[:k]
                            ids, scores = ids[first], scores[first]
                            los[w] = max(los[w], int(scores[-1]))
                        found[w] = ids, scores
                lo = min(los)
                at = to
        return found


class Forest:
    """The index: trees by block as a table, pivots and radii of the cells (at most CELLS of them) with their numbers of blocks."""

    def __init__(self, rows: DataFrame):
        """rows: those of `prepared`, written."""
        self.spark = rows.sparkSession
        self.n, most, self.d = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("x"))).first()
        self.most = most = most or 0.0
        self.d = d = self.d or 0
        if not self.n:
            return
        sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, self.n // SAMPLE))) == 0).select("vec_id", "x").toPandas().sort_values("vec_id")
        sample = np.zeros((max(1, len(sampled)), d))
        for k, x in enumerate(sampled["x"]):
            sample[k, : len(x)] = x
        sample = augmented(sample, most)
        centre = int(_apart(sample, sample.mean(0)).argmin())
        chosen, _ = farthest_first(sample, centre, 0.0, max(1, min(CELLS, self.n // BLOCK)))
        self.pivots = pivots = sample[chosen]

        def deal(batches):
            for b in batches:
                x = augmented(_matrix(b.column("x"), d), most)
                away = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "x")), pa.array(cell.astype(np.int32)), pa.array(away.min(1) if len(b) else np.zeros(0))], ["vec_id", "label", "x", "cell", "away"])

        dealt = stored(rows.select("vec_id", "label", "x").mapInArrow(deal, "vec_id long, label int, x array<double>, cell int, away double"), "op11-cells")
        cells = dealt.groupBy("cell").agg(F.max("away").alias("away"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).collect()
        self.radius, self.blocks = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
        for c in cells:
            self.radius[c["cell"]], self.blocks[c["cell"]] = c["away"] + 1e-6 * (1 + most**0.5), c["blocks"]
        many = self.spark.createDataFrame([(c["cell"], c["blocks"]) for c in cells], "cell int, blocks int")
        block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))

        def build(table: pa.Table) -> pa.Table:
            x = _matrix(table["x"], d)
            order, nodes = cover_tree(augmented(x, most))
            at: list[list] = [[] for _ in order]
            for k, (parent, start, end, radius) in enumerate(nodes):
                at[start].append({"node": k, "parent": parent, "end": end, "radius": radius})
            kind = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("end", pa.int32()), ("radius", pa.float64())]))
            table = table.take(pa.array(order))
            return pa.table([table["block"], pa.array(np.arange(len(order), dtype=np.int32)), table["vec_id"], table["label"], table["x"], pa.array(at, kind)], names=["block", "pos", "vec_id", "label", "x", "nodes"])

        placed = dealt.join(F.broadcast(many), "cell").select(block.alias("block"), "vec_id", "label", "x")
        self.tree = stored(placed.groupBy("block").applyInArrow(build, _TREE), "op11-trees")
        drop(dealt)

    def _asked(self, queries: DataFrame, home: bool) -> DataFrame:
        """A row for each query and block that may hold rows of its windows: of the nearest cell one block, or all but that one."""
        pivots, radius, blocks, most, d = self.pivots, self.radius, self.blocks, self.most, self.d

        def ask(batches):
            live = np.flatnonzero(blocks)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    b = batch.slice(at, 256)
                    x = _matrix(b.column("x"), d)
                    dots = pivots[live, :-1] @ x.T
                    up, low = bounds(dots, np.sqrt((x * x).sum(1)), radius[live], most)
                    windows = b.column("windows")
                    first, last = windows.offsets.to_numpy()[:-1], windows.offsets.to_numpy()[1:]
                    flat = windows.values
                    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    salt = b.column("vec_id").to_numpy() // 50
                    for k in range(len(b)):
                        nearest = int(dots[:, k].argmax())
                        own = (int(live[nearest]) << 32) + int(salt[k] % blocks[live[nearest]])
                        if home:
                            at_blocks = np.array([own])
                        else:
                            some = live[(up[:, k] >= lo[first[k] : last[k]].min()) & (low[:, k] <= hi[first[k] : last[k]].max())] if last[k] > first[k] else live[:0]
                            at_blocks = np.concatenate([np.zeros(0, np.int64), *((c << 32) + np.arange(blocks[c]) for c in some)])
                            at_blocks = at_blocks[at_blocks != own]
                        for s in range(0, len(at_blocks), 1024):
                            part = at_blocks[s : s + 1024]
                            row = b.slice(k, 1).take(pa.array(np.zeros(len(part), np.int64)))
                            yield pa.RecordBatch.from_arrays([pa.array(part), row.column("grp"), row.column("vec_id"), row.column("label"), row.column("x"), row.column("windows")], ["block", "grp", "vec_id", "label", "x", "windows"])

        return queries.mapInArrow(ask, f"block long, grp int, vec_id long, label int, x array<double>, windows {_WINDOWS}")

    def search(self, queries: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """(anchor_id, key, vec_id, score): of each query's windows the k best rows of its label or of other labels, by block."""
        most, d = self.most, self.d

        def find(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if len(left) and len(right):
                tree = Tree(left, most, d)
                centres = tree.x[tree.start]
                for at in range(0, len(right), 128):
                    few = right.slice(at, 128).combine_chunks()
                    q = _matrix(few["x"], d)
                    up, low = bounds(centres @ q.T, np.sqrt((q * q).sum(1)), tree.radius, most)
                    up, low = np.ascontiguousarray(up.T), np.ascontiguousarray(low.T)
                    for i, (me, label, windows) in enumerate(zip(few["vec_id"].to_pylist(), few["label"].to_pylist(), few["windows"].to_pylist(), strict=True)):
                        fits = (lambda r, me=me, label=label: (tree.labels[r] == label) & (tree.ids[r] != me)) if same else (lambda r, label=label: tree.labels[r] != label)
                        for w, (ids, scores) in zip(windows, tree.best(q[i], up[i], low[i], [(w["lo"], w["hi"]) for w in windows], k, fits), strict=True):
                            out.append((np.full(len(ids), me), np.full(len(ids), w["key"]), ids, scores))
            columns = [np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in range(4)]
            return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["anchor_id", "key", "vec_id", "score"])

        asked = stored(self._asked(queries, home), "op11-asked")
        met = stored(asked.select("block", "grp").distinct(), "op11-met")
        trees = self.tree.join(met.hint("merge"), "block")
        return stored(trees.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp")).applyInArrow(find, "anchor_id long, key long, vec_id long, score long"), "op11-found")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and window, with their rank."""
    by = W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _both(forest: Forest, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each query's windows: in its nearest block, then in all others that may hold as good ones."""
    here = forest.search(queries, k, same, True)
    least = _first(here, k).where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("least"))
    raised = lambda w: F.struct(w["key"].alias("key"), F.greatest(w["lo"], F.coalesce(F.col("least")[w["key"]], w["lo"])).alias("lo"), w["hi"].alias("hi"))
    rest = queries.join(least.withColumnRenamed("anchor_id", "vec_id").hint("merge"), "vec_id", "left").withColumn("windows", F.when(F.col("least").isNull(), F.col("windows")).otherwise(F.transform("windows", raised)))
    found = here.unionByName(forest.search(rest.select("vec_id", "label", "x", "grp", "windows"), k, same, False))
    return stored(_first(found, k), "op11-best")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, exact.

    Anchors are the rows whose vec_id is divisible by `every`; positives their best rows of the same label; negatives the
    best of other labels with low % to high % of the positive's score. Rows and labels as in `prepared`: null labels, vectors
    or parts and non-finite parts take no part, a repeated vec_id counts once, a shorter vector ends in zeros, other columns
    are ignored, an empty table gives no rows. high is a multiple of 5 and low divides 100. Scores that no long can hold
    count as the largest or least long. An anchor without positives, or with none in the window, has no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with scratch(spark) as kept:
        rows = stored(prepared(vectors), "op11-rows")
        forest = Forest(rows)
        if not forest.n:
            return spark.createDataFrame([], names)
        anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "x")
        groups = max(1, anchors.count() // GROUP)
        anchors = anchors.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(-LONG - 1).alias("lo"), F.lit(LONG).alias("hi")))
        good = _both(forest, anchors.withColumn("windows", whole), positives, True)
        lo = -F.expr(f"(-score - pmod(-score, {100 // low})) div {100 // low}")
        hi = F.expr(f"((score - pmod(score, 20)) div 20) * {high // 5} + (pmod(score, 20) * {high // 5}) div 20")
        windows = good.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("key"), lo.alias("lo"), hi.alias("hi"))).alias("windows"))
        asking = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id").hint("merge"), "vec_id").select("vec_id", "label", "x", "grp", "windows")
        bad = _both(forest, asking, negatives, False)
        out = good.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score")).join(bad.select("anchor_id", "key", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["anchor_id", "key"])
        out = stored(out.select("anchor_id", F.col("key").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"), "op11-mined")
        kept.append(out)
        return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
