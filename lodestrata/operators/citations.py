"""Citation graph: edge tables, neighbours, aliases, expansion, reachability, and paper snapshots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import maths
from lodestrata.tables import stored

FEW = 50_000  #: links that are joined up by the driver


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order, by partial aggregates."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def edge_provenance(observed: DataFrame) -> DataFrame:
    """src, dst, provider, observations: the least provider of each edge and how often it was seen."""
    return observed.groupBy("src", "dst").agg(F.min("provider").alias("provider"), F.count("*").alias("observations"))


def edge_observations(observed: DataFrame, *, src: str | None = None, dst: str | None = None, evidence_type: str | None = None) -> DataFrame:
    """The observations of edges that have the values asked for, by src, dst, evidence type and provider."""
    for name, value in (("src", src), ("dst", dst), ("evidence_type", evidence_type)):
        if value is not None:
            observed = observed.where(F.col(name) == value)
    return observed.orderBy("src", "dst", "evidence_type", "provider")


def upsert_papers(current: DataFrame, incoming: DataFrame, key: str = "id", sticky: tuple[str, ...] = ("embedding",), flags: tuple[str, ...] = ("integrated",)) -> DataFrame:
    """The snapshot after incoming rows: they replace all columns, but a sticky value stays where the new one is null,
    and a flag once true stays true."""
    new = F.col("b.__new").isNotNull()
    both = current.alias("a").join(incoming.withColumn("__new", F.lit(True)).alias("b"), key, "full")

    def value(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in sticky:
            return F.coalesce(b, a)
        if c in flags:
            return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
        return F.when(new, b).otherwise(a)

    return both.select(key, *[value(c).alias(c) for c in current.columns if c != key])


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """current and the first incoming row of each key that it lacks."""
    fresh = first_rows(incoming, keys, order).join(current.select(*keys).distinct(), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def lookup(df: DataFrame, keys: DataFrame, on: list[str], order: list | None = None) -> DataFrame:
    """The rows of df that have one of the keys, in an order if one is given."""
    out = df.join(keys.select(*on).distinct(), on, "left_semi")
    return out.orderBy(*order) if order else out


def readable(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """id, readable, integrated of ids: whether the paper is known and has an abstract, and whether it is known and integrated."""
    known = papers.select("id", F.col("abstract").isNotNull().alias("__a"), F.coalesce("integrated", F.lit(False)).alias("__i"))
    return asked.select("id").join(known, "id", "left").select("id", F.coalesce("__a", F.lit(False)).alias("readable"), F.coalesce("__i", F.lit(False)).alias("integrated"))


def union_edges(references: DataFrame, citants: DataFrame) -> DataFrame:
    """src, dst of every edge of both directions once; citants are (paper, citing paper)."""
    return references.select("src", "dst").unionByName(citants.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbor, mode: what a node cites (ref) and what cites it (cites). A hub is a hot key of either join; adaptive
    execution splits its partition, since the nodes' side is one row a key."""
    out = nodes.join(edges, nodes["id"] == edges["src"]).select("id", F.col("dst").alias("neighbor"), F.lit("ref").alias("mode"))
    into = nodes.join(edges, nodes["id"] == edges["dst"]).select("id", F.col("src").alias("neighbor"), F.lit("cites").alias("mode"))
    return out.unionByName(into)


def canonicalize(aliases: DataFrame) -> DataFrame:
    """alias, canonical_id at the end of each chain, by pointer jumping: each round doubles the steps taken.

    Self-aliases are dropped, an alias's first row by canonical id counts. Where steps as many as there are aliases lead to no
    end, they have led into a cycle: its members, and what leads to it, map to its least id. Tables of steps are joined by
    merging: their files are small, they themselves aren't, and a broadcast would pass them through the driver.
    """
    step = aliases.where("alias <> canonical_id").groupBy("alias").agg(F.min("canonical_id").alias("next")).withColumn("least", F.least("alias", "next"))
    step = stored(step, "aliases")
    rows, taken = step.count(), 1
    while taken < 2 * rows:
        ahead = step.select(F.col("alias").alias("next"), F.col("next").alias("further"), F.col("least").alias("there"))
        moved = step.join(ahead.hint("merge"), "next", "left").select("alias", F.coalesce("further", "next").alias("next"), F.least("least", "there").alias("least"), F.col("further").isNotNull().alias("moved"))
        step, taken = stored(moved, "aliases"), 2 * taken
        if step.where("moved").isEmpty():
            return step.select("alias", F.col("next").alias("canonical_id"))
    ring = step.select(F.col("alias").alias("next"), F.col("least").alias("ring"))
    return step.join(ring.hint("merge"), "next", "left").select("alias", F.coalesce("ring", "next").alias("canonical_id"))


def k_hop(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """id, hop: nodes within k steps of the seeds in either direction, each at its least hop. The two-way edges and each hop's
    nodes are written once; a hub's edges are split by adaptive execution."""
    both = stored(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("next"))), "ways")
    seen = edge = stored(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "hop")
    for hop in range(1, k + 1):
        edge = edge.join(both, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        edge = stored(edge, "hop")
        seen = seen.unionByName(edge)
    return seen


def _joined_up(links: pa.Table) -> pa.Table:
    """v, to: the least node that each node of links (a, b) is joined to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pa.table({"v": pa.array(up, pa.int64()), "to": pa.array([top(x) for x in up], pa.int64())})


def coherence(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """agent_id, coherence: the share of an agent's visited nodes that its first one reaches inside the visited set, over
    edges of either direction.

    Nodes are numbered, and each round moves every node that has edges to the one of least hash among itself and its
    neighbours; edges then link the nodes moved to. That shrinks any graph by a share a round, chains and stars too, so all
    rounds together cost little more than the first, and only sizes of clusters and the place of each first node are kept.
    The last FEW links are joined up at once.
    """
    nodes = visits.groupBy("agent_id", "node").agg(F.min("ordinal").alias("ordinal"))
    nodes = stored(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    a, b = nodes.select("agent_id", F.col("node").alias("src"), F.col("v").alias("a")), nodes.select("agent_id", F.col("node").alias("dst"), F.col("v").alias("b"))
    inside = edges.join(a, "src").join(b, ["agent_id", "dst"])
    links = stored(inside.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "inside")
    first = stored(nodes.groupBy("agent_id").agg(F.min_by("v", F.struct("ordinal", "node")).alias("v"), F.count("*").alias("n")), "first")
    sizes = None
    turn = 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        last = links.limit(FEW + 1).toArrow()
        if last.num_rows <= FEW:
            near = visits.sparkSession.createDataFrame(_joined_up(last))
        else:
            ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("rank", rank("b"))
            near = ways.groupBy(F.col("a").alias("v")).agg(F.min_by("b", "rank").alias("b"), F.min("rank").alias("rank"))
            near = near.select("v", F.when(rank("v") < F.col("rank"), F.col("v")).otherwise(F.col("b")).alias("to"))
        near = stored(near, "near")
        met = near.withColumn("n", F.lit(1).cast("long")) if sizes is None else sizes.join(near, "v", "left").select(F.coalesce("to", "v").alias("to"), "n")
        sizes = stored(met.groupBy(F.col("to").alias("v")).agg(F.sum("n").alias("n")), "sizes")
        first = stored(first.join(near, "v", "left").select("agent_id", F.coalesce("to", "v").alias("v"), "n"), "first")
        if last.num_rows <= FEW:
            break
        x, y = near.select(F.col("v").alias("a"), F.col("to").alias("x")), near.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = links.join(x, "a").join(y, "b").where("x <> y")
        links = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "inside")
    if sizes is None:
        return first.select("agent_id", (F.lit(1) / F.col("n")).alias("coherence"))
    reached = sizes.withColumnRenamed("n", "reached")
    return first.join(reached, "v", "left").select("agent_id", (F.coalesce("reached", F.lit(1)) / F.col("n")).alias("coherence"))


def source_distance(papers: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """id, distance: seed, direct_reference, citant or deeper, in that order of precedence."""
    refs = edges.where(F.col("src") == seed).select(F.col("dst").alias("id")).distinct().withColumn("r", F.lit(True))
    cits = edges.where(F.col("dst") == seed).select(F.col("src").alias("id")).distinct().withColumn("c", F.lit(True))
    both = papers.select("id").join(refs, "id", "left").join(cits, "id", "left")
    return both.select("id", F.when(F.col("id") == seed, "seed").when(F.col("r"), "direct_reference").when(F.col("c"), "citant").otherwise("deeper").alias("distance"))


def diversity(visits: DataFrame, vectors: DataFrame) -> DataFrame:
    """agent_id, diversity: 1 less the mean cosine of all pairs of visited vectors, from the sum of unit vectors alone, in one
    aggregate."""
    raw = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="u").transform(raw)  # in SQL a norm inside a lambda is taken again for every component
    rows = visits.select("agent_id", "id").join(unit.select("id", "u"), "id")
    sums = rows.groupBy("agent_id").agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("u"))).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x * x)
    mean = (square - F.col("n")) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))
    return sums.select("agent_id", F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - mean)).alias("diversity"))


def structural(agents: DataFrame, visits: DataFrame, papers: DataFrame, vectors: DataFrame, edges: DataFrame, size: int = 30) -> DataFrame:
    """agent_id, coverage, diversity, depth, coherence and r, their mean; an agent without visits has zeros. visits: agent_id,
    node, ordinal; they are written once, since each part reads them."""
    visits = stored(visits.select("agent_id", "node", "ordinal"), "visits")
    read = visits.select("agent_id", F.col("node").alias("id"))
    counts = visits.groupBy("agent_id").agg(F.least(F.lit(1.0), F.count("*") / size).alias("coverage"))
    depth = read.join(papers.select("id", "citation_count"), "id").groupBy("agent_id").agg(maths.sigmoid(F.log1p(F.avg("citation_count")) / 5).alias("depth"))
    rows = agents.select("agent_id").join(counts, "agent_id", "left")
    for part in (diversity(read, vectors), depth, coherence(visits, edges)):
        rows = rows.join(part, "agent_id", "left")
    usual = {"coverage": 0.0, "diversity": 1.0, "depth": 0.5, "coherence": 0.0}
    value = {n: F.when(F.col("coverage").isNull(), 0.0).otherwise(F.coalesce(n, F.lit(x))) for n, x in usual.items()}
    out = rows.select("agent_id", *[x.alias(n) for n, x in value.items()])
    return out.withColumn("r", (F.col("coverage") + F.col("diversity") + F.col("depth") + F.col("coherence")) / 4)


def search_papers(papers: DataFrame, query: list[str], most: int) -> DataFrame:
    """id, overlap: papers that share title words with the query, most words first, then citations, then id."""
    word = F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word")
    hits = papers.where("title is not null").select("id", "citation_count", word).where(F.col("word").isin(query))
    return hits.groupBy("id", "citation_count").agg(F.count("*").alias("overlap")).orderBy(F.desc("overlap"), F.desc("citation_count"), "id").limit(most)
