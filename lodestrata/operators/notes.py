"""Notes on visited papers and overviews of agents, as rows and as files.

A note names all of a paper's links. The links of a hub may be a large share of all edges, so links are dealt to tasks by ranges of one
order, and each task joins up what stands side by side; only what a task's ends or a hub's pieces leave open is put together afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.tables import stored

SPAN = 4096  #: lines that are joined at a time
ROWS = 1 << 14  #: rows that a task takes up at a time


def _gathered(batches):
    """Tables of ROWS rows and more, of batches in order."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += len(b)
        if n >= ROWS:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for k in keys:
        a, b = table[k].slice(0, len(table) - 1), table[k].slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy().astype(bool)
    return np.flatnonzero(new)


def _pieces(tables, keys: list[str], span: int, at: int):
    """Tables of keys, part (its number), whole (whether it holds all rows of its keys), text and n, of tables in order of their keys. A
    piece has as many rows as `span` at most; the first and last of a task may go on in another."""
    held, first, broken = None, True, False
    for table in (*tables, None):
        if table is not None:
            held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if held is None or not len(held):
            continue
        starts = _starts(held, keys)
        ends = np.r_[starts[1:], len(held)]
        done = len(starts) if table is None else len(starts) - 1  # the last keys may have more rows
        cuts, sizes = starts[:done], (ends - starts)[:done]
        kept = len(held) if table is None else starts[-1]
        if table is not None and len(held) - kept >= span:
            cuts, sizes = np.r_[cuts, kept], np.r_[sizes, (len(held) - kept) // span * span]
            kept += sizes[-1]
        of = np.repeat(np.arange(len(cuts)), -(-sizes // span))
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        begin = cuts[of] + turn * span
        n = np.minimum(span, cuts[of] + sizes[of] - begin)
        whole = (sizes <= span)[of]
        if len(whole):
            open_end = table is None or done < len(cuts)
            whole &= ~((of == 0) & (first or broken)) & ~((of == len(cuts) - 1) & open_end)
            offsets = pa.array(np.r_[begin, begin[-1] + n[-1]], pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, held["__line"].combine_chunks()), "\n")
            yield pa.table({**{k: held[k].take(pa.array(begin)) for k in keys}, "__part": pa.array(at + np.arange(len(n))), "__whole": pa.array(whole), "__text": text, "__n": pa.array(n.astype(np.int64))})
            first, broken, at = False, done < len(cuts), at + len(n)
        held = held.slice(kept)


def lines(rows: DataFrame, keys: list[str], order: list[str], line: Column, out: str, span: int = SPAN) -> DataFrame:
    """keys, `out` (a line, never null, for each row of a key, in order, between line ends) and its number; rows that are equal in keys and order
    have to be one already."""
    ship(rows.sparkSession)
    rows = stored(rows.select(*keys, *order, line.alias("__line")), "lines")
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "__line")

    def joined(batches):
        at = TaskContext.get().partitionId() << 32
        for table in _pieces(_gathered(batches), keys, span, at):
            yield from table.combine_chunks().to_batches()

    kinds = rows.select(*keys, F.lit(1).cast("long").alias("__part"), F.lit(True).alias("__whole"), "__line", F.lit(1).cast("long").alias("__n")).withColumnRenamed("__line", "__text").schema
    parts = stored(placed.mapInArrow(joined, kinds), "line-parts")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "__text"))), lambda x: x["__text"]), "\n")
    open_ = parts.where("not __whole").groupBy(*keys).agg(text.alias(out), F.sum("__n").alias(f"n_{out}"))
    return parts.where("__whole").select(*keys, F.col("__text").alias(out), F.col("__n").alias(f"n_{out}")).unionByName(open_)


def note_name(c: Column) -> Column:
    """The name of a paper's note: its id with : / and \\ as _."""
    return F.translate(c, ":/\\", "___")


def _link(c: str) -> Column:
    return F.concat(F.lit("- [["), note_name(F.col(c)), F.lit("]]"))


def render_notes(visits: DataFrame, papers: DataFrame, edges: DataFrame, span: int = SPAN) -> DataFrame:
    """agent_id, path, content of each visited paper (agent_id, id): title, year and provider of papers (id, title, year, provider), and all its
    links (edges src, dst): what it refers to, what cites it, and which papers that the agent visited refer to it."""
    seen = stored(visits.select("agent_id", "id").distinct(), "note-visits")
    own = stored(seen.select("id").distinct(), "note-papers")
    plain = stored(edges.where("src <> dst").select("src", "dst").distinct(), "note-edges")
    out = lines(plain.join(own.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi"), ["src"], ["dst"], _link("dst"), "refers", span).withColumnRenamed("src", "id")
    into = lines(plain.join(own.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi"), ["dst"], ["src"], _link("src"), "cited", span).withColumnRenamed("dst", "id")
    walked = seen.withColumnRenamed("id", "src").join(plain.hint("merge"), "src").join(seen.withColumnRenamed("id", "dst").hint("merge"), ["agent_id", "dst"], "left_semi")
    near = lines(walked, ["agent_id", "dst"], ["src"], _link("src"), "nearby", span).withColumnRenamed("dst", "id")
    rows = seen.join(near.hint("merge"), ["agent_id", "id"], "left")  # first, while rows are short
    rows = rows.join(papers.select("id", "title", "year", "provider").hint("merge"), "id", "left").join(out.hint("merge"), "id", "left").join(into.hint("merge"), "id", "left")
    title, none = F.coalesce("title", "id"), F.lit("(none discovered)")
    body = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit('title: "'), title, F.lit('"')), F.concat(F.lit("year: "), F.coalesce(F.col("year").cast("string"), F.lit("null"))), F.concat(F.lit("provider: "), F.coalesce("provider", F.lit("unknown"))), F.lit("---"),
        F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.lit("## References (outgoing)"), F.coalesce("refers", none), F.lit(""), F.lit("## Cited by (incoming)"), F.coalesce("cited", none), F.lit(""), F.lit("## Referenced by (in agent's graph)"), F.coalesce("nearby", F.lit("(none)")), F.lit(""),
    )
    return rows.select("agent_id", F.concat(note_name(F.col("id")), F.lit(".md")).alias("path"), body.alias("content"))


def render_overviews(agents: DataFrame, visits: DataFrame, papers: DataFrame, edges: DataFrame, span: int = SPAN) -> DataFrame:
    """agent_id, path, content: an overview of each agent (agent_id, caste, quality): how many papers and edges it knows, its path (visits
    agent_id, id, ordinal) in order, and the notes of all papers."""
    visits = stored(visits.select("agent_id", "id", "ordinal"), "overview-visits")
    first = visits.groupBy("agent_id", "id").agg(F.min("ordinal").alias("ordinal")).join(papers.select("id", "title").hint("merge"), "id", "left")
    path = lines(first, ["agent_id"], ["ordinal", "id"], F.concat(_link("id"), F.lit(" — "), F.coalesce("title", "id")), "path_lines", span)
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    known = visits.select("agent_id", F.col("id").alias("src")).distinct().join(degree.hint("merge"), "src").groupBy("agent_id").agg(F.sum("degree").alias("edges"))
    rows = agents.join(path.hint("merge"), "agent_id", "left").join(known.hint("merge"), "agent_id", "left")
    said = lambda name, value: F.concat(F.lit(f"- **{name}:** "), value)
    count = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("string")
    body = F.concat_ws(
        "\n", F.lit("---"), F.lit("type: moc"), F.concat(F.lit("agent: "), F.col("agent_id").cast("string")), F.concat(F.lit("caste: "), F.coalesce("caste", F.lit(""))), F.lit("---"), F.lit(""),
        said("Final Q", F.format_string("%.4f", F.coalesce("quality", F.lit(0.0)))), said("Papers visited", count("n_path_lines")), said("Private graph", F.concat(count("edges"), F.lit(" ref-edges"))), F.lit(""), F.lit("## Exploration Path"), F.coalesce("path_lines", F.lit("(no path)")), F.lit(""),
    )
    return rows.select("agent_id", F.lit("_MOC.md").alias("path"), body.alias("content"))


def write_notes(notes: DataFrame, folder: str) -> None:
    """Each note as one text file in a folder of its agent and path. A note is written by one task, after those before it."""
    notes.repartition("agent_id", "path").write.mode("overwrite").partitionBy("agent_id", "path").option("lineSep", "\n").text(folder)
