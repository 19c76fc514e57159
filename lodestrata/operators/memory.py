"""Research memory: dossiers made of papers and model analyses, relations, gaps, the index of evidence, and answers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrata.functions import texts
from lodestrata.operators.notes import _starts
from lodestrata.operators.ranges import SPAN, filled, lagged
from lodestrata.operators.ranks import ranked
from lodestrata.shipping import ship
from lodestrata.tables import stored

PLACES = ("supported", "disputed", "plausible", "unknown")  #: of what is said in an answer
MOST_RANGES = 10_000  #: that places of questions are dealt to
RELATIONS = ("support", "contradiction", "extension", "comparison", "replication", "background")  #: fixed values; others count as extension


def build_dossiers(papers: DataFrame, analyses: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """paper_id, title, content_kind, contribution, concepts, limitations, credited, status of papers (paper_id, title, abstract,
    fulltext) with their analysis (paper_id, analysis: JSON text).

    Fields of an analysis may be a text or a list under one of several names. Without a readable one the status is failed. A
    failed dossier never replaces one of current that is credited.
    """
    a = F.try_parse_json(F.col("analysis"))
    rows = papers.join(analyses.select("paper_id", "analysis"), "paper_id", "left")
    kind = texts.content_kind(F.col("fulltext"), F.col("abstract"))
    text = lambda *names: texts.as_text(texts.pick(a, *names))
    items = lambda *names: texts.as_list(texts.pick(a, *names))
    fresh = rows.select(
        "paper_id",
        "title",
        kind.alias("content_kind"),
        text("contribution", "main_contribution", "summary").alias("contribution"),
        items("concepts", "key_concepts").alias("concepts"),
        items("limitations", "limits").alias("limitations"),
        (a.isNotNull() & (kind != "metadata")).alias("credited"),
        F.when(a.isNull(), "failed").otherwise("extracted").alias("status"),
    )
    if current is None:
        return fresh
    held = current.select(F.col("paper_id").alias("__id"), F.struct(*fresh.columns).alias("old"))
    both = fresh.select("paper_id", F.struct(*fresh.columns).alias("new")).join(held, F.col("paper_id") == F.col("__id"), "full")
    keep = F.col("new").isNull() | ((F.col("new.status") == "failed") & F.coalesce(F.col("old.credited"), F.lit(False)))
    return both.select(F.when(keep, F.col("old")).otherwise(F.col("new")).alias("d")).select("d.*")


def relations(analyses: DataFrame) -> DataFrame:
    """id, source, target, kind, rationale of the relations that analyses name, the first of each id; no target, no relation."""
    raw = F.from_json(F.col("analysis"), "relations array<struct<target_paper_id:string,kind:string,rationale:string>>")["relations"]
    rows = analyses.select(F.col("paper_id").cast("string").alias("source"), F.posexplode(raw).alias("k", "r"))
    given = F.lower(F.trim(F.coalesce("r.kind", F.lit(""))))
    rows = rows.select("source", "k", F.trim("r.target_paper_id").alias("target"), F.when(given.isin(*RELATIONS), given).otherwise("extension").alias("kind"), F.coalesce("r.rationale", F.lit("")).alias("rationale")).where("target <> ''")
    rows = rows.withColumn("id", texts.stable_id("rel", F.col("source"), F.col("target"), F.col("kind")))
    return rows.groupBy("id", "source", "target", "kind").agg(F.min_by("rationale", "k").alias("rationale"))


def gaps(analyses: DataFrame, claims: DataFrame) -> DataFrame:
    """id, text of what analyses say is unknown and of claims whose status is; each id once."""
    said = F.from_json(F.col("analysis"), "knowledge_gaps array<string>")["knowledge_gaps"]
    a = analyses.select(F.col("paper_id").cast("string").alias("p"), F.explode(said).alias("t")).select("p", F.trim("t").alias("text")).where("text <> ''")
    own = a.select(texts.stable_id("gap", F.col("p"), F.col("text")).alias("id"), "text")
    open_ = claims.where("status = 'unknown'").select(texts.stable_id("gap", F.col("claim_id").cast("string")).alias("id"), "text")
    return own.unionByName(open_).groupBy("id").agg(F.min("text").alias("text"))


def evidence_index(dossiers: DataFrame, claims: DataFrame) -> DataFrame:
    """evidence_id, paper_id, origin: the first reference of each id, dossiers before claims, each in order of their ordinal."""
    rows = dossiers.select("evidence_id", "paper_id", F.lit(0).alias("o"), "ordinal", F.lit("dossier").alias("origin")).unionByName(claims.select("evidence_id", "paper_id", F.lit(1).alias("o"), "ordinal", F.lit("claim").alias("origin")))
    return rows.groupBy("evidence_id").agg(F.min_by(F.struct("paper_id", "origin"), F.struct("o", "ordinal", "paper_id")).alias("r")).select("evidence_id", "r.*")


def answer_lines(relevant: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, place, rank, said of what a memory says: relevant (question_id, claim_id, rank), claims (claim_id, text, status, papers: an
    array), sources (paper_id) that may be cited. place is supported, disputed, plausible, unknown or null for what isn't said. A claim
    without such a source is said without a citation; a proposed one needs one."""
    cited = claims.select("claim_id", F.explode("papers").alias("paper_id")).hint("merge").join(sources.select("paper_id").distinct(), "paper_id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("paper_id")).alias("refs"))
    rows = relevant.join(claims.select("claim_id", "text", "status"), "claim_id").join(cited, "claim_id", "left")
    said = F.when(F.col("refs").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" ["), F.array_join("refs", ", "), F.lit("]")))
    place = F.when(F.col("status").isin("supported", "disputed"), F.col("status")).when((F.col("status") == "proposed") & F.col("refs").isNotNull(), "plausible").when(F.col("status").isin("unknown", "superseded"), "unknown")
    return rows.select("question_id", place.alias("place"), "rank", F.when(F.col("status").isin("unknown", "superseded"), F.col("text")).otherwise(said).alias("said"))


def answer_questions(relevant: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id and arrays supported, disputed, plausible, unknown of `answer_lines`: a question's texts in one row."""
    rows = answer_lines(relevant, claims, sources)

    def listed(name: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("place") == name, F.struct("rank", "said"))))
        return F.transform(held, lambda x: x["said"]).alias(name)

    return rows.groupBy("question_id").agg(*[listed(n) for n in PLACES])


def _digests(tables, keys: list[str]):
    """Tables of keys and the MD5 of their lines between line ends, of tables in order of their keys."""
    now, state = None, None
    for table in tables:
        starts = [*_starts(table, keys).tolist(), len(table)]
        for a, b in zip(starts, starts[1:]):
            key = tuple(table[k][a].as_py() for k in keys)
            text = "\n".join(table["__line"].slice(a, b - a).to_pylist())
            if state is not None and key == now:
                state.update(b"\n")
            else:
                if state is not None:
                    yield pa.table({**dict(zip(keys, [[x] for x in now])), "md5": [state.hexdigest()]})
                now, state = key, hashlib.md5()
            state.update(text.encode())
    if state is not None:
        yield pa.table({**dict(zip(keys, [[x] for x in now])), "md5": [state.hexdigest()]})


def answer_digests(lines: DataFrame) -> DataFrame:
    """question_id and the MD5 of the lines of each place, in order of rank between line ends, of `answer_lines`. An MD5 is one state, so the
    lines of a place of a question pass through one task; they stream, and each place of a question has a task of its own where it is large."""
    ship(lines.sparkSession)
    rows = stored(lines, "answer-lines")
    keys = ["question_id", "place"]
    said = rows.where("place is not null and said is not null")
    n = said.select(*keys).distinct().count()
    placed = said.repartitionByRange(max(1, min(4 * n, MOST_RANGES)), *keys).sortWithinPartitions(*keys, "rank", "said").select(*keys, F.col("said").alias("__line"))
    kinds = rows.select(*keys, F.lit("").alias("md5")).schema

    def digested(batches):
        for table in _digests((pa.Table.from_batches([b]) for b in batches), keys):
            yield from table.cast(pa.schema([pa.field(k, like[k]) for k in keys] + [pa.field("md5", pa.string())])).to_batches()

    like = {f.name: f.type for f in to_arrow_schema(kinds)}
    told = stored(placed.mapInArrow(digested, kinds), "answer-digests")
    each = told.groupBy("question_id").agg(*[F.max(F.when(F.col("place") == x, F.col("md5"))).alias(x) for x in PLACES])
    rows = rows.select("question_id").distinct().join(each.hint("merge"), "question_id", "left")
    return rows.select("question_id", *[F.coalesce(x, F.md5(F.lit("").cast("binary"))).alias(x) for x in PLACES])


def freeze_bundles(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """agent_id, n_claims, n_sources, bundle, state_hash: an agent's claims (agent_id, claim_id, text, status) and sources
    (agent_id, paper_id) as one JSON text in order of their ids, and its hash. A bundle is one agent's memory, and bounded by it."""
    a = claims.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "status", "text"))).alias("claims"))
    b = sources.groupBy("agent_id").agg(F.array_sort(F.collect_set("paper_id")).alias("sources"))
    both = a.join(b, "agent_id", "full")
    both = both.select("agent_id", F.coalesce("claims", F.array().cast(a.schema["claims"].dataType)).alias("claims"), F.coalesce("sources", F.array().cast(b.schema["sources"].dataType)).alias("sources"))
    body = texts.canonical_json({"claims": F.col("claims"), "sources": F.col("sources")})
    return both.select("agent_id", F.size("claims").cast("long").alias("n_claims"), F.size("sources").cast("long").alias("n_sources"), body.alias("bundle"), texts.sha256_text(body).alias("state_hash"))


def hydrate_run(events: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of events, and those of evaluations whose keys no event has."""
    return events.unionByName(evaluations.select(*events.columns).join(events.select(*keys).distinct(), keys, "left_anti"))


def discovery(papers: DataFrame, native: DataFrame, extracted: DataFrame) -> DataFrame:
    """paper_id, origin, found, traversable, failed of papers (paper_id, extraction_error) with the neighbours that their source
    lists (paper_id, neighbor, provider), else those extracted from their text; a provider `unknown` can't be followed."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("paper_id").agg(F.count_distinct("neighbor").alias(f"{name}_n"), F.count_distinct(F.when(F.col("provider") != "unknown", F.col("neighbor"))).alias(f"{name}_t"))

    rows = papers.join(counted(native, "native"), "paper_id", "left").join(counted(extracted, "text"), "paper_id", "left")
    origin = F.when(F.col("native_n") > 0, "native").when(F.col("text_n") > 0, "extracted").otherwise("none")
    pick = lambda x: F.coalesce(F.when(origin == "native", F.col(f"native_{x}")).otherwise(F.col(f"text_{x}")), F.lit(0)).cast("long")
    return rows.select("paper_id", origin.alias("origin"), pick("n").alias("found"), pick("t").alias("traversable"), ((origin == "none") & F.col("extraction_error").isNotNull()).alias("failed"))


def set_embeddings(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """papers (id, provider, embedding, integrated) with new vectors (id, embedding); an id that isn't there becomes a stub of
    provider `unknown`."""
    both = papers.join(vectors.select("id", F.col("embedding").alias("__new")), "id", "full")
    return both.select("id", F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("__new", "embedding").alias("embedding"), F.coalesce("integrated", F.lit(False)).alias("integrated"))


def mark_integrated(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """papers with integrated true for the ids, stubs for those that aren't there."""
    both = papers.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "full")
    return both.select("id", F.coalesce("provider", F.lit("unknown")).alias("provider"), "embedding", (F.coalesce("integrated", F.lit(False)) | F.col("__hit").isNotNull()).alias("integrated"))


def append_research_events(current: DataFrame, incoming: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    """run_id, seq, type, state, prev_state_hash, state_hash of incoming events (run_id, type, state) as the next ones of their runs: an
    event without a state carries the hash on. Numbers and hashes are worked out by ranges, so a run may be any share of all rows;
    `ranges.snapshots` of the result are the rows to restore from."""
    last = current.groupBy("run_id").agg(F.max("seq").alias("last"), F.max_by("state_hash", "seq").alias("head"))
    placed = stored(ranked(incoming, ["run_id", order], "__place"), "research-places")
    first = placed.groupBy("run_id").agg(F.min("__place").alias("__first"))
    own = F.when(F.col("state").isNotNull(), texts.sha256_text(F.col("state")))
    rows = placed.join(first.hint("merge"), "run_id").join(last.hint("merge"), "run_id", "left")
    rows = rows.withColumn("seq", (F.coalesce("last", F.lit(0)) + F.col("__place") - F.col("__first") + 1).cast("long"))
    rows = filled(rows.select("run_id", "seq", "type", "state", "head"), "run_id", own, "state_hash", span=span).withColumn("state_hash", F.coalesce("state_hash", "head"))
    rows = lagged(rows, "run_id", F.struct("state_hash"), "before", span=span)
    return rows.select("run_id", "seq", "type", "state", F.when(F.col("before").isNull(), F.col("head")).otherwise(F.col("before.state_hash")).alias("prev_state_hash"), "state_hash")


def research_chain(events: DataFrame, span: int = SPAN) -> DataFrame:
    """run_id, events, broken: how many events don't link to the hash of the one before."""
    rows = lagged(events.select("run_id", "seq", "prev_state_hash", "state_hash"), "run_id", F.col("state_hash"), "before", span=span)
    return rows.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(~F.col("prev_state_hash").eqNullSafe(F.col("before"))).alias("broken"))


def fold_claim_statuses(mutations: DataFrame) -> DataFrame:
    """claim_id, status, steps after mutations (claim_id, seq, action, backed) in order of seq: propose opens a claim, support and
    dispute need evidence (without it the claim is proposed), reject and supersede end it, open and answer say unknown and
    proposed. A claim's mutations are a list of its own, folded as a column expression."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "action", "backed")))

    def step(state: Column, m: Column) -> Column:
        a = m["action"]
        return (
            F.when(state == "superseded", state)
            .when(a == "propose", F.when(state == "", "proposed").otherwise(state))
            .when(a == "support", F.when(m["backed"], "supported").otherwise("proposed"))
            .when(a == "dispute", F.when(m["backed"], "disputed").otherwise("proposed"))
            .when(a.isin("reject", "supersede"), "superseded")
            .when(a == "open", "unknown")
            .when((a == "answer") & (state == "unknown"), "proposed")
            .otherwise(state)
        )

    return mutations.groupBy("claim_id").agg(steps.alias("s")).select("claim_id", F.aggregate("s", F.lit(""), step).alias("status"), F.size("s").cast("long").alias("steps"))
