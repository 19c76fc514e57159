"""From papers' bibliographies to edges: segmentation, verification, resolution, provisional nodes and accounts, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as ids
from lodestrata.functions import texts
from lodestrata.operators import resolution
from lodestrata.tables import stored

LEAST_PARSE = 0.3  #: fixed value: entries parsed with less confidence stay provisional


def raw_entries(papers: DataFrame) -> DataFrame:
    """paper_id, ordinal, raw, entry_id of papers (paper_id, text)."""
    rows = papers.select("paper_id", F.posexplode(resolution.segment_bibliography(F.col("text"))).alias("k", "raw"))
    ordinal = F.col("k") + 1
    return rows.select("paper_id", ordinal.alias("ordinal"), "raw", F.concat_ws(":", F.col("paper_id").cast("string"), ordinal.cast("string")).alias("entry_id"))


def build_reference_graph(papers: DataFrame, mapped: DataFrame, catalog: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Tables entries, edges, provisional, attempts and accounts of papers (paper_id, text) and the fields that a model read from their
    entries (entry_id, title, authors, year, doi, arxiv_id, pmid, confidence).

    Fields that an entry's text doesn't show are dropped. An entry that resolves gives an edge to its canonical paper; one that
    doesn't, or was parsed with little confidence, an edge to a provisional node of its own. accounts: paper_id, entries,
    mapped, resolved, provisional, lacking."""
    raw = stored(raw_entries(papers), "bib-raw")
    rows = raw.join(mapped, "entry_id", "left")
    checked = stored(resolution.verify_mapped(rows.select("entry_id", "raw", "title", "doi", "arxiv_id", "pmid", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))), "bib-checked")
    entries = stored(
        raw.join(checked.withColumnsRenamed({"status": "mapping_status", "confidence": "parse_confidence", "arxiv_id": "arxiv"}), "entry_id").join(mapped.select("entry_id", "title", "authors", "year"), "entry_id", "left"), "bib-entries"
    )
    sure = (F.col("parse_confidence") >= LEAST_PARSE) & (F.col("mapping_status") == "mapped")
    asked = entries.where(sure).select("entry_id", "title", "doi", "arxiv", "pmid", "authors", F.col("year").cast("int").alias("year"), ids.alias_keys(F.col("doi"), F.col("arxiv"), F.col("pmid")).alias("keys"))
    results, evidence, attempts = resolution.resolve_entries(asked, catalog, aliases)
    met = stored(entries.join(results.select("entry_id", "status", "id", "method", "reason"), "entry_id", "left"), "bib-results")
    good = F.col("status") == "resolved"
    node = texts.provisional_id(texts.sha256_text(F.col("paper_id").cast("string")), texts.raw_entry_hash(F.col("raw")))
    reason = F.when(F.col("mapping_status") == "unparsed", "unparsed").when(F.col("parse_confidence") < LEAST_PARSE, "low_parse_confidence").otherwise(F.coalesce("reason", F.lit("ambiguous")))
    provisional = met.where(~F.coalesce(good, F.lit(False))).select("paper_id", "entry_id", node.alias("id"), reason.alias("reason"))
    real = met.where(good).select(F.col("paper_id").cast("string").alias("src"), F.col("id").alias("dst"), "method", F.lit(False).alias("provisional"))
    edges = real.unionByName(provisional.select(F.col("paper_id").cast("string").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("string").alias("method"), F.lit(True).alias("provisional")))
    edges = edges.groupBy("src", "dst").agg(F.min("method").alias("method"), F.min("provisional").alias("provisional"))
    ok = F.coalesce(good, F.lit(False))
    counts = met.groupBy("paper_id").agg(F.count("*").alias("entries"), F.count_if(F.col("mapping_status") == "mapped").alias("mapped"), F.count_if(ok).alias("resolved"), F.count_if(~ok).alias("provisional"))
    accounts = papers.select("paper_id").join(counts, "paper_id", "left").select("paper_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("entries", "mapped", "resolved", "provisional")], F.col("entries").isNull().alias("lacking"))
    return {"entries": met, "edges": edges, "provisional": provisional, "attempts": attempts, "evidence": evidence, "accounts": accounts}
