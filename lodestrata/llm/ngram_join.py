"""Jaccard self-join of word n-gram sets, by vertical partitioning.

N-grams have a global order: rarest first, then by hash. It is cut into fragments by the power of two under the
number of documents with the n-gram. A document's n-grams in one fragment are a segment; two segments' overlap
is counted by itself, and a pair's overlap is the sum over fragments. N-grams of one document only can't overlap
and take part as a count alone, which leaves few documents with shared n-grams enough.

Equal sets are one class, of which the smallest doc_id stands for all. Pairs come from n-grams in both
documents' prefixes (as long as a pair at the threshold must share one), if sizes and the place in the order
leave room for the threshold. Not all pairs of an n-gram are made: in each of a few rounds the first document of
an n-gram's list is compared with one document of each other component there; what is left after those rounds
is compared in full where components still differ, smaller sets by fewer of their n-grams, which loses no link between
components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import components
from lodestrata.llm.postings import repeated
from lodestrata.llm.text import LOWER, Chunk, chunks, has_repeated_ids, mix, numbered, texts_of, window_hashes
from lodestrata.tables import drop, stored

SIZE, PERCENT, ROUNDS = 4, 85, 2
BUCKET_WORDS = 100_000
LOCAL = 256  #: an n-gram in so many documents of one task's lot counts as frequent everywhere


def sets(c: Chunk, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each text's distinct n-grams, by text, then hash; lower-cased in ASCII."""
    h = c.word_hashes(LOWER[c.data])
    at = np.flatnonzero(c.full(size))
    docs = [c.doc_of_word()[at]]
    grams = [window_hashes(h, size)[at]]
    for k in range(1, size):
        few = np.flatnonzero(c.n_words == k)
        docs.append(few)
        grams.append(mix(window_hashes(h, k)[c.first[few]], k))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


def _summary(size: int):
    def summary(batches):
        for b in batches:
            for c in chunks(b, "text"):
                doc, gram = sets(c, size)
                cuts = np.searchsorted(doc, np.arange(len(c) + 1))
                digests = [hashlib.blake2b(gram[i:j].tobytes(), digest_size=16).hexdigest() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([c.rows.column("doc_id"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(digests, pa.string())], ["doc_id", "n", "digest"])

    return summary


def _postings(size: int):
    def postings(batch):
        for c in chunks(batch, "text"):
            doc, gram = sets(c, size)
            yield {"hash": gram, "doc": c.rows.column("doc_id").to_numpy(zero_copy_only=False)[doc], "place": gram, "known": np.zeros(len(gram), bool)}

    return postings


def _room(percent: int):
    """Whether sizes and the places of a common n-gram leave room for the threshold."""
    most = 1 + F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos"))
    return F.col("doc_id").eqNullSafe(F.col("other")) == F.lit(False), (100 + percent) * most >= percent * (F.col("n") + F.col("other_n"))


def _last_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents that share an n-gram and whose components differ.

    The smaller set of a pair at the threshold has a common n-gram among fewer of its first ones than the larger: the
    overlap is at least 2 * percent / (100 + percent) of the smaller. That bound and the sizes' level, by steps of
    100 / percent, are part of what is joined: an n-gram late in the order of many sets (a licence line in otherwise
    different texts) makes no pairs.
    """
    level = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    rows = stored(rows.select("gram", "doc_id", "n", "pos", "component", level.alias("level")), "op4-left")
    short = rows.where((100 + percent) * (F.col("n") - F.col("pos") + 1) >= 2 * percent * F.col("n"))
    long = rows.select("gram", F.col("doc_id").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"), F.col("component").alias("other_component"), F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    met = short.hint("merge").join(long, ["gram", "level"])
    return met.where("component <> other_component and (n < other_n or n = other_n and doc_id < other)")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those at the threshold: overlaps by fragment, then their sum."""
    pairs = stored(pairs, "op4-pairs")
    first = pairs.join(segments.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a")).hint("merge"), "a")
    part = first.join(segments.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b")).hint("merge"), ["b", "fragment"])
    part = part.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    whole = part.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    links = stored(whole.where((100 + percent) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "op4-links")
    drop(pairs)
    return links


def similar_sets(documents: DataFrame, *, size: int = SIZE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    A document's set holds its distinct n-grams of `size` words (runs of [^\\x20\\x09-\\x0D], ASCII lower-cased);
    with fewer words, the whole sequence. Documents link when 100 * intersection >= percent * union, and
    component_id is the least doc_id that links reach; class_id is the least doc_id with an equal set. Null and
    empty texts have no set, no links and are their own component; repeated rows give a row each; rows without
    doc_id are left out; other columns are ignored; an empty table gives no rows.
    """
    texts = texts_of(documents)
    if not has_repeated_ids(texts):
        return _similar(texts, size, percent, rounds)
    rows = numbered(texts, "op4-rows")
    own = stored(_similar(rows.select(F.col("row").alias("doc_id"), "text"), size, percent, rounds).withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id").hint("merge"), "row"), "op4-own")
    for name in ("class_id", "component_id"):
        least = stored(own.groupBy(name).agg(F.min("doc_id").alias("least")), f"op4-{name}")
        own = own.join(least.hint("merge"), name).drop(name).withColumnRenamed("least", name)
    return own.select("doc_id", "n_shingles", "class_id", "component_id")


def _similar(texts: DataFrame, size: int, percent: int, rounds: int) -> DataFrame:
    """similar_sets of rows with different doc_ids."""
    summary = stored(texts.mapInArrow(_summary(size), "doc_id long, n long, digest string"), "op4-sets")
    classes = stored(summary.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("class_id")), "op4-classes")
    buckets = max(1024, -(-(summary.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    shared = repeated(texts, _postings(size), buckets, local=LOCAL, keep_hash=True).select("doc_id", F.struct(F.col("n").alias("df"), F.col("place").alias("gram")).alias("e"))
    vertical = (
        shared.join(classes.select(F.col("class_id").alias("doc_id"), F.col("n")).hint("merge"), "doc_id")
        .groupBy("doc_id", "n")
        .agg(F.array_sort(F.collect_set("e")).alias("e"))
        .where(100 * F.size("e") >= percent * F.col("n"))
    )
    vertical = stored(vertical, "op4-vertical")
    level = "cast(floor(log2(x.df)) as int)"
    segments = vertical.select("doc_id", "n", F.explode(F.expr(f"transform(array_distinct(transform(e, x -> {level})), f -> struct(f as fragment, transform(filter(e, x -> {level} = f), x -> x.gram) as grams))")).alias("s")).select("doc_id", "n", "s.fragment", "s.grams")
    alone = F.col("n") - F.size("e")  # they come first in the order
    longest = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    prefix = vertical.select("doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("e", F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int"))).alias("at", "x")).select(F.col("x.gram").alias("gram"), "doc_id", "n", (F.col("alone") + F.col("at") + 1).alias("pos"))
    prefix = stored(prefix, "op4-prefix")
    differ, room = _room(percent)
    links = None
    for k in range(rounds + 1):
        labelled = None
        if links is None:
            rows = prefix.withColumn("component", F.col("doc_id"))
        else:
            rows = labelled = stored(prefix.join(stored(components(links), "op4-labels").withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "op4-labelled")
        lists = stored(rows.groupBy("gram").agg(F.min(F.struct("pos", "doc_id", "n", "component")).alias("h"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram", "h"), "op4-lists")
        rows = rows.join(lists.hint("merge"), "gram")
        if k < rounds:
            best = rows.where("component <> h.component").groupBy("gram", "component").agg(F.min(F.struct("pos", "doc_id", "n")).alias("m"), F.min("h").alias("h"))
            pairs = best.select("m.*", F.col("h.doc_id").alias("other"), F.col("h.n").alias("other_n"), F.col("h.pos").alias("other_pos"))
        else:
            pairs = _last_pairs(rows, percent)
        pairs = pairs.where(differ & room).select(F.greatest("doc_id", "other").alias("a"), F.least("doc_id", "other").alias("b")).distinct()
        found = _linked(pairs, segments, percent)
        drop(lists, labelled) if labelled else drop(lists)
        links = found if links is None else links.unionByName(found)
    label = stored(components(links), "op4-components").withColumnRenamed("node", "class_id").withColumnRenamed("component", "component_id")
    return (
        summary.join(classes.hint("merge"), ["n", "digest"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
        .join(label.hint("merge"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    )


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")
