"""Removal of passages that occur more than once, by difference-cover anchors.

Two places that share WINDOW words share, at some common offset, an anchor: a window of ANCHOR words that
starts at a position whose remainder modulo PERIOD is in COVER. For COVER has every difference modulo PERIOD,
so for any two places an offset under PERIOD brings both into COVER, and ANCHOR + PERIOD - 1 = WINDOW. Only
anchors are hashed and shuffled (5 of 21 positions). An anchor that repeats is extended to the windows around
it, and windows with the same 96 bits of hash (and bucket) as another are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.postings import repeated
from lodestrata.llm.text import chunks, has_repeated_ids, numbered, pieces, texts_of, window_hashes
from lodestrata.tables import stored

WINDOW, PERIOD, COVER = 35, 21, (3, 6, 7, 12, 14)
BUCKET_WORDS = 100_000  #: words of the corpus for each bucket


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def bucket_count(words: int) -> int:
    return max(1024, -(-words // BUCKET_WORDS))


def _whole(batches):
    for b in batches:
        for rows, data, bounds in pieces(b, "text"):
            texts = [data[s:e].tobytes().split() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]  # at the six bytes that no word has
            digests = [hashlib.sha256(b" ".join(words)).hexdigest() for words in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(words) for words in texts], pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "sha256"])


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    at = np.isin(np.arange(period), cover)

    def postings(batch):
        for c in chunks(batch, "text"):
            h = window_hashes(c.word_hashes(), window - period + 1)
            i = np.flatnonzero(c.full(window - period + 1) & at[c.within() % period] & np.repeat(c.n_words >= window, c.n_words))
            docs = c.rows.column("doc_id").to_numpy(zero_copy_only=False)
            yield {"hash": h[i], "doc": np.repeat(docs, c.n_words)[i], "place": c.within()[i], "known": np.zeros(len(i), bool)}

    return postings


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _spread(c, places: pa.Array, before: int, after: int) -> np.ndarray:
    """True for a chunk's words from `before` ahead of a place to `after` behind it, both included."""
    values, sizes = _lists(places)
    first = np.repeat(c.first[:-1], sizes)
    change = np.zeros(len(c.starts) + 1, np.int64)
    at = first + values
    np.add.at(change, np.maximum(at - before, first), 1)
    np.add.at(change, np.minimum(at + after + 1, len(c.starts)), -1)
    return np.cumsum(change[:-1]) > 0


def _windows(window: int, period: int):
    def postings(batch):
        for c in chunks(batch, "text"):
            h = c.word_hashes()
            i = np.flatnonzero(_spread(c, c.rows.column("places"), period - 1, 0) & c.full(window))
            docs = c.rows.column("doc_id").to_numpy(zero_copy_only=False)
            copies = c.rows.column("copies").to_numpy(zero_copy_only=False)
            yield {"hash": window_hashes(h, window)[i], "more": window_hashes(h, window, second=True)[i], "doc": np.repeat(docs, c.n_words)[i], "place": c.within()[i], "known": np.repeat(copies > 1, c.n_words)[i]}

    return postings


def _removal(window: int):
    def cut(batches):
        for b in batches:
            for c in chunks(b, "text"):
                gone = _spread(c, c.rows.column("places"), 0, window - 1)
                data, texts, removed = c.data.tobytes(), [], []
                for k in range(len(c)):
                    i, j = c.first[k], c.first[k + 1]
                    kept = np.flatnonzero(~gone[i:j]) + i
                    removed.append(j - i - len(kept))
                    texts.append(b" ".join([data[s:e] for s, e in zip(c.starts[kept].tolist(), c.ends[kept].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([c.rows.column("doc_id"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_removed", "kept"])

    return cut


def remove_repeated_passages(documents: DataFrame, *, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and kept_text where words were removed (else null:
    all words of the text stay).

    A word goes if a window of `window` words that covers it has a word sequence that starts anywhere else too, in
    the same text or another; windows are judged on the input. Sameness is that of 96 bits of hash and more. Null and empty texts have no words; texts under
    `window` words lose none; a row that repeats another, doc_id and all, is a copy of it like any other, and both
    give a row; rows without doc_id are left out; other columns are ignored; an empty table gives no rows.
    """
    if not is_cover(period, cover) or window < period:
        raise ValueError("cover must have every difference modulo period, and window be period at least")
    texts = texts_of(documents)
    if not has_repeated_ids(texts):
        return _removed(texts, window, period, cover)
    rows = numbered(texts, "op1-rows")
    out = _removed(rows.select(F.col("row").alias("doc_id"), "text"), window, period, cover).withColumnRenamed("doc_id", "row")
    return out.join(rows.select("row", "doc_id").hint("merge"), "row").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def _removed(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """remove_repeated_passages of rows with different doc_ids."""
    whole = stored(texts.mapInArrow(_whole, "doc_id long, n_words long, sha256 string"), "op1-whole")
    buckets = bucket_count(whole.agg(F.sum("n_words")).first()[0] or 0)
    # Copies of one word sequence lose all their words; the first stands for them from here on.
    same = stored(whole.where(F.col("n_words") >= window).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "op1-same").select("doc_id", "copies")
    hits = repeated(texts, _anchors(window, period, cover), buckets).groupBy("doc_id").agg(F.collect_list(F.col("place").cast("int")).alias("places"))
    held = stored(texts.join(stored(hits.hint("merge").join(same, "doc_id"), "op1-hits").hint("merge"), "doc_id"), "op1-held")
    found = repeated(held, _windows(window, period), buckets, width=8, second=True).groupBy("doc_id").agg(F.collect_list(F.col("place").cast("int")).alias("places"))
    cut = stored(held.select("doc_id", "text").join(found.hint("merge"), "doc_id").mapInArrow(_removal(window), "doc_id long, n_removed long, kept string").dropDuplicates(["doc_id"]), "op1-cut")
    copies = whole.where(F.col("n_words") >= window).join(stored(whole.where(F.col("n_words") >= window).groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1"), "op1-copies").hint("merge"), "sha256").select("doc_id", F.lit(True).alias("copied")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return (
        whole.join(stored(copies, "op1-copied").hint("merge"), "doc_id", "left")
        .join(cut.hint("merge"), "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copied"), F.lit(empty)).otherwise(F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), "sha256")).alias("kept_sha256"),
            F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
        )
    )


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
