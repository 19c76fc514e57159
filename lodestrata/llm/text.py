"""Vectorised helpers for whole texts inside Arrow tasks.

A chunk is a run of rows whose texts are handled together: their UTF-8 bytes lie in one array, words are
byte ranges in it, and every hash is a prefix sum, so the cost is a few passes over the bytes whatever the
number of words. A word is a run of ``[^\\x20\\x09-\\x0D]``. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.tables import stored

CHUNK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BYTE_BASE, _WORD_BASE, _WORD_BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, _U), np.ones(1, _U)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.tables[0]):
            size = 1 << (n - 1).bit_length()
            for k, base in enumerate(self.bases):
                x = np.full(size, base, _U)
                x[0] = 1
                self.tables[k] = np.multiply.accumulate(x)
        return self.tables[0][:n], self.tables[1][:n]


_BYTES, _WORDS, _WORDS_2 = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_WORD_BASE_2)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Chunk:
    rows: pa.RecordBatch
    data: np.ndarray  #: the texts' bytes, one after the other
    bounds: np.ndarray  #: where each text starts in data, and the end
    starts: np.ndarray  #: of words, in data
    ends: np.ndarray
    first: np.ndarray  #: each text's first word, and the number of words

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def within(self) -> np.ndarray:
        """Each word's number within its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.n_words)

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.data if data is None else data
        up, down = _BYTES.get(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))

    def full(self, k: int) -> np.ndarray:
        """True for words at which a window of k words starts that ends in the same text."""
        return np.arange(len(self.starts)) + k <= np.repeat(self.first[1:], self.n_words)


def window_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of the k words from each word on; those that run over the end are of fewer words and not to be used."""
    up, down = (_WORDS_2 if second else _WORDS).get(len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum((mix(words, 7) if second else words) * up[:-1], out=total[1:])
    at = np.arange(len(words))
    return mix((total[np.minimum(at + k, len(words))] - total[at]) * down[:-1], 3 if second else 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8), offsets


def pieces(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) of runs of rows whose texts have about `most` bytes; a longer text comes alone."""
    if not len(batch):
        return
    data, offsets = text_bytes(batch.column(name))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = SEPARATOR[data]
    word = ~gap
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(word & edge[:-1])
    edge[1:-1] = gap[1:]
    edge[bounds] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def chunks(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    for rows, data, bounds in pieces(batch, name, most):
        yield Chunk(rows, data, bounds, *words_of(data, bounds))


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id as long and text alone; a row without doc_id can't be named in a result and is left out."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def has_repeated_ids(texts: DataFrame) -> bool:
    """Whether two rows have one doc_id; reads that column alone."""
    return not texts.groupBy("doc_id").count().where("count > 1").isEmpty()


def numbered(texts: DataFrame, name: str) -> DataFrame:
    """texts, written with a number of its own for each row: for tables in which a doc_id has several texts."""
    return stored(texts.withColumn("row", F.monotonically_increasing_id()), name)
