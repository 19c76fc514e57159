"""Which hashes occur more than once, and where: one packed shuffle for all of a corpus's postings.

Tasks cut the hash range into buckets and send each bucket one row of packed postings for some hundred
thousand of them, so a posting costs its hash bytes and two or three more. A hash that occurs `local` times or
more among the postings that a task holds is announced to its bucket by one posting; its places travel on
their own, dealt by document. So a bucket gets at most `local` places of a hash from each such lot, however
hot the hash is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import mix

LOT = 1_500_000  #: postings that a task packs together
HOT = 2**31 - 1  #: the count of a hash that was announced
PACKED = "bucket int, kind int, size int, hashes binary, docs binary, places binary"
PLACES = "doc_id long, place long, n int"
_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("size", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int32())])


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, byte planes one after the other: equal high bytes compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(x: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(-1, size)
    out = np.zeros((size, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _rows(lot: dict[str, np.ndarray], buckets: int, local: int, width: int, keep_hash: bool) -> Iterator[pa.RecordBatch]:
    h, more, docs, places, known = lot["hash"], lot.get("more"), lot["doc"], lot["place"], lot["known"]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    group = np.cumsum(new) - 1
    count, heads = np.bincount(group), order[new]
    loud = (count >= local) | (np.bincount(group, known[order]) > 0)
    quiet = np.zeros(len(h), bool)
    quiet[order] = ~loud[group]
    parts = [(np.flatnonzero(quiet), 0), (heads[loud], 1)]
    out: list[tuple] = []
    for at, kind in parts:
        bucket = ((h[at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        at = at[by := np.argsort(bucket, kind="stable")]
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            i = at[cuts[b] : cuts[b + 1]]
            out.append((b, kind, len(i), _pack(h[i], width) + (_pack(more[i], 4) if more is not None else b""), _pack(docs[i], 8) if kind == 0 else b"", _pack(places[i], 4) if kind == 0 and not keep_hash else b""))
    at = np.flatnonzero(~quiet)
    bucket = (mix(docs[at].astype(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
    at = at[by := np.argsort(bucket, kind="stable")]
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    value = h & np.uint64(2 ** (8 * width) - 1) if keep_hash else places
    for b in np.flatnonzero(np.diff(cuts)):
        i = at[cuts[b] : cuts[b + 1]]
        out.append((b, 2, len(i), b"", _pack(docs[i], 8), _pack(value[i], 8)))
    for k in range(0, len(out), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[k : k + 2000], strict=True), _ROWS, strict=True)], schema=_ROWS)


def _gather(lots: Iterator[dict[str, np.ndarray]], buckets: int, local: int, width: int, keep_hash: bool) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    for lot in lots:
        held.append(lot)
        if sum(len(x["hash"]) for x in held) >= LOT:
            yield from _rows({k: np.concatenate([x[k] for x in held]) for k in held[0]}, buckets, local, width, keep_hash)
            held = []
    if held and sum(len(x["hash"]) for x in held):
        yield from _rows({k: np.concatenate([x[k] for x in held]) for k in held[0]}, buckets, local, width, keep_hash)


def _places(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(doc), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + 200_000].view(np.int64)), pa.array(place[k : k + 200_000].view(np.int64)), pa.array(n[k : k + 200_000].astype(np.int32))], schema=_OUT)


def _bucket(rows: list[tuple], width: int, second: bool, keep_hash: bool) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    hashes, mores, docs, places, heads = [], [], [], [], []
    for kind, size, h, d, p in rows:
        hashes.append(_unpack(h[: width * size], size))
        if second:
            mores.append(_unpack(h[width * size :], size))
        docs.append(_unpack(d, size) if kind == 0 else np.zeros(size, np.uint64))
        places.append(_unpack(p, size) if kind == 0 and not keep_hash else np.zeros(size, np.uint64))
        heads.append(np.full(size, kind == 1))
    h, doc, place, head = (np.concatenate(x) for x in (hashes, docs, places, heads))
    more = np.concatenate(mores) if second else None
    order = np.lexsort((more, h)) if second else np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if second:
        new[1:] |= more[order][1:] != more[order][:-1]
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    count[np.bincount(group, head[order]) > 0] = HOT
    n = count[group]
    at = (n > 1) & ~head[order]
    i = order[at]
    yield from _places(doc[i], h[i] if keep_hash else place[i], n[at])


def repeated(texts: DataFrame, postings: Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]], buckets: int, *, local: int = 2, width: int = 6, second: bool = False, keep_hash: bool = False) -> DataFrame:
    """(doc_id, place, n) of every posting whose hash occurs n > 1 times; n is HOT where it was announced.

    postings gives, for a batch of texts, arrays hash (uint64), doc, place and known (repeated for certain), and
    with second also more (of which 32 bits count). place is the hash's low bytes with keep_hash.
    """

    def send(batches):
        yield from _gather((lot for b in batches for lot in postings(b)), buckets, local, width, keep_hash)

    def count(batches):
        at, rows = None, []
        for b in batches:
            for bucket, kind, size, h, d, p in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if bucket != at:
                    yield from _bucket(rows, width, second, keep_hash)
                    at, rows = bucket, []
                if kind == 2:
                    doc = _unpack(d, size)
                    yield from _places(doc, _unpack(p, size), np.full(size, HOT))
                else:
                    rows.append((kind, size, h, d, p))
        yield from _bucket(rows, width, second, keep_hash)

    packed = texts.mapInArrow(send, PACKED)
    return packed.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(count, PLACES)
