"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a piece of labelled text. A text is parsed greedily: a phrase
is the longest run of bytes that the language's text holds, of one byte at least. A language that knows the text needs few,
long phrases; phrases * log2(bytes learned) / bytes is an estimate of the cross entropy, and the least wins.

Texts are lower-cased; runs of ASCII bytes that are no letters become one space. A phrase ends at the latest with a block
of BLOCK bytes, so that blocks are parsed side by side, all of a task's blocks and languages one byte further at each step.
"""

from __future__ import annotations

import hashlib
import zlib
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import pieces, text_bytes
from lodestrata.shipping import ship

LEARNED = 40_000  #: bytes of text learned for each language: the bound of the sample that the classifier is fitted on
MODEL = 1 << 28  #: bytes learned of all languages together; with many languages each has less
PIECE = 400  #: the sample consists of pieces of so many bytes
BLOCK = 1024
LOT = 24  #: languages whose automata are in a worker's memory at a time, some 20 MB each
CHUNK = 2 << 20

_SPACE, _SEPARATOR = 32, 0x1FF


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[:128] = [c if chr(c).isalpha() else _SPACE for c in range(128)]
    return out


CLASS = _classes()


def normal(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of several texts with runs of ASCII non-letters as one space each, and the texts' new bounds."""
    data = CLASS[data]
    keep = data != _SPACE
    first = np.ones(len(data), bool)
    first[1:] = keep[:-1]
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    keep |= first
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def automaton(text: bytes, parts: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text, state 0 first; parts: where a new piece starts, across which no substring goes."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    starts = set(parts)
    for k, byte in enumerate(text):
        for symbol in (_SEPARATOR, byte) if k in starts else (byte,):
            new = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = new
                p = links[p]
            if p >= 0:
                q = nexts[p][symbol]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    links[q] = links[new] = copy
                    while p >= 0 and nexts[p].get(symbol) == q:
                        nexts[p][symbol] = copy
                        p = links[p]
            last = new
    return nexts


class Parser:
    """Automata of some languages in one table: at state + symbol stands twice the next state, plus 1 where a phrase starts."""

    def __init__(self, texts: list[list[bytes]]):
        joined = [b"".join(t) for t in texts]
        seen = sorted(set().union(*joined)) if joined else []
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no language has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables, self.roots, base = [], [], 0
        for text, parts in zip(joined, texts, strict=True):
            nexts = automaton(text, list(np.cumsum([len(p) for p in parts])[:-1]))
            where = np.repeat(np.arange(len(nexts)), [len(n) for n in nexts])
            by = np.fromiter((s for n in nexts for s in n), np.int64, len(where))
            to = np.fromiter((t for n in nexts for t in n.values()), np.int64, len(where))
            plain = by != _SEPARATOR
            table = np.full((len(nexts), width), -1, np.int64)
            table[where[plain], self.symbol[by[plain]]] = to[plain]
            restart = np.where(table[0] < 0, 0, table[0])
            out = np.where(table < 0, 2 * (base + restart * width) + 1, 2 * (base + table * width))
            out[0] |= 1
            tables.append(out.astype(np.int32).ravel())
            self.roots.append(base)
            base += out.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        n = -(-np.diff(bounds) // BLOCK)
        text = np.repeat(np.arange(len(n)), n)
        start = bounds[:-1][text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        size = np.minimum(BLOCK, bounds[1:][text] - start)
        by = np.argsort(-size, kind="stable")
        text, start, size = text[by], start[by], size[by]
        symbols = self.symbol[data]
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # blocks longer than t
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(start), 1)
        count = np.zeros(state.shape, np.int32)
        for t, k in enumerate(live):
            went = self.table.take(state[:, :k] + symbols.take(start[:k] + t))
            count[:, :k] += went & 1
            np.right_shift(went, 1, out=state[:, :k])
        out = np.zeros((len(n), len(self.roots)), np.int64)
        np.add.at(out, text, count.T)
        return out


class Languages:
    def __init__(self, texts: dict[str, list[bytes]]):
        """texts: pieces of normalised text by language."""
        self.names = sorted(texts)
        self.lots = [[texts[name] for name in self.names[k : k + LOT]] for k in range(0, len(self.names), LOT)]
        self.bits = np.array([log2(max(2, sum(map(len, texts[name])))) for name in self.names])
        self.kept = Parser(self.lots[0]) if len(self.lots) == 1 else None

    def judge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the language's number and 1 - best / second best cross entropy; -1 and 0 of an empty text."""
        size = np.diff(bounds)
        if not self.names:
            return np.full(len(size), -1), np.zeros(len(size))
        phrases = np.hstack([(self.kept or Parser(lot)).phrases(data, bounds) for lot in self.lots])
        entropy = phrases * self.bits
        best = entropy.argmin(1)
        if len(self.names) == 1:
            return np.where(size, best, -1), (size > 0) * 1.0
        two = np.partition(entropy, 1, axis=1)
        return np.where(size, best, -1), np.where(size, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0.0)


_LOADED: dict[str, Languages] = {}  # a worker keeps one set of automata from task to task


def loaded(texts: dict[str, list[bytes]], key: str) -> Languages:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Languages(texts)
    return _LOADED[key]


def _rows(documents: DataFrame) -> DataFrame:
    code = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (code % 4 == 2).alias("held_out"), F.col("lang").cast("string").alias("lang"))


def learn(documents: DataFrame) -> dict[str, list[bytes]]:
    """Pieces of text by language, LEARNED bytes of each at most: of the documents that aren't held out, those pieces whose hash
    is least. Texts are chosen by a hash of their own first, so that 64 times as much as is learned is cut into pieces."""
    rows = _rows(documents).where("not held_out and lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r["n"]}
    if not totals:
        return {}
    most = max(PIECE, min(LEARNED, MODEL // len(totals)))
    shares = documents.sparkSession.createDataFrame([(name, min(1.0, 64 * most / n), min(1.0, 2 * most / min(n, 64 * most))) for name, n in totals.items()], "lang string, texts double, parts double")
    chosen = rows.select("lang", "text").join(F.broadcast(shares), "lang").where((F.xxhash64("text") / F.lit(2.0**64) + 0.5) < F.col("texts")).select("lang", "text", "parts")

    def cut(batches):
        for batch in batches:
            for b, _, _ in pieces(batch, "text", CHUNK):
                data, bounds = normal(*_lower(b.column("text")))
                n = -(-np.diff(bounds) // PIECE)
                row = np.repeat(np.arange(len(n)), n)
                start = bounds[:-1][row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                whole = data.tobytes()
                parts = [whole[s : min(s + PIECE, e)] for s, e in zip(start.tolist(), bounds[1:][row].tolist(), strict=True)]
                code = np.array([xxhash.xxh64_intdigest(p, 1) for p in parts], np.uint64)
                share = b.column("parts").to_numpy()[row]
                take = np.flatnonzero(code <= share * (2.0**64 - 2048))
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row[take])), pa.array(code[take].view(np.int64)), pa.array([parts[k] for k in take], pa.binary())], ["lang", "code", "part"])

    found = chosen.mapInArrow(cut, "lang string, code long, part binary").groupBy("lang", "code").agg(F.min("part").alias("part"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["code"] % (1 << 64))):
        have = out.setdefault(r["lang"], [])
        left = most - sum(map(len, have))
        if left > 0:
            have.append(bytes(r["part"])[:left])
    return out


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row with a doc_id.

    Learns from rows with crc32(doc_id) mod 4 other than 2 and a lang. Null text, text without a letter, or a table without
    labelled text: `und` and score 0. The score is 1 - cross entropy of the best language / of the second (1 with a single
    language, 0 at a tie; the least name wins). Repeated rows each give one row, other columns are ignored, an empty table
    gives no rows. What is learned is at most LEARNED bytes a language and MODEL bytes in all, and is broadcast.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = learn(documents)
    names = sorted(texts)
    key = hashlib.sha256(b"\0".join(p for name in names for p in (name.encode(), *texts[name]))).hexdigest() + str(zlib.crc32(repr(names).encode()))
    shared = spark.sparkContext.broadcast(texts)

    def tell(batches):
        languages = loaded(shared.value, key)
        names = pa.array([*languages.names, "und"], pa.string())
        for batch in batches:
            for b, _, _ in pieces(batch, "text", CHUNK):
                column = b.column("text")
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, score = languages.judge(*normal(*_lower(column)))
                best = np.where(letters & (best >= 0), best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), names.take(pa.array(best)), pa.array(np.where(best < len(names) - 1, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return _rows(documents).select("doc_id", "text", "held_out").mapInArrow(tell, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
