"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

A byte sequence's encoding ends in exactly one token for each of its prefixes, and a sequence of tokens is the
encoding of its bytes if each two neighbours are that of theirs. So the encodings of all prefixes form a tree:
a prefix's parent is the prefix without its last token. No token is longer than the longest in the merge list,
so any continuation passes through a prefix among the last `lookahead` bytes; what the branches of all those
have in common can't change any more and is emitted, and only the rest is held.

Decoding turns ids to bytes and feeds an incremental UTF-8 machine that holds the bytes of a split character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.llm.text import pieces, texts_of

#: The pattern that cuts text before the merges (byte-level pre-tokenisation).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 16  #: characters of a text handled at a time
REMEMBERED, PAIRS = 250_000, 300_000  #: words whose ids a worker remembers, and pairs of tokens: some 90 and 30 MB


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


Word = tuple[str, tuple[int, ...], bytes]  #: ids joined by commas, ids, and the bytes that they stand for


class Transducer:
    def __init__(self, vocabulary: str):
        """vocabulary: the JSON text of a byte-level BPE tokenizer."""
        spec = json.loads(vocabulary)
        letters, model = byte_letters(), spec["model"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        ids = {token: i for i, token in self.bytes.items()}
        self.rank = {}
        for k, merge in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[ids[a], ids[b]] = (k, ids[a + b])
        self.single = [ids[bytes([b])] for b in range(256)]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.bytes |= {i: s.encode() for s, i in self.specials.items()}
        self.pairs: dict[int, bool] = {}
        self.ids, self.parts, self.age = {}, {}, {}
        for token, i in ids.items():  # those that an encoding can have; the two tokens that one is made of, and when
            steps: list[tuple[int, int]] = []
            if self.merged(token, steps) == [i]:
                self.ids[token] = i
                self.parts[i] = steps[-1] if steps else None
                self.age[i] = self.rank[steps[-1]][0] if steps else -1
        self.lookahead = max(map(len, self.ids))  #: a token that ends later starts within so many bytes
        self.reach: dict[bytes, int] = {}  # by four bytes: the longest token that ends with them
        for token in self.ids:
            if len(token) > 3:
                self.reach[token[-4:]] = max(len(token), self.reach.get(token[-4:], 0))
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, Word] = {}  # in two generations: what is used again moves to the new one
        self.before: dict[str, Word] = {}

    def merged(self, data: bytes, steps: list | None = None) -> list[int]:
        """The encoding of a token's or two tokens' bytes, merge by merge in order of rank; steps gets the pairs that were merged."""
        parts, rank = [self.single[b] for b in data], self.rank
        while len(parts) > 1:
            best = min((rank[p] for p in zip(parts, parts[1:]) if p in rank), default=None)
            if best is None:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and rank.get((parts[k], parts[k + 1])) == best:
                    if steps is not None:
                        steps.append((parts[k], parts[k + 1]))
                    out.append(best[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Whether the encoding of two tokens' bytes is those two: whether no merge across the border comes before the merges that
        made them. Those are undone latest first, of equal ones the right token's: what then meets at the border must have no merge
        of a rank below the one undone last (of the same rank, the left of two goes first)."""
        rank, parts, age = self.rank, self.parts, self.age
        before = None  # rank of the merge undone last, and whether it made the left token
        while True:
            across = rank.get((a, b))
            if across is not None and (before is None or across[0] < before[0] or across[0] == before[0] and not before[1]):
                return False
            x, y = age[a], age[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                before, a = (x, True), parts[a][1]
            else:
                before, b = (y, False), parts[b][0]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one pre-token's bytes, each as soon as it is stable."""
        longest, ids, fits, reach = self.lookahead, self.ids, self.fits, self.reach
        held = bytearray()  # bytes since the last emitted boundary
        last = [-1]  # by prefix of held: its last token
        parent = [0]  # and where that starts
        for byte in data:
            held.append(byte)
            end = len(held)
            for start in range(max(0, end - (reach.get(bytes(held[-4:]), 3) if end > 3 else end)), end):
                token = ids.get(bytes(held[start:]))
                if token is not None and (start == 0 and last[0] < 0 or last[start] >= 0 and fits(last[start], token)):
                    last.append(token)
                    parent.append(start)
                    break
            else:
                raise ValueError("no encoding: the vocabulary lacks a byte")
            if end >= 4 * longest and end % longest == 0:
                stable = self._shared(parent, end)
                if stable:
                    yield from self._path(last, parent, stable)
                    del held[:stable]
                    last = last[stable:]
                    parent = [0] + [p - stable for p in parent[stable + 1 :]]
        yield from self._path(last, parent, len(held))

    def short(self, data: bytes) -> list[int]:
        """stream() for a pre-token within the lookahead, of which nothing is stable before its end."""
        ids, pairs, fits, reach = self.ids.get, self.pairs.get, self.fits, self.reach.get
        last, parent = [-1], [0]
        for end in range(1, len(data) + 1):
            start = end - reach(data[end - 4 : end], 3) if end > 3 else 0
            if start < 0:
                start = 0
            token = ids(data[start:end])
            while token is None or start and not ((known := pairs(last[start] << 32 | token)) or known is None and fits(last[start], token)):
                start += 1
                token = ids(data[start:end])
            last.append(token)
            parent.append(start)
        return self._path(last, parent, len(data))

    def _shared(self, parent: list[int], end: int) -> int:
        """The last boundary on the branches of all prefixes that a later token may start from."""
        live = set(range(max(0, end - self.lookahead + 1), end + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(parent[top])
        return live.pop()

    @staticmethod
    def _path(last: list[int], parent: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end = parent[end]
        return out[::-1]

    def word(self, word: str) -> Word:
        got = self.before.get(word)
        if got is None:
            data = word.encode()
            ids = tuple(self.short(data) if len(data) <= self.lookahead else self.stream(data))
            data = b"".join([self.bytes[i] for i in ids])
            got = ",".join(map(str, ids)), ids, data
        if len(word) <= 64:
            if len(self.words) >= REMEMBERED // 2:
                self.before, self.words = self.words, {}
            self.words[word] = got
        return got

    def encode(self, text: str) -> Iterator[list[Word]]:
        """Lists of words, one of each pre-token or special token after the other."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            i = self.specials[m[0]]
            yield [(str(i), (i,), m[0].encode())]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[Word]]:
        new = self.word
        while at < end:
            known = self.words.get
            cut = end
            if end - at > PIECE and (m := CUT.search(text, at + PIECE, end)):
                cut = m.start() + 1
            yield [known(w) or new(w) for w in self.pattern.findall(text[at:cut])]
            at = cut


#: Between a character that is no white space and a single space before another: no pre-token lies across.
CUT = regex.compile(r"\S(?= \S)")


class Decoder:
    """Ids to text, piece by piece; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        tokens = self.tokens
        return self.feed_bytes([tokens[i] for i in ids], last)

    def feed_bytes(self, parts: Iterable[bytes], last: bool = False) -> str:
        return self.machine.decode(b"".join(parts), last)


def _digests(transducer: Transducer, text: str) -> tuple[int, str, str]:
    ids, decoded, decoder = hashlib.sha256(), hashlib.sha256(), Decoder(transducer.bytes)
    n = 0
    for lot in transducer.encode(text):
        if lot:
            ids.update((("," if n else "") + ",".join([x[0] for x in lot])).encode())
            decoded.update(decoder.feed_bytes([x[2] for x in lot]).encode())
            n += sum([len(x[1]) for x in lot])
    decoded.update(decoder.feed((), True).encode())
    return n, ids.hexdigest(), decoded.hexdigest()


_LOADED: dict[str, Transducer] = {}  # a worker keeps the tables from task to task: one vocabulary's, and the bounded caches


def loaded(vocabulary: str) -> Transducer:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(vocabulary)
    return _LOADED[key]


def vocabulary_text(path: str | None = None) -> str:
    """The tokenizer file's text; path defaults to the public byte-level BPE of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token_ids and decoded text of every row; null texts count as empty and have no ids.

    A special token's string in a text is its one id. Rows without doc_id are left out, repeated rows each give
    one, other columns are ignored, an empty table gives no rows. The driver reads the vocabulary (a file of
    fixed size) and broadcasts it.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def encode(batches):
        t = loaded(vocabulary.value)
        for b in batches:
            for rows, data, bounds in pieces(b, "text"):
                ids = [[i for lot in t.encode(data[s:e].tobytes().decode()) for x in lot for i in x[1]] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [Decoder(t.bytes).feed(x, True) for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "token_ids", "decoded"])

    return texts_of(documents).mapInArrow(encode, "doc_id long, token_ids array<int>, decoded string")


def encode_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_texts, in memory that doesn't grow with a text's ids."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def encode(batches):
        t = loaded(vocabulary.value)
        for b in batches:
            for rows, data, bounds in pieces(b, "text"):
                out = [_digests(t, data[s:e].tobytes().decode()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                n, ids, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(documents).mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
