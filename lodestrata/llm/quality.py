"""Quality rules: counts of repetition and symbols, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model over the code points of each language's texts, four at a time. Spark counts
every n-gram of every whole text, with no limit on n-grams or languages; discounts, continuation counts and
probabilities are grouped aggregates and joins of those counts. A text mustn't vouch for itself: an n-gram that only
one document holds counts as unseen, for any document. Those known are kept in arrays sorted by hash and found by
binary search. Up to BROADCAST entries (twelve bytes each, counted first) the arrays are broadcast; a larger model
stays where it is, and the documents' n-grams are joined to it: the same numbers, by shuffle.

A language's band comes from the distribution of its texts' mean log-perplexities over the whole corpus: it reaches
BELOW times the distance from median to lower quartile under the median, ABOVE times that to the upper quartile over
it, and is widened for short texts, whose mean varies more. Quartiles stay where they are while under a quarter of a
language's texts is noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import Chunk, chunks, mix, window_hashes
from lodestrata.shipping import ship
from lodestrata.tables import stored

ORDER, DOCUMENTS = 4, 2  #: code points in an n-gram (four of 16 bits fill a long); documents that must hold a known one
BROADCAST = 4_000_000  #: entries of the model; more are joined by shuffle
HELD, CHUNK = 2_000_000, 1 << 19  #: n-grams that a counting task holds before it sends them on; bytes of text that are handled at a time
BELOW, ABOVE, SHORT = 16.0, 16.0, 14.0  #: distances from median to quartile; nats, divided by the square root of the length
BIN = 0.001  #: log-perplexities are counted in bins so wide for median and quartiles
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
START = 0xFFFF  #: stands before a text


def codes(points: np.ndarray) -> np.ndarray:
    """Code points as 16 bits; those beyond the basic plane share its 6,400 private ones by hash."""
    out = points.astype(np.uint64)
    far = points > 0xFFFF
    if far.any():
        out[far] = np.uint64(0xE000) + mix(out[far]) % np.uint64(6400)
    return out


def ngrams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends with each code point of a chunk, number of code points of each text)."""
    lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    bounds = lead[c.bounds]
    k = codes(np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32))
    place = np.arange(len(k)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = k.copy()
    for back in range(1, ORDER):
        before = np.full(len(k), START, np.uint64)
        before[back:] = k[: len(k) - back] if back < len(k) else k[:0]
        before[place < back] = START
        out |= before << np.uint64(16 * back)
    return out, np.diff(bounds)


def _by_model(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.array(c.rows.column("model").to_pylist()), return_inverse=True)


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Rows (model, k, gram, n, documents) for the n-grams of each order k that a task sees: how often (of the highest order alone) and in
    how many documents."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}

    def merged(parts):
        gram, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
        return gram[heads], np.add.reduceat(n[order], heads), np.add.reduceat(docs[order], heads)

    def rows():
        for (name, order), parts in held.items():
            gram, n, docs = merged(parts)
            for at in range(0, len(gram), 200_000):
                i = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram[i])), pa.array(np.full(len(gram[i]), order, np.int32)), pa.array(gram[i].view(np.int64)), pa.array(n[i]), pa.array(docs[i])], ["model", "k", "gram", "n", "documents"])

    for b in batches:
        for c in chunks(b, "text", CHUNK):
            gram, sizes = ngrams(c)
            names, model = _by_model(c)
            doc = np.repeat(np.arange(len(c)), sizes)
            for m, name in enumerate(names):
                mine = np.flatnonzero(model[doc] == m)  # places of n-grams; from order to order one for each document and n-gram
                for k in range(ORDER, 0, -1):
                    if not len(mine):
                        break
                    own = gram[mine] & np.uint64((1 << 16 * k) - 1)
                    by = np.argsort(own, kind="stable")
                    g, d = own[by], doc[mine[by]]
                    new = np.concatenate([[True], g[1:] != g[:-1]])
                    heads = np.flatnonzero(new)
                    other = new | np.concatenate([[True], d[1:] != d[:-1]])
                    n = np.diff(np.append(heads, len(g))) if k == ORDER else np.zeros(len(heads), np.int64)
                    parts = held.setdefault((str(name), k), [])
                    parts.append((g[heads], n, np.add.reduceat(other.astype(np.int64), heads)))
                    if len(parts) > 8:
                        held[str(name), k] = [merged(parts)]
                    mine = np.sort(mine[by[other]])
            if sum(len(x[0]) for parts in held.values() for x in parts) > HELD:
                held = {key: [merged(parts)] for key, parts in held.items()}
                if sum(len(x[0]) for parts in held.values() for x in parts) > HELD // 2:
                    yield from rows()
                    held = {}
    yield from rows()


def _discounts(rows: DataFrame) -> DataFrame:
    """model, d1, d2, d3: what is taken off counts 1, 2, 3 and more; a row for each language."""
    n = [F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4)]
    found = rows.groupBy("model").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)], F.count("*").alias("kinds"))
    y = F.expr("n1 / (n1 + 2 * n2)")
    enough = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")

    def d(k: int, usual: float) -> Column:
        return F.when(enough, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(usual).alias(f"d{k}")

    return found.select("model", d(1, 0.5), d(2, 0.75), d(3, 0.9), "kinds")


def _levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (model, gram, documents, p) and (model, context, documents, left).

    p is the smoothed probability of the n-gram's last code point; where fewer than DOCUMENTS hold the n-gram, that of
    the order below times what is left of the context. How many documents hold an n-gram is counted for each order by
    itself, and a context counts as the n-gram that it is; that of a text's first code point is in each text once.
    """
    of = lambda k: counts.where(F.col("k") == k).select("model", "gram", "n", "documents")
    tables = [of(ORDER).withColumnRenamed("n", "c")]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
        longer = tables[0].select("model", suffix, F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("documents"))
        held = of(k).select("model", "gram", F.lit(0).cast("long").alias("c"), "documents")
        tables.insert(0, stored(longer.unionByName(held).groupBy("model", "gram").agg(F.sum("c").alias("c"), F.sum("documents").alias("documents")), f"op7-order{k}"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, rows in enumerate(tables, 1):
        taken = F.broadcast(_discounts(rows))  # a row for each language
        rows = rows.withColumns({"context": F.shiftrightunsigned("gram", 16), "suffix": F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))}).join(taken, "model")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = rows.groupBy("model", "context").agg(F.sum("c").alias("total"), F.sum(off).alias("off"), F.sum("documents").alias("context_documents"))
        if k > 1:
            held = tables[k - 2].select("model", F.col("gram").alias("context"), F.col("documents").alias("held"))
            contexts = contexts.join(held.hint("merge"), ["model", "context"], "left").withColumn("context_documents", F.coalesce("held", "context_documents"))
        contexts = contexts.select("model", "context", "total", "context_documents", F.when(F.col("context_documents") >= DOCUMENTS, F.col("off") / F.col("total")).otherwise(1.0).alias("left"))
        contexts = stored(contexts, f"op7-contexts{k}")
        lower = F.lit(1.0) / (F.col("kinds") + 1)
        rows = rows.join(contexts.hint("merge"), ["model", "context"])
        if out:
            rows = rows.join(out[-1][0].select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower")).hint("merge"), ["model", "suffix"])
            lower = F.col("lower")
        p = F.col("left") * lower + F.when(F.col("documents") >= DOCUMENTS, (F.col("c") - off) / F.col("total")).otherwise(0.0)
        out.append((stored(rows.select("model", "gram", "documents", p.alias("p")), f"op7-known{k}"), contexts))
    return out


def keys(model: np.ndarray, gram: np.ndarray, order: int, kind: int) -> np.ndarray:
    """Hash of an n-gram (kind 0) or context (kind 1) of a model, given by its own hash."""
    return mix(mix(gram, 8 * kind + order) ^ model, 11)


def name_hash(name: str) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for x in name.encode():
        out = mix(out ^ np.uint64(x), 13)
    return out[0]


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, at = np.unique(np.array(b.column("model").to_pylist(), str), return_inverse=True)
        model = np.array([name_hash(str(x)) for x in names], np.uint64)[at]
        gram, order, kind = b.column("gram").to_numpy().view(np.uint64), b.column("k").to_numpy(), b.column("kind").to_numpy()
        key = np.zeros(len(gram), np.uint64)
        for k in range(1, ORDER + 1):
            for t in (0, 1):
                mine = (order == k) & (kind == t)
                key[mine] = keys(model[mine], gram[mine], k, t)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("value")], ["key", "value"])


def _entries(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """key, value (log-probability or log of what is left) of all that DOCUMENTS hold, in order of the key; and the
    probability of a code point that no text of a language has, under order 1's empty context."""
    parts = []
    for k, (rows, contexts) in enumerate(levels, 1):
        parts.append(rows.where(F.col("documents") >= DOCUMENTS).select("model", "gram", F.lit(k).alias("k"), F.lit(0).alias("kind"), F.log("p").cast("float").alias("value")))
        left = F.log(F.greatest("left", F.lit(1e-12)))
        if k == 1:
            kinds = F.broadcast(rows.groupBy("model").agg(F.count("*").alias("kinds")))  # a row for each language
            contexts, left = contexts.join(kinds, "model"), left - F.log(F.col("kinds") + 1)
        known = contexts if k == 1 else contexts.where(F.col("context_documents") >= DOCUMENTS)
        parts.append(known.select("model", F.col("context").alias("gram"), F.lit(k).alias("k"), F.lit(1).alias("kind"), left.cast("float").alias("value")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return stored(every.mapInArrow(_hashed, "key long, value float"), "op7-entries")


class Model:
    """The sorted arrays of all languages."""

    def __init__(self, table: pa.Table):
        key = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, self.values = key[order], table["value"].to_numpy()[order]

    def _find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(want), bool), np.zeros(len(want), np.float32)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[at] == want, self.values[at]

    def surprise(self, name: str, gram: np.ndarray) -> np.ndarray:
        """-ln p of each n-gram's last code point."""
        model = name_hash(name)
        kinds, where = np.unique(gram, return_inverse=True)
        total, left = np.zeros(len(kinds)), np.arange(len(kinds))
        for k in range(ORDER, 0, -1):
            g = kinds[left] & np.uint64((1 << 16 * k) - 1)
            found, value = self._find(keys(model, g, k, 0))
            total[left[found]] += value[found]
            left, g = left[~found], g[~found]
            found, value = self._find(keys(model, g >> np.uint64(16), k, 1))
            total[left[found]] += value[found]
        return -total[where]


def repeated_words(c: Chunk, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words in windows of k words that occur twice or more in it."""
    at = np.flatnonzero(c.full(k))
    docs = c.doc_of_word()
    h = mix(window_hashes(c.word_hashes(), k)[at] + docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 4)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h) + 1, bool)
    twice[:-1][1:] |= same
    twice[:-1][:-1] |= same
    change = np.zeros(len(c.starts) + 1, np.int64)
    hit = at[order[twice[:-1]]]
    change[hit] += 1
    np.add.at(change, hit + k, -1)
    return np.bincount(docs[np.cumsum(change[:-1]) > 0], minlength=len(c))


MEASURES = "doc_id long, model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, surprise double, row string, grams array<long>, times array<int>"


def _measures(model: Model | None):
    """Counts and the summed surprise of each text; without a model, in place of it the text's distinct n-grams."""

    def measure(batches):
        import uuid

        task, n = uuid.uuid4().hex, 0
        for b in batches:
            for c in chunks(b, "text", CHUNK):
                inside = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                chars = np.bincount(c.doc_of_word(), inside[c.ends] - inside[c.starts], len(c)).astype(np.int64)
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[c.data])])[c.bounds]
                lines = []
                for k in range(len(c)):
                    all_lines = [x for x in c.data[c.bounds[k] : c.bounds[k + 1]].tobytes().split(b"\n") if x.split()]
                    lines.append(len(all_lines) - len(set(all_lines)))
                gram, sizes = ngrams(c)
                names, which = _by_model(c)
                total, lists, times = np.zeros(len(c)), None, None
                doc = np.repeat(np.arange(len(c)), sizes)
                if model is not None:
                    for k, name in enumerate(names):
                        mine = which[doc] == k
                        total += np.bincount(doc[mine], model.surprise(str(name), gram[mine]), len(c))
                else:
                    cuts = np.concatenate([[0], np.cumsum(sizes)])
                    pairs = [np.unique(gram[i:j].view(np.int64), return_counts=True) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    lists, times = [x for x, _ in pairs], [x.astype(np.int32) for _, x in pairs]
                ids = [f"{task}-{n + k}" for k in range(len(c))] if model is None else [None] * len(c)
                n += len(c)
                yield pa.RecordBatch.from_arrays(
                    [c.rows.column("doc_id"), c.rows.column("model"), pa.array(c.n_words.astype(np.int64)), pa.array(chars), pa.array(np.diff(marks).astype(np.int64)), pa.array(lines, pa.int64()), pa.array(repeated_words(c).astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(total), pa.array(ids, pa.string()), pa.array(lists or [None] * len(c), pa.list_(pa.int64())), pa.array(times or [None] * len(c), pa.list_(pa.int32()))],
                    ["doc_id", "model", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "surprise", "row", "grams", "times"],
                )

    return measure


def _texts(documents: DataFrame) -> DataFrame:
    ship(documents.sparkSession)
    code = F.split_part(F.translate(F.lower(F.trim(F.col("lang").cast("string"))), "_", "-"), F.lit("-"), F.lit(1)) if "lang" in documents.columns else F.lit("und")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(code.rlike("^[a-z]{2,8}$"), code).otherwise("und").alias("model")).where(F.col("doc_id").isNotNull())


def measure(documents: DataFrame, *, broadcast: int = BROADCAST) -> DataFrame:
    """Counts and log_perplexity (mean -ln p of a code point) of every row, by a model of the same documents."""
    spark = documents.sparkSession
    texts = _texts(documents)
    counts = stored(texts.mapInArrow(_count, "model string, k int, gram long, n long, documents long").groupBy("model", "k", "gram").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "op7-counts")
    levels = _levels(counts)
    entries = _entries(levels)
    slim = ("doc_id", "model", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")
    if entries.count() <= broadcast:
        shared = spark.sparkContext.broadcast(Model(entries.toArrow()))

        def run(batches):
            yield from _measures(shared.value)(batches)

        rows = stored(texts.mapInArrow(run, MEASURES).select(*slim, "surprise"), "op7-measures")
        shared.destroy()
    else:
        lists = stored(texts.mapInArrow(_measures(None), MEASURES).drop("surprise"), "op7-lists")
        each = lists.select("row", "model", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "model", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
        sums = each.hint("merge").join(levels[-1][0].select("model", "gram", F.log("p").alias("l")), ["model", "gram"]).groupBy("row").agg(F.sum(-F.col("l") * F.col("times")).alias("surprise"))
        rows = stored(lists.select("row", *slim).join(stored(sums, "op7-sums").hint("merge"), "row", "left").select(*slim, F.coalesce("surprise", F.lit(0.0)).alias("surprise")), "op7-measures")
    return rows.select(*slim, (F.col("surprise") / F.greatest("n_chars", F.lit(1))).alias("log_perplexity"))


def score(documents: DataFrame, *, below: float = BELOW, above: float = ABOVE, short: float = SHORT, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each document: counts, log_perplexity, the band's lower and upper end, base_failed and kept.

    base_failed: under 10 words, or over 20 % of the words stand in 5-word windows found twice or more in the
    text. kept: not base_failed, and the mean log-perplexity a code point lies in the band of the language (the
    primary subtag of lang). Null and empty texts have no words and fail; texts with an odd or missing language share
    the model "und" and its band; a row without doc_id is left out; repeated rows each give one; other columns are
    ignored; an empty table gives no rows.
    """
    rows = measure(documents, broadcast=broadcast)
    bands = F.broadcast(_bands(rows))  # a row for each language
    slack = short / F.sqrt(F.greatest("n_chars", F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.join(bands, "model", "left")
        .withColumns({"lower": F.col("middle") - below * (F.col("middle") - F.col("low")) - slack, "upper": F.col("middle") + above * (F.col("high") - F.col("middle")) + slack, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True)))
        .drop("low", "middle", "high")
    )


def _bands(rows: DataFrame) -> DataFrame:
    """model, low, middle, high: quartiles and median of the log-perplexities of the rows with words enough, to a bin."""
    fit = rows.where(F.col("n_words") >= MIN_WORDS)
    bins = fit.groupBy("model", F.round(F.col("log_perplexity") / BIN).cast("int").alias("bin")).count()  # at most as many bins a model as log-perplexity has
    points = bins.groupBy("model").agg(F.expr("percentile(bin, array(0.25D, 0.5D, 0.75D), count)").alias("q"))
    return points.select("model", *[(F.col("q")[k] * BIN).alias(name) for k, name in enumerate(("low", "middle", "high"))])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
