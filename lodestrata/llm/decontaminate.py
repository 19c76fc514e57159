"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Column expressions and joins only. A window of an item's size can reach the threshold only if it shares enough
word shingles with some item of that size, and sliding it on to its first shared shingle loses none; so windows that
start at a shared shingle (or end with the text) and hold enough of them are all that need a fingerprint.
Fingerprints have 64 bits, cut into BLOCKS; within RADIUS, some block differs in RADIUS // BLOCKS bits at most, so the
index files each item's blocks under all values that near, and a join on (size, block, value) yields every window
within the radius. Two texts at a weighted similarity of 0.8 differ in 10 of 64 bits on average and in more than
RADIUS once in about a thousand; those pairs of window and item are compared too, by their shared shingles alone, so
no leak depends on a fingerprint. Each pair is verified exactly: the sum of the lesser over the sum of the greater
multiplicities of shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.tables import stored

SHINGLE, PERCENT = 5, 80
BITS, BLOCKS, RADIUS = 64, 4, 19
BROADCAST_SHINGLES = 1_000_000  #: of the benchmark; more are joined by shuffle
LANE = 65_535  #: hashes that a lane of 16 bits can count
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D], ASCII lower-cased."""
    clean = F.translate(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+"))


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once however often f uses it and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shingles(w: Column) -> Column:
    """Hashes of the SHINGLE words from each place of an array on; of the whole array, if it is shorter."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def hashed(text: Column) -> Column:
    """struct(n: the number of words, s: their shingles)."""
    return let(words(text), lambda w: F.struct(F.size(w).alias("n"), shingles(w).alias("s")))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over the hashes. Sixteen longs count four bits each in lanes of 16; beyond
    LANE hashes each bit is counted by itself."""
    return F.when(F.size(hashes) <= LANE, let(_lanes(hashes), _bits)).otherwise(_long_simhash(hashes))


def _lanes(hashes: Column) -> Column:
    ones = 0x0001000100010001
    start = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(16)])
    total = F.aggregate(hashes, start, lambda acc, h: F.struct(*[(acc[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones))).alias(f"s{j}") for j in range(16)]))
    return F.struct(total.alias("t"), F.size(hashes).alias("n"))


def _bits(lanes: Column) -> Column:
    out = F.lit(0).cast("long")
    for j in range(16):
        for k in range(4):
            count = F.shiftrightunsigned(lanes["t"][f"s{j}"], 16 * k).bitwiseAND(F.lit(0xFFFF))
            out = out.bitwiseOR(F.when(count * 2 > lanes["n"], F.lit(_bit(16 * k + j))).otherwise(F.lit(0)).cast("long"))
    return out


def _bit(k: int) -> int:
    return (1 << k) - (1 << 64 if k == 63 else 0)


def _long_simhash(hashes: Column) -> Column:
    shift = lambda h, j: F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(1))
    counts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + shift(h, j)))
    bits = F.zip_with(counts, F.array(*[F.lit(_bit(k)) for k in range(64)]), lambda n, b: F.when(2 * n > F.size(hashes), b).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def with_fingerprint(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("fp", simhash(F.col(name)))


def block(fp: Column, k: int) -> Column:
    size = BITS // BLOCKS
    return F.shiftrightunsigned(fp, k * size).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def near_masks(radius: int = RADIUS) -> list[int]:
    """All values of a block with radius // BLOCKS bits at most."""
    return [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(BITS // BLOCKS), k)]


def _repeated(a: Column) -> Column:
    """The elements that an array holds twice or more, each once."""
    same = lambda x: F.array_distinct(F.filter(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda y, z: F.when(y == z, y)), lambda y: y.isNotNull()))
    return F.when(F.size(a) > 1, let(F.array_sort(a), same)).otherwise(F.slice(a, F.lit(1), F.lit(0)))


def weighted_similarity(a: Column, b: Column) -> Column:
    """(sum of lesser multiplicities, sum of greater) of two arrays; elements repeated in both are counted one by one."""
    times = lambda x, y: F.size(F.filter(x, lambda z: z == y))
    more = F.aggregate(F.array_intersect(_repeated(a), _repeated(b)), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)) - 1)
    return let(F.size(F.array_intersect(a, b)) + more, lambda both: F.struct(both.alias("least"), (F.size(a) + F.size(b) - both).alias("most")))


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), hashed(F.col("text")).alias("x"))
    return rows.select("item_id", F.col("x.n").alias("size"), F.col("x.s").alias("item")).where("size > 0")


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, radius: int = RADIUS, complete: bool = True) -> DataFrame:
    """doc_id, item_id, start, similarity: the best window (its first word) of each document for each item it holds.

    A document holds an item if a window of as many words as the item (the whole text, if it has fewer) has a
    weighted similarity of percent / 100 or more over 5-word shingles. An item of fewer words is one shingle and is
    held by texts of just its words. Null and empty texts hold nothing and are held by nothing; rows without an id are left
    out; all texts under one id count as its. Without `complete`, only pairs within the fingerprints' radius are compared.
    """
    items = stored(_items(benchmark), "op2-items")
    need = lambda a, b: F.ceil(F.lit(percent) * (a + b) / (100 + percent)).cast("int")
    keys = items.select("item_id", "size", F.size("item").alias("m"), F.explode(F.array_distinct("item")).alias("h"))
    n_keys = items.agg(F.sum(F.size("item"))).first()[0] or 0
    keys = F.broadcast(keys) if n_keys <= BROADCAST_SHINGLES else stored(keys, "op2-keys").hint("merge")
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = texts.select("doc_id", hashed(F.col("text")).alias("x")).select("doc_id", F.col("x.n").alias("n"), F.posexplode(F.col("x.s")).alias("pos", "h")).join(keys, "h")
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    within = F.least(F.col("m"), F.greatest(F.col("n") - SHINGLE + 1, F.lit(1)))
    lists = hits.groupBy("doc_id", "n", "item_id", "size", "m").agg(F.collect_set("pos").alias("p")).withColumns({"last": last, "within": within})
    lists = lists.where(F.size("p") >= need(F.col("m"), F.col("within")))
    least = need(F.col("m"), F.col("within"))

    def start_of(at: Column, i: Column) -> Column:
        """The window's start for the i-th shared place, if it holds `least` of them; the places are in order."""
        inside = F.get("p", i + F.col("least") - 1) < at + F.col("within")
        clipped = F.get("p", F.size("p") - F.col("least")) >= F.col("last")
        return F.when((at <= F.col("last")) & inside, at).when((at > F.col("last")) & clipped, F.col("last"))

    lists = lists.withColumns({"p": F.array_sort("p"), "least": least})
    enough = F.array_distinct(F.filter(F.transform("p", start_of), lambda x: x.isNotNull()))
    proposed = stored(lists.select("doc_id", "item_id", "size", F.explode(enough).alias("start")), "op2-proposed")
    wanted = proposed.groupBy("doc_id").agg(F.collect_set(F.struct("size", "start")).alias("wanted"))
    held = texts.join(stored(wanted, "op2-wanted").hint("merge"), "doc_id")
    cut = lambda s: F.transform("wanted", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.slice(s, x["start"] + 1, F.greatest(x["size"] - SHINGLE + 1, F.lit(1))).alias("window")))
    windows = held.select("doc_id", F.explode(let(hashed(F.col("text")), lambda x: cut(x["s"]))).alias("x")).select("doc_id", "x.*")
    windows = stored(with_fingerprint(windows, "window"), "op2-windows")
    blocks = lambda extra: F.explode(F.array(*[F.struct(F.lit(k).alias("block"), block(F.col("fp"), k).alias("value")) for k in range(BLOCKS)])).alias(extra)
    filed = with_fingerprint(items, "item").withColumnRenamed("fp", "item_fp").withColumn("fp", F.col("item_fp"))
    filed = filed.select("item_id", "size", "item", "item_fp", blocks("b")).select("item_id", "size", "item_fp", "b.block", F.explode(F.transform(F.array(*[F.lit(m) for m in near_masks(radius)]), lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    met = windows.select("doc_id", "start", "size", "fp", blocks("b")).select("doc_id", "start", "size", "fp", "b.block", "b.value").hint("merge").join(stored(filed, "op2-index"), ["size", "block", "value"])
    near = stored(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("doc_id", "start", "size", "item_id").distinct(), "op2-near")
    keys = ["doc_id", "start", "size", "item_id"]
    far = proposed.select(*keys).distinct().join(near.hint("merge"), keys, "left_anti")
    pairs = (near.unionByName(far) if complete else near).hint("merge").join(windows.select("doc_id", "start", "size", "window"), ["doc_id", "start", "size"])
    items = F.broadcast(items.select("item_id", "item")) if n_keys <= BROADCAST_SHINGLES else items.select("item_id", "item").hint("merge")
    scored = pairs.join(items, "item_id").withColumn("s", weighted_similarity(F.col("window"), F.col("item"))).where(100 * F.col("s.least") >= percent * F.col("s.most"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("s.least") / F.col("s.most")).alias("similarity"), (-F.col("start")).alias("start"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.start")).cast("long").alias("start"), F.col("m.similarity").alias("similarity"))


def judge(documents: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted) and the best similarity of every row; repeated rows each give one."""
    leaks = find_leaks(documents, benchmark, **more).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    both = rows.join(stored(leaks, "op2-leaks").hint("merge"), "doc_id", "left")
    return both.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "similarity")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, similarity: a row for each document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
