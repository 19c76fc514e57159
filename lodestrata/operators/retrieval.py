"""Claims for questions by an inverted index.

Claims have a place in one order, by status and then id, that holds for all questions. A word's postings are the places of its claims,
cut into blocks of places; a block's first place is the best that anything in it can have, and how many postings of the word lie
before it is kept with it. So the best claims of a question are found in the first blocks of its words: its rarest word gives
a last place that has to be beaten, and the other words' blocks beyond that place aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranks import ranked
from lodestrata.tables import stored

STATUS_ORDER = ("supported", "disputed", "proposed", "unknown", "superseded")
BLOCK = 4096  #: places of a block
BUCKETS = 64  #: folders that words are dealt to


def words(text: Column) -> Column:
    """The distinct words [a-z0-9]+ of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), lambda x: x != "")


def status_place(status: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), status)
    return F.when(at > 0, at).otherwise(len(STATUS_ORDER) + 1)


@dataclass
class ClaimIndex:
    claims: DataFrame  #: place, claim_id, words
    postings: DataFrame  #: bucket, word, block, before, n, df, places
    block: int

    def save(self, path: str) -> None:
        """Write both tables; postings in a folder for each bucket of words, in order of word and block."""
        self.claims.write.mode("overwrite").parquet(f"{path}/claims")
        self.postings.repartitionByRange("bucket", "word", "block").sortWithinPartitions("bucket", "word", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str, block: int = BLOCK) -> ClaimIndex:
    return ClaimIndex(spark.read.parquet(f"{path}/claims"), spark.read.parquet(f"{path}/postings"), block)


def claim_index(claims: DataFrame, block: int = BLOCK) -> ClaimIndex:
    """The index of claims (claim_id, text, status). A block holds as many places as `block` at most, also of a word of all claims."""
    rows = claims.select("claim_id", status_place(F.col("status")).alias("status_place"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    rows = stored(rows.withColumn("tie", F.xxhash64("words")), "claim-words")  # texts are cut once, and no words go into the bounds of ranges
    placed = stored(ranked(rows, ["status_place", "claim_id", "tie"], "place").select("place", "claim_id", "words"), "claim-places")
    each = placed.select(F.explode("words").alias("word"), "place").withColumn("block", F.floor(F.col("place") / block).cast("long"))
    blocks = each.groupBy("word", "block").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumn("n", F.size("places").cast("long"))
    in_order = Window.partitionBy("word").orderBy("block")  # a row for each block of a word
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = F.sum("n").over(Window.partitionBy("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    return ClaimIndex(placed, stored(blocks.select(bucket.alias("bucket"), "word", "block", before.alias("before"), "n", df.alias("df"), "places"), "claim-postings"), block)


def candidates(index: ClaimIndex, questions: DataFrame, k: int) -> DataFrame:
    """question_id, place: all that can be among the k first claims of a question (question_id, words) that share a word with it."""
    terms = questions.select("question_id", F.explode("words").alias("word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    terms = stored(terms, "question-terms")
    lead = index.postings.where(F.col("before") < k)
    # the rarest word that has k claims itself: its k-th claim is a place to beat
    rarest = lead.where((F.col("before") + F.col("n") >= k)).select("bucket", "word", "df", F.element_at("places", (F.lit(k) - F.col("before")).cast("int")).alias("kth"))
    bar = terms.join(rarest.hint("merge"), ["bucket", "word"]).groupBy("question_id").agg(F.min_by("kth", F.struct("df", "word")).alias("bar"))
    barred = stored(terms.join(bar.hint("merge"), "question_id", "left").withColumn("bar", F.coalesce("bar", F.lit((1 << 63) - 1))), "question-bars")
    met = barred.join(lead.hint("merge"), ["bucket", "word"]).where(F.col("block") * index.block <= F.col("bar"))
    some = F.slice("places", F.lit(1), F.least(F.col("n"), F.lit(k) - F.col("before")).cast("int"))
    return met.select("question_id", "bar", F.explode(some).alias("place")).where("place <= bar").select("question_id", "place").distinct()


def top_claims(index: ClaimIndex, questions: DataFrame, k: int) -> DataFrame:
    """question_id, rank, claim_id, overlap: the k first claims, by status and id, among those that share a word with a question (question_id,
    text), else among all claims, with the number of words shared. Null texts have no words; an empty index gives no rows."""
    q = stored(questions.select("question_id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words")), "question-words")
    met = stored(candidates(index, q, k), "question-candidates")
    alone = q.select("question_id").join(met.select("question_id").distinct().hint("merge"), "question_id", "left_anti")
    every = alone.select("question_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("place"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("place"))  # k rows for each word of a question at most
    first = met.unionByName(every).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    rows = first.join(index.claims.withColumnRenamed("words", "claim_words").hint("merge"), "place").join(q.hint("merge"), "question_id")
    return rows.select("question_id", "rank", "claim_id", F.size(F.array_intersect("words", "claim_words")).cast("long").alias("overlap"))
