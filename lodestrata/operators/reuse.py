"""Which papers of a manifest need work: those without a result that can be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import stored

BITS_PER_KEY = 16
BITMAP = 32_768  #: bits of a bitmap of Spark's bitmap functions
MOST_MB = 64  #: of bitmaps that are sent to all tasks


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path of the files in a folder and below it, from one listing; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")


def _bit(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def maybe_in(rows: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a member with their keys, rows that have none for sure), by a Bloom filter of one hash with BITS_PER_KEY bits a
    member; where that takes more than MOST_MB, all rows may. Null keys have no member."""
    members = stored(members.select(*keys).distinct(), "members")
    bits = max(1, -(-members.count() * BITS_PER_KEY // BITMAP)) * BITMAP
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    if bits / 8e6 > MOST_MB:
        return rows.where(whole), rows.where(~whole)
    at = members.select(_bit(keys, bits).alias("at"))
    maps = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("__bits"))
    marked = rows.withColumn("__at", _bit(keys, bits)).withColumn("__bucket", F.expr("bitmap_bucket_number(__at)")).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, int(bitmap_bit_position(__at) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("(shiftright(__byte, int(bitmap_bit_position(__at) % 8)) & 1) = 1"), F.lit(False)) & whole
    marked = stored(marked.withColumn("__byte", byte).withColumn("__hit", hit).select(*rows.columns, "__hit"), "marked")
    return marked.where("__hit").drop("__hit"), marked.where("not __hit").drop("__hit")


def pending(manifest: DataFrame, results: DataFrame, bundles: DataFrame, fingerprint: str, retry_failed: bool = False) -> DataFrame:
    """The rows of a manifest (paper_id, version, source_sha256) without a result to use again: completed, of the manifest's version, of the same
    source, with this configuration's fingerprint, and with a bundle that is there (results: paper_id, status, version, source_sha256,
    fingerprint, bundle; bundles: path, a listing); or failed, unless failed papers are tried again."""
    done = results.where((F.col("status") == "completed") & (F.col("fingerprint") == fingerprint) & F.col("bundle").isNotNull())
    done = done.join(bundles.select(F.col("path").alias("bundle")).distinct().hint("merge"), "bundle", "left_semi").select("paper_id", "version", "source_sha256")
    maybe, sure = maybe_in(manifest, done, ["paper_id", "version", "source_sha256"])
    left = maybe.join(done.distinct().hint("merge"), ["paper_id", "version", "source_sha256"], "left_anti").select(*manifest.columns).unionByName(sure)
    if retry_failed:
        return left
    return left.join(results.where("status = 'failed'").select("paper_id").distinct().hint("merge"), "paper_id", "left_anti").select(*manifest.columns)
