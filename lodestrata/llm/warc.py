"""WARC records in a content-addressed archive: payloads once, headers apart, records rebuilt by joins.

An archive is a folder with two Parquet tables: `payloads` (sha256, payload) holds each payload's bytes once,
`headers` (sha256, header) the exact header of every record, response or revisit. A payload's bytes come from
the row with the least page_id, found by a partial aggregate, so a payload of a third of all pages is neither
gathered nor moved. Writing compares length and SHA-1 of all rows with one SHA-256 and fails if they differ;
reading rebuilds the records and computes the digests of the payloads cut out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import new_path, stored

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  #: fixed value: base32
DATE = "1970-01-01T00:00:00Z"  #: pages carry no date
MIN_BYTES = 0


def base32(hex40: Column) -> Column:
    """A SHA-1 in hexadecimal digits as 32 base32 letters: five digits are four letters."""
    parts = []
    for k in range(8):
        value = F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(value, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), page_id.cast("string"), F.lit(">"))


def header(page_id: Column, url: Column, digest: Column, size: Column, first: Column) -> Column:
    """A record's header, with the empty line that ends it; white space and controls in a URL are percent signs and digits."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A"), "\t", "%09"), " ", "%20")
    common = [F.lit("\r\nWARC-Target-URI: "), safe, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), record_id(page_id), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"), digest]
    response = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response"), *common, F.lit("\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = F.concat(F.lit("WARC/1.0\r\nWARC-Type: revisit"), *common, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(first), F.lit("\r\nContent-Length: 0\r\n\r\n"))
    return F.when(first.isNull() | (first == page_id), response).otherwise(revisit)


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES) -> None:
    """Write a record for each row (page_id, url, html); null html is empty, a row without page_id is left out.

    Of rows with one payload of min_bytes or more, those with the least page_id are response (repeated rows all
    are), the others revisit it; smaller payloads are all response.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    spark = pages.sparkSession
    facts.write.option("compression", "zstd").parquet(f"{path}/facts")
    facts = spark.read.schema(facts.schema).parquet(f"{path}/facts")
    firsts = facts.groupBy("sha256").agg(F.min("page_id").alias("first"), F.min("sha1").alias("sha1"), (F.min(F.struct("sha1", "size")) != F.max(F.struct("sha1", "size"))).alias("clash"))
    firsts.write.option("compression", "zstd").parquet(f"{path}/firsts")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/firsts")
    if not firsts.where("clash").isEmpty():
        raise ValueError("two payloads have one SHA-256")
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("sha256"), "payload")
    once = keyed.join(firsts.select(F.col("first").alias("page_id"), "sha256").hint("merge"), ["page_id", "sha256"]).dropDuplicates(["page_id", "sha256"])  # in the join's partitions
    once.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = F.when(F.col("size") >= min_bytes, F.col("first"))
    met = facts.join(firsts.select("sha256", "first").hint("merge"), "sha256")
    met.select("sha256", header(F.col("page_id"), F.col("url"), base32(F.col("sha1")), F.col("size"), first).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """sha256, header, and from the header page_id, url, record_type, payload_digest, refers_to."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    page = lambda name: F.regexp_extract(field(name), "^<urn:x-page:(-?[0-9]+)>$", 1).cast("long")
    rows = spark.read.schema("sha256 string, header string").parquet(f"{path}/headers")
    return rows.select("sha256", "header", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("t"), F.regexp_extract("header", r"^WARC/1.0\r\nWARC-Type: ([a-z]+)", 1).alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), page("WARC-Refers-To").alias("refers_to")).drop("t")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_digest, refers_to, sha256 and record: each record's original bytes, rebuilt from
    its header and, for a response, the stored payload. A revisit has no block and is not joined."""
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    headers = read_headers(spark, path)
    whole = headers.where("record_type = 'response'").join(payloads.hint("merge"), "sha256")
    plain = headers.where("record_type <> 'response'").withColumn("payload", F.lit(b""))
    return whole.unionByName(plain).select("page_id", "url", "record_type", "payload_digest", "refers_to", "sha256", F.concat(F.encode("header", "UTF-8"), "payload", F.lit(b"\r\n\r\n")).alias("record"))


def block_of(record: Column) -> Column:
    """The bytes behind a record's header, as many as its Content-Length says."""
    head = F.instr(F.decode(record, "ISO-8859-1"), "\r\n\r\n")  # one character a byte
    size = F.regexp_extract(F.decode(F.substring(record, F.lit(1), head), "UTF-8"), r"\r\nContent-Length: ([0-9]+)", 1).cast("int")
    return F.substring(record, head + 4, size)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record: size and digest are those of the
    payload cut out of the rebuilt response, which a revisit shares with the record that it refers to."""
    records = read_records(spark, path).withColumn("block", F.when(F.col("record_type") == "response", block_of(F.col("record"))))
    kinds = records.select("page_id", "sha256", "payload_digest", "record_type", "refers_to", F.octet_length("block").cast("long").alias("payload_bytes"), base32(F.sha1("block")).alias("own"), F.sha2("block", 256).alias("own_sha256"))
    kinds = stored(kinds, "op8-records")
    sound = kinds.where("record_type = 'response'").groupBy("sha256").agg(F.min("payload_bytes").alias("payload_bytes"), F.min("own").alias("own"), F.min(F.col("own_sha256") == F.col("sha256")).alias("sound"))
    both = kinds.select("sha256", "page_id", "payload_digest", "record_type", "refers_to").join(stored(sound, "op8-sound").hint("merge"), "sha256", "left")
    wrong = ~F.coalesce(F.col("sound") & (F.col("payload_digest") == F.col("own")), F.lit(False))
    digest = F.when(wrong, F.raise_error(F.lit("a rebuilt payload doesn't have its digest"))).otherwise(F.col("own"))
    return both.select("page_id", "payload_bytes", digest.cast("string").alias("payload_digest"), "record_type", "refers_to")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_digests(spark, path)


_LETTERS = " || ".join(f"substr('{ALPHABET}', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT) >> {15 - 5 * j}) & 31)::INTEGER + 1, 1)" for k in range(8) for j in range(4))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
