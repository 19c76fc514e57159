"""Cutting texts to chunks, and lists to batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_text(text: Column, size: int, most: int) -> Column:
    """array of struct(i, text): slices of `size` characters, `most` at most, blank ones left out."""
    n = F.least(F.lit(most), F.ceil(F.char_length(text) / size).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.substr(text, i * size + 1, F.lit(size)).alias("text")))
    return F.filter(parts, lambda p: F.regexp_replace(p["text"], r"\s+", "") != "")


def to_batches(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """df with batch: rows of a key in order, `size` to a batch."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("long"))


def pack_context(blocks: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """key, context: texts in order (nulls first; ties by text) joined by an empty line, cut at `most` characters; null texts are left
    out, a key without texts has an empty context. Texts past the cap aren't gathered."""
    before = F.sum(F.char_length(text) + 2).over(Window.partitionBy(key).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < most + 2)  # a text just past the cap still has its empty line before it
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(key).agg(F.left(F.array_join(parts, "\n\n"), F.lit(most)).alias("context"))
