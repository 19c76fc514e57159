"""Ranks over all rows of a table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.tables import stored


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with each row's place from 1 in an order without ties: rows are dealt by ranges of the order, counted by range, and
    numbered within theirs after the counts before it."""
    parts = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.broadcast(counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__head")))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__w", within).join(heads, "__p").withColumn(name, (F.col("__head") + F.col("__w")).cast("long")).drop("__p", "__w", "__head")
