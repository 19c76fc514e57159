"""The k first rows of each key as a partial aggregate: every task keeps k rows a key, and only those are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship

HELD = 1 << 18  #: rows that a task holds before it gives what it has and starts anew


def _first(table: pa.Table, key: str, order: list[str], k: int) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in (key, *order)])
    if not len(table):
        return table
    own = table[key].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return table.filter(pa.array(place < k))


def top_k(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """key, the order's columns and rank (from 1) of the k first rows of each key, by the columns in ascending order, which may not be
    null; equal rows stand side by side. A key's rows meet as k a task at most."""
    ship(rows.sparkSession)
    columns = rows.select(key, *order)

    def keep(batches):
        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = _first(new if held is None else pa.concat_tables([held, new]), key, order, k)
            if len(held) > HELD:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    few = columns.mapInArrow(keep, columns.schema)
    lists = few.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(*order))), 1, k).alias("rows"))
    return lists.select(key, F.posexplode("rows").alias("at", "row")).select(key, *[F.col("row")[c].alias(c) for c in order], (F.col("at") + 1).cast("long").alias("rank"))
