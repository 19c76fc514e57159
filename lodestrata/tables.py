"""Tables between the steps of an operator, in the folder that the cluster shares.

The folder is spark.checkpoint.dir of the session. Only where that is unset, and only on a local master, a
temporary folder stands in. A written table cuts lineage: a lost executor costs no earlier step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_PATHS: list[str] = []  #: of the tables that this session has written and not deleted


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS.append(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path in _PATHS:
            _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, *kept: DataFrame) -> Iterator[list[DataFrame]]:
    """What `stored` writes inside is deleted at the end, but for the tables put on the list that this gives."""
    before, out = set(_PATHS), list(kept)
    yield out
    for path in [p for p in _PATHS if p not in before and p not in {getattr(t, "_stored_at", None) for t in out}]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _PATHS.remove(path)
