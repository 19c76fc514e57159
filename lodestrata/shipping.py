"""The package itself, for Python tasks on executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH = 1000  #: rows of an Arrow batch: at some kB a text, a few MB in the executor and again in its Python worker
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context. A session that leaves Arrow's batches at Spark's 10,000 rows gets BATCH:
    whole texts of that many rows would be held off the heap by every task, twice."""
    if int(spark.conf.get(_BATCH)) == 10_000:
        spark.conf.set(_BATCH, str(BATCH))
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, str(Path(top.name) / path.relative_to(top)))
    context.addPyFile(str(archive))
    context._lodestrata_shipped = True
