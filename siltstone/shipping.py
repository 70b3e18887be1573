"""This package on the executors, for Python workers that import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch, unless the session names another number than Spark's own: a worker holds few whole texts at once.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has Spark's own size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    # The driver's own folder: Spark copies the archive to the executors.
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
