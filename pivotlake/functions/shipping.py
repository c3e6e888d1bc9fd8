"""Hands this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's files, once per Spark context; executors
    fetch it from the driver, so nothing need be installed on them. Arrow batches of the
    session get a bound."""
    # texts can be long: bound the batches that workers hold by bytes, not by rows only
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_pivotlake_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="pivotlake-")) / "pivotlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, Path(_PACKAGE.name) / f.relative_to(_PACKAGE))
    sc.addPyFile(str(path))
    sc._pivotlake_shipped = True
