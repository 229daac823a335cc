"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows can hold whole texts, files or blocks of vectors: batches are bounded by size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession | None = None) -> None:
    """Adds the package's sources to the session's files, once per context. The
    zip is staged on the driver, whose file server hands it to every executor."""
    spark = spark or SparkSession.getActiveSession()
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    context = spark.sparkContext
    if getattr(context, "_plyforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plyforge-")) / "plyforge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    context._plyforge_shipped = True
