"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, unless the session sets its own: rows here are whole texts, and a task holds several batches.
BATCH_ROWS = 2000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each application, and bound their batches."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows not in spark.conf.getAll:
        spark.conf.set(rows, BATCH_ROWS)
    return spark
