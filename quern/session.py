"""What a Spark session needs before it runs this package's functions on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows and bytes of an Arrow batch, where the session has not set its own: texts are long, and two batches a task are held.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need no copy of their own."""
    for name, (usual, ours) in ARROW.items():
        if spark.conf.get(name, usual) in (usual, f"{usual}b"):
            spark.conf.set(name, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-ship-"), "quern.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("quern", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
