"""Sending this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bounds of the batches that go to Python workers, where the session has Spark's own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that they can import it.

    Also bound the batches that go to Python, since texts may be long; a session's own bounds stay.
    """
    context = spark.sparkContext
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)
    if getattr(context, "_runstore_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="runstore-package-")  # the driver's own; Spark serves the file from there
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    path = os.path.join(own, "runstore_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("runstore", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._runstore_shipped = True
