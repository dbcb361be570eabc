"""A PySpark-native analytics engine for market bars."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once for each application.

    Not needed where the package is installed on all nodes or given to spark-submit with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "barlab.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
            for folder, _, names in sorted(os.walk(home)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        bundle.write(file, os.path.relpath(file, os.path.dirname(home)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
