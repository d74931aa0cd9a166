"""Prepares a session: this package in the Python workers of every executor, and small batches for them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of rows that a Python worker gets at a time; Spark's own default is 64 MB, which some workers hold several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to Spark's file server, once for each application, and sets BATCH in the session."""
    spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_rivulet_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rivulet-"), "rivulet_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("rivulet", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._rivulet_shipped = True
