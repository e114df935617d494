"""Getting this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

import lodestone


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark context.

    Does nothing when the package was already shipped by the same driver. The archive
    goes through Spark's own file server, so executors need no shared folder for it.
    """
    sc = spark.sparkContext
    if any(name.startswith("lodestone-src") for name in sc._python_includes):
        return
    root = os.path.dirname(os.path.abspath(lodestone.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone"), f"lodestone-src-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, root)))
    sc.addPyFile(path)
