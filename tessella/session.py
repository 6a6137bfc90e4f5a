"""What every operator needs of its session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessella", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._tessella_shipped = True
