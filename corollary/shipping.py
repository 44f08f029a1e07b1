"""Send this package to the executors of a session, once for each Spark application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``import corollary`` work in Python workers wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "corollary_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("corollary", os.path.relpath(path, here)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
