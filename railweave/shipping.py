"""Gives the executors the package, where they don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors of ``spark``, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="railweave-")) / f"{root.name}.zip"
    with zipfile.ZipFile(place, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, os.path.join(root.name, path.relative_to(root)))
    context.addPyFile(str(place))
    _shipped.add(context.applicationId)
