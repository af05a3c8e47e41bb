"""Gives executors this package, where they don't have it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package, zipped, to the files that every Python worker gets; once in an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="strandline-code-")  # on the driver only, which serves it for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
