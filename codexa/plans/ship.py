"""Send the package to the workers, so that they need no installation of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip file, served to executors by the driver."""
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    SHIPPED.add(context.applicationId)
