"""Sends the package to executors that do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def archive(folder: Path, target: Path) -> Path:
    """A zip file of the package below `folder`, its modules only."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((folder / "lexspan").rglob("*.py")):
            z.write(p, p.relative_to(folder))
    return target


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application; local masters have it already.

    The archive is made on the driver, which serves it to the executors: they need no folder in common for it.
    """
    context = spark.sparkContext
    if context.master.startswith("local") or context.applicationId in _SHIPPED:
        return
    context.addPyFile(str(archive(Path(__file__).resolve().parents[2], Path(tempfile.mkdtemp()) / "lexspan.zip")))
    _SHIPPED.add(context.applicationId)
