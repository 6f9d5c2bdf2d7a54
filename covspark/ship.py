"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="covspark-")) / "covspark_package.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(here.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                out.write(p, Path(here.name) / p.relative_to(here))
    context.addPyFile(str(at))
    _sent.add(context.applicationId)
