"""Gives executors this package where they cannot import it from a path they share with the driver."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _done or str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="tracemill-")) / "tracemill.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(_PACKAGE.rglob("*.py")):
            archive.write(module, module.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _done.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
