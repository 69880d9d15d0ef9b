"""Getting the package to the Python workers."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_PACKAGES = ("skilltrend", "standin")
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to all workers once per application.

    Workers need not start in the folder of the repository, nor see it.
    """
    application = spark.sparkContext.applicationId
    if application in _done:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="skilltrend-ship-"), "skilltrend_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for package in _PACKAGES:
            for folder, _, files in os.walk(os.path.join(_ROOT, package)):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _done.add(application)


def shipped(query: Query) -> Query:
    """``query``, with the package sent before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
