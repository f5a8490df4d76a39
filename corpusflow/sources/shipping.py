"""Sends the package to executors that can't import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import corpusflow

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file of the application, once, unless the workers' search
    path has its folder: they inherit PYTHONPATH and, on one machine, the working folder."""
    root = Path(corpusflow.__file__).resolve().parent.parent
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if spark.sparkContext.applicationId in _sent or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/corpusflow", "zip", root, "corpusflow")
    spark.sparkContext.addPyFile(archive)
    _sent.add(spark.sparkContext.applicationId)
