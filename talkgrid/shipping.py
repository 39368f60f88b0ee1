"""Brings the package to Python workers that can't import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SENT: set[str] = set()


def workers_find_it(spark: SparkSession) -> bool:
    """Whether workers have the package's folder on their path: by PYTHONPATH, or as working folder where they are local."""
    path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    master = spark.sparkContext.master
    return _ROOT in path or (master.split("[")[0] == "local" and os.path.abspath(os.getcwd()) == _ROOT)


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers of this session, once, if they don't have it.

    The archive is made in the driver's temporary folder and served by Spark to each executor, as with ``--py-files``.
    """
    application = spark.sparkContext.applicationId
    if application in _SENT or workers_find_it(spark):
        return
    _SENT.add(application)
    folder = tempfile.mkdtemp(prefix="talkgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/talkgrid", "zip", _ROOT, "talkgrid"))
