"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local (tests on one machine) a local folder is made, and
    stored in the session. On a cluster executors share no local folder, so there a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables that one operator writes in order to cut lineage or to read them more than once.

    A table survives the loss of any executor, as it lies in the shared folder. What is still there when the
    session ends is deleted then; ``drop`` deletes sooner.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/talkgrid-{uuid.uuid4().hex}"
        _LIVE.append((spark, self.root))

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        # the stored schema is that of the data; an explicit one also makes empty tables readable
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table, for rows that several operators read: they are made once."""
    return Workspace(df.sparkSession).write(df, "rows")


@atexit.register
def _clean() -> None:
    for spark, root in _LIVE:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, root)
        except Exception:  # the session is already gone
            pass
