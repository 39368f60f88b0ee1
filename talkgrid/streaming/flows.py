"""Structured Streaming variants. Streams of events have ``event_id``, ``ts`` (timestamp), ``user_id``, ``event_type``, ``value``.

The lateness is ours to choose: rows more than ``LATENESS`` behind the newest one are dropped by the stateful operators.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkgrid.storage import Workspace

LATENESS = "10 minutes"


def stream_table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A parquet table as a stream; new files in a table's folder are read as they come."""
    path = f"{sf}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if os.path.isfile(path):  # a table of one file: the folder, with a filter on names
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf)
    return reader.parquet(path)


def timed(stream: DataFrame, column: str = "ts", lateness: str = LATENESS) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Rows, and sum of values, of each type and window."""
    by = timed(stream).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return by.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    by = timed(stream).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: periods in which no two events in a row are ``gap`` apart."""
    by = timed(stream).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each of ``keys``; give a time within the watermark as a key to bound the state."""
    return stream.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Pairs of a left and a later right event of the same user, at most ``within`` apart."""
    a = timed(left).select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u1"), F.col("ts").alias("t1"))
    b = timed(right).select(F.col("event_id").alias("right_id"), F.col("user_id").alias("u2"), F.col("ts").alias("t2"))
    return a.join(b, F.expr(f"u1 = u2 AND t2 > t1 AND t2 <= t1 + INTERVAL {within}")).select("left_id", "right_id")


def stream_hysteresis(stream: DataFrame, enter: float, leave: float) -> DataFrame:
    """Runs of each type whose value rises to ``enter`` and falls to ``leave``: ``start_us``, ``end_us``, ``peak``.

    A run comes out when it ends. Rows of a micro-batch are taken in order of time; the state of a type is whether a
    run is open, its start and its peak.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, peak = state.get if state.exists else (-1, 0.0)
        rows: list[dict[str, Any]] = []
        for row in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            if start < 0 and row.value >= enter:
                start, peak = row.us, row.value
            elif start >= 0:
                peak = max(peak, row.value)
                if row.value <= leave:
                    rows.append({"event_type": key[0], "start_us": start, "end_us": row.us, "peak": peak})
                    start = -1
        state.update((start, peak))
        yield pd.DataFrame(rows, columns=["event_type", "start_us", "end_us", "peak"])

    rows = stream.select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return rows.groupBy("event_type").applyInPandasWithState(update, "event_type string, start_us bigint, end_us bigint, peak double", "start bigint, peak double", "append", GroupStateTimeout.NoTimeout)


def stream_registry(stream: DataFrame, name: str, vector: str, alpha: float = 0.30) -> DataFrame:
    """Centroids of names, moved by each vector as it comes: ``name``, ``centroid``, ``samples``; the last row of a name counts."""
    import numpy as np

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centroid, samples = state.get if state.exists else ([], 0)
        c = np.asarray(centroid, float)
        for batch in batches:
            for v in batch["v"]:
                x = np.asarray(v, float)
                c = x if samples == 0 else (1 - alpha) * c + alpha * x
                c = c / (np.linalg.norm(c) + 1e-9)
                samples += 1
        state.update((c.tolist(), samples))
        yield pd.DataFrame({"name": [key[0]], "centroid": [c.tolist()], "samples": [samples]})

    rows = stream.select(F.col(name).cast("string").alias("name"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("name").applyInPandasWithState(update, "name string, centroid array<double>, samples bigint", "centroid array<double>, samples bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str, spark: SparkSession | None = None) -> DataFrame:
    """All that is available of a stream, worked off into a table in the shared folder.

    Mode ``complete`` keeps the last result, ``append`` all rows. Checkpoints lie in the shared folder, so a run
    survives the loss of executors.
    """
    spark = spark or stream.sparkSession
    space = Workspace(spark)
    path = f"{space.root}/out"

    def write(df: DataFrame, epoch: int) -> None:
        # an epoch that is repeated after a failure overwrites its own folder
        df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{space.root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
