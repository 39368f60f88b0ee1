"""Streams in several batches: late rows, state across batches, and the same results as one batch."""

import datetime as dt

import pytest

from talkgrid.streaming import flows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def stream(spark, folder, batches):
    """A stream that reads one file a batch, in order."""
    import os
    import shutil
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), u, k, v) for e, m, u, k, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
        name = next(f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.move(f"{folder}/part{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (time.time() - 100 + i,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[(1, 5, 1, "a", 1.0), (2, 10, 1, "a", 2.0)], [(3, 200, 1, "a", 3.0)], [(7, 201, 1, "a", 1.0)], [(4, 6, 1, "a", 50.0), (5, 195, 1, "a", 4.0)], [(6, 400, 1, "a", 5.0)]]
    out = flows.run_to_table(flows.tumbling(stream(spark, tmp_path, batches)), "append")
    got = {r.start_us // 3_600_000_000 - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600: (r.n, r.total) for r in out.collect()}
    assert got == {0: (2, 3.0), 3: (3, 8.0)}  # the row of minute 6 came after its window had closed


def test_runs_go_on_across_batches(spark, tmp_path):
    batches = [[(1, 1, 1, "a", 10.0), (2, 2, 1, "a", 90.0)], [(3, 3, 1, "a", 95.0), (4, 4, 1, "b", 85.0)], [(5, 5, 1, "a", 5.0), (6, 6, 1, "b", 30.0)]]
    out = flows.run_to_table(flows.stream_hysteresis(stream(spark, tmp_path, batches), 80, 20), "append").collect()
    assert [(r.event_type, (r.end_us - r.start_us) // 60_000_000, r.peak) for r in out] == [("a", 3, 95.0)]


def test_repeated_rows_come_out_once(spark, tmp_path):
    batches = [[(1, 1, 1, "a", 1.0), (1, 1, 1, "a", 1.0)], [(1, 1, 1, "a", 1.0), (2, 2, 1, "a", 1.0)]]
    out = flows.run_to_table(flows.deduplicated(stream(spark, tmp_path, batches), ["event_id"]), "append")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_registry_state(spark, tmp_path):
    from pyspark.sql import functions as F

    batches = [[(1, 1, 1, "a", 1.0)], [(2, 2, 1, "a", 0.0), (3, 3, 1, "b", 0.0)]]
    rows = stream(spark, tmp_path, batches).select("event_type", F.array("value", 1 - F.col("value")).alias("v"))
    found = flows.run_to_table(flows.stream_registry(rows, "event_type", "v", 0.5), "update").collect()
    last = {r.name: r for r in sorted(found, key=lambda r: r.samples)}
    assert last["a"].samples == 2 and last["a"].centroid == pytest.approx([0.5**0.5, 0.5**0.5]) and last["b"].centroid == pytest.approx([0.0, 1.0])
