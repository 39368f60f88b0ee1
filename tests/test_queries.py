"""Every core query with SQL gives the rows of its SQL on the smallest tables; the others run."""

import pytest
from conftest import oracle, same_rows

from talkgrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    same_rows(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["sed_events", "hysteresis_events", "hysteresis_min_frames", "conversation_metrics", "narrative_insights", "speaker_rollup", "response_latency", "same_speaker_merge", "median_filter_frames", "topic_coherence_jaccard"])
def test_source_tables_are_read_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Scan parquet" in line and "testdata" in line for line in plan.splitlines()) <= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
