"""The training-data queries on the smallest tables."""

import pytest
from conftest import oracle, same_rows

from talkgrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_percentiles_are_within_their_bound(spark, sf):
    """The ranks of all estimates, counted by another engine, are off by no more than the certified error."""
    found = queries.p5_percentiles(spark, sf).toPandas()
    assert len(found) and found["rank_error"].max() <= 0.005
    con = oracle(sf)
    con.register("found", found)
    latest = "(SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1)"
    values = " UNION ALL ".join(f"SELECT speaker_id, '{m}' AS field_name, {m} AS x FROM {latest} WHERE {m} > 0 AND NOT isnan({m}) AND trim(speaker_id) <> ''" for m in queries.MEASURES)
    for p in queries.PERCENTILES:
        c = f"p{round(p * 100)}"
        off, groups, exact = con.execute(
            f"""SELECT max(greatest(below - 1 - {p} * (n - 1), {p} * (n - 1) - upto) / n - rank_error), count(*), max(CASE WHEN n <= 20 THEN abs({c} - q) END)
            FROM (SELECT speaker_id, field_name, count(*) AS m, quantile_cont(x, {p}) AS q FROM ({values}) GROUP BY ALL) JOIN found USING (speaker_id, field_name)
            JOIN (SELECT speaker_id, field_name, count(*) FILTER (x < {c}) AS below, count(*) FILTER (x <= {c}) AS upto FROM ({values}) JOIN found USING (speaker_id, field_name) GROUP BY ALL) USING (speaker_id, field_name)
            WHERE m = n"""
        ).fetchone()
        assert off <= 1e-9 and groups == len(found) and exact < 1e-9


def test_ids_of_all_documents(spark, con):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    want = {d: e.ids for (d, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False))}
    assert {r.doc_id: list(r.ids) for r in queries.p6_ids(spark, SF).collect()} == want


def test_sources_that_fall_short(spark, con):
    """The definition of problem 7, from the ids themselves."""
    counts = {r.doc_id: len(r.ids) for r in queries.p6_ids(spark, SF).collect()}
    sizes = {}
    for doc, source in con.execute("SELECT doc_id, lower(trim(source)) FROM documents WHERE source IS NOT NULL").fetchall():
        sizes[source] = sizes.get(source, 0) + counts[doc]
    targets = con.execute("SELECT lower(trim(source)), target_share, max_repeats FROM mix_targets").fetchall()
    total = sum(sizes.get(s, 0) for s, _, _ in targets)
    want = sorted(s for s, share, most in targets if most * sizes.get(s, 0) < share * total)
    assert sorted(r.source for r in queries.p7_found(spark, SF).collect()) == want
