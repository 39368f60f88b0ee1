"""Core operators against brute force, and on odd input."""

import random

import pytest
from pyspark.sql import functions as F

from talkgrid.operators import coverage, drift, intervals, latest, overlap, sequences, skew
from talkgrid.storage import Workspace


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_latest_rows(spark):
    schema = "id bigint, at int, v string, __rank int"
    df = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0), (1, None, "z", 0), (2, 5, "x", 0), (2, 5, "y", 0), (None, 1, "n", 0), (None, 1, "n", 0), (None, 2, "m", 0)], schema)
    out = latest.latest_rows(df, "id", "at", ["v"])
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "b"), (2, "y"), (None, "m"), (None, "n")]
    assert latest.latest_rows(df.limit(0), "id", "at", ["v"]).count() == 0


def test_heavy_groups(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 30_000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    space = Workspace(spark)
    heavy = skew.heavy_groups(df, ["k"], 60_000, space)
    assert [r.k for r in heavy.collect()] == ["hot"]
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.join_groups(df, groups, ["k"], heavy).agg(F.count("*"), F.sum(F.lit(1))).first()[0] == 60_000
    assert skew.heavy_groups(df.limit(0), ["k"], 0, space) is None


def periods(spans, least, most):
    out, groups = [], {}
    for k, s, e in spans:
        if k is not None and s is not None and e is not None and s < e:
            groups.setdefault(k, []).append((s, e))
    for k, own in groups.items():
        merged = []
        for s, e in sorted(own):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([s, e, 1])
        out += [(k, "period", s, e) for s, e, n in merged if n >= least]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= most]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_periods_and_gaps(spark, seed):
    rnd = random.Random(seed)
    spans = []
    for _ in range(400):
        k, s = rnd.choice(["a", "b", None]), rnd.randrange(-300_000, 900_000)
        length = rnd.choice([0, 1, 500, 3000, 65_536, 70_000, 200_000, 400_000]) if seed % 2 else rnd.choice([0, 10, 2000, 4000])
        spans.append((k, s, s + length))
    spans += [("c", 0, 65_536), ("c", 65_536, 131_072), ("c", 131_072, 131_073), ("d", 0, 10), ("d", 0, 10), ("e", 5, 1), ("f", None, 3), ("g", 0, 10**13), ("g", 10**12, 10**12 + 5), ("g", 10**12 + 7, 10**12 + 9), ("g", 10**12 + 20, 10**12 + 21)]
    df = spark.createDataFrame([(k, s, e, 1) for k, s, e in spans], "k string, a bigint, b bigint, n int")
    out = coverage.periods_and_gaps(df, ["k"], "a", "b", min_members=2, max_gap=50_000)
    assert rows(out, "k", "kind", "start_ms", "end_ms") == periods(spans, 2, 50_000)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], "k string, a bigint, b bigint")
    assert coverage.periods_and_gaps(df, ["k"], "a", "b").collect() == []


def lines(*payloads, export=1, at=1):
    return [(export, "segments", "st", at, i, p) for i, p in enumerate(payloads)]


def report(spark, data):
    df = spark.createDataFrame(data, "export_id bigint, artefact string, station string, written_at int, line_no int, payload string")
    return rows(drift.drift_report(drift.load_records(df)), "export_id", "field_name", "change")


KEY = '"file_id":"f","speaker_id":"s","start":1.0'


def test_drift_changes(spark):
    data = lines(f'{{{KEY},"a":1,"b":"x","c":null,"old":true}}', export=1, at=1)
    data += lines(f'{{{KEY},"a":"1","c":2,"new":true,"d":[1]}}', f'{{{KEY},"a":"1","c":2,"new":true,"d":[1]}}', export=2, at=2)
    data += lines(f'{{{KEY},"a":null,"c":"NaN","new":true,"d":[]}}', export=3, at=3)
    data += lines(f'{{{KEY},"a":2,"c":2,"new":true,"d":{{}}}}', export=4, at=4)
    assert report(spark, data) == [(2, "a", "retyped"), (2, "b", "removed"), (2, "d", "added"), (2, "new", "renamed"), (4, "a", "retyped"), (4, "d", "retyped")]


def test_drift_lines_that_are_no_record(spark):
    good, bad = f'{{{KEY},"a":1}}', ["", None, "null", "[1]", "5", '{"z":1', '{"z":1}}', '{"z":1} x', '{"z":1},{"z":2}', '{"z":1}]', "{'z':1}", '{"z":1,}', '{"z":NaN}', "# rotated"]
    assert report(spark, lines(good) + lines(good, *bad, export=2, at=2)) == []
    assert report(spark, lines(good) + lines("", export=2, at=2)) == [(2, "a", "removed")]
    assert report(spark, []) == []
    assert report(spark, lines(f'{{{KEY},"a":1}}') + lines(f'{{{KEY},"a":"x","a":2}}', export=2, at=2)) == []


def test_drift_with_nulls(spark):
    data = [(None, "segments", "st", 1, 1, f'{{{KEY},"z":1}}'), (1, None, None, None, None, f'{{{KEY},"a":1}}'), (2, None, None, 5, 1, f'{{{KEY},"b":1}}'), (3, "segments", "st", 1, 1, None)]
    assert report(spark, data) == [(2, "b", "renamed")]


def test_drift_needs_agreement_in_all_records(spark):
    two = lambda f, a, b: [f'{{"file_id":"f","speaker_id":"s","start":{k},"{f}":{v}}}' for k, v in ((1, a), (2, b))]
    assert report(spark, lines(*two("a", 1, 2)) + lines(*two("b", "1.0", 2), export=2, at=2)) == [(2, "b", "renamed")]
    assert report(spark, lines(*two("a", 1, 2)) + lines(*two("b", 1, 3), export=2, at=2)) == [(2, "a", "removed"), (2, "b", "added")]
    assert report(spark, lines(*two("a", 1, 2)) + lines(*two("b", 1, '"2"'), export=2, at=2)) == [(2, "a", "removed"), (2, "b", "added")]
    assert report(spark, lines(*two("a", "null", '""')) + lines(*two("b", '"NaN"', "null"), export=2, at=2)) == [(2, "a", "removed"), (2, "b", "added")]


def test_typed_projection(spark):
    data = lines('{"file_id":"f","start":"1.5","n":1,"note":"x"}', '{"n":"7"}', '{"n":"seven"}', '{"n":2,"file":{"a":1}}', "broken")
    df = spark.createDataFrame(data, "export_id bigint, artefact string, station string, written_at int, line_no int, payload string")
    records = drift.load_records(df)
    table, failed = drift.consistent_table(records)
    assert sorted(r.n for r in table.collect() if r.n is not None) == [1, 2, 7]
    assert {r.field_name: (r.type, r["values"], r.failed) for r in failed.collect()} == {"n": ("bigint", 4, 1), "note": ("string", 1, 0), "file": ("string", 1, 0)}
    assert table.count() == 4 and [r.start for r in table.collect() if r.start] == [1.5]


def exports(spark, *data):
    """Records of lines (export, station, time, payload)."""
    rows = [(e, "segments", station, at, i, payload) for i, (e, station, at, payload) in enumerate(data)]
    return drift.load_records(spark.createDataFrame(rows, "export_id bigint, artefact string, station string, written_at int, line_no int, payload string"))


def test_renaming_of_one_station_moves_no_values_of_another(spark):
    a = lambda e, f, v: (e, "A", e, f'{{{KEY},"{f}":{v}}}')
    records = exports(spark, a(1, "snr", 5), a(2, "level", 5), a(3, "level", 6), (4, "B", 1, f'{{{KEY},"snr":7,"level":99}}'), (5, "C", 1, f'{{{KEY},"level":8}}'))
    table, casts = drift.consistent_table(records)
    by = {r.export_id: (r.snr, r.level) for r in table.collect()}
    # level is in most records, so the line of A goes there; both fields of B stay what they are
    assert by == {1: (None, 5), 2: (None, 5), 3: (None, 6), 4: (7, 99), 5: (None, 8)}
    found = {(r.export_id, r.field_name): (r.column_name, r["values"], r.failed) for r in casts.collect()}
    assert found[1, "snr"] == ("level", 1, 0) and found[4, "snr"] == ("snr", 1, 0) and found[4, "level"] == ("level", 1, 0) and len(found) == 6
    assert {(r.export_id, r.column_name, r.value) for r in drift.consistent_values(records).collect()} == {(1, "level", "5"), (2, "level", "5"), (3, "level", "6"), (4, "snr", "7"), (4, "level", "99"), (5, "level", "8")}


def test_a_former_name_that_comes_back_keeps_its_values(spark):
    a = lambda e, *f: (e, "A", e, f'{{{KEY},{",".join(f)}}}')
    records = exports(spark, a(1, '"x":5'), a(2, '"y":5'), a(3, '"y":6', '"x":1'), a(4, '"z":6', '"x":1'), a(5, '"z":7', '"x":2'), a(6, '"z":7'))
    rows = {r.export_id: {c: r[c] for c in "xyz" if c in r and r[c] is not None} for r in drift.consistent_table(records)[0].collect()}
    # one line x, y, z, of which z is in most records; and another x
    assert rows == {1: {"z": 5}, 2: {"z": 5}, 3: {"z": 6, "x": 1}, 4: {"z": 6, "x": 1}, 5: {"z": 7, "x": 2}, 6: {"z": 7}}


def test_whole_numbers_keep_their_digits(spark):
    one, other = 9007199254740993, 9007199254740992
    records = exports(spark, (1, "A", 1, f'{{{KEY},"n":{one},"d":1.5,"w":12345678901234567890.5,"e":1e3}}'), (2, "A", 2, f'{{{KEY},"m":{other},"d":1,"w":1,"e":1000}}'))
    assert {(r.field_name, r.change) for r in drift.drift_report(records).collect()} == {("n", "removed"), ("m", "added")}
    table = drift.consistent_table(records)[0]
    kinds = dict(table.dtypes)
    assert (kinds["n"], kinds["d"], kinds["w"], kinds["e"]) == ("bigint", "double", "decimal(38,18)", "bigint")
    first = {r.export_id: r for r in table.collect()}
    assert first[1].n == one and first[2].m == other and str(first[1].w).rstrip("0") == "12345678901234567890.5" and first[1].e == first[2].e == 1000


def test_fields_beyond_the_most_columns_stay_in_a_map(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_COLUMNS", 2)
    table = drift.consistent_table(exports(spark, (1, "A", 1, f'{{{KEY},"a":1,"b":2,"c":3}}'), (2, "A", 2, f'{{{KEY},"a":1,"b":2,"File_ID":4}}')))[0]
    rows = {r.export_id: (r.a, r.b, r.other_fields) for r in table.collect()}
    assert rows == {1: (1, 2, {"c": "3"}), 2: (1, 2, {"File_ID": "4"})}


def test_renaming_evidence_with_repeated_keys(spark):
    a = lambda e, *f: [(e, "A", e, f'{{{KEY},"i":{i},{x}}}') for i, x in enumerate(f)]
    same = exports(spark, *a(1, '"x":5', '"x":5'), *a(2, '"y":5', '"y":5'))
    assert [(r.field_name, r.change) for r in drift.drift_report(same).collect()] == [("y", "renamed")]
    other = exports(spark, *a(1, '"x":5', '"x":6'), *a(2, '"y":6', '"y":5'))
    assert len(drift.drift_report(other).collect()) == 2


def test_run_containers_unite_to_the_set_units():
    import numpy as np

    rnd = random.Random(5)
    spans = [(g, a, a + rnd.randrange(1, 9), 1) for g in range(4) for a in (rnd.randrange(200) for _ in range(30))]
    group, s, e, n = coverage.unite(*map(np.array, zip(*spans)))
    for g in range(4):
        bits = {t for k, a, b, _ in spans if k == g for t in range(a, b)}
        runs = [(int(a), int(b)) for k, a, b in zip(group, s, e) if k == g]
        assert {t for a, b in runs for t in range(a, b)} == bits and all(b < a for (_, b), (a, _) in zip(runs, runs[1:]))
    assert n.sum() == len(spans)
    # united in two parts, and their containers again: the same
    half = [coverage.unite(*map(np.array, zip(*part))) for part in (spans[::2], spans[1::2])]
    assert all((x == y).all() for x, y in zip(coverage.unite(*map(np.concatenate, zip(*half))), (group, s, e, n)))


@pytest.mark.parametrize("rows", [3, 10_000])
def test_containers_of_batches_of_any_size(spark, rows):
    """Few rows a batch: containers lie across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    rnd = random.Random(6)
    data = [(rnd.choice("abc"), rnd.randrange(3), a, a + rnd.randrange(1, 60)) for a in (rnd.randrange(3000) for _ in range(400))]
    df = spark.createDataFrame(data, "k string, shard bigint, s bigint, e bigint").withColumn("n", F.lit(1).cast("bigint"))
    found = {(r.k, r.shard): (r.s, r.e, r.n) for r in coverage._containers(df.repartition(5), ["k", "shard"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 9
    for key, (s, e, n) in found.items():
        bits = {t for k, j, a, b in data if (k, j) == key for t in range(a, b)}
        assert {t for a, b in zip(s, e) for t in range(a, b)} == bits and all(b < a for b, a in zip(e, s[1:])) and sum(n) == sum((k, j) == key for k, j, _, _ in data)


@pytest.mark.parametrize("block", [50, 10**9])
def test_previous_and_last_known(spark, block):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.randrange(400), i, rnd.choice([None, i])) for i in range(120)]
    df = spark.createDataFrame(data, "k string, t bigint, i bigint, v bigint")
    got = {r.i: r.prev_v for r in sequences.with_previous(df, ["k"], ["t", "i"], ["v"], block).collect()}
    known = {r.i: r.w for r in sequences.with_last_known(df, ["k"], ["t", "i"], F.col("v"), "w", block).collect()}
    position = {r.i: r.pos for r in sequences.with_position(df, ["k"], ["t", "i"], block).collect()}
    for k in "ab":
        before, last = None, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))):
            last = v if v is not None else last
            assert (got[i], known[i], position[i]) == (before, last, n)
            before = v


@pytest.mark.parametrize("block", [7, 8192])
def test_hysteresis(spark, block):
    rnd = random.Random(5)
    scores = [None if rnd.random() < 0.1 else rnd.random() for _ in range(200)]
    df = spark.createDataFrame([("x", i, i, i + 2, s) for i, s in enumerate(scores)], "k string, frame bigint, t0 bigint, t1 bigint, score double")
    out, start, peak = [], None, 0
    for i, s in enumerate(scores):
        if s is None:
            continue
        if start is None and s >= 0.7:
            start, peak = i, s
        elif start is not None:
            peak = max(peak, s)
            if s <= 0.3:
                out.append((start, i, peak))
                start = None
    if start is not None:
        out.append((start, len(scores) - 1, peak))
    assert rows(sequences.hysteresis(df, ["k"], 0.7, 0.3, block), "first", "last", "peak") == out
    with pytest.raises(ValueError):
        sequences.hysteresis(df, ["k"], 0.5, 0.5)


@pytest.mark.parametrize("block", [4, 8192])
def test_median_filter(spark, block):
    rnd = random.Random(1)
    x = [rnd.random() for _ in range(30)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, frame bigint, score double")
    padded = [x[0]] * 2 + x + [x[-1]] * 2
    want = [(i, sorted(padded[i : i + 5])[2]) for i in range(30)]
    assert rows(sequences.median_filter(df, ["k"], 5, block), "frame", "smooth") == want


def test_gap_merge(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 20, 30), ("a", 41, 50), ("a", 5, 8)], "k string, s bigint, e bigint")
    assert rows(sequences.gap_merge(df, ["k"], 10), "s", "e", "members") == [(0, 30, 3), (41, 50, 1)]


def test_self_overlaps(spark):
    rnd = random.Random(9)
    data = [(rnd.choice("fg"), i, rnd.choice("AB"), s, s + rnd.randrange(0, 4000)) for i, s in enumerate(rnd.randrange(0, 30_000) for _ in range(120))]
    df = spark.createDataFrame(data, "file_id string, idx bigint, speaker_id string, s bigint, e bigint")
    want = []
    for a in data:
        for b in data:
            if a[0] == b[0] and (a[3], a[1]) < (b[3], b[1]) and a[3] < b[4] and b[3] < a[4] and min(a[4], b[4]) - b[3] >= 50:
                want.append((a[1], b[1], min(a[4], b[4]) - b[3]))
    for width in (100, 10_000):
        got = intervals.self_overlaps(df, ["file_id"], width, 50).select("early.idx", F.col("late.idx").alias("other"), "overlap")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    fold = overlap.interruption_fold(overlap.pairs(df))
    assert fold.agg(F.sum("made"), F.sum("received")).first()[0] == overlap.interruptions(overlap.pairs(df)).count()


def test_windows(spark):
    df = spark.createDataFrame([("a", 0, 3500), ("b", 0, 0)], "name string, s bigint, e bigint")
    assert rows(intervals.windows(df, 1500, 750, least=600), "name", "ws", "we") == [("a", 0, 1500), ("a", 750, 2250), ("a", 1500, 3000), ("a", 2250, 3500)]
    assert rows(intervals.windows(df, 1500, 750, keep_tail=False), "name", "ws", "we") == [("a", 0, 1500), ("a", 750, 2250), ("a", 1500, 3000)]


def test_survives_without_checkpoint_dir(spark):
    space = Workspace(spark)
    assert space.write(spark.range(3), "t").count() == 3
    space.drop("t")
