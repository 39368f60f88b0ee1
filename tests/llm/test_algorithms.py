"""Top N, nearest match and percentiles against brute force, and on odd input."""

import random

import pytest
from pyspark.sql import functions as F

from talkgrid.llm import digest
from talkgrid.llm.digest import DELTA, build_digests, certified, digest_groups, merge_digests, percentiles
from talkgrid.llm.nearest import nearest_join, neighbour_intervals
from talkgrid.llm.topn import double_code, top_n_per_group
from talkgrid.operators.skew import heavy_groups
from talkgrid.storage import Workspace


def best(data, n, decimals):
    groups = {}
    for k, s, i in set(data):
        if k is not None and s is not None and s == s and i is not None:
            groups.setdefault(k, set()).add((-round(s, decimals) if decimals is not None else -s, i))
    return sorted((k, i) for k, g in groups.items() for _, i in sorted(g)[:n])


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_code_orders_like_the_number(spark):
    values = [float("-inf"), -1e308, -2.5, -1.0, -5e-324, 0.0, 5e-324, 2.2250738585072014e-308, 1e-300, 0.1, 0.5, 1.0, 1.0000000000000002, 2.0, 3.0, 1e16, 1.7e308, float("inf")]
    rnd = random.Random(0)
    values = sorted({*values, *(rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(-300, 300) for _ in range(500)), *(2.0**k for k in range(-1074, 1024, 7))})
    codes = [r.c for r in spark.createDataFrame([(v,) for v in values], "x double").orderBy("x").select(double_code(F.col("x")).alias("c")).collect()]
    assert all(a < b for a, b in zip(codes, codes[1:]))
    assert spark.range(1).select(double_code(F.lit(-0.0)) == double_code(F.lit(0.0))).first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_top_n(spark, seed):
    rnd = random.Random(seed)
    scores = [None, float("nan"), -3.5, 0.0, 0.25, 0.25004, 0.25006, 1e9, float("inf")]
    data = [(rnd.choice(["a", "b", "c", None]), rnd.choice(scores) if rnd.random() < 0.5 else rnd.gauss(0, 1), rnd.choice([None, *range(40), -5])) for _ in range(600)]
    data += data[:50] + [("one", 1.0, 7), ("tie", 2.0, 2**62), ("tie", 2.0, -(2**62)), ("tie", 2.0, 0), ("tie", 2.0, 1)]
    df = spark.createDataFrame([(k, s, i, 1, 2, 3) for k, s, i in data], "g string, score double, id bigint, c int, lo int, need int")
    for n, decimals in ((3, 4), (1, None), (10, None)):
        rounded = [(k, s, i) for k, s, i in data]
        assert found(top_n_per_group(df, ["g"], "score", "id", n, decimals), "g", "id") == best(rounded, n, decimals)


def test_top_n_of_a_hot_group(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 9000).cast("string"))).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("s"), "id")
    df = df.unionByName(spark.range(60_000, 90_000).select(F.lit("same").alias("g"), F.lit(0.5).alias("s"), "id"))
    got = {r.g: r.n for r in top_n_per_group(df, ["g"], "s", "id", 3, unique=True).groupBy("g").count().withColumnRenamed("count", "n").collect()}
    want = {r.g: min(3, r["count"]) for r in df.groupBy("g").count().collect()}
    assert got == want
    assert found(top_n_per_group(df.filter("g = 'same'"), ["g"], "s", "id", 2), "id") == [(60_000,), (60_001,)]


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, s double, id bigint")
    out = top_n_per_group(df, ["g"], "s", "id", 3)
    assert out.collect() == [] and out.columns == ["g", "id"]


def pairs(left, right, tolerance):
    out = []
    for k, t, i in left:
        if k is None or t is None:
            continue
        near = sorted((abs(t - u), u, j) for h, u, j in right if h == k and u is not None and j is not None and abs(t - u) <= tolerance)
        if near:
            out.append((near[0][2], i))
    return sorted(out)


@pytest.mark.parametrize("seed,tolerance", [(0, 750), (1, 10), (2, 0), (3, 1)])
def test_nearest(spark, seed, tolerance):
    rnd = random.Random(seed)
    wide = 40 * max(tolerance, 2)
    side = lambda n: [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(-wide, wide * 3)]), i) for i in range(n)]
    left, right = side(300), side(200)
    right += right[:20] + [("a", 5, 999), ("a", 5, 3)]
    l = spark.createDataFrame([(*r, 1) for r in left], "f string, t bigint, e bigint, lo int")
    r = spark.createDataFrame([(*r, 1) for r in right], "f string, t bigint, s bigint, lo int")
    assert found(nearest_join(l, r, ["f"], "e", "t", "s", "t", tolerance), "s", "e") == pairs(left, right, tolerance)


def test_nearest_of_nothing_and_of_a_hot_bucket(spark):
    r = spark.createDataFrame([("a", 0, 1), ("a", 20, 2)], "f string, t bigint, s bigint")
    l = spark.range(30_000).select(F.lit("a").alias("f"), (F.col("id") % 30).alias("t"), F.col("id").alias("e"))
    got = {x.s: x["count"] for x in nearest_join(l, r, ["f"], "e", "t", "s", "t", 750).groupBy("s").count().collect()}
    assert got == {1: 11_000, 2: 19_000}
    assert nearest_join(l.limit(0), r, ["f"], "e", "t", "s", "t", 750).count() == 0
    assert nearest_join(l.limit(5), r.limit(0), ["f"], "e", "t", "s", "t", 750).count() == 0


def test_intervals_do_not_overlap(spark):
    rnd = random.Random(4)
    times = sorted(rnd.sample(range(-5000, 500_000), 400))
    got = sorted((r.lo, r.hi) for r in neighbour_intervals(spark.createDataFrame([("a", t) for t in times], "f string, t bigint"), ["f"], 750).collect())
    assert all(a[1] < b[0] for a, b in zip(got, got[1:])) and len(got) == 400


def test_percentiles_are_near_and_certified(spark):
    rnd = random.Random(6)
    data = [("big", rnd.lognormvariate(0, 2), i) for i in range(20_000)] + [("two", 1.0, 30_001), ("two", 3.0, 30_002), ("one", 5.0, 30_003)] + [("same", 2.0, 40_000 + i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v double, id bigint").withColumn("hi", F.lit(1))
    ps = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    estimates = percentiles(digest_groups(df, ["k"], "v", "id", "hi", len(data)), ["k"], ps)
    got = {r.k: r for r in certified(df, estimates, ["k"], "v", ps, heavy_groups(df, ["k"], len(data), Workspace(spark))).collect()}
    assert got["big"].rank_error < 1 / DELTA and got["same"].p2 == 2.0 and got["same"].rank_error == 0.0
    assert (got["two"].p0, got["two"].p2, got["two"].p5, got["one"].p2) == (1.0, 2.0, 3.0, 5.0)
    values = sorted(v for k, v, _ in data if k == "big")
    assert got["big"].p0 == values[0] and got["big"].p5 == values[-1]


def test_parts_are_always_merged(spark, monkeypatch):
    merged = []
    monkeypatch.setattr(digest, "merge_digests", lambda d, keys, delta: merged.append(keys) or merge_digests(d, keys, delta))
    df = spark.createDataFrame([("a", float(i), i, day) for i in range(50) for day in (1, None)], "k string, v double, id bigint, day int")
    r = percentiles(digest_groups(df, ["k"], "v", "id", "day", 100), ["k"], [0.5]).first()
    assert len(merged) == 1 and (r.n, r.p0) == (100, pytest.approx(24.5))
    monkeypatch.setattr(digest, "PART_ROWS", 1)
    monkeypatch.setattr(digest, "FAN_IN", 8)
    r = percentiles(digest_groups(df, ["k"], "v", "id", "day", 100), ["k"], [0.5]).first()
    assert len(merged) == 1 + 3 and (r.n, r.p0) == (100, pytest.approx(24.5))  # 200 parts, 25, 4, 1


def test_groups_with_too_large_an_error_are_digested_again(spark, monkeypatch):
    monkeypatch.setattr(digest, "DELTA", 8)
    rnd = random.Random(8)
    data = [(k, rnd.lognormvariate(0, 3), i, i % 5) for k, n in (("big", 9000), ("small", 3)) for i in range(n)]
    space = Workspace(spark)
    df = space.write(spark.createDataFrame(data, "k string, v double, id bigint, day int"), "values")
    rough = percentiles(digest_groups(df, ["k"], "v", "id", "day", len(data), 8), ["k"], [0.1, 0.5, 0.9])
    assert certified(df, rough, ["k"], "v", [0.1, 0.5, 0.9], None).agg(F.max("rank_error")).first()[0] > digest.MOST_ERROR
    found, _ = digest.certified_percentiles(df, ["k"], "v", "id", "day", [0.1, 0.5, 0.9], space)
    assert {r.k: r.n for r in found.collect()} == {"big": 9000, "small": 3} and found.agg(F.max("rank_error")).first()[0] <= digest.MOST_ERROR
    empty, heavy = digest.certified_percentiles(space.write(df.limit(0), "none"), ["k"], "v", "id", "day", [0.5], space)
    assert empty.collect() == [] and heavy is None


def test_digests_of_days_can_be_joined(spark):
    df = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 30_000).cast("double").alias("v"), (F.col("id") % 7).alias("day"))
    daily = build_digests(df, ["k"], "v", "day")
    joined = merge_digests(daily, ["k"])
    assert joined.count() <= DELTA / 2 + 2 and joined.agg(F.sum("weight")).first()[0] == 30_000
    r = percentiles(joined, ["k"], [0.1, 0.5, 0.9]).first()
    assert r.p0 == pytest.approx(3000, abs=80) and r.p1 == pytest.approx(15_000, abs=160) and r.p2 == pytest.approx(27_000, abs=80)
    assert percentiles(joined.limit(0), ["k"], [0.5]).count() == 0
