"""Problem 5: percentiles of very large numeric columns, from mergeable digests.

Method: merging centroid digests. The sorted values of a group are cut into clusters whose size depends on the
quantile: a cluster spans at most one unit of ``k(q) = delta / (2 pi) * asin(2 q - 1)``, so clusters are small at the
ends and large in the middle, and there are at most ``delta / 2 + 1``. Digests of parts, files or days are merged by
clustering their centroids again. A second pass counts the values below each estimate and so certifies its error in
rank.

A digest is built of each part (a file or a day, which are hashed into smaller ones where there are very many rows) and
parts are always merged, in a tree: neither a hot group nor its centroids ever have to be in one task. Groups whose
certified error is above the bound are digested again, finer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.skew import heavy_groups, join_groups
from talkgrid.storage import Workspace

#: Fineness of a digest. The rank error is about 1 / delta in the middle and far less at the ends.
DELTA = 400
#: Values in a part of a group, and digests merged at once.
PART_ROWS, FAN_IN = 1_000_000, 64
#: Certified rank error that is accepted, and how much finer and how often groups above it are digested again.
MOST_ERROR, FINER, ROUNDS = 0.005, 8, 3


def _cluster(q: Column, delta: int) -> Column:
    return F.floor(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1))) * (delta / (2 * math.pi)) + delta / 4)


def build_digests(values: DataFrame, keys: list[str], value: str, part: str, delta: int = DELTA) -> DataFrame:
    """A digest of each ``keys`` and ``part``: rows of ``mean``, ``weight``, ``lo``, ``hi``, one for each centroid.

    ``value`` must be finite and not null. Other columns are not read; ``keys`` must not have the names of the result. Groups of up to about ``delta / 3`` values keep most values as they are.
    """
    by = [*keys, part]
    w = Window.partitionBy(*by)
    ranked = values.select(*by, F.col(value).alias("__x")).withColumn("__rank", F.row_number().over(w.orderBy("__x"))).withColumn("__n", F.count(F.lit(1)).over(w))
    clustered = ranked.withColumn("__k", _cluster((F.col("__rank") - 0.5) / F.col("__n"), delta))
    digest = clustered.groupBy(*by, "__k").agg(F.avg("__x").alias("mean"), F.count(F.lit(1)).alias("weight"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    return digest.drop("__k")


def merge_digests(digests: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """One digest for each ``keys`` of any number of digests (of partitions, files, days), by clustering centroids again."""
    w = Window.partitionBy(*keys)
    upto = F.sum("weight").over(w.orderBy("mean", "lo", "hi", "weight").rowsBetween(Window.unboundedPreceding, 0))
    placed = digests.withColumn("__q", (upto - F.col("weight") / 2) / F.sum("weight").over(w))
    return (
        placed.withColumn("__k", _cluster(F.col("__q"), delta))
        .groupBy(*keys, "__k")
        .agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("__k")
    )


def digest_groups(values: DataFrame, keys: list[str], value: str, ident: str, part: str, total: int, delta: int = DELTA) -> DataFrame:
    """A digest of each group of ``values``, of which there are ``total``, merged from digests of its parts.

    ``part`` is a column such as the day or the file (null is a part too). Where there are more than ``PART_ROWS`` values, each
    part is cut further by a hash of ``ident``. Parts are merged ``FAN_IN`` at once, level by level, in one level at least.
    """
    salts = max(1, -(-total // PART_ROWS))
    number = F.xxhash64(part, F.pmod(F.xxhash64(ident), F.lit(salts)))
    digests = build_digests(values.withColumn("__part", number), keys, value, "__part", delta)
    parts = salts * values.select(part).distinct().count()
    while True:
        parts = max(1, -(-parts // FAN_IN))
        digests = merge_digests(digests.withColumn("__part", F.pmod("__part", F.lit(parts))), [*keys, "__part"], delta)
        if parts == 1:
            return digests.drop("__part")


def percentiles(digests: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """``n`` and the estimates ``p0``, ``p1``, ... of each group, interpolated between the middles of centroids.

    Where every centroid is one value, the result is the usual interpolated percentile.
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy("mean", "lo", "hi", "weight")
    placed = (
        digests.withColumn("n", F.sum("weight").over(w))
        .withColumn("m", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2)
        .withColumn("first", F.row_number().over(order) == 1)
        .withColumn("m2", F.lead("m").over(order))
        .withColumn("mean2", F.lead("mean").over(order))
    )
    found = []
    for j, p in enumerate(ps):
        t = f"({float(p)!r}D * (n - 1) + 0.5D)"
        inside = F.expr(f"({t} >= m OR first) AND (m2 IS NULL OR {t} < m2)")
        at = F.expr(
            f"""CASE WHEN {t} < m THEN lo + ({t} - 0.5D) / (m - 0.5D) * (mean - lo)
                WHEN m2 IS NOT NULL THEN mean + ({t} - m) / (m2 - m) * (mean2 - mean)
                WHEN n - 0.5D > m THEN mean + ({t} - m) / (n - 0.5D - m) * (hi - mean) ELSE mean END"""
        )
        found.append(F.max(F.when(inside, at)).alias(f"p{j}"))
    return placed.groupBy(*keys).agg(F.first("n").alias("n"), *found)


def certified(values: DataFrame, estimates: DataFrame, keys: list[str], value: str, ps: list[float], heavy: DataFrame | None) -> DataFrame:
    """``estimates`` with ``rank_error``: the largest share of the group by which an estimate misses its rank.

    Counts the values below and up to each estimate; an estimate equal to repeated values is right for all their ranks.
    """
    joined = join_groups(values.select(*keys, F.col(value).alias("__x")), estimates, keys, heavy)
    counts = []
    for j in range(len(ps)):
        counts += [F.count_if(F.col("__x") < F.col(f"p{j}")).alias(f"__b{j}"), F.count_if(F.col("__x") <= F.col(f"p{j}")).alias(f"__u{j}")]
    counted = joined.groupBy(*keys, "n", *[f"p{j}" for j in range(len(ps))]).agg(*counts)
    # the rank of a percentile is that of interpolation, n - 1 steps from 0 to 1: one value up or down is no error
    miss = [F.expr(f"greatest(0.0D, (__b{j} - 1 - {float(p)!r}D * (n - 1)) / n, ({float(p)!r}D * (n - 1) - __u{j}) / n)") for j, p in enumerate(ps)]
    error = F.greatest(*miss) if len(miss) > 1 else miss[0]
    return counted.select(*keys, "n", *[f"p{j}" for j in range(len(ps))], error.alias("rank_error"))


def certified_percentiles(values: DataFrame, keys: list[str], value: str, ident: str, part: str, ps: list[float], space: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """``keys``, ``n``, ``p0``, ``p1``, ... and the ``rank_error`` of the estimates of each group, as a written table; and its heavy groups.

    ``values`` is a written table. Groups with an error above ``MOST_ERROR`` are digested again with ``FINER`` times the
    fineness, up to ``ROUNDS`` times; what error is left then is that in the result. No values give no rows.
    """
    total = values.count()
    heavy = heavy_groups(values, keys, total, space)
    delta, done, todo = DELTA, None, values
    for step in range(ROUNDS + 1):
        estimates = percentiles(digest_groups(todo, keys, value, ident, part, total, delta), keys, ps)
        found = space.write(certified(todo, estimates, keys, value, ps, heavy), f"certified{step}")
        poor = F.col("rank_error") > MOST_ERROR
        if step == ROUNDS or not found.filter(poor).limit(1).count():
            return (found if done is None else done.unionByName(found)), heavy
        done = found.filter(~poor) if done is None else done.unionByName(found.filter(~poor))
        # only rows of the groups that need it; they lie where they lay
        todo, delta = space.write(join_groups(todo, found.filter(poor).select(*keys), keys, heavy), f"again{step}"), delta * FINER
    raise AssertionError
