"""Problem 4: the record of another table that is nearest in time.

Method: the right side's times become nearest-neighbour intervals. Each distinct time owns the instants from the
midpoint to the time before it up to the midpoint to the next one, no further than the tolerance. These intervals
don't overlap, so a left time lies in at most one; a range join over an index partitioned by group and time bucket
finds it.

Neighbours are looked up inside blocks of time that also see what lies just outside them, so a hot group is spread
over its blocks and a block holds at most its length in distinct times. A bucket is wider than an interval, so an
interval is in at most two; it holds at most ``2 * tolerance + 1`` intervals, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.skew import heavy_groups
from talkgrid.storage import Workspace

#: Length of a block in tolerances, for finding neighbours.
BLOCK = 64
#: Parts into which the left rows of a busy bucket are split.
SALTS = 32


def neighbour_intervals(times: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Intervals [lo, hi] of the times ``t`` (bigint, distinct by ``keys``) to which ``t`` is the nearest.

    A time in the middle of two belongs to the earlier. The other columns of ``times`` are kept.
    """
    reach = 2 * tolerance  # a neighbour further away doesn't narrow an interval
    block = BLOCK * max(tolerance, 1)
    at = lambda d: f"floor((t + {d}) / {block}.0D)"
    # a time is in its own block, and known to the ones that it can influence
    blocks = F.array_distinct(F.array(*[F.expr(at(d)).cast("bigint") for d in (0, -reach, reach)]))
    spread = times.withColumn("block", F.explode(blocks))
    w = Window.partitionBy(*keys, "block").orderBy("t")
    spread = spread.withColumn("before", F.lag("t").over(w)).withColumn("after", F.lead("t").over(w))
    own = spread.filter(F.col("block") == F.expr(at(0)).cast("bigint"))
    # shiftright halves towards minus infinity, so a time in the middle goes to the earlier neighbour
    lo = F.greatest(F.expr(f"t - {tolerance}L"), F.expr("shiftright(before + t, 1) + 1"))
    hi = F.least(F.expr(f"t + {tolerance}L"), F.expr("shiftright(t + after, 1)"))
    return own.withColumn("lo", lo).withColumn("hi", hi).drop("before", "after", "block")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int) -> DataFrame:
    """For each left row the id of the right row of the same ``keys`` nearest in time, at most ``tolerance`` away.

    Times are bigint in one unit. Of right rows equally near the earlier one is taken, then the smaller id. Left rows
    without such a right row have no result; rows with a null key, time or (right) id don't take part; repeated left rows each
    get a result; an empty table on either side gives an empty result. Result: ``right_id`` and ``left_id``, which must
    differ in name. Other columns are not read, so equal names on both sides don't matter.
    """
    names = [f"k{j}" for j in range(len(keys))]
    known = " AND ".join([f"{a} IS NOT NULL" for a in [*names, "t"]])
    pick = lambda df, time, ident, to: df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(time).alias("t"), F.col(ident).alias(to)).filter(known)
    times = pick(right, right_time, right_id, "rid").groupBy(*names, "t").agg(F.min("rid").alias("rid")).filter("rid IS NOT NULL")
    width = float(2 * tolerance + 1)
    index = neighbour_intervals(times, names, tolerance).select(
        *names, "lo", "hi", "rid",
        F.explode(F.expr(f"array_distinct(array(floor(lo / {width}D), floor(hi / {width}D)))")).alias("bucket"),
    )
    probes = pick(left, left_time, left_id, "lid").withColumn("bucket", F.expr(f"floor(t / {width}D)"))
    # Written once, as the join and the search for busy buckets both read it.
    space = Workspace(left.sparkSession)
    probes = space.write(probes, "probes")
    place, zero = [*names, "bucket"], F.lit(0).cast("bigint")
    busy = heavy_groups(probes, place, probes.count(), space)
    if busy is not None:
        # The left rows of a busy bucket are split by a salt, for which its few intervals are repeated.
        busy = F.broadcast(busy.withColumn("busy", F.lit(True)))
        salt = F.when(F.col("busy"), F.pmod(F.xxhash64("lid"), F.lit(SALTS))).otherwise(zero)
        probes = probes.join(busy, place, "left").withColumn("salt", salt).drop("busy")
        salts = F.when(F.col("busy"), F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.array(zero))
        index = index.join(busy, place, "left").withColumn("salt", F.explode(salts)).drop("busy")
        place = [*place, "salt"]
    hit = probes.join(index, place).filter("t BETWEEN lo AND hi")
    return hit.select(F.col("rid").alias(right_id), F.col("lid").alias(left_id))
