"""Groups that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.storage import Workspace

#: At most this many groups can be heavy, whatever the data: what is broadcast is bounded by it.
MAX_HEAVY = 100_000
#: Groups up to this many rows are never worth splitting.
LEAST_HEAVY = 20_000


def heavy_limit(total: int) -> int:
    """Rows from which a group of ``total`` rows is heavy: fewer than ``MAX_HEAVY`` groups can have more."""
    return max(LEAST_HEAVY, -(-total // MAX_HEAVY))


def heavy_groups(rows: DataFrame, keys: list[str], total: int, space: Workspace, name: str = "heavy") -> DataFrame | None:
    """The ``keys`` of groups with more rows than ``heavy_limit(total)``, written to ``space``; None if there are none.

    Rows are first counted by a hash of the keys, in at most a million buckets; groups are counted only within
    buckets that are over the limit themselves. Neither pass moves rows: both count before the shuffle. The result
    has fewer than ``MAX_HEAVY`` rows, so it may be broadcast. Null keys form groups too.
    """
    limit = heavy_limit(total)
    if total <= limit:
        return None
    buckets = min(1 << 20, max(1 << 12, total // 256))
    hashed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    full = hashed.groupBy("__bucket").count().filter(F.col("count") > limit).select("__bucket")
    heavy = hashed.join(F.broadcast(full), "__bucket", "left_semi").groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    heavy = space.write(heavy, name)
    return heavy if heavy.limit(1).count() else None


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``keys``, which aren't null); ``heavy`` as of ``heavy_groups``.

    Rows of heavy groups are joined where they lie, with a broadcast of those groups only; the others by a shuffle.
    """
    if heavy is None:
        return rows.join(groups, keys)
    hot = F.broadcast(groups.join(F.broadcast(heavy), keys, "left_semi"))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(heavy), keys, "left_anti").join(groups, keys))
