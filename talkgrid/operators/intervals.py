"""Joins and cuts of time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Pairs of intervals of the same ``keys`` that overlap: ``ls < re AND rs < le``.

    Both sides have ``keys``, ``s`` and ``e`` (bigint); their columns come out as structs named ``names``. Each
    interval is put into the time buckets of ``width`` that it touches, and joins by group and bucket, so that hot
    groups are spread over time and no interval meets others far away. A pair counts in the first bucket that both
    have. ``width`` should be about the usual length of the longer side.
    """
    a, b = names

    def spread(df: DataFrame, to: str) -> DataFrame:
        first, last = f"floor(s / {float(width)}D)", f"floor(greatest(s, e - 1) / {float(width)}D)"
        return df.filter("s <= e").select(*keys, F.struct("*").alias(to), F.expr(first).alias(f"{to}_first"), F.explode(F.expr(f"sequence({first}, {last})")).alias("bucket"))

    pairs = spread(left, a).join(spread(right, b), [*keys, "bucket"])
    return pairs.filter(f"bucket = greatest({a}_first, {b}_first) AND {a}.s < {b}.e AND {b}.s < {a}.e").select(*keys, a, b)


def self_overlaps(df: DataFrame, keys: list[str], width: int, least: int) -> DataFrame:
    """Each unordered pair of intervals of a group that overlap by at least ``least``: ``early``, ``late``, ``overlap``.

    ``late`` starts later, or at the same time with a higher ``idx``.
    """
    pairs = overlap_join(df, df, keys, width, ("early", "late"))
    pairs = pairs.filter("early.s < late.s OR (early.s = late.s AND early.idx < late.idx)")
    return pairs.withColumn("overlap", F.expr("least(early.e, late.e) - late.s")).filter(F.col("overlap") >= least)


def windows(df: DataFrame, width: int, hop: int | None = None, least: int = 1, keep_tail: bool = True) -> DataFrame:
    """Windows [ws, we) of ``width`` every ``hop`` over each interval [s, e), cut at its end; ``k`` counts them from 0.

    Windows shorter than ``least`` are left out; without ``keep_tail`` so are cut ones, but for the first.
    """
    hop = hop or width
    count = f"greatest(0L, CAST(ceil((e - s) / {float(hop)}D) AS bigint) - 1)"
    cut = df.withColumn("k", F.explode(F.expr(f"sequence(0L, {count})"))).withColumn("ws", F.expr(f"s + k * {hop}L"))
    cut = cut.withColumn("we", F.expr(f"least(ws + {width}L, e)")).filter(f"we - ws >= {least}L")
    return cut if keep_tail else cut.filter(f"k = 0 OR we - ws = {width}L")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """For each left row the right row of the same ``keys`` nearest in time, if within ``tolerance``: ``keys``, ``idx``, ``other``, ``apart``.

    Both sides have ``keys``, ``idx`` and ``s``. Of equally near rows the earlier counts, then the lower ``idx``. Right
    rows are put into their time bucket and its neighbours, and only the best of a left row's candidates is kept
    before anything is shuffled again.
    """
    width = float(max(1, tolerance))
    near = right.filter("s IS NOT NULL").select(*keys, F.col("idx").alias("other"), F.col("s").alias("t"), F.explode(F.expr(f"sequence(floor(s / {width}D) - 1, floor(s / {width}D) + 1)")).alias("bucket"))
    probes = left.filter("s IS NOT NULL").select(*keys, "idx", "s", F.expr(f"floor(s / {width}D)").alias("bucket"))
    pairs = probes.join(near, [*keys, "bucket"]).withColumn("apart", F.abs(F.col("s") - F.col("t"))).filter(F.col("apart") <= tolerance)
    return pairs.groupBy(*keys, "idx").agg(F.min(F.struct("apart", "t", "other")).alias("b")).select(*keys, "idx", F.col("b.other").alias("other"), F.col("b.apart").alias("apart"))


def analysis_windows(df: DataFrame, width: int, hop: int) -> DataFrame:
    """Windows of exactly ``width`` over each [s, e): one every ``hop`` that fits, and a last one that ends at ``e``.

    An interval shorter than ``width`` has one window, which is cut at its end. Result: the columns of ``df``, ``ws``, ``we``.
    """
    fits = f"greatest(0L, (e - s - {width}L) div {hop}L)"
    starts = F.expr(f"array_distinct(concat(transform(sequence(0L, {fits}), k -> s + k * {hop}L), array(greatest(s, e - {width}L))))")
    return df.filter("e > s").withColumn("ws", F.explode(starts)).withColumn("we", F.expr(f"least(ws + {width}L, e)"))
