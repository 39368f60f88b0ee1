"""Overlapping speech and the interruptions in it. Segments have ``file_id``, ``idx``, ``speaker_id``, ``s``, ``e`` (ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.intervals import self_overlaps
from talkgrid.operators.sequences import joined_rows, part

#: Least overlap that counts, longest distance of two starts of an interruption, and width of a join bucket, in ms.
LEAST_OVERLAP, INTERRUPTION_GAP, BUCKET = 50, 150, 10_000


def pairs(segments: DataFrame) -> DataFrame:
    """Pairs of segments of a file that overlap by ``LEAST_OVERLAP``: ``early``, ``late``, ``overlap``."""
    return self_overlaps(segments.select("file_id", "idx", "speaker_id", "s", "e"), ["file_id"], BUCKET, LEAST_OVERLAP)


def overlap_totals(segments: DataFrame) -> DataFrame:
    """Overlap of each file, and its share of the time from the first start to the last end; a pair counts whoever speaks."""
    span = segments.groupBy("file_id").agg((F.max("e") - F.min("s")).alias("span"), F.max("e").alias("total"))
    found = pairs(segments).groupBy("file_id").agg(F.sum("overlap").alias("ov"))
    out = span.join(found, "file_id", "left").withColumn("overlap_ms", F.coalesce("ov", F.lit(0).cast("bigint")))
    return out.select("file_id", "overlap_ms", F.expr("CASE WHEN span > 0 THEN overlap_ms / CAST(span AS double) ELSE 0.0D END").alias("overlap_ratio"))


def overlap_summary(segments: DataFrame) -> DataFrame:
    """Overlap of each file in percent of its speech span, and of its duration (0 to 100, null without duration)."""
    total = segments.groupBy("file_id").agg(F.max("e").alias("total"))
    out = overlap_totals(segments).join(total, "file_id")
    return out.select(
        "file_id", "overlap_ms", (F.col("overlap_ratio") * 100).alias("overlap_pct"),
        F.expr("CASE WHEN total > 0 THEN greatest(0.0D, least(100.0D, 100 * overlap_ms / CAST(total AS double))) END").alias("overlap_of_duration_pct"),
        F.lit(True).alias("overlap_available"),
    )


def overlap_by_speaker(pairs: DataFrame) -> DataFrame:
    """Overlap of each speaker; both sides of a pair get it, so a speaker who overlaps himself gets it twice."""
    sides = pairs.select("file_id", F.explode(F.array("early.speaker_id", "late.speaker_id")).alias("speaker_id"), "overlap")
    return sides.groupBy("file_id", "speaker_id").agg(F.sum("overlap").alias("overlap_ms"))


def interruptions(pairs: DataFrame) -> DataFrame:
    """Pairs of two speakers whose starts are close: the later one interrupts; at the same start the first in order does."""
    close = pairs.filter(f"early.speaker_id <> late.speaker_id AND late.s - early.s <= {INTERRUPTION_GAP}")
    later = F.col("late.s") > F.col("early.s")
    one, other = F.col("late.speaker_id"), F.col("early.speaker_id")
    return close.select(
        "file_id", F.col("late.s").alias("at_ms"), F.when(later, one).otherwise(other).alias("interrupter"), F.when(later, other).otherwise(one).alias("interrupted"), F.col("overlap").alias("overlap_ms")
    )


def interruption_fold(pairs: DataFrame) -> DataFrame:
    """By file and speaker: interruptions ``made`` and ``received``, and ``overlap_ms``; 0 where there are none."""
    both = F.array(F.struct(F.col("interrupter").alias("speaker_id"), F.lit(1).alias("made"), F.lit(0).alias("received")), F.struct(F.col("interrupted").alias("speaker_id"), F.lit(0).alias("made"), F.lit(1).alias("received")))
    sides = interruptions(pairs).select("file_id", F.inline(both)).groupBy("file_id", "speaker_id").agg(F.sum("made").alias("made"), F.sum("received").alias("received"))
    out = overlap_by_speaker(pairs).join(sides, ["file_id", "speaker_id"], "full")
    return out.select("file_id", "speaker_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("made", "received", "overlap_ms")])


def same_speaker_merge(segments: DataFrame, gap: int) -> DataFrame:
    """Neighbouring segments of one speaker with a pause of 0 to ``gap`` as one, which ends where the last one ends.

    Segments that overlap their predecessor aren't merged, and the end may lie before an earlier one. Runs are
    numbered by blocks of time, so a long file is spread over its blocks.
    """
    rows = segments.select("file_id", "idx", "speaker_id", "s", "e")
    parts = {
        "speaker_id": (F.first("speaker_id"), F.first(part("speaker_id"))), "s": (F.min("s"), F.min(part("s"))),
        "tail": (F.max(F.struct("s", "idx", "e")), F.max(part("tail"))), "members": (F.count(F.lit(1)), F.sum(part("members"))),
    }
    breaks = f"NOT coalesce(prev_speaker_id = speaker_id AND s - prev_e BETWEEN 0 AND {gap}, false)"
    out = joined_rows(rows, ["file_id"], ["s", "idx"], ["speaker_id", "s", "e"], breaks, parts)
    return out.select("file_id", "speaker_id", "s", F.col("tail.e").alias("e"), "members")
