"""Metrics of the flow of a conversation, for many recordings at once.

``segments`` has ``file_id``, ``idx``, ``speaker_id``, ``s``, ``e`` (milliseconds) and what else is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.text import content_words
from talkgrid.operators.sequences import turns, with_previous
from talkgrid.storage import Workspace

#: Longest pause, in ms, that counts as a response.
LONGEST_RESPONSE = 5000


def durations(segments: DataFrame) -> DataFrame:
    """``total`` duration (end of the last segment), ``speech`` (sum of segments, overlaps twice) and ``segments`` of each file."""
    return segments.groupBy("file_id").agg(F.max("e").alias("total"), F.sum(F.col("e") - F.col("s")).alias("speech"), F.count(F.lit(1)).alias("segments"))


def speaker_dominance(segments: DataFrame) -> DataFrame:
    """Share of the speech of a file that each speaker has, in percent: null where there is no speech."""
    by = segments.groupBy("file_id", "speaker_id").agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    total = durations(segments).select("file_id", F.col("speech").alias("__all"))
    return by.join(total, "file_id").select("file_id", "speaker_id", "speech", F.expr("CASE WHEN __all > 0 THEN speech / CAST(__all AS double) * 100 END").alias("share_pct"))


def turn_balance(segments: DataFrame) -> DataFrame:
    """Normalised entropy of the speakers' shares of a file: 1 if equal; 0 for one speaker or no speech."""
    p = speaker_dominance(segments).filter("speech > 0").withColumn("p", F.col("share_pct") / 100)
    found = p.groupBy("file_id").agg(F.count(F.lit(1)).alias("k"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.max("share_pct").alias("dominance_max"))
    base = segments.select("file_id").distinct().join(found, "file_id", "left")
    return base.select("file_id", F.expr("CASE WHEN k > 1 THEN h / log2(k) ELSE 0.0D END").alias("balance"), F.coalesce("dominance_max", F.lit(0.0)).alias("dominance_max"))


def interruptions_by_row(segments: DataFrame) -> DataFrame:
    """Segments that start before the row before has ended, whoever speaks: ``file_id``, ``idx``, ``speaker_id``, ``late_by``."""
    rows = with_previous(segments.select("file_id", "idx", "speaker_id", "s", "e"), ["file_id"], ["s", "idx"], ["e"])
    return rows.filter("s < prev_e").select("file_id", "idx", "speaker_id", (F.col("prev_e") - F.col("s")).alias("late_by"))


def responses(segments: DataFrame) -> DataFrame:
    """Turns with ``latency``: from the end of the turn before to the start; only those of 0 to 5 s."""
    return _responses(turns(segments.select("file_id", "idx", "speaker_id", "s", "e"), ["file_id"]))


def _responses(starts: DataFrame) -> DataFrame:
    rows = with_previous(starts, ["file_id"], ["s", "idx"], ["e"]).withColumn("latency", F.col("s") - F.col("prev_e"))
    return rows.filter(f"latency BETWEEN 0 AND {LONGEST_RESPONSE}").select("file_id", "idx", "speaker_id", "latency")


def energy_flow(segments: DataFrame, width: int = 30_000) -> DataFrame:
    """Energy of each whole window of a file: mean arousal (missing: 0) by the share of the window that is spoken.

    A file has ``total div width`` windows, one at least; what is after the last one doesn't count, and a window
    without speech has 0. ``segments`` has ``arousal`` too.
    """
    files = durations(segments).select("file_id", "total").filter("total > 0")
    grid = files.withColumn("w", F.explode(F.expr(f"sequence(0L, greatest(1L, total div {width}L) - 1)"))).select(
        "file_id", "w", F.expr(f"w * {width}L").alias("ws"), F.expr(f"least((w + 1) * {width}L, total)").alias("we")
    )
    parts = segments.select("file_id", "speaker_id", "s", "e", F.coalesce("arousal", F.lit(0.0)).cast("decimal(18,6)").alias("a"))
    parts = parts.withColumn("w", F.explode(F.expr(f"sequence(s div {width}L, greatest(s, e - 1) div {width}L)"))).filter(f"e > w * {width}L")
    parts = parts.join(files, "file_id").filter(f"s < least((w + 1) * {width}L, total)")
    spoken = F.expr(f"least(e, (w + 1) * {width}L, total) - greatest(s, w * {width}L)")
    found = parts.groupBy("file_id", "w").agg(
        F.sum("a").cast("double").alias("a"), F.count(F.lit(1)).alias("n"), F.sum(F.greatest(spoken, F.lit(0))).alias("spoken"), F.countDistinct("speaker_id").alias("speakers")
    )
    out = grid.join(found, ["file_id", "w"], "left")
    density = F.expr(f"coalesce(spoken, 0) / {float(width)}D")
    return out.select(
        "file_id", "ws", "we", F.expr(f"coalesce(a / n * (spoken / {float(width)}D), 0.0D)").alias("energy"), F.coalesce("speakers", F.lit(0)).cast("bigint").alias("active_speakers"), density.alias("speech_density")
    )


def topic_coherence(segments: DataFrame) -> DataFrame:
    """Mean share of common content words of neighbouring segments; 1 for a file of one segment, 0 where none can be compared."""
    rows = segments.select("file_id", "idx", "s", content_words(F.coalesce("text", F.lit(""))).alias("terms"))
    rows = with_previous(rows, ["file_id"], ["s", "idx"], ["terms"])
    both = F.size(F.array_union("terms", "prev_terms"))
    j = F.when((F.size("terms") > 0) & (F.size("prev_terms") > 0), F.size(F.array_intersect("terms", "prev_terms")) / both)
    found = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.avg(j).alias("j"))
    return found.select("file_id", F.expr("CASE WHEN n < 2 THEN 1.0D ELSE coalesce(j, 0.0D) END").alias("coherence"))


def conversation_metrics(segments: DataFrame) -> DataFrame:
    """One row a file: balance, dominance, interruptions and turns a minute, turn length, response latency, silence.

    A file has a row however few segments it has; rates are 0 where the duration is 0. The rows with their predecessors
    are written once; speakers are aggregated before files.
    """
    given = segments.select("file_id", "idx", "speaker_id", "s", "e")
    rows = with_previous(given, ["file_id"], ["s", "idx"], ["speaker_id", "e"])
    rows = rows.withColumn("turn", F.expr("(prev_speaker_id IS NULL OR prev_speaker_id <> speaker_id) AND e > s")).withColumn("cut", F.expr("coalesce(s < prev_e, false)"))
    rows = Workspace(segments.sparkSession).write(rows.drop("prev_speaker_id", "prev_e"), "rows")
    length = F.col("e") - F.col("s")
    by = rows.groupBy("file_id", "speaker_id").agg(
        F.max("e").alias("total"), F.sum(length).alias("x"), F.count_if("cut").alias("cuts"), F.count_if("turn").alias("turns"), F.sum(F.when(F.col("turn"), length)).alias("turn_ms")
    )
    base = by.groupBy("file_id").agg(
        F.max("total").alias("total"), F.sum("x").alias("speech"), F.sum("cuts").alias("cuts"), F.sum("turns").alias("turns"), F.sum("turn_ms").alias("turn_ms"),
        F.count_if(F.col("x") > 0).alias("k"), F.max("x").alias("most"), F.sum(F.when(F.col("x") > 0, F.col("x") * F.log2("x"))).alias("xlogx"),
    )
    answers = _responses(rows.filter("turn")).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("answers"), F.sum("latency").alias("latency"), F.expr("percentile(latency, 0.5D)").alias("median")
    )
    out = base.join(answers, "file_id", "left")
    rate = lambda c: F.expr(f"CASE WHEN total > 0 THEN coalesce({c}, 0) / (total / 60000.0D) ELSE 0.0D END")
    return out.select(
        "file_id", F.expr("CASE WHEN k > 1 THEN (log2(speech) - xlogx / speech) / log2(k) ELSE 0.0D END").alias("turn_taking_balance"),
        F.expr("CASE WHEN speech > 0 THEN most / CAST(speech AS double) * 100 ELSE 0.0D END").alias("dominance_max"), rate("cuts").alias("interruption_rate_per_min"),
        F.expr("CASE WHEN turns > 0 THEN turn_ms / (turns * 1000.0D) ELSE 0.0D END").alias("avg_turn_duration_sec"), rate("turns").alias("turns_per_min"),
        F.expr("coalesce(latency / (answers * 1000.0D), 0.0D)").alias("latency_avg_sec"), F.expr("coalesce(median / 1000.0D, 0.0D)").alias("latency_median_sec"),
        F.coalesce("answers", F.lit(0)).cast("bigint").alias("latency_count"),
        F.expr("CASE WHEN total > 0 THEN greatest(0.0D, least(1.0D, 1 - speech / CAST(total AS double))) ELSE 1.0D END").alias("silence_ratio"),
    )
