"""Moments, flags and patterns of segments by fixed limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of voice quality, and those for which lower is worse.
VOICE_LIMITS = {"vq_jitter_pct": 1.0, "vq_shimmer_db": 6.0, "vq_hnr_db": 15.0, "vq_cpps_db": 10.0, "vq_voiced_ratio": 0.5}
LOWER_IS_WORSE = ["vq_hnr_db", "vq_cpps_db", "vq_voiced_ratio"]
#: Intents of an action, and parts of a text that make it one.
ACTION_INTENTS = ["command", "instruction", "request", "suggestion"]
ACTION_PARTS = ["let's ", "we will"]


def voice_risks(segments: DataFrame) -> DataFrame:
    """Each measurement of a segment beyond its limit: ``file_id``, ``idx``, ``speaker_id``, ``metric``, ``value``, ``threshold``.

    Metrics that ``segments`` doesn't have are left out; missing values are no risk.
    """
    there = [m for m in VOICE_LIMITS if m in segments.columns]
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(VOICE_LIMITS[m]).alias("threshold")) for m in there]))
    rows = segments.select("file_id", "idx", "speaker_id", cells)
    return rows.filter(F.when(F.col("metric").isin(LOWER_IS_WORSE), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold")))


def voice_statistics(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, least and largest value of each voice metric by ``keys``; metrics without values have no row."""
    there = [m for m in VOICE_LIMITS if m in segments.columns]
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in there]))
    rows = segments.select(*keys, cells).filter("value IS NOT NULL")
    return rows.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").cast("decimal(24,8)")).cast("double").alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"))


def worst_voices(segments: DataFrame, n: int) -> DataFrame:
    """The ``n`` worst risks of each speaker and metric: ``rank`` 1 is furthest beyond the limit; ties by file and ``idx``.

    The limit of rows is applied before the shuffle too.
    """
    w = Window.partitionBy("speaker_id", "metric").orderBy(F.abs(F.col("value") - F.col("threshold")).desc(), "file_id", "idx")
    return voice_risks(segments).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def peak_moments(segments: DataFrame, n: int = 10, least: float | None = None) -> DataFrame:
    """The ``n`` segments of a file with most arousal (missing: 0), earlier ones first if equal; then only those of ``least`` or more.

    ``text`` is cut to 180 signs. The limit of rows is applied before the shuffle too.
    """
    rows = segments.select("file_id", "idx", "s", "speaker_id", F.coalesce("speaker_name", F.lit("")).alias("speaker_name"), F.coalesce("arousal", F.lit(0.0)).alias("arousal"), F.substring(F.coalesce("text", F.lit("")), 1, 180).alias("text"))
    w = Window.partitionBy("file_id").orderBy(F.col("arousal").desc(), "s", "idx")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top if least is None else top.filter(F.col("arousal") >= least)


def action_items(segments: DataFrame) -> DataFrame:
    """Segments with an intent to act, or with a text that says so; ``confidence`` 0.8."""
    text = F.lower(F.coalesce("text", F.lit("")))
    hit = F.coalesce(F.col("intent_top").isin(ACTION_INTENTS), F.lit(False))
    for part in ACTION_PARTS:
        hit = hit | F.contains(text, F.lit(part))
    return segments.filter(hit).select(
        "file_id", "idx", "s", "speaker_id", F.coalesce("speaker_name", F.lit("")).alias("speaker_name"), F.coalesce("arousal", F.lit(0.0)).alias("arousal"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif("intent_top", F.lit("")), F.lit("unknown")).alias("intent"), F.lit(0.8).alias("confidence"),
    )


def moments_to_review(segments: DataFrame) -> DataFrame:
    """Peaks and actions in one table, told apart by ``kind``."""
    peaks = peak_moments(segments).drop("rank").withColumn("kind", F.lit("peak"))
    return peaks.unionByName(action_items(segments).withColumn("kind", F.lit("action")), allowMissingColumns=True)


def speech_patterns(segments: DataFrame, keys: list[str], measures: list[str], counts: list[str]) -> DataFrame:
    """By group: count, mean, deviation, median and ends of each measure, of values that aren't missing or 0; totals of ``counts``.

    In rows by ``feature``; a feature without values has none.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("feature"), F.nullif(F.col(m).cast("double"), F.lit(0.0)).alias("x")) for m in measures]))
    x = segments.select(*keys, cells).filter("x IS NOT NULL")
    stats = x.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("x").cast("decimal(24,8)")).cast("double").alias("mean"), F.stddev_pop("x").alias("deviation"), F.percentile("x", F.lit(0.5)).alias("median"), F.min("x").alias("least"), F.max("x").alias("largest")
    )
    sums = F.inline(F.array(*[F.struct(F.lit(f"{c}_total").alias("feature"), F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias("c")) for c in counts]))
    totals = segments.select(*keys, sums).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("c").cast("double").alias("mean"))
    return stats.unionByName(totals, allowMissingColumns=True)


def speech_anomalies(segments: DataFrame) -> DataFrame:
    """Segments with anomalies: ``flags`` (names in a fixed order, joined by commas) and ``severity``.

    Needs ``wpm``, ``pause_ratio``, ``loudness_rms``, ``vq_jitter_pct`` and ``disfluency_rate`` (a 100 words); missing
    values have no flag. ``vq_shimmer_db`` counts where there is such a column.
    """
    rules = [
        ("very_slow_speech", F.col("wpm") < 80, 1.0), ("very_fast_speech", F.col("wpm") > 300, 1.0), ("high_disfluency", F.col("disfluency_rate") > 15, 1.5),
        ("elevated_disfluency", (F.col("disfluency_rate") > 8) & (F.col("disfluency_rate") <= 15), 0.5), ("high_pause_ratio", F.col("pause_ratio") > 0.5, 0.5),
        ("very_quiet", F.col("loudness_rms") < -40, 0.5), ("high_jitter", F.col("vq_jitter_pct") > 2.5, 0.5),
        *([("high_shimmer", F.col("vq_shimmer_db") > 1.5, 0.5)] if "vq_shimmer_db" in segments.columns else []),
    ]
    flags = F.array_compact(F.array(*[F.when(hit, name) for name, hit, _ in rules]))
    severity = sum((F.when(hit, weight).otherwise(0.0) for _, hit, weight in rules), F.lit(0.0))
    return segments.select("file_id", "idx", F.array_join(flags, ",").alias("flags"), severity.alias("severity")).filter("flags <> ''")


def rate_deviations(segments: DataFrame, most: float = 60.0) -> DataFrame:
    """Segments that are more than ``most`` words a minute away from the mean of their speaker over all files."""
    mean = segments.groupBy("speaker_id").agg(F.avg(F.col("wpm").cast("decimal(24,8)")).cast("double").alias("mean_wpm"))
    return segments.join(mean, "speaker_id").filter(F.abs(F.col("wpm") - F.col("mean_wpm")) > most).select("file_id", "idx", "speaker_id", "wpm", "mean_wpm")


def backchannels(segments: DataFrame, pause_ratio: float = 0.35, longest: float = 0.3) -> DataFrame:
    """Segments that may answer a pause: a pause ratio of ``pause_ratio`` or more, and ``longest`` seconds or less."""
    return segments.filter((F.col("pause_ratio") >= pause_ratio) & (F.col("duration_s") <= longest)).select("file_id", "idx", "pause_ratio", "duration_s")


def insights(metrics: DataFrame) -> DataFrame:
    """Sentences on the interaction of each file, numbered; from ``conversation_metrics`` with ``coherence``."""
    m = F.col
    said = [
        F.when(m("turn_taking_balance") >= 0.7, "Turn-taking was well balanced across speakers.").when(m("turn_taking_balance") <= 0.4, "Conversation was strongly one-sided; one voice dominated.").otherwise("Participation was moderately balanced."),
        F.when(m("interruption_rate_per_min") >= 3, "Interruption rate was very high; dialogue may have been adversarial or manipulative.").when(m("interruption_rate_per_min") >= 1, "Interruption rate was elevated, suggesting competitive turn-taking.").otherwise("Interruption behaviour stayed low."),
        F.when(m("silence_ratio") > 0.25, "Considerable portions of the session were silent.").when(m("silence_ratio") < 0.05, "Conversation moved quickly with minimal pauses."),
        F.when(m("coherence") < 0.3, "Topic coherence was low; content shifted frequently.").when(m("coherence") > 0.6, "Discussion stayed on topic with good coherence."),
        F.when(m("dominance_max") > 70, "One participant held most of the floor, signalling a potential power imbalance."),
    ]
    return metrics.select("file_id", F.posexplode(F.array_compact(F.array(*said))).alias("n", "sentence"))
