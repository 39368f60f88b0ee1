"""Clean views of the project's tables, and the same views as SQL text for the queries' checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators.latest import finite, latest_rows, squeezed, whole_ms

#: Measurements of a segment; null and NaN are one missing value in the views.
MEASURES = [
    "asr_logprob_avg", "asr_confidence", "valence", "arousal", "dominance", "noise_score", "snr_db", "snr_db_sed", "timeline_overlap_ratio",
    "wpm", "duration_s", "pause_ratio", "f0_mean_hz", "f0_std_hz", "loudness_rms", "vq_jitter_pct", "vq_hnr_db",
]
PLAIN = [
    "file_id", "speaker_id", "speaker_name", "text", "asr_language", "error_flags", "emotion_top", "intent_top", "low_confidence_ser", "noise_tag",
    "timeline_event_count", "timeline_mode", "words", "pause_count", "disfluency_count", "vad_unstable", "voice_quality_hint", "vq_reliable",
]


def known(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def segments(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """Latest segments with a file, a speaker and whole times: ``idx``, ``s``, ``e`` (ms, ``s <= e``), ``columns``.

    ``file_id`` and ``speaker_id`` are always there; only the columns asked for are read and shuffled.
    """
    wanted = list(dict.fromkeys(["file_id", "speaker_id", *(columns if columns is not None else [*PLAIN, *MEASURES])]))
    rows = latest_rows(spark.read.parquet(f"{sf}/segments.parquet"), "seg_id", "ingested_at", list(dict.fromkeys([*wanted, "start", "end"])))
    rows = rows.filter(finite(F.col("start")) & finite(F.col("end")) & F.col("file_id").isNotNull() & (squeezed(F.col("speaker_id")) != ""))
    values = [known(F.col(c)).alias(c) if c in MEASURES else F.col(c) for c in wanted]
    return rows.select(F.col("seg_id").alias("idx"), whole_ms(F.col("start")).alias("s"), whole_ms(F.col("end")).alias("e"), *values).filter("s <= e")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Latest sound events with a file, a label, whole times and a score: ``event_id``, ``file_id``, ``label``, ``s``, ``e``, ``score``."""
    rows = latest_rows(spark.read.parquet(f"{sf}/events_timeline.parquet"), "event_id", "ingested_at", ["file_id", "label", "start", "end", "score"])
    rows = rows.filter(finite(F.col("start")) & finite(F.col("end")) & finite(F.col("score")) & F.col("file_id").isNotNull())
    label = F.lower(squeezed(F.col("label")))
    return rows.select("event_id", "file_id", label.alias("label"), whole_ms(F.col("start")).alias("s"), whole_ms(F.col("end")).alias("e"), F.round("score", 4).alias("score")).filter(
        "s <= e AND label <> ''"
    )


def register_views(spark: SparkSession, sf: str) -> list[str]:
    """All tables of a folder as views of their names, and the clean ones as ``clean_segments`` and ``clean_events``, for ``spark.sql``."""
    names = []
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sf)
    for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
        file = status.getPath().getName()
        if file.endswith(".parquet"):
            spark.read.parquet(f"{sf}/{file}").createOrReplaceTempView(name := file.removesuffix(".parquet"))
            names.append(name)
    segments(spark, sf).createOrReplaceTempView("clean_segments")
    events(spark, sf).createOrReplaceTempView("clean_events")
    return sorted([*names, "clean_segments", "clean_events"])


def _sql_segments() -> str:
    values = ", ".join([f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in MEASURES] + PLAIN)
    return f"""seg AS (SELECT idx, s, e, * EXCLUDE (idx, s, e) FROM (
        SELECT seg_id AS idx, round("start" * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e, {values}
        FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1)
        WHERE NOT isnan("start") AND NOT isnan("end") AND file_id IS NOT NULL AND trim(speaker_id) <> '') WHERE s <= e)"""


#: Common table expressions ``seg`` and ``ev``: the same views for the checking engine.
SEG = _sql_segments()
EV = r"""ev AS (SELECT * FROM (
        SELECT event_id, file_id, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS label, round("start" * 1000)::BIGINT AS s, round("end" * 1000)::BIGINT AS e, round(score, 4) AS score
        FROM (SELECT * FROM events_timeline QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1)
        WHERE NOT isnan("start") AND NOT isnan("end") AND NOT isnan(score) AND file_id IS NOT NULL) WHERE s <= e AND label <> '')"""
