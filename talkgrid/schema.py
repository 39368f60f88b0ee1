"""The fixed schema of output segments, and its defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = "array<struct<label:string,score:double>>"
#: Names, order and types of the columns of an output segment.
SEGMENT_COLUMNS: dict[str, str] = {
    "file_id": "string", "start": "double", "end": "double", "speaker_id": "string", "speaker_name": "string", "text": "string",
    "valence": "double", "arousal": "double", "dominance": "double", "emotion_top": "string", "emotion_scores_json": "map<string,double>",
    "text_emotions_top5_json": SCORES, "text_emotions_full_json": "map<string,double>", "intent_top": "string", "intent_top3_json": SCORES,
    "events_top3_json": "array<struct<label:string,score:double,overlap:double>>", "noise_tag": "string", "noise_score": "double", "timeline_event_count": "int",
    "timeline_mode": "string", "timeline_inference_mode": "string", "timeline_overlap_count": "int", "timeline_overlap_ratio": "double", "timeline_events_path": "string",
    "snr_db": "double", "snr_db_sed": "double", "asr_confidence": "double", "asr_logprob_avg": "double", "asr_language": "string", "asr_tokens_json": "array<string>",
    "asr_words_json": "array<struct<word:string,start:double,end:double,probability:double>>", "low_confidence_ser": "boolean", "vad_unstable": "boolean", "affect_hint": "string",
    "pause_count": "int", "pause_time_s": "double", "pause_ratio": "double", "f0_mean_hz": "double", "f0_std_hz": "double", "loudness_rms": "double", "disfluency_count": "int",
    "wpm": "double", "duration_s": "double", "words": "int", "error_flags": "string", "vq_jitter_pct": "double", "vq_shimmer_db": "double", "vq_hnr_db": "double", "vq_cpps_db": "double",
    "voice_quality_hint": "string", "vq_voiced_ratio": "double", "vq_spectral_slope_db": "double", "vq_reliable": "boolean",
}
#: What missing columns are filled with; all others stay null.
DEFAULTS = {
    "error_flags": "", "low_confidence_ser": False, "timeline_event_count": 0, "timeline_overlap_count": 0, "timeline_overlap_ratio": 0.0, "vad_unstable": False,
    "vq_voiced_ratio": 0.0, "vq_spectral_slope_db": 0.0, "vq_reliable": False,
}
EMPTY_LISTS = ["asr_tokens_json", "asr_words_json", "events_top3_json"]


def segment_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, t in SEGMENT_COLUMNS.items()])


def with_segment_columns(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of an output segment, in order; missing ones have their defaults.

    Columns that are there are cast, and what can't be cast is null. Others are left out.
    """

    def column(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]).cast(kind))
        elif name in EMPTY_LISTS:
            value = F.coalesce(value, F.array().cast(kind))
        return value.alias(name)

    return df.select(*[column(n, t) for n, t in SEGMENT_COLUMNS.items()])


def flat(df: DataFrame) -> DataFrame:
    """``df`` for a flat file: nested columns as JSON, maps with sorted keys."""

    def column(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(name)
        return F.to_json(c).alias(name) if isinstance(kind, (T.ArrayType, T.StructType)) else c

    return df.select(*[column(f.name, f.dataType) for f in df.schema.fields])
