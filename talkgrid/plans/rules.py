"""Queries of moments, flags, patterns, hints and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.functions import affect as A
from talkgrid.operators import conversation as C
from talkgrid.operators import rules as U
from talkgrid.plans.conversation import FLOW, rounded
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import SEG, segments
from talkgrid.storage import stored

R = Registry()
_RISKS = f"""{SEG}, vr AS (SELECT file_id, idx, speaker_id, 'vq_jitter_pct' AS metric, vq_jitter_pct AS value, 1.0::DOUBLE AS threshold FROM seg WHERE vq_jitter_pct > 1.0
   UNION ALL SELECT file_id, idx, speaker_id, 'vq_hnr_db', vq_hnr_db, 15.0 FROM seg WHERE vq_hnr_db < 15.0)"""
_VOICE = ["vq_jitter_pct", "vq_hnr_db"]


@R.add(f"WITH {_RISKS} SELECT * FROM vr")
def vq_risk_flags(spark: SparkSession, sf: str) -> DataFrame:
    return U.voice_risks(segments(spark, sf, _VOICE))


@R.add(f"WITH {_RISKS} SELECT *, (row_number() OVER (PARTITION BY speaker_id, metric ORDER BY abs(value - threshold) DESC, file_id, idx))::INTEGER AS rank FROM vr QUALIFY rank <= 5")
def vq_worst_per_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return U.worst_voices(segments(spark, sf, _VOICE), 5)


@R.add(
    f"""WITH {SEG}, x AS (SELECT speaker_id, 'vq_jitter_pct' AS metric, vq_jitter_pct AS v FROM seg UNION ALL SELECT speaker_id, 'vq_hnr_db', vq_hnr_db FROM seg)
SELECT speaker_id, metric, count(v) AS n, round(avg(v::DECIMAL(24,8)), 9) AS mean, min(v) AS least, max(v) AS largest FROM x WHERE v IS NOT NULL GROUP BY ALL"""
)
def vq_stats_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.voice_statistics(segments(spark, sf, _VOICE), ["speaker_id"]), "mean", digits=9)


_PEAKS = """pk AS (SELECT file_id, idx, s, speaker_id, coalesce(speaker_name, '') AS speaker_name, coalesce(arousal, 0.0) AS arousal, substr(coalesce(text, ''), 1, 180) AS text,
   (row_number() OVER (PARTITION BY file_id ORDER BY coalesce(arousal, 0.0) DESC, s, idx))::INTEGER AS rank FROM seg)"""
_ACTIONS = """ac AS (SELECT file_id, idx, s, speaker_id, coalesce(speaker_name, '') AS speaker_name, coalesce(arousal, 0.0) AS arousal, coalesce(text, '') AS text,
   coalesce(nullif(intent_top, ''), 'unknown') AS intent, 0.8::DOUBLE AS confidence FROM seg
   WHERE coalesce(intent_top IN ('command', 'instruction', 'request', 'suggestion'), false) OR contains(lower(coalesce(text, '')), 'let''s ') OR contains(lower(coalesce(text, '')), 'we will'))"""
_MOMENT = ["speaker_name", "arousal", "text", "intent_top"]


@R.add(f"WITH {SEG}, {_PEAKS} SELECT * FROM pk WHERE rank <= 10")
def peak_moments_top10(spark: SparkSession, sf: str) -> DataFrame:
    return U.peak_moments(segments(spark, sf, _MOMENT))


@R.add(f"WITH {SEG}, {_PEAKS} SELECT * FROM pk WHERE rank <= 5 AND arousal >= 0.35")
def key_moments_top5(spark: SparkSession, sf: str) -> DataFrame:
    return U.peak_moments(segments(spark, sf, _MOMENT), 5, 0.35)


@R.add(f"WITH {SEG}, {_ACTIONS} SELECT * FROM ac")
def action_items(spark: SparkSession, sf: str) -> DataFrame:
    return U.action_items(segments(spark, sf, _MOMENT))


@R.add(
    f"""WITH {SEG}, {_PEAKS}, {_ACTIONS} SELECT file_id, idx, s, speaker_id, speaker_name, arousal, text, NULL::VARCHAR AS intent, NULL::DOUBLE AS confidence, 'peak' AS kind FROM pk WHERE rank <= 10
UNION ALL SELECT *, 'action' AS kind FROM ac"""
)
def moments_union(spark: SparkSession, sf: str) -> DataFrame:
    return U.moments_to_review(segments(spark, sf, _MOMENT))


_PATTERNS = ["wpm", "pause_ratio", "f0_mean_hz", "f0_std_hz", "loudness_rms", *_VOICE]
_COUNTS = ["disfluency_count", "pause_count"]
_UNPIVOT = " UNION ALL ".join(f"SELECT speaker_id, '{m}' AS feature, nullif({m}, 0.0) AS x FROM seg" for m in _PATTERNS)
_TOTALS = " UNION ALL ".join(f"SELECT speaker_id, '{c}_total' AS feature, coalesce({c}, 0) AS c FROM seg" for c in _COUNTS)


@R.add(
    f"""WITH {SEG}, u AS ({_UNPIVOT}), t AS ({_TOTALS}) SELECT speaker_id, feature, count(x) AS n, round(avg(x::DECIMAL(24,8)), 9) AS mean, round(stddev_pop(x), 7) AS deviation, round(quantile_cont(x, 0.5), 9) AS median,
 min(x) AS least, max(x) AS largest FROM u WHERE x IS NOT NULL GROUP BY ALL
UNION ALL SELECT speaker_id, feature, count(*), sum(c)::DOUBLE, NULL, NULL, NULL, NULL FROM t GROUP BY ALL"""
)
def speech_patterns(spark: SparkSession, sf: str) -> DataFrame:
    df = U.speech_patterns(segments(spark, sf, [*_PATTERNS, *_COUNTS]), ["speaker_id"], _PATTERNS, _COUNTS)
    return rounded(rounded(df, "mean", "median", digits=9), "deviation", digits=7)


@R.add(
    f"""WITH {SEG}, r AS (SELECT *, CASE WHEN words > 0 THEN 100.0 * disfluency_count / words END AS dr FROM seg),
 f AS (SELECT file_id, idx, list_filter([CASE WHEN wpm < 80 THEN 'very_slow_speech' END, CASE WHEN wpm > 300 THEN 'very_fast_speech' END, CASE WHEN dr > 15 THEN 'high_disfluency' END,
   CASE WHEN dr > 8 AND dr <= 15 THEN 'elevated_disfluency' END, CASE WHEN pause_ratio > 0.5 THEN 'high_pause_ratio' END, CASE WHEN loudness_rms < -40 THEN 'very_quiet' END,
   CASE WHEN vq_jitter_pct > 2.5 THEN 'high_jitter' END], lambda x: x IS NOT NULL) AS fl FROM r)
SELECT file_id, idx, array_to_string(fl, ',') AS flags,
 list_sum([CASE WHEN x IN ('very_slow_speech', 'very_fast_speech') THEN 1.0::DOUBLE WHEN x = 'high_disfluency' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END for x in fl]) AS severity FROM f WHERE len(fl) > 0"""
)
def speech_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, [*_PATTERNS, "words", "disfluency_count"]).withColumn("disfluency_rate", F.expr("CASE WHEN words > 0 THEN 100.0D * disfluency_count / words END"))
    return U.speech_anomalies(rows)


@R.add(
    f"""WITH {SEG}, m AS (SELECT speaker_id, avg(wpm::DECIMAL(24,8)) AS mean_wpm FROM seg GROUP BY 1)
SELECT file_id, idx, speaker_id, wpm, round(mean_wpm, 9) AS mean_wpm FROM seg JOIN m USING (speaker_id) WHERE abs(wpm - mean_wpm) > 60"""
)
def speech_rate_deviations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.rate_deviations(segments(spark, sf, ["wpm"])), "mean_wpm", digits=9)


@R.add(f"WITH {SEG} SELECT file_id, idx, pause_ratio, duration_s FROM seg WHERE pause_ratio >= 0.2 AND duration_s <= 2.0")
def backchannels(spark: SparkSession, sf: str) -> DataFrame:
    return U.backchannels(segments(spark, sf, ["pause_ratio", "duration_s"]), 0.2, 2.0)


@R.add(
    f"""WITH {SEG} SELECT file_id, idx, CASE WHEN valence IS NULL OR arousal IS NULL THEN 'neutral-status' WHEN arousal > 0.5 AND valence < 0 THEN 'agitated-negative'
 WHEN arousal < 0.3 AND valence > 0.2 THEN 'calm-positive' ELSE 'neutral-' || coalesce(intent_top, 'None') END AS hint FROM seg"""
)
def affect_hint_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf, ["valence", "arousal", "intent_top"]).select("file_id", "idx", A.pipeline_hint(F.col("valence"), F.col("arousal"), F.col("intent_top")).alias("hint"))


@R.add(
    f"""WITH {SEG}, q AS (SELECT *, replace(lower(trim(coalesce(nullif(intent_top, ''), 'status_update'))), ' ', '_') AS c FROM seg),
 t AS (SELECT *, coalesce(nullif(replace(CASE WHEN c = 'status_update' THEN 'status' ELSE c END, '_', '-'), ''), 'status') AS tag FROM q)
SELECT file_id, idx, CASE WHEN valence IS NULL OR arousal IS NULL THEN 'neutral-' || tag WHEN arousal > 0.55 AND valence < 0 THEN 'agitated-negative' WHEN arousal < 0.3 AND valence > 0.25 THEN 'calm-positive'
 WHEN valence > 0.5 THEN 'bright-' || tag WHEN valence < -0.35 THEN 'low-' || tag ELSE 'neutral-' || tag END AS hint FROM t"""
)
def affect_hint_analyzer(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf, ["valence", "arousal", "intent_top"]).select("file_id", "idx", A.analyzer_hint(F.col("valence"), F.col("arousal"), F.col("intent_top")).alias("hint"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Emotion scores of speakers_summary as maps, with a key that tells rows apart."""
    rows = spark.read.parquet(f"{sf}/speakers_summary.parquet").filter("text_emotions_full_json IS NOT NULL AND file_id IS NOT NULL AND speaker_id IS NOT NULL")
    return rows.select("file_id", "speaker_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("written"), F.from_json("text_emotions_full_json", "map<string,double>").alias("scores")).filter("scores IS NOT NULL")


_JSON = """sj AS (SELECT file_id, speaker_id, epoch_us(written_at) AS written, text_emotions_full_json::JSON AS j FROM speakers_summary
   WHERE text_emotions_full_json IS NOT NULL AND file_id IS NOT NULL AND speaker_id IS NOT NULL),
 sv AS (SELECT file_id, speaker_id, written, [json_extract(j, '$."' || k || '"')::DOUBLE for k in json_keys(j)] AS v, json_keys(j) AS k FROM sj)"""


@R.add(
    f"""WITH {_JSON}, d AS (SELECT *, list_reverse_sort(v) AS r, list_sum([-x * ln(x) for x in v if x > 0]) AS h, len([x for x in v if x > 0]) AS n FROM sv)
SELECT file_id, speaker_id, written, round(CASE WHEN len(r) > 1 THEN r[1] - r[2] ELSE coalesce(r[1], 0.0) END, 9) AS margin, round(CASE WHEN n > 1 THEN h / ln(n) ELSE 0.0 END, 9) AS norm_entropy,
 coalesce(r[1] < 0.55 OR (CASE WHEN len(r) > 1 THEN r[1] - r[2] ELSE coalesce(r[1], 0.0) END) < 0.18 OR (CASE WHEN n > 1 THEN h / ln(n) ELSE 0.0 END) > 0.85, true) AS low_confidence FROM d"""
)
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("scores")
    df = _scores(spark, sf).select("file_id", "speaker_id", "written", A.top_margin(c).alias("margin"), A.normalized_entropy(c).alias("norm_entropy"), A.low_confidence(c).alias("low_confidence"))
    return rounded(df, "margin", "norm_entropy", digits=9)


@R.add(
    f"""WITH {_JSON}, e AS (SELECT file_id, speaker_id, written, unnest(k) AS label, unnest(v) AS score FROM sv WHERE len(v) > 0), t AS (SELECT file_id, speaker_id, written, sum(score) AS t FROM e WHERE score >= 0 GROUP BY ALL)
SELECT file_id, speaker_id, written, label, round(score / t, 9) AS share FROM e JOIN t USING (file_id, speaker_id, written) WHERE score > 0 AND t > 0"""
)
def normalize_scores(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.speakers import EMOTIONS

    df = _scores(spark, sf).select("file_id", "speaker_id", "written", F.explode(A.normalize_scores(F.col("scores"), EMOTIONS)).alias("label", "share"))
    return rounded(df.filter("share > 0"), "share", digits=9)


@R.add(
    f"""WITH {_JSON}, e AS (SELECT file_id, speaker_id, written, unnest(k) AS label, unnest(v) AS score FROM sv)
SELECT file_id, speaker_id, written, label, score, (row_number() OVER (PARTITION BY file_id, speaker_id, written ORDER BY score DESC, label) - 1)::INTEGER AS pos FROM e QUALIFY pos < 3"""
)
def scores_top3(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scores(spark, sf).select("file_id", "speaker_id", "written", F.posexplode(A.top_k(F.col("scores"), 3)).alias("pos", "t"))
    return rows.select("file_id", "speaker_id", "written", "t.label", "t.score", "pos")


@R.add(
    rf"""WITH {FLOW}, i AS (SELECT file_id, count(*) AS cuts FROM o WHERE s < pe GROUP BY file_id),
 w AS (SELECT file_id, idx, s, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: length(x) > 3)) AS terms FROM seg),
 q AS (SELECT file_id, terms, lag(terms) OVER (PARTITION BY file_id ORDER BY s, idx) AS pt FROM w),
 j AS (SELECT file_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE coalesce(avg(CASE WHEN len(terms) > 0 AND len(pt) > 0 THEN len(list_intersect(terms, pt)) / len(list_distinct(list_concat(terms, pt)))::DOUBLE END), 0.0) END AS coherence FROM q GROUP BY file_id),
 m AS (SELECT f.file_id, coalesce(balance, 0.0) AS b, coalesce(dominance_max, 0.0) AS d, CASE WHEN total > 0 THEN coalesce(cuts, 0) / (total / 60000.0::DOUBLE) ELSE 0.0 END AS r,
   CASE WHEN total > 0 THEN greatest(0.0, least(1.0, 1 - speech / total::DOUBLE)) ELSE 1.0 END AS s, coherence AS c FROM f LEFT JOIN b USING (file_id) LEFT JOIN i USING (file_id) JOIN j USING (file_id)),
 l AS (SELECT file_id, list_filter([
   CASE WHEN b >= 0.7 THEN 'Turn-taking was well balanced across speakers.' WHEN b <= 0.4 THEN 'Conversation was strongly one-sided; one voice dominated.' ELSE 'Participation was moderately balanced.' END,
   CASE WHEN r >= 3 THEN 'Interruption rate was very high; dialogue may have been adversarial or manipulative.' WHEN r >= 1 THEN 'Interruption rate was elevated, suggesting competitive turn-taking.' ELSE 'Interruption behaviour stayed low.' END,
   CASE WHEN s > 0.25 THEN 'Considerable portions of the session were silent.' WHEN s < 0.05 THEN 'Conversation moved quickly with minimal pauses.' END,
   CASE WHEN c < 0.3 THEN 'Topic coherence was low; content shifted frequently.' WHEN c > 0.6 THEN 'Discussion stayed on topic with good coherence.' END,
   CASE WHEN d > 70 THEN 'One participant held most of the floor, signalling a potential power imbalance.' END], lambda x: x IS NOT NULL) AS l FROM m)
SELECT file_id, (unnest(range(len(l))))::INTEGER AS n, unnest(l) AS sentence FROM l"""
)
def narrative_insights(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(segments(spark, sf, ["text"]))
    return U.insights(C.conversation_metrics(rows).join(C.topic_coherence(rows), "file_id"))
