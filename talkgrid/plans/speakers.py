"""Queries of speakers: roll-ups, votes, quantiles, emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import conversation as C
from talkgrid.operators import overlap as O
from talkgrid.operators import speakers as S
from talkgrid.operators.latest import squeezed
from talkgrid.plans.conversation import _FOLD, rounded
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import SEG, segments
from talkgrid.storage import stored

R = Registry()
_COLUMNS = ["speaker_name", "text", "words", "wpm", "pause_ratio", "pause_count", "emotion_top", "voice_quality_hint", *S.MEDIANS]


def _fold(spark: SparkSession, sf: str) -> DataFrame:
    return O.interruption_fold(O.pairs(segments(spark, sf, [])))


def _vote(column: str) -> str:
    return f"""(SELECT file_id, speaker_id, {column}, n FROM (SELECT file_id, speaker_id, {column}, count(*) AS n, min(idx) AS i FROM seg WHERE trim({column}) <> '' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY file_id, speaker_id ORDER BY n DESC, i) = 1)"""


_WORDS = r"coalesce(words::BIGINT, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) END)"
_MED = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.0) AS {c}_med" for c in S.MEDIANS)
_NAME = "(SELECT file_id, speaker_id, arg_min(speaker_name, idx) AS speaker_name FROM seg WHERE trim(speaker_name) <> '' GROUP BY ALL)"


@R.add(
    f"""WITH {_FOLD}, mrf AS (SELECT file_id, speaker_id, coalesce(made, 0) AS made, coalesce(received, 0) AS received, coalesce(overlap_ms, 0) AS overlap_ms FROM os FULL JOIN mr USING (file_id, speaker_id)),
 a AS (SELECT file_id, speaker_id, sum(e - s)::BIGINT AS d, sum({_WORDS})::BIGINT AS word_count, coalesce(quantile_cont(wpm, 0.5), 0.0) AS wm, {_MED},
        coalesce(quantile_cont(loudness_rms, 0.25), 0.0) AS lq1, coalesce(quantile_cont(loudness_rms, 0.75), 0.0) AS lq3,
        sum((coalesce(pause_ratio, 0.0) * (e - s))::DECIMAL(24,6))::DOUBLE AS pause, coalesce(sum(pause_count), 0)::BIGINT AS pause_count FROM seg GROUP BY ALL),
 n AS {_NAME}, ve AS {_vote("emotion_top")}, vh AS {_vote("voice_quality_hint")}
SELECT file_id, speaker_id, coalesce(speaker_name, '') AS speaker_name, round(d / 1000.0::DOUBLE, 6) AS total_duration, word_count,
  round(CASE WHEN d > 0 THEN word_count / (d / 60000.0::DOUBLE) ELSE wm END, 6) AS avg_wpm, round(valence_med, 6) AS avg_valence, round(arousal_med, 6) AS avg_arousal, round(dominance_med, 6) AS avg_dominance,
  coalesce(emotion_top, 'neutral') AS dominant_speech_emotion, coalesce(made, 0) AS interruptions_made, coalesce(received, 0) AS interruptions_received,
  round(CASE WHEN d > 0 THEN overlap_ms / d::DOUBLE END, 6) AS overlap_ratio, true AS overlap_data_available, round(f0_mean_hz_med, 6) AS f0_mean_hz, round(f0_std_hz_med, 6) AS f0_std_hz,
  round(loudness_rms_med, 6) AS loudness_rms_med, round(greatest(0.0, lq3 - lq1), 6) AS loudness_dr_db, round(greatest(0.0, lq3 - lq1) * 20, 6) AS loudness_dr_x20, round(pause / 1000.0::DOUBLE, 6) AS pause_total_sec,
  pause_count, round(CASE WHEN d > 0 THEN pause / d ELSE 0.0 END, 6) AS pause_ratio, round(vq_jitter_pct_med, 6) AS vq_jitter_pct_med, round(vq_hnr_db_med, 6) AS vq_hnr_db_med, coalesce(voice_quality_hint, '') AS voice_quality_hint
FROM a LEFT JOIN mrf USING (file_id, speaker_id) LEFT JOIN n USING (file_id, speaker_id) LEFT JOIN ve USING (file_id, speaker_id) LEFT JOIN vh USING (file_id, speaker_id)"""
)
def speaker_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(segments(spark, sf, _COLUMNS))
    df = S.rollup(rows, O.interruption_fold(O.pairs(rows)))
    return rounded(df, *[c for c, t in df.dtypes if t == "double"])


@R.add(f"WITH {SEG}, v AS {_vote('emotion_top')} SELECT file_id, speaker_id, emotion_top, n AS votes FROM v")
def speaker_votes_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return S.votes(segments(spark, sf, ["emotion_top"]), S.KEYS, "emotion_top", "idx")


@R.add(
    f"""WITH {SEG} SELECT file_id, speaker_id, round(quantile_cont(loudness_rms, 0.25), 6) AS q0, round(quantile_cont(loudness_rms, 0.5), 6) AS q1, round(quantile_cont(loudness_rms, 0.75), 6) AS q2
FROM seg GROUP BY ALL"""
)
def speaker_quantiles_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.quantiles(segments(spark, sf, ["loudness_rms"]), S.KEYS, "loudness_rms", [0.25, 0.5, 0.75]), "q0", "q1", "q2")


@R.add(
    f"""WITH {SEG} SELECT speaker_id, quantile_disc(loudness_rms, 0.25) AS q0, quantile_disc(loudness_rms, 0.5) AS q1, quantile_disc(loudness_rms, 0.75) AS q2 FROM seg GROUP BY speaker_id"""
)
def speaker_quantiles_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return S.quantiles(segments(spark, sf, ["loudness_rms"]), ["speaker_id"], "loudness_rms", [0.25, 0.5, 0.75], exact=False)


@R.add()
def speaker_quantiles_p2(spark: SparkSession, sf: str) -> DataFrame:
    return S.p2_quantiles(segments(spark, sf, ["loudness_rms"]), S.KEYS, "idx", "loudness_rms", 0.5)


@R.add(
    f"""WITH {SEG} SELECT file_id, speaker_id, count(loudness_rms) AS n, round(avg(loudness_rms), 9) AS mean, round(var_pop(loudness_rms), 10) AS variance, round(stddev_pop(loudness_rms), 10) AS deviation,
 min(loudness_rms) AS least, max(loudness_rms) AS largest FROM seg WHERE loudness_rms IS NOT NULL GROUP BY ALL"""
)
def speaker_moments_pop(spark: SparkSession, sf: str) -> DataFrame:
    df = S.moments(segments(spark, sf, ["loudness_rms"]), S.KEYS, "loudness_rms")
    return rounded(rounded(df, "mean", digits=9), "variance", "deviation", digits=10)


_MEAN = ", ".join(f"coalesce(avg({c}::DECIMAL(24,8)), 0.0) AS avg_{c}" for c in ("valence", "arousal", "dominance"))


@R.add(
    f"""WITH {_FOLD}, f AS (SELECT file_id, speaker_id, coalesce(made, 0) AS made, coalesce(received, 0) AS received FROM os FULL JOIN mr USING (file_id, speaker_id)),
 a AS (SELECT file_id, speaker_id, sum(e - s)::BIGINT AS duration_ms, sum({_WORDS.replace("coalesce(words::BIGINT, ", "(")})::BIGINT AS word_count, {_MEAN} FROM seg GROUP BY ALL), n AS {_NAME}
SELECT file_id, speaker_id, coalesce(speaker_name, speaker_id) AS speaker_name, coalesce(duration_ms, 0) AS duration_ms, coalesce(word_count, 0) AS word_count,
 round(coalesce(avg_valence, 0.0), 9) AS avg_valence, round(coalesce(avg_arousal, 0.0), 9) AS avg_arousal, round(coalesce(avg_dominance, 0.0), 9) AS avg_dominance,
 coalesce(made, 0) AS interruptions_made, coalesce(received, 0) AS interruptions_received
FROM a LEFT JOIN n USING (file_id, speaker_id) FULL JOIN f USING (file_id, speaker_id)"""
)
def legacy_speaker_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = S.profile(segments(spark, sf, ["speaker_name", "text", "valence", "arousal", "dominance"]), _fold(spark, sf))
    return rounded(df, "avg_valence", "avg_arousal", "avg_dominance", digits=9)


@R.add(
    f"""WITH {SEG}, a AS (SELECT file_id, speaker_id, sum(e - s) AS d, avg(valence::DECIMAL(24,8)) AS v FROM seg GROUP BY ALL),
 b AS (SELECT file_id, count(*) AS n FROM a GROUP BY 1), t AS (SELECT file_id, max(e) AS total FROM seg GROUP BY 1),
 w AS (SELECT file_id, coalesce(v, 0) AS v FROM a QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY d DESC, speaker_id) = 1)
SELECT file_id, n || ' speakers over ' || (total // 60000) || ' min; most-active tone ' || CASE WHEN v > 0.2 THEN 'positive' WHEN v < -0.2 THEN 'negative' ELSE 'neutral' END || '.' AS quick_take
FROM b JOIN t USING (file_id) JOIN w USING (file_id)"""
)
def quick_take(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, ["speaker_name", "text", "valence", "arousal", "dominance"])
    return S.quick_take(S.profile(rows, _fold(spark, sf)), C.durations(rows).select("file_id", "total"))


_EMOTIONS = "[" + ", ".join(f"'{e}'" for e in S.EMOTIONS) + "]"


@R.add(
    f"""WITH x AS (SELECT speaker_id, text_emotions_full_json::JSON AS j FROM speakers_summary WHERE trim(speaker_id) <> '' AND text_emotions_full_json IS NOT NULL),
 k AS (SELECT speaker_id, unnest(json_keys(j)) AS label, j FROM x), v AS (SELECT speaker_id, label, json_extract(j, '$."' || label || '"')::DOUBLE AS score FROM k),
 q AS (SELECT speaker_id, label, sum(greatest(coalesce(score, 0.0), 0.0)::DECIMAL(24,8)) AS v FROM v WHERE list_contains({_EMOTIONS}, label) GROUP BY ALL),
 t AS (SELECT speaker_id, sum(v) AS t FROM q GROUP BY 1 HAVING sum(v) > 0),
 sh AS (SELECT speaker_id, label, v::DOUBLE / t::DOUBLE AS share FROM q JOIN t USING (speaker_id) WHERE v > 0 UNION ALL
        SELECT DISTINCT speaker_id, 'neutral', 1.0 FROM v WHERE speaker_id NOT IN (SELECT speaker_id FROM t))
SELECT speaker_id, label, round(share, 6) AS share, (row_number() OVER (PARTITION BY speaker_id ORDER BY share DESC, list_position({_EMOTIONS}, label)))::INTEGER AS rank FROM sh"""
)
def speaker_emotion_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/speakers_summary.parquet").filter(squeezed(F.col("speaker_id")) != "")
    scores = rows.select("speaker_id", F.explode(F.from_json("text_emotions_full_json", "map<string,double>")).alias("label", "score"))
    return rounded(S.emotion_distribution(scores, ["speaker_id"], "label", "score"), "share")


@R.add(
    f"""WITH {SEG}, c AS (SELECT file_id, emotion_top, count(*) AS n, min(idx) AS i FROM seg WHERE trim(emotion_top) <> '' GROUP BY ALL),
 t AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY n DESC, i))::INTEGER AS rank FROM c)
SELECT file_id, emotion_top, n, rank FROM t WHERE rank <= 3 AND emotion_top <> 'unknown'"""
)
def emotion_top3(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = segments(spark, sf, ["emotion_top"]).filter("trim(emotion_top) <> ''")
    counts = rows.groupBy("file_id", "emotion_top").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("i"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("n").desc(), "i")))
    return ranked.filter("rank <= 3 AND emotion_top <> 'unknown'").select("file_id", "emotion_top", "n", "rank")


@R.add(f"WITH {SEG} SELECT file_id, count(DISTINCT coalesce(nullif(trim(speaker_name), ''), speaker_id)) AS speakers FROM seg GROUP BY 1")
def distinct_speakers(spark: SparkSession, sf: str) -> DataFrame:
    label = F.coalesce(F.nullif(F.trim("speaker_name"), F.lit("")), F.col("speaker_id"))
    return segments(spark, sf, ["speaker_name"]).groupBy("file_id").agg(F.countDistinct(label).alias("speakers"))


@R.add(
    f"""WITH {SEG}, d AS (SELECT speaker_id, sum(e - s)::BIGINT AS d FROM seg GROUP BY 1), t AS (SELECT sum(d) AS t FROM d)
SELECT speaker_id, d AS speech_ms, round(d / t::DOUBLE * 100, 6) AS share_pct FROM d, t ORDER BY d DESC, speaker_id LIMIT 3"""
)
def speaker_headlines(spark: SparkSession, sf: str) -> DataFrame:
    by = segments(spark, sf, []).groupBy("speaker_id").agg(F.sum(F.expr("e - s")).alias("speech_ms"))
    total = by.agg(F.sum("speech_ms").cast("double").alias("t")).scalar()
    top = by.orderBy(F.col("speech_ms").desc(), "speaker_id").limit(3)
    return top.select("speaker_id", "speech_ms", F.round(F.col("speech_ms") / total * 100, 6).alias("share_pct"))


@R.add(
    f"""WITH {SEG}, b AS (SELECT file_id, speaker_id, sum(e - s) AS d FROM seg GROUP BY ALL), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY d DESC, speaker_id) <= 2)
SELECT file_id, speaker_id, idx, s, e FROM seg SEMI JOIN k USING (file_id, speaker_id)"""
)
def max_speakers_cut(spark: SparkSession, sf: str) -> DataFrame:
    return S.main_speakers(segments(spark, sf, []), 2)


@R.add(f"WITH {SEG} SELECT file_id, idx, speaker_id, e - s AS length FROM seg QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY e - s DESC, s, idx) = 1")
def longest_segment(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest_segments(segments(spark, sf, []))


@R.add(
    f"""WITH {SEG}, f AS (SELECT file_id, speaker_id, s, idx FROM seg QUALIFY row_number() OVER (PARTITION BY file_id, speaker_id ORDER BY s, idx) = 1)
SELECT file_id, speaker_id, 'Speaker_' || row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS renamed FROM f"""
)
def first_seen_labels(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.sequences import first_seen_labels as run

    return run(segments(spark, sf, []), ["file_id"], "speaker_id", ["s", "idx"])


@R.add(
    f"""WITH {SEG}, c AS (SELECT (date_trunc('day', ingested_at))::DATE AS day, speaker_id, wpm FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1) WHERE wpm > 0 AND NOT isnan(wpm) AND trim(speaker_id) <> '')
SELECT day::VARCHAR AS day, count(*) AS n, count(DISTINCT speaker_id) AS speakers, max(wpm) AS fastest FROM c GROUP BY GROUPING SETS ((day), ())"""
)
def daily_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, speakers and the highest speed of each day of delivery, and of all (null)."""
    from talkgrid.operators.latest import latest_rows

    rows = latest_rows(spark.read.parquet(f"{sf}/segments.parquet"), "seg_id", "ingested_at", ["speaker_id", "wpm", "ingested_at"])
    rows = rows.filter((F.col("wpm") > 0) & ~F.isnan("wpm") & (squeezed(F.col("speaker_id")) != "")).withColumn("day", F.to_date("ingested_at").cast("string"))
    return rows.rollup("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_id").alias("speakers"), F.max("wpm").alias("fastest"))
