"""Queries of run bookkeeping, overlays and kernels of samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import runs as B
from talkgrid.operators import signal, waves
from talkgrid.operators import transcripts as T
from talkgrid.operators import vectors as V
from talkgrid.operators.intervals import windows
from talkgrid.plans.conversation import rounded
from talkgrid.plans.registry import Registry
from talkgrid.plans.vectors import _cen
from talkgrid.sources.tables import SEG, segments

R = Registry()
_FILLED = ["valence", "arousal", "dominance", "emotion_top", "intent_top", "noise_tag", "noise_score", "snr_db_sed"]
_TEXTS = ["emotion_top", "intent_top", "noise_tag"]


def _filled(c: str) -> str:
    """A column of the match by position if there is one, else by time, where it has a value."""
    known = lambda t: f"nullif({t}.{c}, '')" if c in _TEXTS else f"{t}.{c}"
    return f"coalesce(CASE WHEN p.idx IS NOT NULL THEN {known('p')} ELSE {known('t')} END, l.{c}) AS {c}"


@R.add(
    f"""WITH {SEG}, l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS pos FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS pos FROM seg WHERE timeline_mode IS NOT NULL),
 n AS (SELECT a.file_id, a.idx, b.idx AS other FROM l a JOIN r b ON a.file_id = b.file_id AND abs(a.s - b.s) <= 750 WHERE NOT EXISTS (FROM r WHERE r.file_id = a.file_id AND r.pos = a.pos)
       QUALIFY row_number() OVER (PARTITION BY a.file_id, a.idx ORDER BY abs(a.s - b.s), b.s, b.idx) = 1),
 near AS (SELECT n.file_id, n.idx, r.* EXCLUDE (file_id, idx) FROM n JOIN r ON r.file_id = n.file_id AND r.idx = n.other)
SELECT l.file_id, l.idx, {", ".join(map(_filled, _FILLED))},
  CASE WHEN p.idx IS NOT NULL THEN 'position' WHEN t.idx IS NOT NULL THEN 'time' END AS match
FROM l LEFT JOIN r p ON p.file_id = l.file_id AND p.pos = l.pos LEFT JOIN near t ON t.file_id = l.file_id AND t.idx = l.idx"""
)
def audio_affect_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with the measures of those that a run with a sound timeline made, by position, else by nearest start."""
    rows = segments(spark, sf, [*_FILLED, "timeline_mode"])
    rows = rows.select("file_id", "idx", "s", "timeline_mode", *_FILLED)
    return T.overlay(rows.drop("timeline_mode"), rows.filter("timeline_mode IS NOT NULL").drop("timeline_mode"), ["file_id"], _FILLED).drop("s")


@R.add(
    """WITH l AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1)
SELECT file_id, seg_id AS idx, coalesce("start", 0.0) AS start_time, coalesce(CASE WHEN "end" <> 0 THEN "end" END, coalesce("start", 0.0) + 0.5) AS end_time, speaker_id, coalesce(nullif(speaker_name, ''), speaker_id) AS speaker_name FROM l"""
)
def recogniser_inputs(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.latest import latest_rows

    rows = latest_rows(spark.read.parquet(f"{sf}/segments.parquet"), "seg_id", "ingested_at", ["file_id", "start", "end", "speaker_id", "speaker_name"])
    return T.recogniser_inputs(rows.withColumnRenamed("seg_id", "idx"))


@R.add(
    f"""WITH {SEG}, o AS (SELECT file_id, e, vad_unstable AS v, lag(vad_unstable) OVER (PARTITION BY file_id ORDER BY s, idx) AS p FROM seg),
 f AS (SELECT file_id, count(*) FILTER (v <> p) AS flips, max(e) AS total FROM o GROUP BY file_id)
SELECT file_id, flips, round(flips / greatest(1, total // 60000)::DOUBLE, 6) AS flips_per_min, flips / greatest(1, total // 60000)::DOUBLE > 0.5 AS unstable FROM f"""
)
def vad_instability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.unstable_files(segments(spark, sf, ["vad_unstable"]), 0.5), "flips_per_min")


@R.add(
    f"""WITH {SEG}, c AS (SELECT file_id, s // 600000 AS chunk, count(*) AS turns, sum(e - s)::BIGINT AS speech_ms, count(*) FILTER (coalesce(vad_unstable, false)) AS unstable FROM seg WHERE s >= 0 GROUP BY ALL)
SELECT file_id, count(*) AS chunks, sum(turns)::BIGINT AS turns, sum(speech_ms)::BIGINT AS speech_ms, sum(unstable)::BIGINT AS unstable FROM c GROUP BY file_id"""
)
def chunk_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunk_statistics(segments(spark, sf, ["vad_unstable"]).filter("s >= 0"))


@R.add("SELECT coalesce(artefact, '(none)') AS stage, count(*) AS runs, coalesce(sum(epoch_ms(received_at) - epoch_ms(written_at)), 0)::BIGINT AS ms, sum(coalesce(length(payload), 0))::BIGINT AS n FROM raw_exports GROUP BY ALL")
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, delay and size of each artefact's deliveries, as the stages of a run."""
    ms = F.unix_millis(F.col("received_at").cast("timestamp")) - F.unix_millis(F.col("written_at").cast("timestamp"))
    rows = spark.read.parquet(f"{sf}/raw_exports.parquet").select(F.coalesce("artefact", F.lit("(none)")).alias("stage"), ms.alias("ms"), F.length("payload").alias("n"))
    return B.stage_statistics(rows)


@R.add("SELECT file_id, epoch_us(checked_at) AS checked FROM audio_health ORDER BY checked_at DESC NULLS LAST, file_id LIMIT 20 OFFSET 10")
def health_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of recordings by the time of their check; a page is the feature."""
    rows = spark.read.parquet(f"{sf}/audio_health.parquet")
    out = B.page(rows.select("file_id", "checked_at"), [F.col("checked_at").desc_nulls_last(), F.col("file_id")], 20, 10)
    return out.select("file_id", F.unix_micros(F.col("checked_at").cast("timestamp")).alias("checked"))


@R.add("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text)[:16] AS sha16 FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", B.content_hash(text, "md5").alias("md5"), B.content_hash(text, "sha1").alias("sha1"), B.content_hash(text, "sha2", 16).alias("sha16"))


_SETTINGS = {"target_sr": 16_000, "denoise": "none", "loudness_mode": "asr"}


@R.add(
    """WITH e AS (SELECT file_id, speaker_id, written_at, word_count, interruptions_made FROM speakers_summary WHERE file_id IS NOT NULL AND speaker_id IS NOT NULL),
 w AS (SELECT file_id, speaker_id, arg_max(word_count, written_at) FILTER (word_count IS NOT NULL) AS word_count FROM e GROUP BY ALL)
SELECT e.file_id, e.speaker_id, epoch_us(max(e.written_at)) AS written, count(*) = 1 AS only_newest FROM e JOIN w ON w.file_id = e.file_id AND w.speaker_id = e.speaker_id AND (w.word_count IS NULL OR w.word_count = e.word_count) GROUP BY ALL"""
)
def usable_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries whose word count is that of the newest run, so that they may be used again: the newest, and whether it is the only one."""
    rows = spark.read.parquet(f"{sf}/speakers_summary.parquet").filter("file_id IS NOT NULL AND speaker_id IS NOT NULL").select("file_id", "speaker_id", "written_at", "word_count")
    entries = B.cache_entries(rows, "v1", F.col("word_count").cast("string"), B.signature(_SETTINGS, B.PREPROCESS_SETTINGS))
    # of the runs with a count, the newest one's is what must be met
    newest = rows.filter("word_count IS NOT NULL").groupBy("file_id", "speaker_id").agg(F.max_by("word_count", "written_at").alias("word_count"))
    wanted = rows.select("file_id", "speaker_id").distinct().join(newest, ["file_id", "speaker_id"], "left")
    wanted = B.cache_entries(wanted, "v1", F.col("word_count").cast("string"), B.signature(_SETTINGS, B.PREPROCESS_SETTINGS))
    good = B.usable(entries, wanted, ["file_id", "speaker_id"], ["version", "audio_sha16", "pp_signature"])
    counts = good.groupBy("file_id", "speaker_id").agg((F.count(F.lit(1)) == 1).alias("only_newest"))
    last = B.newest_usable(entries, wanted, ["file_id", "speaker_id"], ["version", "audio_sha16", "pp_signature"], "written_at")
    return last.join(counts, ["file_id", "speaker_id"]).select("file_id", "speaker_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("written"), "only_newest")


@R.add(
    f"""WITH {SEG} SELECT file_id, idx, coalesce(valence, 0.0) AS valence, coalesce(arousal, 0.0) AS arousal, coalesce(dominance, 0.0) AS dominance, coalesce(emotion_top, 'neutral') AS emotion_top,
 coalesce(low_confidence_ser, false) AS low_confidence_ser, coalesce(intent_top, 'status_update') AS intent_top FROM seg"""
)
def affect_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, ["valence", "arousal", "dominance", "emotion_top", "low_confidence_ser", "intent_top"])
    return T.flat_affect(T.nested_affect(rows, ["file_id", "idx"]), ["file_id", "idx"])


@R.add(
    rf"""WITH {SEG}, w AS (SELECT file_id, idx, s, e, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM seg WHERE trim(text) <> '' AND e > s),
 u AS (SELECT file_id, idx, s, e, unnest(range(len(words))) AS i, unnest(words) AS word, len(words) AS n FROM w),
 t AS (SELECT file_id, idx, word, i, s + (i * (e - s)) // n AS ws, s + ((i + 1) * (e - s)) // n AS we FROM u),
 k AS (SELECT file_id, idx, s, e, unnest(range(greatest(1, ceil((e - s) / 2000.0::DOUBLE)::BIGINT))) AS k FROM seg WHERE trim(text) <> '' AND e > s),
 b AS (SELECT *, s + k * 2000 AS bs, least(s + k * 2000 + 2000, e) AS be FROM k)
SELECT b.file_id, b.idx, b.k, coalesce(string_agg(word, ' ' ORDER BY i), '[silence]') AS text, arg_min(ws - bs, i) AS first_at, arg_max(we - bs, i) AS last_to
FROM b LEFT JOIN t ON b.file_id = t.file_id AND b.idx = t.idx AND t.ws < be AND t.we > bs GROUP BY ALL"""
)
def timed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with times dealt to pieces of 2 s of their segment, in the time of the piece."""
    rows = segments(spark, sf, ["text"]).filter("trim(text) <> '' AND e > s")
    pieces = windows(rows.select("file_id", "idx", "s", "e"), 2000).select("file_id", "idx", "k", F.col("ws").alias("s"), F.col("we").alias("e"), F.lit(0).cast("bigint").alias("origin"))
    parts = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    words = rows.select("file_id", "idx", F.col("s").alias("from"), F.col("e").alias("to"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "word"))
    words = words.select("file_id", "idx", F.col("i").cast("bigint").alias("i"), "word", F.expr("from + (i * (to - from)) div n").alias("s"), F.expr("from + ((i + 1) * (to - from)) div n").alias("e"))
    out = T.words_to_boundaries(words, pieces, ["file_id", "idx"])
    return out.select("file_id", "idx", "k", "text", F.try_element_at("words", F.lit(1))["s"].alias("first_at"), F.try_element_at("words", F.lit(-1))["e"].alias("last_to"))


@R.add(
    f"""WITH {_cen('true', 'ce')} SELECT 'all' AS file_id, (SELECT count(*) FROM ce_l) AS labels, round(max(1 - list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)) + 1e-9)), 6) AS apart FROM ce_l a, ce_l b WHERE a.label < b.label"""
)
def centroid_spread(spark: SparkSession, sf: str) -> DataFrame:
    middles = V.centroids(spark.read.parquet(f"{sf}/embeddings.parquet"), ["label"], "embedding").withColumn("file_id", F.lit("all"))
    return rounded(V.centroid_spread(middles, ["file_id"]), "apart")


@R.add()
def spectral_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral clusters of the labels' centroids."""
    middles = V.centroids(spark.read.parquet(f"{sf}/embeddings.parquet"), ["label"], "embedding").withColumn("file_id", F.lit("all"))
    return rounded(V.spectral_cluster(middles, ["file_id"], "label", "centroid"), "silhouette")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as short chunks of samples, for the kernels: 64 a second."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("embedding IS NOT NULL")
    return rows.select(F.col("label").cast("string").alias("path"), F.col("vec_id").cast("int").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("samples"), F.lit(64).alias("rate"))


_SAMPLES = "smp AS (SELECT label::VARCHAR AS path, vec_id::INTEGER AS chunk_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL)"
_HEALTH = "rms_db double, snr_db double, dynamic_range_db double, silence_ratio double, clipping_detected boolean"


@R.add(
    f"""WITH {_SAMPLES}, h AS (SELECT path, chunk_id, avg(x * x) AS p, quantile_cont(x * x, 0.1) AS q, quantile_cont(abs(x) + 1e-12, 0.05) AS lo, quantile_cont(abs(x) + 1e-12, 0.95) AS hi, avg((abs(x) < 0.001)::INTEGER) AS quiet, max(abs(x)) AS peak FROM smp GROUP BY ALL)
SELECT path, chunk_id, round(20 * log10(sqrt(p + 1e-12)), 5) AS rms_db, round(CASE WHEN p > 0 THEN 10 * log10(p / greatest(q, 1e-12)) ELSE 0.0 END, 5) AS snr_db, round(greatest(0.0, 20 * log10(greatest(hi, 1e-12)) - 20 * log10(greatest(lo, 1e-12))), 5) AS dynamic_range_db,
 round(quiet, 5) AS silence_ratio, peak >= 0.999 AS clipping_detected FROM h"""
)
def chunk_health(spark: SparkSession, sf: str) -> DataFrame:
    out = signal.per_chunk(_chunks(spark, sf), signal.health, _HEALTH)
    return rounded(out, "rms_db", "snr_db", "dynamic_range_db", "silence_ratio", digits=5)


def _series(chunks: DataFrame, kernel) -> DataFrame:
    """``kernel`` of each chunk as rows ``path``, ``chunk_id``, ``i``, ``y``."""
    out = signal.per_chunk(chunks, lambda y, rate: {"y": np.round(kernel(y.astype(np.float64), rate), 6).tolist()}, "y array<double>")
    return out.select("path", "chunk_id", F.posexplode("y").alias("i", "y"))


@R.add(
    f"""WITH {_SAMPLES}, d AS (SELECT a.path, a.chunk_id, a.i, CASE WHEN b.i = 0 THEN power(0.85::DOUBLE, a.i) ELSE 0.15::DOUBLE * power(0.85::DOUBLE, a.i - b.i) END * b.x AS t FROM smp a JOIN smp b ON a.path = b.path AND a.chunk_id = b.chunk_id AND b.i <= a.i)
SELECT path, chunk_id, i::INTEGER AS i, round(sum(t), 6) AS y FROM d GROUP BY ALL"""
)
def smoothed_exponentially(spark: SparkSession, sf: str) -> DataFrame:
    return _series(_chunks(spark, sf), lambda y, rate: waves.smooth_exponential(y, 0.15))


@R.add(
    f"""WITH {_SAMPLES} SELECT path, chunk_id, i::INTEGER AS i, round(0.25 * coalesce(lag(x) OVER w, x) + 0.5 * x + 0.25 * coalesce(lead(x) OVER w, x), 6) AS y FROM smp WINDOW w AS (PARTITION BY path, chunk_id ORDER BY i)"""
)
def smoothed_by_hann(spark: SparkSession, sf: str) -> DataFrame:
    return _series(_chunks(spark, sf), lambda y, rate: waves.smooth_hann(y, 5))


@R.add(
    f"""WITH {_SAMPLES}, f AS (SELECT path, chunk_id, n, unnest(range(greatest(1, ceil((n - 16) / 8.0::DOUBLE)::BIGINT + 1))) AS f FROM (SELECT DISTINCT path, chunk_id, n FROM smp))
SELECT f.path, f.chunk_id, f::INTEGER AS i, round(sqrt(avg(x * x)), 6) AS y FROM f JOIN smp ON smp.path = f.path AND smp.chunk_id = f.chunk_id AND i >= f * 8 AND i < f * 8 + 16 GROUP BY ALL"""
)
def frame_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _series(_chunks(spark, sf), lambda y, rate: signal.frame_rms(y, 16, 8))


@R.add(
    f"""WITH {_SAMPLES} SELECT path, chunk_id, round(10 * log10((avg(x * x) + 1e-9) / (var_pop(d) + 1e-9)), 5) AS snr_db, max(abs(x)) > 0.95 AS limited
FROM (SELECT *, x - lag(x) OVER (PARTITION BY path, chunk_id ORDER BY i) AS d FROM smp) GROUP BY path, chunk_id"""
)
def chunk_snr(spark: SparkSession, sf: str) -> DataFrame:
    kernel = lambda y, rate: {"snr_db": waves.snr_by_differences(y), "limited": bool(np.abs(waves.limit_peak(y) - y).max(initial=0.0) > 0)}
    return rounded(signal.per_chunk(_chunks(spark, sf), kernel, "snr_db double, limited boolean"), "snr_db", digits=5)


@R.add(
    f"""WITH c AS (SELECT label::VARCHAR AS path, vec_id::INTEGER AS chunk_id, embedding, len(embedding) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL),
 t AS (SELECT path, chunk_id, CASE WHEN r > 1 AND 4 < n THEN 4 ELSE 0 END AS cut, embedding, n FROM c)
SELECT path, chunk_id, coalesce(sum(n - cut) OVER (PARTITION BY path ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, n - cut AS length, round(embedding[cut + 1]::DOUBLE, 6) AS first FROM t"""
)
def joined_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that share four samples with the one before, put together."""
    out = B.chunk_offsets(_chunks(spark, sf).withColumn("overlap", F.lit(4)), ["path"], "chunk_id")
    return out.select("path", "chunk_id", F.col("at").cast("bigint").alias("at"), F.size("samples").cast("bigint").alias("length"), F.round(F.try_element_at("samples", F.lit(1)), 6).alias("first"))


@R.add()
def chunk_features(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral shape, pauses, pitch and voice quality of each chunk, played at 8,000 samples a second and repeated to half a second."""

    def kernel(y: np.ndarray, rate: int) -> dict:
        wave = np.tile(y, -(-4000 // max(1, len(y))))[:4000]
        found = waves.spectral_shape(wave, 8000) | signal.pauses(wave, 8000) | signal.pitch(wave, 8000) | waves.voice_quality(wave, 8000) | waves.quality(wave, 8000)
        return {k: round(v, 6) if isinstance(v, float) else v for k, v in found.items()}

    names = [
        "centroid_median", "centroid_iqr", "flatness_median", "pause_count", "long_pauses", "pause_time_s", "pause_ratio", "f0_median_hz", "f0_iqr_hz", "voiced_frames", "jitter_pct", "shimmer_db", "hnr_db", "cpps_db",
        "voiced_ratio", "spectral_slope_db", "snr_db",
    ]
    return signal.per_chunk(_chunks(spark, sf), kernel, ", ".join(f"{n} double" for n in names) + ", reliable boolean, status string")
