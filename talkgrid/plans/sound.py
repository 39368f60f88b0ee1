"""Queries of sound events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import sound as D
from talkgrid.operators.intervals import windows
from talkgrid.operators.sequences import hysteresis as run_hysteresis
from talkgrid.operators.sequences import median_filter
from talkgrid.plans.conversation import rounded
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import EV, SEG, events, segments
from talkgrid.storage import Workspace

R = Registry()
ENTER, LEAVE = 0.6, 0.45
FRAMES = f"""{EV}, fr AS (SELECT file_id, label, frame, frame * 500 AS t0, frame * 500 + 1000 AS t1, score FROM (
    SELECT file_id, label, s // 500 AS frame, max(score) AS score FROM ev GROUP BY ALL))"""
RUNS = f"""{FRAMES}, st AS (SELECT *, coalesce(last_value(CASE WHEN score >= {ENTER} THEN 1 WHEN score <= {LEAVE} THEN 0 END IGNORE NULLS) OVER (PARTITION BY file_id, label ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM fr),
 ws AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY file_id, label ORDER BY frame), 0) AS was FROM st),
 rn AS (SELECT *, sum(CASE WHEN on_ = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, label ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM ws WHERE on_ = 1 OR was = 1),
 hr AS (SELECT file_id, label, min(frame) AS first, max(frame) AS last, min(t0) AS s, max(t1) AS e, max(score) AS peak, count(*) AS frames FROM rn GROUP BY file_id, label, run)"""


@R.add(f"WITH {RUNS} SELECT * FROM hr")
def hysteresis_events(spark: SparkSession, sf: str) -> DataFrame:
    return run_hysteresis(D.to_frames(events(spark, sf)), ["file_id", "label"], ENTER, LEAVE)


@R.add(
    f"""WITH {RUNS}, f AS (SELECT *, lag(last) OVER (PARTITION BY file_id, label ORDER BY first) AS pl FROM hr WHERE last - first + 1 >= 2),
 g AS (SELECT *, sum(CASE WHEN pl IS NULL OR (first - pl - 1) * 500 > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, label ORDER BY first ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT file_id, label, min(first) AS first, max(last) AS last, max(peak) AS peak FROM g GROUP BY file_id, label, g"""
)
def hysteresis_min_frames(spark: SparkSession, sf: str) -> DataFrame:
    return D.events_by_frame_count(D.to_frames(events(spark, sf)), ENTER, LEAVE, 1000, 4000)


@R.add(
    f"""WITH {RUNS}, f AS (SELECT *, lag(e) OVER (PARTITION BY file_id, label ORDER BY s) AS pe FROM hr WHERE e - s >= CASE WHEN label = 'speech' THEN 2000 ELSE 1500 END),
 g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, label ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM f),
 m AS (SELECT file_id, label, min(s) AS s, max(e) AS e, greatest(0.0, least(1.0, max(peak))) AS score FROM g GROUP BY file_id, label, g)
SELECT file_id, label, s, e, score, e - s AS duration, round(score * (e - s) / 1000.0::DOUBLE, 6) AS weight FROM m"""
)
def sed_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.events_from_frames(D.to_frames(events(spark, sf)), ENTER, LEAVE, 1500, 5000, {"speech": 2000}), "weight")


@R.add(
    f"""WITH {FRAMES}, d AS (SELECT file_id, label, row_number() OVER (PARTITION BY file_id, label ORDER BY frame) AS frame, score FROM fr),
 x AS (SELECT *, list_sort([coalesce(lag(score, 2) OVER w, first_value(score) OVER a), coalesce(lag(score, 1) OVER w, first_value(score) OVER a), score,
   coalesce(lead(score, 1) OVER w, last_value(score) OVER a), coalesce(lead(score, 2) OVER w, last_value(score) OVER a)])[3] AS smooth FROM d
   WINDOW w AS (PARTITION BY file_id, label ORDER BY frame), a AS (PARTITION BY file_id, label ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT file_id, label, frame, score, smooth FROM x"""
)
def median_filter_frames(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.sequences import with_position

    frames = Workspace(spark).write(D.to_frames(events(spark, sf)).select("file_id", "label", "frame", "score"), "frames")
    dense = with_position(frames, ["file_id", "label"], ["frame"], 8192).drop("frame").withColumn("frame", F.col("pos") + 1)
    return median_filter(dense.select("file_id", "label", "frame", "score"), ["file_id", "label"], 5)


_COARSE = "CASE " + " ".join(f"WHEN regexp_matches(label, '{'|'.join(parts)}') THEN '{name}'" for name, parts in D.COARSE) + f" ELSE '{D.OTHER}' END"
_NOISE = f"regexp_matches(label, '{'|'.join(D.NOISE)}')"


@R.add(f"WITH {FRAMES} SELECT file_id, frame, {_COARSE} AS label, max(score) AS score FROM fr GROUP BY file_id, frame, {_COARSE}")
def label_collapse_max(spark: SparkSession, sf: str) -> DataFrame:
    return D.collapse_labels(D.to_frames(events(spark, sf)), D.coarse_label(F.col("label")))


@R.add(f"WITH {EV} SELECT label, {_COARSE} AS coarse, count(*) AS events FROM ev GROUP BY ALL")
def coarse_labels(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("label", D.coarse_label(F.col("label")).alias("coarse")).agg(F.count(F.lit(1)).alias("events"))


@R.add(
    f"""WITH {EV}, n AS (SELECT file_id, sum(score::DECIMAL(18,6))::DOUBLE AS noise_score FROM ev WHERE {_NOISE} GROUP BY 1)
SELECT file_id, noise_score, round(CASE WHEN noise_score <= 0 THEN 35.0 ELSE greatest(-5.0, least(35.0, 35.0 - 20.0 * log10(1.0 + 10.0 * noise_score))) END, 6) AS snr_db FROM n"""
)
def noise_score(spark: SparkSession, sf: str) -> DataFrame:
    by = events(spark, sf).filter(D.is_noise(F.col("label"))).groupBy("file_id").agg(F.sum(F.col("score").cast("decimal(18,6)")).cast("double").alias("noise_score"))
    return rounded(by.withColumn("snr_db", D.snr_from_noise(F.col("noise_score"))), "snr_db")


@R.add(f"WITH {FRAMES} SELECT * FROM (SELECT file_id, frame, label, score, (row_number() OVER (PARTITION BY file_id, frame ORDER BY score DESC, label))::INTEGER AS rank FROM fr) WHERE rank <= 3")
def frame_top3(spark: SparkSession, sf: str) -> DataFrame:
    return D.frame_top(D.to_frames(events(spark, sf)), 3).select("file_id", "frame", "label", "score", "rank")


ATTR = f"""{SEG}, {EV}, att AS (SELECT seg.file_id, idx, event_id, label, least(seg.e, ev.e) - greatest(seg.s, ev.s) AS overlap,
   ((least(seg.e, ev.e) - greatest(seg.s, ev.s)) * greatest(0.0, score))::DECIMAL(24,6) AS weight
   FROM seg JOIN ev ON seg.file_id = ev.file_id AND seg.s < ev.e AND ev.s < seg.e WHERE seg.e > seg.s AND ev.e > ev.s)"""


def _attributed(spark: SparkSession, sf: str) -> DataFrame:
    return D.attributed(segments(spark, sf, []), events(spark, sf))


@R.add(f"WITH {ATTR} SELECT file_id, idx, event_id, label, overlap, weight::DOUBLE AS weight FROM att")
def sed_event_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _attributed(spark, sf).withColumn("weight", F.col("weight").cast("double"))


@R.add(
    f"""WITH {ATTR}, g AS (SELECT file_id, idx, label, sum(overlap)::BIGINT AS overlap, sum(weight)::DOUBLE AS weight FROM att GROUP BY ALL),
 r AS (SELECT *, weight / overlap AS score, (row_number() OVER (PARTITION BY file_id, idx ORDER BY weight DESC, weight / overlap DESC, label))::INTEGER AS rank FROM g)
SELECT file_id, idx, rank, label, round(score, 9) AS score, overlap FROM r WHERE rank <= 3"""
)
def sed_top3_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.top_events(_attributed(spark, sf)), "score", digits=9)


@R.add(
    f"""WITH {ATTR}, g AS (SELECT file_id, idx, sum(overlap)::BIGINT AS o, sum(weight)::DOUBLE AS w FROM att GROUP BY ALL)
SELECT file_id, idx, greatest(-5.0::DOUBLE, least(35.0::DOUBLE, 35.0::DOUBLE - 35.0::DOUBLE * least(1.0::DOUBLE, 0.5::DOUBLE * least(1.0::DOUBLE, o / (e - s)::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, w / (e - s)::DOUBLE)))) AS snr_db FROM g JOIN seg USING (file_id, idx)"""
)
def sed_snr(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, [])
    return D.snr_from_events(D.attributed(rows, events(spark, sf)), rows)


@R.add(
    f"""WITH {EV}, g AS (SELECT file_id, label, sum(e - s)::BIGINT AS duration, sum((greatest(0.0, score) * (e - s))::DECIMAL(24,6))::DOUBLE AS weight FROM ev GROUP BY ALL)
SELECT file_id, label, duration, weight, round(CASE WHEN duration > 0 THEN weight / duration ELSE 0.0 END, 9) AS mean_score FROM g"""
)
def sed_summary_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.timeline_summary(events(spark, sf)), "mean_score", digits=9)


@R.add(
    f"""WITH {ATTR}, g AS (SELECT file_id, idx, count(*) AS n, sum(overlap)::BIGINT AS o FROM att GROUP BY ALL)
SELECT file_id, idx, coalesce(n, 0) AS event_count, coalesce(o, 0) AS overlap_ms, round(CASE WHEN e > s THEN least(1.0, coalesce(o, 0) / (e - s)::DOUBLE) ELSE 0.0 END, 9) AS overlap_ratio
FROM seg LEFT JOIN g USING (file_id, idx)"""
)
def turns_left_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, [])
    return rounded(D.segments_with_events(rows, D.attributed(rows, events(spark, sf))), "overlap_ratio", digits=9)


@R.add(
    f"""WITH {EV}, l AS (SELECT file_id, greatest(0, s - 50) AS s, e + 50 AS e, event_id FROM ev WHERE regexp_matches(label, 'speech|conversation|narration|whisper|child babble')),
 m AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM l),
 g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s - pm > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT file_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY file_id, g"""
)
def sed_speech_regions(spark: SparkSession, sf: str) -> DataFrame:
    return D.speech_regions(events(spark, sf))


@R.add(
    f"""WITH {EV} SELECT CASE WHEN grouping(label) = 1 THEN '(all)' ELSE label END AS label, CASE WHEN grouping(hour) = 1 THEN -1 ELSE hour END AS hour, count(*) AS events, max(score) AS best
FROM (SELECT label, s // 3600000 AS hour, score FROM ev) GROUP BY CUBE (label, hour)"""
)
def cube_label_hour(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("hour", F.expr("floor(s / 3600000D)"))
    out = rows.cube("label", "hour").agg(F.count(F.lit(1)).alias("events"), F.max("score").alias("best"), F.grouping("label").alias("gl"), F.grouping("hour").alias("gh"))
    return out.select(F.expr("IF(gl = 1, '(all)', label)").alias("label"), F.expr("IF(gh = 1, -1L, hour)").alias("hour"), "events", "best")


@R.add(
    f"""WITH {SEG}, w AS (SELECT file_id, idx, s, e, unnest(range(greatest(1, (ceil((e - s) / 750.0::DOUBLE))::BIGINT))) AS k FROM seg)
SELECT file_id, idx, k, s + k * 750 AS ws, least(s + k * 750 + 1500, e) AS we FROM w WHERE least(s + k * 750 + 1500, e) - (s + k * 750) >= 600"""
)
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows(segments(spark, sf, []), 1500, 750, least=600).select("file_id", "idx", "k", "ws", "we")


@R.add(
    f"""WITH {SEG}, w AS (SELECT file_id, idx, s, e, unnest(range(greatest(1, (ceil((e - s) / 1500.0::DOUBLE))::BIGINT))) AS k FROM seg WHERE e - s > 2000)
SELECT file_id, idx, k, s + k * 1500 AS ws, least(s + k * 1500 + 2000, e) AS we FROM w"""
)
def split_long_regions(spark: SparkSession, sf: str) -> DataFrame:
    return windows(segments(spark, sf, []).filter("e - s > 2000"), 2000, 1500).select("file_id", "idx", "k", "ws", "we")


@R.add(
    f"""WITH {SEG}, f AS (SELECT file_id, max(e) AS total FROM seg GROUP BY 1), c AS (SELECT file_id, total, unnest(range(greatest(1, ceil(total / 600000.0::DOUBLE)::BIGINT))) AS chunk_id FROM f WHERE total > 0)
SELECT file_id, chunk_id, chunk_id * 600000 AS start_ms, least((chunk_id + 1) * 600000, total) AS end_ms, CASE WHEN chunk_id > 0 THEN 2000 ELSE 0 END AS overlap_start,
 CASE WHEN (chunk_id + 1) * 600000 < total THEN 2000 ELSE 0 END AS overlap_end FROM c"""
)
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    files = segments(spark, sf, []).groupBy("file_id").agg(F.lit(0).cast("bigint").alias("s"), F.max("e").alias("e")).filter("e > 0")
    cut = windows(files, 600_000)
    return cut.select("file_id", F.col("k").alias("chunk_id"), F.col("ws").alias("start_ms"), F.col("we").alias("end_ms"), F.expr("IF(k > 0, 2000, 0)").alias("overlap_start"), F.expr("IF(we < e, 2000, 0)").alias("overlap_end"))


@R.add(
    f"""WITH {SEG}, n AS (SELECT file_id, count(*) AS n FROM seg GROUP BY 1), r AS (SELECT file_id, idx, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) - 1 AS pos FROM seg)
SELECT file_id, idx, pos FROM r JOIN n USING (file_id) WHERE pos % greatest(1, ceil(n / 50.0::DOUBLE)::BIGINT) = 0"""
)
def decimate_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every f-th segment of a file, so that about 50 are left; a feature of the sampling of analysis windows."""
    from talkgrid.operators.sequences import with_position

    rows = with_position(segments(spark, sf, []), ["file_id"], ["s", "idx"])
    counts = rows.groupBy("file_id").agg((F.max("pos") + 1).alias("n"))
    return rows.join(counts, "file_id").filter("pos % greatest(1L, CAST(ceil(n / 50.0D) AS bigint)) = 0").select("file_id", "idx", "pos")


@R.add(
    f"""WITH {SEG}, w AS (SELECT file_id, idx, s, e, unnest(range(greatest(0, (e - s - 1000) // 500) + 1)) AS k FROM seg WHERE e > s),
 a AS (SELECT file_id, idx, s + k * 500 AS ws, e FROM w UNION SELECT file_id, idx, greatest(s, e - 1000) AS ws, e FROM seg WHERE e > s)
SELECT file_id, idx, ws, least(ws + 1000, e) AS we FROM a"""
)
def analysis_windows(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.intervals import analysis_windows as run

    return run(segments(spark, sf, []), 1000, 500).select("file_id", "idx", "ws", "we")
