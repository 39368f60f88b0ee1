"""Queries of turn taking, interruptions, overlap and energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import conversation as C
from talkgrid.operators import overlap as O
from talkgrid.operators.sequences import gap_merge, turns
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import SEG, segments

R = Registry()
ROUND = 6
_BASE = ["file_id", "speaker_id"]


def rounded(df: DataFrame, *columns: str, digits: int = ROUND) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: Common table expressions on ``seg``: rows with their predecessor, turns, responses, durations and shares.
FLOW = f"""{SEG},
 o AS (SELECT file_id, idx, speaker_id, s, e, lag(e) OVER w AS pe, lag(speaker_id) OVER w AS ps FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY s, idx)),
 t AS (SELECT file_id, idx, speaker_id, s, e, s - lag(e) OVER (PARTITION BY file_id ORDER BY s, idx) AS latency FROM o WHERE (ps IS NULL OR ps <> speaker_id) AND e > s),
 r AS (SELECT * FROM t WHERE latency BETWEEN 0 AND 5000),
 f AS (SELECT file_id, max(e) AS total, sum(e - s)::BIGINT AS speech, count(*) AS segments FROM seg GROUP BY file_id),
 d AS (SELECT file_id, speaker_id, sum(e - s)::BIGINT AS speech FROM seg GROUP BY ALL),
 p AS (SELECT d.file_id, d.speaker_id, d.speech, CASE WHEN f.speech > 0 THEN d.speech / f.speech::DOUBLE * 100 END AS share_pct FROM d JOIN f USING (file_id)),
 b AS (SELECT file_id, CASE WHEN count(*) > 1 THEN -sum(share_pct / 100 * log2(share_pct / 100)) / log2(count(*)) ELSE 0.0 END AS balance, max(share_pct) AS dominance_max
       FROM p WHERE speech > 0 GROUP BY file_id)"""


@R.add(
    f"""WITH {FLOW}, i AS (SELECT file_id, count(*) AS cuts FROM o WHERE s < pe GROUP BY file_id),
 g AS (SELECT file_id, count(*) AS turns, sum(e - s) AS turn_ms FROM t GROUP BY file_id),
 a AS (SELECT file_id, count(*) AS answers, sum(latency) AS latency, quantile_cont(latency, 0.5) AS median FROM r GROUP BY file_id)
SELECT f.file_id, round(coalesce(balance, 0.0), 6) AS turn_taking_balance, round(coalesce(dominance_max, 0.0), 6) AS dominance_max,
       round(CASE WHEN total > 0 THEN coalesce(cuts, 0) / (total / 60000.0::DOUBLE) ELSE 0.0 END, 6) AS interruption_rate_per_min,
       round(coalesce(turn_ms / (turns * 1000.0::DOUBLE), 0.0), 6) AS avg_turn_duration_sec,
       round(CASE WHEN total > 0 THEN coalesce(turns, 0) / (total / 60000.0::DOUBLE) ELSE 0.0 END, 6) AS turns_per_min,
       round(coalesce(latency / (answers * 1000.0::DOUBLE), 0.0), 6) AS latency_avg_sec, round(coalesce(median / 1000.0::DOUBLE, 0.0), 6) AS latency_median_sec,
       coalesce(answers, 0) AS latency_count,
       round(CASE WHEN total > 0 THEN greatest(0.0, least(1.0, 1 - speech / total::DOUBLE)) ELSE 1.0 END, 6) AS silence_ratio
FROM f LEFT JOIN b USING (file_id) LEFT JOIN i USING (file_id) LEFT JOIN g USING (file_id) LEFT JOIN a USING (file_id)"""
)
def conversation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = C.conversation_metrics(segments(spark, sf, _BASE))
    return rounded(df, *[c for c, t in df.dtypes if t == "double"])


@R.add(f"WITH {FLOW} SELECT file_id, speaker_id, speech, round(share_pct, 6) AS share_pct FROM p")
def speaker_dominance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.speaker_dominance(segments(spark, sf, _BASE)), "share_pct")


@R.add(f"WITH {FLOW} SELECT file_id, round(coalesce(balance, 0.0), 6) AS balance, round(coalesce(dominance_max, 0.0), 6) AS dominance_max FROM f LEFT JOIN b USING (file_id)")
def turn_balance_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.turn_balance(segments(spark, sf, _BASE)), "balance", "dominance_max")


@R.add(f"WITH {FLOW} SELECT file_id, idx, speaker_id, s, e FROM t")
def turns_extract(spark: SparkSession, sf: str) -> DataFrame:
    return turns(segments(spark, sf, _BASE), ["file_id"]).select("file_id", "idx", "speaker_id", "s", "e")


@R.add(f"WITH {FLOW} SELECT file_id, idx, speaker_id, pe - s AS late_by FROM o WHERE s < pe")
def interruptions_prev_row(spark: SparkSession, sf: str) -> DataFrame:
    return C.interruptions_by_row(segments(spark, sf, _BASE))


@R.add(
    f"""WITH {FLOW} SELECT file_id, speaker_id, count(*) AS cuts, round(count(*) / (any_value(total) / 60000.0::DOUBLE), 6) AS per_min
FROM o JOIN f USING (file_id) WHERE s < pe AND total > 0 GROUP BY file_id, speaker_id"""
)
def interruption_rate_by_speaker(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, _BASE)
    cuts = C.interruptions_by_row(rows).groupBy("file_id", "speaker_id").agg(F.count(F.lit(1)).alias("cuts"))
    total = C.durations(rows).filter("total > 0")
    return cuts.join(total, "file_id").select("file_id", "speaker_id", "cuts", F.round(F.expr("cuts / (total / 60000.0D)"), ROUND).alias("per_min"))


@R.add(f"WITH {FLOW} SELECT file_id, idx, speaker_id, latency FROM r")
def response_latency(spark: SparkSession, sf: str) -> DataFrame:
    return C.responses(segments(spark, sf, _BASE))


@R.add(f"WITH {FLOW} SELECT file_id, round(CASE WHEN total > 0 THEN greatest(0.0, least(1.0, 1 - speech / total::DOUBLE)) ELSE 1.0 END, 6) AS silence_ratio FROM f")
def silence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.expr("CASE WHEN total > 0 THEN greatest(0.0D, least(1.0D, 1 - speech / CAST(total AS double))) ELSE 1.0D END")
    return C.durations(segments(spark, sf, _BASE)).select("file_id", F.round(ratio, ROUND).alias("silence_ratio"))


@R.add(
    f"""WITH {FLOW}, grid AS (SELECT file_id, total, unnest(range(greatest(1, total // 30000))) AS w FROM f WHERE total > 0),
 c AS (SELECT *, w * 30000 AS ws, least((w + 1) * 30000, total) AS we FROM grid),
 m AS (SELECT c.file_id, c.w, sum(coalesce(arousal, 0)::DECIMAL(18,6))::DOUBLE AS a, count(*) AS n, sum(greatest(0, least(e, we) - greatest(s, ws))) AS spoken,
              count(DISTINCT speaker_id) AS speakers
       FROM c JOIN seg ON c.file_id = seg.file_id AND s < we AND e > ws GROUP BY ALL)
SELECT c.file_id, ws, we, round(coalesce(a / n * (spoken / 30000.0::DOUBLE), 0.0), 9) AS energy, coalesce(speakers, 0) AS active_speakers,
       round(coalesce(spoken, 0) / 30000.0::DOUBLE, 9) AS speech_density FROM c LEFT JOIN m USING (file_id, w)"""
)
def energy_flow_30s(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.energy_flow(segments(spark, sf, [*_BASE, "arousal"])), "energy", "speech_density", digits=9)


@R.add(
    rf"""WITH {SEG}, w AS (SELECT file_id, idx, s, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: length(x) > 3)) AS terms FROM seg),
 q AS (SELECT file_id, terms, lag(terms) OVER (PARTITION BY file_id ORDER BY s, idx) AS pt FROM w),
 j AS (SELECT file_id, CASE WHEN len(terms) > 0 AND len(pt) > 0 THEN len(list_intersect(terms, pt)) / len(list_distinct(list_concat(terms, pt)))::DOUBLE END AS j FROM q)
SELECT file_id, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE coalesce(avg(j), 0.0) END, 6) AS coherence FROM j GROUP BY file_id"""
)
def topic_coherence_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.topic_coherence(segments(spark, sf, [*_BASE, "text"])), "coherence")


#: Pairs of segments of a file that overlap by 50 ms or more; interruptions among them.
PAIRS = f"""{SEG}, pr AS (SELECT a.file_id, a.speaker_id AS sa, b.speaker_id AS sb, a.s AS s_a, b.s AS s_b, least(a.e, b.e) - b.s AS ov
   FROM seg a JOIN seg b ON a.file_id = b.file_id AND (a.s < b.s OR (a.s = b.s AND a.idx < b.idx)) AND a.s < b.e AND b.s < a.e WHERE least(a.e, b.e) - b.s >= 50),
 ir AS (SELECT file_id, s_b AS at_ms, CASE WHEN s_b > s_a THEN sb ELSE sa END AS interrupter, CASE WHEN s_b > s_a THEN sa ELSE sb END AS interrupted, ov AS overlap_ms
        FROM pr WHERE sa <> sb AND s_b - s_a <= 150)"""


@R.add(
    f"""WITH {PAIRS}, sp AS (SELECT file_id, max(e) - min(s) AS span FROM seg GROUP BY file_id), po AS (SELECT file_id, sum(ov)::BIGINT AS ov FROM pr GROUP BY file_id)
SELECT file_id, coalesce(ov, 0) AS overlap_ms, round(CASE WHEN span > 0 THEN coalesce(ov, 0) / span::DOUBLE ELSE 0.0 END, 6) AS overlap_ratio FROM sp LEFT JOIN po USING (file_id)"""
)
def overlap_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.overlap_totals(segments(spark, sf, _BASE)), "overlap_ratio")


@R.add(f"WITH {PAIRS} SELECT file_id, speaker_id, sum(ov)::BIGINT AS overlap_ms FROM (SELECT file_id, sa AS speaker_id, ov FROM pr UNION ALL SELECT file_id, sb, ov FROM pr) GROUP BY ALL")
def overlap_by_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return O.overlap_by_speaker(O.pairs(segments(spark, sf, _BASE)))


@R.add(f"WITH {PAIRS} SELECT * FROM ir")
def interruption_events(spark: SparkSession, sf: str) -> DataFrame:
    return O.interruptions(O.pairs(segments(spark, sf, _BASE)))


_FOLD = f"""{PAIRS}, mr AS (SELECT file_id, speaker_id, sum(made)::BIGINT AS made, sum(received)::BIGINT AS received FROM (
    SELECT file_id, interrupter AS speaker_id, 1 AS made, 0 AS received FROM ir UNION ALL SELECT file_id, interrupted, 0, 1 FROM ir) GROUP BY ALL),
 os AS (SELECT file_id, speaker_id, sum(ov)::BIGINT AS overlap_ms FROM (SELECT file_id, sa AS speaker_id, ov FROM pr UNION ALL SELECT file_id, sb, ov FROM pr) GROUP BY ALL)"""


@R.add(
    f"""WITH {_FOLD} SELECT file_id, speaker_id, coalesce(made, 0) AS made, coalesce(received, 0) AS received, coalesce(overlap_ms, 0) AS overlap_ms
FROM os FULL JOIN mr USING (file_id, speaker_id)"""
)
def interruptions_made_received(spark: SparkSession, sf: str) -> DataFrame:
    return O.interruption_fold(O.pairs(segments(spark, sf, _BASE)))


@R.add(
    f"""WITH {PAIRS}, sp AS (SELECT file_id, max(e) - min(s) AS span, max(e) AS total FROM seg GROUP BY file_id), po AS (SELECT file_id, sum(ov)::BIGINT AS ov FROM pr GROUP BY file_id)
SELECT file_id, coalesce(ov, 0) AS overlap_ms, round(CASE WHEN span > 0 THEN 100 * coalesce(ov, 0) / span::DOUBLE ELSE 0.0 END, 6) AS overlap_pct,
       round(CASE WHEN total > 0 THEN greatest(0.0, least(100.0, 100 * coalesce(ov, 0) / total::DOUBLE)) END, 6) AS overlap_of_duration_pct, true AS overlap_available
FROM sp LEFT JOIN po USING (file_id)"""
)
def overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.overlap_summary(segments(spark, sf, _BASE)), "overlap_pct", "overlap_of_duration_pct")


@R.add(
    f"""WITH {SEG}, m AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM seg),
 g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s - pm > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, idx ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT file_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY file_id, g"""
)
def gap_merge_regions(spark: SparkSession, sf: str) -> DataFrame:
    return gap_merge(segments(spark, sf, _BASE), ["file_id"], 500)


@R.add(
    f"""WITH {FLOW}, x AS (SELECT file_id, speaker_id, s, e, idx, CASE WHEN ps = speaker_id AND s - pe BETWEEN 0 AND 1000 THEN 0 ELSE 1 END AS fresh FROM o),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s, idx ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT file_id, any_value(speaker_id) AS speaker_id, min(s) AS s, arg_max(e, {{'s': s, 'i': idx}}) AS e, count(*) AS members FROM g GROUP BY file_id, g"""
)
def same_speaker_merge(spark: SparkSession, sf: str) -> DataFrame:
    return O.same_speaker_merge(segments(spark, sf, _BASE), 1000)


@R.add(
    f"""WITH {FLOW} SELECT CASE WHEN grouping(file_id) = 1 THEN '(all)' ELSE file_id END AS file_id, CASE WHEN grouping(speaker_id) = 1 THEN '(all)' ELSE speaker_id END AS speaker_id,
 sum(e - s)::BIGINT AS speech_ms, count(*) AS segments FROM seg GROUP BY ROLLUP (file_id, speaker_id)"""
)
def rollup_file_speaker(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, _BASE).rollup("file_id", "speaker_id").agg(
        F.sum(F.expr("e - s")).alias("speech_ms"), F.count(F.lit(1)).alias("segments"), F.grouping("file_id").alias("gf"), F.grouping("speaker_id").alias("gs")
    )
    return rows.select(F.expr("IF(gf = 1, '(all)', file_id)").alias("file_id"), F.expr("IF(gs = 1, '(all)', speaker_id)").alias("speaker_id"), "speech_ms", "segments")
