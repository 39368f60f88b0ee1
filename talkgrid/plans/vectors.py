"""Queries of vectors, speech recognition helpers and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import conversation as C
from talkgrid.operators import streams as Q
from talkgrid.operators import transcripts as T
from talkgrid.operators import vectors as V
from talkgrid.operators.latest import latest_rows
from talkgrid.plans.conversation import FLOW, rounded
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import EV, SEG, events, segments

R = Registry()


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _cen(where: str, name: str) -> str:
    """Unit centroids by label as rows (label, pos, x) in a table ``name``, and as lists in ``name``_l."""
    return f"""{name}_m AS (SELECT label, pos, avg(x::DOUBLE) AS x, count(*) AS n FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings WHERE {where}) GROUP BY ALL),
 {name} AS (SELECT label, pos, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) AS x, n FROM {name}_m), {name}_l AS (SELECT label, list(x ORDER BY pos) AS c, max(n) AS n FROM {name} GROUP BY label)"""


@R.add(f"WITH {_cen('true', 'ce')} SELECT label, pos::INTEGER AS pos, round(x, 6) AS x, n AS members FROM ce")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.centroids(_vectors(spark, sf), ["label"], "embedding").select("label", F.posexplode("centroid").alias("pos", "x"), "members"), "x")


def _named(df: DataFrame, *columns: F.Column) -> DataFrame:
    return df.select(F.concat(F.lit("Speaker_"), F.col("label").cast("string")).alias("name"), *columns)


_SIM = f"""{_cen('true', 'rg')}, sm AS (SELECT vec_id, 'Speaker_' || rg_l.label AS name, list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c)) + 1e-9) AS sim FROM embeddings, rg_l),
 bm AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1)"""


@R.add(f"WITH {_SIM} SELECT vec_id, name, round(sim, 6) AS similarity, CASE WHEN sim >= 0.3 THEN name END AS assigned, sim >= 0.2 AND sim < 0.3 AS needs_review FROM bm")
def registry_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against a registry of the centroids of all labels."""
    registry = _named(V.centroids(_vectors(spark, sf), ["label"], "embedding"), F.col("centroid"))
    return rounded(V.assign_names(V.match_registry(_vectors(spark, sf), "vec_id", "embedding", registry), 0.3, 0.2), "similarity")


@R.add(
    f"""WITH f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v, count(*) AS n FROM embeddings GROUP BY label), fu AS (SELECT label, v, n, sqrt(list_dot_product(v, v)) + 1e-9 AS l FROM f),
 od AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) / l AS x FROM fu), {_cen('true', 'nw')}, b AS (SELECT o.label, o.pos, CASE WHEN fu.n > 1 THEN o.x * 0.7 + n.x * 0.3 ELSE o.x END AS x, fu.n > 1 AS moved FROM od o JOIN fu USING (label) JOIN nw n ON o.label = n.label AND o.pos = n.pos)
SELECT 'Speaker_' || label AS name, CASE WHEN moved THEN 2 ELSE 1 END::BIGINT AS samples, pos::INTEGER AS pos, round(CASE WHEN moved THEN x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) ELSE x END, 6) AS x FROM b"""
)
def registry_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Speakers enrolled with their first vector, and moved by the centroid of all if they have more."""
    rows = _vectors(spark, sf)
    first = _named(rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")), V.unit(F.col("v")).alias("centroid"), F.lit(1).cast("bigint").alias("samples"))
    fresh = _named(V.centroids(rows, ["label"], "embedding").filter("members > 1"), F.col("centroid"))
    return rounded(V.update_registry(first, fresh).select("name", "samples", F.posexplode("centroid").alias("pos", "x")), "x")


@R.add(f"WITH {_cen('true', 'ce')} SELECT vec_id, e.label, round(1 - list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c)) + 1e-9), 6) AS distance FROM embeddings e JOIN ce_l USING (label)")
def distance_to_centroid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return rounded(rows.join(V.centroids(rows, ["label"], "embedding"), "label").select("vec_id", "label", (1 - V.cosine(F.col("embedding"), F.col("centroid"))).alias("distance")), "distance")


@R.add()
def ahc_labels(spark: SparkSession, sf: str) -> DataFrame:
    return V.cluster(_vectors(spark, sf).withColumn("all", F.lit(1)), ["all"], "vec_id", "embedding", 0.6)


@R.add(
    f"""WITH {FLOW}, tt AS (SELECT file_id, sum(speech)::BIGINT AS total, count(*) AS n FROM d GROUP BY 1), x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY speech DESC, speaker_id) = 1),
 z AS (SELECT d.file_id, max(d.speech) AS second FROM d JOIN x ON d.file_id = x.file_id AND d.speaker_id <> x.speaker_id GROUP BY 1)
SELECT file_id, x.speaker_id, round(x.speech / total::DOUBLE, 9) AS share, n > 1 AND x.speech / total::DOUBLE >= 0.6 AND coalesce(second, 0) < 120000 AS collapse FROM tt JOIN x USING (file_id) LEFT JOIN z USING (file_id) WHERE total > 0"""
)
def collapse_single_speaker(spark: SparkSession, sf: str) -> DataFrame:
    by = C.speaker_dominance(segments(spark, sf, [])).select("file_id", "speaker_id", "speech")
    return rounded(V.collapse_speakers(by, 0.6, secondary_min=120_000), "share", digits=9)


@R.add(f"WITH {FLOW} SELECT file_id, speaker_id, count(*) AS turns, sum(e - s)::BIGINT AS turn_ms FROM t GROUP BY ALL")
def turn_summary(spark: SparkSession, sf: str) -> DataFrame:
    from talkgrid.operators.sequences import turns

    return turns(segments(spark, sf, []), ["file_id"]).groupBy("file_id", "speaker_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.expr("e - s")).alias("turn_ms"))


@R.add(
    f"""WITH RECURSIVE {SEG}, c AS (SELECT file_id, idx, s, e - s AS d, count(*) OVER (PARTITION BY file_id) AS n FROM seg),
 el AS (SELECT file_id, idx, d, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS rn FROM c WHERE n >= 12 AND d <= 8000),
 w(file_id, idx, rn, batch, ms, cnt) AS (SELECT file_id, idx, rn, 0, d, 1 FROM el WHERE rn = 1 UNION ALL
   SELECT el.file_id, el.idx, el.rn, CASE WHEN ms + d > 300000 OR cnt >= 50 THEN batch + 1 ELSE batch END, CASE WHEN ms + d > 300000 OR cnt >= 50 THEN d ELSE ms + d END, CASE WHEN ms + d > 300000 OR cnt >= 50 THEN 1 ELSE cnt + 1 END
   FROM w JOIN el ON el.file_id = w.file_id AND el.rn = w.rn + 1)
SELECT c.file_id, c.idx, w.batch::INTEGER AS batch FROM c LEFT JOIN w USING (file_id, idx)"""
)
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    return Q.pack_batches(segments(spark, sf, []))


@R.add(
    f"""WITH RECURSIVE {SEG}, r AS (SELECT file_id, idx, speaker_id, greatest(0, s) AS s, greatest(greatest(0, s) + 50, e) AS e, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS rn FROM seg),
 w(file_id, rn, li, lp, ls, le, oi, op, os, oe) AS (SELECT file_id, rn, idx, speaker_id, s, e, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM r WHERE rn = 1 UNION ALL
   SELECT file_id, rn, CASE WHEN e - ns >= 50 THEN idx ELSE li END, CASE WHEN e - ns >= 50 THEN speaker_id ELSE lp END, CASE WHEN e - ns >= 50 THEN ns ELSE ls END, CASE WHEN e - ns >= 50 THEN e ELSE nl END,
     CASE WHEN e - ns >= 50 THEN li END, CASE WHEN e - ns >= 50 THEN lp END, CASE WHEN e - ns >= 50 THEN ls END, CASE WHEN e - ns >= 50 THEN nl END
   FROM (SELECT r.*, li, lp, ls, CASE WHEN s < le THEN (le + s) // 2 ELSE s END AS ns, CASE WHEN s < le THEN (le + s) // 2 ELSE le END AS nl FROM w JOIN r ON r.file_id = w.file_id AND r.rn = w.rn + 1))
SELECT file_id, oi AS idx, op AS speaker_id, os AS s, oe AS e FROM w WHERE oi IS NOT NULL
UNION ALL SELECT file_id, li, lp, ls, le FROM w QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rn DESC) = 1"""
)
def midpoint_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return Q.resolve_overlaps(segments(spark, sf, []))


_TO_LAST = "ne - ns < 1500 AND lp = np AND greatest(0, ns - le) <= 1000"
_TO_NEXT = "ne - ns < 1500 AND r.speaker_id = np AND greatest(0, r.s - ne) <= 1000"


@R.add(
    f"""WITH RECURSIVE {SEG}, r AS (SELECT file_id, idx, speaker_id, s, e, row_number() OVER (PARTITION BY file_id ORDER BY s, idx) AS rn FROM seg),
 w(file_id, rn, li, lp, ls, le, ni, np, ns, ne, oi, op, os, oe) AS (SELECT file_id, rn, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, idx, speaker_id, s, e, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM r WHERE rn = 1 UNION ALL
   SELECT file_id, rn, CASE WHEN a OR b THEN li ELSE ni END, CASE WHEN a OR b THEN lp ELSE np END, CASE WHEN a OR b THEN ls ELSE ns END, CASE WHEN a THEN greatest(le, ne) WHEN b THEN le ELSE ne END,
     idx, speaker_id, CASE WHEN b THEN least(s, ns) ELSE s END, e, CASE WHEN NOT (a OR b) THEN li END, CASE WHEN NOT (a OR b) THEN lp END, CASE WHEN NOT (a OR b) THEN ls END, CASE WHEN NOT (a OR b) THEN le END
   FROM (SELECT r.*, li, lp, ls, le, ni, np, ns, ne, coalesce({_TO_LAST}, false) AS a, NOT coalesce({_TO_LAST}, false) AND coalesce({_TO_NEXT}, false) AS b FROM w JOIN r ON r.file_id = w.file_id AND r.rn = w.rn + 1)),
 z AS (SELECT *, coalesce({_TO_LAST}, false) AS a FROM w QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rn DESC) = 1)
SELECT file_id, oi AS idx, op AS speaker_id, os AS s, oe AS e FROM w WHERE oi IS NOT NULL UNION ALL SELECT file_id, li, lp, ls, CASE WHEN a THEN greatest(le, ne) ELSE le END FROM z WHERE li IS NOT NULL
UNION ALL SELECT file_id, ni, np, ns, ne FROM z WHERE NOT a"""
)
def min_duration_absorb(spark: SparkSession, sf: str) -> DataFrame:
    return Q.absorb_short(segments(spark, sf, []), 1500, 1000)


@R.add(
    rf"""WITH {SEG}, w AS (SELECT file_id, idx, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM seg WHERE trim(text) <> ''),
 p AS (SELECT file_id, idx, words, unnest([0, 1, 2]) AS part FROM w),
 c AS (SELECT file_id, idx, words, part, greatest(1, floor(len(words) * 0.5::DOUBLE)::BIGINT) AS n0, greatest(1, floor(len(words) * 0.3::DOUBLE)::BIGINT) AS n1, greatest(1, floor(len(words) * 0.2::DOUBLE)::BIGINT) AS n2 FROM p)
SELECT file_id, idx, part::INTEGER AS part, coalesce(nullif(array_to_string(CASE part WHEN 0 THEN words[1:n0] WHEN 1 THEN words[n0 + 1:n0 + n1] ELSE words[n0 + n1 + 1:n0 + n1 + n2] END, ' '), ''), '[silence]') AS text FROM c"""
)
def text_proportional_split(spark: SparkSession, sf: str) -> DataFrame:
    return T.split_text(segments(spark, sf, ["text"]).filter("trim(text) <> ''"), [0.5, 0.3, 0.2])


@R.add(
    rf"""WITH {SEG}, w AS (SELECT file_id, idx, s, e, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM seg WHERE trim(text) <> '' AND e > s),
 u AS (SELECT file_id, idx, s, e, unnest(range(len(words))) AS i, unnest(words) AS word, len(words) AS n FROM w),
 t AS (SELECT file_id, idx, word, i, s + (i * (e - s)) // n AS ws, s + ((i + 1) * (e - s)) // n AS we FROM u),
 k AS (SELECT file_id, idx, s, e, unnest(range(greatest(1, ceil((e - s) / 2000.0::DOUBLE)::BIGINT))) AS k FROM seg WHERE trim(text) <> '' AND e > s),
 b AS (SELECT *, s + k * 2000 AS bs, least(s + k * 2000 + 2000, e) AS be FROM k)
SELECT b.file_id, b.idx, b.k, coalesce(string_agg(word, ' ' ORDER BY i), '[silence]') AS text FROM b LEFT JOIN t ON b.file_id = t.file_id AND b.idx = t.idx AND t.ws < be AND t.we > bs GROUP BY ALL"""
)
def words_to_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, ["text"]).filter("trim(text) <> '' AND e > s")
    return T.words_to_windows(rows, 2000)


_TWO = """dl AS (SELECT seg_id, ingested_at, sha256(concat_ws('|', coalesce(file_id, ''), coalesce(speaker_id, ''), coalesce(text, ''), coalesce(words::VARCHAR, ''))) AS digest FROM segments WHERE seg_id IS NOT NULL)"""


@R.add(f"WITH {_TWO} SELECT seg_id, count(*) AS deliveries, count(DISTINCT digest) > 1 AS changed FROM dl GROUP BY seg_id HAVING count(*) > 1")
def digest_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/segments.parquet").filter("seg_id IS NOT NULL")
    digest = T.digest(["file_id", "speaker_id", "text", "words"])
    by = rows.select("seg_id", digest.alias("digest")).groupBy("seg_id").agg(F.count(F.lit(1)).alias("deliveries"), (F.countDistinct("digest") > 1).alias("changed"))
    return by.filter("deliveries > 1")


@R.add("SELECT file_id, speaker_id, epoch_us(max(written_at)) AS last_written, count(*) AS runs FROM speakers_summary WHERE file_id IS NOT NULL AND speaker_id IS NOT NULL GROUP BY ALL")
def resume_point(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/speakers_summary.parquet").filter("file_id IS NOT NULL AND speaker_id IS NOT NULL")
    return rows.groupBy("file_id", "speaker_id").agg(F.unix_micros(F.max("written_at").cast("timestamp")).alias("last_written"), F.count(F.lit(1)).alias("runs"))


@R.add(
    """WITH x AS (SELECT DISTINCT station, artefact, export_id, written_at FROM raw_exports)
SELECT station, artefact, export_id, (row_number() OVER (PARTITION BY station, artefact ORDER BY written_at DESC, export_id DESC))::INTEGER AS age FROM x QUALIFY age > 3"""
)
def checkpoint_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Exports that may go when the three newest of a station and artefact are kept."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf}/raw_exports.parquet").groupBy("station", "artefact", "export_id").agg(F.max("written_at").alias("written_at"))
    w = Window.partitionBy("station", "artefact").orderBy(F.col("written_at").desc(), F.col("export_id").desc())
    return rows.withColumn("age", F.row_number().over(w)).filter("age > 3").select("station", "artefact", "export_id", "age")


@R.add(
    """WITH l AS (SELECT * FROM speakers_summary QUALIFY row_number() OVER (PARTITION BY file_id, speaker_id ORDER BY written_at DESC) = 1)
SELECT h.file_id, count(l.speaker_id) AS speakers, coalesce(sum(l.word_count), 0)::BIGINT AS words, max(h.clipping_detected::INTEGER) = 1 AS clipping FROM audio_health h LEFT JOIN l ON h.file_id = l.file_id GROUP BY h.file_id"""
)
def qc_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/speakers_summary.parquet").withColumn("pair", F.concat_ws("\u0000", F.coalesce("file_id", F.lit("\u0001")), F.coalesce("speaker_id", F.lit("\u0001"))))
    last = latest_rows(rows, "pair", "written_at", ["file_id", "speaker_id", "word_count"])
    by = last.groupBy("file_id").agg(F.count("speaker_id").alias("speakers"), F.sum("word_count").alias("words"))
    health = spark.read.parquet(f"{sf}/audio_health.parquet").select("file_id", "clipping_detected")
    zero = F.lit(0).cast("bigint")
    return health.join(by, "file_id", "left").select("file_id", F.coalesce("speakers", zero).alias("speakers"), F.coalesce("words", zero).alias("words"), F.col("clipping_detected").alias("clipping"))


@R.add(
    """SELECT count(*) AS recordings, round(avg(try_cast(snr_db AS DECIMAL(18,6))), 6) AS snr_db, round(avg(try_cast(silence_ratio AS DECIMAL(18,6))), 6) AS silence_ratio,
 coalesce(bool_or(clipping_detected), false) AS any_clipping, max(CASE WHEN NOT isnan(floor_clipping_ratio) THEN floor_clipping_ratio END) AS floor_clipping_ratio FROM audio_health"""
)
def health_combine(spark: SparkSession, sf: str) -> DataFrame:
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    mean = lambda c: F.round(F.avg(known(c).cast("decimal(18,6)")).cast("double"), 6).alias(c)
    rows = spark.read.parquet(f"{sf}/audio_health.parquet")
    return rows.agg(
        F.count(F.lit(1)).alias("recordings"), mean("snr_db"), mean("silence_ratio"), F.coalesce(F.bool_or("clipping_detected"), F.lit(False)).alias("any_clipping"), F.max(known("floor_clipping_ratio")).alias("floor_clipping_ratio")
    )


@R.add(
    f"""WITH {SEG}, {EV}, p AS (SELECT a.file_id, a.idx, b.event_id AS other, abs(a.s - b.s) AS apart, b.s AS t FROM seg a JOIN ev b ON a.file_id = b.file_id AND abs(a.s - b.s) <= 750)
SELECT file_id, idx, other, apart FROM p QUALIFY row_number() OVER (PARTITION BY file_id, idx ORDER BY apart, t, other) = 1"""
)
def nearest_audio_affect(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment with the sound event that starts nearest to it."""
    from talkgrid.operators.intervals import nearest_within

    return nearest_within(segments(spark, sf, []), events(spark, sf).select("file_id", F.col("event_id").alias("idx"), "s"), ["file_id"], 750)


@R.add()
def merge_similar_speakers(spark: SparkSession, sf: str) -> DataFrame:
    middles = V.centroids(_vectors(spark, sf), ["label"], "embedding").withColumn("file_id", F.lit("all"))
    return V.merge_similar(middles, ["file_id"], "label", 0.6)


@R.add(
    """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9 AS n FROM embeddings),
 d AS (SELECT x.vec_id, x.label, y.label AS other, avg(1 - list_dot_product(x.v, y.v) / (x.n * y.n)) AS d FROM n x JOIN n y ON x.vec_id <> y.vec_id GROUP BY ALL),
 s AS (SELECT vec_id, any_value(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY vec_id)
SELECT 'all' AS file_id, round(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""
)
def speaker_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.mean_silhouette(_vectors(spark, sf).withColumn("file_id", F.lit("all")), ["file_id"], "label", "embedding"), "silhouette")


@R.add(
    f"""WITH {SEG}, w AS (SELECT file_id, speaker_id, s, e FROM seg WHERE e > s), t AS (SELECT file_id, t, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS u FROM (SELECT file_id, s AS t FROM w UNION SELECT file_id, e FROM w)),
 o AS (SELECT t.file_id, t, u, speaker_id FROM t JOIN w ON w.file_id = t.file_id AND s <= t AND e > t GROUP BY t.file_id, t, u, speaker_id QUALIFY row_number() OVER (PARTITION BY t.file_id, t ORDER BY count(*) DESC, speaker_id) = 1),
 g AS (SELECT *, CASE WHEN lag(speaker_id) OVER x = speaker_id AND lag(u) OVER x = t THEN 0 ELSE 1 END AS fresh FROM o WINDOW x AS (PARTITION BY file_id ORDER BY t)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY t) AS g FROM g)
SELECT file_id, any_value(speaker_id) AS speaker_id, min(t) AS s, max(u) AS e FROM h GROUP BY file_id, g"""
)
def active_speaker_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return Q.active_speakers(segments(spark, sf, []))


@R.add(
    f"""WITH {SEG}, t AS (SELECT *, round_even(s / 1000.0::DOUBLE, 0)::BIGINT AS a, round_even(e / 1000.0::DOUBLE, 0)::BIGINT AS b FROM seg WHERE s >= 0)
SELECT file_id, idx, s, concat('[', printf('%02d:%02d:%02d', a // 3600, a // 60 % 60, a % 60), ' - ', printf('%02d:%02d:%02d', b // 3600, b // 60 % 60, b % 60), '] ', coalesce(nullif(speaker_name, ''), speaker_id), chr(10),
  '  Text: ', coalesce(nullif(trim(text), ''), '(no speech recognized)'), chr(10), '  Affect: emotion ', coalesce(nullif(emotion_top, ''), 'unknown'), '; valence ', coalesce(printf('%+.2f', round(valence::DECIMAL(18,6), 2)::DOUBLE + 0.0), 'n/a'), ', arousal ', coalesce(printf('%+.2f', round(arousal::DECIMAL(18,6), 2)::DOUBLE + 0.0), 'n/a'),
  ', dominance ', coalesce(printf('%+.2f', round(dominance::DECIMAL(18,6), 2)::DOUBLE + 0.0), 'n/a'), chr(10), '  Intent: ', coalesce(nullif(intent_top, ''), 'unknown'), chr(10), '  VAD: ', CASE WHEN vad_unstable THEN 'unstable' ELSE 'stable' END, ' | Noise tag: ', coalesce(nullif(noise_tag, ''), 'n/a')) AS block FROM t"""
)
def readable_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return T.readable(segments(spark, sf, ["speaker_name", "text", "emotion_top", "valence", "arousal", "dominance", "intent_top", "vad_unstable", "noise_tag"]).filter("s >= 0"))


#: What a later delivery may correct.
CORRECTED = ["file_id", "speaker_id", "speaker_name", "text", "start", "end", "words", "wpm", "valence", "arousal", "dominance", "snr_db", "emotion_top", "intent_top"]
_ROW = ", ".join(f"""'{c}': "{c}\"""" for c in CORRECTED)


@R.add(
    f"""WITH n AS (SELECT seg_id, {{{_ROW}}} AS d FROM segments WHERE seg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1),
 o AS (SELECT seg_id, {{{_ROW}}} AS d FROM segments WHERE seg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at) = 1)
SELECT seg_id FROM n JOIN o USING (seg_id) WHERE n.d IS DISTINCT FROM o.d"""
)
def resume_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of which the latest delivery differs from the first in any column that may be corrected, which a resumed run computes again."""
    rows = spark.read.parquet(f"{sf}/segments.parquet").filter("seg_id IS NOT NULL")
    new = latest_rows(rows, "seg_id", "ingested_at", CORRECTED)
    old = rows.groupBy("seg_id").agg(F.min_by(F.struct(*CORRECTED), "ingested_at").alias("r")).select("seg_id", "r.*")
    return T.changed_rows(old, new, "seg_id", CORRECTED).select("seg_id")
