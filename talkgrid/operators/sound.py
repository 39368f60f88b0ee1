"""Sound events: frames to events, labels, and events of segments. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.intervals import overlap_join
from talkgrid.operators.sequences import hysteresis, merge_runs

#: Width of a join bucket of events and segments.
BUCKET = 10_000
#: Parts of a label that make it noise.
NOISE = ["music", "noise", "typing", "keyboard", "applause", "traffic", "engine", "vehicle", "crowd", "siren", "wind", "rain", "tv"]
#: Coarse labels by parts of a label; the first that fits counts, else ``OTHER``.
COARSE = [
    ("applause", ["applause", "clapping"]),
    ("barking", ["bark", "dog"]),
    ("cooking", ["cooking", "kitchen", "sizzle", "frying", "chopping", "cutting board", "microwave", "blender"]),
    ("door", ["door", "knock", "doorbell"]),
    ("engine", ["engine", "motor", "propeller", "idling", "revving", "mechanical fan"]),
    ("footsteps", ["footstep", "footsteps", "shoe", "walk", "walking", "run", "running", "sandal", "high-heeled"]),
    ("impact", ["impact", "hit", "slam", "bang", "thud", "thump", "smash", "crash", "clack", "click", "clunk", "door slam"]),
    ("keyboard", ["keyboard instrument", "piano", "synth", "organ", "harpsichord", "accordion", "keytar", "electric piano"]),
    ("laughter", ["laugh", "laughter", "chuckle", "giggle"]),
    ("mouse_click", ["mouse click", "computer mouse", "mouse button"]),
    ("music", ["music", "song", "sing", "guitar", "violin", "cello", "flute", "brass", "drum", "percussion", "orchestra", "band", "choir", "harp", "saxophone"]),
    ("phone", ["telephone", "phone", "dial tone", "ringtone", "busy signal", "fax", "texting"]),
    ("siren_alarm", ["siren", "alarm", "beacon", "fire alarm", "ambulance"]),
    ("tv", ["television", "tv", "broadcast", "news", "sitcom"]),
    ("typing", ["typing", "typewriter", "computer keyboard", "keyboarding", "mechanical keyboard"]),
    ("vehicle", ["vehicle", "car", "truck", "bus", "train", "tram", "subway", "rail", "motorcycle", "aircraft", "airplane", "helicopter", "boat", "ship"]),
    ("wind", ["wind", "breeze", "gust", "airflow"]),
    ("water", ["water", "rain", "stream", "river", "ocean", "sea", "waves", "surf", "drip", "splash", "pour"]),
    ("crowd", ["crowd", "cheer", "boo", "stadium", "audience", "chant", "speech", "conversation"]),
]
OTHER = "other_env"


def coarse_label(label: Column) -> Column:
    """The first coarse label of which a part is in ``label``, without regard to case."""
    out, lower = None, F.lower(label)
    for name, parts in COARSE:
        hit = lower.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def is_noise(label: Column) -> Column:
    return F.lower(label).rlike("|".join(NOISE))


def to_frames(events: DataFrame, hop: int = 500, width: int = 1000) -> DataFrame:
    """Frames of each file and label: the best score of the events that start in it; only frames with one."""
    frames = events.withColumn("frame", F.expr(f"floor(s / {float(hop)}D)")).groupBy("file_id", "label", "frame").agg(F.max("score").alias("score"))
    return frames.select("file_id", "label", "frame", (F.col("frame") * hop).alias("t0"), (F.col("frame") * hop + width).alias("t1"), "score")


def collapse_labels(frames: DataFrame, group: Column) -> DataFrame:
    """The best score of each frame and ``group`` of labels."""
    return frames.groupBy("file_id", "frame", group.alias("label")).agg(F.max("score").alias("score"))


def mapped_labels(frames: DataFrame, classes: DataFrame) -> DataFrame:
    """``collapse_labels`` by a table ``classes`` of ``raw`` and ``label``, in any case; labels that aren't there stay.

    Of several rows of one raw label the last by ``label`` counts. The planner picks the join by the table's size.
    """
    by = classes.groupBy(F.lower(F.trim("raw")).alias("__raw")).agg(F.max("label").alias("__to"))
    joined = frames.join(by, F.lower(F.trim("label")) == F.col("__raw"), "left")
    return collapse_labels(joined, F.coalesce("__to", "label"))


def frame_top(frames: DataFrame, k: int) -> DataFrame:
    """The ``k`` best labels of each frame, with ``rank``; of equal scores the first by name. A frame has as many rows as labels."""
    w = Window.partitionBy("file_id", "frame").orderBy(F.col("score").desc(), "label")
    return frames.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def events_from_frames(frames: DataFrame, enter: float, leave: float, least: int, gap: int, least_by_label: dict[str, int] | None = None) -> DataFrame:
    """Events of each file and label: runs by hysteresis of at least ``least`` ms, joined within ``gap`` ms.

    ``least_by_label`` has other limits for some labels. Runs of one label are joined, whatever lies between of others.
    Result: ``file_id``, ``label``, ``s``, ``e``, ``score`` (peak, 0 to 1), ``duration``, ``weight``.
    """
    keys = ["file_id", "label"]
    limit = F.lit(least)
    for label, ms in (least_by_label or {}).items():
        limit = F.when(F.lower("label") == label.lower(), ms).otherwise(limit)
    runs = hysteresis(frames, keys, enter, leave).filter(F.col("e") - F.col("s") >= limit)
    merged = merge_runs(runs, keys, "s", "e", gap)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("peak")))
    return merged.select(*keys, "s", "e", score.alias("score"), (F.col("e") - F.col("s")).alias("duration"), (score * (F.col("e") - F.col("s")) / 1000.0).alias("weight"))


def events_by_frame_count(frames: DataFrame, enter: float, leave: float, least: int, gap: int, hop: int = 500) -> DataFrame:
    """Runs of at least ``ceil(least / hop)`` frames, joined where ``gap`` ms or less of frames lie between: first, last, peak."""
    keys = ["file_id", "label"]
    runs = hysteresis(frames, keys, enter, leave).filter(F.col("last") - F.col("first") + 1 >= max(1, -(-least // hop)))
    return merge_runs(runs, keys, "first", "last", gap / hop + 1, 8192).select(*keys, "first", "last", "peak")


def timeline_summary(events: DataFrame) -> DataFrame:
    """By file and label: ``duration`` (ms), ``weight`` (score by ms) and mean score."""
    d = F.greatest(F.lit(0), F.col("e") - F.col("s"))
    by = events.groupBy("file_id", "label").agg(F.sum(d).alias("duration"), F.sum((F.greatest(F.lit(0.0), F.col("score")) * d).cast("decimal(24,6)")).cast("double").alias("weight"))
    return by.withColumn("mean_score", F.expr("CASE WHEN duration > 0 THEN weight / duration ELSE 0.0D END"))


def attributed(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Each event that overlaps a segment: ``file_id``, ``idx``, ``event_id``, ``label``, ``overlap`` (ms), ``weight``."""
    pairs = overlap_join(segments.select("file_id", "idx", "s", "e").filter("e > s"), events.select("file_id", "event_id", "label", "s", "e", "score").filter("e > s"), ["file_id"], BUCKET, ("seg", "ev"))
    overlap = F.expr("least(seg.e, ev.e) - greatest(seg.s, ev.s)")
    return pairs.select("file_id", F.col("seg.idx").alias("idx"), F.col("ev.event_id").alias("event_id"), F.col("ev.label").alias("label"), overlap.alias("overlap"), (overlap * F.greatest(F.lit(0.0), F.col("ev.score"))).cast("decimal(24,6)").alias("weight"))


def top_events(attribution: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` labels of most weight of each segment: ``rank``, ``label``, ``score``, ``overlap``; ties by score, then name."""
    by = attribution.groupBy("file_id", "idx", "label").agg(F.sum("overlap").alias("overlap"), F.sum("weight").cast("double").alias("weight"))
    by = by.withColumn("score", F.expr("CASE WHEN overlap > 0 THEN weight / overlap ELSE 0.0D END"))
    w = Window.partitionBy("file_id", "idx").orderBy(F.col("weight").desc(), F.col("score").desc(), "label")
    return by.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("file_id", "idx", "rank", "label", "score", "overlap")


def snr_from_events(attribution: DataFrame, segments: DataFrame) -> DataFrame:
    """Signal to noise of each segment with events: 35 dB less what half the density and half the weight of events take."""
    by = attribution.groupBy("file_id", "idx").agg(F.sum("overlap").alias("o"), F.sum("weight").cast("double").alias("w"))
    out = by.join(segments.select("file_id", "idx", (F.col("e") - F.col("s")).cast("double").alias("d")), ["file_id", "idx"])
    taken = F.expr("least(1.0D, 0.5D * least(1.0D, o / d) + 0.5D * least(1.0D, w / d))")
    return out.select("file_id", "idx", F.greatest(F.lit(-5.0), F.least(F.lit(35.0), 35.0 - 35.0 * taken)).alias("snr_db"))


def snr_from_noise(score: Column) -> Column:
    """Signal to noise by a noise score: 35 dB at 0 or below, less 20 log10(1 + 10 score), within -5 to 35; null for null."""
    value = 35.0 - 20.0 * F.log10(1.0 + 10.0 * score)
    return F.when(score.isNull() | F.isnan(score), None).when(score <= 0, 35.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(35.0), value)))


def segments_with_events(segments: DataFrame, attribution: DataFrame) -> DataFrame:
    """Every segment with ``event_count``, ``overlap_ms`` and ``overlap_ratio`` (at most 1) of its events; 0 without any."""
    by = attribution.groupBy("file_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("o"))
    out = segments.select("file_id", "idx", "s", "e").join(by, ["file_id", "idx"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select("file_id", "idx", F.coalesce("n", zero).alias("event_count"), F.coalesce("o", zero).alias("overlap_ms"), F.expr("CASE WHEN e > s THEN least(1.0D, coalesce(o, 0L) / CAST(e - s AS double)) ELSE 0.0D END").alias("overlap_ratio"))


def speech_regions(events: DataFrame, pad: int = 50, gap: int = 100, least: int = 0) -> DataFrame:
    """Regions of speech-like events of at least ``least`` ms, padded on both sides and joined within ``gap`` ms."""
    from talkgrid.operators.sequences import gap_merge

    like = events.filter(F.col("label").rlike("speech|conversation|narration|whisper|child babble")).filter(F.col("e") - F.col("s") >= least)
    wide = like.select("file_id", F.greatest(F.lit(0).cast("bigint"), F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"))
    return gap_merge(wide, ["file_id"], gap)
