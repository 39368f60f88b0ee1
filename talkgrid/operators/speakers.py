"""Roll-ups of speakers. Segments have ``file_id``, ``idx`` (order), ``speaker_id``, ``s``, ``e`` (ms) and measurements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions.text import word_count

KEYS = ["file_id", "speaker_id"]
#: Columns of which the roll-up gives the median.
MEDIANS = ["valence", "arousal", "dominance", "f0_mean_hz", "f0_std_hz", "loudness_rms", "vq_jitter_pct", "vq_hnr_db"]
#: The labels of text emotions, in the order that breaks ties.
EMOTIONS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire", "disappointment", "disapproval", "disgust",
    "embarrassment", "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride", "realization", "relief", "remorse",
    "sadness", "surprise", "neutral",
]


def votes(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """The most frequent non-blank ``label`` of each group as ``label``, with its ``votes``; of equal ones the one seen first by ``order``."""
    counts = df.filter(F.trim(F.col(label)) != "").groupBy(*keys, F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "__label")).alias("b"))
    return best.select(*keys, F.col("b.__label").alias(label), F.col("b.n").alias("votes"))


def first_known(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first non-blank ``value`` of each group by ``order``."""
    return df.filter(F.trim(F.col(value)) != "").groupBy(*keys).agg(F.min_by(value, order).alias(value))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population variance and deviation, least and largest of the finite values of each group; no row without any."""
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))).withColumn("__x", F.col(value))
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("__x").cast("decimal(24,8)")).cast("double").alias("mean"), F.var_pop("__x").alias("variance"), F.stddev_pop("__x").alias("deviation"),
        F.min("__x").alias("least"), F.max("__x").alias("largest"),
    )


def quantiles(df: DataFrame, keys: list[str], value: str, ps: list[float], exact: bool = True) -> DataFrame:
    """Interpolated quantiles ``q0``, ``q1``, ... of each group.

    Exact ones keep the counts of the distinct values of a group. Where a group has very many, take ``exact=False``,
    which keeps a sketch of bounded size with a relative rank error below 0.0001.
    """
    array = F.array(*[F.lit(p) for p in ps])
    agg = F.percentile(value, array) if exact else F.percentile_approx(value, array, 10_000)
    return df.groupBy(*keys).agg(agg.alias("__q")).select(*keys, *[F.get("__q", F.lit(i)).alias(f"q{i}") for i in range(len(ps))])


def rollup(segments: DataFrame, fold: DataFrame | None = None) -> DataFrame:
    """One row a file and speaker: duration, words, speed, medians, votes, pauses, interruptions and overlap.

    ``fold`` has ``made``, ``received`` and ``overlap_ms`` by file and speaker; only speakers with segments get them.
    ``loudness_dr_db`` is the distance of the quartiles; ``loudness_dr_x20`` the twentyfold of it, which older reports show.
    Missing medians are 0, a missing vote is "neutral" (emotion) or "" (voice hint). Words that are missing are
    counted in the text. A speaker without duration gets the median of the segments' speeds.
    """
    words = F.coalesce(F.col("words").cast("bigint"), word_count(F.col("text")).cast("bigint"))
    pause = (F.coalesce("pause_ratio", F.lit(0.0)) * (F.col("e") - F.col("s"))).cast("decimal(24,6)")
    q = lambda c, p: F.coalesce(F.percentile(c, F.lit(p)), F.lit(0.0))
    out = segments.groupBy(*KEYS).agg(
        F.sum(F.col("e") - F.col("s")).alias("duration_ms"), F.sum(words).alias("word_count"), q("wpm", 0.5).alias("wpm_median"),
        *[q(c, 0.5).alias(f"{c}_med") for c in MEDIANS], q("loudness_rms", 0.25).alias("lq1"), q("loudness_rms", 0.75).alias("lq3"),
        F.sum(pause).alias("pause"), F.coalesce(F.sum(F.col("pause_count").cast("bigint")), F.lit(0).cast("bigint")).alias("pause_count"),
    )
    for side in (first_known(segments, KEYS, "speaker_name", "idx"), votes(segments, KEYS, "emotion_top", "idx").drop("votes"), votes(segments, KEYS, "voice_quality_hint", "idx").drop("votes")):
        out = out.join(side, KEYS, "left")
    if fold is not None:
        out = out.join(fold, KEYS, "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("bigint") for c in ("made", "received", "overlap_ms")})
    zero = F.lit(0).cast("bigint")
    return out.select(
        *KEYS, F.coalesce("speaker_name", F.lit("")).alias("speaker_name"), (F.col("duration_ms") / 1000.0).alias("total_duration"), "word_count",
        F.expr("CASE WHEN duration_ms > 0 THEN word_count / (duration_ms / 60000.0D) ELSE wpm_median END").alias("avg_wpm"),
        F.col("valence_med").alias("avg_valence"), F.col("arousal_med").alias("avg_arousal"), F.col("dominance_med").alias("avg_dominance"),
        F.coalesce("emotion_top", F.lit("neutral")).alias("dominant_speech_emotion"), F.coalesce("made", zero).alias("interruptions_made"), F.coalesce("received", zero).alias("interruptions_received"),
        F.expr("CASE WHEN duration_ms > 0 THEN overlap_ms / CAST(duration_ms AS double) END").alias("overlap_ratio"), F.lit(fold is not None).alias("overlap_data_available"),
        F.col("f0_mean_hz_med").alias("f0_mean_hz"), F.col("f0_std_hz_med").alias("f0_std_hz"), "loudness_rms_med", F.expr("greatest(0.0D, lq3 - lq1)").alias("loudness_dr_db"),
        F.expr("greatest(0.0D, lq3 - lq1) * 20").alias("loudness_dr_x20"), (F.col("pause").cast("double") / 1000.0).alias("pause_total_sec"), "pause_count",
        F.expr("CASE WHEN duration_ms > 0 THEN CAST(pause AS double) / duration_ms ELSE 0.0D END").alias("pause_ratio"), "vq_jitter_pct_med", "vq_hnr_db_med",
        F.coalesce("voice_quality_hint", F.lit("")).alias("voice_quality_hint"),
    )


def profile(segments: DataFrame, fold: DataFrame) -> DataFrame:
    """The shorter profile: means instead of medians, words of the text, and speakers that only ``fold`` knows."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("decimal(24,8)")).cast("double"), F.lit(0.0))
    base = segments.groupBy(*KEYS).agg(
        F.sum(F.col("e") - F.col("s")).alias("duration_ms"), F.sum(word_count(F.col("text")).cast("bigint")).alias("word_count"),
        *[mean(c).alias(f"avg_{c}") for c in ("valence", "arousal", "dominance")],
    )
    named = base.join(first_known(segments, KEYS, "speaker_name", "idx"), KEYS, "left")
    out = named.join(fold.select(*KEYS, "made", "received"), KEYS, "full")
    zero = F.lit(0).cast("bigint")
    return out.select(
        *KEYS, F.coalesce("speaker_name", "speaker_id").alias("speaker_name"), F.coalesce("duration_ms", zero).alias("duration_ms"), F.coalesce("word_count", zero).alias("word_count"),
        *[F.coalesce(f"avg_{c}", F.lit(0.0)).alias(f"avg_{c}") for c in ("valence", "arousal", "dominance")],
        F.coalesce("made", zero).alias("interruptions_made"), F.coalesce("received", zero).alias("interruptions_received"),
    )


def quick_take(profiles: DataFrame, durations: DataFrame) -> DataFrame:
    """A sentence a file: speakers, minutes, and the tone of the one who speaks most (of equal ones the first by id)."""
    best = profiles.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("duration_ms")).alias("d"), "speaker_id", F.col("avg_valence").alias("v"))).alias("b"))
    tone = F.when(F.col("b.v") > 0.2, "positive").when(F.col("b.v") < -0.2, "negative").otherwise("neutral")
    return best.join(durations, "file_id").select("file_id", F.concat(F.col("n").cast("string"), F.lit(" speakers over "), F.expr("CAST(total div 60000 AS string)"), F.lit(" min; most-active tone "), tone, F.lit(".")).alias("quick_take"))


def emotion_distribution(scores: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Normalised sums of the scores of the known ``EMOTIONS`` of each group, with ``rank``; a group without any is all neutral.

    Null and negative scores count as 0; groups come from all rows.
    """
    known = scores.filter(F.col(label).isin(EMOTIONS)).groupBy(*keys, F.col(label).alias("label")).agg(F.sum(F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)).cast("decimal(24,8)")).alias("v"))
    total = known.groupBy(*keys).agg(F.sum("v").alias("t")).filter("t > 0")
    share = known.join(total, keys).filter("v > 0").select(*keys, "label", (F.col("v").cast("double") / F.col("t").cast("double")).alias("share"))
    none = scores.select(*keys).distinct().join(total, keys, "left_anti").select(*keys, F.lit("neutral").alias("label"), F.lit(1.0).alias("share"))
    place = F.array_position(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("label"))
    w = Window.partitionBy(*keys).orderBy(F.col("share").desc(), place)
    return share.unionByName(none).withColumn("rank", F.row_number().over(w).cast("int"))


class P2:
    """The five-marker estimate of a quantile of a stream of values; below five values the nearest rank."""

    def __init__(self, p: float):
        self.p, self.first, self.h = p, [], []
        self.pos = [0.0, 1.0, 2.0, 3.0, 4.0]
        self.want = [0.0, 2 * p, 4 * p, 2 + 2 * p, 4.0]
        self.step = [0.0, p / 2, p, (1 + p) / 2, 1.0]

    def add(self, x: float) -> None:
        if len(self.first) < 5:
            self.first.append(x)
            if len(self.first) == 5:
                self.h = sorted(self.first)
            return
        h, pos = self.h, self.pos
        h[0], h[4] = min(h[0], x), max(h[4], x)
        cell = next((k for k in range(3, -1, -1) if x >= h[k]), 0)
        for i in range(cell + 1, 5):
            pos[i] += 1
        self.want = [w + d for w, d in zip(self.want, self.step)]
        for i in (1, 2, 3):
            d = self.want[i] - pos[i]
            if (d >= 1 and pos[i + 1] - pos[i] > 1) or (d <= -1 and pos[i - 1] - pos[i] < -1):
                d = 1.0 if d > 0 else -1.0
                left, right = pos[i] - pos[i - 1], pos[i + 1] - pos[i]
                curve = h[i] + d / (pos[i + 1] - pos[i - 1]) * ((left + d) * (h[i + 1] - h[i]) / right + (right - d) * (h[i] - h[i - 1]) / left)
                if not h[i - 1] < curve < h[i + 1]:
                    j = i + int(d)
                    curve = h[i] + d * (h[j] - h[i]) / (pos[j] - pos[i])
                h[i] = curve
                pos[i] += d

    def value(self) -> float | None:
        if self.h:
            return self.h[2]
        return sorted(self.first)[round((len(self.first) - 1) * self.p)] if self.first else None


def p2_quantiles(df: DataFrame, keys: list[str], order: str, value: str, p: float) -> DataFrame:
    """The five-marker estimate ``estimate`` of each group, fed by ``order``: the order matters, and such estimates can't be merged.

    Partitions are sorted by group and order and read as a stream, so a group of any size needs constant memory, though one
    task. Prefer ``quantiles``. Null and NaN values don't count; groups without values have no row.
    """
    rows = df.select(*keys, order, F.col(value).alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").repartition(*keys).sortWithinPartitions(*keys, order)
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = None, None, []
        for batch in batches:
            for now, x in zip(zip(*[batch[k] for k in keys]), batch["x"]):
                if now != key:
                    if state:
                        done.append((*key, state.value()))
                    key, state = now, P2(p)
                state.add(float(x))
            yield pd.DataFrame(done, columns=[*keys, "estimate"])
            done = []
        if state:
            yield pd.DataFrame([(*key, state.value())], columns=[*keys, "estimate"])

    return rows.mapInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["estimate double"]))


def main_speakers(segments: DataFrame, most: int) -> DataFrame:
    """The segments of the ``most`` speakers of each file who speak longest (of equal ones the first by id)."""
    by = segments.groupBy(*KEYS).agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    w = Window.partitionBy("file_id").orderBy(F.col("speech").desc(), "speaker_id")
    kept = by.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*KEYS)
    return segments.join(kept, KEYS, "left_semi")


def longest_segments(segments: DataFrame) -> DataFrame:
    """The longest segment of each file, of equal ones the earliest: ``file_id``, ``idx``, ``speaker_id``, ``length``."""
    best = segments.groupBy("file_id").agg(F.min(F.struct((F.col("s") - F.col("e")).alias("d"), "s", "idx", "speaker_id")).alias("b"))
    return best.select("file_id", F.col("b.idx").alias("idx"), F.col("b.speaker_id").alias("speaker_id"), (-F.col("b.d")).alias("length"))
