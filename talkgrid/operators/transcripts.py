"""Operators of recognised text: splitting, words in windows, digests, readable blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.text import clock, signed
from talkgrid.operators.intervals import nearest_within, overlap_join, windows
from talkgrid.operators.sequences import with_position
from talkgrid.storage import stored


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def split_text(segments: DataFrame, shares: list[float]) -> DataFrame:
    """The words of a segment dealt to parts by their ``shares`` of the time, at least one word each: ``part``, ``text``.

    Shares are rounded down, so words at the end may be left over; a part without words is "[silence]".
    """
    words, n = _parts(F.col("text")), F.size(_parts(F.col("text")))
    counts = [F.greatest(F.lit(1), F.floor(n * F.lit(s)).cast("int")) for s in shares]
    parts, at = [], F.lit(1)
    for i, c in enumerate(counts):
        chosen = F.array_join(F.when(at <= n, F.slice(words, at, c)).otherwise(F.array().cast("array<string>")), " ")
        parts.append(F.struct(F.lit(i).alias("part"), F.coalesce(F.nullif(chosen, F.lit("")), F.lit("[silence]")).alias("text")))
        at = at + c
    return segments.select("file_id", "idx", F.inline(F.array(*parts)))


def words_to_windows(segments: DataFrame, width: int) -> DataFrame:
    """The words of each window of a segment, spread evenly over it: ``k``, ``text``; a word at a border is in both windows."""
    rows = windows(segments.select("file_id", "idx", "s", "e", _parts(F.col("text")).alias("words")), width)
    n, span = F.size("words"), F.col("e") - F.col("s")
    timed = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.floor(F.col("s") + F.floor(i * span / n)).alias("ws"), F.floor(F.col("s") + F.floor((i + 1) * span / n)).alias("we")))
    hit = F.filter(timed, lambda t: (t["ws"] < F.col("we")) & (t["we"] > F.col("ws")))
    text = F.array_join(F.transform(hit, lambda t: t["word"]), " ")
    return rows.select("file_id", "idx", "k", F.coalesce(F.nullif(text, F.lit("")), F.lit("[silence]")).alias("text"))


def digest(columns: list[str]) -> Column:
    """SHA-256 of the columns' texts, with missing ones as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that aren't in ``old`` with the same ``key`` and digest of ``columns``: those to compute again."""
    have = old.select(key, digest(columns).alias("__digest"))
    return new.withColumn("__digest", digest(columns)).join(have, [key, "__digest"], "left_anti").drop("__digest")


def readable(segments: DataFrame) -> DataFrame:
    """A block of text for each segment, for people: ``file_id``, ``idx``, ``s``, ``block``."""
    c = lambda name, other: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(other))
    who = F.coalesce(F.nullif(F.col("speaker_name"), F.lit("")), F.col("speaker_id"))
    lines = [
        F.format_string("[%s - %s] %s", clock(F.col("s")), clock(F.col("e")), who),
        F.format_string("  Text: %s", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(no speech recognized)"))),
        F.format_string("  Affect: emotion %s; valence %s, arousal %s, dominance %s", c("emotion_top", "unknown"), signed(F.col("valence")), signed(F.col("arousal")), signed(F.col("dominance"))),
        F.format_string("  Intent: %s", c("intent_top", "unknown")),
        F.format_string("  VAD: %s | Noise tag: %s", F.when(F.col("vad_unstable"), "unstable").otherwise("stable"), c("noise_tag", "n/a")),
    ]
    return segments.select("file_id", "idx", "s", F.concat_ws("\n", *lines).alias("block"))


def overlay(rows: DataFrame, other: DataFrame, keys: list[str], columns: list[str], tolerance: int = 750) -> DataFrame:
    """``rows`` with ``columns`` of the matching row of ``other`` where that has a value (not null and not ""), and ``match``.

    Both sides have ``keys``, ``idx`` and ``s``. The row at the same position of a group, by ``s`` and ``idx``, matches; where
    ``other`` has no such position, the row nearest in time within ``tolerance`` does. ``match`` is ``position``, ``time`` or null.
    """
    order = ["s", "idx"]
    left, right = stored(with_position(rows, keys, order)), stored(with_position(other, keys, order))
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    same = right.select(*keys, "pos", values.alias("__same"), F.lit(1).alias("__there"))
    both = left.join(same, [*keys, "pos"], "left")
    late = left.join(same.select(*keys, "pos"), [*keys, "pos"], "left_anti").select(*keys, "idx", "s")
    near = nearest_within(late, right.select(*keys, "idx", "s"), keys, tolerance).select(*keys, "idx", F.col("other").alias("__other"))
    near = near.join(right.select(*keys, F.col("idx").alias("__other"), values.alias("__near")), [*keys, "__other"]).drop("__other")
    out = both.join(near, [*keys, "idx"], "left").withColumn("__v", F.coalesce("__same", "__near"))
    given = lambda c: F.when(F.col(f"__v.{c}").cast("string") != "", F.col(f"__v.{c}"))
    match = F.when(F.col("__there") == 1, "position").when(F.col("__near").isNotNull(), "time")
    return out.select(*[F.coalesce(given(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], match.alias("match"))


def words_to_boundaries(words: DataFrame, boundaries: DataFrame, keys: list[str], width: int = 10_000) -> DataFrame:
    """Words with times dealt to boundaries: ``keys``, ``k``, ``text``, ``words`` (``word``, ``s``, ``e`` in time of the segment).

    ``words`` has ``keys``, ``i`` (order), ``word``, ``s``, ``e``; ``boundaries`` has ``keys``, ``k``, ``s``, ``e`` (where the
    segment lies in the joined audio) and ``origin`` (where it began). A word over a border is in both segments; times are
    moved by ``origin - s``. A boundary without words has the text "[silence]" and no words.
    """
    pairs = overlap_join(words.select(*keys, "i", "word", "s", "e"), boundaries.select(*keys, "k", "s", "e", "origin"), keys, width, ("w", "b"))
    move = F.col("b.origin") - F.col("b.s")
    timed = F.struct(F.col("w.i").alias("i"), F.struct(F.trim("w.word").alias("word"), (F.col("w.s") + move).alias("s"), (F.col("w.e") + move).alias("e")).alias("w"))
    found = pairs.groupBy(*keys, F.col("b.k").alias("k")).agg(F.array_sort(F.collect_list(timed)).alias("t"))
    out = boundaries.select(*keys, "k").join(found, [*keys, "k"], "left").withColumn("words", F.transform("t", lambda x: x["w"]))
    text = F.array_join(F.filter(F.transform("words", lambda w: w["word"]), lambda w: w != ""), " ")
    return out.select(*keys, "k", F.coalesce(F.nullif(text, F.lit("")), F.lit("[silence]")).alias("text"), "words")


def recogniser_inputs(turns: DataFrame) -> DataFrame:
    """Turns as a recogniser takes them: ``start_time``, ``end_time`` (half a second later where it is missing or 0), ``speaker_id``, ``speaker_name`` (else the id)."""
    start = F.coalesce("start", F.lit(0.0))
    return turns.select(
        "file_id", "idx", start.alias("start_time"), F.coalesce(F.when(F.col("end") != 0, F.col("end")), start + 0.5).alias("end_time"),
        "speaker_id", F.coalesce(F.when(F.col("speaker_name") != "", F.col("speaker_name")), F.col("speaker_id")).alias("speaker_name"),
    )


#: The parts of a nested affect record, and the flat columns they hold.
_AFFECT = {
    "vad": ["valence", "arousal", "dominance"], "speech_emotion": ["emotion_top", "low_confidence_ser"], "intent": ["intent_top"],
}


def nested_affect(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Flat affect columns as one nested record ``affect``; numbers that are missing or not finite are 0."""
    def number(c: str):
        return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).otherwise(0.0)

    part = lambda names: F.struct(*[(number(c) if c in _AFFECT["vad"] else F.coalesce(c, F.lit(False)) if c == "low_confidence_ser" else F.coalesce(F.col(c), F.lit("neutral" if c == "emotion_top" else "status_update"))).alias(c) for c in names])
    return rows.select(*keep, F.struct(*[part(names).alias(name) for name, names in _AFFECT.items()]).alias("affect"))


def flat_affect(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``nested_affect`` again."""
    return rows.select(*keep, *[F.col(f"affect.{name}.{c}").alias(c) for name, names in _AFFECT.items() for c in names])
