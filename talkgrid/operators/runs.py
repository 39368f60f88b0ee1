"""Bookkeeping of runs: digests, signatures of settings, caches and checkpoints that may be used again, and run statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.sequences import with_previous

#: The settings of preprocessing and of sound events that make an artefact another one.
PREPROCESS_SETTINGS = ["target_sr", "denoise", "loudness_mode", "denoise_alpha_db", "denoise_beta"]
SOUND_SETTINGS = [
    "enable_sed", "sed_mode", "sed_window_sec", "sed_hop_sec", "sed_enter", "sed_exit", "sed_min_dur", "sed_default_min_dur", "sed_merge_gap", "sed_classmap_csv", "sed_timeline_jsonl", "sed_median_k",
    "sed_batch_size", "sed_max_windows",
]


def content_hash(value: Column, algorithm: str = "sha2", signs: int | None = None) -> Column:
    """The hash of a text or of bytes, in hexadecimal: ``md5``, ``sha1`` or ``sha2`` (256 bits); its first ``signs`` if given."""
    made = {"md5": F.md5, "sha1": F.sha1, "sha2": lambda c: F.sha2(c, 256)}[algorithm](value)
    return made if signs is None else F.substring(made, 1, signs)


def signature(settings: Mapping, names: Iterable[str]) -> str:
    """The named settings as JSON with sorted keys; missing ones are null. Equal settings have equal signatures."""
    return json.dumps({name: settings.get(name) for name in names}, sort_keys=True)


def cache_entries(df: DataFrame, version: str, digest: Column, settings: str, **extra: Column) -> DataFrame:
    """``df`` with what tells whether an artefact may be used again: ``version``, ``audio_sha16``, ``pp_signature`` and ``extra``."""
    return df.select("*", F.lit(version).alias("version"), digest.alias("audio_sha16"), F.lit(settings).alias("pp_signature"), *[c.alias(k) for k, c in extra.items()])


def usable(entries: DataFrame, wanted: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """The ``entries`` whose columns ``same`` equal those ``wanted`` for their ``keys``; a value that isn't wanted (null) is not compared.

    ``wanted`` has one row for each of ``keys``; entries that nobody wants are left out.
    """
    right = wanted.select(*keys, *[F.col(c).alias(f"__{c}") for c in same])
    fits = F.lit(True)
    for c in same:
        fits = fits & (F.col(f"__{c}").isNull() | F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False)))
    return entries.join(right, keys).filter(fits).select(*entries.columns)


def newest_usable(entries: DataFrame, wanted: DataFrame, keys: list[str], same: list[str], time: str) -> DataFrame:
    """Of the usable entries the newest of each of ``keys``; of equal times the one whose columns sort last."""
    rows = usable(entries, wanted, keys, same)
    rest = [c for c in rows.columns if c not in keys and c != time]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in rows.columns])


def stage_statistics(events: DataFrame) -> DataFrame:
    """By ``stage``: how often it ran, its time and what it counted (``ms`` and ``n`` of each event; missing ones are 0)."""
    zero = F.lit(0).cast("bigint")
    return events.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce(F.col("ms").cast("bigint"), zero)).alias("ms"), F.sum(F.coalesce(F.col("n").cast("bigint"), zero)).alias("n"))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a listing: ``limit`` rows after the first ``offset`` by ``order``, which must tell rows apart."""
    return df.orderBy(*order).offset(offset).limit(limit)


def unstable_files(segments: DataFrame, most: float = 60.0) -> DataFrame:
    """By file: how often the speech detector changed its mind (``flips`` of ``vad_unstable`` from row to row), a minute, and whether that is too often."""
    rows = with_previous(segments.select("file_id", "idx", "s", "e", "vad_unstable"), ["file_id"], ["s", "idx"], ["vad_unstable"])
    by = rows.groupBy("file_id").agg(F.count_if(F.col("vad_unstable") != F.col("prev_vad_unstable")).alias("flips"), F.max("e").alias("total"))
    rate = F.col("flips") / F.greatest(F.lit(1), F.expr("total div 60000"))
    return by.select("file_id", "flips", rate.alias("flips_per_min"), (rate > most).alias("unstable"))


def chunk_statistics(segments: DataFrame, width: int = 600_000) -> DataFrame:
    """Counters of speech by file, summed over chunks of ``width`` ms by the start: ``chunks``, ``turns``, ``speech_ms``, ``unstable``."""
    chunks = segments.groupBy("file_id", F.expr(f"floor(s / {float(width)}D)").alias("chunk")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.expr("e - s")).alias("speech_ms"), F.count_if(F.coalesce("vad_unstable", F.lit(False))).alias("unstable")
    )
    return chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), *[F.sum(c).alias(c) for c in ("turns", "speech_ms", "unstable")])


def chunk_offsets(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Chunks of samples without what each but the first shares with the one before, and where they lie in the joined wave.

    ``chunks`` has ``samples`` (array) and ``overlap`` (samples at the left). Result: ``keys``, ``order``, ``at``, ``samples``; the
    joined wave is never one row. Only lengths are put in order, a row a chunk; a chunk that is all overlap is kept whole.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    small = chunks.select(*keys, order, "overlap", F.size("samples").alias("__n"))
    cut = F.when((F.lag(F.lit(1)).over(w) == 1) & (F.col("overlap") < F.col("__n")), F.col("overlap")).otherwise(0)
    small = small.withColumn("__cut", cut.cast("int")).withColumn("__at", F.coalesce(F.sum(F.col("__n") - F.col("__cut")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = chunks.join(small.select(*keys, order, "__cut", "__at"), [*keys, order])
    return out.select(*keys, order, F.col("__at").alias("at"), F.slice("samples", F.col("__cut") + 1, F.greatest(F.lit(0), F.size("samples") - F.col("__cut"))).alias("samples"))
