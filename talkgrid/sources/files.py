"""Readers of the files that recordings come with."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of video.
VIDEO = ["mp4", "mkv", "mov", "avi", "webm", "m4v", "mpg", "mpeg", "wmv", "flv"]


def is_video(path: str | F.Column):
    """Whether a path (column) ends like a video file."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(VIDEO)


def audio_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Audio files without their content: ``path``, ``length``, ``modified``. The content isn't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def cache_key(rate: int, channels: int = 1) -> F.Column:
    """Key of what is computed from a file in this state: the first 16 signs of a hash of path, size, time, rate and channels."""
    return F.substring(F.sha2(F.concat_ws("::", "path", F.col("length").cast("string"), F.unix_micros("modified").cast("string"), F.lit(str(rate)), F.lit(str(channels))), 256), 1, 16)


def _decode(content: bytes, first: float, seconds: float | None, rate: int) -> tuple[np.ndarray, int] | None:
    """Mono samples of a span of an uncompressed WAV, and their rate; None for other content."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            own, width, channels, n = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
            start = min(n, max(0, round(first * own)))
            count = n - start if seconds is None else min(n - start, max(0, round(seconds * own)))
            w.setpos(start)
            raw = w.readframes(count)
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float32) - 0x800000
        x /= 0x800000
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if rate and rate != own and len(x):
        at = np.arange(max(1, round(len(x) * rate / own))) * own / rate
        x, own = np.interp(at, np.arange(len(x)), x).astype(np.float32), rate
    return x, own


def read_audio(spark: SparkSession, path: str, rate: int = 16_000, chunk: float = 60.0, overlap: float = 0.0, glob: str = "*.wav", span: tuple[float, float | None] = (0.0, None)) -> DataFrame:
    """Mono chunks of uncompressed WAV files: ``path``, ``chunk_id``, ``start_s``, ``rate``, ``samples``.

    Samples are resampled to ``rate`` (0: as they are); a chunk reaches ``overlap`` seconds into its neighbours. Only what lies in ``span``
    (seconds, None: the end) is decoded; chunks are counted from its start. Files that aren't
    uncompressed WAV give one row with null ``samples``.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                whole = _decode(content, 0.0, 0.0, 0)
                if whole is None:
                    yield pd.DataFrame({"path": [p], "chunk_id": [0], "start_s": [0.0], "rate": [0], "samples": [None]})
                    continue
                with wave.open(io.BytesIO(content)) as w:
                    total = w.getnframes() / w.getframerate()
                begin, stop = min(total, max(0.0, span[0])), total if span[1] is None else min(total, span[1])
                for k in range(max(1, int(np.ceil((stop - begin) / chunk - 1e-9)))):
                    first = max(begin, begin + k * chunk - overlap)
                    last = max(first, min(stop, begin + (k + 1) * chunk + overlap))
                    x, own = _decode(content, first, last - first, rate)
                    yield pd.DataFrame({"path": [p], "chunk_id": [k], "start_s": [first], "rate": [own], "samples": [x]})

    return rows.select("path", "content").mapInPandas(run, "path string, chunk_id int, start_s double, rate int, samples array<float>")


def probe_audio(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Header facts of WAV files: ``path``, ``duration_s``, ``rate``, ``channels``, ``is_pcm``, ``digest``; nulls for other content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                digest = hashlib.blake2s(content, digest_size=16).hexdigest()
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        out.append((p, w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), True, digest))
                except (wave.Error, EOFError):
                    out.append((p, None, None, None, False, digest))
            yield pd.DataFrame(out, columns=["path", "duration_s", "rate", "channels", "is_pcm", "digest"])

    return rows.select("path", "content").mapInPandas(run, "path string, duration_s double, rate int, channels int, is_pcm boolean, digest string")


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with header in the types of ``schema``; rows that don't fit have nulls. Fails at once where ``required`` columns are missing."""
    there = spark.read.csv(path, header=True).columns
    missing = sorted(set(required or []) - set(there))
    if missing:
        raise ValueError(f"{path} has no columns {', '.join(missing)}")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    kinds = {k.strip("`"): v for k, v in (part.strip().split(" ", 1) for part in schema.split(", "))}
    return raw.select(*[(F.col(f"`{n}`").try_cast(t) if n in there else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a class list: the column ``display_name``, or else the first one, as ``label``; trimmed, blank ones left out."""
    rows = spark.read.csv(path, header=True)
    name = "display_name" if "display_name" in rows.columns else rows.columns[0]
    return rows.select(F.trim(F.col(f"`{name}`")).alias("label")).filter("label <> ''")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Events of timeline documents, either a list or an object with ``events``: one row an event, and no row for other content."""
    event = "struct<label:string,start:double,end:double,score:double>"
    rows = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{event}>")
    inside = F.from_json("value", f"struct<events:array<{event}>>")["events"]
    starts = F.substring(F.trim("value"), 1, 1)
    return rows.select(F.explode(F.when(starts == "[", listed).otherwise(inside)).alias("e")).select("e.*")
