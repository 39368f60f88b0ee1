"""Kernels of audio samples, as functions of one chunk; ``per_chunk`` runs them on a table of chunks by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def frame_rms(y: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Root mean square of each frame, by cumulated squares; the last frame may be cut."""
    if not len(y):
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(y.astype(np.float64) ** 2)])
    starts = np.arange(0, max(1, len(y) - frame + hop), hop)
    starts = starts[starts < len(y)]
    ends = np.minimum(starts + frame, len(y))
    return np.sqrt((total[ends] - total[starts]) / (ends - starts))


def decibels(x: np.ndarray | float) -> np.ndarray:
    return 20 * np.log10(np.maximum(1e-12, x))


def loudness(y: np.ndarray, rate: int) -> float:
    """Mean level of blocks of 400 ms, every 100 ms, that aren't 10 dB below the mean of all; the level of a shorter chunk."""
    block, hop = rate * 400 // 1000, rate * 100 // 1000
    if block <= 0 or len(y) < block:
        return float(decibels(np.sqrt(np.mean(y.astype(np.float64) ** 2) + 1e-12))) if len(y) else -120.0
    total = np.concatenate([[0.0], np.cumsum(y.astype(np.float64) ** 2)])
    at = np.arange(0, len(y) - block + 1, hop)
    level = decibels(np.sqrt((total[at + block] - total[at]) / block + 1e-12))
    loud = level[level > level.mean() - 10]
    return float(loud.mean() if len(loud) else level.mean())


def health(y: np.ndarray, rate: int, silence_db: float = -60.0) -> dict[str, float | bool]:
    """Level, signal to noise, dynamic range, silence, loudness and clipping of a chunk.

    Signal to noise is the mean power over the 10th percentile of the samples' powers; silence the share of samples below
    ``silence_db``; the range goes from the 5th to the 95th percentile of amplitudes; clipping is looked for on four points a
    sample. Without samples all is silence.
    """
    if not len(y):
        return {"rms_db": -120.0, "snr_db": 0.0, "dynamic_range_db": 0.0, "silence_ratio": 1.0, "est_lufs": -120.0, "clipping_detected": False}
    y = y.astype(np.float64)
    power, size = float(np.mean(y**2)), np.abs(y)
    low, high = np.percentile(size + 1e-12, [5, 95])
    between = np.interp(np.arange(len(y) * 4 - 3) / 4, np.arange(len(y)), y)
    return {
        "rms_db": float(decibels(np.sqrt(power + 1e-12))), "snr_db": float(10 * np.log10(power / max(np.percentile(y**2, 10), 1e-12))) if power > 0 else 0.0,
        "dynamic_range_db": float(max(0.0, decibels(high) - decibels(low))), "silence_ratio": float(np.mean(size < 10 ** (silence_db / 20))),
        "est_lufs": loudness(y, rate), "clipping_detected": bool((np.abs(between) >= 0.999).any()),
    }


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Spans [first, last) in which a mask is set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def speech_regions(y: np.ndarray, rate: int, gate_db: float = -33.0, hop: float = 0.01, pad: float = 0.1, gap: float = 0.5) -> list[tuple[float, float]]:
    """Spans in seconds that are louder than ``gate_db``, padded and joined within ``gap``."""
    step = max(1, int(rate * hop))
    out: list[list[float]] = []
    for a, b in runs(decibels(frame_rms(y, step, step)) > gate_db):
        s, e = max(0.0, a * hop - pad), min(len(y) / rate, b * hop + pad)
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def pauses(y: np.ndarray, rate: int, threshold_db: float = -45.0, least: float = 0.2, long: float = 0.6) -> dict[str, float]:
    """Number of pauses, of long ones, their time and its share of the chunk."""
    step = max(1, rate // 100)
    quiet = decibels(frame_rms(y, 2 * step, step)) < threshold_db
    lengths = np.array([(b - a) * step / rate for a, b in runs(quiet)] or [0.0])
    found = lengths[lengths >= least]
    return {"pause_count": float(len(found)), "long_pauses": float((found >= long).sum()), "pause_time_s": float(found.sum()), "pause_ratio": float(found.sum() / max(len(y) / rate, 1e-9))}


def hz_to_mel(f: np.ndarray | float) -> np.ndarray:
    return 2595 * np.log10(1 + np.asarray(f) / 700)


def mel_to_hz(m: np.ndarray | float) -> np.ndarray:
    return 700 * (10 ** (np.asarray(m) / 2595) - 1)


def mel_filters(rate: int, n_fft: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles between band centres that are evenly spaced in mel: bands by frequencies."""
    centres = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), bands + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - centres[:-2, None]) / np.maximum(1e-9, centres[1:-1] - centres[:-2])[:, None]
    down = (centres[2:, None] - f) / np.maximum(1e-9, centres[2:] - centres[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(y: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 320, bands: int = 64) -> np.ndarray:
    """Log energies of mel bands of each frame (Hann windows, reflected at the ends)."""
    if len(y) < 2:
        return np.zeros((0, bands))
    half = n_fft // 2
    padded = np.pad(y.astype(np.float64), half, mode="reflect" if len(y) > half else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    return 10 * np.log10(np.maximum(1e-10, power @ mel_filters(rate, n_fft, bands, 50, min(14_000, rate / 2)).T))


def pitch(y: np.ndarray, rate: int, low: float = 60, high: float = 400) -> dict[str, float]:
    """Median and quartile range of the pitch of voiced frames, by autocorrelation; zeros if none is voiced."""
    frame, hop = max(2, rate * 40 // 1000), max(1, rate * 10 // 1000)
    found = []
    for at in range(0, max(0, len(y) - frame), hop):
        x = y[at : at + frame] - y[at : at + frame].mean()
        energy = float(x @ x)
        if energy < 1e-6:
            continue
        n = 1 << (2 * frame - 1).bit_length()
        r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2)[:frame] / energy
        a, b = int(rate / high), min(frame - 1, int(rate / low))
        k = a + int(r[a:b].argmax()) if b > a else 0
        if k and r[k] > 0.45:
            found.append(rate / k)
    if not found:
        return {"f0_median_hz": 0.0, "f0_iqr_hz": 0.0, "voiced_frames": 0.0}
    q1, q2, q3 = np.percentile(found, [25, 50, 75])
    return {"f0_median_hz": float(q2), "f0_iqr_hz": float(q3 - q1), "voiced_frames": float(len(found))}


def high_pass(y: np.ndarray, rate: int, cut: float = 80.0) -> np.ndarray:
    """Without what is below ``cut``: a Butterworth response of second order, both ways, in the frequency domain."""
    if not len(y):
        return y
    f = np.fft.rfftfreq(len(y), 1 / rate)
    gain = (f / cut) ** 4 / (1 + (f / cut) ** 4)
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y)).astype(np.float32)


def to_loudness(y: np.ndarray, rate: int, target: float = -20.0) -> np.ndarray:
    """Moved towards a loudness by at most 12 dB, and held below a peak of 0.95."""
    gain = np.clip(target - loudness(y, rate), -12, 12)
    out = y * 10 ** (gain / 20)
    peak = np.abs(out).max(initial=0.0)
    return (out * (0.95 / peak) if peak > 0.95 else out).astype(np.float32)


def trim_overlaps(y: np.ndarray, rate: int, left: float, right: float) -> np.ndarray:
    """A chunk without what it shares with its neighbours."""
    return y[round(left * rate) : len(y) - round(right * rate)]


def per_chunk(chunks: DataFrame, kernel: Callable[[np.ndarray, int], dict], schema: str) -> DataFrame:
    """``path``, ``chunk_id`` and the values of ``kernel`` (named in ``schema``) of each chunk of ``read_audio``; chunks without samples are left out."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, c, *[v[n] for n in names]) for p, c, v in ((p, c, kernel(np.asarray(x, np.float32), r)) for p, c, x, r in zip(batch["path"], batch["chunk_id"], batch["samples"], batch["rate"]))]
            yield pd.DataFrame(out, columns=["path", "chunk_id", *names])

    return chunks.filter("samples IS NOT NULL").select("path", "chunk_id", "samples", "rate").mapInPandas(run, f"path string, chunk_id int, {schema}")
