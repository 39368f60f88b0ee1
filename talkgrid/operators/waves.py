"""More kernels of audio samples: smoothing, level control, denoising, spectral shape and voice quality. Plain functions of one chunk."""

from __future__ import annotations

import numpy as np

from talkgrid.operators.signal import decibels, frame_rms, high_pass, runs

#: Defaults of level control, in dB and frames of 10 ms.
GATE_DB, TARGET_DB, MOST_BOOST_DB, SMOOTH_FRAMES, ALPHA = -45.0, -23.0, 18.0, 25, 0.15
THRESHOLD_DB, RATIO, KNEE_DB = -26.0, 2.0, 6.0


def smooth_exponential(x: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Each value with ``alpha`` of itself and the rest of the result before; the first is kept. Whole vectors at once, in blocks."""
    out, keep, before = np.empty(len(x)), 1.0 - alpha, float(x[0]) if len(x) else 0.0
    width = 64  # short enough for the powers not to vanish
    powers = keep ** np.arange(width + 1)
    weights = np.tril(powers[np.abs(np.subtract.outer(np.arange(width), np.arange(width)))]) * alpha
    for at in range(0, len(x), width):
        part = np.asarray(x[at : at + width], np.float64)
        out[at : at + len(part)] = weights[: len(part), : len(part)] @ part + powers[1 : len(part) + 1] * before
        before = out[at + len(part) - 1]
    return out


def smooth_hann(x: np.ndarray, width: int) -> np.ndarray:
    """Means weighted by a Hann window of ``width``, with the outer values repeated at the ends; one more value for an even width."""
    if width <= 1 or not len(x):
        return np.asarray(x, np.float64)
    w = np.hanning(width)
    return np.convolve(np.pad(np.asarray(x, np.float64), width // 2, mode="edge"), w / max(w.sum(), 1e-12), mode="valid")


def envelope(frames: np.ndarray, hop: int, length: int) -> np.ndarray:
    """A value for each sample, on straight lines between those of frames that begin ``hop`` apart."""
    return np.interp(np.arange(length), np.arange(len(frames)) * hop, frames)


def _levels(y: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    hop = max(1, rate // 100)
    return decibels(frame_rms(y, 2 * hop, hop)), hop


def raise_quiet(y: np.ndarray, rate: int, method: str = "hann") -> np.ndarray:
    """Frames between the gate and the target are raised towards it, by ``MOST_BOOST_DB`` at most; gains are smoothed."""
    if not len(y):
        return y
    level, hop = _levels(y, rate)
    gain = np.where((level > GATE_DB) & (level < TARGET_DB), np.minimum(TARGET_DB - level, MOST_BOOST_DB), 0.0)
    gain = smooth_hann(gain, SMOOTH_FRAMES) if method == "hann" else smooth_exponential(gain)
    return (y * envelope(10 ** (gain / 20), hop, len(y))).astype(np.float32)


def compress(y: np.ndarray, rate: int) -> np.ndarray:
    """What is above the threshold is lowered by the ratio; across the knee the reduction sets in gradually."""
    if not len(y):
        return y
    level, hop = _levels(y, rate)
    over = level - THRESHOLD_DB
    share = np.clip((over + KNEE_DB / 2) / KNEE_DB, 0.0, 1.0)
    return (y * envelope(10 ** (share * over * (1 / RATIO - 1) / 20), hop, len(y))).astype(np.float32)


def limit_peak(y: np.ndarray, most: float = 0.95) -> np.ndarray:
    peak = np.abs(y).max(initial=0.0)
    return (y * (most / peak) if peak > most else y).astype(np.float32)


def resample(y: np.ndarray, rate: int, to: int) -> np.ndarray:
    """At another rate: on straight lines between samples, after what the new rate can't hold is taken away."""
    if rate == to or len(y) < 2:
        return y.astype(np.float32)
    spectrum = np.fft.rfft(y)
    if to < rate:
        spectrum[np.fft.rfftfreq(len(y), 1 / rate) > 0.5 * to] = 0
        y = np.fft.irfft(spectrum, len(y))
    return np.interp(np.arange(int(len(y) * to / rate)) * (rate / to), np.arange(len(y)), y).astype(np.float32)


def frames_of(y: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Frames of ``frame`` samples every ``hop``, until one reaches the end; the last is filled up with zeros."""
    count = 1 + max(0, -(-(len(y) - frame) // hop))
    padded = np.pad(y, (0, max(0, (count - 1) * hop + frame - len(y))))
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop][:count]


def quiet_mask(level: np.ndarray, threshold: float) -> np.ndarray:
    """Frames below ``threshold``, by the majority of 3 to 7 neighbours (more where there are more frames; zeros beyond the ends)."""
    mask = np.asarray(level) < threshold
    k = min(7, max(3, len(mask) // 20)) | 1
    if len(mask) <= 7:
        return mask
    total = np.concatenate([[0], np.cumsum(np.pad(mask.astype(int), k // 2))])
    return (total[k:] - total[:-k]) * 2 > k


def denoise(y: np.ndarray, rate: int, speech: np.ndarray, over_db: float = 3.0, floor: float = 0.06) -> np.ndarray:
    """Spectral subtraction: the mean spectrum of frames that aren't ``speech`` is taken from all, down to a floor.

    ``speech`` is a mask of frames of 20 ms every 10 ms. The mask of the spectrum is smoothed in time, and frames that
    would lose more than 12 dB give half of it back. Without enough noise, nothing changes.
    """
    hop = max(1, rate // 100)
    n = 2 * hop
    if len(y) < 2 * n:
        return y.astype(np.float32)
    window = np.hanning(n + 1)[:-1]
    spectrum = np.fft.rfft(frames_of(np.pad(y.astype(np.float64), n), n, hop) * window, axis=1)
    power = np.abs(spectrum) ** 2
    noise = ~np.pad(speech.astype(bool), (2, max(0, len(power) - len(speech) - 2)), constant_values=False)[: len(power)]
    noise[:2] = noise[-2:] = False
    if noise.sum() < 5:
        return y.astype(np.float32)
    gain = np.maximum(floor, 1 - 10 ** (over_db / 10) * power[noise].mean(axis=0) / np.maximum(power, 1e-20))
    near = np.pad(gain, ((1, 1), (0, 0)), mode="edge")
    gain = np.median(np.stack([near[:-2], near[1:-1], near[2:]]), axis=0)
    lost = 10 * np.log10(np.maximum(1e-12, (gain**2 * power).sum(axis=1) / np.maximum(1e-12, power.sum(axis=1))))
    gain = np.where((lost < -12)[:, None], (1 + gain) / 2, gain)
    pieces = np.fft.irfft(spectrum * gain, n, axis=1)
    out, weight = np.zeros(len(pieces) * hop + n), np.zeros(len(pieces) * hop + n)
    for j in range(2):  # two frames lie over each sample
        part = pieces[j::2]
        at = (np.arange(len(part)) * 2 + j)[:, None] * hop + np.arange(n)
        np.add.at(out, at, part)
        np.add.at(weight, at, np.broadcast_to(window, at.shape))
    return (out / np.maximum(weight, 1e-3))[n : n + len(y)].astype(np.float32)


def snr_by_differences(y: np.ndarray) -> float:
    """Power against the variance of the differences of neighbours, in dB; NaN without samples."""
    if not len(y):
        return float("nan")
    y = y.astype(np.float64)
    return float(10 * np.log10((np.mean(y**2) + 1e-9) / (np.var(np.diff(y)) + 1e-9 if len(y) > 1 else 1e-9)))


def has_speech(y: np.ndarray, voiced_share: float | None = None, least_share: float = 0.05, least_db: float = -60.0) -> bool:
    """Whether a chunk is worth working on: by the share of speech of a detector if there is one, else by its level."""
    if voiced_share is not None:
        return voiced_share >= least_share
    return bool(len(y)) and float(decibels(np.sqrt(np.mean(y.astype(np.float64) ** 2)))) >= least_db


def spectral_shape(y: np.ndarray, rate: int, n: int = 512, hop: int = 256) -> dict[str, float]:
    """Median and quartile distance of the spectral centroid, and the median flatness; NaN without samples."""
    if not len(y):
        return dict.fromkeys(("centroid_median", "centroid_iqr", "flatness_median"), float("nan"))
    magnitude = np.abs(np.fft.rfft(frames_of(np.pad(y.astype(np.float64), n // 2), n, hop) * np.hanning(n + 1)[:-1], axis=1))
    total = magnitude.sum(axis=1)
    centroid = np.where(total > 0, magnitude @ np.fft.rfftfreq(n, 1 / rate) / np.maximum(total, 1e-12), 0.0)
    power = np.maximum(magnitude**2, 1e-10)
    flatness = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
    q1, q2, q3 = np.percentile(centroid, [25, 50, 75])
    return {"centroid_median": float(q2), "centroid_iqr": float(q3 - q1) if len(centroid) > 4 else 0.0, "flatness_median": float(np.median(flatness))}


def quality(y: np.ndarray, rate: int) -> dict[str, float | bool | str]:
    """Signal to noise by the 5th and 85th percentile of frame energies, and whether voice measures can be relied on."""
    frame = min(rate // 20, len(y) // 20)
    early = [(not len(y), -60.0, "empty"), (len(y) < 0.1 * rate, -40.0, "too_short"), (not np.any(np.abs(y) > 1e-8), -60.0, "silent"), (frame < 64, -30.0, "insufficient_length")]
    for hit, snr, status in early:
        if hit:
            return {"snr_db": snr, "reliable": False, "status": status}
    energy = np.mean(np.lib.stride_tricks.sliding_window_view(y.astype(np.float64) ** 2, frame)[:: frame // 2], axis=1)
    low, high = np.percentile(energy, [5, 85])
    ratio = lambda x: float(10 * np.log10((x + 1e-12) / (low + 1e-12)))
    snr = ratio(high) if low > 0 else 10.0
    clipped = float(np.mean(np.abs(y) > 0.95))
    tests = [(snr >= 6.0, "low_snr"), (clipped < 0.03, "clipping"), (ratio(energy.max()) >= 12.0, "low_range"), (len(y) >= 0.2 * rate, "short")]
    failed = next((name for ok, name in tests if not ok), None)
    return {"snr_db": snr, "reliable": failed is None, "status": failed or "reliable"}


def voice_quality(y: np.ndarray, rate: int, low: float = 60, high: float = 400) -> dict[str, float]:
    """Jitter, shimmer, harmonics to noise, cepstral peak, voiced share and spectral slope, without an outside program.

    Jitter is the mean change of neighbouring periods in percent of the mean period; shimmer the median deviation of the
    level's changes; harmonics to noise come from the height of the autocorrelation peak; the cepstral peak is measured
    against its mean; the slope is that of the mean spectrum from 1 to 4 kHz in dB a decade.
    """
    out = dict.fromkeys(("jitter_pct", "shimmer_db", "hnr_db", "cpps_db", "voiced_ratio", "spectral_slope_db"), 0.0)
    n, hop = max(4, rate * 40 // 1000), max(1, rate // 100)
    if len(y) < n:
        return out
    x = np.lib.stride_tricks.sliding_window_view(y.astype(np.float64), n)[::hop]
    x = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, axis=1)[:, :n]
    energy = r[:, 0]
    a, b = max(1, int(rate / high)), min(n - 1, int(rate / low))
    if b <= a:
        return out
    lag = a + r[:, a:b].argmax(axis=1)
    # the window takes from a lag as much as it is long
    peak = r[np.arange(len(r)), lag] / np.maximum(energy, 1e-12) * n / (n - lag)
    voiced = (energy > 1e-6) & (peak > 0.45)
    out["voiced_ratio"] = float(voiced.mean())
    if voiced.sum() > 3:
        periods, h = lag[voiced] / rate, np.clip(peak[voiced].mean(), 1e-6, 0.9999)
        out["jitter_pct"] = float(np.clip(np.abs(np.diff(periods)).mean() / periods.mean() * 100, 0, 25))
        out["hnr_db"] = float(np.clip(10 * np.log10(h / (1 - h)), 0, 40))
    level = decibels(np.sqrt(energy / n))
    if len(level) > 5:
        change = np.diff(level)
        out["shimmer_db"] = float(np.clip(np.median(np.abs(change - np.median(change))), 0, 15))
    magnitude = np.abs(np.fft.rfft(x * np.hanning(n), size, axis=1))
    cepstrum = np.abs(np.fft.irfft(np.log(np.maximum(magnitude, 1e-9)), axis=1))[:, a:b]
    out["cpps_db"] = float(np.clip(np.mean(20 * np.log10(np.maximum(cepstrum.max(axis=1), 1e-9) / np.maximum(cepstrum.mean(axis=1), 1e-9))), 0, 35))
    f, mean = np.fft.rfftfreq(size, 1 / rate), magnitude.mean(axis=0)
    inside = (f >= 1000) & (f <= 4000) & (mean > 0)
    if inside.sum() > 10:
        out["spectral_slope_db"] = float(np.clip(np.polyfit(np.log10(f[inside]), 20 * np.log10(mean[inside]), 1)[0], -30, 10))
    return out


def preprocess(y: np.ndarray, rate: int) -> np.ndarray:
    """The chain of a chunk: high pass, noise reduction, upward gain, compression, and the limit of peaks."""
    if not len(y):
        return y
    y = high_pass(y, rate)
    level, _ = _levels(y, rate)
    speech = level > np.percentile(level, 20) + 12
    return limit_peak(compress(raise_quiet(denoise(y, rate, speech), rate), rate))


def longest_run(mask: np.ndarray) -> int:
    return max((b - a for a, b in runs(np.asarray(mask, bool))), default=0)
