"""Kernels of samples against plain definitions; overlays, caches and spectral clusters on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.operators import rules, runs, signal, transcripts, vectors, waves

RATE = 8000


def tone(seconds, hz=200.0, size=0.3):
    t = np.arange(int(seconds * RATE)) / RATE
    return (size * np.sin(2 * np.pi * hz * t)).astype(np.float32)


def test_smoothing():
    x = np.random.default_rng(1).normal(size=300)
    want, acc = [], x[0]
    for v in x:
        acc = 0.15 * v + 0.85 * acc
        want.append(acc)
    assert np.allclose(waves.smooth_exponential(x, 0.15), want) and len(waves.smooth_exponential(x[:0])) == 0
    assert np.allclose(waves.smooth_hann(np.ones(20), 7), 1.0) and np.array_equal(waves.smooth_hann(x, 1), x)
    assert np.allclose(waves.envelope(np.array([0.0, 1.0]), 4, 6), [0, 0.25, 0.5, 0.75, 1, 1])


def test_level_control():
    quiet, loud = tone(1, size=0.02), tone(1, size=0.8)
    level = lambda y: signal.decibels(np.sqrt(np.mean(y[1000:-1000].astype(float) ** 2)))
    assert level(waves.raise_quiet(quiet, RATE)) == pytest.approx(waves.TARGET_DB, abs=0.5)
    assert level(waves.raise_quiet(quiet, RATE, "exponential")) == pytest.approx(waves.TARGET_DB, abs=1.5)
    assert np.allclose(waves.raise_quiet(tone(1, size=1e-4), RATE), tone(1, size=1e-4))
    want = waves.THRESHOLD_DB + (level(loud) - waves.THRESHOLD_DB) / waves.RATIO
    assert level(waves.compress(loud, RATE)) == pytest.approx(want, abs=0.3)
    assert np.abs(waves.limit_peak(2 * loud)).max() == pytest.approx(0.95) and np.array_equal(waves.limit_peak(quiet), quiet)
    for f in (waves.raise_quiet, waves.compress, waves.preprocess):
        assert len(f(quiet[:0], RATE)) == 0
    assert len(waves.preprocess(loud, RATE)) == len(loud) and np.isfinite(waves.preprocess(loud, RATE)).all()


def test_health_by_definition():
    y = np.concatenate([tone(1), np.zeros(RATE, np.float32)])
    h = signal.health(y, RATE)
    assert h["silence_ratio"] == pytest.approx(np.mean(np.abs(y) < 1e-3)) and not h["clipping_detected"]
    assert h["snr_db"] == pytest.approx(10 * np.log10(np.mean(y.astype(float) ** 2) / 1e-12), abs=1e-6)
    # between two samples below the limit there may be no more than these; a full-scale sample clips
    assert signal.health(np.array([0.0, 1.0, 0.0], np.float32), RATE)["clipping_detected"]
    assert signal.loudness(tone(2), RATE) == pytest.approx(20 * np.log10(0.3 / 2**0.5), abs=0.1)
    assert signal.loudness(y, RATE) > signal.decibels(np.sqrt(np.mean(y**2)))  # silence is left out


def test_frames_masks_and_rates():
    assert [f.tolist() for f in waves.frames_of(np.arange(5.0), 4, 2)] == [[0, 1, 2, 3], [2, 3, 4, 0]]
    assert [f.tolist() for f in waves.frames_of(np.arange(2.0), 4, 2)] == [[0, 1, 0, 0]]
    level = np.full(60, -60.0)
    level[30] = -10
    assert waves.quiet_mask(level, -45).all() and waves.longest_run(waves.quiet_mask(level, -45)) == 60  # a single loud frame goes
    level[28:33] = -10
    assert waves.longest_run(waves.quiet_mask(level, -45)) == 28 and waves.quiet_mask(level[:5], -45).all()
    low = waves.resample(tone(1), RATE, 4000)
    assert len(low) == 4000 and np.corrcoef(low, tone(1)[::2])[0, 1] > 0.99
    assert np.abs(waves.resample(tone(1, 3000), RATE, 4000)).max() < 0.05 and len(waves.resample(tone(1), 4000, RATE)) == 16_000


def test_denoising_lowers_the_noise_only():
    noise = np.random.default_rng(2).normal(size=2 * RATE).astype(np.float32) * 0.01
    y = noise.copy()
    y[RATE:] += tone(1)
    level = signal.decibels(signal.frame_rms(y, 160, 80))
    out = waves.denoise(y, RATE, level > -30)
    assert len(out) == len(y) and np.std(out[1000:7000]) < 0.6 * np.std(y[1000:7000]) and np.std(out[9000:15000]) == pytest.approx(np.std(y[9000:15000]), rel=0.15)
    assert np.array_equal(waves.denoise(y[:100], RATE, np.zeros(1)), y[:100])


def test_features_of_a_voice():
    y = tone(1, 200) + tone(1, 400, 0.1)
    shape = waves.spectral_shape(y, RATE)
    assert 200 < shape["centroid_median"] < 400 and shape["flatness_median"] < 0.05
    voice, rough = waves.voice_quality(y, RATE), waves.voice_quality(np.random.default_rng(3).normal(size=RATE).astype(np.float32) * 0.1, RATE)
    assert voice["voiced_ratio"] > 0.9 > rough["voiced_ratio"] and voice["jitter_pct"] < 1 and voice["hnr_db"] > 15
    assert waves.voice_quality(y[:10], RATE)["voiced_ratio"] == 0.0 and np.isnan(waves.spectral_shape(y[:0], RATE)["centroid_median"])
    parts = np.concatenate([y[:4000], np.zeros(4000, np.float32) + 1e-4])
    assert waves.quality(parts, RATE)["status"] == "reliable" and waves.quality(y, RATE)["status"] == "low_snr"
    assert [waves.quality(x, RATE)["status"] for x in (y[:0], y[:100], np.zeros(RATE, np.float32))] == ["empty", "too_short", "silent"]
    assert waves.has_speech(y) and not waves.has_speech(y * 1e-5) and waves.has_speech(y * 0, 0.05) and not waves.has_speech(y, 0.01)
    assert np.isnan(waves.snr_by_differences(y[:0])) and waves.snr_by_differences(y) > 10


def test_spectral_clusters_of_planted_groups(spark):
    rng = np.random.default_rng(4)
    middles = np.eye(8)[:3]
    data = [("f", 10 * j + i, (middles[j] + rng.normal(size=8) * 0.05).tolist()) for j in range(3) for i in range(8)] + [("one", 99, [1.0] * 8), ("none", 98, None)]
    df = spark.createDataFrame(data, "file_id string, id bigint, v array<double>")
    out = vectors.spectral_cluster(df, ["file_id"], "id", "v").collect()
    by = {r.id: r.cluster for r in out}
    assert [by[10 * j + i] for j in range(3) for i in range(8)] == [j for j in range(3) for _ in range(8)] and by[99] is None and 98 not in by
    with pytest.raises(Exception, match="more than 5"):
        vectors.spectral_cluster(df, ["file_id"], "id", "v", most_vectors=5).collect()
    a = vectors.affinity(np.array([x for _, _, x in data[:24]]), 0.5)
    assert np.allclose(a, a.T) and a.min() >= 0.5 and a.max() == 1.0
    assert vectors.centroid_spread(spark.createDataFrame([("f", [1.0, 0.0]), ("f", [0.0, 1.0]), ("g", [1.0, 1.0])], "file_id string, centroid array<double>"), ["file_id"]).orderBy("file_id").collect()[0].apart == pytest.approx(1.0, abs=1e-6)


def test_overlay_by_position_then_time(spark):
    left = spark.createDataFrame([("f", 1, 0, None, "a"), ("f", 2, 1000, 0.5, "b"), ("f", 3, 2000, 0.7, "c"), ("f", 4, 9000, 0.9, "d"), ("g", 5, 0, 1.0, "e")], "file_id string, idx bigint, s bigint, valence double, tag string")
    right = spark.createDataFrame([("f", 11, 10, 0.1, ""), ("f", 12, 2500, None, "x")], "file_id string, idx bigint, s bigint, valence double, tag string")
    out = {r.idx: (r.valence, r.tag, r.match) for r in transcripts.overlay(left, right, ["file_id"], ["valence", "tag"]).collect()}
    assert out == {1: (0.1, "a", "position"), 2: (0.5, "x", "position"), 3: (0.7, "x", "time"), 4: (0.9, "d", None), 5: (1.0, "e", None)}
    assert transcripts.overlay(left.limit(0), right, ["file_id"], ["tag"]).count() == 0


def test_words_with_times(spark):
    words = spark.createDataFrame([("f", 0, " one ", 0, 400), ("f", 1, "two", 900, 1100), ("f", 2, "", 1500, 1600)], "file_id string, i bigint, word string, s bigint, e bigint")
    bounds = spark.createDataFrame([("f", 0, 0, 1000, 7000), ("f", 1, 1000, 2000, 20_000), ("f", 2, 2000, 3000, 0)], "file_id string, k bigint, s bigint, e bigint, origin bigint")
    out = {r.k: (r.text, [tuple(w) for w in r.words or []]) for r in transcripts.words_to_boundaries(words, bounds, ["file_id"]).collect()}
    assert out == {0: ("one two", [("one", 7000, 7400), ("two", 7900, 8100)]), 1: ("two", [("two", 19_900, 20_100), ("", 20_500, 20_600)]), 2: ("[silence]", [])}


def test_caches(spark):
    assert runs.signature({"b": 1, "denoise": "x"}, ["denoise", "b", "c"]) == '{"b": 1, "c": null, "denoise": "x"}'
    entries = spark.createDataFrame([("a", 1, "v1", "s1"), ("a", 2, "v1", "s2"), ("b", 1, "v0", "s1"), ("c", 1, None, "s1")], "file string, at int, version string, sha string")
    wanted = spark.createDataFrame([("a", "v1", None), ("b", "v1", "s1"), ("c", "v1", None)], "file string, version string, sha string")
    assert {(r.file, r.at) for r in runs.usable(entries, wanted, ["file"], ["version", "sha"]).collect()} == {("a", 1), ("a", 2)}
    assert [(r.file, r.at) for r in runs.newest_usable(entries, wanted, ["file"], ["version", "sha"], "at").collect()] == [("a", 2)]
    assert [r.at for r in runs.page(entries, [F.col("at").desc(), F.col("file")], 2, 1).collect()] == [1, 1]


def test_joined_chunks(spark):
    df = spark.createDataFrame([("f", 0, [1.0, 2.0, 3.0], 1), ("f", 1, [3.0, 4.0], 1), ("f", 2, [5.0], 1), ("f", 3, [5.0, 6.0], 1)], "path string, c int, samples array<double>, overlap int")
    out = runs.chunk_offsets(df, ["path"], "c").orderBy("c").collect()
    assert [(r.at, r.samples) for r in out] == [(0, [1, 2, 3]), (3, [4]), (4, [5]), (5, [6])]


def test_shimmer_counts_where_it_is_measured(spark):
    df = spark.createDataFrame([("f", 1, 100.0, 0.1, -20.0, 1.0, 0.0, 2.0)], "file_id string, idx bigint, wpm double, pause_ratio double, loudness_rms double, vq_jitter_pct double, disfluency_rate double, vq_shimmer_db double")
    assert rules.speech_anomalies(df).first().flags == "high_shimmer" and rules.speech_anomalies(df.drop("vq_shimmer_db")).count() == 0
