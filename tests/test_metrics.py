"""Metrics, speakers, text, vectors, sequential operators, files and signals."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid import schema
from talkgrid.functions import affect, text
from talkgrid.operators import conversation, signal, speakers, streams, transcripts, vectors
from talkgrid.sources import files, sinks

GOLDEN = [("f", 0, "A", 0, 10_000, 0.5, "hello topic one"), ("f", 1, "B", 10_000, 20_000, 0.7, "topic one again"), ("f", 2, "A", 19_000, 25_000, 0.2, "new words here"), ("f", 3, "B", 25_500, 30_000, 0.6, "closing words")]


@pytest.fixture()
def golden(spark):
    return spark.createDataFrame(GOLDEN, "file_id string, idx bigint, speaker_id string, s bigint, e bigint, arousal double, text string")


def test_golden_conversation(golden):
    m = conversation.conversation_metrics(golden).first()
    assert m.turn_taking_balance == pytest.approx(0.9982545693874831)
    assert (m.turns_per_min, m.interruption_rate_per_min, m.avg_turn_duration_sec) == (8.0, 2.0, 7.625)
    assert (m.latency_avg_sec, m.latency_median_sec, m.latency_count, m.silence_ratio) == (0.25, 0.25, 2, 0.0)
    shares = {r.speaker_id: r.share_pct for r in conversation.speaker_dominance(golden).collect()}
    assert shares["A"] == pytest.approx(52.459016393442624) and shares["B"] == pytest.approx(47.540983606557376)


def test_conversation_of_nothing(spark, golden):
    assert conversation.conversation_metrics(golden.limit(0)).count() == 0
    one = golden.limit(1).withColumn("e", F.col("s"))
    m = conversation.conversation_metrics(one).first()
    assert (m.turn_taking_balance, m.turns_per_min, m.silence_ratio) == (0.0, 0.0, 1.0)
    assert conversation.topic_coherence(one).first().coherence == 1.0


def test_votes_break_ties_by_order(spark):
    df = spark.createDataFrame([("f", 3, "b"), ("f", 1, "a"), ("f", 2, "b"), ("f", 4, "a"), ("f", 0, ""), ("f", 5, None)], "k string, i bigint, v string")
    assert [tuple(r) for r in speakers.votes(df, ["k"], "v", "i").collect()] == [("f", "a", 2)]


def test_p2_estimate(spark):
    rnd = random.Random(2)
    data = [("a", i, rnd.gauss(10, 2)) for i in range(3000)] + [("b", i, float(i)) for i in range(3)] + [("c", 0, None)]
    df = spark.createDataFrame(data, "k string, i bigint, x double")
    got = {r.k: r.estimate for r in speakers.p2_quantiles(df, ["k"], "i", "x", 0.5).collect()}
    assert got["a"] == pytest.approx(10, abs=0.2) and got["b"] == 1.0 and "c" not in got


def test_text_functions(spark):
    df = spark.createDataFrame([("So um, I I I mean - we we went, you know you know, to the ocean's edge",), ("",), (None,), ("naïve   co-op a b 7",)], "t string")
    r = df.select(text.tokens(F.col("t")).alias("w"), text.word_count(F.col("t")).alias("n"), text.filler_count(text.tokens(F.col("t")), F.col("t")).alias("f"), text.syllable_count(text.tokens(F.col("t"))).alias("s")).collect()
    assert r[0].w[:4] == ["so", "um", "i", "i"] and r[1].w == [] and r[2].w == [] and r[2].n == 0 and r[2].f == 0
    assert r[3].w == ["naïve", "co-op", "a"] and r[3].n == 5
    c = spark.createDataFrame([(5200, 3723.0), (None, None)], "ms bigint, sec double").select(text.clock(F.col("ms")).alias("a"), text.spoken_clock(F.col("sec")).alias("b"), text.short_clock(F.col("sec")).alias("c"), text.fine_clock(F.col("ms")).alias("d")).collect()
    assert tuple(c[0]) == ("00:00:05", "1h 02m 03s", "1:02:03", "00:05.200") and tuple(c[1]) == ("--:--:--", "0s", "0:00", "00:00.000")


def test_affect_functions(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('Joy', 0.6D, 'joy', 0.2D, 'x', 0.2D, 'bad', double('NaN'))), (2, map_from_arrays(array(), array())), (3, NULL) AS t(i, m)").orderBy("i").select(F.col("m").cast("map<string,double>").alias("m"))
    m = F.col("m")
    r = df.select(affect.normalize_scores(m, ["neutral", "joy"]).alias("n"), affect.top_margin(m).alias("t"), affect.low_confidence(m).alias("l"), affect.top_k(m, 2).alias("k")).collect()
    assert r[0].n == {"neutral": 0.5, "joy": 0.5} and r[1].n == {"neutral": 1.0, "joy": 0.0}
    assert r[0].t == pytest.approx(0.4) and r[1].t == 0.0 and r[1].l and r[2].l
    assert [e.label for e in r[0].k] == ["Joy", "joy"]
    s = spark.range(1).select(affect.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first().s
    assert s == [0.5, 0.5]


def seg(spark, data):
    return spark.createDataFrame([("f", i, k, s, e) for i, (k, s, e) in enumerate(data)], "file_id string, idx bigint, speaker_id string, s bigint, e bigint")


def test_packing(spark):
    df = seg(spark, [("A", 2000 * i, 2000 * i + 2000) for i in range(6)] + [("A", 20_000, 40_000)])
    got = {r.idx: r.batch for r in streams.pack_batches(df, longest=3000, most=3, threshold=4).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 0, 1, 1, 1, None]
    assert streams.pack_batches(df.limit(0)).count() == 0


def test_overlaps_are_cut_in_the_middle(spark):
    df = seg(spark, [("A", 0, 1000), ("B", 800, 2000), ("C", 1900, 1910)])
    got = sorted((r.idx, r.s, r.e) for r in streams.resolve_overlaps(df).collect())
    assert got == [(0, 0, 900), (1, 900, 1950)]


def test_short_turns(spark):
    df = seg(spark, [("A", 0, 2000), ("A", 2100, 2200), ("B", 2500, 2600), ("B", 2700, 5000), ("C", 6000, 6100)])
    assert sorted((r.idx, r.s, r.e) for r in streams.absorb_short(df, 1000, 500).collect()) == [(0, 0, 2200), (3, 2500, 5000), (4, 6000, 6100)]


def test_vectors(spark):
    rnd = np.random.default_rng(0)
    middles = np.eye(8)[:3] * 5
    data = [(int(i), int(i % 3), (middles[i % 3] + rnd.normal(0, 0.1, 8)).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "id bigint, label int, v array<double>")
    groups = {}
    for r in vectors.cluster(df.withColumn("g", F.lit("x")), ["g"], "id", "v", 0.3).collect():
        groups.setdefault(r.cluster, set()).add(r.id % 3)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    registry = vectors.centroids(df, ["label"], "v").select(F.col("label").cast("string").alias("name"), "centroid", F.lit(1).cast("bigint").alias("samples"))
    assert all(str(r.id % 3) == r.name for r in vectors.match_registry(df, "id", "v", registry).collect())
    none = vectors.match_registry(df, "id", "v", registry.limit(0)).first()
    assert none.name is None and none.similarity == 0.0
    moved = vectors.update_registry(registry, registry.withColumn("name", F.concat(F.lit("n"), "name")))
    assert moved.count() == 6 and moved.agg(F.max("samples")).first()[0] == 1


def test_collapse(spark):
    df = spark.createDataFrame([("f", "A", 9500), ("f", "B", 500), ("g", "A", 5), ("g", "B", 5), ("h", "A", 7)], "file_id string, speaker_id string, speech bigint")
    got = {r.file_id: r.collapse for r in vectors.collapse_speakers(df).collect()}
    assert got == {"f": True, "g": False, "h": False}
    assert not vectors.collapse_speakers(df, secondary_max_ratio=0.04).filter("file_id = 'f'").first().collapse


def test_collapse_of_turns(spark):
    one, near, far = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = [
        *[("near", s, 50, v) for s, v in (("A", one), ("A", one), ("B", near))], *[("far", s, 50, v) for s, v in (("A", one), ("A", one), ("B", far))],
        ("two", "A", 95, one), ("two", "B", 5, one), ("main", "A", 90, one), ("main", "A", 90, far), ("main", "B", 9, far), ("none", "A", 50, None), ("none", "A", 50, None), ("none", "B", 50, None),
    ]
    df = spark.createDataFrame(rows, "file_id string, speaker_id string, speech bigint, vector array<double>")
    got = lambda **x: {r.file_id for r in vectors.collapse_turns(df, **x).collect() if r.collapse}
    assert got() == {"near", "main"} and got(min_turns=2) == {"near", "main", "two"}
    assert got(secondary_max_ratio=0.04) == {"near"} and got(secondary_min=50) == {"main"} and got(centroid=0) == {"main"}
    forced = {r.file_id: (r.force, r.silhouette) for r in vectors.force_single_speaker(df).collect()}
    assert {k for k, v in forced.items() if v[0]} == {"main"} and forced["two"][1] is None and forced["far"][1] == pytest.approx(2 / 3, abs=1e-6)


def test_transcripts(spark, golden):
    split = {r.part: r.text for r in transcripts.split_text(golden.limit(1), [0.5, 0.3, 0.2]).collect()}
    assert split == {0: "hello", 1: "topic", 2: "one"}
    words = {r.k: r.text for r in transcripts.words_to_windows(golden.limit(1), 5000).collect()}
    assert words == {0: "hello topic", 1: "topic one"}
    assert transcripts.changed_rows(golden, golden.withColumn("text", F.when(F.col("idx") == 2, "x").otherwise(F.col("text"))), "idx", ["text"]).count() == 1


def test_segment_columns_and_sinks(spark, golden, tmp_path):
    rows = schema.with_segment_columns(golden.withColumn("start", F.col("s") / 1000.0).withColumn("wpm", F.lit("fast")))
    assert rows.columns == list(schema.SEGMENT_COLUMNS) and len(rows.columns) == 53
    first = rows.orderBy("start").first()
    assert first.wpm is None and first.error_flags == "" and first.asr_tokens_json == [] and first.start == 0.0
    sinks.write_segments(rows, str(tmp_path / "seg"))
    back = files.read_csv(spark, str(tmp_path / "seg" / "segments_csv"), "file_id string, start double, arousal double, nothing int", ["file_id"])
    assert back.count() == 4 and sorted(r.arousal for r in back.collect()) == [0.2, 0.5, 0.6, 0.7]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "seg" / "segments_csv"), "x int", ["x"])
    more = golden.withColumns({c: F.lit(None).cast(t) for c, t in (("speaker_name", "string"), ("emotion_top", "string"), ("valence", "double"), ("dominance", "double"), ("intent_top", "string"), ("noise_tag", "string"), ("vad_unstable", "boolean"))})
    sinks.write_transcript(more, str(tmp_path / "txt"))
    assert "[00:00:00 - 00:00:10] A" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())
    page = sinks.report_html({"pace": 8}, [{"speaker_id": "<A>"}], [], [{"speaker": "A", "text": "x"}], 3)
    assert "&lt;A&gt;" in page and "2 more segments" in page
    assert "- pace: 8" in sinks.report_markdown({"pace": 8}, ["calm"])


def test_audio(spark, tmp_path):
    rate = 8000
    y = (0.5 * np.sin(2 * np.pi * 200 * np.arange(2 * rate) / rate)).astype(np.float32)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((y * 32767).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no sound")
    probe = {r.path.rsplit("/", 1)[1]: r for r in files.probe_audio(spark, str(tmp_path)).collect()}
    assert probe["a.wav"].duration_s == 2.0 and probe["a.wav"].is_pcm and not probe["b.wav"].is_pcm
    chunks = files.read_audio(spark, str(tmp_path), rate=0, chunk=1.0)
    assert chunks.count() == 3 and chunks.filter("samples IS NULL").count() == 1
    out = signal.per_chunk(chunks, signal.pitch, "f0_median_hz double, f0_iqr_hz double, voiced_frames double").collect()
    assert all(r.f0_median_hz == pytest.approx(200, rel=0.03) for r in out) and len(out) == 2
    assert files.audio_files(spark, str(tmp_path), "*.wav").withColumn("key", files.cache_key(16000)).count() == 2


def test_signal_kernels():
    silence = signal.health(np.zeros(16_000, np.float32), 16_000)
    assert silence["silence_ratio"] == 1.0 and not silence["clipping_detected"] and silence["snr_db"] == 0.0
    y = np.concatenate([np.zeros(8000), np.ones(8000) * 0.5, np.zeros(8000)]).astype(np.float32)
    assert signal.speech_regions(y, 8000) == [pytest.approx((0.9, 2.1), abs=0.03)]
    assert signal.pauses(y, 8000)["pause_count"] == 2
    assert signal.log_mel(y, 8000).shape[1] == 64
    assert np.abs(signal.high_pass(np.ones(8000, np.float32), 8000)).max() < 1e-3
    assert signal.mel_to_hz(signal.hz_to_mel(440.0)) == pytest.approx(440)
    assert len(signal.trim_overlaps(y, 8000, 0.25, 0.25)) == 20_000
    assert signal.health(np.zeros(0, np.float32), 8000)["silence_ratio"] == 1.0


def test_timeline_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"events":[{"label":"music","start":0,"end":0.5,"score":0.9}]}')
    (tmp_path / "b.json").write_text('[{"label":"speech","start":0,"end":0.2}]')
    (tmp_path / "c.json").write_text("broken")
    assert sorted(r.label for r in files.read_timeline(spark, str(tmp_path)).collect()) == ["music", "speech"]


def test_pipeline(spark, tmp_path):
    from talkgrid.plans import pipeline

    names = pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "speakers_summary")).count() > 0 and "transcript" in names


def test_clusters_of_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CLUSTERED_AT_ONCE", 20)
    rnd = np.random.default_rng(1)
    data = [("g" if i < 300 else "h", int(i), (np.eye(6)[i % 4] * 5 + rnd.normal(0, 0.05, 6)).tolist()) for i in range(320)]
    df = spark.createDataFrame(data, "g string, id bigint, v array<double>")
    found = {}
    for r in vectors.cluster(df, ["g"], "id", "v", 0.3).collect():
        found.setdefault((r.g, r.cluster), set()).add(r.id % 4)
    assert sorted(k for k in found) == [(g, c) for g in "gh" for c in (1, 2, 3, 4)] and all(len(x) == 1 for x in found.values())
    assert vectors.cluster(df.limit(0), ["g"], "id", "v").count() == 0


def test_clusters_are_those_of_average_linkage_at_any_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("g", F.lit("x"))
    rows = df.select("vec_id", "embedding").orderBy("vec_id").collect()
    wanted = vectors.agglomerate(np.array([r.embedding for r in rows], np.float64), np.ones(len(rows)), 0.6)
    found = {r.vec_id: r.cluster for r in vectors.cluster(df, ["g"], "vec_id", "embedding", 0.6).collect()}
    assert len(found) == len(rows) == 2000
    assert len({(found[r.vec_id], w) for r, w in zip(rows, wanted)}) == len(set(found.values())) == len(set(wanted))


def test_merging_and_fit_of_labels(spark):
    df = spark.createDataFrame([("f", "a", [1.0, 0.0]), ("f", "b", [0.99, 0.1]), ("f", "c", [0.0, 1.0]), ("g", "a", [1.0, 0.0])], "f string, l string, v array<double>")
    merged = {(r.f, r.l): r.merged_into for r in vectors.merge_similar(vectors.centroids(df, ["f", "l"], "v"), ["f"], "l", 0.1).collect()}
    assert merged == {("f", "a"): "a", ("f", "b"): "a", ("f", "c"): "c", ("g", "a"): "a"}
    fit = {r.f: r.silhouette for r in vectors.silhouette(df.filter("l <> 'b'"), ["f"], "l", "v").collect()}
    assert fit["f"] == pytest.approx(1.0) and fit["g"] is None


def test_silhouette_of_all_members(spark):
    from talkgrid.plans import vectors as plans

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    d, fit = 1 - x @ x.T, []
    for i, own in enumerate(label):
        a = (d[i, label == own].sum() - d[i, i]) / max(1, (label == own).sum() - 1)
        b = min(d[i, label == other].mean() for other in set(label) if other != own)
        fit.append((b - a) / max(a, b))
    assert plans.speaker_silhouette(spark, "/root/testdata/sf0.001").first().silhouette == pytest.approx(np.mean(fit), abs=1e-6)
    few = spark.createDataFrame([("f", "a", [1.0, 0.0]), ("f", "a", [2.0, 0.0]), ("f", "b", [0.0, 1.0]), ("g", "a", [1.0, 0.0])], "f string, l string, v array<double>")
    got = {r.f: r.silhouette for r in vectors.mean_silhouette(few, ["f"], "l", "v").collect()}
    assert got["f"] == pytest.approx(2 / 3, abs=1e-6) and got["g"] is None


def test_active_speakers(spark):
    df = seg(spark, [("A", 0, 1000), ("B", 500, 2000), ("B", 600, 700), ("A", 3000, 3000), ("C", 4000, 5000)])
    got = sorted((r.s, r.e, r.speaker_id) for r in streams.active_speakers(df).collect())
    assert got == [(0, 600, "A"), (600, 700, "B"), (700, 1000, "A"), (1000, 2000, "B"), (4000, 5000, "C")]


def test_nearest_within(spark):
    from talkgrid.operators.intervals import nearest_within

    left = spark.createDataFrame([("f", 1, 100), ("f", 2, 5000), ("g", 3, 0), ("f", 4, None)], "k string, idx bigint, s bigint")
    right = spark.createDataFrame([("f", 10, 90), ("f", 11, 110), ("f", 12, 5751), ("g", 13, -750)], "k string, idx bigint, s bigint")
    assert sorted((r.idx, r.other, r.apart) for r in nearest_within(left, right, ["k"], 750).collect()) == [(1, 10, 10), (3, 13, 750)]


def test_views(spark):
    from talkgrid.sources import tables

    names = tables.register_views(spark, "/root/testdata/sf0.001")
    assert {"segments", "documents", "clean_segments", "clean_events"} <= set(names)
    assert spark.sql("SELECT count(*) FROM clean_segments WHERE s > e OR trim(speaker_id) = ''").first()[0] == 0


def test_model_slots(spark):
    from talkgrid.functions import slots

    df = spark.createDataFrame([(1, "good"), (2, None)], "id int, text string")
    assert slots.with_model(df, "scores", slots.default_text_emotion()).first().scores["neutral"] == 1.0
    r = {x.id: x.v for x in slots.with_model(df, "v", F.lit(0.0), lambda: lambda b: [None if t is None else float(len(t)) for t in b["text"]], ["text"]).collect()}
    assert r == {1: 4.0, 2: 0.0}
    assert slots.parse_durations("Speech=0.5, music: 1") == {"speech": 0.5, "music": 1.0} == slots.parse_durations('{"Speech": 0.5, "music": 1}')
    assert slots.parse_durations(None) == {}
    with pytest.raises(ValueError):
        slots.parse_durations("speech")
    assert df.select(slots.default_affect().alias("a"), slots.default_intent().alias("i"), slots.default_speech_emotion().alias("s")).first().a.arousal == 0.0
