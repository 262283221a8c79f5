import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.functions import levels
from wavemill.jobs import definitions, reports, target
from wavemill.operators import blocks, design, intervals, lineage, samples, segments, spectra
from wavemill.sources import wav
from wavemill.streaming import live

SCHEMA = "track long, channel int, block_idx long, offset long, samples array<double>"


def made(spark, tracks, size=4096):
    rows = [(t, c, i, i * size, x[i * size : (i + 1) * size].tolist()) for (t, c), x in tracks.items() for i in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, SCHEMA)


def response(section, rate, frequency):
    (b, a), z = section, np.exp(-2j * np.pi * frequency / rate)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def values(df):
    return {k: np.array([r.value for r in sorted(g, key=lambda r: r.frame)]) for k, g in _by(blocks.to_samples(df).collect()).items()}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault((r.track, r.channel), []).append(r)
    return out


@pytest.mark.parametrize("rate", [44_100, 48_000, 96_000])
def test_k_weighting_at_any_rate(rate):
    shelf, high = design.k_weighting(rate)
    both = lambda f: 20 * math.log10(response(shelf, rate, f) * response(high, rate, f))
    at_48 = [20 * math.log10(response(design.K_48000[0], 48_000, f) * response(design.K_48000[1], 48_000, f)) for f in (30, 100, 997, 4000, 9000)]
    assert np.allclose([both(f) for f in (30, 100, 997, 4000, 9000)], at_48, atol=0.1)
    assert both(997) == pytest.approx(0.691, abs=0.06)


def test_passes_and_allpass():
    low, high = design.low_pass(48_000, 1000), design.high_pass(48_000, 1000)
    assert response(low, 48_000, 1000) == pytest.approx(math.sqrt(0.5), abs=1e-3) and response(high, 48_000, 1000) == pytest.approx(math.sqrt(0.5), abs=1e-3)
    assert response(low, 48_000, 10) == pytest.approx(1, abs=1e-3) and response(high, 48_000, 10) < 1e-3 and response(low, 48_000, 10_000) < 0.02
    assert all(response(design.allpass(a), 48_000, f) == pytest.approx(1) for a in (-90, 45, 90) for f in (10, 5000))
    assert design.smoothing(0, 48_000) == 1 and 0 < design.smoothing(1, 48_000) < design.smoothing(1, 48_000, True) < 1
    assert design.triangle(4) == [0.5, 1, 1, 0.5] and design.frames_of(0.001, 48_000) == 1 and design.delay_bound(48_000) == pytest.approx(23 / 25)
    assert design.forgetting(3) == 0.998 and design.suppression(2) == 10


def test_loudness_of_a_sine_at_each_tracks_rate(spark):
    rows = []
    for track, rate in ((1, 44_100), (2, 48_000)):
        x = 10 ** (-23 / 20) * math.sqrt(2) / math.sqrt(2) * np.sin(2 * np.pi * 997 * np.arange(2 * rate) / rate)
        rows += [(track, c, i, i * 8192, x[i * 8192 : (i + 1) * 8192].tolist(), rate) for c in range(2) for i in range(-(-len(x) // 8192))]
    df = lineage.settle(spark.createDataFrame(rows, SCHEMA + ", rate int"))
    got = {r.track: r.lufs for r in reports.integrated_loudness(df).collect()}
    assert got[1] == pytest.approx(-23, abs=0.06) and got[2] == pytest.approx(-23, abs=0.02)
    one = {r.track: r.lufs for r in reports.integrated_loudness(df, weights=(1.0, 0.0)).collect()}
    assert one[1] == pytest.approx(-23 - 3.01, abs=0.06)


def test_report_as_files(spark, tmp_path):
    df = made(spark, {(1, 0): np.full(500, 0.5), (2, 0): np.zeros(500)}, 128)
    report = reports.loudness_report(df, 100, 16, sections=design.K_48000)
    reports.write_report(report, str(tmp_path / "r"))
    rows = {r.track: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert rows[1].amplitude.buckets == [0] * 15 + [500] and rows[1].amplitude.bucketMax == 0.5 and rows[2].amplitude.totalSamples == 500
    long = blocks.to_samples(df)
    reports.write_waveform(samples.waveform(long, 50), str(tmp_path / "w"), 100, 50)
    assert spark.read.parquet(str(tmp_path / "w")).filter("track = 1 and resolution = 2").count() == 10
    reports.write_spectrogram(blocks.spectrogram(df, 64, 64), str(tmp_path / "s"), 100, 64, 64)
    assert dict(spark.read.parquet(str(tmp_path / "s")).dtypes)["bands"] == "array<float>"


def test_zero_phase_smooth_and_noise_shaping_over_block_edges(spark):
    rng = np.random.default_rng(5)
    x = {(1, 0): rng.standard_normal(700), (1, 1): rng.standard_normal(700), (2, 0): rng.standard_normal(64)}
    df = lineage.settle(made(spark, x, 64))
    share = design.smoothing(30, 100, True)
    for got, key in ((values(blocks.smooth(df, 30, 100, True)), k) for k in x):
        y, last = [], x[key][0]
        for v in x[key]:
            y.append(last := share * v + (1 - share) * last)
        z, last = [], y[-1]
        for v in y[::-1]:
            z.append(last := share * v + (1 - share) * last)
        assert np.allclose(got[key], z[::-1])
    shaped = values(blocks.shape_noise(df, 4))
    for key, v in x.items():
        q = np.floor(np.cumsum(v) * 8 + 0.5) / 8
        assert np.allclose(shaped[key], np.diff(q, prepend=0))


def test_dither_is_repeatable_and_on_the_grid(spark):
    df = spark.range(500).select(F.lit(1).alias("track"), F.lit(0).alias("channel"), F.col("id").alias("frame"), (F.sin("id") / 2).alias("value"))
    a, b = (samples.dither(df, 16).orderBy("frame").collect() for _ in range(2))
    assert a == b and all((r.value * 32768).is_integer() for r in a)
    plain = np.sin(np.arange(500)) / 2
    assert np.abs(np.array([r.value for r in a]) - plain).max() < 2 / 32768 and np.ptp(np.array([r.value for r in a]) - plain) > 1.5 / 32768


def test_rows_of_many_tracks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_TRACKS", 1)
    df = spark.range(1000).select((F.col("id") % 3).alias("track"), F.lit(0).alias("channel"), F.col("id").alias("frame"), F.lit(0.5).alias("value"))
    out = samples.normalize(df)
    assert out.columns == df.columns and out.count() == 1000 and {r.value for r in out.collect()} == {1.0}
    some = samples.track_gain(df, spark.createDataFrame([(0, 2.0)], "track long, factor double"))
    assert {(r.track, r.value) for r in some.collect()} == {(0, 1.0), (1, 0.5), (2, 0.5)}


def test_band_edges_cover_the_range():
    for scale in spectra.SCALES:
        edges = spectra.band_edges(scale, 16, 50, 7000, 16_000, 512)
        assert all(0 <= a <= b <= 256 and 0 <= v <= 1 and 0 <= w <= 1 for a, b, v, w in edges)
        assert all(b[0] <= a[1] for a, b in zip(edges, edges[1:])) and edges[0][0] == 1 and edges[-1][1] in (224, 225)


def test_segments_give_back_what_went_in(spark):
    x = {(1, 0): np.random.default_rng(1).standard_normal(250), (2, 0): np.ones(5)}
    df = made(spark, x, 64)
    assert all(np.allclose(got, x[k]) for k, got in values(segments.on_segments(df, lambda s: s, 16, 4)).items())
    sums = segments.aggregate(df, lambda s: (np.abs(s).max(),), ("top",), "max").collect()
    assert {r.track: r.top for r in sums}[1] == np.abs(x[1, 0]).max()
    scored = segments.scores(df, lambda s: s.sum(), 32, 8).collect()
    assert {(r.track, r.w) for r in scored} == {(1, w) for w in range(8)} | {(2, 0)}


def test_loudness_target_is_met(spark):
    rate, rng = 4000, np.random.default_rng(42)
    t = np.arange(8 * rate) / rate
    speech = lambda level: level * (np.sin(2 * np.pi * 220 * t) + 0.3 * np.sin(2 * np.pi * 880 * t) + 0.3 * rng.uniform(-1, 1, len(t))) * (0.4 + 0.6 * (np.sin(2 * np.pi * 0.5 * t) > 0))
    df = lineage.settle(made(spark, {(1, 0): speech(0.03), (2, 0): speech(0.3), (3, 0): np.zeros(len(t))}))
    out, done = target.loudness_target(df, rate, -20.0, -1.0, smoothing_ms=5.0, most_attempts=6, never_expand=True)
    rows = {r.track: r for r in done.collect()}
    assert set(rows) == {1, 2}
    measured = {r.track: r for r in reports.loudness_report(lineage.settle(out), rate).collect()}
    for track, r in rows.items():
        assert r.converged and measured[track].lufs == pytest.approx(r.lufs, abs=1e-6) and -20.5 < r.lufs <= -20.0
        assert 20 * math.log10(measured[track].true_peak) <= -0.99
    assert measured[3].lufs == float("-inf") and out.count() == df.count()


def test_predicted_boost():
    counts = np.zeros(1024)
    counts[512] = 1000
    rows = pd.DataFrame({"lufs": [-30.0] * 3, "counts": [counts] * 3, "bucket_max": [1.0] * 3, "floor": [None, -50.0, None], "pivot": [-3.0] * 3, "limit_db": [0.0] * 3, "peak_cap": [5.0] * 3})
    # all values lie under the pivot, at -6 dB: the second track's ramp reaches them with less than its boost
    level = 20 * np.log10(512.5 / 1024)
    assert target.predicted(rows, np.full(3, 5.0), np.full(3, 5.0)) == pytest.approx([-25, -30 + 5 * (level + 50) / 47, -25])
    found = target.solve_boosts(rows, np.array([-25.0, -25.0, 50.0]), 0.5, False)
    assert found == pytest.approx([5.0, 5 * 47 / (level + 50), target.HIGHEST], abs=0.01) and found[2] == target.HIGHEST
    silent = rows.assign(bucket_max=0.0)
    assert (target.predicted(silent, np.zeros(3), np.zeros(3)) == -np.inf).all()


def test_wav_channels_and_same_names(spark, tmp_path):
    spark.dataSource.register(wav.WavDataSource)
    for folder, level in (("a", 0.25), ("b", 0.5)):
        df = spark.createDataFrame([("x", c, 0, 0, [level * (c + 1)] * 10) for c in range(2)], "track string, channel int, block_idx long, offset long, samples array<double>")
        wav.write(df, str(tmp_path / folder), 8000, 32, True).collect()
    back = spark.read.format("wav").option("channels", "1,5,0").load(str(tmp_path / "*" / "x.wav"))
    assert {(r.track, r.channel, r.samples[0], len(r.samples)) for r in back.collect()} == {(t, c, v, 10) for t, k in (("a/x", 0.25), ("b/x", 0.5)) for c, v in ((0, 2 * k), (1, 0), (2, k))}


def test_definitions_from_files(spark, tmp_path):
    good = {"definition": "d", "apiVersion": 1, "nodes": [{"node": "in", "operator": "gain", "parameters": {"db": "{{loud}}"}}, {"node": "out", "operator": "invert"}], "edges": [{"source": "in", "target": "out"}]}
    bad = [good | {"apiVersion": 2}, good | {"edges": [{"source": "in", "target": "no"}]}, good | {"nodes": []}, good | {"nodes": good["nodes"] * 2}]
    for i, one in enumerate([good, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(one))
    (tmp_path / "9.json").write_text("{")
    rows = definitions.load(spark, str(tmp_path)).collect()
    assert sorted(str(r.problem) for r in rows) == sorted(["None", "unknown version", "an edge to no node", "no nodes", "a node's name twice", "no JSON of this form"])
    one = next(r for r in rows if r.problem is None).asDict(recursive=True)
    known = {"gain": samples.gain, "invert": samples.invert}
    df = spark.createDataFrame([(1, 0, 0, 0.5)], "track long, channel int, frame long, value double")
    assert definitions.pipeline(known, one, {"loud": "20"})(df).first().value == pytest.approx(-5)
    for given in ({}, {"loud": "1", "more": "2"}):
        with pytest.raises(ValueError, match="parameters"):
            definitions.pipeline(known, one, given)
    with pytest.raises(ValueError, match="no such operator"):
        definitions.pipeline({}, one, {"loud": "1"})
    nodes = spark.createDataFrame([("d", n) for n in "abc"], "definition string, node string")
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "b")], "definition string, source string, target string")
    found = {("".join(r.path), r.cycle) for r in definitions.paths(nodes, edges).collect()}
    assert found == {("a", False), ("ab", False), ("abc", False), ("abcb", True)}


def test_levels_and_streams(spark):
    row = spark.range(1).select(levels.db_to_linear(-20.0).alias("a"), levels.db_to_linear(F.lit(float("-inf"))).alias("b")).first()
    assert row.a == pytest.approx(0.1) and row.b == 0
    events = spark.sql("select 1 as track, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) as ts, 1.0D as value from values (0), (0), (20), (100) t(s)")
    got = live.sessions(live.unrepeated(events, ["track", "ts"]), "30 seconds").orderBy("start").collect()
    assert [r.n for r in got] == [2, 1]


def test_filter_on_a_stream_equals_the_table(spark, tmp_path):
    x = np.random.default_rng(9).standard_normal(300)
    df = made(spark, {(1, 0): x}, 100).drop("block_idx").orderBy("offset")
    for i in range(3):
        df.filter(F.col("offset") == 100 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.read(spark, str(tmp_path / "in"), "*.parquet", df)
    low = design.low_pass(100, 10)
    query = live.lti_filter(stream, [low]).writeStream.format("memory").queryName("filtered").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = np.concatenate([r.samples for r in spark.table("filtered").orderBy("offset").collect()])
    assert np.allclose(got, values(blocks.lti_filter(made(spark, {(1, 0): x}, 100), [low]))[1, 0])


def streamed(spark, tmp_path, df, parts, by, op):
    """The rows of df in `parts` files, one batch each, through op."""
    for i, part in enumerate(parts):
        df.filter(part).orderBy(by).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = op(stream).writeStream.format("memory").queryName("out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    return spark.table("out").collect()


def test_segments_close_on_a_stream_as_in_the_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(t, w, float(np.clip(0.5 + 0.4 * math.sin(w / 7 + t) + rng.normal(0, 0.1), 0, 1)), w == 119) for t in (1, 2) for w in range(120)]
    df = spark.createDataFrame(rows, "track long, w long, p double, last boolean")
    got = streamed(spark, tmp_path, df, ["w < 50", "w >= 50 and w < 51", "w >= 51"], "w", lambda s: live.hysteresis(s, 0.6, 10, 30, 20))
    expected = intervals.hysteresis(df.select("track", "w", "p"), 0.6, 10, 30, 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) > 4


def test_cut_blocks_close_up_on_a_stream(spark, tmp_path):
    keep = [i % 7 != 0 and i % 5 != 1 for i in range(90)]
    rows = [(1, 0, 30 * b, [float(i) for i in range(30 * b, 30 * b + 30)], keep[30 * b : 30 * b + 30]) for b in range(3)]
    df = spark.createDataFrame(rows, "track long, channel int, offset long, samples array<double>, kept array<boolean>")
    got = streamed(spark, tmp_path, df, ["offset < 30", "offset >= 30"], "offset", live.closed_up)
    flat = {r.offset + i: x for r in got for i, x in enumerate(r.samples)}
    assert [flat[i] for i in range(len(flat))] == [float(i) for i in range(90) if keep[i]]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_takes_blocks_of_one_length_side_by_side():
    """before, each block was a batch and a channel's states a group of their own."""
    machine, x = blocks.Filter(design.K_48000), np.random.default_rng(5).normal(size=(700, 9))
    y, state = machine.run(x, np.zeros((4, 9)))
    for k in range(9):
        alone, end = machine.run(x[:, k], np.zeros(4))
        assert np.allclose(y[:, k], alone, atol=1e-12) and np.allclose(state[:, k], end, atol=1e-12)


def test_states_are_carried_without_a_group_for_each_channel(spark):
    """F8: the loudness that a normalisation needs, with ragged and empty blocks."""
    x = np.random.default_rng(6).normal(size=1000)
    rows = [(t, 0, i, a, x[a:b].tolist()) for t in range(3) for i, (a, b) in enumerate(((0, 300), (300, 301), (301, 301), (301, 700), (700, 1000)))]
    out = blocks.lti_filter(spark.createDataFrame(rows, SCHEMA), [design.low_pass(48_000, 900)])
    assert "FlatMapGroups" not in _plan(out)
    want = blocks.Filter([design.low_pass(48_000, 900)]).run(x, np.zeros(2))[0]
    assert all(np.allclose(v, want) for v in values(out).values())


def test_settled_filter_begins_at_the_first_value(spark):
    """smoothing without a pass over the data for the first values."""
    x = np.random.default_rng(7).normal(size=500) + 3
    got = values(blocks.lti_filter(made(spark, {(1, 0): x, (2, 1): x[::-1]}, 64), [design.one_pole(0.1)], settled=True))
    for key, v in (((1, 0), x), ((2, 1), x[::-1])):
        y, want = v[0], []
        for value in v:
            y += 0.1 * (value - y)
            want.append(y)
        assert np.allclose(got[key], want)


def test_backward_filter_is_the_reversed_one(spark):
    """the way back without turning the blocks round."""
    x = np.random.default_rng(8).normal(size=500)
    low = [design.low_pass(48_000, 2000)]
    back = values(blocks.lti_filter(made(spark, {(1, 0): x}, 64), low, backward=True))[1, 0]
    assert np.allclose(back, blocks.Filter(low).run(x[::-1], np.zeros(2))[0][::-1])


def test_held_magnitudes_of_channels_of_other_lengths(spark):
    """the frames of a longer channel count wherever the shorter one stands."""
    x = np.sin(np.arange(200.0))
    got = [values(blocks.held_magnitudes(made(spark, {(1, c): x[:n] for c, n in enumerate(lengths)}, 64), 2))[1, 0] for lengths in ((200, 150), (150, 200))]
    assert len(got[0]) == len(got[1]) == 200 and np.allclose(*got)


def test_amplitude_looks_no_bucket_up_in_a_map(spark):
    """1024 look-ups, each through all of a track's buckets."""
    hist = spark.createDataFrame([(1, 0, 5, 1.0), (1, 3, 7, 1.0), (2, 2, 1, 0.5)], "track long, bucket int, n long, bucket_max double")
    out = reports.amplitude(hist, 4)
    assert "map_from_entries" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1.0, [5, 0, 0, 7], 12), (2, 0.5, [0, 0, 1, 0], 1)]


def test_inverse_transform_without_a_group_for_each_block(spark):
    """frames are made and added up many at a time."""
    x = np.random.default_rng(9).normal(size=1000)
    out = blocks.istft(blocks.stft(made(spark, {(1, 0): x, (2, 0): -x}, 64), 64, 16), 64, 16, 100)
    assert "FlatMapGroups" not in _plan(out)
    got = values(out)
    assert np.allclose(got[1, 0][64:900], x[64:900]) and np.allclose(got[2, 0], -got[1, 0])


def test_segments_over_edges_and_folds_without_groups(spark):
    """No sums of samples are shuffled, no group is a batch of its own."""
    x = np.random.default_rng(10).normal(size=333)
    out = segments.on_segments(made(spark, {(1, 0): x}, 32), lambda s: s - s.mean(), 16, 8)
    whole, sums, weight, w = np.concatenate([x, np.zeros(16)]), np.zeros(349), np.zeros(349), np.array(design.triangle(16))
    for k in range(0, 333, 8):
        sums[k : k + 16] += w * (whole[k : k + 16] - whole[k : k + 16].mean())
        weight[k : k + 16] += w
    assert "collect_list" not in _plan(out) and np.allclose(values(out)[1, 0], (sums / weight)[:333])
    ends = segments.fold(made(spark, {(1, 0): x, (1, 1): x[:20]}, 32), lambda s: (s[0], s[-1]), lambda a, b: np.array([a[0], b[1]]), 4)
    assert "FlatMapGroups" not in _plan(ends)
    assert {r.channel: r.state for r in ends.collect()} == {0: [x[0], x[-1]], 1: [x[0], x[19]]}


def test_gate_keeps_one_row_for_each_frame(spark):
    """frames met all segments of 4,096 frames as rows; now as an array, so there is no sum over frames."""
    df = spark.createDataFrame([(1, 0, f, 1.0) for f in range(200)] + [(2, 0, 0, 1.0)], "track long, channel int, frame long, value double")
    out = intervals.gate(df, spark.createDataFrame([(1, 50, 60), (1, 63, 130)], "track long, start_frame long, end_frame long"), 0.25, 4, 8)
    got = {(r.track, r.frame): r.value for r in out.collect()}
    assert len(got) == 201 and got[1, 46] == 0.25 and got[1, 50] == got[1, 129] == 1 and 0.25 < got[1, 61] < 1 and got[1, 180] == got[2, 0] == 0.25
    assert "max(g" not in _plan(out)


def test_more_lines_are_more_tasks_not_larger_ones(spark, sf_dir, monkeypatch):
    """tracks are dealt by the table's size."""
    from wavemill.sources import tables

    monkeypatch.setattr(tables, "LINES", 100)
    assert tables.scores(spark, sf_dir).rdd.getNumPartitions() == -(-tables.read(spark, sf_dir, "lineitem").count() // 100)


@pytest.mark.parametrize("batch", [37, 10_000])
def test_blocks_are_cut_from_sorted_rows(spark, sf_dir, batch):
    """before, every block was a list of rows collected and sorted by itself."""
    from wavemill.sources import tables

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df, ordered = tables.signal(spark, sf_dir), lambda df: sorted(map(tuple, df.collect()))
        direct, general = tables.signal_blocks(spark, sf_dir, 100), blocks.from_samples(df, 100)
        assert "collect_list" not in _plan(direct) + _plan(general)
        assert ordered(direct) == ordered(general) and ordered(blocks.to_samples(general)) == ordered(df.select("track", "channel", "frame", "value"))
        odd = spark.createDataFrame([(None, 5, 1.0), (None, 2, None), ("x", 1, 3.0)], "track string, k int, a double")
        assert sorted(blocks.from_rows(odd.repartition(1), ("k",), ("a",), 2).collect(), key=lambda r: str(r.track)) == [(None, 0, 0, 0, [None, 1.0]), ("x", 0, 0, 0, [3.0])]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [5, 10_000])
def test_short_channels_go_through_a_filter_in_one_pass(spark, monkeypatch, batch):
    """Before, every block met its state in a join, also where a channel is a few blocks."""
    rng = np.random.default_rng(11)
    x = {(1, 0): rng.normal(size=450) + 2, (1, 1): rng.normal(size=130), (2, 0): rng.normal(size=70), (3, 0): rng.normal(size=5)}
    low, df = [design.low_pass(100, 9)], lineage.settle(made(spark, x, 10))
    assert "Join" not in _plan(blocks.lti_filter(df.filter("track > 1"), low))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for span in (16, 3):
            monkeypatch.setattr(blocks, "SPAN", span)
            for backward, settled in ((False, False), (False, True), (True, False), (True, True)):
                got = values(blocks.lti_filter(df, low, backward, settled))
                for key, v in x.items():
                    v, machine = v[::-1] if backward else v, blocks.Filter(low)
                    want = machine.run(v, machine.settled() * v[0] if settled else np.zeros(2))[0]
                    assert np.allclose(got[key], want[::-1] if backward else want), (span, backward, settled, key)
        first = spark.createDataFrame([(1, 0, i, 0 if i < 4 else (i - 4) * 2, [] if i < 4 else [1.0, 1.0]) for i in range(9)], SCHEMA)
        assert np.allclose(values(blocks.lti_filter(first, [design.one_pole(0.1)], settled=True))[1, 0], 1.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_references_meet_targets_without_a_task_for_each(spark):
    """a target's frames were dealt by target alone, so a long one went to one task."""
    frames = spark.createDataFrame([(t, 0, f, [1.0 * t], [0.0]) for t in range(2) for f in range(3 - t)], "track long, channel int, stft_frame long, re array<double>, im array<double>")
    session = spark.createDataFrame([(7, 0, "target"), (7, 1, "reference")], "session long, track long, role string")
    out = spectra.with_references(frames, session)
    assert "hashpartitioning(target" not in _plan(out)
    assert sorted((r.target, r.reference, r.stft_frame, r.ref_re) for r in out.collect()) == [(0, 1, 0, [1.0]), (0, 1, 1, [1.0]), (0, 1, 2, [0.0])]


def test_round_trip_is_made_once(spark, sf_dir):
    """the ends and the rows each went through both transforms, with all their Python workers."""
    from wavemill.jobs import queries

    assert "MapInArrow" not in _plan(queries.spectral_round_trip(spark, sf_dir))


def test_dealt_blocks_meet_the_filter_without_a_shuffle(spark, monkeypatch):
    """F8: every sample was shuffled twice, by track and by span, and left a row for each gate of both spans."""
    rng = np.random.default_rng(3)
    x = {(1, 0): rng.normal(size=333), (1, 1): rng.normal(size=120), (2, 0): np.zeros(70), (3, 1): rng.normal(size=45)}
    shuffled = made(spark, x, 10)
    df = lineage.settle(shuffled.repartition(3, "track").sortWithinPartitions("block_idx"))
    low, spans = [design.low_pass(100, 9)], ((0.4, 0.1), (3.0, 0.1))

    def sums(df, dealt):
        return {(r.track, r.span, r.gate): r.power for r in blocks.gated_sums(df, low, spans, 100, (1.0, 0.5), dealt).collect()}

    want = {}
    for (track, channel), v in x.items():
        y = blocks.Filter(low).run(v, np.zeros(2))[0] ** 2 * (1.0, 0.5)[channel]
        for k, size in enumerate((40, 300)):
            for gate in range((len(v) - 1) // 10 + 1):
                want[track, k, gate] = want.get((track, k, gate), 0) + y[gate * 10 : gate * 10 + size].sum()
    for span in (64, 3):
        monkeypatch.setattr(blocks, "SPAN", span)
        for got in (sums(shuffled, False), sums(df, True)):
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    monkeypatch.setattr(blocks, "SPAN", 64)
    plan = _plan(blocks.gated_sums(df, low, spans, 100, None, True))
    assert "hashpartitioning(track" in plan and "_span" not in plan.split("Exchange", 1)[1].split("MapInArrow")[0]
    assert plan.count("Exchange") == 1


def test_one_span_of_gates_for_integrated_loudness(spark, monkeypatch):
    """F8: the gates of three seconds were summed as well, three of four rows that left the filter."""
    asked, whole = [], blocks.gated_sums
    monkeypatch.setattr(blocks, "gated_sums", lambda df, sections, spans, *more: asked.append(tuple(spans)) or whole(df, sections, spans, *more))
    df = made(spark, {(1, 0): np.full(500, 0.5), (2, 0): np.zeros(500), (3, 0): np.ones(30)}, 128)
    got = {r.track: r.lufs for r in reports.integrated_loudness(df, 100, sections=design.K_48000).collect()}
    assert asked == [((0.4, 0.1),)] and math.isfinite(got[1]) and got[2] == got[3] == -math.inf


def test_lines_are_sorted_by_one_number_where_it_fits(spark, tmp_path):
    """Rows of six keys were compared."""
    from wavemill.sources import tables

    far = 1 << 40
    for k, (suppliers, orders) in enumerate((((-5, 7, 8), (-3, 0, 9)), ((0, far, 2 * far), (-far, 0, far)), ((None, 7, None), (1, 2, 3)), ((1, 2), (None, 4)))):
        rows = [(s, o, line, 1, float(1 + (7 * line + 3 * i + j) % 50), 0.01 * (line % 10), 1.0) for i, s in enumerate(suppliers) for j, o in enumerate(orders) for line in range(1, 8)]
        spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        out = tables.signal_blocks(spark, f"{tmp_path}/{k}", 4)
        assert ("_packed" in _plan(out)) == (k == 0)
        want = tables.signal(spark, f"{tmp_path}/{k}")
        ordered = lambda df: sorted(map(str, df.select("track", "channel", "frame", "value").collect()))
        assert ordered(blocks.to_samples(out)) == ordered(want)


def test_digits_are_those_of_round(spark):
    values = [0.1234565, -0.1234564, 1 / 64, -37 / 64, -1e-9, 0.0, 123.4567891, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(levels.digits(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    rows = df.collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows] and "-0.0" not in [str(r.a) for r in rows]
