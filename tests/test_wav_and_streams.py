import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.jobs import definitions, reports
from wavemill.operators import blocks, intervals, loudness
from wavemill.sources import tables, wav
from wavemill.streaming import live


@pytest.fixture
def two_tracks(spark):
    rng = np.random.default_rng(3)
    rows = [(t, c, i, i * 100, rng.uniform(-1, 1, 100 if i < 3 else 40).tolist()) for t in ("a", "b") for c in range(2) for i in range(4)]
    return spark.createDataFrame(rows, "track string, channel int, block_idx long, offset long, samples array<double>")


@pytest.mark.parametrize(("bits", "floating", "error"), [(16, False, 1.6 / 32767), (24, False, 1.6 / 8388607), (32, False, 1e-7), (32, True, 1e-7)])
def test_wav_round_trip(spark, two_tracks, tmp_path, bits, floating, error):
    spark.dataSource.register(wav.WavDataSource)
    assert {r.n_frames for r in wav.write(two_tracks, str(tmp_path), 8000, bits, floating).collect()} == {340}
    heads = spark.read.format("wav").option("mode", "header").load(str(tmp_path)).collect()
    assert {(r.track, r.sample_rate, r.n_channels, r.n_frames, r.bit_depth) for r in heads} == {("a", 8000, 2, 340, bits), ("b", 8000, 2, 340, bits)}
    back = spark.read.format("wav").option("blockFrames", 64).option("blocksPerPartition", 2).load(str(tmp_path))
    both = blocks.to_samples(back).join(blocks.to_samples(two_tracks).withColumnRenamed("value", "given"), ["track", "channel", "frame"])
    assert both.count() == 2 * 2 * 340 and both.agg(F.max(F.abs(F.col("value") - F.col("given")))).first()[0] <= error


@pytest.mark.parametrize(("bits", "floating"), [(16, False), (24, False), (32, True)])
def test_files_by_many_tasks_equal_those_of_one(spark, tmp_path, bits, floating):
    rng = np.random.default_rng(5)
    rows = [(t, c, i, i * 500, rng.uniform(-1, 1, 500 if i < last else 77).tolist()) for t, last in (("long", 120), ("in/two/folders", 3)) for c in range(2) for i in range(last + 1)]
    rows += [("long", 0, 999, 0, [])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, int(c), int(i), int(o), list(x)) for t, c, i, o, x in rows], "track string, channel int, block_idx long, offset long, samples array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r.track: r for r in wav.write_parallel(df, str(tmp_path / "many"), 8000, bits, floating).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out["long"].n_tasks > 1 and {t: r.n_frames for t, r in out.items()} == {"long": 60_077, "in/two/folders": 1_577}
    wav.write(df.filter(F.size("samples") > 0), str(tmp_path / "one"), 8000, bits, floating).collect()
    for track, r in out.items():
        with open(r.path, "rb") as many, open(tmp_path / "one" / f"{track}.wav", "rb") as one:
            assert many.read() == one.read()
    assert not [p for p in (tmp_path / "many").rglob(".*")]


def test_blocks_that_do_not_follow_one_another_are_errors(spark, tmp_path):
    form = "track string, channel int, block_idx long, offset long, samples array<double>"
    ten, start = [0.5] * 10, ("a", 0, 0, 0, [0.5] * 10)
    gap, lap, again, short = [start, ("a", 0, 1, 12, ten)], [start, ("a", 0, 1, 8, ten)], [start, start], [start, ("a", 0, 1, 10, ten), ("a", 1, 0, 0, ten)]
    both = [start, ("a", 0, 1, 5, ten), ("a", 0, 2, 20, ten)]  # an overlap as long as the gap
    for rows in (gap, lap, again, short, both):
        with pytest.raises(ValueError):
            wav.write_parallel(spark.createDataFrame(rows, form), str(tmp_path), 8000)
    with pytest.raises(Exception, match="not a file's name"):
        wav.write_parallel(spark.createDataFrame([("../a", *start[1:])], form), str(tmp_path), 8000)
    assert not list(tmp_path.rglob("*")) and wav.write_parallel(spark.createDataFrame([], form), str(tmp_path), 8000).count() == 0


def test_pcm_and_headers(tmp_path):
    assert wav.decode_pcm(b"\x00\x80\xff", 8, 1).tolist() == [-1, 0, 127 / 128]
    assert wav.decode_pcm(b"\x00\x80", 16, 1)[0] == -1 and wav.decode_pcm(b"\x00\x00\x80", 24, 1)[0] == -1 and wav.decode_pcm(b"\x00\x00\x00\x80", 32, 1)[0] == -1
    assert wav.decode_pcm(struct.pack("<d", 0.5), 64, 3)[0] == 0.5
    path = tmp_path / "bad.wav"
    for data in (b"nothing", b"RIFF\0\0\0\0WAVEdata\0\0\0\0"):
        path.write_bytes(data)
        with pytest.raises(ValueError), open(path, "rb") as file:
            wav.parse_header(file, str(path))
    assert wav.header(1 << 31, 2, 48000, 16, False)[:4] == b"RF64" and len(wav.header(1, 1, 1, 16, False)) == 80


def tone(spark, seconds, levels_db, rate=48000, hz=997.0, size=blocks.BLOCK):
    rows = []
    frame = np.arange(seconds * rate)
    x = np.concatenate([10 ** (db / 20) * np.sin(2 * np.pi * hz * frame / rate) for db in levels_db])
    for i in range(0, len(x), size):
        rows.append((1, 0, i // size, i, x[i : i + size].tolist()))
    return spark.createDataFrame(rows, "track long, channel int, block_idx long, offset long, samples array<double>")


def test_full_scale_tone_has_the_loudness_of_the_standard(spark):
    out = reports.loudness_report(tone(spark, 4, [0]), 48000).first()
    assert out.lufs == pytest.approx(-3.01, abs=0.1) and out.peak == pytest.approx(1, abs=1e-3) and 0.99 < out.true_peak < 1.02


def test_silence(spark):
    power = loudness.power(blocks.to_samples(tone(spark, 4, [-400])).withColumn("value", F.lit(0.0)))
    assert loudness.integrated(power, 48000).first().lufs == -math.inf
    assert loudness.short_term(power, 48000).first().lufs == pytest.approx(-100.691)
    assert loudness.loudness_range(loudness.short_term(power, 48000)).first().lra == 0


def test_results_do_not_depend_on_the_blocks(spark):
    df = blocks.to_samples(tone(spark, 1, [-3], rate=4000))
    outs = []
    for size in (64, 1000, 65_536):
        b = blocks.from_samples(df, size)
        y = [r.value for r in blocks.to_samples(blocks.zero_phase(b, blocks.K_WEIGHTING)).orderBy("frame").collect()]
        s = [r.value for r in blocks.to_samples(blocks.sliding_extreme(b, 31, False)).orderBy("frame").collect()]
        outs.append((y, s, blocks.true_peak(b).first().true_peak))
    for y, s, p in outs[1:]:
        assert np.allclose(y, outs[0][0], atol=1e-9) and s == outs[0][1] and p == pytest.approx(outs[0][2])
    same = blocks.to_samples(blocks.deinterleave(blocks.interleave(blocks.from_samples(df, 1000))))
    assert same.exceptAll(df).count() == 0


def test_streams_equal_tables(spark, sf_dir, tmp_path):
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = live.read(spark, sf_dir, "events.parquet", like).select(F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("kind"), "event_id")
    table = tables.live(spark, sf_dir)

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    for name, op in (("wave", lambda d: live.waveform(d, "1 hour")), ("gates", lambda d: live.gates(d, "2 hours", "30 minutes"))):
        got, expected = run(op(stream), name, "update"), op(table)
        assert got.count() == expected.count() and got.exceptAll(expected).count() == 0
    assert run(live.fine_histogram(stream, 0.5), "hist", "complete").exceptAll(live.fine_histogram(table, 0.5)).count() == 0
    rows = {}
    for r in table.orderBy("ts").collect():
        last = rows.setdefault(r.track, [])
        if not last or (r.value - last[-1][1] >= 1 and (r.ts - last[-1][0]).total_seconds() >= 60):
            last.append((r.ts, r.value))
    got = run(live.throttle(stream, 60, 1), "slow", "append").collect()
    assert sorted((r.track, r.ts, r.value) for r in got) == sorted((t, *x) for t, xs in rows.items() for x in xs)


def test_definitions(spark):
    nodes = spark.createDataFrame([("d", n) for n in "abcd"] + [("e", "x")], "definition string, node string")
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "a", "c"), ("d", "c", "b"), ("d", "c", "zz")], "definition string, source string, target string")
    assert [r.node for r in definitions.unknown_edges(nodes, edges).collect()] == ["zz"]
    assert {(r.definition, r.node) for r in definitions.roots(nodes, edges).collect()} == {("d", "a"), ("d", "d"), ("e", "x")}
    found = {("".join(r.path), r.cycle) for r in definitions.paths(nodes, edges).filter("definition = 'd'").collect()}
    assert {("a", False), ("ab", False), ("abc", False), ("abcb", True), ("ac", False), ("acb", False), ("acbc", True)} <= found
    df = spark.createDataFrame([("d", {"path": "{{in}}/{{ name }}.wav", "x": "1"})], "definition string, parameters map<string,string>")
    assert [r.name for r in definitions.placeholders(df).collect()] == ["in", "name"]
    out = definitions.substitute(df, {"in": "/a$1"}).first()
    assert out.parameters["path"] == "/a$1/{{ name }}.wav" and out.unbound == ["name"]
    with pytest.raises(ValueError):
        definitions.parse_options(["a=1", "a=2"])


def test_segments_published_cases(spark):
    seg = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 30, 31)], "track long, start_frame long, end_frame long")
    assert sorted((r.start_frame, r.end_frame) for r in intervals.merge(seg).collect()) == [(0, 20), (30, 31)]
    with pytest.raises(ValueError):
        intervals.hysteresis(seg, 0.001, 1, 1, 1)
