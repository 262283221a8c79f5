"""Registered queries of filters, spectra, reports and the loudness target, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import blocks, design, lattice, loudness, samples, segments, spectra
from ..operators.design import Section
from ..operators.intervals import splice
from ..sources import tables
from ..sources.tables import RATE
from ..streaming import live
from . import queries, target
from .queries import SIG, Query, gate_sql

#: The signal, written once for recursive queries.
SRC = SIG + ", src as materialized (select track, channel, frame, cast(value as double) as value from sig)"


def iir(name: str, source: str, section: Section, other: Section | None = None, seeded: bool = False) -> str:
    """A recursive section over (track, channel, frame, value); `other` for tracks of odd numbers. seeded: the
    output before the first frame is its value."""
    (b0, b1, b2), (_, a1, a2) = section
    if other is None:
        k = [repr(float(x)) for x in (b0, b1, b2, a1, a2)]
    else:
        (c0, c1, c2), (_, d1, d2) = other
        k = [f"case when f.track % 2 = 1 then {y!r} else {x!r} end" for x, y in zip((b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2))]
    first = f"select track, channel, -1::bigint, 0.0::double, 0.0::double, {'value' if seeded else '0.0::double'}, 0.0::double from {source} where frame = 0"
    return f"""{name}_r(track, channel, frame, x1, x2, y1, y2) as ({first}
union all select f.track, f.channel, s.frame, s.value, f.x1, ({k[0]}) * s.value + ({k[1]}) * f.x1 + ({k[2]}) * f.x2 - ({k[3]}) * f.y1 - ({k[4]}) * f.y2, f.y1 from {name}_r f join {source} s on s.track = f.track and s.channel = f.channel and s.frame = f.frame + 1),
{name} as materialized (select track, channel, frame, y1 as value from {name}_r where frame >= 0)"""


def back(name: str, source: str) -> str:
    return f"{name} as materialized (select track, channel, max(frame) over (partition by track, channel) - frame as frame, value from {source})"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _blocks(op: Callable[[DataFrame], DataFrame], size: int = 100, digits: int = 6) -> Query:
    return lambda spark, sf_dir: _rounded(blocks.to_samples(op(queries.in_blocks(spark, sf_dir, size))), digits)


def _samples(op: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: _rounded(op(tables.signal(spark, sf_dir)), digits)


MEL = spectra.band_edges("mel", 8, 200, 8000, 16000, 64)


def spectrogram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight mel bands, as if the signal had a rate of 16 kHz; a row for each band."""
    out = spectra.to_bands(blocks.spectrogram(tables.blocks(spark, sf_dir), 64, 16), MEL)
    return _rounded(out.select("track", "channel", "stft_frame", F.posexplode("bands").alias("band", "magnitude")), 5)


def true_peak_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(blocks.true_peak_position(queries.in_blocks(spark, sf_dir, 128)))


def limit_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plain histogram; the pivot is a level for each track."""
    df = tables.signal(spark, sf_dir)
    pivots = df.groupBy("track").agg((-20.0 + F.pmod(F.first("track"), F.lit(3))).alias("pivot"))
    return _rounded(target.limit_level(samples.histogram(df, 64), pivots, 0.9, 64))


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the attempts at a target."""
    order = F.col("o_orderkey")
    rows = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), order.alias("attempt"), (-16.0 + (order % 21 - 10) / 4).alias("lufs"), (-1.0 + (order * 7 % 13 - 6) / 8).alias("true_peak_db"))
    return target.best_attempt(rows, -16.0, F.lit(-1.0))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.stft(blocks.settle(tables.blocks(spark, sf_dir)), 16, 16)


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track of an even number as target, with the next one as its reference."""
    frames = blocks.settle(_spectra(spark, sf_dir))
    tracks = frames.select("track").distinct()
    session = tracks.select((F.col("track") - F.col("track") % 2).alias("session"), "track", F.when(F.col("track") % 2 == 0, "target").otherwise("reference").alias("role"))
    found = spectra.transfer(spectra.with_references(frames, session))
    return _rounded(found, 5).withColumns({c: F.col(c) + 0.0 for c in ("h_re", "h_im")})


def degenerate_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of numbers as transfer functions, some of them broken."""
    rows = tables.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("session"), F.col("l_suppkey").alias("target"), F.lit(0).alias("reference"), F.col("l_quantity"), F.col("l_discount"))
    h_re = F.when(F.col("session") == 1, float("nan")).when(F.col("session") == 2, float("inf")).when(F.col("session") == 3, 0.0).when((F.col("session") == 4) & (F.col("l_quantity") < 48), 1e-9).otherwise(F.col("l_quantity"))
    return spectra.degenerate(rows.select("session", "target", "reference", h_re.cast("double").alias("h_re"), F.lit(0.0).alias("h_im")))


def crest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(queries.in_blocks(spark, sf_dir, 64).select("track", "channel", "block_idx", spectra.crest_score(F.col("samples")).alias("score")))


def low_crest_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase and group delay for the magnitudes of each block's first frame."""
    frames = _spectra(spark, sf_dir).select("track", "stft_frame", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)).alias("m"))
    phase = frames.select("track", "stft_frame", spectra.relative_power(F.col("m")).alias("power"), spectra.schroeder_phase(F.col("m")).alias("phase"))
    both = phase.withColumn("delay", spectra.group_delay(F.col("phase"), 0.5))
    return _rounded(both.select("track", "stft_frame", F.posexplode(F.arrays_zip("power", "phase", "delay")).alias("bin", "x")).select("track", "stft_frame", "bin", "x.*"), 5).withColumn("phase", F.col("phase") + 0.0)


def segment_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that takes a segment's mean off, on overlapping segments."""
    out = segments.on_segments(queries.in_blocks(spark, sf_dir, 32), lambda x: x - x.mean(), 16, 8)
    return _rounded(blocks.to_samples(out))


def score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that sums squares, on runs of 16 with the 4 before."""
    return _rounded(segments.scores(queries.in_blocks(spark, sf_dir, 64), lambda x: float(x @ x), 16, 4))


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure, then apply: each track less its mean."""
    df = queries.in_blocks(spark, sf_dir, 64)
    out = segments.measure_apply(df, lambda x: (x.sum(), len(x)), ("total", "n"), lambda x, m: x - m[0] / m[1])
    return _rounded(blocks.to_samples(out), 10)  # means lie on halves of the sixth digit


def largest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate whose merge depends on the order: first and last value, and the largest step between neighbours."""
    partial = lambda x: (x[0], x[-1], np.abs(np.diff(x)).max(initial=0.0))
    merge = lambda a, b: np.array([a[0], b[1], max(a[2], b[2], abs(b[0] - a[1]))])
    out = segments.fold(queries.in_blocks(spark, sf_dir, 32), partial, merge, 4)
    return out.select("track", "channel", *[F.get("state", F.lit(i)).alias(c) for i, c in enumerate(("first", "last", "step"))])


def varying_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sections whose coefficients wander, some of them to their bounds; the last rows end before the track."""
    df = tables.signal(spark, sf_dir)
    rows = df.groupBy("track").agg(F.max("frame").alias("last")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 20))).alias("row"))
    k = [((F.col("row") * 7 + F.col("track") + 5 * s) % 19 - 9) / 10.0 for s in range(3)]
    out = lattice.apply(blocks.from_samples(df, 100), rows.select("track", "row", F.array(*k).alias("k")), 16, 3, 1.2)
    return _rounded(blocks.to_samples(out), 9).withColumn("value", F.col("value") + 0.0)


def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.blocks(spark, sf_dir).select("track", "block_idx", spectra.mirrored(F.col("samples"), 3, 2).alias("s"))
    return out.select("track", "block_idx", F.posexplode("s").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


def frequency_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as frequencies, on each scale and back."""
    f = F.col("o_totalprice").cast("double")
    out = tables.read(spark, sf_dir, "orders").select("o_orderkey", levels.hertz_to_mel(f).alias("mel"), levels.hertz_to_erb(f).alias("erb"), F.log(f).alias("log"))
    out = out.withColumn("back_mel", levels.mel_to_hertz(F.col("mel"))).withColumn("back_erb", levels.erb_to_hertz(F.col("erb"))).withColumn("back_log", F.exp("log"))
    return _rounded(out, 4)


def loudness_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of 48 kHz, gates of the nominal rate; what was done for each track."""
    df = queries.in_blocks(spark, sf_dir, 256)
    return _rounded(target.loudness_target(df, RATE, -9.0, smoothing_ms=20.0, never_expand=True, most_attempts=2, sections=design.K_48000)[1])


def source_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of the loudness target without their histogram."""
    out = target.measure_source(queries.in_blocks(spark, sf_dir, 128), RATE, 3, 0.9, design.K_48000)
    return _rounded(out.drop("counts"))


QUERIES: dict[str, Query] = {
    "low_pass": _blocks(lambda df: blocks.lti_filter(df, [design.low_pass(RATE, 12.0)])),
    "band_pass": _blocks(lambda df: blocks.band_pass(df, RATE, 4.0, 20.0), 200),
    "smooth": _blocks(lambda df: blocks.smooth(df, 50.0, RATE)),
    "smooth_both_ways": lambda spark, sf_dir: _blocks(lambda df: blocks.smooth(df, 50.0, RATE, both_ways=True))(spark, sf_dir).withColumn("value", F.col("value") + 0.0),
    "rotate_phase": _blocks(lambda df: blocks.rotate_phase(df, 90.0)),
    "detection_envelope": _blocks(lambda df: blocks.detection(df, 3), 128),
    "spectrogram_bands": spectrogram_bands,
    "true_peak_position": true_peak_position,
    "limit_level": limit_level,
    "best_attempt": best_attempt,
    "source_measures": source_measures,
    "loudness_target": loudness_target,
    "transfer": transfer,
    "degenerate_transfers": degenerate_transfers,
    "crest_scores": crest_scores,
    "low_crest_phase": low_crest_phase,
    "segment_model": segment_model,
    "score_model": score_model,
    "centred": centred,
    "largest_step": largest_step,
    "varying_lattice": varying_lattice,
    "mirrored": mirrored,
    "frequency_scales": frequency_scales,
    "channel_sum": _samples(samples.channel_sum),
    "windows_padded": _samples(lambda df: samples.windows(df, 40, 15, padded=True)),
    "splice_channels": _samples(lambda df: splice(df, df.filter("frame < 30"), 50, {0: 1}, RATE, RATE)),
    "momentary_loudness": _samples(lambda df: loudness.momentary(loudness.power(df), RATE)),
    "live_sessions": queries._live(lambda df: live.sessions(df, "45 minutes")),
}

_K48, _K44 = design.K_48000, design.k_weighting(44100)
_LOUD = f"""{SRC}, {iir('k1', 'src', _K48[0])}, {iir('k2', 'k1', _K48[1])}, pow as materialized (select track, frame, sum(value * value) as power from k2 group by 1, 2), len as (select track, max(frame) + 1 as n from pow group by 1)"""
_INTEGRATED = """a as (select *, avg(power) filter (power > pow(10, (-70 + 0.691) / 10)) over (partition by track) / 10 as least_ from gates), b as (select track, avg(power) as power from a where power > pow(10, (-70 + 0.691) / 10) and power > least_ group by 1),
lufs as (select track, case when coalesce(power, 0) > 0 then -0.691 + 10 * log10(power) else '-inf'::double end as lufs from len left join b using (track))"""
_TAIL = "tail as (select * from pow union all select track, n + unnest(generate_series(0, 149)), 0.0 from len)"
_RANGE = """short as (select track, gate, -0.691 + 10 * log10(greatest(power, 1e-10)) as lufs from shorts), over70 as (select * from short where lufs >= -70),
rel as (select track, 10 * log10(avg(pow(10, lufs / 10))) - 20 as least_ from over70 group by 1), good as (select o.* from over70 o join rel using (track) where lufs >= least_),
k as (select *, row_number() over (partition by track order by lufs) - 1 as k, count(*) over (partition by track) as n from good),
lra as (select track, max(case when k = floor((n - 1) * 0.95 + 0.5) then lufs end) - max(case when k = floor((n - 1) * 0.1 + 0.5) then lufs end) as lra from k group by 1)"""
_EXTENT = 'shortp as (select track, gate, -0.691 + 10 * log10(greatest(power, 1e-10)) as lufs from plains), o2 as (select * from shortp where lufs >= -70), r2 as (select track, 10 * log10(avg(pow(10, lufs / 10))) - 20 as least_ from o2 group by 1), extent as (select track, min(lufs) as floor, quantile_cont(lufs, 0.5) as "pivot" from o2 join r2 using (track) where lufs >= least_ group by 1)'
_TAP = "tp as (select track, max(greatest(abs(value), " + ", ".join("abs(" + " + ".join(f"v{k} * {tap}" for k, tap in enumerate(phase)) + ")" for phase in blocks.PHASES) + ")) as true_peak from lagged group by track)"
_LAGS = "ends as (select track, channel, max(frame) + unnest(generate_series(1, 11)) as frame, 0.0::double as value from sig group by track, channel), lagged as (select track, channel, frame, value, " + ", ".join(f"lag(value, {k}, 0) over w as v{k}" for k in range(12)) + " from (select * from sig union all select * from ends) window w as (partition by track, channel order by frame))"


def hist_sql(name: str, source: str, buckets: int) -> str:
    """{name}(track, bucket, n, bucket_max) of the magnitudes of source."""
    return f"{name} as (select track, case when m > 0 then least({buckets - 1}, cast(floor(abs(value) * {buckets} / m) as integer)) else 0 end as bucket, count(*) as n, m as bucket_max from {source} join (select track, max(abs(value)) as m from {source} group by 1) using (track) group by 1, 2, 4)"


def limit_sql(name: str, hist: str, pivots: str, percentile: float, buckets: int) -> str:
    return f"""{name}_r as (select *, sum(n) over (partition by track order by bucket desc) as above, sum(n) over (partition by track) as al from {hist}),
{name} as (select track, coalesce(limit_db, 'inf'::double) as limit_db from (select distinct track from {hist}) left join (select track, 20 * log10(greatest((max(bucket) + 0.5) * max(bucket_max) / {buckets}, 1e-10)) as limit_db
  from {name}_r join {pivots} using (track) where bucket_max > 0 and above >= al * (1 - {percentile}) group by track
  having max(bucket) >= max(least({buckets - 1}, greatest(0, floor(pow(10, coalesce("pivot", -40) / 20) / (bucket_max / {buckets})))))) using (track))"""


def _tops(frames: str = "lagged") -> str:
    phases = ", ".join("abs(" + " + ".join(f"v{k} * {tap}" for k, tap in enumerate(phase)) + ")" for phase in blocks.PHASES)
    return f"tops as (select track, channel, frame, greatest({phases}) as m from {frames})"


_HELD = f"{_LAGS}, {_tops()}, loud as (select track, frame, max(m) as m from tops where frame <= (select max(frame) from sig s where s.track = tops.track) group by 1, 2), held as (select track, 0 as channel, frame, max(m) over (partition by track order by frame rows between 3 preceding and 3 following) as value from loud)"
_SMOOTH = design.smoothing(50.0, RATE)
_SMOOTH2 = design.smoothing(50.0, RATE, True)
_SEG = "select cast(label as bigint) as track, 64 * (row_number() over (partition by label order by vec_id) - 1) as o, embedding from embeddings"
_S = f"blk as ({_SEG}), s as materialized (select track, o + i as frame, embedding[i + 1]::double as value from blk, generate_series(0, 63) t(i))"


def spectra_sql(fft: int, hop: int, tail: bool) -> str:
    last = f"(n - {fft}) // {hop} + 1"
    more = f"case when n > greatest(0, {last}) * {hop} then 0 else 1 end" if tail else "1"
    return f"""n as (select track, max(frame) + 1 as n from s group by 1), fr as (select track, unnest(generate_series(0, greatest(0, {last}) - {more})) as k from n),
x as (select track, k, frame - k * {hop} as i, value * 0.5 * (1 - cos(2 * pi() * (frame - k * {hop}) / {fft})) as v from fr join s using (track) where frame between k * {hop} and k * {hop} + {fft - 1}),
spec as materialized (select track, k, b, sum(v * cos(2 * pi() * b * i / {fft})) as re, -sum(v * sin(2 * pi() * b * i / {fft})) as im from x, generate_series(0, {fft // 2}) t(b) group by track, k, b)"""


def _bands_sql(edges: Sequence[tuple[int, int, float, float]]) -> str:
    rows = []
    for band, (first, last, a, b) in enumerate(edges):
        weights = [a] if first == last else [a, *[1.0] * (last - first - 1), b]
        rows += [f"({band}, {first + i}, {w!r})" for i, w in enumerate(weights)]
    return ", ".join(rows)


ORACLES: dict[str, str] = {
    "k_weight": f"with recursive {SRC}, {iir('k1', 'src', _K48[0], _K44[0])}, {iir('k2', 'k1', _K48[1], _K44[1])} select track, channel, frame, round(value, 6) as value from k2",
    "loudness_report": f"""with recursive {_LOUD}, {gate_sql(40, 10)}, {_INTEGRATED}, {_TAIL}, {gate_sql(300, 10, 'tail', 'shorts')}, {_RANGE}, {_LAGS}, {_TAP}, {hist_sql('hist', 'sig', 1024)},
run as (select *, sum(n) over (partition by track order by bucket) as cum, sum(n) over (partition by track) * 0.5 as goal, sum(n) over (partition by track) as total from hist),
med as (select track, bucket_max as peak, total, bucket_max / 1024 * (bucket + (goal - (cum - n)) / n) as median from run where cum >= goal qualify row_number() over (partition by track order by bucket) = 1)
select track, round(lufs, 6) as lufs, round(coalesce(lra, 0), 6) as lra, round(true_peak, 6) as true_peak, round(peak, 6) as peak, cast(total as bigint) as total, round(median, 6) as median from lufs left join lra using (track) join tp using (track) left join med using (track)""",
    "loudness_normalize": f"with recursive {_LOUD}, {gate_sql(40, 10)}, {_INTEGRATED} select track, channel, frame, round(value * case when isfinite(lufs) then pow(10, (-23 - lufs) / 20) else 1 end, 6) as value from sig join lufs using (track)",
    "true_peak_normalize": f"with {SIG}, {_LAGS}, {_TAP} select track, channel, frame, round(value * case when true_peak > 0 then pow(10, -1 / 20.0) / true_peak else 1 end, 6) as value from sig join tp using (track)",
    "low_pass": f"with recursive {SRC}, {iir('y', 'src', design.low_pass(RATE, 12.0))} select track, channel, frame, round(value, 6) as value from y",
    "band_pass": f"with recursive {SRC}, {iir('y1', 'src', design.high_pass(RATE, 4.0))}, {back('z1', 'y1')}, {iir('y2', 'z1', design.high_pass(RATE, 4.0))}, {back('z2', 'y2')}, {iir('y3', 'z2', design.low_pass(RATE, 20.0))}, {back('z3', 'y3')}, {iir('y4', 'z3', design.low_pass(RATE, 20.0))}, {back('z4', 'y4')} select track, channel, frame, round(value, 6) as value from z4",
    "smooth": f"with recursive {SRC}, {iir('y', 'src', design.one_pole(_SMOOTH), seeded=True)} select track, channel, frame, round(value, 6) as value from y",
    "smooth_both_ways": f"with recursive {SRC}, {iir('y', 'src', design.one_pole(_SMOOTH2), seeded=True)}, {back('z', 'y')}, {iir('y2', 'z', design.one_pole(_SMOOTH2), seeded=True)}, {back('z2', 'y2')} select track, channel, frame, round(value, 6) + 0.0 as value from z2",
    "rotate_phase": f"with recursive {SRC}, {iir('y', 'src', design.allpass(90.0))} select track, channel, frame, round(value, 6) as value from y",
    "detection_envelope": f"with {SIG}, {_HELD} select track, channel, frame, round(20 * log10(greatest(value, 1e-10)), 6) as value from held",
    "spectrogram_bands": f"with {_S}, {spectra_sql(64, 16, True)}, bands(band, b, w) as (values {_bands_sql(MEL)}) select track, 0 as channel, k as stft_frame, band, round(case when sum(w) > 0 then sum(w * sqrt(re * re + im * im)) / 32 / sum(w) else 0 end, 5) as magnitude from spec join bands using (b) group by 1, 2, 3, 4",
    "true_peak_position": f"with {SIG}, {_LAGS}, {_tops()}, last as (select track, channel, max(frame) as n from sig group by 1, 2), c as (select track, least(frame, n) as frame, m from tops join last using (track, channel)) select track, frame, round(m, 6) as magnitude from c qualify row_number() over (partition by track order by m desc, frame) = 1",
    "limit_level": f"""with {SIG}, {hist_sql('hist', 'sig', 64)}, piv as (select distinct track, -20.0 + track % 3 as "pivot" from hist), {limit_sql('lim', 'hist', 'piv', 0.9, 64)} select track, round(limit_db, 6) as limit_db from lim""",
    "best_attempt": "with a as (select o_custkey as track, o_orderkey as attempt, -16.0 + (o_orderkey % 21 - 10) / 4.0 as lufs, -1.0 + (o_orderkey * 7 % 13 - 6) / 8.0 as true_peak_db from orders), b as (select *, true_peak_db <= -1.0 + 0.01 as holds from a) select track, attempt, lufs, true_peak_db from b qualify row_number() over (partition by track order by case when holds and lufs <= -16 then 0 else 1 end, case when holds then 0 else 1 end, case when holds then 0 else abs(true_peak_db + 1) end, abs(lufs + 16), attempt) = 1",
    "source_measures": f"""with recursive {_LOUD}, {gate_sql(40, 10)}, {_INTEGRATED}, {_TAIL}, {gate_sql(300, 10, 'tail', 'shorts')}, {_RANGE}, {gate_sql(300, 10, 'pow', 'plains')}, {_EXTENT}, {_HELD}, {_TAP}, {hist_sql('hist', 'held', 1024)}, {limit_sql('lim', 'hist', '(select track, "pivot" from len left join extent using (track))', 0.9, 1024)}
select track, round(lufs, 6) as lufs, round(coalesce(lra, 0), 6) as lra, round(20 * log10(greatest(true_peak, 1e-10)), 6) as true_peak_db, round(coalesce(floor, 'inf'::double), 6) as floor, round(coalesce("pivot", 'inf'::double), 6) as "pivot", round(limit_db, 6) as limit_db, round(bucket_max, 6) as bucket_max
from lufs left join lra using (track) join tp using (track) left join extent using (track) join lim using (track) join (select distinct track, bucket_max from hist) using (track)""",
    "transfer": f"""with {_S}, {spectra_sql(16, 16, False)}, p as (select t.track as target, t.track + 1 as reference, t.k, t.b, t.re, t.im, coalesce(r.re, 0) as rr, coalesce(r.im, 0) as ri from spec t left join spec r on r.track = t.track + 1 and r.k = t.k and r.b = t.b where t.track % 2 = 0 and exists (select 1 from spec x where x.track = t.track + 1)),
q as (select *, rr * rr + ri * ri as pr, re * re + im * im as pt, max(rr * rr + ri * ri) over (partition by target) as top from p), w as (select *, pr / (pt + pr + 1e-10 * (top + 1e-20)) as w from q),
s2 as (select target, reference, b, sum(w * (re * rr + im * ri)) as x, sum(w * (im * rr - re * ri)) as y, sum(w * pr) as auto from w group by 1, 2, 3), m as (select *, auto + 1e-10 * max(auto) over (partition by target) as under from s2)
select target as session, target, reference, b as bin, round(case when under > 0 then x / under else 0 end, 5) + 0.0 as h_re, round(case when under > 0 then y / under else 0 end, 5) + 0.0 as h_im from m""",
    "degenerate_transfers": "with r as (select l_suppkey % 7 as session, l_suppkey as target, case l_suppkey % 7 when 1 then 'nan'::double when 2 then 'inf'::double when 3 then 0.0 when 4 then case when l_quantity < 48 then 1e-9 else l_quantity end else l_quantity end as h from lineitem), t as (select *, max(h) over (partition by session, target) as top from r) select session, target, 0 as reference, case session when 1 then 'not a number' when 2 then 'infinite or denormal' else case when max(top) = 0 then 'all zero' when count(*) filter (h < 1e-4 * top) >= 0.8 * count(*) then 'mostly silent' end end as reason from t group by 1, 2",
    "crest_scores": f"with {SIG}, b as (select track, channel, frame // 64 as block_idx, max(abs(value)) as p, sqrt(avg(value * value)) as r from sig group by 1, 2, 3), t as (select *, case when r > 0 then least(1, greatest(0, (p / r - sqrt(2)) / (6 - sqrt(2)))) else 0 end as t from b) select track, channel, block_idx, round(t * t * (3 - 2 * t), 6) as score from t",
    "low_crest_phase": f"""with {_S}, {spectra_sql(16, 16, False)}, p as (select track, k, b, re * re + im * im as p, sum(re * re + im * im) over (partition by track, k) as t from spec), q as (select track, k, b, case when t > 0 then p / t else 1 / 9.0 end as power from p),
f as (select *, -2 * pi() * coalesce(sum((8 - b) * power) over (partition by track, k order by b rows between unbounded preceding and 1 preceding), 0) as phase from q),
d as (select *, lag(phase) over w as lo, lead(phase) over w as hi from f window w as (partition by track, k order by b))
select track, k as stft_frame, b as bin, round(power, 5) as power, round(phase, 5) + 0.0 as phase, round(0.5 * greatest(0, -(coalesce(hi, phase) - coalesce(lo, phase)) / (case when b in (0, 8) then 1 else 2 end * pi() / 8)), 5) as delay from d""",
    "segment_model": f"""with {SIG}, e as (select track, channel, max(frame) as m from sig group by 1, 2), g as (select track, channel, m, unnest(generate_series(0, m // 8)) as k from e),
f as (select g.track, g.channel, g.k, i, g.k * 8 + i as frame, coalesce(s.value, 0) as v from g cross join generate_series(0, 15) t(i) left join sig s on s.track = g.track and s.channel = g.channel and s.frame = g.k * 8 + i),
o as (select *, (v - avg(v) over (partition by track, channel, k)) as y, (case when i < 8 then i + 1 else 16 - i end) / 8.0 as w from f)
select o.track, o.channel, o.frame, round(sum(w * y) / sum(w), 6) as value from o join e using (track, channel) where frame <= m group by 1, 2, 3""",
    "score_model": f"with {SIG}, w as (select track, channel, unnest([frame // 16, (frame + 4) // 16]) as w, unnest([true, frame % 16 >= 12]) as good, value, frame from sig), e as (select track, channel, max(frame) // 16 as last from sig group by 1, 2) select track, channel, w, round(sum(value * value), 6) as p from w join e using (track, channel) where good and w <= last group by 1, 2, 3",
    "centred": f"with {SIG} select track, channel, frame, round(value - sum(value) over (partition by track) / count(*) over (partition by track), 10) as value from sig",
    "largest_step": f"with {SIG}, d as (select *, abs(value - lag(value) over (partition by track, channel order by frame)) as d from sig) select track, channel, cast(min_by(value, frame) as double) as first, cast(max_by(value, frame) as double) as last, cast(coalesce(max(d), 0) as double) as step from d group by 1, 2",
    "varying_lattice": f"""with recursive {SRC}, n as (select track, max(frame) // 20 as last from src group by 1), pos as materialized (select s.*, least(frame // 16, last) as lo, least(least(frame // 16, last) + 1, last) as hi, last from src s join n using (track)),
x as materialized (select track, channel, frame, value, {", ".join(f"greatest(-0.95, least(0.95, 1.2 * (((lo * 7 + track + {5 * s}) % 19 - 9) / 10.0 + (frame / 16.0 - lo) * (((hi * 7 + track + {5 * s}) % 19 - 9) / 10.0 - ((lo * 7 + track + {5 * s}) % 19 - 9) / 10.0))))::double as k{s}" for s in range(3))} from pos),
r(track, channel, frame, z0, z1, z2, y) as (select track, channel, -1::bigint, 0.0::double, 0.0::double, 0.0::double, 0.0::double from x where frame = 0
union all select track, channel, frame, sqrt(1 - k0 * k0) * x0 + k0 * z0, sqrt(1 - k1 * k1) * x1 + k1 * z1, sqrt(1 - k2 * k2) * x2 + k2 * z2, sqrt(1 - k2 * k2) * z2 - k2 * x2 from
 (select *, sqrt(1 - k1 * k1) * z1 - k1 * x1 as x2 from (select x.*, r.z0, r.z1, r.z2, x.value as x0, sqrt(1 - k0 * k0) * r.z0 - k0 * x.value as x1 from r join x on x.track = r.track and x.channel = r.channel and x.frame = r.frame + 1)))
select track, channel, frame, round(y, 9) + 0.0 as value from r where frame >= 0""",
    "mirrored": "with b as (select cast(label as bigint) as track, row_number() over (partition by label order by vec_id) - 1 as block_idx, embedding as e from embeddings) select track, block_idx, i, cast(e[case when i < 3 then 3 - i when i < 67 then i - 2 else 64 - (i - 67) end] as double) as value from b, generate_series(0, 68) t(i)",
    "frequency_scales": "with f as (select o_orderkey, cast(o_totalprice as double) as f from orders) select o_orderkey, round(2595 * log10(1 + f / 700), 4) as mel, round(21.4 * log10(1 + 0.00437 * f), 4) as erb, round(ln(f), 4) as log, round(f, 4) as back_mel, round(f, 4) as back_erb, round(f, 4) as back_log from f",
    "channel_sum": f"with {SIG} select track, 0 as channel, frame, round(l + r, 6) as value from rows",
    "windows_padded": f"with {SIG}, e as (select track, channel, max(frame) as m from sig group by 1, 2), w as (select track, channel, unnest(generate_series(0, m // 15)) as w from e) select w.track, w.channel, w.w as \"window\", i, round(coalesce(s.value, 0), 6) as value from w cross join generate_series(0, 39) t(i) left join sig s on s.track = w.track and s.channel = w.channel and s.frame = w.w * 15 + i",
    "splice_channels": f"with {SIG} select s.track, s.channel, s.frame, round(coalesce(i.l, s.value), 6) as value from sig s left join rows i on s.channel = 1 and i.track = s.track and i.frame < 30 and i.frame + 50 = s.frame",
    "momentary_loudness": f"with {queries.POWER}, {gate_sql(40, 10)} select track, gate, round(-0.691 + 10 * log10(greatest(power, 1e-10)), 6) as lufs from gates",
    "live_sessions": "with e as (select user_id as track, ts, case when ts - lag(ts) over w < interval '45 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by track order by ts) as k from e) select track, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, count(*) as n from s group by track, k",
}
