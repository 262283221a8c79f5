"""The registered query of each operator on samples and intervals, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import blocks, design, intervals, loudness, samples
from ..operators.lineage import per_track
from ..sources import tables
from ..sources.tables import RATE
from ..streaming import live
from . import reports

Query = Callable[[SparkSession, str], DataFrame]

SIG = """
rows as (select l_suppkey as track, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice) - 1 as frame, (2 * l_quantity - 51) / 64.0 as l, (8 * floor(l_discount * 100 + 0.5) - 40) / 64.0 as r, cast(10 * floor(l_discount * 100 + 0.5) as bigint) as p from lineitem),
sig as (select track, 0 as channel, frame, l as value from rows union all select track, 1, frame, r from rows)
"""
REG = """
reg as (select o_orderkey % (select count(*) from supplier) as track, (o_orderkey * 7 % 1200) / 100.0 as start_s, (o_orderkey * 7 % 1200) / 100.0 + (o_custkey % 3) / 100.0 as end_s from orders),
seg as (select track, cast(floor(start_s * 100 + 0.5) as bigint) as a, cast(floor(end_s * 100 + 0.5) as bigint) as b from reg where floor(end_s * 100 + 0.5) > floor(start_s * 100 + 0.5)),
merged as (select track, min(a) as a, max(b) as b from (select *, sum(case when a > reach or reach is null then 1 else 0 end) over (partition by track order by a, b) as island
  from (select *, max(b) over (partition by track order by a, b rows between unbounded preceding and 1 preceding) as reach from seg)) group by track, island)
"""
POWER = SIG + ", pow as (select track, frame, sum(value * value) as power from sig group by 1, 2), len as (select track, max(frame) + 1 as n from pow group by 1)"


def gate_sql(size: int, step: int, source: str = "pow", name: str = "gates") -> str:
    return f"""{name} as (select track, gate, sum(power) / {size} as power from (select track, power, unnest(generate_series(greatest(0, cast(floor((frame - {size}) / {step}.0) as bigint) + 1), cast(floor(frame / {step}.0) as bigint))) as gate from {source})
  join (select track, max(frame) + 1 as total from {source} group by 1) using (track) where gate * {step} + {size} <= total group by 1, 2)"""


def _signal(op: Callable[[DataFrame], DataFrame], mono: bool = False, digits: int | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op((tables.mono if mono else tables.signal)(spark, sf_dir))
        return out.withColumns({c: F.round(c, digits) for c, t in out.dtypes if t == "double"}) if digits else out

    return query


def in_blocks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The signal in blocks, written once, as what works on blocks reads them several times; a track's are in one task."""
    return blocks.settle(tables.signal_blocks(spark, sf_dir, size))


def _with_regions(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(tables.signal(spark, sf_dir), tables.regions(spark, sf_dir))


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("track").agg((F.max("frame") + 1).alias("n"))


def peak_normalize_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.waveform(samples.normalize(tables.signal(spark, sf_dir)), 50)


def _replace(df: DataFrame) -> DataFrame:
    return samples.replace_channel(df, 1, df.filter("channel = 0 and frame % 2 = 0"))


def _splice(df: DataFrame) -> DataFrame:
    """The first 40 frames of each track's other channel, put in at frame 100."""
    return intervals.splice(df, df.filter("frame < 40").withColumn("channel", 1 - F.col("channel")), 100)


def _segments(df: DataFrame, regions: DataFrame) -> DataFrame:
    return intervals.merge(intervals.to_frames(regions, RATE))


def _energies(df: DataFrame) -> DataFrame:
    return samples.windows(df, 40, 10).groupBy("track", "channel", "window").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))


def _envelope(df: DataFrame) -> DataFrame:
    """Each channel times the smoothed first one, joined by frame."""
    control = samples.sliding_max(df.filter("channel = 0"), 5).select("track", "frame", F.col("value").alias("g"))
    return df.join(control, ["track", "frame"]).select("track", "channel", "frame", (F.col("value") * F.col("g")).alias("value"))


def _curve(df: DataFrame) -> DataFrame:
    level = levels.linear_to_db(F.abs("value"))
    return df.select("track", "channel", "frame", F.round(levels.gain_curve(level, -20, -3, 6, -1, -40), 6).alias("gain_db"))


def _predict(df: DataFrame) -> DataFrame:
    """Share of power left after a gain curve, from the histogram alone."""
    hist = samples.histogram(df, 64)
    centre = (F.col("bucket") + 0.5) * F.col("bucket_max") / 64
    gain = F.pow(F.lit(10.0), levels.gain_curve(levels.linear_to_db(centre), -20, -3, 6, -1, -40) / 20)
    c2 = F.col("n") * centre * centre
    return hist.filter("bucket_max > 0").groupBy("track").agg(F.round(10 * F.log10(F.sum(c2 * gain * gain) / F.sum(c2)), 6).alias("change_db"))


def _pcm(df: DataFrame) -> DataFrame:
    return df.select("track", "channel", "frame", levels.quantize_pcm(F.col("value") * 1.25, 16).alias("pcm"))


def _stats(df: DataFrame) -> DataFrame:
    out = samples.statistics(df)
    return out.select("track", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _gates(df: DataFrame) -> DataFrame:
    return loudness.gates(loudness.power(df), 40, 10)


def _integrated(df: DataFrame) -> DataFrame:
    return loudness.integrated(loudness.power(df), RATE).withColumn("lufs", F.round("lufs", 6))


def _range(df: DataFrame) -> DataFrame:
    return loudness.loudness_range(loudness.short_term(loudness.with_tail(loudness.power(df), RATE), RATE)).withColumn("lra", F.round("lra", 6))


def _extent(df: DataFrame) -> DataFrame:
    out = loudness.gated_extent(loudness.short_term(loudness.power(df), RATE))
    return out.select("track", F.round("low", 6).alias("low"), F.round("median", 6).alias("median"))


def voice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.hysteresis(tables.scores(spark, sf_dir), 50, 10, 30, 20, slack=15)


def voice_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to segments, padded, and the signal gated by them."""
    df = tables.signal(spark, sf_dir)
    found = intervals.hysteresis(tables.scores(spark, sf_dir), 50, 1, 3, 2, slack=15)
    out = intervals.gate(df, intervals.pad_segments(found, 2, _lengths(df)), 0.25, 4, 8)
    return out.withColumn("value", F.round("value", 9))


def true_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.true_peak(in_blocks(spark, sf_dir, 128))
    return out.withColumn("true_peak", F.round("true_peak", 9))


def k_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of odd numbers at 44.1 kHz, the others at 48 kHz."""
    rated = in_blocks(spark, sf_dir, 100).withColumn("rate", F.when(F.col("track") % 2 == 1, 44100).otherwise(48000))
    out = blocks.to_samples(blocks.lti_filter(rated, design.k_weighting))
    return out.withColumn("value", F.round("value", 6))


def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row for each band."""
    out = blocks.spectrogram(tables.blocks(spark, sf_dir), 64, 16)
    return out.select("track", "channel", "stft_frame", F.posexplode("bands").alias("band", "magnitude")).withColumn("magnitude", F.round("magnitude", 6))


def spectral_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 64 of each track on, out of the inverse transform of the transform."""
    frames = blocks.stft(blocks.settle(tables.blocks(spark, sf_dir)), 64, 16)
    out = blocks.settle(blocks.istft(frames, 64, 16, 100))
    ends = out.groupBy("track").agg(F.max(F.col("offset") + F.size("samples") - 1).alias("n"))
    return per_track(blocks.to_samples(out), ends).filter("frame >= 64 and frame <= n - 64").select("track", "frame", (F.round("value", 5) + 0.0).alias("value"))


def loudness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of 48 kHz, gates of the nominal rate; the report without its array of buckets."""
    out = reports.loudness_report(in_blocks(spark, sf_dir, 128), RATE, sections=design.K_48000)
    return out.drop("buckets").withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def loudness_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.loudness_normalize(in_blocks(spark, sf_dir, 128), RATE, sections=design.K_48000, dealt=True, apply=reports.gained_samples)
    return out.withColumn("value", levels.digits(F.col("value"), 6))


def true_peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.true_peak_normalize(in_blocks(spark, sf_dir, 128), apply=reports.gained_samples)
    return out.withColumn("value", F.round("value", 6))


def regrid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 64 cut to 60, closed up and dealt to a grid of 100."""
    cut = blocks.slice_block(tables.blocks(spark, sf_dir), 2, 60).withColumn("offset", F.col("block_idx") * 60)
    return blocks.to_samples(blocks.regrid(cut, 100))


def _live(op: Callable[[DataFrame], DataFrame]) -> Query:
    """The table's result of what runs on a stream too; times as text, whatever the session's zone."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(tables.live(spark, sf_dir))
        return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in out.dtypes if t == "timestamp"})

    return query


QUERIES: dict[str, Query] = {
    "live_waveform": _live(lambda df: live.waveform(df, "1 hour")),
    "live_gates": _live(lambda df: live.gates(df, "2 hours", "30 minutes").withColumn("power", F.round("power", 6))),
    "live_activity": _live(lambda df: live.activity(df, 1.0, "90 minutes")),
    "live_histogram": _live(lambda df: live.fine_histogram(df, 0.5)),
    "live_last_finished": _live(lambda df: live.last_finished(df, "purchase")),
    "true_peak": true_peak,
    "true_peak_long": _signal(lambda df: blocks.true_peak_long(df), digits=9),
    "k_weight": k_weight,
    "spectrogram": spectrogram,
    "spectral_round_trip": spectral_round_trip,
    "loudness_report": loudness_report,
    "loudness_normalize": loudness_normalize,
    "true_peak_normalize": true_peak_normalize,
    "regrid_blocks": regrid_blocks,
    "sliding_extreme": lambda spark, sf_dir: blocks.to_samples(blocks.sliding_extreme(in_blocks(spark, sf_dir, 64), 20)),
    "peak_normalize_waveform": peak_normalize_waveform,
    "gain": _signal(lambda df: samples.gain(df, 6.0), digits=9),
    "invert": _signal(samples.invert),
    "pan": _signal(lambda df: samples.pan(df, 0.5), mono=True, digits=9),
    "balance": _signal(lambda df: samples.balance(df, 0.25)),
    "duplicate_channels": _signal(lambda df: samples.duplicate_channels(df, 3), mono=True),
    "select_channels": _signal(lambda df: samples.select_channels(df, (1, 5, 0))),
    "replace_channel": _signal(_replace),
    "reverse": _signal(samples.reverse),
    "pad": _signal(lambda df: samples.pad(df, RATE, 0.1, 0.25)),
    "trim": _signal(lambda df: samples.trim(df, 0.7, 3)),
    "shape_noise": _signal(lambda df: samples.shape_noise(df, 4, 100)),
    "quantize_pcm": _signal(_pcm),
    "downmix": _signal(samples.downmix),
    "peak": _signal(samples.peak),
    "histogram": _signal(lambda df: samples.histogram(df, 64)),
    "histogram_median": _signal(lambda df: samples.histogram_percentile(samples.histogram(df, 64), 50, 64), digits=9),
    "histogram_percentile": _signal(lambda df: samples.histogram_percentile(samples.histogram(df, 64), 95, 64), digits=9),
    "statistics": _signal(_stats),
    "loudest": _signal(samples.loudest),
    "checks": _signal(lambda df: samples.checks(df, RATE, 6.0)),
    "moving_average": _signal(lambda df: samples.moving_average(df, 9, 100), digits=9),
    "sliding_max": _signal(lambda df: samples.sliding_max(df, 5, 100)),
    "windows": _signal(lambda df: samples.windows(df, 40, 10)),
    "transients": _signal(lambda df: samples.transients(_energies(df))),
    "hold": _signal(lambda df: samples.hold(_energies(df).select("track", "channel", "window", F.col("energy").alias("amount")), 2)),
    "envelope": _signal(_envelope),
    "gain_curve": _signal(_curve),
    "predicted_loudness": _signal(_predict),
    "splice": _signal(_splice),
    "merge_regions": _with_regions(_segments),
    "cut": _with_regions(lambda df, r: intervals.cut(df, r, RATE)),
    "gate": _with_regions(lambda df, r: intervals.gate(df, _segments(df, r), 0.25, 4, 8).withColumn("value", F.round("value", 9))),
    "pad_segments": _with_regions(lambda df, r: intervals.pad_segments(_segments(df, r), 5, _lengths(df))),
    "resample_segments": _with_regions(lambda df, r: intervals.resample_segments(_segments(df, r), 100, 44.1, _lengths(df))),
    "voice_segments": voice_segments,
    "voice_gate": voice_gate,
    "gates": _signal(_gates),
    "integrated_loudness": _signal(_integrated),
    "loudness_range": _signal(_range),
    "gated_extent": _signal(_extent),
}

_CURVE = "case when {l} >= -3 then -1 - ({l} + 3) when {l} >= -20 then 6 + -7 * ({l} + 20) / 17.0 when {l} <= -40 then 0 else 6 * ({l} + 40) / 20.0 end"
_HIST = "top as (select track, max(abs(value)) as m from sig group by 1), hist as (select track, case when m > 0 then least(63, cast(floor(abs(value) * 64 / m) as integer)) else 0 end as bucket, count(*) as n, m as bucket_max from sig join top using (track) group by 1, 2, 4)"
_PERCENTILE = SIG + ", " + _HIST + """, run as (select *, sum(n) over (partition by track order by bucket) as cum, sum(n) over (partition by track) * {p} as goal from hist)
select track, round(bucket_max / 64 * (bucket + (goal - (cum - n)) / n), 9) as level from run where cum >= goal qualify row_number() over (partition by track order by bucket) = 1"""
_WINDOWS = "win as (select track, channel, w as \"window\", frame - w * 10 as i, value from (select *, unnest(generate_series(greatest(0, cast(floor((frame - 40) / 10.0) as bigint) + 1), cast(floor(frame / 10.0) as bigint))) as w from sig)), energy as (select track, channel, \"window\", sum(value * value) as energy from win group by 1, 2, 3)"
_GATE = """ends as (select track, max(frame) + 1 as n from sig group by 1),
gains as (select track, frame, max(case when frame >= a and frame < b then 1.0 when frame > a - 4 and frame < a then 0.25 + 0.75 * (0.5 - 0.5 * cos(pi() * (frame - (a - 4)) / 4.0))
  when frame >= b and frame <= b + 8 then 0.25 + 0.75 * (0.5 - 0.5 * cos(pi() * (1 - (frame - b) / 8.0))) else 0.25 end) as g
  from (select distinct track, frame from sig) join {seg} using (track) where frame >= a - 4 and frame <= b + 8 group by 1, 2)
select track, channel, frame, round(value * coalesce(g, 0.25), 9) as value from sig left join gains using (track, frame)"""
_VOICE = """s as (select track, frame as w, frame * {wf} as pos, p >= 50 as on_, p < 35 as off_ from rows),
e as (select *, sum(case when on_ then 1 else 0 end) over (partition by track order by w) as ep, (max(w) over (partition by track) + 1) * {wf} as total from s),
q as (select *, min(case when off_ then pos end) over (partition by track, ep order by w) as sil from e where ep > 0),
r as (select track, ep, min(pos) as on_pos, min(sil) as sil, max(case when off_ and pos - sil >= {mi} then 1 else 0 end) as closed, max(total) as total from q group by 1, 2),
g as (select *, coalesce(sum(closed) over (partition by track order by ep rows between unbounded preceding and 1 preceding), 0) as seg from r),
voice as (select track, min(on_pos) as a, coalesce(max(case when closed = 1 then sil end), max(total)) as b from g group by track, seg having coalesce(max(case when closed = 1 then sil end), max(total)) - min(on_pos) > {ms})"""
_PADDED = """padded as (select track, greatest(0, case when behind is null then a - {p} when behind < 2 * {p} then a - behind // 2 else a - {p} end) as a, least(n, case when ahead is null then b + {p} when ahead < 2 * {p} then b + ahead // 2 else b + {p} end) as b
  from (select *, a - lag(b) over (partition by track order by a) as behind, lead(a) over (partition by track order by a) - b as ahead from {seg}) join (select track, max(frame) + 1 as n from sig group by 1) using (track))"""
_SHORT = """short as (select track, gate, -0.691 + 10 * log10(greatest(power, 1e-10)) as lufs from gates),
over70 as (select * from short where lufs >= -70), rel as (select track, 10 * log10(avg(pow(10, lufs / 10))) - 20 as least_ from over70 group by 1),
good as (select o.* from over70 o join rel using (track) where lufs >= least_)"""

_PEAK = SIG + """, tail as (select track, channel, max(frame) + unnest(generate_series(1, 11)) as frame, 0.0 as value from sig group by track, channel),
lagged as (select track, value, """ + ", ".join(f"lag(value, {k}, 0) over w as v{k}" for k in range(12)) + """ from (select * from sig union all select * from tail) window w as (partition by track, channel order by frame))
select track, round(max(greatest(abs(value), """ + ", ".join("abs(" + " + ".join(f"v{k} * {tap}" for k, tap in enumerate(phase)) + ")" for phase in blocks.PHASES) + """)), 9) as true_peak from lagged group by track"""
_BLK = "blk as (select cast(label as bigint) as track, 64 * (row_number() over (partition by label order by vec_id) - 1) as o, embedding from embeddings), s as (select track, o + i as frame, embedding[i + 1]::double as value from blk, generate_series(0, 63) t(i))"

ORACLES: dict[str, str] = {
    "live_waveform": "select user_id as track, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, min(value) as min, max(value) as max from events group by 1, 2",
    "live_gates": "with g as (select user_id as track, value, time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as s, ts from events, generate_series(0, 3) t(k)) select track, strftime(s, '%Y-%m-%d %H:%M:%S') as start, round(sum(value * value), 6) as power, count(*) as n from g where ts < s + interval '2 hours' group by 1, 2",
    "live_activity": "with e as (select user_id as track, ts, case when ts - lag(ts) over w < interval '90 minutes' then 0 else 1 end as new from events where value > 1 window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by track order by ts) as k from e) select track, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by track, k",
    "live_histogram": "select user_id as track, cast(floor(abs(value) / 0.5) as bigint) as bucket, count(*) as n from events group by 1, 2",
    "live_last_finished": "select user_id as track, strftime(ts, '%Y-%m-%d %H:%M:%S') as finished_at, value from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "true_peak": f"with {_PEAK}",
    "true_peak_long": f"with {_PEAK}",
    "spectrogram": f"""with {_BLK}, n as (select track, max(frame) + 1 as n from s group by 1), fr as (select track, unnest(generate_series(0, greatest(0, (n - 64) // 16 + 1) - case when n > greatest(0, (n - 64) // 16 + 1) * 16 then 0 else 1 end)) as k from n),
x as (select track, k, frame - k * 16 as i, value * 0.5 * (1 - cos(2 * pi() * (frame - k * 16) / 64)) as v from fr join s using (track) where frame between k * 16 and k * 16 + 63)
select track, 0 as channel, k as stft_frame, b as band, round(sqrt(pow(sum(v * cos(2 * pi() * b * i / 64)), 2) + pow(sum(v * sin(2 * pi() * b * i / 64)), 2)) / 32, 6) as magnitude from x, generate_series(0, 32) t(b) group by track, k, b""",
    "spectral_round_trip": f"with {_BLK}, n as (select track, max(frame) as n from s group by 1) select track, frame, round(value, 5) + 0.0 as value from s join n using (track) where frame >= 64 and frame <= n - 64",
    "regrid_blocks": f"with {_BLK} select track, 0 as channel, frame // 64 * 60 + frame % 64 - 2 as frame, value from s where frame % 64 between 2 and 61",
    "sliding_extreme": f"with {SIG} select track, channel, frame, max(value) over (partition by track, channel order by frame rows between 20 preceding and 20 following) as value from sig",
    "peak_normalize_waveform": f"with {SIG}, top as (select track, max(abs(value)) as m from sig group by 1) select track, channel, cast(floor(frame / 50.0) as bigint) as point, least(1, min(value * f)) as min, greatest(-1, max(value * f)) as max from sig join (select track, case when m > 0 then 1 / m else 1 end as f from top) using (track) group by 1, 2, 3",
    "gain": f"with {SIG} select track, channel, frame, round(value * pow(10, 6 / 20.0), 9) as value from sig",
    "invert": f"with {SIG} select track, channel, frame, -value as value from sig",
    "pan": f"with {SIG} select track, c as channel, frame, round(value * case when c = 0 then cos(0.75 * pi() / 2) else sin(0.75 * pi() / 2) end, 9) as value from sig, (values (0), (1)) t(c) where channel = 0",
    "balance": f"with {SIG} select track, channel, frame, value * case when channel = 0 then 0.75 else 1 end as value from sig",
    "duplicate_channels": f"with {SIG} select track, c as channel, frame, value from sig, (values (0), (1), (2)) t(c) where channel = 0",
    "select_channels": f"with {SIG} select track, 0 as channel, frame, r as value from rows union all select track, 1, frame, 0.0 from rows union all select track, 2, frame, l from rows",
    "replace_channel": f"with {SIG} select track, 0 as channel, frame, l as value from rows union all select track, 1, frame, case when frame % 2 = 0 then l else 0 end from rows",
    "reverse": f"with {SIG} select track, channel, max(frame) over (partition by track) - frame as frame, value from sig",
    "pad": f"with {SIG}, ends as (select track, channel, max(frame) as m from sig group by 1, 2) select track, channel, frame + 10 as frame, value from sig union all select track, channel, unnest(generate_series(0, 9)), 0.0 from ends union all select track, channel, unnest(generate_series(m + 11, m + 35)), 0.0 from ends",
    "trim": f"with {SIG}, ends as (select track, min(frame) filter (abs(value) > 0.7) as a, max(frame) filter (abs(value) > 0.7) as b, max(frame) as n from sig group by 1) select track, channel, frame - greatest(0, a - 3) as frame, value from sig join ends using (track) where frame between greatest(0, a - 3) and least(n, b + 3)",
    "shape_noise": f"with {SIG}, s as (select *, floor(sum(value) over (partition by track, channel order by frame) * 8 + 0.5) / 8 as q from sig) select track, channel, frame, q - lag(q, 1, 0) over (partition by track, channel order by frame) as value from s",
    "quantize_pcm": f"with {SIG} select track, channel, frame, cast(floor(least(1, greatest(-1, value * 1.25)) * case when value < 0 then 32768 else 32767 end + 0.5) as bigint) as pcm from sig",
    "downmix": f"with {SIG} select track, 0 as channel, frame, (l + r) / 2 as value from rows",
    "peak": f"with {SIG} select track, max(abs(value)) as peak from sig group by 1",
    "histogram": f"with {SIG}, {_HIST} select track, bucket, n, bucket_max from hist",
    "histogram_median": "with " + _PERCENTILE.replace("{p}", "0.5"),
    "histogram_percentile": "with " + _PERCENTILE.replace("{p}", "0.95"),
    "statistics": f"with {SIG} select track, round(avg(value), 9) as mean, round(case when stddev_pop(value) = 0 then 1 else stddev_pop(value) end, 9) as std from sig group by 1",
    "loudest": f"with {SIG} select track, channel, frame, abs(value) as magnitude from sig qualify row_number() over (partition by track, channel order by abs(value) desc, frame) = 1",
    "checks": f"with {SIG} select track, sqrt(avg(value * value)) < 1e-6 as silent, false as not_finite, avg(case when abs(value) >= 1 then 1.0 else 0 end) > 0.1 as clipped, avg(case when value = 0 then 1.0 else 0 end) > 0.9 as zeros, (max(frame) + 1) / 100.0 as seconds, abs((max(frame) + 1) / 100.0 - 6) > 0.06 as off_length from sig group by 1",
    "moving_average": f"with {SIG} select track, channel, frame, round(avg(value) over (partition by track, channel order by frame rows between 4 preceding and 4 following), 9) as value from sig",
    "sliding_max": f"with {SIG} select track, channel, frame, max(value) over (partition by track, channel order by frame rows between 5 preceding and 5 following) as value from sig",
    "windows": f"with {SIG}, {_WINDOWS} select * from win",
    "transients": f"with {SIG}, {_WINDOWS} select track, channel, \"window\", energy, coalesce(before > 0 and energy > 2 * before, false) as transient from (select *, lag(energy) over (partition by track, channel order by \"window\") as before from energy)",
    "hold": f"with {SIG}, {_WINDOWS} select track, channel, \"window\", max(energy) over (partition by track, channel order by \"window\" rows between 2 preceding and 2 following) as amount from energy",
    "envelope": f"with {SIG}, g as (select track, frame, max(l) over (partition by track order by frame rows between 5 preceding and 5 following) as g from rows) select track, channel, frame, value * g as value from sig join g using (track, frame)",
    "gain_curve": f"with {SIG}, lv as (select *, 20 * log10(greatest(abs(value), 1e-10)) as l from sig) select track, channel, frame, round({_CURVE.format(l='l')}, 6) as gain_db from lv",
    "predicted_loudness": f"with {SIG}, {_HIST}, c as (select *, (bucket + 0.5) * bucket_max / 64 as c from hist where bucket_max > 0), l as (select *, 20 * log10(greatest(c, 1e-10)) as l from c) select track, round(10 * log10(sum(n * c * c * pow(10, ({_CURVE.format(l='l')}) / 10)) / sum(n * c * c)), 6) as change_db from l group by 1",
    "splice": f"with {SIG.replace('sig as (', 'sig as materialized (')} select s.track, s.channel, s.frame, coalesce(i.value, s.value) as value from sig s left join (select track, 1 - channel as channel, frame + 100 as frame, value from sig where frame < 40) i using (track, channel, frame)",
    "merge_regions": f"with {REG} select track, a as start_frame, b as end_frame from merged",
    "cut": f"with {SIG}, {REG}, out as (select s.*, exists (select 1 from merged m where m.track = s.track and s.frame >= m.a and s.frame < m.b) as cut_ from sig s) select track, channel, row_number() over (partition by track, channel order by frame) - 1 as frame, value from out where not cut_",
    "gate": f"with {SIG}, {REG}, {_GATE.format(seg='merged')}",
    "pad_segments": f"with {SIG}, {REG}, {_PADDED.format(p=5, seg='merged')} select track, a as start_frame, b as end_frame from padded",
    "resample_segments": f"with {SIG}, {REG} select * from (select track, least(n, greatest(0, cast(floor(a * 0.441 + 0.5) as bigint))) as start_frame, least(n, greatest(0, cast(floor(b * 0.441 + 0.5) as bigint))) as end_frame from merged join (select track, max(frame) + 1 as n from sig group by 1) using (track)) where end_frame > start_frame",
    "voice_segments": f"with {SIG}, {_VOICE.format(wf=10, mi=30, ms=20)} select track, a as start_frame, b as end_frame from voice",
    "voice_gate": f"with {SIG}, {_VOICE.format(wf=1, mi=3, ms=2)}, {_PADDED.format(p=2, seg='voice')}, {_GATE.format(seg='padded')}",
    "gates": f"with {POWER}, {gate_sql(40, 10)} select track, gate, power from gates",
    "integrated_loudness": f"with {POWER}, {gate_sql(40, 10)}, a as (select *, avg(power) filter (power > pow(10, (-70 + 0.691) / 10)) over (partition by track) / 10 as least_ from gates), b as (select track, avg(power) as power from a where power > pow(10, (-70 + 0.691) / 10) and power > least_ group by 1) select track, case when power > 0 then round(-0.691 + 10 * log10(power), 6) else '-inf'::double end as lufs from len left join b using (track)",
    "loudness_range": f"with {POWER}, tail as (select * from pow union all select track, n + unnest(generate_series(0, 149)), 0.0 from len), {gate_sql(300, 10, 'tail')}, {_SHORT}, k as (select *, row_number() over (partition by track order by lufs) - 1 as k, count(*) over (partition by track) as n from good), lr as (select track, max(lufs) filter (k = floor((n - 1) * 0.95 + 0.5)) - max(lufs) filter (k = floor((n - 1) * 0.1 + 0.5)) as lra from k group by 1) select track, round(coalesce(lra, 0), 6) as lra from (select distinct track from gates) left join lr using (track)",
    "gated_extent": f"with {POWER}, {gate_sql(300, 10)}, {_SHORT} select track, round(coalesce(min(lufs), 'inf'::double), 6) as low, round(coalesce(quantile_cont(lufs, 0.5), 'inf'::double), 6) as median from (select distinct track from gates) left join good using (track) group by 1",
}
