"""Registered queries of bleed removal, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bleed, blocks
from ..operators.lineage import settle
from ..sources import tables
from .filter_queries import _S, _rounded, spectra_sql
from .queries import Query


def _session(rows: DataFrame) -> DataFrame:
    """Three tracks a session: a target and two references."""
    role = F.when(F.col("track") % 3 == 0, "target").otherwise("reference")
    return rows.select("track").distinct().select((F.col("track") - F.col("track") % 3).alias("session"), "track", role.alias("role"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(blocks.stft(tables.blocks(spark, sf_dir), 64, 32))
    return settle(bleed.frames(rows, _session(rows)))


def speaker_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target (microphone 0) and its two references, in every frame."""
    out = bleed.activity(_frames(spark, sf_dir))
    each = out.select("session", "target", "stft_frame", F.posexplode(F.arrays_zip("scores", "active")).alias("mic", "x"))
    return _rounded(each.select("session", "target", "stft_frame", "mic", F.col("x.scores").alias("score"), F.col("x.active").alias("active")), 5)


def bleed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by the clock, so that corrections, pauses and returns take turns; ranges of eight bins."""
    rows = _frames(spark, sf_dir)
    k = F.col("stft_frame")
    active = rows.select("session", "target", "stft_frame", F.array(k % 4 == 0, F.floor(k / 6) % 2 == 0, F.floor(k / 5) % 3 == 0).alias("active"))
    seeds = rows.select("session", "target").distinct().select("session", "target", (F.col("target") + 1).alias("reference"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bin"))
    seeds = seeds.select("session", "target", "reference", "bin", ((F.col("bin") % 3) / 10).alias("h_re"), F.lit(0.05).alias("h_im"))
    out = bleed.adaptive_bleed(rows, active, seeds, 0.9, 0.5, 0.5, 4, width=8)
    each = out.select("session", "target", "stft_frame", "range", F.posexplode(F.arrays_zip("bleed_re", "bleed_im")).alias("i", "x"))
    return _rounded(each.select("session", "target", "stft_frame", (8 * F.col("range") + F.col("i")).alias("bin"), F.col("x.bleed_re").alias("bleed_re"), F.col("x.bleed_im").alias("bleed_im")), 4).withColumns({c: F.round(F.col(c), 4) + 0.0 for c in ("bleed_re", "bleed_im")})


def bleed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the first reference as the bleed, in two ranges of bins."""
    rows = _frames(spark, sf_dir)
    half = lambda c: F.transform(F.get("refs", F.lit(0))[c], lambda x: x / 2)
    zero = F.transform("re", lambda _: F.lit(0.0))
    first = F.get("refs", F.lit(0))["track"] == F.get("mics", F.lit(0))
    rows = rows.withColumns({f"bleed_{c}": F.when(first, half(c)).otherwise(zero) for c in ("re", "im")})
    part = lambda c: F.when(F.col("range") == 0, F.slice(c, 1, 20)).otherwise(F.slice(c, 21, 100)).alias(c)
    rows = rows.withColumn("range", F.explode(F.array(F.lit(0), F.lit(1))))
    out = bleed.wiener_masks(rows.select("session", "target", "range", "stft_frame", *[part(c) for c in ("re", "im", "bleed_re", "bleed_im")]), 2.0)
    return _rounded(out.select("session", "target", "stft_frame", F.posexplode("mask").alias("bin", "mask")), 5)


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of a label as a frame of a mask."""
    share = F.transform("samples", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 4))
    return tables.blocks(spark, sf_dir).select(F.lit(0).alias("session"), F.col("track").alias("target"), F.col("block_idx").cast("long").alias("stft_frame"), share.alias("mask"))


def _binned(df: DataFrame, column: str) -> DataFrame:
    return _rounded(df.select("target", "stft_frame", F.posexplode(column).alias("bin", "mask")), 5)


def mask_nlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(bleed.smooth_nlm(_masks(spark, sf_dir), 2.0, patch=4, tile=4, bins=2, past=3, ahead=2), "smooth")


def mask_dftt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide is a flatter mask."""
    rows = _masks(spark, sf_dir).withColumn("smooth", F.transform("mask", lambda x: x / 2 + 0.25))
    return _binned(bleed.smooth_dftt(rows, 0.7, frames=4, bins=8, hop_frames=2, hop_bins=4), "final")


QUERIES: dict[str, Query] = {
    "speaker_activity": speaker_activity,
    "bleed_filter": bleed_filter,
    "bleed_mask": bleed_mask,
    "mask_nlm": mask_nlm,
    "mask_dftt": mask_dftt,
}

_SPECTRA = f"{_S}, {spectra_sql(64, 32, False)}"
#: Targets' frames of every microphone of the session; a reference that is shorter goes on with zeros.
_MICS = f"""{_SPECTRA}, mics as materialized (select t.track as target, m.m as mic, t.k, t.b, coalesce(r.re, 0) as re, coalesce(r.im, 0) as im from (select * from spec where track % 3 = 0) t cross join (values (0), (1), (2)) m(m)
  left join spec r on r.track = t.track + m.m and r.k = t.k and r.b = t.b where exists (select 1 from spec x where x.track = t.track + 1) and (m.m < 2 or exists (select 1 from spec x where x.track = t.track + 2)))"""


def _one(r: str, step: int) -> str:
    """The columns of one reference's filter in the recursion: 1 foreseen, 2 corrected, 3 with its pauses."""
    if step == 1:
        return f"0.9 * {r}re as {r}re, 0.9 * {r}im as {r}im, 0.81 * {r}p + (1 - 0.81) * ({r}re * {r}re + {r}im * {r}im + {r}p) as {r}p, {r}n, {r}sre, {r}sim, {r}sp, {r}known, {r}silent, {r}x.re as {r}yre, {r}x.im as {r}yim"
    if step == 2:
        return f"{r}re, {r}im, {r}p, case when k % 4 = 0 then {r}n else 0.5 * {r}n + 0.5 * (ere * ere + eim * eim + 0.5 * ({r}yre * {r}yre + {r}yim * {r}yim) * {r}p) end as {r}n, {r}sre, {r}sim, {r}sp, {r}known, {r}silent, {r}yre, {r}yim"
    if step == 3:
        gain = f"({r}p / ({r}n + 1e-30))"
        on = lambda new, old: f"case when k % 4 = 0 then {old} else {new} end"
        h_re, h_im = f"{r}re + {gain} * ({r}yre * ere + {r}yim * eim)", f"{r}im + {gain} * ({r}yre * eim - {r}yim * ere)"
        return f"{on(h_re, f'{r}re')} as {r}re, {on(h_im, f'{r}im')} as {r}im, {on(f'greatest(1 - {gain} * ({r}yre * {r}yre + {r}yim * {r}yim), 0) * {r}p', f'{r}p')} as {r}p, {r}n, {r}sre, {r}sim, {r}sp, {r}known, {r}silent"
    speaks = "(k // 6) % 2 = 0" if r == "a" else "(k // 5) % 3 = 0"
    back, keep = f"({speaks} and {r}silent >= 4 and {r}known)", f"({speaks} and not ({r}silent >= 4 and {r}known))"
    pick = lambda c: f"case when {back} then {r}s{c} else {r}{c} end as {r}{c}"
    store = lambda c: f"case when {keep} then {r}{c} else {r}s{c} end as {r}s{c}"
    return f"{pick('re')}, {pick('im')}, {pick('p')}, {r}n, {store('re')}, {store('im')}, {store('p')}, ({r}known or {keep}) as {r}known, case when {speaks} then 0 else {r}silent + 1 end as {r}silent"


_STATE = ", ".join(f"{r}{c}" for r in "ab" for c in ("re", "im", "p", "n", "sre", "sim", "sp", "known", "silent"))
_FIRST = "((b % 3) / 10.0)::double, 0.05::double, 1.0::double, 1.0::double, 0.0::double, 0.0::double, 0.0::double, false, 0::bigint, 0.0::double, 0.0::double, 1.0::double, 1.0::double, 0.0::double, 0.0::double, 0.0::double, false, 0::bigint"

ORACLES: dict[str, str] = {
    "speaker_activity": f"""with {_MICS}, pw as materialized (select target, mic, k, b, re * re + im * im as p from mics),
sm as materialized (select t.target, t.mic, t.k, t.b, any_value(t.p) as p, sum(s.p * pow(0.5, t.k - s.k + 1)) as y from pw t join pw s on s.target = t.target and s.mic = t.mic and s.b = t.b and s.k between t.k - 60 and t.k group by 1, 2, 3, 4),
nz as materialized (select t.target, t.mic, t.k, t.b, any_value(t.p) as p, any_value(t.y) as y, 2 * min(s.y) as noise from sm t join sm s on s.target = t.target and s.mic = t.mic and s.b = t.b and s.k between 12 * ((t.k + 1) // 12 - 8) and t.k group by 1, 2, 3, 4),
cl as (select *, greatest(y - noise, 0) as c, case when noise > 0 then greatest(least(p - 4 * noise, y), 0) / (4 * noise) else 0 end as xi from nz),
dm as (select *, row_number() over (partition by target, k, b order by c desc, mic) = 1 and c > 0 as dom from cl),
sh as (select target, k, mic, avg(case when dom and xi >= 0.25 then 1.0 else 0.0 end) as share from dm group by 1, 2, 3),
bd as (select target, k, mic, max(m) as best from (select target, k, mic, least(b // 3, 9) as band, avg(xi) as m from dm group by 1, 2, 3, 4) group by 1, 2, 3),
sc as (select target, k, mic, least(0.1 * best, 1) * share as score from sh join bd using (target, k, mic))
select target as session, target, k as stft_frame, mic, round(score, 5) as score, score > 0.2 as active from sc""",
    "bleed_filter": f"""with recursive {_MICS}, w as materialized (select target, k, b, max(case when mic = 0 then re end) as xre, max(case when mic = 0 then im end) as xim from mics group by 1, 2, 3),
ya as materialized (select target, k, b, re, im from mics where mic = 1), yb as materialized (select w.target, w.k, w.b, coalesce(m.re, 0) as re, coalesce(m.im, 0) as im from w left join mics m on m.mic = 2 and m.target = w.target and m.k = w.k and m.b = w.b),
r(target, b, k, dre, dim, {_STATE}) as (select target, b, -1::bigint, 0.0::double, 0.0::double, {_FIRST} from w where k = 0
union all select target, b, k, dre, dim, {_one('a', 4)}, {_one('b', 4)} from (select target, b, k, dre, dim, {_one('a', 3)}, {_one('b', 3)} from (select target, b, k, dre, dim, ere, eim, {_one('a', 2)}, {_one('b', 2)} from
 (select *, xre - dre as ere, xim - dim as eim from (select *, are * ayre - aim * ayim + bre * byre - bim * byim as dre, are * ayim + aim * ayre + bre * byim + bim * byre as dim from
 (select r.target, r.b, w.k, w.xre, w.xim, {_one('a', 1)}, {_one('b', 1)} from r join w on w.target = r.target and w.b = r.b and w.k = r.k + 1 join ya ax on ax.target = w.target and ax.b = w.b and ax.k = w.k join yb bx on bx.target = w.target and bx.b = w.b and bx.k = w.k))))))
select target as session, target, k as stft_frame, b as bin, round(dre, 4) + 0.0 as bleed_re, round(dim, 4) + 0.0 as bleed_im from r where k >= 0""",
    "bleed_mask": f"""with recursive {_MICS}, f as (select target, k, mic, list(re order by b) as re, list(im order by b) as im from mics group by 1, 2, 3),
g as materialized (select x.target, x.k, x.re as xr, x.im as xi, [v / 2 for v in y.re] as dr, [v / 2 for v in y.im] as di from f x join f y on y.target = x.target and y.k = x.k and x.mic = 0 and y.mic = 1),
r(target, k, psd, o, mask) as (select target, -1::bigint, [0.0::double for v in xr], [0.0::double for v in xr], [0.0::double for v in xr] from g where k = 0
union all select target, k, psd, list_transform(generate_series(1, 33), lambda i: mask[i] * mask[i] * (xr[i] * xr[i] + xi[i] * xi[i])), mask from
 (select *, list_transform(generate_series(1, 33), lambda i: greatest(0, least(1, s[i] / (s[i] + 2 * (1 + 200 * pow((i - 1) / 32.0, 2)) * psd[i] + 1e-10)))) as mask from
 (select *, list_transform(generate_series(1, 33), lambda i: case when y[i] >= list_avg(y) and o[i] >= list_avg(o) then 0.2 * y[i] else 0.25 * y[i] + 0.15 * o[i] end) as s from
 (select g.target, g.k, g.xr, g.xi, r.o, list_transform(generate_series(1, 33), lambda i: 0.5 * r.psd[i] + 0.5 * (g.dr[i] * g.dr[i] + g.di[i] * g.di[i])) as psd, list_transform(generate_series(1, 33), lambda i: pow(g.xr[i] - g.dr[i], 2) + pow(g.xi[i] - g.di[i], 2)) as y
  from r join g on g.target = r.target and g.k = r.k + 1))))
select target as session, target, k as stft_frame, unnest(generate_series(0, 32)) as bin, unnest([round(m, 5) for m in mask]) as mask from r where k >= 0""",
}

_MASK = "v as (select cast(label as bigint) as target, row_number() over (partition by label order by vec_id) - 1 as f, embedding from embeddings), m as materialized (select target, f, b, least(1.0, abs(embedding[b + 1]::double) * 4) as x from v, generate_series(0, 63) t(b)), n as (select target, max(f) + 1 as n from v group by 1)"
_WIN = "(0.5 - 0.5 * cos(2 * pi() * i / 3)) * (0.5 - 0.5 * cos(2 * pi() * j / 7))"

ORACLES["mask_nlm"] = f"""with {_MASK}, tiles as (select target, n, unnest(generate_series(0, n - 1, 4)) as f0, b0 from n, generate_series(0, 60, 4) t(b0)),
c as (select target, n, f0, b0, df, db, greatest(0, least(n - 1, f0 + 2 + df)) as cf, greatest(0, least(63, b0 + 2 + db)) as cb from tiles, generate_series(-3, 2) t(df), generate_series(-2, 2) u(db)),
p as (select c.*, greatest(0, least(n - 1, f0 + 2 + pf)) as af, greatest(0, least(63, b0 + 2 + pb)) as ab, greatest(0, least(n - 1, cf + pf)) as bf, greatest(0, least(63, cb + pb)) as bb from c, generate_series(-2, 1) t(pf), generate_series(-2, 1) u(pb)),
d as (select p.target, f0, b0, df, db, any_value(cf) as cf, any_value(cb) as cb, exp(-sum((x.x - y.x) * (x.x - y.x)) / 4) as w from p join m x on x.target = p.target and x.f = af and x.b = ab join m y on y.target = p.target and y.f = bf and y.b = bb group by 1, 2, 3, 4, 5),
o as (select d.target, f0, b0, least(1, greatest(0, sum(w * x.x) / sum(w))) as s from d join m x on x.target = d.target and x.f = cf and x.b = cb group by 1, 2, 3)
select m.target, m.f as stft_frame, m.b as bin, round(o.s, 5) as mask from m join o on o.target = m.target and o.f0 = m.f - m.f % 4 and o.b0 = m.b - m.b % 4"""

ORACLES["mask_dftt"] = f"""with {_MASK}, win as (select target, n, unnest(generate_series(0, n - 1, 2)) as f0, b0 from n, generate_series(0, 60, 4) t(b0)),
s as (select w.target, f0, b0, i, j, x * {_WIN} as x, (x / 2 + 0.25) * {_WIN} as g from win w, generate_series(0, 3) t(i), generate_series(0, 7) u(j), m where m.target = w.target and m.f = least(f0 + i, n - 1) and m.b = least(b0 + j, 63)),
z as (select target, f0, b0, u, v, sum(x * cos(2 * pi() * (u * i / 4.0 + v * j / 8.0))) as re, -sum(x * sin(2 * pi() * (u * i / 4.0 + v * j / 8.0))) as im, pow(sum(g * cos(2 * pi() * (u * i / 4.0 + v * j / 8.0))), 2) + pow(sum(g * sin(2 * pi() * (u * i / 4.0 + v * j / 8.0))), 2) as g from s, generate_series(0, 3) t(u), generate_series(0, 7) q(v) group by 1, 2, 3, 4, 5),
k as (select target, f0, b0, u, v, re * g / (g + 0.49) as re, im * g / (g + 0.49) as im from z),
y as (select target, f0 + i as f, b0 + j as b, {_WIN} as w, sum(re * cos(2 * pi() * (u * i / 4.0 + v * j / 8.0)) - im * sin(2 * pi() * (u * i / 4.0 + v * j / 8.0))) / 32 as y from k, generate_series(0, 3) t(i), generate_series(0, 7) q(j) group by target, f0, b0, i, j),
o as (select target, f, b, sum(y * w) as y, sum(w * w) as w from y group by 1, 2, 3)
select m.target, m.f as stft_frame, m.b as bin, round(case when o.w > 1e-8 then least(1, greatest(0, o.y / o.w)) else m.x end, 5) as mask from m join o using (target, f, b)"""
