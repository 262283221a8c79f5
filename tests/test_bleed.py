import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.jobs import debleed
from wavemill.operators import bleed, blocks


def complex_noise(rng, *shape):
    return rng.normal(size=shape) + 1j * rng.normal(size=shape)


def test_filter_finds_the_path_and_keeps_it_while_the_target_speaks():
    rng = np.random.default_rng(1)
    paths = np.array([0.5 + 0.2j, -0.3j])[:, None] * np.ones((2, 6))
    machine = bleed.Adaptive(np.zeros((2, 6)), 0.9998, 0.5, 0.25, 24)
    for _ in range(400):
        y = complex_noise(rng, 2, 6)
        machine.step((paths * y).sum(axis=0) + 0.01 * complex_noise(rng, 6), y, [False, True, True])
    assert np.abs(machine.h - paths).max() < 0.1
    before = machine.h.copy()
    y = complex_noise(rng, 2, 6)
    machine.step(complex_noise(rng, 6) * 100, y, [True, True, True])
    assert np.allclose(machine.h, before * 0.9998)


def test_filter_returns_to_what_it_was_before_a_pause():
    rng = np.random.default_rng(2)
    machine = bleed.Adaptive(np.full((1, 4), 0.5), 0.99, 0.5, 0.25, 10)
    machine.step(complex_noise(rng, 4), complex_noise(rng, 1, 4), [True, True])
    kept = machine.h.copy()
    for _ in range(12):  # only noise: the filter drifts away
        machine.step(complex_noise(rng, 4), 0.5 * complex_noise(rng, 1, 4), [False, False])
    assert np.abs(machine.h - kept).max() > 0.05
    machine.step(complex_noise(rng, 4), complex_noise(rng, 1, 4), [False, True])
    assert np.array_equal(machine.h, kept)
    short = bleed.Adaptive(np.full((1, 4), 0.5), 0.99, 0.5, 0.25, 10)
    for active in (True, False, False, True):
        short.step(complex_noise(rng, 4), complex_noise(rng, 1, 4), [False, active])
    assert np.array_equal(short.kept[0], short.h)


def test_activity_tells_the_speaker():
    rng = np.random.default_rng(3)
    power = 1e-4 * rng.gamma(20, 1 / 20, size=(400, 3, 40))
    power[100:200, 1] += rng.exponential(size=(100, 40))
    power[100:200, 0] += 0.01 * rng.exponential(size=(100, 40))
    found = bleed.scores(power, 0) > bleed.LEAST_SCORE
    assert found[105:195, 1].mean() > 0.9 and not found[100:200, [0, 2]].any() and not found[20:95].any()


def test_noise_floor_is_the_least_of_the_last_parts():
    power = np.full((300, 1), 5.0)
    power[30:40] = 1.0
    floor = bleed.noise_floor(power, 0)[:, 0] / bleed.BIAS
    assert (floor[:30] == 5).all() and (floor[30:143] == 1).all() and (floor[143:] == 5).all()


def plain_floor(power):
    current, parts, out = np.full(power.shape[1:], np.inf), [], []
    for t, now in enumerate(power):
        current = np.minimum(current, now)
        if (t + 1) % bleed.PART == 0:
            parts, current = [*parts, current][-bleed.PARTS :], np.full(power.shape[1:], np.inf)
        out.append(bleed.BIAS * np.minimum.reduce([current, *parts]))
    return np.array(out)


def test_activity_of_spans_equals_the_whole(spark):
    rng = np.random.default_rng(4)
    n = 700
    x = complex_noise(rng, n, 3, 12) * np.exp(rng.normal(size=(n, 3, 1)))
    assert np.allclose(bleed.noise_floor(np.abs(x) ** 2, 0), plain_floor(np.abs(x) ** 2))
    rows = [("s", "t", k, x[k, 0].real.tolist(), x[k, 0].imag.tolist(), ["a", "b"], [(m, x[k, 1 + i].real.tolist(), x[k, 1 + i].imag.tolist()) for i, m in enumerate("ab")]) for k in range(n)]
    df = spark.createDataFrame(rows, "session string, target string, stft_frame long, re array<double>, im array<double>, mics array<string>, refs array<struct<track string, re array<double>, im array<double>>>")
    got = {r.stft_frame: r.scores for r in bleed.activity(df).collect()}
    want = bleed.scores(np.abs(x) ** 2, 0)
    assert len(got) == n and np.allclose([got[k] for k in range(n)], want, atol=1e-12)


def test_mask_bounds():
    rng = np.random.default_rng(5)
    machine = bleed.Wiener(20, 25.0, 0.5)
    for _ in range(10):
        x = complex_noise(rng, 20)
        assert ((mask := machine.step(x, 0 * x)) > 0.99).all() and (mask <= 1).all()
    x = complex_noise(rng, 20)
    assert bleed.Wiener(20, 25.0, 0.5).step(x, x).max() < 1e-6  # nothing but bleed
    assert bleed.Wiener(20, 0.0, 0.5).step(x, x * 0.5).min() > 0.99  # no suppression
    high = bleed.Wiener(20, 1.0, 0.5).step(np.ones(20), np.full(20, 0.3))
    assert (np.diff(high) < 0).all()  # high bins are cut more


def plain_nlm(mask, threshold, patch, tile, bins, past, ahead):
    n, width = mask.shape
    at = lambda f, b: mask[min(max(f, 0), n - 1), min(max(b, 0), width - 1)]
    out = np.empty_like(mask)
    for f0 in range(0, n, tile):
        for b0 in range(0, width, tile):
            f, b, sums, weights = f0 + tile // 2, b0 + tile // 2, 0.0, 0.0
            for g in range(f - past, f + ahead + 1):
                for c in range(b - bins, b + bins + 1):
                    g1, c1 = min(max(g, 0), n - 1), min(max(c, 0), width - 1)
                    d = sum((at(f + i, b + j) - at(g1 + i, c1 + j)) ** 2 for i in range(-patch // 2, patch // 2) for j in range(-patch // 2, patch // 2))
                    w = np.exp(-d / threshold**2)
                    sums, weights = sums + w * at(g, c), weights + w
            out[f0 : f0 + tile, b0 : b0 + tile] = sums / weights
    return out


def plain_dftt(raw, guide, threshold, frames, bins, hop_frames, hop_bins):
    n, width = raw.shape
    window = np.outer(np.hanning(frames), np.hanning(bins))
    total, weight = np.zeros_like(raw), np.zeros_like(raw)
    u, v = np.arange(frames), np.arange(bins)
    turn_f, turn_b = np.exp(-2j * np.pi * np.outer(u, u) / frames), np.exp(-2j * np.pi * np.outer(v, v) / bins)
    for f in range(0, n, hop_frames):
        for b in range(0, width, hop_bins):
            at = np.ix_(np.minimum(f + u, n - 1), np.minimum(b + v, width - 1))
            x, g = (turn_f @ (m[at] * window) @ turn_b for m in (raw, guide))
            gain = np.abs(g) ** 2 / (np.abs(g) ** 2 + threshold**2)
            y = (turn_f.conj() @ (x * gain) @ turn_b.conj()).real / (frames * bins) * window
            k, m = min(frames, n - f), min(bins, width - b)
            total[f : f + k, b : b + m] += y[:k, :m]
            weight[f : f + k, b : b + m] += (window**2)[:k, :m]
    return np.where(weight > 1e-8, np.clip(total / np.maximum(weight, 1e-8), 0, 1), raw)


@pytest.mark.parametrize("n", [1, 63, 150])
def test_smoothing_in_spans_equals_plain_forms(spark, n):
    rng = np.random.default_rng(n)
    mask = np.clip(rng.random((n, 21)) + np.linspace(-0.5, 0.5, n)[:, None], 0, 1)
    df = spark.createDataFrame([("s", "t", k, mask[k].tolist()) for k in range(n)], "session string, target string, stft_frame long, mask array<double>")
    small = {"patch": 4, "tile": 4, "bins": 2, "past": 6, "ahead": 3}
    both = bleed.smooth_dftt(bleed.smooth_nlm(df, 0.8, **small), 0.5)
    rows = sorted(both.collect(), key=lambda r: r.stft_frame)
    smooth = np.array([r.smooth for r in rows])
    assert np.allclose(smooth, plain_nlm(mask, 0.8, **small))
    assert np.allclose([r.final for r in rows], plain_dftt(mask, smooth, 0.5, 16, 32, 4, 8))
    assert [r.final for r in bleed.smooth_dftt(bleed.smooth_nlm(df, 0.0), 0.0).collect()] == [r.mask for r in df.collect()]


def test_default_tiles_equal_the_plain_form():
    mask = np.random.default_rng(8).random((20, 18))
    whole = plain_nlm(mask, 0.75, 8, 8, 8, 16, 4)
    assert np.allclose(bleed.nlm_tiles(mask, 0, 20, 0.75), whole)
    assert np.allclose(bleed.nlm_tiles(mask, 8, 8, 0.75), whole[8:16])


RATE, SIZE = 8000, 2048


def recording(spark, tracks):
    rows = [(t, 0, i, i * SIZE, x[i * SIZE : (i + 1) * SIZE].tolist()) for t, x in tracks.items() for i in range(-(-len(x) // SIZE))]
    return spark.createDataFrame(rows, "track string, channel int, block_idx long, offset long, samples array<double>")


def speech(rng, n, turns):
    """Noise with a voice's rhythm and tilt, silent outside the turns."""
    x = np.convolve(rng.normal(size=n), [1, 0.9, 0.6, 0.3])[:n] * (0.3 + np.abs(np.sin(np.arange(n) / 700)))
    on = np.zeros(n)
    for a, b in turns:
        on[int(a * RATE) : int(b * RATE)] = 1
    return 0.1 * x * on


def energy(x):
    return float((np.asarray(x) ** 2).sum())


def test_planted_bleed_is_taken_out(spark):
    rng, n = np.random.default_rng(11), 12 * RATE + 777
    one, two = speech(rng, n, [(0.5, 3), (7, 9)]), speech(rng, n, [(3.5, 6.5), (9.5, 11.5)])
    noise = 1e-5 * rng.normal(size=(3, n))
    path = np.array([0.0, 0.35, 0.1, -0.05])
    heard = one + np.convolve(two, path)[:n] + noise[0]
    tracks = {"lead": heard, "guest": two + noise[1], "alone": one + noise[2]}
    session = spark.createDataFrame([("x", "lead", "target"), ("x", "guest", "reference"), ("y", "alone", "target")], "session string, track string, role string")
    out = debleed.remove(recording(spark, tracks), session, RATE, 512, 128)
    rows = sorted(out.collect(), key=lambda r: r.block_idx)
    assert {r.track for r in rows} == {"lead"} and [r.offset for r in rows] == [i * SIZE for i in range(len(rows))]
    y = np.concatenate([r.samples for r in rows])
    assert len(y) == n
    guest, lead = slice(int(9.8 * RATE), int(11.3 * RATE)), slice(int(7.3 * RATE), int(8.8 * RATE))
    assert energy(y[guest]) < 0.05 * energy(heard[guest])  # 13 dB at least
    assert energy(y[lead] - one[lead]) < 0.1 * energy(one[lead])
    # nothing is taken out at strength zero, and every sample of the edges comes back
    same = debleed.remove(recording(spark, tracks), session, RATE, 512, 128, strength=0.0, smoothing=0.0)
    back = np.concatenate([r.samples for r in sorted(same.collect(), key=lambda r: r.block_idx)])
    assert np.abs(back - heard).max() < 1e-3


def test_a_silent_or_missing_reference_changes_little(spark):
    rng, n = np.random.default_rng(12), 3 * RATE
    one = speech(rng, n, [(0.2, 2.8)]) + 1e-5 * rng.normal(size=n)
    tracks = {"lead": one, "off": np.zeros(n), "short": 1e-5 * rng.normal(size=n // 3)}
    session = spark.createDataFrame([("x", "lead", "target"), ("x", "off", "reference"), ("x", "short", "reference"), ("x", "absent", "reference")], "session string, track string, role string")
    y = np.concatenate([r.samples for r in sorted(debleed.remove(recording(spark, tracks), session, RATE, 512, 128).collect(), key=lambda r: r.block_idx)])
    assert len(y) == n and energy(y - one) < 0.05 * energy(one)
    empty = recording(spark, {"lead": one}).limit(0)
    assert debleed.remove(empty, session, RATE, 512, 128).collect() == []


def test_missing_references_are_silent(spark):
    spectra = spark.createDataFrame([("t", 0, k, [1.0], [0.0]) for k in range(3)] + [("a", 0, 1, [2.0], [1.0])], "track string, channel int, stft_frame long, re array<double>, im array<double>")
    session = spark.createDataFrame([("s", "t", "target"), ("s", "a", "reference"), ("s", "b", "reference")], "session string, track string, role string")
    rows = sorted(bleed.frames(spectra, session).collect(), key=lambda r: r.stft_frame)
    assert [r.mics for r in rows] == [["a", "b"]] * 3 and [len(r.refs) for r in rows] == [0, 1, 0]
    assert blocks.stft is not None and bleed.frames(spectra.filter(F.lit(False)), session).collect() == []
