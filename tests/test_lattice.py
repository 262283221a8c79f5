import numpy as np
import pytest

from wavemill.operators import blocks, lattice


def plainly(x, k):
    z, out = np.zeros(k.shape[1]), []
    for v, row in zip(x, k):
        for s, r in enumerate(row):
            c = np.sqrt(1 - r * r)
            v, z[s] = c * z[s] - r * v, c * v + r * z[s]
        out.append(v)
    return np.array(out), z


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_run_equals_sample_by_sample(n):
    rng = np.random.default_rng(n)
    x, k = rng.normal(size=n), np.clip(rng.normal(size=(n, 8)), -lattice.LARGEST, lattice.LARGEST)
    y, z = lattice.run(x[:, None], k, np.zeros((8, 1)))
    want, ends = plainly(x, k)
    assert np.allclose(y[:, 0], want, atol=1e-11) and np.allclose(z[:, 0], ends, atol=1e-11)
    assert (y**2).sum() + (z**2).sum() == pytest.approx((x**2).sum())  # no energy is added or lost


def test_no_coefficients_are_a_delay():
    x = np.random.default_rng(1).normal(size=50)
    assert np.allclose(lattice.run(x[:, None], np.zeros((50, 8)), np.zeros((8, 1)))[0][:, 0], [*[0] * 8, *x[:42]])


def test_what_sections_held_is_forgotten():
    k = np.full((lattice.MEMORY, 8), lattice.LARGEST)
    assert np.abs(lattice.run(np.zeros((lattice.MEMORY, 8)), k, np.eye(8))[1]).max() < 1e-16


@pytest.mark.parametrize("size", [7, 64, 1000, 4096])
def test_any_block_size(spark, size):
    rng = np.random.default_rng(3)
    x, rows = rng.normal(size=(2, 3000)), rng.uniform(-1.2, 1.2, size=(20, 8))
    df = spark.createDataFrame([("t", c, i, i * size, x[c][i * size : (i + 1) * size].tolist()) for c in range(2) for i in range(-(-3000 // size))] + [("none", 0, 0, 0, x[0][:5].tolist())], "track string, channel int, block_idx long, offset long, samples array<double>")
    trajectory = spark.createDataFrame([("t", i, r.tolist()) for i, r in enumerate(rows)], "track string, row int, k array<double>")
    out = blocks.to_samples(lattice.apply(df, trajectory, 128, strength=0.8)).toPandas().sort_values("frame")
    k = lattice.coefficients(rows, 0, 20, 0, 3000, 128, 0.8)
    for c in range(2):
        got = out[(out.track == "t") & (out.channel == c)].value.to_numpy()
        assert np.allclose(got, plainly(x[c], k)[0], atol=1e-11)
        assert (got**2).sum() <= (x[c] ** 2).sum() * (1 + 1e-12)
    assert (out[out.track == "none"].value == 0).all()


def test_reflections_of_known_denominators():
    k = np.random.default_rng(5).uniform(-0.9, 0.9, size=(30, 8))
    a = np.ones((30, 1))
    for m in range(8):  # the recursion upwards
        a = np.concatenate([a, np.zeros((30, 1))], axis=1)
        a = a + k[:, m : m + 1] * a[:, ::-1]
    assert np.allclose(lattice.reflections(a), k)
    assert (np.abs(lattice.reflections(np.array([[1.0, 5.0, -9.0], [2.0, np.nan, 1.0]]))) <= lattice.LARGEST).all()


def test_blocks_with_their_own_coefficients_side_by_side():
    """before, each block went through alone."""
    random = np.random.default_rng(4)
    x, k, state = random.normal(size=(100, 6, 1)), random.uniform(-0.9, 0.9, (100, 6, 3)), random.normal(size=(3, 6, 1))
    y, z = lattice.run(x, k, state)
    for b in range(6):
        alone, end = lattice.run(x[:, b], k[:, b], state[:, b])
        assert np.allclose(y[:, b], alone) and np.allclose(z[:, b], end)
