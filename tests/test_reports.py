import numpy as np
import pytest

from wavemill.jobs.reports import loudness_normalize, loudness_report, true_peak_normalize
from wavemill.operators.lineage import settle


@pytest.fixture(scope="module")
def speech(spark):
    rate, rows = 4000, []
    rng = np.random.default_rng(42)
    for track, level in ((1, 0.05), (2, 0.3), (3, 0.0)):
        t = np.arange(5 * rate) / rate
        x = level * (np.sin(2 * np.pi * 220 * t) + 0.3 * np.sin(2 * np.pi * 880 * t) + 0.3 * rng.uniform(-1, 1, len(t)))
        rows += [(track, 0, i, i * 4096, x[i * 4096 : (i + 1) * 4096].tolist()) for i in range(-(-len(x) // 4096))]
    return spark.createDataFrame(rows, "track long, channel int, block_idx long, offset long, samples array<double>").persist()


def test_normalisations(speech):
    got = {r.track: r for r in loudness_report(settle(loudness_normalize(speech, 4000, -23)), 4000).collect()}
    assert got[1].lufs == pytest.approx(-23, abs=0.01) and got[3].lufs == float("-inf")
    got = {r.track: r for r in loudness_report(settle(true_peak_normalize(speech, -2)), 4000).collect()}
    assert 20 * np.log10(got[2].true_peak) == pytest.approx(-2, abs=1e-6)
