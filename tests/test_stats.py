import math

import numpy as np
import pytest

from tracewright.functions import stats


def test_tails_against_simulation_and_identities():
    assert stats.betainc(1, 1, 0.3) == pytest.approx(0.3)
    assert stats.betainc(2, 3, 0.4) == pytest.approx(1 - stats.betainc(3, 2, 0.6))
    assert stats.f_sf(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert stats.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-3)
    assert stats.chi2_sf(10, 4) == pytest.approx(math.exp(-5) * (1 + 5))
    p = [0.1, 0.4, 0.03]
    assert stats.fisher_combine(p) == pytest.approx(stats.chi2_sf(-2 * sum(map(math.log, p)), 6))
    assert stats.hypergeometric_sf(1, 10, 5, 1) == pytest.approx(0.5)


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ABC"), rng.integers(0, 14))) for _ in range(2))
        assert stats.smith_waterman(a, b) == brute_alignment(a, b)


def test_linkage_and_silhouette():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 9.0])
    d = np.abs(x[:, None] - x)
    merges = stats.average_linkage(d)
    assert stats.cut(merges, 6, clusters=3).tolist() == [0, 0, 0, 1, 1, 2]
    assert stats.cut(merges, 6, height=1.0).tolist() == [0, 0, 0, 1, 1, 2]
    assert stats.silhouette(d, np.array([0, 0, 0, 1, 1, 2])) > 0.7 > stats.silhouette(d, np.array([0, 1, 0, 1, 0, 1]))


def test_change_points():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.3, 60), rng.normal(3, 0.3, 60), rng.normal(-2, 0.3, 60)]
    cuts = stats.pelt((x - x.mean()) / x.std(), 1.5 * math.log(180))
    assert len(cuts) == 2 and abs(cuts[0] - 60) <= 2 and abs(cuts[1] - 120) <= 2
    assert stats.pelt(rng.normal(size=60), 1.5 * math.log(60)) == []
