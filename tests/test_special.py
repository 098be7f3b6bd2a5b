import math

import numpy as np

from quern.functions import special as s
from quern.functions.stats import theta_ml


def test_tails_against_known_values():
    assert abs(s.norm_sf(1.959963984540054) - 0.025) < 1e-12
    assert abs(s.norm_isf(0.025)[0] - 1.959963984540054) < 1e-9
    assert s.norm_isf([0.0, 1.0]).tolist() == [math.inf, -math.inf]
    assert abs(s.t_sf(2.0, 10) - 0.03669401738537018) < 1e-12
    assert abs(s.t_sf(-2.0, 10) + s.t_sf(2.0, 10) - 1) < 1e-12
    for df in (1, 4, 7, 50):
        for x in (0.1, 3.0, 20.0, 80.0):
            if df % 2 == 0:
                exact = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
                assert abs(s.chi2_sf(x, df) - exact) < 1e-12
    assert abs(s.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    total = sum(math.comb(5, i) * math.comb(5, 4 - i) for i in (3, 4)) / math.comb(10, 4)
    assert abs(s.hypergeom_sf_at(3, 10, 5, 4) - total) < 1e-12


def test_gamma_family():
    assert abs(s.digamma(1.0)[0] + 0.5772156649015329) < 1e-12
    assert abs(s.trigamma(1.0)[0] - math.pi**2 / 6) < 1e-12
    grid = np.linspace(1e-6, 60, 600_001)
    assert abs(np.trapezoid(s.gamma_pdf(grid, 2.5, 1.5), grid) - 1) < 1e-6
    assert abs(np.trapezoid(s.norm_pdf(np.linspace(-9, 9, 10_001)), np.linspace(-9, 9, 10_001)) - 1) < 1e-9


def test_dispersion_is_recovered():
    rnd = np.random.default_rng(3)
    mu = np.full(20_000, 5.0)
    y = rnd.negative_binomial(2.0, 2.0 / (2.0 + mu))
    assert abs(theta_ml(y.astype(float), mu) - 2.0) < 0.15
