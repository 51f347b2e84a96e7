import math

import numpy as np
import pytest

from fenceline.functions import special as s


def test_published_quantiles():
    assert s.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert 2 * s.norm_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert s.t_sf(2.2281388519649385, 10) == pytest.approx(0.025, abs=1e-10)
    assert s.t_isf(0.025, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert s.t_sf(-1.0, 1) == pytest.approx(0.75, abs=1e-12)
    assert s.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-11)
    assert s.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-11)
    assert s.f_sf(4.102821015303491, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert s.t_sf(1.5, 5e7) == pytest.approx(s.norm_sf(1.5), rel=1e-6)


def test_grubbs_critical_value():
    assert s.grubbs_critical(11, 0.05) == pytest.approx(2.355, abs=1e-3)


def test_shapiro_wilk_textbook_sample():
    w, p = s.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=2e-3)
    assert p == pytest.approx(0.0067, abs=5e-4)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 12, 1999, 2002, 5001, 60_000])
def test_sums_of_normal_scores(n):
    scores = np.array([s.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    assert s.score_sums(np.arange(n + 1), n) == pytest.approx(np.concatenate(([0.0], np.cumsum(scores))), abs=1e-9)
    if n > 5:
        outer, second, rest = s._shapiro_weights(n)
        assert 2 * (outer**2 + second**2) + rest**2 * float(scores[2:-2] @ scores[2:-2]) == pytest.approx(1.0, abs=1e-10)


def test_fisher_exact():
    assert s.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495, abs=1e-9)
    assert s.fisher_two_sided(5, 5, 5, 5) == pytest.approx(1.0, abs=1e-9)
    # large totals stay quick and finite
    assert 0 <= s.fisher_two_sided(3, 500_000, 9, 700_000) <= 1


def test_mann_whitney_exact_textbook():
    assert s.mann_whitney_exact(17, 5, 4) == pytest.approx(1 / 9, abs=1e-9)


def test_mann_whitney_exact_at_every_size():
    def counts(m, n):  # orders by U, by the last value's sample
        if not m or not n:
            return {0: 1}
        out = {}
        for part, shift in ((counts(m - 1, n), n), (counts(m, n - 1), 0)):
            for u, k in part.items():
                out[u + shift] = out.get(u + shift, 0) + k
        return out

    for m, n in ((1, 1), (1, 9), (2, 7), (3, 3), (5, 4), (4, 8), (6, 6)):
        by_u = counts(m, n)
        for u in by_u:
            tail = sum(k for v, k in by_u.items() if v <= min(u, m * n - u))
            expected = min(1.0, 2 * tail / sum(by_u.values()))
            assert s.mann_whitney_exact(u, m, n) == s.mann_whitney_exact(u, n, m) == pytest.approx(expected, rel=1e-12)
    # a lone outlier keeps its p on both sides of any size; far more normal rows cost no more
    for n in (100_000, 100_001, 10**9):
        assert s.mann_whitney_p(n, 1, n, 0) == pytest.approx(2 / (n + 1), rel=1e-12)
        assert s.mann_whitney_p(0, n, 2, 0) == pytest.approx(4 / ((n + 2) * (n + 1)), rel=1e-12)
    n = 10**6
    assert s.mann_whitney_p(4.0 * n, 8, n, 0) == pytest.approx(1.0, abs=1e-5)
    for u in (2.5e6, 3e6, 3.7e6):  # the middle agrees with the normal approximation
        assert s.mann_whitney_exact(u, 8, n) == pytest.approx(s.mann_whitney_p(u, 8, n, 1e-9), abs=0.01)


def test_polygamma():
    assert s.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert s.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-9)
    x = np.array([3.5, 40.0])
    assert s.digamma(x + 1) - s.digamma(x) == pytest.approx(1 / x, abs=1e-10)


def test_log_norm_cdf_far_tail_is_continuous():
    z = np.array([-29.99999, -30.00001])
    a, b = s.log_norm_cdf(z)
    assert a == pytest.approx(b, rel=1e-5)
