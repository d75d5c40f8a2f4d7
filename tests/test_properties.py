"""Properties of the pure functions, on generated inputs."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paravane.functions import special
from paravane.operators import bootstrap

counts = st.lists(st.integers(0, 200), min_size=8, max_size=8).map(np.array)


@given(st.integers(0, 60), st.integers(0, 60))
def test_binomial_tail_is_the_beta_ratio(k, extra):
    n = k + extra
    want = 1.0 if k == 0 else special.beta_ratio(k, n - k + 1, 0.3)
    assert math.isclose(special.binomial_tail(k, n, 0.3), want, rel_tol=1e-9, abs_tol=1e-12)


@given(st.floats(0.51, 0.999), st.integers(1, 60))
def test_t_quantile_inverts_the_tail(p, df):
    assert math.isclose(1 - special.t_two_sided(special.t_quantile(p, df), df) / 2, p, abs_tol=1e-9)


@settings(deadline=None, max_examples=40)
@given(counts, st.integers(0, 5))
def test_bootstrap_brackets_and_bounds(cells, seed):
    observed, low, high, p = bootstrap.difference_interval(cells, 400, seed)
    assert low <= high and 0 <= p <= 1 and abs(observed) <= cells.sum()
    if cells.sum():
        found = bootstrap.paired_intervals(cells, 400, 0.95, seed)
        for point, a, b in found.values():
            assert a <= b and -1 <= a and b <= 1 and -1 <= point <= 1
        assert math.isclose(found["acc_idiomatic"][0] - found["acc_original"][0], found["delta_paraphrase"][0] + found["delta_idiom"][0], abs_tol=1e-12)


@given(st.floats(0, 500))
def test_chi2_tail_is_a_falling_probability(x):
    assert 0 <= special.chi2_tail(x + 1) <= special.chi2_tail(x) <= 1
