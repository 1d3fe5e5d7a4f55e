import math

from tabsleuth.functions.stats import betainc_reg, chi2_survival, f_survival


def test_chi_square_tail_at_any_degrees_of_freedom():
    # an even number of degrees has a finite sum; a mean-centred one is known to be a little below one half
    for k in (2, 4, 10, 60):
        for x in (0.5, 5.0, 40.0, 200.0):
            want = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))
            assert abs(chi2_survival(x, k) - want) < 1e-12
    for k in (1e6, 1e8, 1e10):
        assert abs(chi2_survival(k, k) - (0.5 - math.sqrt(2 / k) / (3 * math.sqrt(2 * math.pi)) * math.sqrt(2) / math.sqrt(2))) < 2e-4
        z = chi2_survival(k + 2 * math.sqrt(2 * k), k)
        assert abs(z - 0.0228) < 2e-3
    a, b = chi2_survival(1.99e6 + 900, 1.99e6), chi2_survival(2.01e6 + 900, 2.01e6)  # on either side of the expansion's start
    assert abs(a - b) < 2e-3


def test_f_tail_with_two_numerator_degrees_is_closed():
    for d2 in (3.0, 50.0, 1e4, 1e7, 1e10):
        for f in (0.1, 1.0, 3.0, 20.0):
            want = math.exp(-(d2 / 2) * math.log1p(2 * f / d2))
            assert abs(f_survival(f, 2, d2) - want) < 1e-9 * want + 1e-300
    assert abs(betainc_reg(2.0, 3.0, 0.4) - 0.5248) < 1e-12
    assert abs(f_survival(1.0, 1e6, 1e6) - 0.5) < 1e-6
