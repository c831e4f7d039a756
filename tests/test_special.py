"""Special functions and other shared text against values from elsewhere, as both engines read the same formulas."""

import math

import pytest

from driftwood.plans.dialect import DUCK, SPARK, doubles, erf


def sf(x, dof):
    """The upper tail of chi-squared by its finite sums."""
    z = x / 2
    if dof % 2 == 0:
        return math.exp(-z) * sum(z**k / math.factorial(k) for k in range(dof // 2))
    return math.erfc(math.sqrt(z)) + math.exp(-z) * sum(z ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (dof + 1) // 2))


CASES = [(10.0, 5), (27.0, 27), (55.178571, 49), (0.5, 1), (3.84, 1), (120.0, 10), (0.0, 4), (900.0, 3), (96.0, 96)]


def test_chi_squared_tail(spark):
    import duckdb

    for x, k in CASES:
        want = sf(x, k)
        # the degrees of freedom come from a column named as a lambda variable might be
        mine = spark.sql(f"SELECT {SPARK.chi2_sf('x', 'k - 1')} AS p FROM (SELECT {x}D AS x, {k + 1} AS k)").first().p
        theirs = duckdb.sql(f"SELECT {DUCK.chi2_sf('x', 'k - 1')} AS p FROM (SELECT {x}::double AS x, {k + 1} AS k)").fetchall()[0][0]
        assert mine == pytest.approx(want, abs=1e-10) and theirs == pytest.approx(want, abs=1e-10)


def test_log_gamma_of_halves(spark):
    for twice in (1, 2, 3, 4, 7, 10, 21, 400):
        assert spark.sql(f"SELECT {SPARK.log_gamma_half('n')} AS g FROM (SELECT {twice} AS n)").first().g == pytest.approx(math.lgamma(twice / 2), abs=1e-9)


def test_erf_and_literals(spark):
    for x in (-2.0, -0.3, 0.0, 0.7, 3.0):
        assert spark.sql(doubles(f"SELECT {erf(f'({x}D)')} AS e")).first().e == pytest.approx(math.erf(x), abs=2e-7)
    assert doubles("0.5 * x1.y + 1.25e-3 - 3") == "0.5e0 * x1.y + 1.25e-3 - 3"
