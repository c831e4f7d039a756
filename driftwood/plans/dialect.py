"""The few places where Spark SQL and DuckDB read differently, so that one declarative text serves as plan and as twin.

An operator is a function of a dialect and the name of its input that gives SQL. `operator` turns it into a function
from DataFrames to a DataFrame; the catalog asks for the same text in the other dialect to check the results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame


class Spark:
    """Spark SQL, ANSI mode."""

    name = "spark"

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def seq(self, low: str, high: str) -> str:
        """A row for each whole number from low to high; none if high < low. Only in a select list."""
        return f"explode(case when {high} >= {low} then sequence(cast({low} as int), cast({high} as int)) else array() end)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def r(self, x: str, digits: int = 6) -> str:
        """Rounded, without a negative zero."""
        return f"(round(cast({x} as double), {digits}) + 0e0)"

    def inf(self) -> str:
        return "double('infinity')"

    def series(self, low: int, high: int, term: str) -> str:
        """The sum of a term over whole numbers k. The term may use columns."""
        return f"aggregate(sequence({low}, {high}), 0e0, (acc, k) -> acc + {term})"

    def log_gamma_half(self, twice: str) -> str:
        """ln Gamma(twice / 2) for a whole number twice >= 1, by the product of its factors."""
        odd = f"(({twice}) % 2)"
        first = f"case when {odd} = 1 then 0.5 * ln(pi()) else 0e0 end"
        factors = f"sequence(1, cast(greatest(({twice} - 1) div 2, 1) as int))"
        return f"aggregate({factors}, {first}, (acc, j_) -> acc + case when j_ > ({twice} - 1) div 2 then 0e0 else ln(j_ - 0.5 * {odd}) end)"

    def chi2_sf(self, x: str, dof: str) -> str:
        """The upper tail of chi-squared: 1 less the series of the lower incomplete gamma function."""
        z = f"(({x}) / 2)"
        terms = f"aggregate(sequence(1, 400), named_struct('t', 1e0, 's', 1e0), (acc, i_) -> named_struct('t', acc.t * {z} / (({dof}) / 2 + i_), 's', acc.s + acc.t * {z} / (({dof}) / 2 + i_)), acc -> acc.s)"
        body = f"exp(({dof}) / 2 * ln({z}) - {z} - {self.log_gamma_half(f'cast({dof} as int) + 2')} + ln({terms}))"
        return _tail(z, dof, body)

    def list_of(self, x: str, by: str) -> str:
        return f"transform(array_sort(collect_list(struct({by} as k, {x} as v))), e -> e.v)"

    def position(self, items: str, i: str) -> str:
        return f"get({items}, cast({i} as int))"

    def timestamp_hour(self, x: str) -> str:
        return f"date_trunc('HOUR', {x})"


class Duck(Spark):
    """DuckDB."""

    name = "duck"

    def table(self, name: str) -> str:
        return name

    def seq(self, low: str, high: str) -> str:
        return f"unnest(range(cast({low} as bigint), cast({high} as bigint) + 1))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def inf(self) -> str:
        return "cast('infinity' as double)"

    def series(self, low: int, high: int, term: str) -> str:
        return f"list_sum(list_transform(range({low}, {high} + 1), lambda k: {term}))"

    def log_gamma_half(self, twice: str) -> str:
        return f"lgamma(({twice}) / 2)"

    def chi2_sf(self, x: str, dof: str) -> str:
        z = f"(({x}) / 2)"
        a = f"(({dof}) / 2)"
        return _tail(z, dof, f"list_sum(list_transform(range(0, 401), lambda i_: exp(({a} + i_) * ln({z}) - {z} - lgamma({a} + i_ + 1))))")

    def list_of(self, x: str, by: str) -> str:
        return f"list({x} order by {by})"

    def position(self, items: str, i: str) -> str:
        return f"({items})[{i} + 1]"

    def timestamp_hour(self, x: str) -> str:
        return f"date_trunc('hour', {x})"


def _tail(z: str, dof: str, lower: str) -> str:
    return f"case when {z} <= 0 then 1e0 when {z} > ({dof}) / 2 + 60 + 8 * sqrt(({dof}) / 2) then 0e0 else greatest(0e0, least(1e0, 1 - {lower})) end"


SPARK, DUCK = Spark(), Duck()


def erf(x: str) -> str:
    """The five-term polynomial 7.1.26 of Abramowitz and Stegun."""
    t = f"(1 / (1 + 0.3275911e0 * abs({x})))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    return f"(case when ({x}) < 0 then -1 else 1 end * (1 - {poly} * exp(-({x}) * ({x}))))"


def two_sided_normal(d: Spark, z: str) -> str:
    """P(|Z| > |z|), exactly the chi-squared tail with one degree of freedom."""
    return d.chi2_sf(f"({z}) * ({z})", "1")


def joined(outer: str, text: str) -> str:
    """A query under further common table expressions."""
    text = text.strip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {outer}, {text.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {outer}, {text[4:].lstrip()}" if text[:5].upper().startswith("WITH") else f"WITH {outer} {text}"


def doubles(text: str) -> str:
    """The text with its decimal literals as doubles: exact decimals would round quotients."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\deE.])", r"\1e0", text)


def operator(build: Callable[..., str]) -> Callable[..., DataFrame]:
    """An operator over one or more frames; its SQL is at hand as .sql(dialect, *names, **config)."""

    @functools.wraps(build)
    def sql(*args, **config) -> str:
        return doubles(build(*args, **config))

    @functools.wraps(build)
    def apply(*frames: DataFrame, **config) -> DataFrame:
        names = {f"f{k}": f for k, f in enumerate(frames)}
        return frames[0].sparkSession.sql(sql(SPARK, *("{" + n + "}" for n in names), **config), **names)

    apply.sql = sql
    return apply
