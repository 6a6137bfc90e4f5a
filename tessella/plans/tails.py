"""Tail probabilities as SQL, by power series; arguments are column names or short expressions."""

from __future__ import annotations


def chi2_sf(x: str, df: str) -> str:
    """1 - P(df / 2, x / 2) by the series of the lower incomplete gamma function."""
    a, z = f"(({df}) / 2.0::DOUBLE)", f"(({x}) / 2.0::DOUBLE)"
    return f"(CASE WHEN {z} <= 0 THEN 1.0::DOUBLE WHEN {z} > 300 THEN 0.0::DOUBLE ELSE greatest(1 - list_sum(list_transform(range(0, 900), lambda i: exp(({a} + i) * ln({z}) - {z} - lgamma({a} + i + 1)))), 0) END)"


def normal_two_sided(z: str) -> str:
    return chi2_sf(f"({z}) ** 2", "1")


def normal_sf(z: str) -> str:
    return f"(CASE WHEN ({z}) > 0 THEN {normal_two_sided(z)} / 2 ELSE 1 - {normal_two_sided(z)} / 2 END)"


def beta(x: str, a: str, b: str) -> str:
    """I_x(a, b), by the series on the side where its terms fall fast."""

    def side(x: str, a: str, b: str) -> str:
        return f"list_sum(list_transform(range(0, 2500), lambda i: exp(({a} + i) * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b} + i) - lgamma({a} + 1 + i) - lgamma({b}))))"

    x, a, b = f"({x})", f"({a})", f"({b})"
    return f"(CASE WHEN {x} <= 0 THEN 0.0::DOUBLE WHEN {x} >= 1 THEN 1.0::DOUBLE WHEN {x} <= 0.5 THEN {side(x, a, b)} ELSE 1 - {side(f'(1 - {x})', b, a)} END)"


def t_two_sided(t: str, df: str) -> str:
    return beta(f"({df}) / (({df}) + ({t}) ** 2)", f"({df}) / 2.0::DOUBLE", "0.5::DOUBLE")


def f_sf(x: str, a: str, b: str) -> str:
    return beta(f"({b}) / (({b}) + ({a}) * ({x}))", f"({b}) / 2.0::DOUBLE", f"({a}) / 2.0::DOUBLE")


def choose(n: str, k: str) -> str:
    """Logarithm of the binomial coefficient."""
    return f"(lgamma(({n}) + 1.0::DOUBLE) - lgamma(({k}) + 1.0::DOUBLE) - lgamma(({n}) - ({k}) + 1.0::DOUBLE))"


def poisson_cdf(k: str, mean: str) -> str:
    """P(X <= k), term by term, for any mean above 0."""
    return f"coalesce(list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(i * ln({mean}) - {mean} - lgamma(i + 1.0::DOUBLE)))), 0)"
