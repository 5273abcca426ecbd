"""Column builders: rounding, bands, ratios that stay null, calendars, option prices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int = 4) -> Column:
    """Halves (and what lies a ten-thousandth of a unit under them) upward, so that the order of a sum does not matter."""
    scale = 10.0**places
    return F.floor(col(x) * scale + 0.5001) / scale


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def half_up(x: Column | str) -> Column:
    """Rounding of halves toward plus infinity."""
    return F.floor(col(x) + 0.5).cast("long")


def banded(x: Column | str, steps: list[tuple[str, float, float]], otherwise: float) -> Column:
    """A score by ordered comparisons (operator, bound, score); null stays null."""
    x = col(x)
    tests = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b}
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for op, bound, score in steps:
        out = out.when(tests[op](bound), float(score))
    return out.otherwise(float(otherwise))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Mean by weights over the parts that are not null; null if none is."""
    total = sum(F.coalesce(s * w, F.lit(0.0)) for s, w in parts)
    weight = sum(F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts)
    return F.try_divide(total, F.when(weight > 0, weight))


def growth_rate(first: Column, last: Column, span: Column) -> Column:
    """Compound annual growth, null unless both ends are positive and the span is a year at least."""
    return F.when((first > 0) & (last > 0) & (span >= 1), F.pow(ratio(last, first), F.lit(1.0) / span) - 1)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_share(x, m=F):
    """The normal distribution function by the five-term approximation of the error function, over columns or (m=np) arrays.

    The coefficients are the fixed values of Abramowitz and Stegun's formula 7.1.26.
    """
    p, terms = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = m.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    series = 0.0 * t
    for a in reversed(terms):
        series = (series + a) * t
    erf = m.sign(x) * (1 - series * m.exp(-z * z))
    return 0.5 * (1 + erf)


def option_terms(s: Column, k: Column, t: Column, rate: Column, sigma: Column) -> dict[str, Column]:
    """European call and put prices and their sensitivities: vega and rho per point, theta per day."""
    root = sigma * F.sqrt(t)
    d1 = (F.log(s / k) + (rate + sigma * sigma / 2) * t) / root
    d2 = d1 - root
    paid = k * F.exp(-rate * t)
    n1, n2, m1, m2, density = normal_share(d1), normal_share(d2), normal_share(-d1), normal_share(-d2), normal_density(d1)
    decay = -s * density * sigma / (2 * F.sqrt(t))
    return {
        "call": s * n1 - paid * n2,
        "put": paid * m2 - s * m1,
        "delta_call": n1,
        "delta_put": n1 - 1,
        "gamma": density / (s * root),
        "vega": s * density * F.sqrt(t) * 0.01,
        "theta_call": (decay - rate * paid * n2) / 365,
        "theta_put": (decay + rate * paid * m2) / 365,
        "rho_call": paid * t * n2 * 0.01,
        "rho_put": -paid * t * m2 * 0.01,
    }


def _call(s, k, t, rate, sigma):
    """option_terms' call price over arrays."""
    root = sigma * np.sqrt(t)
    d1 = (np.log(s / k) + (rate + sigma * sigma / 2) * t) / root
    return s * normal_share(d1, np) - k * np.exp(-rate * t) * normal_share(d1 - root, np)


def implied_volatility(price: Column, s: Column, k: Column, t: Column, rate: Column, low: float = 0.001, high: float = 5.0, steps: int = 20) -> Column:
    """The volatility whose call price is `price`, by bisection (5 / 2 ** 20 is under 1e-5); null where none in [low, high] has it, or a value is null or not positive.

    Halved over whole batches: a fold of built-in functions works every term out anew at each of its uses.
    """

    @F.pandas_udf("double")
    def found(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, rate: pd.Series) -> pd.Series:
        p, s, k, t, rate = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (price, s, k, t, rate))
        s, k, t = (np.where(x > 0, x, np.nan) for x in (s, k, t))
        a, b = np.full(len(p), low), np.full(len(p), high)
        inside = (_call(s, k, t, rate, a) <= p) & (p <= _call(s, k, t, rate, b))
        for _ in range(steps):
            middle = (a + b) / 2
            under = _call(s, k, t, rate, middle) < p
            a, b = np.where(under, middle, a), np.where(under, b, middle)
        return pd.Series((a + b) / 2).astype(object).where(inside, None)

    return found(price, s, k, t, rate)


def week_label(d: Column | str) -> Column:
    """ISO week as YYYY-Www."""
    d = col(d)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
