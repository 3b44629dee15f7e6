"""Tail probabilities as expressions of a fixed number of steps, at any statistic and any degrees of freedom.

A tail is its density at the border times the integral of the density's ratio from there on. The integral is a sum over the
nodes of a double exponential rule, which is as exact for a bell as for a steep decay, once its step is the border's scale.
Everything is in logarithms, so a tail underflows to 0 and never turns into 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Step and ends of the rule: 139 nodes, an error of some 1e-14.
STEP, FIRST, LAST = 0.06, -3.4, 4.9


def _nodes() -> list[tuple[float, float]]:
    """(node, weight) for an integral over the positive half-line."""
    ys = [FIRST + STEP * i for i in range(math.ceil((LAST - FIRST) / STEP))]
    return [(g := math.exp(y - math.exp(-y)), STEP * g * (1 + math.exp(-y))) for y in ys]


def _integral(log_ratio: Callable[[Column], Column]) -> Column:
    nodes = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(w).alias("w")) for g, w in _nodes()))
    return F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["w"] * F.exp(log_ratio(n["g"])))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _stirling(a: Column) -> Column:
    x = 1 / (a * a)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x * (1 / 1188 - x * (691 / 360360)))))) / a


def _scaled_gamma(a: Column) -> Column:
    """a log a - a - log gamma(a): without the large terms that cancel."""
    z = a + 8
    log_gamma = z * F.log(z) - z - 0.5 * F.log(z / (2 * math.pi)) + _stirling(z) - sum((F.log(a + j) for j in range(1, 8)), F.log(a))
    return F.when(a >= 8, 0.5 * F.log(a / (2 * math.pi)) - _stirling(a)).otherwise(a * F.log(a) - a - log_gamma)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X >= x) for a chi-squared X of `df` degrees of freedom, whole or not (STA06). Null where x or df is null or NaN, or df isn't positive."""

    def tail(s: Column) -> Column:
        a, u, scale = s["a"], s["u"], s["scale"]
        e = F.exp(u)
        side = F.signum(u) + (u == 0).cast("double")
        total = _integral(lambda g: a * (side * scale * g - e * F.expm1(side * scale * g)))
        part = F.exp(_scaled_gamma(a) + a * (u - F.expm1(u))) * scale * total
        return F.when(side > 0, part).otherwise(1 - part)

    a, half = df.cast("double") / 2, x.cast("double") / 2
    u = F.when(F.abs(half - a) < a / 2, F.log1p((half - a) / a)).otherwise(F.log(half / a))
    known = x.isNotNull() & ~F.isnan(x.cast("double")) & (df > 0)
    return F.when(known & (x <= 0), 1.0).when(known & (half == float("inf")), 0.0).when(known, _with(F.struct(a.alias("a"), u.alias("u")), lambda s: _with(F.struct(s["a"].alias("a"), s["u"].alias("u"), (1 / (s["a"] * F.abs(F.expm1(s["u"])) + F.sqrt(s["a"]))).alias("scale")), tail)))


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z."""
    return chi2_tail(z * z, F.lit(1))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's T of `df` degrees of freedom. Null as chi2_tail."""

    def log_cosh(w: Column) -> Column:
        return F.when(w < 300, F.log1p(2 * F.pow(F.sinh(w / 2), 2))).otherwise(w - math.log(2))

    def tail(s: Column) -> Column:
        n, w = s["n"], s["w"]
        a = n / 2
        scale = 1 / (n * F.tanh(w) + F.sqrt(n))
        lead = a * F.log1p(0.5 / a) + 0.5 * F.log(a + 0.5) - 0.5 - _scaled_gamma(a + 0.5) + _scaled_gamma(a) - 0.5 * math.log(math.pi)
        total = _with(F.struct(n.alias("n"), w.alias("w"), scale.alias("scale"), log_cosh(w).alias("at")), lambda r: _integral(lambda g: -r["n"] * (log_cosh(r["w"] + r["scale"] * g) - r["at"])))
        return F.least(2 * F.exp(lead - n * log_cosh(w)) * scale * total, F.lit(1.0))

    n, x = df.cast("double"), F.abs(t.cast("double"))
    known = x.isNotNull() & ~F.isnan(x) & (df > 0)
    w = F.when(x < float("inf"), F.asinh(x / F.sqrt(n)))
    return F.when(known & (x == float("inf")), 0.0).when(known, _with(F.struct(n.alias("n"), w.alias("w")), tail))


def t_quantile(p: Column, df: Column) -> Column:
    """The t that |T| reaches or exceeds with probability p, in (0, 1): 0.05 gives the factor of a 95 % interval. 60 halvings in log t, so a relative error of 1e-15; null as t_two_sided."""
    low, high = math.log(1e-8), math.log(1e8)
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return _with(F.struct(middle.alias("m"), (t_two_sided(F.exp(middle), df) > p).alias("more")), lambda r: F.when(r["more"], F.struct(r["m"].alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), r["m"].alias("high"))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halved)
    return F.when((df > 0) & (p > 0) & (p < 1), F.exp((found["low"] + found["high"]) / 2))
