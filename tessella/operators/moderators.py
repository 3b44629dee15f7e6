"""What follows a pool of studies: tail probabilities, subgroups, moderators, refits, small-study effects, plot data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.tails import chi2_tail, t_quantile, t_two_sided, two_sided
from tessella.operators.synthesis import drop_reason, pool
from tessella.storage import stored

#: Half the width of a 95 % interval in standard errors.
Z95 = 1.959963984540054


def interval(estimate: Column, se: Column) -> tuple[Column, Column]:
    return estimate - Z95 * se, estimate + Z95 * se


def inference(effects: DataFrame, group: list[str]) -> DataFrame:
    """(group, k, estimate, low, high, p, q_p, pi_low, pi_high) of the random-effects pool (STA05, STA06).

    q_p is null where heterogeneity isn't estimable, that is, where Q is no larger than its degrees of freedom. The
    prediction interval takes in tau2.
    """
    pooled = pool(effects, group)
    low, high = interval(F.col("dl"), F.col("dl_se"))
    pi_low, pi_high = interval(F.col("dl"), F.sqrt(F.col("dl_se") * F.col("dl_se") + F.col("tau2")))
    df = F.col("k") - 1
    return pooled.select(*group, "k", F.col("dl").alias("estimate"), low.alias("low"), high.alias("high"), two_sided(F.col("dl") / F.col("dl_se")).alias("p"), F.when(F.col("q") > df, chi2_tail(F.col("q"), df)).alias("q_p"), pi_low.alias("pi_low"), pi_high.alias("pi_high"))


def hartung_knapp(effects: DataFrame, group: list[str], level: float = 0.05) -> DataFrame:
    """(group, k, estimate, se, t, low, high, p) of the random-effects pool with Hartung and Knapp's standard error and Student's t on k - 1 degrees of freedom (STA05).

    A group of one row has an estimate alone. Equal studies have a standard error of 0: then t, p and the interval are null.
    """
    pooled = pool(effects, group).select(*group, "k", F.col("dl").alias("estimate"), F.col("hk_se").alias("se"))
    df = F.col("k") - 1
    t = F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))
    half = F.when(F.col("se") > 0, t_quantile(F.lit(level), df) * F.col("se"))
    return pooled.select("*", t.alias("t"), half.alias("half")).select(*group, "k", "estimate", "se", "t", (F.col("estimate") - F.col("half")).alias("low"), (F.col("estimate") + F.col("half")).alias("high"), t_two_sided(F.col("t"), df).alias("p"))


def _usable(effects: DataFrame) -> DataFrame:
    return effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).withColumn("vi", F.col("sei") * F.col("sei"))


def _sum(x: Column, w: str = "w") -> Column:
    return F.sum(F.col(w) * x)


def subgroup_test(effects: DataFrame, group: list[str], by: str) -> DataFrame:
    """(group, k, levels, tau2, qm, df, p): do the levels of `by` differ? (STA07)

    The model has a mean for each level and one tau2 for all, by the method of moments from what heterogeneity the levels
    leave. All is made of sums by level. Rows of no level are left out; with one level there is nothing to test.
    """
    rows = _usable(effects).where(F.col(by).isNotNull()).withColumn("w", 1 / F.col("vi"))
    y = F.col("yi")
    sums = rows.groupBy(*group, by).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), _sum(y).alias("swy"), _sum(F.col("w")).alias("sw2"), _sum(y * y).alias("swyy"))
    left = sums.groupBy(*group).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("levels"), F.sum(F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")).alias("qe"), F.sum(F.col("sw") - F.col("sw2") / F.col("sw")).alias("c"))
    left = left.where("levels > 1").select(*group, "k", "levels", F.when(F.col("c") > 0, F.greatest((F.col("qe") - F.col("k") + F.col("levels")) / F.col("c"), F.lit(0.0))).otherwise(0.0).alias("tau2"))
    again = rows.drop("w").join(left, group).withColumn("w", 1 / (F.col("vi") + F.col("tau2")))
    means = again.groupBy(*group, by, "k", "levels", "tau2").agg(F.sum("w").alias("sw"), _sum(y).alias("swy"))
    out = means.groupBy(*group, "k", "levels", "tau2").agg((F.sum(F.col("swy") * F.col("swy") / F.col("sw")) - F.sum("swy") * F.sum("swy") / F.sum("sw")).alias("qm"))
    df = F.col("levels") - 1
    return out.select(*group, "k", "levels", "tau2", "qm", df.alias("df"), chi2_tail(F.col("qm"), df).alias("p"))


def meta_regression(effects: DataFrame, group: list[str], moderator: str) -> DataFrame:
    """(group, k, tau2, intercept, slope, slope_se, low, high, qm, p, caution): a regression on one moderator (STA07).

    tau2 by the method of moments; all from sums. caution where a group has fewer than ten studies. Rows without the moderator are
    left out, and so are groups of fewer than three rows or of one value. On sei it is Egger's test (STA08).
    """
    rows = _usable(effects).withColumn("x", F.col(moderator).cast("double")).where("x IS NOT NULL AND NOT isnan(x)").withColumn("w", 1 / F.col("vi"))
    x, y = F.col("x"), F.col("yi")

    def sums(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*group, *by).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("s"), _sum(x).alias("sx"), _sum(x * x).alias("sxx"), _sum(y).alias("sy"), _sum(x * y).alias("sxy"), _sum(y * y).alias("syy"), _sum(F.col("w")).alias("t"), _sum(F.col("w") * x).alias("tx"), _sum(F.col("w") * x * x).alias("txx"))

    c = {n: F.col(n) for n in ("s", "sx", "sxx", "sy", "sxy", "syy", "t", "tx", "txx", "k")}
    det = c["s"] * c["sxx"] - c["sx"] * c["sx"]
    slope, start = (c["s"] * c["sxy"] - c["sx"] * c["sy"]) / det, (c["sxx"] * c["sy"] - c["sx"] * c["sxy"]) / det
    qe = c["syy"] - start * c["sy"] - slope * c["sxy"]
    trace = c["s"] - (c["sxx"] * c["t"] - 2 * c["sx"] * c["tx"] + c["s"] * c["txx"]) / det
    first = sums(rows).where((F.col("k") > 2) & (det > 1e-12 * c["s"] * c["sxx"]))
    tau = first.select(*group, F.greatest((qe - (c["k"] - 2)) / trace, F.lit(0.0)).alias("tau2"))
    out = sums(rows.drop("w").join(tau, group).withColumn("w", 1 / (F.col("vi") + F.col("tau2"))), "tau2")
    out = out.select(*group, "k", "tau2", start.alias("intercept"), slope.alias("slope"), F.sqrt(c["s"] / det).alias("slope_se"))
    low, high = interval(F.col("slope"), F.col("slope_se"))
    z = F.col("slope") / F.col("slope_se")
    return out.select(*group, "k", "tau2", "intercept", "slope", "slope_se", low.alias("low"), high.alias("high"), (z * z).alias("qm"), two_sided(z).alias("p"), (F.col("k") < 10).alias("caution"))


#: Points at which sums over an analysis are taken for each stretch of SPAN in the logarithm of tau2 and the least variance.
POINTS, SPAN = 16, 1.0
#: A study of more than this share of a sum is not subtracted from it; the others are summed instead.
LARGEST_SHARE = 1e-3


def refits(effects: DataFrame, group: list[str], study: str) -> DataFrame:
    """(group, study, estimate, se, p): the random-effects pool without each study (STA09).

    tau2 without a study follows from the group's sums less its own. The second pass needs the sums of 1 / (v + tau2) and y / (v + tau2) over
    the others, at the tau2 of each study. As functions of u = log(tau2 + least v) these have no singularity within pi of the real line, so
    a polynomial through the sums at 16 points of a stretch of length 1 is as exact as a double (12.6 to the -16th power). So the
    work is some 16 times the rows for each stretch in which a tau2 lies, most often one. Studies too heavy to be subtracted without a
    loss of digits, at most some thousands, and those of small analyses, are summed over the others one by one.
    """
    rows = stored(_usable(effects).withColumn("w", 1 / F.col("vi")).select(*group, F.col(study).alias("_study"), "yi", "vi", "w"))
    y, v = F.col("yi"), F.col("vi")
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), _sum(y).alias("swy"), _sum(F.col("w")).alias("sw2"), _sum(y * y).alias("swyy")).where("k > 2")
    rest = {n: F.col(n) - x for n, x in (("sw", F.col("w")), ("swy", F.col("w") * y), ("sw2", F.col("w") * F.col("w")), ("swyy", F.col("w") * y * y))}
    q, c = rest["swyy"] - rest["swy"] * rest["swy"] / rest["sw"], rest["sw"] - rest["sw2"] / rest["sw"]
    told = rows.where("_study IS NOT NULL")
    without = told.join(sums, group).select(*group, "_study", "yi", "vi", F.greatest((q - (F.col("k") - 2)) / c, F.lit(0.0)).alias("tau2"))
    without = without.groupBy(*group, "_study").agg(F.collect_list(F.struct("yi", "vi", "tau2")).alias("own"))
    low = told.groupBy(*group).agg(F.min("vi").alias("v0"))
    without = stored(without.join(low, group).select(*group, "_study", "own", "v0", F.explode("own.tau2").alias("tau2")).withColumn("u", F.log(F.col("tau2") + F.col("v0"))).withColumn("stretch", F.floor(F.col("u") / SPAN)))

    angles = [math.cos(math.pi * i / (POINTS - 1)) for i in range(POINTS)]
    places = without.where("stretch IS NOT NULL").select(*group, "stretch", "v0").distinct().select("*", F.posexplode(F.array(*(F.lit(0.5 * SPAN * (1 + x)) for x in angles))).alias("i", "du"))
    places = places.withColumn("at", F.exp(F.col("stretch") * SPAN + F.col("du")) - F.col("v0"))
    part = 1 / (v + F.col("at"))
    known = told.join(F.broadcast(places), group).groupBy(*group, "stretch", "i").agg(F.sum(part).alias("s"), F.sum(part * y).alias("sy"), F.sum(part * F.abs(y)).alias("sa"))
    known = known.groupBy(*group, "stretch").agg(F.sort_array(F.collect_list(F.struct("i", "s", "sy", "sa"))).alias("known"))

    both = without.join(known, [*group, "stretch"], "left")
    off = [F.col("u") - F.col("stretch") * SPAN - 0.5 * SPAN * (1 + x) for x in angles]
    turns = [(-1.0) ** i * (0.5 if i in (0, POINTS - 1) else 1.0) for i in range(POINTS)]
    both = both.withColumn("turns", F.array(*(F.when(d == 0, None).otherwise(t / d) for d, t in zip(off, turns, strict=True))))
    hit = F.array_position(F.transform("turns", lambda x: x.isNull()), True).cast("int")

    def through(name: str) -> Column:
        values = F.col("known")[name]
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        return F.when(hit > 0, F.try_element_at(values, F.nullif(hit, F.lit(0)))).otherwise(total(F.zip_with(values, "turns", lambda a, b: a * b)) / total(F.col("turns")))

    mine = lambda f: F.aggregate("own", F.lit(0.0), lambda a, b: a + f(b) / (b["vi"] + F.col("tau2")))
    both = both.select(*group, "_study", "tau2", *(through(n).alias(n) for n in ("s", "sy", "sa")), mine(lambda b: F.lit(1.0)).alias("m"), mine(lambda b: b["yi"]).alias("my"), mine(lambda b: F.abs(b["yi"])).alias("ma"))
    heavy = F.coalesce((F.col("m") > LARGEST_SHARE * F.col("s")) | (F.col("ma") > LARGEST_SHARE * F.col("sa")), F.lit(True))
    both = stored(both.withColumn("heavy", heavy))
    light = both.where("NOT heavy").select(*group, "_study", (F.col("s") - F.col("m")).alias("sv"), (F.col("sy") - F.col("my")).alias("svy"))
    weight = 1 / (v + F.col("tau2"))
    pairs = both.where("heavy").select(*group, "_study", "tau2").join(told.select(*group, F.col("_study").alias("_in"), "yi", "vi"), group).where("_in <> _study")
    out = light.unionByName(pairs.groupBy(*group, "_study").agg(F.sum(weight).alias("sv"), F.sum(weight * y).alias("svy")))
    out = out.groupBy(*group, F.col("_study").alias(study)).agg((F.sum("svy") / F.sum("sv")).alias("estimate"), (1 / F.sqrt(F.sum("sv"))).alias("se"))
    return out.select(*group, study, "estimate", "se", two_sided(F.col("estimate") / F.col("se")).alias("p"))


def fragility(effects: DataFrame, group: list[str], study: str, level: float = 0.05) -> DataFrame:
    """(group, refits, least, most, flips): the range of estimates without one study, and how many refits change whether p is below `level` (STA09)."""
    beyond = F.abs(F.col("estimate") / F.col("se")) > NormalDist().inv_cdf(1 - level / 2)  # the same as p < level, without a tail for each refit
    effects = stored(effects.select(*group, study, "yi", "sei"))
    whole = pool(effects, group).select(*group, F.col("dl").alias("estimate"), F.col("dl_se").alias("se")).select(*group, beyond.alias("whole"))
    each = refits(effects, group, study).join(whole, group)
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("refits"), F.min("estimate").alias("least"), F.max("estimate").alias("most"), F.count_if(beyond != F.col("whole")).alias("flips"))


def _by_group(effects: DataFrame, group: list[str], columns: str, run) -> DataFrame:
    kinds = dict(effects.dtypes)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in group}, **run(g)}])

    return effects.groupBy(*group).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in group), columns]))


def _moments(y: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """tau2 by the method of moments, and the mean."""
    w = 1 / v
    mean = (w * y).sum() / w.sum()
    c = w.sum() - (w * w).sum() / w.sum()
    tau = max(0.0, ((w * (y - mean) ** 2).sum() - len(y) + 1) / c) if c > 0 else 0.0
    w = 1 / (v + tau)
    return tau, float((w * y).sum() / w.sum())


def trim_and_fill(effects: DataFrame, group: list[str], least: int = 10) -> DataFrame:
    """(group, k, side, k0, estimate): how many studies are missing on one side of the funnel, and the pool with their mirror images (STA08).

    The number is found by iteration over ranks (the estimator L0), so each analysis, of as many studies as a review has, is one
    Arrow group. Groups of fewer than `least` studies aren't tried.
    """

    def run(g: pd.DataFrame) -> dict:
        y, v = g["yi"].to_numpy(float), g["vi"].to_numpy(float)
        w, s = 1 / v, np.sqrt(v)
        ms = (w * s).sum() / w.sum()
        right = (w * (s - ms) * y).sum() < 0
        sign = -1.0 if right else 1.0
        order = np.argsort(sign * y, kind="stable")
        y, v = (sign * y)[order], v[order]
        k, k0, before = len(y), 0, -1
        for _ in range(100):
            if k0 == before:
                break
            before = k0
            mean = _moments(y[: k - k0], v[: k - k0])[1]
            off = y - mean
            ranks = np.empty(k)
            ranks[np.argsort(np.abs(off), kind="stable")] = np.arange(1, k + 1)
            k0 = max(0, round((4 * ranks[off > 0].sum() - k * (k + 1)) / (2 * k - 1)))
        filled = np.concatenate([y, 2 * mean - y[k - k0 :]]) if k0 else y
        return {"k": k, "side": "right" if right else "left", "k0": k0, "estimate": sign * _moments(filled, np.concatenate([v, v[k - k0 :]]) if k0 else v)[1]}

    rows = _usable(effects).select(*group, "yi", "vi")
    enough = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return _by_group(rows.join(enough, group), group, "k long, side string, k0 long, estimate double", run)


def _adjusted(phi: np.ndarray, m: float) -> np.ndarray:
    """The inverse root of diag(phi^2) - m r r', r the roots of phi, times 1 / r. Eigenvalues of 1e-12 and less count as none.

    By the integral of (B + s^2)^-1 over s, each of which is a diagonal and one more product, so it takes a sum over the rows for each of the
    integral's points. In log s the integrand has no singularity within pi / 2 of the real line: at steps of 0.3 the error is some 1e-14.
    """
    root, least = np.sqrt(phi), 1e-12
    if phi.min() ** 2 <= least or m * (phi / (phi**2 - least)).sum() >= 1:
        values, vectors = np.linalg.eigh(np.diag(phi**2) - m * np.outer(root, root))
        return vectors @ (np.where(values > least, 1 / np.sqrt(np.maximum(values, 1e-300)), 0) * (vectors.T @ (1 / root)))
    # no eigenvalue is below 1e-12, so below e^-46 the integrand is 1e-14 of its largest value
    total = np.zeros(len(phi))
    for s in np.exp(np.arange(-46.0, math.log(phi.max()) + 20, 0.3)):
        e = 1 / (phi**2 + s * s)
        total += s * e * (e.sum() / (1 - m * (phi * e).sum()))
    return phi**-1.5 + m * root * (2 / math.pi) * 0.3 * total


def cluster_cr2(effects: DataFrame, group: list[str], cluster: str) -> DataFrame:
    """(group, estimate, se, df, clusters, caution): the random-effects mean with the bias-reduced variance CR2 of its clusters, and Satterthwaite degrees of freedom (STA10).

    Each cluster's residuals are adjusted by the inverse root of their expected covariance, a diagonal less one product, in time in
    proportion to its rows. A cluster is one Arrow group; sums by group, and the covariance of all clusters, which is again a diagonal less one
    product, are aggregates. caution below ten clusters; a group of one cluster has no variance and is left out.
    """
    rows = stored(_usable(effects).where(F.col(cluster).isNotNull()).select(*group, F.col(cluster).alias("_cluster"), "yi", "vi"))
    y, v = F.col("yi"), F.col("vi")
    first = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.count_distinct("_cluster").alias("clusters"), F.sum(1 / v).alias("sw"), F.sum(1 / v / v).alias("sw2"), (F.sum(y / v) / F.sum(1 / v)).alias("fe")).where("clusters > 1")
    q = rows.join(first, group).groupBy(*group, "k", "clusters", "sw", "sw2").agg(F.sum((y - F.col("fe")) * (y - F.col("fe")) / v).alias("q"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    tau = q.select(*group, "clusters", F.when(c > 0, F.greatest((F.col("q") - F.col("k") + 1) / c, F.lit(0.0))).otherwise(0.0).alias("tau2"))
    phi = v + F.col("tau2")
    mean = rows.join(tau, group).groupBy(*group, "clusters", "tau2").agg((F.sum(y / phi) / F.sum(1 / phi)).alias("estimate"), (1 / F.sum(1 / phi)).alias("m"))
    kinds = dict(rows.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        phi, m = g["phi"].to_numpy(float), float(g["m"].iloc[0])
        weight = m * _adjusted(phi, m) * np.sqrt(phi)
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in group}, "e": weight @ g["off"].to_numpy(float), "s": weight.sum(), "o": (phi * weight) @ weight}])

    off = rows.join(mean, group).select(*group, "_cluster", "m", phi.alias("phi"), (y - F.col("estimate")).alias("off"))
    parts = off.groupBy(*group, "_cluster").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in group), "e double, s double, o double"]))
    e, s, o, m = (F.col(x) for x in ("e", "s", "o", "m"))
    out = parts.groupBy(*group).agg(F.sum(e * e).alias("ee"), F.sum(s * s).alias("ss"), F.sum(o).alias("so"), F.sum(o * o).alias("oo"), F.sum(o * s * s).alias("oss")).join(mean, group)
    df = F.pow(F.col("so") - m * F.col("ss"), 2) / (F.col("oo") - 2 * m * F.col("oss") + m * m * F.col("ss") * F.col("ss"))
    return out.select(*group, "estimate", F.sqrt("ee").alias("se"), df.alias("df"), "clusters", (F.col("clusters") < 10).alias("caution"))


def forest(effects: DataFrame, group: list[str], study: str) -> DataFrame:
    """(group, study, yi, low, high, weight): the rows of a forest plot; weights of the random-effects pool in percent (STA11)."""
    rows = _usable(effects).join(pool(effects, group).select(*group, "tau2"), group).withColumn("w", 1 / (F.col("vi") + F.col("tau2")))
    total = rows.groupBy(*group).agg(F.sum("w").alias("all"))
    low, high = interval(F.col("yi"), F.col("sei"))
    return rows.join(total, group).select(*group, study, "yi", low.alias("low"), high.alias("high"), (100 * F.col("w") / F.col("all")).alias("weight"))


def funnel(effects: DataFrame, group: list[str], study: str) -> DataFrame:
    """(group, study, yi, sei, low, high, outside): the points of a funnel plot, and the bounds around the fixed effect at their height (STA11)."""
    rows = _usable(effects).join(pool(effects, group).select(*group, "fe"), group)
    low, high = interval(F.col("fe"), F.col("sei"))
    return rows.select(*group, study, "yi", "sei", low.alias("low"), high.alias("high"), (~F.col("yi").between(low, high)).alias("outside"))


def bias_shares(judgements: DataFrame, group: list[str], domain: str, judgement: str) -> DataFrame:
    """(group, domain, judgement, n, share): the bars of a risk-of-bias figure (STA11)."""
    n = judgements.groupBy(*group, domain, judgement).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*group, domain).agg(F.sum("n").alias("all"))
    return n.join(total, [*group, domain]).select(*group, domain, judgement, "n", (F.col("n") / F.col("all")).alias("share"))


def absolute_effects(relative: Column, low: Column, high: Column, baseline: Column, ratio: Column) -> Column:
    """Struct (status, per_1000, low, high) of a ratio measure at a baseline risk (STA12). Without a baseline risk between 0 and 1 a ratio has none."""
    at = lambda x: F.bround(baseline * 1000 * (x - 1), 0).cast("long")
    fit = ratio & (baseline > 0) & (baseline <= 1)
    status = F.when(~ratio, "not a ratio").when(baseline.isNull(), "no baseline risk").when(~fit, "baseline risk out of range").otherwise("ok")
    return F.struct(status.alias("status"), *(F.when(fit, at(x)).alias(n) for n, x in (("per_1000", relative), ("low", low), ("high", high))))
