"""Meta-analysis: effect sizes, pooling, heterogeneity, sensitivity, overlap of reviews."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)


def se_from_ci(low: Column, high: Column, level: float = 0.95) -> Column:
    """Standard error of an interval (STA01)."""
    return (high - low) / (2 * NormalDist().inv_cdf(0.5 + level / 2))


def log_ratio(ratio: Column) -> Column:
    """ln of a ratio; null where it isn't above 0 (STA01)."""
    return F.when(ratio > 0, F.log(ratio))


def fisher_z(r: Column) -> Column:
    """atanh of a correlation; null outside -1 to 1 (STA01)."""
    return F.when(F.abs(r) < 1, 0.5 * F.log((1 + r) / (1 - r)))


def fisher_se(n: Column) -> Column:
    return F.when(n > 3, 1 / F.sqrt(n - 3))


def smd_se(n1: Column, n2: Column, d: Column) -> Column:
    return F.sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2 - 2)))


def from_counts(a: Column, b: Column, c: Column, d: Column, metric: str) -> tuple[Column, Column]:
    """(estimate, standard error) of a 2 x 2 table: OR and RR as logarithms, RD; a half is added to all where one is 0 (STA02)."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = a + add, b + add, c + add, d + add
    if metric == "OR":
        return F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    p, q = a / (a + b), c / (c + d)
    if metric == "RR":
        return F.log(p / q), F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    return p - q, F.sqrt(p * (1 - p) / (a + b) + q * (1 - q) / (c + d))


def from_means(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column, metric: str) -> tuple[Column, Column]:
    """(estimate, standard error) of two means: MD, or SMD with Hedges' correction (STA02)."""
    if metric == "MD":
        return m1 - m2, F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)
    df = n1 + n2 - 2
    g = (1 - 3 / (4 * df - 1)) * (m1 - m2) / F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / df)
    return g, F.sqrt(1 / n1 + 1 / n2 + g * g / (2 * (n1 + n2)))


def drop_reason(estimate: Column, se: Column) -> Column:
    """Why a row can't be pooled, or null (STA03)."""
    return F.when(estimate.isNull(), "no estimate").when(F.isnan(estimate), "estimate not finite").when(se.isNull(), "no standard error").when(F.isnan(se), "standard error not finite").when(se <= 0, "standard error not positive")


def pool(effects: DataFrame, group: list[str]) -> DataFrame:
    """Fixed effect and DerSimonian-Laird pools of (yi, sei) by group (STA05, STA06, STA07).

    k, fe, fe_se, q, tau2, i2, h2, dl, dl_se and hk_se (Hartung-Knapp); moderators.inference adds p values and intervals. i2 and h2 are null where
    q <= k - 1. Two aggregates with map-side combination; the second joins the first's tau2 back by group. A group of one row has
    no tau2 above 0.
    """
    w = 1 / (F.col("sei") * F.col("sei"))
    rows = effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).withColumn("w", w)
    first = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("yi")).alias("swy"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("yi") * F.col("yi")).alias("swyy"))
    q = F.greatest(F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"), F.lit(0.0))
    df = F.col("k") - 1
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    first = first.withColumn("fe", F.col("swy") / F.col("sw")).withColumn("fe_se", 1 / F.sqrt("sw")).withColumn("q", q)
    first = first.withColumn("tau2", F.when((df > 0) & (F.col("q") > df), (F.col("q") - df) / c).otherwise(0.0))
    first = first.withColumn("i2", F.when((df > 0) & (F.col("q") > df), (F.col("q") - df) / F.col("q"))).withColumn("h2", F.when((df > 0) & (F.col("q") > df), F.col("q") / df))
    joined = rows.join(first.select(*group, "tau2"), group)
    v = 1 / (F.col("sei") * F.col("sei") + F.col("tau2"))
    second = joined.withColumn("v", v).groupBy(*group).agg(F.sum("v").alias("sv"), F.sum(F.col("v") * F.col("yi")).alias("svy"), F.sum(F.col("v") * F.col("yi") * F.col("yi")).alias("svyy"))
    out = first.join(second, group).withColumn("dl", F.col("svy") / F.col("sv")).withColumn("dl_se", 1 / F.sqrt("sv"))
    spread = F.greatest(F.col("svyy") - F.col("svy") * F.col("svy") / F.col("sv"), F.lit(0.0))
    return out.withColumn("hk_se", F.when(df > 0, F.sqrt(spread / (df * F.col("sv"))))).select(*group, "k", "fe", "fe_se", "q", "tau2", "i2", "h2", "dl", "dl_se", "hk_se")


def leave_one_out(effects: DataFrame, group: list[str], study: str) -> DataFrame:
    """(group, study, fe, fe_se): the fixed effect without each study, by subtraction from sums; no refit (STA09)."""
    rows = effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).withColumn("w", 1 / (F.col("sei") * F.col("sei")))
    sums = rows.groupBy(*group).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("yi")).alias("swy"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return rows.join(sums, group).select(*group, study, ((F.col("swy") - F.col("w") * F.col("yi")) / (F.col("sw") - F.col("w"))).alias("fe"), (1 / F.sqrt(F.col("sw") - F.col("w"))).alias("fe_se"))


def egger(effects: DataFrame, group: list[str], least: int = 10) -> DataFrame:
    """(group, k, intercept, slope): regression of yi / sei on 1 / sei, where a group has `least` studies (STA08)."""
    y, x = F.col("yi") / F.col("sei"), 1 / F.col("sei")
    out = effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))
    return out.where(F.col("k") >= least)


def begg(effects: DataFrame, group: list[str], least: int = 10) -> DataFrame:
    """(group, k, tau): Kendall's rank correlation of standardised effect and variance (STA08)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, v = g["yi"].to_numpy(), g["sei"].to_numpy() ** 2
        w = 1 / v
        t = (y - (w * y).sum() / w.sum()) / np.sqrt(v - 1 / w.sum())
        s = sum(np.sign(t[i] - t[:i]) @ np.sign(v[i] - v[:i]) for i in range(1, len(t)))
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in group}, "k": len(g), "tau": 2 * s / (len(g) * (len(g) - 1)) if len(g) > 1 else None}])

    kinds = dict(effects.dtypes)
    rows = effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull())
    enough = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*group)
    return rows.join(enough, group).groupBy(*group).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in group) + ", k long, tau double")


def reml(effects: DataFrame, group: list[str], rounds: int = 100) -> DataFrame:
    """(group, k, tau2, estimate, se): restricted maximum likelihood by Fisher scoring, group by group (STA05).

    A group is one analysis, of as many studies as a review has; it is iterated in an Arrow worker, since there is no closed form.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, v = g["yi"].to_numpy(float), g["sei"].to_numpy(float) ** 2
        tau = max(0.0, float(np.var(y, ddof=1) - v.mean())) if len(y) > 1 else 0.0
        for _ in range(rounds if len(y) > 1 else 0):
            w = 1 / (v + tau)
            mu, sw, sw2 = (w * y).sum() / w.sum(), w.sum(), (w**2).sum()
            score = -0.5 * (sw - sw2 / sw) + 0.5 * ((w**2) * (y - mu) ** 2).sum()
            info = 0.5 * (sw2 - 2 * (w**3).sum() / sw + (sw2 / sw) ** 2)
            new = max(0.0, tau + score / info)
            done, tau = abs(new - tau) < 1e-10, new
            if done:
                break
        w = 1 / (v + tau)
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in group}, "k": len(y), "tau2": tau, "estimate": (w * y).sum() / w.sum(), "se": math.sqrt(1 / w.sum())}])

    kinds = dict(effects.dtypes)
    return effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).groupBy(*group).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in group) + ", k long, tau2 double, estimate double, se double")


def cluster_se(effects: DataFrame, group: list[str], cluster: str) -> DataFrame:
    """(group, estimate, se, clusters): fixed weights with cluster-robust variance, corrected by m / (m - 1) (STA10)."""
    rows = effects.where(drop_reason(F.col("yi"), F.col("sei")).isNull()).withColumn("w", 1 / (F.col("sei") * F.col("sei")))
    sums = rows.groupBy(*group).agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("yi")) / F.sum("w")).alias("estimate"))
    parts = rows.join(sums, group).groupBy(*group, cluster, "sw", "estimate").agg(F.sum(F.col("w") * (F.col("yi") - F.col("estimate"))).alias("s"))
    out = parts.groupBy(*group, "sw", "estimate").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("clusters"))
    return out.where("clusters > 1").select(*group, "estimate", (F.sqrt(F.col("ss") * F.col("clusters") / (F.col("clusters") - 1)) / F.col("sw")).alias("se"), "clusters")


def absolute_effect(relative: Column, baseline: Column) -> Column:
    """Difference per thousand at a baseline risk (STA12)."""
    return baseline * 1000 * (relative - 1)


def review_overlap(marks: DataFrame) -> DataFrame:
    """(a, b, shared, share) for pairs of reviews with a common study (JOIN09): share of the smaller review, four places.

    marks (review, study). Each mark is sent to its review with the study's later reviews, as one list, and pairs are made and
    counted where these arrive, so that no pair is written before it is counted.
    """
    m = marks.select("review", "study").where("review IS NOT NULL").distinct()
    sizes = m.groupBy("review").agg(F.count(F.lit(1)).alias("n"))
    lists = m.where("study IS NOT NULL").groupBy("study").agg(F.sort_array(F.collect_list("review")).alias("all"))
    later = lists.where(F.size("all") > 1).select("all", F.posexplode("all").alias("at", "a")).select("a", F.slice("all", F.col("at") + 2, F.size("all")).alias("later")).where(F.size("later") > 0)
    pairs = later.repartition("a").select("a", F.explode("later").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(sizes.select(F.col("review").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("review").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 4).alias("share"))


def pooling_status(overlap: DataFrame, threshold: float = 0.30, handled: bool = False) -> DataFrame:
    """(a, b, status): finding where the overlap is above the threshold and dependence isn't handled, else caution (AGG14)."""
    return overlap.where(F.col("share") > threshold).select("a", "b", F.lit("caution" if handled else "finding").alias("status"))


def overlap_counts(marks: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review, studies, partners, apart): of each review (review) its studies, the reviews that share one with it, and those that share none (JOIN09).

    Pairs without a common study are told as a number: all of them would be as many rows as reviews squared. A review without any
    study has no share with another one; it is apart from all. Repeated and null marks and reviews that aren't listed count for nothing.
    """
    known = reviews.select("review").where("review IS NOT NULL").distinct()
    m = marks.where("study IS NOT NULL").select("review", "study").join(known, "review", "left_semi")
    sizes = m.distinct().groupBy("review").agg(F.count(F.lit(1)).alias("studies"))
    pairs = review_overlap(m).select("a", "b")
    partners = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("review")).agg(F.count(F.lit(1)).alias("partners"))
    out = known.join(sizes, "review", "left").join(partners, "review", "left").fillna(0, ["studies", "partners"])
    return out.select("review", "studies", "partners", (F.lit(known.count() - 1) - F.col("partners")).alias("apart"))


def pooling_notes(effects: DataFrame, marks: DataFrame, group: str, threshold: float = 0.30, pool: bool = True, handled: bool = False) -> DataFrame:
    """(group, level, rule, a, b): what speaks against pooling the reviews of each group (AGG14).

    effects (group, review, metric, family), marks (group, review, study, marked): marked is true, false, or null where a cell can't be read.
    A review with an unreadable cell or without any study is a gap. An overlap above `threshold` of the smaller review is a finding where
    reviews are to be pooled and dependence isn't handled, else a caution. A review of several metrics is a finding, of several
    families a caution; to pool, metrics must agree over the group, unless dependence is handled, and there must be two reviews.
    Groups are those of effects; null groups and reviews are left out.
    """
    known = effects.where(F.col(group).isNotNull() & F.col("review").isNotNull()).select(group, "review", F.lower(F.trim("metric")).alias("metric"), F.lower(F.trim("family")).alias("family"))
    reviews = known.groupBy(group, "review").agg(F.count_distinct(F.nullif("metric", F.lit(""))).alias("metrics"), F.count_distinct(F.nullif("family", F.lit(""))).alias("families"))
    cells = marks.where(F.col(group).isNotNull()).groupBy(group, "review").agg(F.count_if(F.col("marked")).alias("n"), F.count_if(F.col("marked").isNull()).alias("unread"))

    def note(df: DataFrame, level: str, rule: str, a: str | None = None, b: str | None = None) -> DataFrame:
        return df.select(group, F.lit(level).alias("level"), F.lit(rule).alias("rule"), *((F.col(x).cast("string") if x else F.lit(None).cast("string")).alias(n) for n, x in (("a", a), ("b", b))))

    gaps = note(reviews.join(cells, [group, "review"], "left").where("coalesce(n, 0) = 0 OR unread > 0"), "gap", "unreadable", "review")
    told = marks.where("marked AND study IS NOT NULL").join(known.select(group).distinct(), group, "left_semi")
    m = told.select(F.struct(group, "review").alias("review"), F.struct(group, "study").alias("study"))
    shared = review_overlap(m).where(F.col("share") > threshold).select(F.col(f"a.{group}").alias(group), F.col("a.review").alias("a"), F.col("b.review").alias("b"))
    out = gaps.unionByName(note(shared, "finding" if pool and not handled else "caution", "overlap", "a", "b"))
    out = out.unionByName(note(reviews.where("metrics > 1"), "finding", "metric", "review")).unionByName(note(reviews.where("families > 1"), "caution", "outcome_family", "review"))
    if pool:
        if not handled:
            out = out.unionByName(note(known.groupBy(group).agg(F.count_distinct(F.nullif("metric", F.lit(""))).alias("n")).where("n > 1"), "finding", "metric_mismatch"))
        out = out.unionByName(note(reviews.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n < 2"), "finding", "review_count"))
    return out


def pooling_verdicts(effects: DataFrame, notes: DataFrame, group: str, pool: bool = True) -> DataFrame:
    """(group, gaps, findings, cautions, status, verdict) of pooling_notes: gaps come before findings, and with a gap there is no verdict (AGG14)."""
    counts = notes.groupBy(group).agg(*(F.count_if(F.col("level") == x).alias(f"{x}s") for x in ("gap", "finding", "caution")))
    out = effects.where(F.col(group).isNotNull()).select(group).distinct().join(counts, group, "left").fillna(0, ["gaps", "findings", "cautions"])
    status = F.when(F.col("gaps") > 0, "insufficient_evidence").when(F.col("findings") > 0, "fail").otherwise("pass")
    verdict = F.when(F.col("gaps") > 0, F.lit(None)).otherwise("narrative" if not pool else F.when(F.col("findings") > 0, "indefensible").otherwise("pool"))
    return out.select(group, "gaps", "findings", "cautions", status.alias("status"), verdict.alias("verdict"))
