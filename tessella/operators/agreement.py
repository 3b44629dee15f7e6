"""Accuracy and agreement: Wilson bounds, confusion tables, kappa, rank AUC, operating points, bootstrap."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for n = 0 (STA13)."""
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def binary_metrics(pairs: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """(metric, k, n, value, low, high) for accuracy, sensitivity, specificity and precision over boolean columns (AGG16)."""
    c = pairs.agg(*(F.count_if(x).alias(n) for n, x in (("tp", actual & predicted), ("tn", ~actual & ~predicted), ("fp", ~actual & predicted), ("fn", actual & ~predicted))))
    t = {x: F.col(x) for x in ("tp", "tn", "fp", "fn")}
    rows = (("accuracy", t["tp"] + t["tn"], t["tp"] + t["tn"] + t["fp"] + t["fn"]), ("sensitivity", t["tp"], t["tp"] + t["fn"]), ("specificity", t["tn"], t["tn"] + t["fp"]), ("precision", t["tp"], t["tp"] + t["fp"]))
    out = c.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), k.alias("k"), n.alias("n")) for m, k, n in rows))).alias("r")).select("r.*")
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select("metric", "k", "n", (F.col("k") / F.nullif("n", F.lit(0))).alias("value"), low.alias("low"), high.alias("high"))


def class_metrics(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One against the rest: (class, tp, fp, fn, precision, recall, f1) (AGG16). One pass over the confusion table."""
    table = pairs.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col(actual) == F.col(predicted)
    sides = table.select(F.explode(F.array(F.struct(F.col(actual).alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("s")).select("s.*")
    out = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return out.select("class", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, po, pe, kappa, pabak): Cohen's kappa of two raters; where chance agreement is complete, 1 or null (AGG17)."""
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, "c").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("cross"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    both = total.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one").select("n", po.alias("po"), pe.alias("pe"))
    return both.select("n", "po", "pe", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).when(F.col("po") >= 1, 1.0).alias("kappa"), (2 * F.col("po") - 1).alias("pabak"))


def _by_score(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Counts of either class by score: as many rows as different scores, whatever a hot score's rows."""
    return rows.groupBy(score).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))


#: Ranges of scores that are summed by themselves, at least, and different scores in one, about.
RANGES, IN_RANGE = 32, 100_000


def _ranged(counts: DataFrame, score: str) -> DataFrame:
    """counts (one row for each score) with the number `range_` of the range that a score falls into, in ascending order.

    The bounds are approximate quantiles of the different scores; the driver holds these and nothing else.
    """
    n = counts.count()
    parts = max(RANGES, -(-n // IN_RANGE))
    cuts = counts.agg(F.percentile_approx(F.col(score).cast("double"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    cuts = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return counts.withColumn("range_", F.size(F.filter(cuts, lambda c: c < F.col(score).cast("double"))))


def _summed_up(counts: DataFrame, score: str, names: list[str], descending: bool = False) -> DataFrame:
    """counts with running sums cum_<name> in the order of the score, itself included: within its range, and a total for each range before."""
    ranged = _ranged(counts, score)
    order = F.desc if descending else F.asc
    tops = ranged.groupBy("range_").agg(*(F.sum(n).alias(n) for n in names))
    before = W.partitionBy(F.lit(0)).orderBy(order("range_"))  # a row for each range
    tops = tops.select("range_", *((F.sum(n).over(before) - F.col(n)).alias(f"top_{n}") for n in names))
    within = W.partitionBy("range_").orderBy(order(score))
    out = ranged.select("*", *(F.sum(n).over(within).alias(f"in_{n}") for n in names)).join(tops, "range_")
    return out.select(score, *names, *((F.col(f"in_{n}") + F.col(f"top_{n}")).alias(f"cum_{n}") for n in names))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auc): the chance that a positive scores above a negative, ties counting half (AGG18). Ranges of scores are summed apart, so no task sorts all."""
    counts = _summed_up(_by_score(rows, score, positive), score, ["pos", "neg"])
    wins = counts.withColumn("wins", F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return wins.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("w")).select("n_pos", "n_neg", (F.col("w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def operating_point(rows: DataFrame, score: str, positive: str, most: float = 0.05) -> DataFrame:
    """(threshold, sensitivity, fpr): of the thresholds with a false-positive rate of at most `most` the one of the highest sensitivity; of equals the highest (AGG18)."""
    counts = _summed_up(_by_score(rows, score, positive), score, ["pos", "neg"], descending=True)
    totals = rows.agg(F.count_if(F.col(positive)).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg"))
    points = counts.select(F.col(score).alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), F.lit(1).alias("one")).join(totals.withColumn("one", F.lit(1)), "one")
    points = points.select("threshold", (F.col("tp") / F.col("n_pos")).alias("sensitivity"), (F.col("fp") / F.col("n_neg")).alias("fpr")).where(F.col("fpr") <= most)
    return points.orderBy(F.desc("sensitivity"), F.desc("threshold")).limit(1)


def _poisson(n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The Poisson(n) value at a uniform number u, by inversion; beyond 200 by the normal one, rounded."""
    out = np.zeros(len(n), np.int64)
    for value in np.unique(n[n > 0]):
        at = n == value
        if value <= 200:
            k = np.arange(1, int(value + 12 * math.sqrt(value) + 20))
            table = np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(value / k))]) - value))
            out[at] = np.searchsorted(table, u[at], "right")
        else:
            out[at] = [max(0, round(NormalDist(float(value), math.sqrt(value)).inv_cdf(min(max(x, 1e-12), 1 - 1e-12)))) for x in u[at]]
    return out


def bootstrap_auc(rows: DataFrame, score: str, positive: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """(reps, low, high): percentile bounds of the AUC over Poisson resamples (AGG19).

    Rows first become counts by score and class. In each resample a count n becomes Poisson(n), as if each row were taken
    Poisson(1) times, by a hash of seed, resample, class and score; so the result is the same however the rows are dealt.
    A range of scores is resampled by one Arrow group, which gives a row for each resample: its positives, its negatives, and
    the wins within the range. Wins over the ranges below are added from these.
    """
    counts = _ranged(_by_score(rows.select(F.col(score).cast("double").alias("s"), positive), "s", positive), "s")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        bits = (g["s"].to_numpy(np.float64) + 0.0).view(np.uint64)
        both = [g["pos"].to_numpy(np.int64), g["neg"].to_numpy(np.int64)]
        out = np.zeros((reps, 3))
        for r in range(reps):
            drawn = []
            for c, n in enumerate(both):
                x = bits * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((seed * 2 + c) * 1_000_003 + r) * 0xD1B54A32D192ED03 % 2**64)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn.append(_poisson(n, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53))
            pos, neg = drawn
            out[r] = pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum()
        return pd.DataFrame({"range_": g["range_"].iloc[0], "r": np.arange(reps), "pos": out[:, 0], "neg": out[:, 1], "wins": out[:, 2]})

    parts = counts.groupBy("range_").applyInPandas(run, "range_ int, r long, pos double, neg double, wins double")
    below = F.sum("neg").over(W.partitionBy("r").orderBy("range_")) - F.col("neg")
    each = parts.withColumn("wins", F.col("wins") + F.col("pos") * below).groupBy("r").agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return each.agg(F.count("auc").alias("reps"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
