"""Subgroups, moderators, refits and plot data over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import moderators as M
from tessella.plans.registry import query, table
from tessella.plans.synthesis import _EFFECTS, _POOL, _rounded, effects



def _erfc(x: str) -> str:
    """By the series of erf below 2 and a continued fraction, from its end, above."""
    series = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (CASE n % 2 WHEN 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / gamma(n + 1) / (2 * n + 1)))"
    fraction = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 80), lambda i: (80 - i)::DOUBLE)), lambda f, j: 1 + j / (2 * ({x}) * ({x})) / f)"
    return f"CASE WHEN {x} < 2 THEN {series} ELSE exp(-({x}) * ({x})) / (({x}) * sqrt(pi())) / {fraction} END"


def _tail(x: str, df: str) -> str:
    """P(X >= x) of whole degrees of freedom: the finite sum of its terms, which a library of quadrature has no part in."""
    h, odd = f"({x} / 2.0)", f"({df} % 2)"
    terms = f"coalesce(list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: exp((j + {odd} / 2.0) * ln({h}) - {h} - lgamma(j + 1 + {odd} / 2.0)))), 0)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE (CASE WHEN {odd} = 1 THEN {_erfc(f'sqrt({h})')} ELSE 0 END) + {terms} END"


def _two_sided(z: str) -> str:
    return _tail(f"(({z}) * ({z}))", "1")


def _t_two_sided(t: str, df: str) -> str:
    """The finite sums of cosines for whole degrees of freedom."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) + 2 * j * ln(cos({angle}))))) / sqrt(pi())"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos({angle}))))), 0) * sqrt(pi()) / 2)"
    return f"greatest(1 - (CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END), 0)"


_Z = "1.959963984540054"


@query(_POOL + f""", r AS (SELECT t.g, k, q, tau2, dl, 1 / sqrt(sv) AS se FROM t JOIN d USING (g))
SELECT g, k, round(dl, 6) AS estimate, round(dl - {_Z} * se, 6) AS low, round(dl + {_Z} * se, 6) AS high, round({_two_sided("dl / se")}, 6) AS p, round(CASE WHEN q > k - 1 THEN {_tail("q", "(k - 1)")} END, 6) AS q_p,
  round(dl - {_Z} * sqrt(se * se + tau2), 6) AS pi_low, round(dl + {_Z} * sqrt(se * se + tau2), 6) AS pi_high FROM r""")
def pool_inference(spark, sf_dir):
    """STA05, STA06: interval, p, p of Q and prediction interval."""
    return _rounded(M.inference(effects(spark, sf_dir), ["g"]), ["g", "k"], ["estimate", "low", "high", "p", "q_p", "pi_low", "pi_high"])


def _newton(before: str, after: str) -> str:
    """A step of Newton's rule from column t of one table towards the point that |t| exceeds with probability 0.05."""
    density = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + t * t / df, -(df + 1) / 2)"
    return f"{after} AS (SELECT * REPLACE (t + ({_t_two_sided('t', 'k - 1')} - 0.05) / (2 * {density}) AS t) FROM {before})"


@query(_POOL + f""", r AS (SELECT t.g, k, (k - 1)::DOUBLE AS df, dl, sqrt((SELECT sum((w.yi - dl) ** 2 / (w.sei * w.sei + tau2)) FROM w WHERE w.g = t.g) / (k - 1) / sv) AS se FROM t JOIN d USING (g)),
q0 AS (SELECT *, {_Z} + (pow({_Z}, 3) + {_Z}) / (4 * df) AS t FROM r), {_newton("q0", "q1")}, {_newton("q1", "q2")}, {_newton("q2", "q3")}
SELECT g, k, round(dl, 6) AS estimate, round(se, 6) AS se, round(dl / se, 6) AS t, round(dl - t * se, 6) AS low, round(dl + t * se, 6) AS high, round({_t_two_sided("(dl / se)", "(k - 1)")}, 6) AS p, round({_t_two_sided("(se / se)", "(k - 1)")}, 6) AS p_of_one FROM q3""")
def pool_knapp_hartung(spark, sf_dir):
    """STA05: the pool with Student's t; p_of_one is the two-sided tail at t = 1, where the degrees of freedom show."""
    return _rounded(M.hartung_knapp(effects(spark, sf_dir), ["g"]).withColumn("p_of_one", M.t_two_sided(F.lit(1.0), F.col("k") - 1)), ["g", "k"], ["estimate", "se", "t", "low", "high", "p", "p_of_one"])


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_suppkey % 40 + 1)::DOUBLE * l_linenumber / 7 AS x, (l_partkey % 60 + 1)::INT AS df FROM lineitem)
SELECT k, n, round({_tail("x", "df")}, 9) AS chi2_p, round({_two_sided("(x / 4)")}, 9) AS normal_p, round({_t_two_sided("(x / 8)", "df")}, 9) AS t_p FROM l""")
def line_tails(spark, sf_dir):
    """STA06, STA05: the three tails at a statistic and degrees of freedom of each line."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 40 + 1).alias("a"), (F.col("l_partkey") % 60 + 1).cast("int").alias("df"))
    x, df = F.col("a").cast("double") * F.col("n") / 7, F.col("df")
    # 79 values of a, 119 of df and the few of n: the tails of each combination are made once
    each = li.select("n", "a", "df").distinct().select(F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("df").alias("_df"), F.round(M.chi2_tail(x, df), 9).alias("chi2_p"), F.round(M.two_sided(x / 4), 9).alias("normal_p"), F.round(M.t_two_sided(x / 8, df), 9).alias("t_p"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("df").eqNullSafe(F.col("_df"))
    return li.join(each, same, "left").select("k", "n", "chi2_p", "normal_p", "t_p")


@query(f"""WITH {_EFFECTS}, w AS (SELECT *, sei * sei AS v FROM e WHERE sei > 0), m AS (SELECT g, cluster, sum(yi / v) / sum(1 / v) AS mu, sum(1 / v) - sum(1 / v / v) / sum(1 / v) AS c FROM w GROUP BY ALL),
h AS (SELECT g, sum((yi - mu) ** 2 / v) AS qe, count(*) AS k FROM w JOIN m USING (g, cluster) GROUP BY g), n AS (SELECT g, count(*) AS levels, sum(c) AS c FROM m GROUP BY g),
t AS (SELECT g, k, levels, greatest((qe - k + levels) / c, 0) AS tau2 FROM h JOIN n USING (g)), b AS (SELECT g, cluster, sum(yi / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sum(1 / (v + tau2)) AS sw FROM w JOIN t USING (g) GROUP BY ALL),
a AS (SELECT g, sum(sw * mu) / sum(sw) AS mean FROM b GROUP BY g), q AS (SELECT g, sum(sw * (mu - mean) ** 2) AS qm FROM b JOIN a USING (g) GROUP BY g)
SELECT g, k, levels, round(tau2, 5) AS tau2, round(qm, 5) AS qm, levels - 1 AS df, round({_tail("qm", "(levels - 1)")}, 6) AS p FROM q JOIN t USING (g)""")
def subgroup_difference(spark, sf_dir):
    """STA07: the omnibus test of the levels' means."""
    return M.subgroup_test(effects(spark, sf_dir), ["g"], "cluster").select("g", "k", "levels", F.round("tau2", 5).alias("tau2"), F.round("qm", 5).alias("qm"), "df", F.round("p", 6).alias("p"))


_REGRESSION = f"""WITH {_EFFECTS}, w AS (SELECT *, sei * sei AS v, MODERATOR AS x, 1 / (sei * sei) AS w FROM e WHERE sei > 0),
s AS (SELECT g, count(*) AS k, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * yi) AS sy, sum(w * x * yi) AS sxy, sum(w * w) AS t, sum(w * w * x) AS tx, sum(w * w * x * x) AS txx FROM w GROUP BY g),
l AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (s * sxx - sx * sx) AS a FROM s), h AS (SELECT g, sum(w.w * (yi - a - b * x) ** 2) AS qe FROM w JOIN l USING (g) GROUP BY g),
t AS (SELECT g, k, greatest((qe - k + 2) / (s - (sxx * t - 2 * sx * tx + s * txx) / (s * sxx - sx * sx)), 0) AS tau2 FROM l JOIN h USING (g)),
u AS (SELECT g, k, tau2, yi, x, 1 / (v + tau2) AS w FROM w JOIN t USING (g)), m AS (SELECT g, sum(w * x) / sum(w) AS mx, sum(w * yi) / sum(w) AS my FROM u GROUP BY g),
f AS (SELECT g, k, tau2, sum(w * (x - mx) * (yi - my)) / sum(w * (x - mx) ** 2) AS slope, 1 / sqrt(sum(w * (x - mx) ** 2)) AS se, any_value(mx) AS mx, any_value(my) AS my FROM u JOIN m USING (g) GROUP BY g, k, tau2)
SELECT g, k, round(tau2, 5) AS tau2, round(my - slope * mx, 5) AS intercept, round(slope, 5) AS slope, round(se, 5) AS slope_se, round(slope - {_Z} * se, 5) AS low, round(slope + {_Z} * se, 5) AS high, round((slope / se) ** 2, 5) AS qm, round({_two_sided("slope / se")}, 6) AS p, k < 10 AS caution FROM f"""
_COEFFICIENTS = ["tau2", "intercept", "slope", "slope_se", "low", "high", "qm"]


def _regressed(df):
    return df.select("g", "k", *(F.round(n, 5).alias(n) for n in _COEFFICIENTS), F.round("p", 6).alias("p"), "caution")


@query(_REGRESSION.replace("MODERATOR", "study::DOUBLE"))
def moderator_regression(spark, sf_dir):
    """STA07: a regression on one moderator."""
    return _regressed(M.meta_regression(effects(spark, sf_dir), ["g"], "study"))


@query(_REGRESSION.replace("MODERATOR", "sei"))
def funnel_asymmetry(spark, sf_dir):
    """STA08: the regression test on the standard error, with p."""
    return _regressed(M.meta_regression(effects(spark, sf_dir), ["g"], "sei"))


@query(f"""WITH {_EFFECTS}, w AS (SELECT *, sei * sei AS v FROM e WHERE sei > 0), p AS (SELECT a.g, a.study AS gone, b.yi, b.v FROM w a JOIN w b ON a.g = b.g AND a.study <> b.study
  UNION ALL SELECT g, NULL, yi, v FROM w), f AS (SELECT g, gone, sum(yi / v) / sum(1 / v) AS mu, sum(1 / v) - sum(1 / v / v) / sum(1 / v) AS c FROM p GROUP BY ALL),
q AS (SELECT p.g, p.gone, greatest((sum((yi - mu) ** 2 / v) - count(*) + 1) / any_value(c), 0) AS tau2 FROM p JOIN f ON p.g = f.g AND p.gone IS NOT DISTINCT FROM f.gone GROUP BY ALL),
r AS (SELECT p.g, p.gone, sum(yi / (v + tau2)) / sum(1 / (v + tau2)) AS est, 1 / sqrt(sum(1 / (v + tau2))) AS se FROM p JOIN q ON p.g = q.g AND p.gone IS NOT DISTINCT FROM q.gone GROUP BY ALL),
s AS (SELECT g, gone, est, abs(est / se) > 1.959963984540054 AS significant FROM r)
SELECT a.g, count(*) AS refits, round(min(a.est), 6) AS least, round(max(a.est), 6) AS most, count(*) FILTER (a.significant <> b.significant) AS flips FROM s a JOIN s b ON a.g = b.g AND a.gone IS NOT NULL AND b.gone IS NULL GROUP BY a.g""")
def leave_one_out_flips(spark, sf_dir):
    """STA09: the range of random-effects refits and how many change the conclusion."""
    return _rounded(M.fragility(effects(spark, sf_dir), ["g"], "study"), ["g", "refits", "flips"], ["least", "most"]).select("g", "refits", "least", "most", "flips")


@query(_POOL + f"""SELECT w.g, study, round(yi, 6) AS yi, round(yi - {_Z} * sei, 6) AS low, round(yi + {_Z} * sei, 6) AS high, round(100 / (sei * sei + tau2) / sv, 6) AS weight FROM w JOIN t ON w.g = t.g JOIN d ON w.g = d.g""")
def forest_rows(spark, sf_dir):
    """STA11."""
    return _rounded(M.forest(effects(spark, sf_dir), ["g"], "study"), ["g", "study"], ["yi", "low", "high", "weight"])


@query(_POOL + f"""SELECT w.g, study, round(yi, 6) AS yi, round(sei, 6) AS sei, round(fe - {_Z} * sei, 6) AS low, round(fe + {_Z} * sei, 6) AS high, abs(yi - fe) > {_Z} * sei AS outside FROM w JOIN t ON w.g = t.g""")
def funnel_points(spark, sf_dir):
    """STA11."""
    return _rounded(M.funnel(effects(spark, sf_dir), ["g"], "study"), ["g", "study", "outside"], ["yi", "sei", "low", "high"])


@query("SELECT g, domain, judgement, n, n / sum(n) OVER (PARTITION BY g, domain) AS share FROM (SELECT o_orderstatus AS g, o_orderpriority AS domain, o_custkey % 3 AS judgement, count(*) AS n FROM orders GROUP BY ALL)")
def bias_bars(spark, sf_dir):
    """STA11: the bars of a risk-of-bias figure."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 3).alias("judgement"))
    return M.bias_shares(o, ["g"], "domain", "judgement")


@query("""WITH r AS (SELECT p_partkey, p_retailprice::DOUBLE / 1000 AS rel, p_size / 40.0::DOUBLE AS base, p_size % 5 > 0 AS ratio FROM part)
SELECT p_partkey, CASE WHEN NOT ratio THEN 'not a ratio' WHEN p_size_missing THEN 'no baseline risk' WHEN NOT (base > 0 AND base <= 1) THEN 'baseline risk out of range' ELSE 'ok' END AS status,
  CASE WHEN ratio AND NOT p_size_missing AND base > 0 AND base <= 1 THEN round_even(base * 1000 * (rel - 1), 0)::BIGINT END AS per_1000,
  CASE WHEN ratio AND NOT p_size_missing AND base > 0 AND base <= 1 THEN round_even(base * 1000 * (rel * 0.8 - 1), 0)::BIGINT END AS low,
  CASE WHEN ratio AND NOT p_size_missing AND base > 0 AND base <= 1 THEN round_even(base * 1000 * (rel * 1.3 - 1), 0)::BIGINT END AS high
FROM (SELECT *, p_partkey % 7 = 0 AS p_size_missing FROM r)""")
def absolute_effects(spark, sf_dir):
    """STA12: differences per thousand with bounds, where there is a baseline risk."""
    size = F.col("p_size").cast("double")
    rel, base = F.col("p_retailprice").cast("double") / 1000, F.when(F.col("p_partkey") % 7 != 0, size / 40.0)
    got = M.absolute_effects(rel, rel * 0.8, rel * 1.3, base, F.col("p_size") % 5 > 0)
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("r")).select("p_partkey", "r.*")


@query()
def cluster_robust_cr2(spark, sf_dir):
    """STA10: inverse roots of matrices aren't for SQL; a test holds it against the matrices written out."""
    return M.cluster_cr2(effects(spark, sf_dir), ["g"], "cluster")


@query()
def trimmed_and_filled(spark, sf_dir):
    """STA08: iterated, so there is no SQL; tests hold it against the ranks written out."""
    return M.trim_and_fill(effects(spark, sf_dir), ["g"])
