"""Meta-analysis and graphs over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import citations_graph as G
from tessella.operators import synthesis as S
from tessella.plans.registry import example, query, table

_EFFECTS = """e AS (SELECT l_suppkey AS study, l_returnflag AS g, l_suppkey % 7 AS cluster, avg(l_quantity) AS yi, stddev_samp(l_quantity) / sqrt(count(*)) AS sei FROM lineitem GROUP BY ALL HAVING count(*) > 2)"""


def effects(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = li.groupBy(F.col("l_suppkey").alias("study"), F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 7).alias("cluster"))
    return out.agg(F.avg("l_quantity").alias("yi"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("sei"), F.count(F.lit(1)).alias("n")).where("n > 2").drop("n")


_POOL = f"""WITH {_EFFECTS}, w AS (SELECT *, 1 / (sei * sei) AS w FROM e WHERE sei > 0), a AS (SELECT g, count(*) AS k, sum(w) AS sw, sum(w * yi) / sum(w) AS fe, sum(w * w) AS sw2 FROM w GROUP BY g),
q AS (SELECT a.*, (SELECT sum(w.w * (w.yi - a.fe) ** 2) FROM w WHERE w.g = a.g) AS q FROM a), t AS (SELECT *, CASE WHEN q > k - 1 THEN (q - (k - 1)) / (sw - sw2 / sw) ELSE 0 END AS tau2 FROM q),
d AS (SELECT t.g, sum(1 / (sei * sei + tau2)) AS sv, sum(yi / (sei * sei + tau2)) / sum(1 / (sei * sei + tau2)) AS dl FROM w JOIN t USING (g) GROUP BY t.g)
"""


def _pool(spark, sf_dir):
    return S.pool(effects(spark, sf_dir), ["g"])


def _rounded(df, keep, names, places=6):
    return df.select(*keep, *(F.round(n, places).alias(n) for n in names))


@query(_POOL + "SELECT g, k, round(fe, 6) AS fe, round(1 / sqrt(sw), 6) AS fe_se FROM t")
def fixed_effect_pool(spark, sf_dir):
    """STA05."""
    return _rounded(_pool(spark, sf_dir), ["g", "k"], ["fe", "fe_se"])


@query(_POOL + "SELECT g, round(dl, 6) AS dl, round(1 / sqrt(sv), 6) AS dl_se FROM d")
def dl_pool(spark, sf_dir):
    """STA05, STA07: random effects by subgroup."""
    return _rounded(_pool(spark, sf_dir), ["g"], ["dl", "dl_se"])


@query(_POOL + "SELECT g, round(q, 5) AS q, round(tau2, 5) AS tau2, round(CASE WHEN q > k - 1 THEN (q - k + 1) / q END, 5) AS i2, round(CASE WHEN q > k - 1 THEN q / (k - 1) END, 5) AS h2 FROM t")
def heterogeneity_q(spark, sf_dir):
    """STA06: not estimable where Q is no larger than its degrees of freedom."""
    return _rounded(_pool(spark, sf_dir), ["g"], ["q", "tau2", "i2", "h2"], 5)


@query(_POOL + "SELECT d.g, round(sqrt((SELECT sum((yi - d.dl) ** 2 / (sei * sei + t.tau2)) FROM w WHERE w.g = d.g) / ((t.k - 1) * d.sv)), 6) AS hk_se FROM d JOIN t USING (g)")
def hartung_knapp(spark, sf_dir):
    """STA05: Hartung-Knapp standard errors."""
    return _rounded(_pool(spark, sf_dir), ["g"], ["hk_se"])


@query(f"WITH {_EFFECTS}, w AS (SELECT *, 1 / (sei * sei) AS w FROM e WHERE sei > 0) SELECT a.g, a.study, round(sum(b.w * b.yi) / sum(b.w), 6) AS fe, round(1 / sqrt(sum(b.w)), 6) AS fe_se FROM w a JOIN w b ON a.g = b.g AND a.study <> b.study GROUP BY a.g, a.study")
def leave_one_out_fe(spark, sf_dir):
    """STA09."""
    return _rounded(S.leave_one_out(effects(spark, sf_dir), ["g"], "study"), ["g", "study"], ["fe", "fe_se"])


@query(f"WITH {_EFFECTS} SELECT g, count(*) AS k, round(regr_intercept(yi / sei, 1 / sei), 6) AS intercept, round(regr_slope(yi / sei, 1 / sei), 6) AS slope FROM e WHERE sei > 0 GROUP BY g HAVING count(*) >= 10")
def egger_test(spark, sf_dir):
    """STA08."""
    return _rounded(S.egger(effects(spark, sf_dir), ["g"]), ["g", "k"], ["intercept", "slope"])


@query(f"""WITH {_EFFECTS}, w AS (SELECT *, sei * sei AS v, 1 / (sei * sei) AS w FROM e WHERE sei > 0), m AS (SELECT g, sum(w * yi) / sum(w) AS mu, 1 / sum(w) AS vm FROM w GROUP BY g), t AS (SELECT g, study, v, (yi - mu) / sqrt(v - vm) AS t FROM w JOIN m USING (g)),
s AS (SELECT a.g, sum(sign(a.t - b.t) * sign(a.v - b.v)) AS s FROM t a JOIN t b ON a.g = b.g AND a.study < b.study GROUP BY a.g), n AS (SELECT g, count(*) AS k FROM t GROUP BY g) SELECT g, k, round(2 * s / (k * (k - 1)), 9) AS tau FROM s JOIN n USING (g) WHERE k >= 10""")
def begg_test(spark, sf_dir):
    """STA08."""
    return _rounded(S.begg(effects(spark, sf_dir), ["g"]), ["g", "k"], ["tau"], 9)


@query(f"""WITH {_EFFECTS}, w AS (SELECT *, 1 / (sei * sei) AS w FROM e WHERE sei > 0), m AS (SELECT g, sum(w) AS sw, sum(w * yi) / sum(w) AS mu FROM w GROUP BY g), c AS (SELECT g, cluster, sw, mu, sum(w * (yi - mu)) AS s FROM w JOIN m USING (g) GROUP BY ALL)
SELECT g, round(mu, 6) AS estimate, round(sqrt(sum(s * s) * count(*) / (count(*) - 1)) / sw, 6) AS se, count(*) AS clusters FROM c GROUP BY g, sw, mu""")
def cluster_robust(spark, sf_dir):
    """STA10."""
    return _rounded(S.cluster_se(effects(spark, sf_dir), ["g"], "cluster"), ["g", "clusters"], ["estimate", "se"]).select("g", "estimate", "se", "clusters")


@query()
def reml_pool(spark, sf_dir):
    """STA05: restricted maximum likelihood is iterated, so there is no SQL; tests hold it against the likelihood's root."""
    return S.reml(effects(spark, sf_dir), ["g"])


@query("""WITH c AS (SELECT l_linestatus AS g, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS a, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS b FROM lineitem GROUP BY 1), x AS (SELECT a, b FROM c WHERE g = 'F'), y AS (SELECT a AS c, b AS d FROM c WHERE g = 'O')
SELECT round(ln((a + h) * (d + h) / ((b + h) * (c + h))), 9) AS ln_or, round(sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)), 9) AS se, round((a + h) / (a + b + 2 * h) - (c + h) / (c + d + 2 * h), 9) AS rd
FROM (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0 END AS h FROM x, y)""")
def effects_from_counts(spark, sf_dir):
    """STA02."""
    li = table(spark, sf_dir, "lineitem")
    n = lambda s, r: F.count_if((F.col("l_linestatus") == s) & ((F.col("l_returnflag") == "R") == r)).cast("double")
    c = li.agg(n("F", True).alias("a"), n("F", False).alias("b"), n("O", True).alias("c"), n("O", False).alias("d"))
    cells = [F.col(x) for x in "abcd"]
    (o, se), (rd, _) = S.from_counts(*cells, "OR"), S.from_counts(*cells, "RD")
    return c.select(F.round(o, 9).alias("ln_or"), F.round(se, 9).alias("se"), F.round(rd, 9).alias("rd"))


@query("""WITH c AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1), x AS (SELECT a.n AS n1, a.m AS m1, a.s AS s1, b.n AS n2, b.m AS m2, b.s AS s2 FROM c a, c b WHERE a.g = 'A' AND b.g = 'N'),
d AS (SELECT *, (1 - 3 / (4 * (n1 + n2 - 2) - 1)) * (m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) AS smd FROM x)
SELECT round(m1 - m2, 7) AS md, round(sqrt(s1 * s1 / n1 + s2 * s2 / n2), 7) AS md_se, round(smd, 7) AS smd, round(sqrt(1 / n1 + 1 / n2 + smd * smd / (2 * (n1 + n2))), 7) AS smd_se FROM d""")
def effects_from_means(spark, sf_dir):
    """STA02."""
    li, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    of = lambda f, x: F.when(F.col("l_returnflag") == x, q)  # noqa: E731, ARG005
    parts = [f(of(f, x)).alias(f"{n}{i}") for i, x in ((1, "A"), (2, "N")) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]
    c = li.agg(*parts)
    cols = [F.col(x) for x in ("n1", "m1", "s1", "n2", "m2", "s2")]
    (md, mse), (g, gse) = S.from_means(*cols, "MD"), S.from_means(*cols, "SMD")
    return c.select(F.round(md, 7).alias("md"), F.round(mse, 7).alias("md_se"), F.round(g, 7).alias("smd"), F.round(gse, 7).alias("smd_se"))


_SIZES = "(VALUES (1, 0.5, 0.9, 0.7, 0.3, 40, 25), (2, 1.1, 1.9, 0.0, 1.0, 3, 30), (3, -0.2, 0.4, 2.0, -0.6, 12, 12)) AS t(id, lo, hi, ratio, r, n, m)"


@example(f"""SELECT id, round((hi - lo) / (2 * 1.959963984540054), 9)::DOUBLE AS se, round(CASE WHEN ratio > 0 THEN ln(ratio) END, 9) AS lr, round(CASE WHEN abs(r) < 1 THEN atanh(r::DOUBLE) END, 9) AS z, round(CASE WHEN n > 3 THEN 1 / sqrt(n - 3) END, 9) AS z_se,
  round(sqrt((n + m) / (n * m) + r * r / (2 * (n + m - 2))), 9)::DOUBLE AS smd_se, round(0.1 * 1000 * (ratio - 1), 6)::DOUBLE AS per_thousand FROM (SELECT id, lo::DOUBLE AS lo, hi::DOUBLE AS hi, ratio::DOUBLE AS ratio, r::DOUBLE AS r, n::DOUBLE AS n, m::DOUBLE AS m FROM {_SIZES})""")
def effect_sizes(spark, sf_dir):
    """STA01, STA12."""
    t = spark.sql(f"SELECT * FROM {_SIZES}")
    c = {x: F.col(x).cast("double") for x in ("lo", "hi", "ratio", "r", "n", "m")}
    return t.select("id", *(F.round(x, 9).alias(k) for k, x in (("se", S.se_from_ci(c["lo"], c["hi"])), ("lr", S.log_ratio(c["ratio"])), ("z", S.fisher_z(c["r"])), ("z_se", S.fisher_se(c["n"])), ("smd_se", S.smd_se(c["n"], c["m"], c["r"])))), F.round(S.absolute_effect(c["ratio"], F.lit(0.1)), 6).alias("per_thousand"))


@example("SELECT * FROM (VALUES (1, NULL), (2, 'no estimate'), (3, 'no standard error'), (4, 'standard error not positive'), (5, 'estimate not finite')) AS t(id, reason)")
def unusable_rows(spark, sf_dir):
    """STA03, AGG13."""
    t = spark.sql("SELECT * FROM VALUES (1, 0.5D, 0.1D), (2, CAST(NULL AS DOUBLE), 0.1D), (3, 0.5D, CAST(NULL AS DOUBLE)), (4, 0.5D, 0D), (5, double('NaN'), 0.1D) AS t(id, yi, sei)")
    return t.select("id", S.drop_reason(F.col("yi"), F.col("sei")).alias("reason"))


@query("SELECT o_custkey AS review, count(DISTINCT o_orderpriority) AS n_metrics, count(DISTINCT o_orderpriority) > 1 AS refused FROM orders GROUP BY o_custkey")
def mixed_metrics(spark, sf_dir):
    """STA04, AGG13: several metrics in one analysis are refused."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("review")).agg(F.count_distinct("o_orderpriority").alias("n_metrics"), (F.count_distinct("o_orderpriority") > 1).alias("refused"))


_OVERLAP = """WITH m AS (SELECT DISTINCT l_suppkey AS review, l_partkey AS study FROM lineitem), n AS (SELECT review, count(*) AS n FROM m GROUP BY review), p AS (SELECT x.review AS a, y.review AS b, count(*) AS shared FROM m x JOIN m y ON x.study = y.study AND x.review < y.review GROUP BY ALL),
o AS (SELECT a, b, shared, round(shared / least(x.n, y.n), 4) AS share FROM p JOIN n x ON x.review = a JOIN n y ON y.review = b)"""


def _marks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("review"), F.col("l_partkey").alias("study"))


@query(_OVERLAP + " SELECT * FROM o")
def pair_overlap_share(spark, sf_dir):
    """JOIN09, SET05."""
    return S.review_overlap(_marks(spark, sf_dir))


@query(_OVERLAP + " SELECT a, b, 'finding' AS status FROM o WHERE share > 0.25")
def pooling_defensibility(spark, sf_dir):
    """AGG14."""
    return S.pooling_status(S.review_overlap(_marks(spark, sf_dir)), 0.25)


@query(_OVERLAP + ", r AS (SELECT DISTINCT l_suppkey AS review FROM lineitem UNION SELECT s_suppkey + 1000000 FROM supplier), own AS (SELECT l_suppkey AS review, count(DISTINCT l_partkey) AS studies FROM lineitem GROUP BY 1), sides AS (SELECT a AS review FROM o UNION ALL SELECT b FROM o), q AS (SELECT review, count(*) AS partners FROM sides GROUP BY review) SELECT review, coalesce(studies, 0) AS studies, coalesce(partners, 0) AS partners, (SELECT count(*) FROM r) - 1 - coalesce(partners, 0) AS apart FROM r LEFT JOIN own USING (review) LEFT JOIN q USING (review)")
def review_partners(spark, sf_dir):
    """JOIN09: with how many reviews each one shares a study, and with how many none; half of the reviews have no study."""
    reviews = _marks(spark, sf_dir).select("review").distinct().unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("review")))
    return S.overlap_counts(_marks(spark, sf_dir), reviews)


#: Small syntheses: the suppliers of each day; some cells can't be read, some suppliers have no study, some days have metrics of two kinds.
_SYNTHESIS = "substr(CAST(l_shipdate AS STRING), 1, 10) AS g, l_suppkey AS review, l_partkey AS study, CASE WHEN l_suppkey % 29 = 0 AND l_linenumber = 7 THEN NULL ELSE l_linenumber <> 6 OR l_suppkey % 9 > 0 END AS marked, CASE WHEN l_partkey % 97 = 0 THEN 'RR' ELSE 'OR ' END AS metric, CASE WHEN l_quantity > 49 THEN 'late' ELSE 'early' END AS family"
_NOTES = f"""l AS (SELECT {_SYNTHESIS} FROM lineitem), r AS (SELECT g, review, count(DISTINCT metric) AS metrics, count(DISTINCT family) AS families, count(*) FILTER (marked) AS n, count(*) FILTER (marked IS NULL) AS unread FROM l GROUP BY ALL),
m AS (SELECT DISTINCT g, review, study FROM l WHERE marked), z AS (SELECT g, review, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT x.g, x.review AS a, y.review AS b, count(*) AS shared FROM m x JOIN m y ON x.g = y.g AND x.study = y.study AND x.review < y.review GROUP BY ALL),
notes AS (SELECT g, 'gap' AS level, 'unreadable' AS rule, review::VARCHAR AS a, NULL::VARCHAR AS b FROM r WHERE n = 0 OR unread > 0
  UNION ALL SELECT o.g, 'finding', 'overlap', a::VARCHAR, b::VARCHAR FROM o JOIN z x ON x.g = o.g AND x.review = a JOIN z y ON y.g = o.g AND y.review = b WHERE round(shared / least(x.n, y.n), 4) > 0.3
  UNION ALL SELECT g, 'finding', 'metric', review::VARCHAR, NULL FROM r WHERE metrics > 1 UNION ALL SELECT g, 'caution', 'outcome_family', review::VARCHAR, NULL FROM r WHERE families > 1
  UNION ALL SELECT g, 'finding', 'metric_mismatch', NULL, NULL FROM l GROUP BY g HAVING count(DISTINCT metric) > 1 UNION ALL SELECT g, 'finding', 'review_count', NULL, NULL FROM r GROUP BY g HAVING count(*) < 2)"""


def _syntheses(spark, sf_dir):
    first, rest = _SYNTHESIS.split(" AS g, ")
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{first} AS g", *rest.split(", "))
    return rows.select("g", "review", "metric", "family"), rows.select("g", "review", "study", "marked")


@query(f"WITH {_NOTES} SELECT * FROM notes")
def synthesis_notes(spark, sf_dir):
    """AGG14: what speaks against pooling the suppliers of each day."""
    return S.pooling_notes(*_syntheses(spark, sf_dir), "g")


@query(f"WITH {_NOTES}, c AS (SELECT g, count(*) FILTER (level = 'gap') AS gaps, count(*) FILTER (level = 'finding') AS findings, count(*) FILTER (level = 'caution') AS cautions FROM (SELECT DISTINCT g FROM l) LEFT JOIN notes USING (g) GROUP BY g) SELECT *, CASE WHEN gaps > 0 THEN 'insufficient_evidence' WHEN findings > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN gaps > 0 THEN NULL WHEN findings > 0 THEN 'indefensible' ELSE 'pool' END AS verdict FROM c")
def synthesis_verdicts(spark, sf_dir):
    """AGG14: gaps, then findings, then a pass."""
    effects, marks = _syntheses(spark, sf_dir)
    return S.pooling_verdicts(effects, S.pooling_notes(effects, marks, "g"), "g")


_GRAPH = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), g AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _graph(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"WITH RECURSIVE {_GRAPH}, r AS (SELECT 's1' AS id, 0 AS depth UNION SELECT g.dst, depth + 1 FROM r JOIN g ON g.src = r.id WHERE depth < 2) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id")
def k_hop_neighbours(spark, sf_dir):
    """GRA01."""
    return G.k_hop(_graph(spark, sf_dir), spark.sql("SELECT 's1' AS id"), 2)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst),
w AS (SELECT c_custkey AS walk, 0 AS step, c_custkey AS id, [c_custkey] AS stack, [c_custkey] AS seen, 'seed' AS move FROM customer UNION ALL
  SELECT walk, step + 1, s[-1], s, CASE WHEN dst IS NULL THEN seen ELSE seen || [dst] END, CASE WHEN dst IS NULL THEN 'back' ELSE 'forward' END FROM (SELECT *, CASE WHEN dst IS NULL THEN stack[:-2] ELSE stack || [dst] END AS s FROM (
    SELECT w.*, (SELECT e.dst FROM e JOIN c ON c.id = e.dst WHERE e.src = w.id AND NOT list_contains(w.seen, e.dst) AND len(w.stack) <= 3 ORDER BY c.n DESC, e.dst LIMIT 1) AS dst FROM w WHERE step < 8)) WHERE len(s) > 0)
SELECT walk, step, id, move FROM w""")
def citation_walks(spark, sf_dir):
    """GRA01: a bounded walk from every customer's key along the graph of parts and suppliers, at most three deep."""
    one = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    e = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("walk"), F.col("c_custkey").alias("id"))
    return G.walk(e, e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")), seeds, 8, 3)


def _explored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.split("p_type", " ").alias("words"), (F.col("p_size") > 5).alias("keep"))
    n = edges.distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.array().cast("array<string>").alias("words"), F.lit(True).alias("keep"))
    nodes = parts.unionByName(suppliers).join(n, "id", "left").fillna(0, ["n"])
    return G.explore(edges, nodes, parts.select(F.col("id").alias("walk"), "id"), steps=6, most=20, depth_limit=4)


@query()
def citation_explorations(spark, sf_dir):
    """GRA01: a walk from every part along the graph of parts and suppliers, with its seven counters; a test walks by hand."""
    return _explored(spark, sf_dir).select("walk", F.array_join("path", ">").alias("path"), *G.STATS)


@query()
def citation_exploration_edges(spark, sf_dir):
    """GRA01: what these walks went along and what they crossed."""
    out = _explored(spark, sf_dir).select("walk", F.posexplode("edges").alias("place", "e"))
    return out.select("walk", "place", F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.col("e.kind").alias("kind"), F.col("e.crossed").alias("crossed"))


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, max(l_quantity) AS score FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL), r AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM e) SELECT src, dst, total FROM r WHERE k <= 3""")
def related_records(spark, sf_dir):
    """GRA02."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("score"))
    return G.related(li, 3)


@example("SELECT * FROM (VALUES (1, 'heart attack'), (1, 'myocardial infarction'), (2, 'flu'), (2, 'influenza'), (3, 'unknown')) AS t(query_id, term)")
def term_expansion(spark, sf_dir):
    """GRA03."""
    terms = spark.sql("SELECT * FROM VALUES (1, 'Heart attack'), (2, 'flu'), (3, 'unknown') AS t(query_id, term)")
    synonyms = spark.sql("SELECT * FROM VALUES ('c1', 'heart attack'), ('c1', 'Myocardial infarction'), ('c2', 'flu'), ('c2', 'influenza') AS t(concept, synonym)")
    return G.expand_terms(terms, synonyms)
