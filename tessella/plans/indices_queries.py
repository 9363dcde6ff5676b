"""Queries of the index operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import indices as X
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r


@query(f"""WITH {V.PANEL_NM}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM panel)
SELECT unit, t, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS in_period, round((value - lo) / (hi - lo), 6) AS in_all, round((value - lo) / (hi - lo), 6) AS plain
FROM panel, b WINDOW w AS (PARTITION BY t)""")
def d1_minmax(spark, sf):
    return r(X.scale_by_period(V.panel_nm(spark, sf), "value").drop("grp", "value", "n"), "in_period", "in_all", "plain")


@query(f"""WITH {V.PANEL_NM} SELECT unit, t, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) AS z,
 round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) AS z_sample FROM panel WINDOW w AS (PARTITION BY t)""")
def d2_zscores(spark, sf):
    return r(X.zscores(V.panel_nm(spark, sf), "value").drop("grp", "value", "n"), "z", "z_sample")


@query(f"""WITH {V.PANEL_NM}, d AS (SELECT *, value - quantile_cont(value, 0.5) OVER (PARTITION BY grp) AS d FROM panel), m AS (SELECT *, quantile_cont(abs(d), 0.5) OVER (PARTITION BY grp) * 1.4826 AS mad FROM d)
SELECT unit, t, round(d / mad, 6) AS robust_z FROM m""")
def d3_robust_z(spark, sf):
    return r(X.robust_z(V.panel_nm(spark, sf), "value", "grp").select("unit", "t", "robust_z"), "robust_z")


@query(f"""WITH {V.PANEL_SY}, v AS (SELECT unit, t, CASE WHEN qty % 5 <> 0 THEN qty // 50 END AS x FROM panel),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY x ASC NULLS LAST) + (count(x) OVER (PARTITION BY t, x) - 1) / 2) / count(x) OVER (PARTITION BY t) END AS p FROM v)
SELECT unit, t, round(coalesce(p, avg(p) OVER (PARTITION BY t)), 6) AS rank_pct FROM k""")
def d4_percent_rank(spark, sf):
    df = V.panel_sy(spark, sf).select("unit", "t", F.when(F.col("qty") % 5 != 0, F.floor(F.col("qty") / 50)).alias("x"))
    return r(X.percent_rank(df, "x", "t").select("unit", "t", "rank_pct"), "rank_pct")


_PARTS = "CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS a, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS b"


@query(f"""WITH p AS (SELECT c_custkey, {_PARTS} FROM customer), w AS (SELECT *, (CASE WHEN a IS NULL THEN 0.0 ELSE 0.7 END + CASE WHEN b IS NULL THEN 0.0 ELSE 0.3 END)::DOUBLE AS w FROM p)
SELECT c_custkey, round(CASE WHEN w > 0 THEN (coalesce(a * 0.7::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0)) / w END, 7) AS blend, round(CASE WHEN a IS NOT NULL THEN least(greatest(1 - a, 0), 1) END, 6) AS inverse,
 round(CASE WHEN w > 0 THEN (coalesce(a * 0.7::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0)) / w ELSE 50 END, 7) AS composite FROM w""")
def d5_weighted_blend(spark, sf):
    """Also the kept-null inverse (d6) and the composite with a default (d9)."""
    a = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000)
    b = F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 100) / 100.0)
    df = V.table(spark, sf, "customer").select("c_custkey", a.alias("a"), b.alias("b"))
    parts = [(F.col("a"), 0.7), (F.col("b"), 0.3)]
    return r(r(df.select("c_custkey", X.weighted_blend(parts).alias("blend"), X.one_minus(F.col("a")).alias("inverse"), X.weighted_blend(parts, 50.0).alias("composite")), "inverse"), "blend", "composite", digits=7)


@query(f"""WITH {V.PANEL_SY}, b AS (SELECT min(value) AS l1, max(value) AS h1, min(disc) AS l2, max(disc) AS h2, count(*) AS n FROM panel), s AS (SELECT (value - l1) / (h1 - l1) + 1e-12 AS a, (disc - l2) / (h2 - l2) + 1e-12 AS b, b.n FROM panel, b),
p AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b, n FROM s), e AS (SELECT 1 + sum(a * ln(a)) / ln(max(n)) AS a, 1 + sum(b * ln(b)) / ln(max(n)) AS b FROM p)
SELECT 'value' AS "column", round(a / (a + b), 6) AS weight FROM e UNION ALL SELECT 'disc', round(b / (a + b), 6) FROM e""")
def d7_entropy_weights(spark, sf):
    return r(X.entropy_weights(V.panel_sy(spark, sf), ["value", "disc"]), "weight")


@query(f"""WITH {V.PANEL_SY}, l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY unit ORDER BY t DESC) = 1), s AS (SELECT unit, value / 1000000 * 0.5 + disc * 10 * 0.5 AS b, value / 1000000 * 0.9 + disc * 10 * 0.1 AS v, value / 1000000 * 0.1 + disc * 10 * 0.9 AS d FROM l),
long AS (SELECT unit, b, 'even' AS scheme, b AS score FROM s UNION ALL SELECT unit, b, 'volume', v FROM s UNION ALL SELECT unit, b, 'discount', d FROM s),
k AS (SELECT *, rank() OVER (PARTITION BY scheme ORDER BY score) AS r, rank() OVER (PARTITION BY scheme ORDER BY b) AS rb, row_number() OVER (PARTITION BY scheme ORDER BY score DESC, unit) AS p, row_number() OVER (PARTITION BY scheme ORDER BY b DESC, unit) AS pb FROM long)
SELECT scheme, round(corr(r, rb), 6) AS spearman, sum((p <= 10 AND pb <= 10)::INT)::BIGINT AS shared_top FROM k GROUP BY 1""")
def d11_weight_sensitivity(spark, sf):
    df = V.edge_rows(V.panel_sy(spark, sf)).select("unit", (F.col("value") / 1000000).alias("v"), (F.col("disc") * 10).alias("d"))
    return r(X.weight_sensitivity(df, "unit", ["v", "d"], {"even": [0.5, 0.5], "volume": [0.9, 0.1], "discount": [0.1, 0.9]}, "even"), "spearman")


@query(f"""WITH {V.PANEL_NM}, q AS (SELECT *, quantile_cont(value, 0.33) OVER w AS lo, quantile_cont(value, 0.67) OVER w AS hi, count(value) OVER w AS k FROM panel WINDOW w AS (PARTITION BY t)),
i AS (SELECT t, CASE WHEN k < 12 THEN 'unclassified' WHEN value <= lo THEN 'low' WHEN value <= hi THEN 'middle' ELSE 'high' END AS tier, value FROM q)
SELECT t, tier, count(*) AS units, round(avg(value), 4) AS mean FROM i GROUP BY ALL""")
def d12_tiers(spark, sf):
    return r(X.tiers(V.panel_nm(spark, sf), "value").groupBy("t", "tier").agg(F.count("*").alias("units"), F.avg("value").alias("mean")), "mean", digits=4)


@query(f"""WITH {V.PANEL_SY}, s AS (SELECT *, sum(qty) OVER (PARTITION BY cl, t) AS q, sum(value) OVER (PARTITION BY cl, t) AS v FROM panel)
SELECT unit, t, round(qty / q, 6) AS share, round(qty / q * v, 4) AS part FROM s""")
def d13_disaggregate(spark, sf):
    return r(r(X.disaggregate(V.panel_sy(spark, sf), "value", "qty", "cl").select("unit", "t", "share", "part"), "share"), "part", digits=4)


@query("SELECT round(avg(v), 6) AS share, count(*) AS groups FROM (SELECT l_orderkey, (count(DISTINCT l_returnflag) > 1)::INT::DOUBLE AS v FROM lineitem GROUP BY 1)")
def d14_variation_share(spark, sf):
    return r(X.variation_share(V.table(spark, sf, "lineitem"), "l_returnflag", ["l_orderkey"]), "share")


@query(f"""WITH {V.PANEL_SY}, e AS (SELECT list_distinct(quantile_cont(qty, [0.2, 0.4, 0.6, 0.8])) AS e FROM panel), b AS (SELECT len(list_filter(e, lambda x: qty > x))::INT AS bin, qty FROM panel, e)
SELECT bin, count(*) AS n, min(qty) AS least, max(qty) AS most FROM b GROUP BY 1""")
def d15_quantile_bins(spark, sf):
    return X.quantile_bins(V.panel_sy(spark, sf), "qty", 5).groupBy("bin").agg(F.count("*").alias("n"), F.min("qty").alias("least"), F.max("qty").alias("most"))


@query(f"""WITH {V.PANEL_SY}, k AS (SELECT *, max(value) OVER (PARTITION BY t ORDER BY disc, value DESC, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM panel)
SELECT t, unit, round(value, 2) AS value, round(disc, 6) AS disc FROM k WHERE top IS NULL OR value > top""")
def d16_pareto(spark, sf):
    return r(r(X.pareto(V.panel_sy(spark, sf), "value", "disc", "unit", "t").select("t", "unit", "value", "disc"), "value", digits=2), "disc")


@query(f"""WITH {V.PANEL_SY}, l AS (SELECT unit, t, ln(value) AS y, ln(qty) AS x FROM panel), b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l), f AS (SELECT unit, t, y, i + s * x AS fit FROM l, b)
SELECT unit, t, round(fit, 5) AS fitted, round(y - fit, 5) AS residual, round((fit - min(fit) OVER ()) / (max(fit) OVER () - min(fit) OVER ()), 5) AS "index" FROM f""")
def d8_production_fit(spark, sf):
    return r(X.production_fit(V.panel_sy(spark, sf), "value", ["qty"]).select("unit", "t", "fitted", "residual", "index"), "fitted", "residual", "index", digits=5)


@query(f"""WITH {V.PANEL_SY}, z AS (SELECT unit, t, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS a, (qty - avg(qty) OVER ()) / stddev_pop(qty) OVER () AS b FROM panel), c AS (SELECT corr(a, b) AS c FROM z), s AS (SELECT unit, t, a + sign(c) * b AS s, (1 + abs(c)) / 2 AS e FROM z, c)
SELECT unit, t, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) * 100, 5) AS component, round(e, 6) AS explained FROM s""")
def d10_principal_component(spark, sf):
    p = V.panel_sy(spark, sf).withColumn("qty", F.col("qty").cast("double"))
    return r(r(X.principal_component(p, ["value", "qty"]).select("unit", "t", "component", "explained"), "component", digits=5), "explained")


@query(f"WITH {V.PANEL_SY} SELECT unit, t, round(least(greatest(1 - disc * 15, 0), 1), 6) AS rest FROM panel")
def d6_one_minus(spark, sf):
    return r(V.panel_sy(spark, sf).select("unit", "t", X.one_minus(F.col("disc") * 15).alias("rest")), "rest")


@query(f"""WITH {V.PANEL_SY}, s AS (SELECT unit, t, CASE WHEN unit % 3 > 0 THEN disc * 10 END AS a, CASE WHEN t % 2 = 0 THEN qty / 1000.0 END AS b, CASE WHEN unit % 3 > 0 THEN 0.5 ELSE 0 END + CASE WHEN t % 2 = 0 THEN 0.3 ELSE 0 END AS w FROM panel)
SELECT unit, t, CASE WHEN w > 0 THEN round((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0)) / w, 6) END AS composite FROM s""")
def d9_composite(spark, sf):
    p = V.panel_sy(spark, sf).select("unit", "t", F.when(F.col("unit") % 3 > 0, F.col("disc") * 10).alias("a"), F.when(F.col("t") % 2 == 0, F.col("qty") / 1000.0).alias("b"))
    return r(p.select("unit", "t", X.weighted_blend([(F.col("a"), 0.5), (F.col("b"), 0.3)]).alias("composite")), "composite")


@query(f"""WITH {V.PANEL_SY}, l AS (SELECT unit, t, unnest(['even', 'value', 'disc']) AS scheme, unnest([0.5, 0.9, 0.1]) * value / 1000000 + unnest([0.5, 0.1, 0.9]) * disc * 10 AS x FROM panel), d AS (SELECT *, x - lag(x) OVER (PARTITION BY scheme, unit ORDER BY t) AS d FROM l), n AS (SELECT *, lead(d) OVER (PARTITION BY scheme, unit ORDER BY t) AS nx FROM d),
q AS (SELECT scheme, quantile_cont(d, 0.3) AS cut FROM d GROUP BY 1), s AS (SELECT scheme, -d AS s, (nx <= cut)::INT AS y FROM n JOIN q USING (scheme) WHERE d IS NOT NULL AND nx IS NOT NULL), k AS (SELECT scheme, y, rank() OVER (PARTITION BY scheme ORDER BY s) + (count(*) OVER (PARTITION BY scheme, s) - 1) / 2 AS rk FROM s)
SELECT scheme, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY 1""")
def d11_scheme_auc(spark, sf):
    p = V.panel_sy(spark, sf).select("unit", "t", (F.col("value") / 1000000).alias("v"), (F.col("disc") * 10).alias("d"))
    return r(X.scheme_auc(p, ["v", "d"], {"even": [0.5, 0.5], "value": [0.9, 0.1], "disc": [0.1, 0.9]}), "auc")
