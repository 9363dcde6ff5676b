"""Queries of the imputation operators, over a panel with holes made by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import imputation as I
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r

#: A cell's value is missing where (7 t + n) % 4 is 0.
HOLES = f"""{V.PANEL_NM}, holes AS (SELECT unit, grp, t, n, CASE WHEN (7 * t + n) % 4 <> 0 THEN value END AS value FROM panel)"""


def holes(spark, sf):
    return V.panel_nm(spark, sf).withColumn("value", F.when((7 * F.col("t") + F.col("n")) % 4 != 0, F.col("value")))


@query(f"""WITH {HOLES}, g AS (SELECT grp, quantile_cont(value, 0.5) AS m FROM holes GROUP BY 1)
SELECT h.unit, h.t, round(coalesce(h.value, g.m, (SELECT quantile_cont(value, 0.5) FROM holes), 0), 4) AS filled FROM holes h LEFT JOIN g USING (grp)""")
def c1_fill_group_median(spark, sf):
    return r(I.fill_group_median(holes(spark, sf), "value", "grp").select("unit", "t", "filled"), "filled", digits=4)


_INTER = """pos AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM holes),
near AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM pos
  WINDOW b AS (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
inter AS (SELECT *, coalesce(value, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0)) AS inside FROM near)"""


@query(f"WITH {HOLES}, {_INTER} SELECT unit, t, round(coalesce(inside, v0, v1), 4) AS filled FROM inter")
def c2_interpolate_both(spark, sf):
    return r(I.interpolate(holes(spark, sf), "value").select("unit", "t", "filled"), "filled", digits=4)


@query(f"WITH {HOLES}, {_INTER} SELECT unit, t, round(inside, 4) AS filled FROM inter")
def c3_interpolate_inside(spark, sf):
    return r(I.interpolate(holes(spark, sf), "value", edges=False).select("unit", "t", "filled"), "filled", digits=4)


@query(f"""WITH {HOLES}, {_INTER}, gt AS (SELECT grp, t, quantile_cont(inside, 0.5) AS m FROM inter GROUP BY ALL), g AS (SELECT grp, quantile_cont(inside, 0.5) AS m FROM inter GROUP BY ALL)
SELECT i.unit, i.t, round(coalesce(i.inside, gt.m, g.m, (SELECT quantile_cont(inside, 0.5) FROM inter)), 4) AS filled,
 CASE WHEN i.value IS NOT NULL THEN 'observed' WHEN i.inside IS NOT NULL THEN 'interpolated' WHEN gt.m IS NOT NULL THEN 'group_period' WHEN g.m IS NOT NULL THEN 'group' ELSE 'all' END AS strategy
FROM inter i LEFT JOIN gt ON i.grp = gt.grp AND i.t = gt.t LEFT JOIN g ON i.grp = g.grp""")
def c4_cascade_fill(spark, sf):
    return r(I.cascade_fill(holes(spark, sf), "value", "grp").select("unit", "t", "filled", "strategy"), "filled", digits=4)


@query(f"""WITH {HOLES}, s AS (SELECT *, CASE WHEN max(n) OVER (PARTITION BY t) > min(n) OVER (PARTITION BY t) THEN (n - min(n) OVER (PARTITION BY t))::DOUBLE / (max(n) OVER (PARTITION BY t) - min(n) OVER (PARTITION BY t)) ELSE 0 END AS f FROM holes),
d AS (SELECT a.t, a.unit, b.value AS v, abs(a.f - b.f) AS d, row_number() OVER (PARTITION BY a.t, a.unit ORDER BY sqrt((a.f - b.f) ** 2), b.unit) AS k FROM s a JOIN s b ON a.t = b.t AND a.value IS NULL AND b.value IS NOT NULL),
w AS (SELECT t, unit, sum(v / (d + 1e-9)) / sum(1 / (d + 1e-9)) AS m FROM d WHERE k <= 5 GROUP BY ALL)
SELECT h.unit, h.t, round(coalesce(h.value, w.m), 2) AS filled FROM holes h LEFT JOIN w ON h.t = w.t AND h.unit = w.unit""")
def c5_knn_fill(spark, sf):
    df = holes(spark, sf).withColumn("m", F.col("n").cast("double"))
    return r(I.knn_fill(df, "value", ["m"], ["t"]).select("unit", "t", "filled"), "filled", digits=2)


@query(f"""WITH {HOLES}, gt AS (SELECT grp, t, quantile_cont(value, 0.5) AS m FROM holes GROUP BY ALL), p AS (SELECT t, quantile_cont(value, 0.5) AS m FROM holes GROUP BY ALL)
SELECT h.unit, h.t, round(coalesce(h.value, gt.m, p.m, (SELECT quantile_cont(value, 0.5) FROM holes)), 4) AS filled,
 CASE WHEN h.value IS NOT NULL THEN 'observed' WHEN gt.m IS NOT NULL THEN 'group' WHEN p.m IS NOT NULL THEN 'period' ELSE 'all' END AS strategy
FROM holes h LEFT JOIN gt ON h.grp = gt.grp AND h.t = gt.t LEFT JOIN p ON h.t = p.t""")
def c6_pool_fill(spark, sf):
    return r(I.pool_fill(holes(spark, sf), "value", "grp").select("unit", "t", "filled", "strategy"), "filled", digits=4)


@query(f"""WITH {V.PANEL_SY}, s AS (SELECT unit, t, CASE WHEN t >= 2000 THEN value END AS s, CASE WHEN t >= 1997 THEN qty END AS h FROM panel),
b AS (SELECT unit, max(t) AS bt, max_by(s, t) AS bs, max_by(h, t) AS bh FROM s WHERE s IS NOT NULL AND h > 0 GROUP BY 1)
SELECT s.unit, s.t, round(coalesce(s.s, bs * h / bh), 4) AS filled, CASE WHEN s.s IS NOT NULL THEN 'snapshot' WHEN bs * h / bh IS NOT NULL THEN 'history' ELSE 'missing' END AS source FROM s LEFT JOIN b USING (unit)""")
def c7_backcast(spark, sf):
    p = V.panel_sy(spark, sf).select("unit", "t", F.when(F.col("t") >= 2000, F.col("value")).alias("s"), F.when(F.col("t") >= 1997, F.col("qty")).alias("h"))
    return r(I.backcast(p, "s", "h").select("unit", "t", "filled", "source"), "filled", digits=4)


@query(f"""WITH {HOLES}, tr AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(n, 0.5) AS mn FROM holes WHERE t < 48)
SELECT unit, t, round(coalesce(value, mv), 4) AS value, coalesce(n, mn)::DOUBLE AS n FROM holes, tr""")
def c9_resolve_features(spark, sf):
    df = holes(spark, sf).select("unit", "t", "value", F.col("n").cast("double").alias("n"), F.when(F.col("t") % 3 == 0, 1.0).alias("rare"))
    return r(I.resolve_features(df, ["value", "n", "rare"], F.col("t") < 48), "value", digits=4)


@query(f"""WITH {V.PANEL_SY} SELECT unit, t, round(0.7 * (value - (SELECT min(value) FROM panel)) / (SELECT max(value) - min(value) FROM panel) + 0.3 * (disc - (SELECT min(disc) FROM panel)) / (SELECT max(disc) - min(disc) FROM panel), 6) AS proxy FROM panel""")
def c10_derived_proxy(spark, sf):
    return r(I.derived_proxy(V.panel_sy(spark, sf), "value", "disc").select("unit", "t", "proxy"), "proxy")


@query(f"""WITH {V.PANEL_SY}, g AS (SELECT unit, t, CASE WHEN t >= 1997 AND unit % 7 > 0 THEN ln(value) END AS y, CASE WHEN unit % 11 > 0 THEN ln(qty) END AS x FROM panel), m AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM g WHERE t <= 1999)
SELECT unit, t, round(coalesce(y, i + s * x), 6) AS filled, (y IS NULL AND x IS NOT NULL)::INT AS filled_flag, CASE WHEN y IS NOT NULL THEN 'observed' WHEN x IS NOT NULL THEN 'model' ELSE 'missing' END AS filled_source FROM g, m""")
def c8_model_backcast(spark, sf):
    g = V.panel_sy(spark, sf).select("unit", "t", F.when((F.col("t") >= 1997) & (F.col("unit") % 7 > 0), F.log("value")).alias("y"), F.when(F.col("unit") % 11 > 0, F.log("qty")).alias("x"))
    return r(I.model_backcast(g, "y", ["x"], 1999).select("unit", "t", "filled", "filled_flag", "filled_source"), "filled")
