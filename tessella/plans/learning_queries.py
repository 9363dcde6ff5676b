"""Queries of hold-outs, forecasts, classifiers and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import learning as L
from tessella.operators.nowcast import nowcasts
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.regression_queries import SYD, U32, _syd
from tessella.plans.shaping_queries import r
from tessella.plans.sql import POISSON

NEXT = f"{SYD}, q AS (SELECT * FROM (SELECT *, cl % 5 AS grp, lead(y) OVER (PARTITION BY unit ORDER BY t) AS target FROM p) WHERE target IS NOT NULL)"
E3 = "round(sqrt(avg(({p} - target) ** 2)), 6) AS {n}_rmse, round(avg(abs({p} - target)), 6) AS {n}_mae, round(1 - sum(({p} - target) ** 2) / nullif(var_pop(target) * count(*), 0), 6) AS {n}_r2"
LIN = ("linear_rmse", "linear_mae", "linear_r2")


def _grouped(spark, sf):
    return _syd(spark, sf).withColumn("grp", F.col("cl") % 5)


@query(f"""WITH {NEXT}, ts AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM q)), b AS (SELECT ts.t, regr_slope(q.target, q.y) AS s, regr_intercept(q.target, q.y) AS i0, avg(q.target) AS m, count(*) AS n FROM ts JOIN q ON q.t < ts.t WHERE ts.i > 2 GROUP BY 1),
e AS (SELECT q.*, i0 + s * y AS lin, m, n FROM q JOIN b USING (t)) SELECT t, any_value(n) AS n_train, count(*) AS n_test, {E3.format(p='lin', n='linear')}, {E3.format(p='m', n='mean')}, {E3.format(p='y', n='persistence')}, round(avg((sign(lin - y) = sign(target - y))::INT), 6) AS directional FROM e GROUP BY t""")
def m8_prospective(spark, sf):
    kinds = [f"{m}_{e}" for m in ("linear", "mean", "persistence") for e in ("rmse", "mae", "r2")]
    return r(L.prospective(_syd(spark, sf), "y", ["y"]), *kinds, "directional")


def _split(name: str, x: str) -> str:
    return f"SELECT '{name}' AS features, count(*) AS n_test, {E3.format(p=f'(i0 + s * {x})', n='linear')} FROM q, (SELECT regr_slope(target, {x}) AS s, regr_intercept(target, {x}) AS i0 FROM q WHERE t <= 1998) WHERE t > 1998"


@query(f"WITH {NEXT}, a AS ({_split('level', 'y')} UNION ALL {_split('size', 'x')}) SELECT *, round(linear_rmse - min(linear_rmse) OVER (), 5) AS rmse_over_best FROM a")
def m10_feature_ablation(spark, sf):
    return r(r(L.temporal_holdout(_syd(spark, sf), "y", {"level": ["y"], "size": ["x"]}, 1998), *LIN), "rmse_over_best", digits=5)


@query(f"WITH {NEXT}, b AS (SELECT g.grp AS left_out, regr_slope(q.target, q.y) AS s, regr_intercept(q.target, q.y) AS i0 FROM (SELECT DISTINCT grp FROM q) g JOIN q ON q.grp <> g.grp GROUP BY 1) SELECT left_out, count(*) AS n_test, {E3.format(p='(i0 + s * y)', n='linear')} FROM q JOIN b ON q.grp = left_out GROUP BY 1")
def m9_spatial_holdout(spark, sf):
    return r(L.spatial_holdout(_grouped(spark, sf), "y", ["y"], "grp"), *LIN)


@query(f"WITH {NEXT}, b AS (SELECT grp AS trained_on, regr_slope(target, y) AS s, regr_intercept(target, y) AS i0 FROM q GROUP BY 1) SELECT trained_on, q.grp AS tested_on, count(*) AS n_test, {E3.format(p='(i0 + s * y)', n='linear')} FROM q JOIN b ON q.grp <> trained_on GROUP BY ALL")
def m9_transfer_matrix(spark, sf):
    return r(L.transfer_matrix(_grouped(spark, sf), "y", ["y"], "grp"), *LIN)


def _halves(spark, sf):
    s = V.scores(spark, sf)
    return s.filter("id % 2 = 0"), s.filter("id % 2 = 1")


@query()
def m11_classifier(spark, sf):
    """Newton steps; tested against plain Python."""
    train, test = _halves(spark, sf)
    return r(L.trained_classifier(train, test, "y", {"length": ["p"], "other": ["q"], "both": ["p", "q"]}), "auc", "brier", "objective", digits=5)


@query()
def m12_platt(spark, sf):
    """Newton steps; tested against plain Python."""
    train, test = (h.drop("p").withColumnRenamed("q", "s") for h in _halves(spark, sf))
    return r(L.platt(train, test, "y", "s").select("id", "s", "p"), "p", digits=5)


@query(f"""WITH {V.SCORES}, g AS (SELECT grp, sum(y) AS s, count(y) AS n FROM scores WHERE id % 2 = 0 GROUP BY 1), k AS (SELECT grp, unnest([1.0, 10.0, 100.0])::DOUBLE AS strength, s, n FROM g), pr AS (SELECT grp, strength, (s + strength * (SELECT avg(y) FROM scores WHERE id % 2 = 0)) / (n + strength) AS prior FROM k)
SELECT strength, count(*) AS n_test, round(avg((0.5 * p + 0.5 * prior - y) ** 2), 6) AS brier FROM scores JOIN pr USING (grp) WHERE id % 2 = 1 GROUP BY 1""")
def m12_prior_shrinkage(spark, sf):
    train, test = _halves(spark, sf)
    return r(L.prior_shrinkage(train, test, "y", "p", "grp", [1, 10, 100]), "brier")


AUC = "(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))"


@query(f"""WITH {V.SCORES}, f AS (SELECT w, y, (w * p + (10 - w) * q) / 10 AS f FROM scores, (SELECT unnest(range(0, 11))::INT AS w)), k AS (SELECT w, y, f, rank() OVER (PARTITION BY w ORDER BY f) + (count(*) OVER (PARTITION BY w, f) - 1) / 2 AS rk FROM f),
a AS (SELECT w, {AUC} AS auc, avg((f - y) ** 2) AS brier FROM k GROUP BY 1) SELECT w, round(auc, 6) AS auc, round(brier, 6) AS brier, round(auc - 0.15 * brier, 6) AS objective, (row_number() OVER (ORDER BY round(auc - 0.15 * brier, 9) DESC, w) = 1)::INT AS best FROM a""")
def m14_fusion_grid(spark, sf):
    return r(L.fusion_grid(V.scores(spark, sf), "y", "p", "q"), "auc", "brier", "objective")


@query(f"""WITH {V.SCORES}, g AS (SELECT w, (w * p + (10 - w) * q) / 10 - y AS e, id % 2 = 0 AS dev FROM scores, (SELECT unnest(range(0, 11))::INT AS w)), a AS (SELECT w, sqrt(avg(CASE WHEN dev THEN e * e END)) AS d, sqrt(avg(CASE WHEN NOT dev THEN e * e END)) AS t FROM g GROUP BY 1)
SELECT w, round(d, 6) AS dev_rmse, round(t, 6) AS test_rmse, (row_number() OVER (ORDER BY round(d, 9), w) = 1)::INT AS chosen FROM a""")
def m19_blend_grid(spark, sf):
    return r(L.blend_grid(V.scores(spark, sf), "y", "p", "q", F.col("id") % 2 == 0), "dev_rmse", "test_rmse")


def _importance(feature: str) -> str:
    score = {"p": "0.7 * v + 0.3 * q", "q": "0.7 * p + 0.3 * v"}[feature]
    return f"""SELECT '{feature}' AS feature, (SELECT {AUC} FROM base) - {AUC} AS d FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM (SELECT y, {score} AS s FROM ro JOIN (SELECT {feature} AS v, row_number() OVER (ORDER BY {U32.format(k=f"'{feature}:' || id")}, id) AS i FROM scores) USING (i)))"""


@query(f"""WITH {V.SCORES}, ro AS (SELECT *, row_number() OVER (ORDER BY {U32.format(k="'rows:' || id")}, id) AS i FROM scores), base AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM (SELECT y, 0.7 * p + 0.3 * q AS s FROM scores))
SELECT feature, round(d, 6) AS auc_drop FROM ({_importance('p')} UNION ALL {_importance('q')})""")
def m16_permutation_importance(spark, sf):
    return r(L.permutation_importance(V.scores(spark, sf), "y", {"p": 0.7, "q": 0.3}, "id"), "auc_drop")


@query(f"""WITH {V.PANEL_NM}, d AS (SELECT unit, t, ln(value) AS v, lag(ln(value)) OVER (PARTITION BY unit ORDER BY t) AS x FROM panel), f AS (SELECT * FROM d WHERE x IS NOT NULL),
s AS (SELECT unit, t, v, x, count(*) OVER w AS n, sum(x) OVER w AS sx, sum(v) OVER w AS sv, sum(x * x) OVER w AS sxx, sum(x * v) OVER w AS sxv FROM f WINDOW w AS (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT unit, t, round(v, 6) AS actual, round(x, 6) AS naive, round(sv / n + (sxv - sx * sv / n) / (sxx - sx * sx / n + 1) * (x - sx / n), 5) AS ar FROM s WHERE n >= 5""")
def n2_rolling_forecasts(spark, sf):
    p = V.panel_nm(spark, sf).select("unit", "t", F.log("value").alias("v"))
    return r(r(L.rolling_forecasts(p, "v"), "actual", "naive"), "ar", digits=5)


@query(f"""WITH {V.SCORES}, d AS (SELECT id, (q - y) ** 2 - (p - y) ** 2 AS g FROM scores), b AS (SELECT *, unnest(range(1, 201))::INT AS draw FROM d), u AS (SELECT *, {U32.format(k="draw || ':' || id")} AS u FROM b),
w AS (SELECT *, {POISSON} AS w FROM u),
n AS (SELECT draw, sum(w * g) / nullif(sum(w), 0) AS b FROM w GROUP BY 1) SELECT (SELECT round(avg(g), 6) FROM d) AS gain, (SELECT count(*) FROM d) AS n, round(quantile_cont(b, 0.025), 6) AS low, round(quantile_cont(b, 0.975), 6) AS high, round(least(1.0, 2 * least(avg((b <= 0)::INT), avg((b >= 0)::INT))), 6)::DOUBLE AS p FROM n""")
def l4_brier_gain(spark, sf):
    return r(L.bootstrap_brier_gain(V.scores(spark, sf), "y", "p", "q", "id"), "gain", "low", "high", "p")


@query()
def n1_nowcast(spark, sf):
    """The series of each supplier nation's yearly value, per cent of the largest; tested against plain Python."""
    g = V.panel_sy(spark, sf).groupBy(F.col("cl").alias("grp"), "t").agg((F.sum(V.cents("value")) / 100.0).alias("value"))
    series = g.select("grp", "t", (100 * F.col("value") / F.max("value").over(Window.partitionBy("t"))).alias("score"))
    numbers = ("level", "nowcast", "low80", "high80", "low95", "high95", "trend", "p_up", "p_down", "mae", "rmse", "directional", "coverage95")
    return r(nowcasts(series), *numbers, digits=4)
