"""Queries of the cross-fitted, matched and counterfactual estimators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import estimators as C
from tessella.plans import views as V
from tessella.plans.events_queries import NM, _np
from tessella.plans.registry import query
from tessella.plans.regression_queries import HET, SYD, U32, _syd
from tessella.plans.shaping_queries import r

FOLD = f"floor({U32.format(k="'fold:' || unit")} * 3)::INT"
#: Cross-fitted predictions at one covariate: models of all rows outside the fold.
OUT = "(SELECT g.fold, {fits} FROM (SELECT DISTINCT fold FROM {rows}) g JOIN {rows} k ON k.fold <> g.fold {where} GROUP BY 1)"
LINE = "regr_intercept({y}, {x}) AS i{n}, regr_slope({y}, {x}) AS s{n}"
INSIDE = "least(greatest({v}, 1e-4), 1 - 1e-4)"


@query(f"""WITH {SYD}, f AS (SELECT *, {FOLD} AS fold, {INSIDE.format(v='regr_intercept(did, x) OVER () + regr_slope(did, x) OVER () * x')} AS ps FROM p), n AS (SELECT count(*) AS n, sum((ps BETWEEN 0.03 AND 0.97)::INT) AS k FROM f),
k AS (SELECT f.*, n.n, n.k, n.k >= greatest(60, floor(0.45 * n.n)) AS ok FROM f, n WHERE n.k < greatest(60, floor(0.45 * n.n)) OR ps BETWEEN 0.03 AND 0.97), b AS {OUT.format(rows='k', where='', fits=LINE.format(y='y', x='x', n=1) + ', ' + LINE.format(y='did', x='x', n=2))},
e AS (SELECT y - i1 - s1 * x AS yt, did - {INSIDE.format(v='i2 + s2 * x')} AS dt, n, k, ok FROM k JOIN b USING (fold)), t AS (SELECT sum(dt * yt) / sum(dt * dt) AS theta, avg(dt * dt) AS m FROM e)
SELECT round(theta, 6) AS coef, round(sqrt(avg((dt * (yt - theta * dt)) ** 2) / count(*)) / m, 6) AS stderr, count(*) AS n_obs, round(CASE WHEN any_value(ok) THEN 1 - any_value(k) / any_value(n) ELSE 0 END, 6)::DOUBLE AS trimmed_share FROM e, t GROUP BY theta, m""")
def k22_double_ml(spark, sf):
    return r(C.double_ml(_syd(spark, sf), "y", "did", ["x"]), "coef", "stderr", "trimmed_share")


DIFF = f"{SYD}, d AS (SELECT unit, did AS d, y - lag(y) OVER w AS dy, lag(x) OVER w AS x FROM p WINDOW w AS (PARTITION BY unit ORDER BY t)), f AS (SELECT *, {FOLD} AS fold FROM d WHERE dy IS NOT NULL)"


@query(f"""WITH {DIFF}, b AS {OUT.format(rows='f', where='', fits=LINE.format(y='d', x='x', n=1))}, c AS {OUT.format(rows='f', where='AND k.d = 0', fits=LINE.format(y='dy', x='x', n=0))},
e AS (SELECT d, {INSIDE.format(v='b.i1 + b.s1 * x')} AS p, dy - c.i0 - c.s0 * x AS e FROM f JOIN b USING (fold) JOIN c USING (fold)), n AS (SELECT count(*) AS n, sum((p BETWEEN 0.05 AND 0.95)::INT) AS k FROM e),
k AS (SELECT e.*, n.n, n.k, n.k >= greatest(60, floor(0.55 * n.n)) AS ok FROM e, n WHERE n.k < greatest(60, floor(0.55 * n.n)) OR p BETWEEN 0.05 AND 0.95), s AS (SELECT (d - (1 - d) * p / greatest(1 - p, 1e-4)) * e / avg(d) OVER () AS c, n, k, ok FROM k)
SELECT round(avg(c), 6) AS coef, round(sqrt(var_pop(c) / count(*)), 6) AS stderr, count(*) AS n_obs, round(CASE WHEN any_value(ok) THEN 1 - any_value(k) / any_value(n) ELSE 0 END, 6)::DOUBLE AS trimmed_share FROM s""")
def k23_doubly_robust_did(spark, sf):
    return r(C.doubly_robust_did(_syd(spark, sf), "y", "did", ["x"]), "coef", "stderr", "trimmed_share")


def _dr(covariate: str) -> str:
    fits = lambda n, y: f"avg({y}) AS i{n}, 0.0::DOUBLE AS s{n}" if covariate == "0" else LINE.format(y=y, x=covariate, n=n)
    return f"""(WITH f AS (SELECT *, {FOLD} AS fold FROM p), a1 AS {OUT.format(rows='f', where='AND k.did = 1', fits=fits(1, 'y'))}, a0 AS {OUT.format(rows='f', where='AND k.did = 0', fits=fits(0, 'y'))}, a2 AS {OUT.format(rows='f', where='', fits=fits(2, 'did'))},
m AS (SELECT f.*, i1 + s1 * {covariate} AS m1, i0 + s0 * {covariate} AS m0, least(greatest(i2 + s2 * {covariate}, 0.05), 0.95) AS e FROM f JOIN a1 USING (fold) JOIN a0 USING (fold) JOIN a2 USING (fold))
SELECT *, m1 - m0 + did * (y - m1) / e - (1 - did) * (y - m0) / (1 - e) AS tau FROM m)"""


@query(f"""WITH {SYD}, s AS {_dr('x')} SELECT t, grp, round(avg(tau), 6) AS ate, round(stddev_pop(tau) / sqrt(count(*)), 6) AS stderr, round(avg(CASE WHEN did = 1 THEN tau END), 6) AS att, count(*) AS n_obs FROM (SELECT *, cl % 5 AS grp FROM s) GROUP BY GROUPING SETS ((), (t), (grp))""")
def k24_dr_effects(spark, sf):
    pseudo = C.pseudo_outcomes(_syd(spark, sf).withColumn("grp", F.col("cl") % 5), "y", "did", ["x"])
    return r(C.effects(pseudo, "did", ["t", "grp"]), "ate", "stderr", "att")


@query(f"""WITH {SYD}, v AS (SELECT 'with size' AS variant, tau FROM {_dr('x')} UNION ALL SELECT 'no covariate', tau FROM {_dr('0')}), a AS (SELECT variant, avg(tau) AS ate, stddev_pop(tau) / sqrt(count(*)) AS se, count(*) AS n FROM v GROUP BY 1)
SELECT a.variant, round(a.ate, 6) AS ate, round(a.se, 6) AS stderr, a.n AS n_obs, (abs(a.ate - b.ate) <= 2 * b.se)::INT AS agrees FROM a, a b WHERE b.variant = 'with size'""")
def k25_ablation(spark, sf):
    return r(C.ablation(_syd(spark, sf), "y", "did", {"with size": ["x"], "no covariate": []}), "ate", "stderr")


TREATED = f"""{SYD}, u AS (SELECT unit, (unit % 3 = 0)::INT AS treated, avg(CASE WHEN t < 1999 THEN y END) AS pre_mean, regr_slope(CASE WHEN t < 1999 THEN y END, t) AS pre_slope, avg(CASE WHEN t >= 1999 THEN y END) - avg(CASE WHEN t < 1999 THEN y END) AS change FROM p GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, sum(pre_mean) AS a, sum(pre_slope) AS b, sum(pre_mean ** 2) AS aa, sum(pre_mean * pre_slope) AS ab, sum(pre_slope ** 2) AS bb, sum(treated) AS d, sum(treated * pre_mean) AS ad, sum(treated * pre_slope) AS bd FROM u),
c AS (SELECT n, a, b, d, aa - a * a / n AS saa, ab - a * b / n AS sab, bb - b * b / n AS sbb, ad - a * d / n AS sad, bd - b * d / n AS sbd FROM s), k AS (SELECT (sbb * sad - sab * sbd) / (saa * sbb - sab ** 2) AS k1, (saa * sbd - sab * sad) / (saa * sbb - sab ** 2) AS k2, a / n AS ma, b / n AS mb, d / n AS md FROM c),
ps AS (SELECT u.*, md + k1 * (pre_mean - ma) + k2 * (pre_slope - mb) AS ps FROM u, k), w AS (SELECT 0.25 * stddev_pop(ps) AS w FROM ps),
near AS (SELECT m.*, o.unit AS other, o.change AS o_change, o.pre_mean AS o_mean, o.pre_slope AS o_slope, abs(m.ps - o.ps) AS gap, row_number() OVER (PARTITION BY m.unit ORDER BY abs(m.ps - o.ps), o.unit) AS nr FROM ps m JOIN ps o ON m.treated = 1 AND o.treated = 0), pairs AS (SELECT * FROM near, w WHERE nr = 1 AND gap <= w)"""


def _treated(spark, sf):
    return _syd(spark, sf).withColumn("treated", (F.col("unit") % 3 == 0).cast("int"))


@query(f"WITH {TREATED} SELECT (SELECT count(*) FROM u WHERE treated = 1) AS n_treated, count(*) AS n_matched, round(avg(change - o_change), 6) AS coef, round(stddev_samp(change - o_change) / sqrt(count(*)), 6) AS stderr FROM pairs")
def k13_matched_did(spark, sf):
    return r(C.matched_did(_treated(spark, sf), "y", 1999)[0], "coef", "stderr")


@query(f"""WITH {TREATED}, sd AS (SELECT sqrt((var_samp(CASE WHEN treated = 1 THEN pre_mean END) + var_samp(CASE WHEN treated = 0 THEN pre_mean END)) / 2) AS a, sqrt((var_samp(CASE WHEN treated = 1 THEN pre_slope END) + var_samp(CASE WHEN treated = 0 THEN pre_slope END)) / 2) AS b,
avg(CASE WHEN treated = 1 THEN pre_mean END) - avg(CASE WHEN treated = 0 THEN pre_mean END) AS da, avg(CASE WHEN treated = 1 THEN pre_slope END) - avg(CASE WHEN treated = 0 THEN pre_slope END) AS db FROM u)
SELECT 'pre_mean' AS feature, round(da / a, 6) AS before, round((SELECT avg(pre_mean - o_mean) FROM pairs) / a, 6) AS after FROM sd UNION ALL SELECT 'pre_slope', round(db / b, 6), round((SELECT avg(pre_slope - o_slope) FROM pairs) / b, 6) FROM sd""")
def k13_balance(spark, sf):
    return r(C.matched_did(_treated(spark, sf), "y", 1999)[1], "before", "after")


def _cohorts(spark, sf):
    return _syd(spark, sf).withColumn("cohort", F.when(F.col("unit") % 3 == 0, 1999).otherwise(9999))


@query()
def k20_synthetic_control(spark, sf):
    """Weights come from the inverse of a matrix of moments; tested against plain Python."""
    return r(C.synthetic_control(_cohorts(spark, sf), "y", 1999), "actual", "synthetic", "gap")


@query()
def k21_low_rank(spark, sf):
    """Iterated singular values; tested against plain Python."""
    return r(C.low_rank_counterfactual(_cohorts(spark, sf), "y", 2.0), "actual", "counterfactual", "effect")


PRE = f"""{SYD}, did AS (SELECT unit, t, y AS value, CASE WHEN unit % 3 = 0 THEN 1999 ELSE 9999 END AS cohort FROM p), st AS (SELECT DISTINCT cohort AS g FROM did WHERE cohort < 9999), e AS (SELECT g, unnest(range(-4, -1))::INT AS event_t FROM st),
m AS (SELECT e.event_t, r.cohort < 9999 AS own, r.value - b.value AS d FROM e JOIN did r ON r.t = g + event_t AND (r.cohort = g OR r.cohort = 9999) JOIN did b ON b.unit = r.unit AND b.t = g - 1),
pre AS (SELECT event_t, avg(CASE WHEN own THEN d END) - avg(CASE WHEN NOT own THEN d END) AS att, sqrt(var_samp(CASE WHEN own THEN d END) / sum(own::INT) + var_samp(CASE WHEN NOT own THEN d END) / sum((NOT own)::INT)) AS stderr, sum(own::INT) AS weight FROM m GROUP BY 1)"""


@query(f"""WITH {PRE}, z AS (SELECT event_t, greatest(weight, 1)::DOUBLE / sum(greatest(weight, 1)) OVER () AS w, att / stderr AS z FROM pre WHERE stderr > 0 AND att IS NOT NULL), s AS (SELECT sum((w * z) ** 2) AS stat, count(*) AS dof FROM z),
d AS (SELECT event_t, w, unnest(range(1, 2001)) AS draw FROM z), n AS (SELECT draw, sum((w * sqrt(-2 * ln(greatest({U32.format(k="'a:' || draw || ':' || event_t")}, 1e-12))) * cos(2 * pi() * greatest({U32.format(k="'b:' || draw || ':' || event_t")}, 1e-12))) ** 2) AS s FROM d GROUP BY 1)
SELECT round(any_value(stat), 6) AS joint_stat, any_value(dof) AS dof, round(avg((round(n.s, 9) >= round(stat, 9))::INT), 6) AS p FROM n, s""")
def k15_pretrend_joint(spark, sf):
    return r(C.pretrend_joint_test(C.pretrend_effects(_cohorts(spark, sf).withColumnRenamed("y", "value"))), "joint_stat", "p")


@query(f"""WITH {SYD}, q AS (SELECT *, unnest([1997, 1998])::INT AS placebo_t FROM p WHERE t < 1999), z AS (SELECT *, (unit % 3 = 0 AND t >= placebo_t)::INT::DOUBLE AS fake FROM q), w AS (SELECT placebo_t, {HET.format(c='y', g='placebo_t')} AS y, {HET.format(c='fake', g='placebo_t')} AS x FROM z)
SELECT placebo_t, CASE WHEN sum(x * x) > 1e-9 THEN round(sum(x * y) / sum(x * x), 6) END AS coef, count(*) AS n_obs FROM w GROUP BY 1""")
def k28_placebo_periods(spark, sf):
    return r(C.placebo_periods(_treated(spark, sf), "y", 1999, [1997, 1998]), "coef")


WINDOWS = {"all": (0, 9999), "late": (1997, 9999), "early": (0, 2000)}


@query(f"""WITH {SYD}, l AS (SELECT unit, t, did, 'y' AS o, y AS v FROM p UNION ALL SELECT unit, t, did, 'x', x FROM p), q AS (SELECT l.*, o || ':' || name AS spec FROM l JOIN (VALUES ('all', 0, 9999), ('late', 1997, 9999), ('early', 0, 2000)) w(name, lo, hi) ON t BETWEEN lo AND hi),
w AS (SELECT spec, {HET.format(c='v', g='spec')} AS y, {HET.format(c='did', g='spec')} AS x FROM q), c AS (SELECT spec, sum(x * y) / nullif(sum(x * x), 0) AS c, count(*) AS n FROM w GROUP BY 1)
SELECT spec, round(c, 6) AS coef, n AS n_obs, row_number() OVER (ORDER BY round(c, 9), spec)::INT AS rank, round((SELECT avg((c > 0)::INT) FROM c), 6) AS positive_share FROM c""")
def k27_specification_curve(spark, sf):
    return r(C.specification_curve(_syd(spark, sf), ["y", "x"], "did", WINDOWS), "coef", "positive_share")


@query(f"""WITH {V.REGISTRY}, {NM}, co AS (SELECT kind, cl, min(start_t) AS c FROM registry GROUP BY ALL), pp AS (SELECT unit, cl, t, ln(1 + value) AS level, ln(1 + value) - lag(ln(1 + value)) OVER (PARTITION BY unit ORDER BY t) AS growth FROM np),
x AS (SELECT k.kind, pp.*, (c IS NOT NULL AND t >= c)::INT::DOUBLE AS did FROM pp JOIN (SELECT unnest(['F', 'O', 'P']) AS kind) k ON true LEFT JOIN co ON co.kind = k.kind AND co.cl = pp.cl), q AS (SELECT unit, t, did, kind || ':level' AS cell, level AS v FROM x UNION ALL SELECT unit, t, did, kind || ':growth', growth FROM x WHERE growth IS NOT NULL),
w AS (SELECT cell, {HET.format(c='v', g='cell')} AS y, {HET.format(c='did', g='cell')} AS x FROM q) SELECT cell, CASE WHEN sum(x * x) > 1e-9 THEN round(sum(x * y) / sum(x * x), 6) END AS coef, count(*) AS n_obs FROM w GROUP BY 1""")
def k26_response_matrix(spark, sf):
    w = Window.partitionBy("unit").orderBy("t")
    p = _np(spark, sf).withColumn("level", F.log1p("value")).withColumn("growth", F.col("level") - F.lag("level").over(w))
    return r(C.response_matrix(p, V.registry(spark, sf), ["F", "O", "P"], ["level", "growth"]), "coef")
