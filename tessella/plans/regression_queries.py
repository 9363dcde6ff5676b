"""Queries of the regression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import regression as R
from tessella.operators import spatial
from tessella.operators.events import timing_ready
from tessella.plans import views as V
from tessella.plans.events_queries import DID, READY, _did
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.plans.spatial_queries import PAIRS
from tessella.plans.sql import every, within

SYD = f"""{V.PANEL_SY}, p AS (SELECT unit, cl, t, ln(value) AS y, ln(qty) AS x, (unit % 3 = 0 AND t >= 1999)::INT::DOUBLE AS did FROM panel)"""
WITHIN = """({c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY t) + avg({c}) OVER ())"""


def _syd(spark, sf):
    return V.panel_sy(spark, sf).select("unit", "cl", "t", F.log("value").alias("y"), F.log("qty").alias("x"), ((F.col("unit") % 3 == 0) & (F.col("t") >= 1999)).cast("double").alias("did"))


@query(f"WITH {SYD} SELECT unit, t, round({WITHIN.format(c='y')}, 6) AS y_w, round({WITHIN.format(c='did')}, 6) AS did_w FROM p")
def k1_two_way_within(spark, sf):
    return r(R.two_way_within(_syd(spark, sf), ["y", "did"]).select("unit", "t", "y_w", "did_w"), "y_w", "did_w")


@query(f"""WITH {SYD}, b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM p), e AS (SELECT p.x, p.y - i - s * p.x AS u, n FROM p, b),
m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(u * u) AS a, sum(u * u * x) AS b, sum(u * u * x * x) AS c FROM e), v AS (SELECT *, n * sxx - sx * sx AS d FROM m)
SELECT 'const' AS term, round(i, 5) AS coef, round(sqrt(v.n / (v.n - 2) * (sxx * sxx * a - 2 * sxx * sx * b + sx * sx * c)) / d, 5) AS stderr, b.n AS n_obs FROM v, b
UNION ALL SELECT 'x', round(s, 5), round(sqrt(v.n / (v.n - 2) * (sx * sx * a - 2 * sx * v.n * b + v.n * v.n * c)) / d, 5), b.n FROM v, b""")
def k3_ols_hc1(spark, sf):
    df = _syd(spark, sf).withColumn("const", F.lit(1.0))
    return r(R.ols(df, "y", ["const", "x"]).select("term", "coef", "stderr", "n_obs"), "coef", "stderr", digits=5)


TW = f"""{SYD}, w AS (SELECT cl, {WITHIN.format(c='y')} AS y, {WITHIN.format(c='did')} AS x FROM p), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM w)"""


@query(f"""WITH {TW}, g AS (SELECT cl, sum(x * (y - b.b * x)) AS s FROM w, b GROUP BY 1), a AS (SELECT sum(s * s) AS m, count(*) AS g FROM g)
SELECT 'did_w' AS term, round(b.b, 6) AS coef, round(sqrt(m * g / (g - 1) * (n - 1) / (n - 1)) / xx, 6) AS stderr, n AS n_obs, g AS n_clusters FROM a, b""")
def k5_twfe(spark, sf):
    return r(R.twfe(_syd(spark, sf), "y", "did").select("term", "coef", "stderr", "n_obs", "n_clusters"), "coef", "stderr")


def two_regressors(names: tuple[str, str]) -> str:
    """SQL from w (cl, y, a, b): least squares of y on a and b by sums, errors clustered by cl."""
    return f"""s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, count(*) AS n FROM w), d AS (SELECT *, aa * bb - ab * ab AS det FROM s), k AS (SELECT *, (bb * ay - ab * yb) / det AS k1, (aa * yb - ab * ay) / det AS k2 FROM d),
gs AS (SELECT cl, sum(a * (y - k1 * a - k2 * b)) AS s1, sum(b * (y - k1 * a - k2 * b)) AS s2 FROM w, k GROUP BY 1), v AS (SELECT any_value(k1) AS k1, any_value(k2) AS k2, any_value(n) AS n, count(*) AS g, sqrt(count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2)) / any_value(det) AS f,
 any_value(bb) ** 2 * sum(s1 * s1) - 2 * any_value(bb) * any_value(ab) * sum(s1 * s2) + any_value(ab) ** 2 * sum(s2 * s2) AS v1, any_value(ab) ** 2 * sum(s1 * s1) - 2 * any_value(aa) * any_value(ab) * sum(s1 * s2) + any_value(aa) ** 2 * sum(s2 * s2) AS v2 FROM gs, k)
SELECT '{names[0]}' AS term, round(k1, 6) AS coef, round(f * sqrt(v1), 6) AS stderr, round(k1 / (f * sqrt(v1)), 4) AS t_value, n AS n_obs, g AS n_clusters FROM v UNION ALL SELECT '{names[1]}', round(k2, 6), round(f * sqrt(v2), 6), round(k2 / (f * sqrt(v2)), 4), n, g FROM v"""


def _fit(df):
    return r(r(df, "coef", "stderr"), "t_value", digits=4)


@query(f"WITH {SYD}, w AS (SELECT cl, {WITHIN.format(c='y')} AS y, {WITHIN.format(c='did')} AS a, {WITHIN.format(c='x')} AS b FROM p), {two_regressors(('did_w', 'x_w'))}")
def k6_did_with_controls(spark, sf):
    """Main effect with a control; two regressors, solved on the driver from one aggregation."""
    return _fit(R.twfe(_syd(spark, sf), "y", "did", ("x",)))


HET = """({c} - avg({c}) OVER (PARTITION BY {g}, unit) - avg({c}) OVER (PARTITION BY {g}, t) + avg({c}) OVER (PARTITION BY {g}))"""


@query(f"""WITH {SYD}, l AS (SELECT *, 1 AS lead, lead(did, 1) OVER (PARTITION BY unit ORDER BY t) AS ld FROM p UNION ALL SELECT *, 2, lead(did, 2) OVER (PARTITION BY unit ORDER BY t) FROM p), f AS (SELECT * FROM l WHERE did = 0 AND ld IS NOT NULL), w AS (SELECT lead, cl, {HET.format(c='y', g='lead')} AS y, {HET.format(c='ld', g='lead')} AS x FROM f),
b AS (SELECT lead, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM w GROUP BY 1), g AS (SELECT lead, cl, sum(x * (y - b * x)) AS s FROM w JOIN b USING (lead) GROUP BY ALL), a AS (SELECT lead, sqrt(sum(s * s) * count(*) / (count(*) - 1)) AS m, count(*) AS g FROM g GROUP BY 1)
SELECT 'lead_did_w' AS term, round(b, 6) AS coef, round(m / xx, 6) AS stderr, round(b / (m / xx), 4) AS t_value, n AS n_obs, g AS n_clusters, lead FROM a JOIN b USING (lead)""")
def k9_lead_placebo(spark, sf):
    return _fit(R.lead_placebo(_syd(spark, sf), "y", "did", (1, 2)))


@query(f"""WITH {SYD}, q AS (SELECT *, cl % 5 AS grp FROM p), w AS (SELECT grp, {HET.format(c='y', g='grp')} AS y, {HET.format(c='did', g='grp')} AS x FROM q) SELECT grp, CASE WHEN sum(x * x) > 1e-9 THEN round(sum(x * y) / sum(x * x), 6) END AS coef, count(*) AS n_obs FROM w GROUP BY 1""")
def k10_heterogeneity(spark, sf):
    return r(R.heterogeneity(_syd(spark, sf).withColumn("grp", F.col("cl") % 5), "y", "did", "grp"), "coef")


ATT = f"""{READY}, st AS (SELECT DISTINCT cohort AS g FROM ready WHERE cohort < 9999), e AS (SELECT g, unnest(range(-3, 4))::INT AS e FROM st),
m AS (SELECT e.g, e.e, r.cohort = e.g AS own, r.value - b.value AS d FROM e JOIN ready r ON r.t = e.g + e.e AND (r.cohort = e.g OR r.cohort > greatest(e.g + e.e, e.g)) JOIN ready b ON b.unit = r.unit AND b.t = e.g - 1),
att AS (SELECT g AS cohort, e AS event_t, avg(CASE WHEN own THEN d END) AS a, avg(CASE WHEN NOT own THEN d END) AS c, sum(own::INT)::BIGINT AS treated FROM m GROUP BY ALL)"""


def _ready(spark, sf):
    return timing_ready(_did(spark, sf), 2, 70, 2)


@query(f"WITH {ATT} SELECT cohort, event_t, treated, round(a - c, 3) AS att FROM att WHERE a IS NOT NULL AND c IS NOT NULL")
def k14_staggered_att(spark, sf):
    return r(R.staggered_att(_ready(spark, sf)), "att", digits=3)


@query(f"WITH {ATT} SELECT event_t, round(sum((a - c) * treated) / sum(treated), 3) AS att, count(*) AS cohorts FROM att WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY 1")
def k16_event_time_att(spark, sf):
    return r(R.event_time_att(R.staggered_att(_ready(spark, sf))), "att", digits=3)


TIMES = {k: f"e{'m' if k < 0 else 'p'}{abs(k)}" for k in (-3, -2, 0, 1, 2, 3)}
DUMMIES = ", ".join(f"coalesce((e = {k})::INT, 0)::DOUBLE AS {n}" for k, n in TIMES.items())


@query(f"""WITH {READY}, et AS (SELECT unit, t, ln(1 + value) AS y, CASE WHEN cohort < 9999 THEN greatest(least(t - cohort, 3), -3) END AS e FROM ready),
d AS (SELECT 1 AS one, unit, t, y, {DUMMIES} FROM et), w AS ({within("d", ["y", *TIMES.values()], "unit", "one")}), {every({n: f"{n}_w" for n in TIMES.values()}, "w", "y", "unit")}""")
def k17_event_study(spark, sf):
    p = _ready(spark, sf).withColumn("y", F.log1p("value"))
    return r(R.event_study(p, "y"), "coef", "stderr", "t_value")


@query(f"""WITH {V.PANEL_SY}, u AS (SELECT ln(min_by(value, t)) AS s, (ln(max_by(value, t)) - ln(min_by(value, t))) / (max(t) - min(t)) AS g FROM panel GROUP BY unit HAVING max(t) > min(t)) SELECT 'start' AS term, round(regr_slope(g, s), 6) AS coef, count(*) AS n_obs FROM u UNION ALL SELECT 'const', round(regr_intercept(g, s), 6), count(*) FROM u""")
def k18_beta_convergence(spark, sf):
    return r(R.beta_convergence(V.panel_sy(spark, sf)).select("term", "coef", "n_obs"), "coef")


@query(f"""WITH {SYD}, w AS (SELECT {WITHIN.format(c='y')} AS y, {WITHIN.format(c='x')} AS x FROM p), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM w)
SELECT 'lx_w' AS term, round(any_value(b.b), 6) AS coef, round(sqrt(any_value(n) / (any_value(n) - 1) * sum(x * x * (y - b.b * x) ** 2)) / any_value(xx), 6) AS stderr, any_value(n) AS n_obs FROM w, b""")
def k19_elasticity(spark, sf):
    return r(R.elasticity(V.panel_sy(spark, sf), "value", "qty").select("term", "coef", "stderr", "n_obs"), "coef", "stderr")


@query(f"""WITH {SYD}, g AS (SELECT DISTINCT cl % 5 AS left_out FROM p), q AS (SELECT p.*, left_out FROM p JOIN g ON p.cl % 5 <> left_out), w AS (SELECT left_out, {HET.format(c='y', g='left_out')} AS y, {HET.format(c='did', g='left_out')} AS x FROM q) SELECT left_out, round(sum(x * y) / sum(x * x), 6) AS coef, count(*) AS n_obs FROM w GROUP BY 1""")
def k29_leave_one_group_out(spark, sf):
    return r(R.leave_one_group_out(_syd(spark, sf).withColumn("grp", F.col("cl") % 5), "y", "did", "grp"), "coef")


@query(f"""WITH {SYD}, ds AS (SELECT p.*, did * disc AS dose FROM p JOIN panel USING (unit, t)), q AS (SELECT quantile_cont(dose, 1.0 / 3) AS a, quantile_cont(dose, 2.0 / 3) AS b FROM ds WHERE dose > 0),
bn AS (SELECT 1 AS one, ds.unit, ds.cl, t, y, CASE WHEN dose > 0 THEN 1 + (dose > q.a)::INT + (dose > q.b)::INT ELSE 0 END AS bin FROM ds, q),
d AS (SELECT *, (bin = 1)::INT::DOUBLE AS b1, (bin = 2)::INT::DOUBLE AS b2, (bin = 3)::INT::DOUBLE AS b3 FROM bn), w AS ({within("d", ["y", "b1", "b2", "b3"], "unit", "one")}), {every({f"b{i}": f"bin_{i}_w" for i in (1, 2, 3)}, "w", "y", "cl")}""")
def k7_dose_bins(spark, sf):
    d = _syd(spark, sf).join(V.panel_sy(spark, sf).select("unit", "t", F.col("disc")), ["unit", "t"]).withColumn("dose", F.col("did") * F.col("disc"))
    return r(R.dose_bins(d, "y", "dose"), "coef", "stderr", "t_value")


@query(f"""WITH {SYD}, l AS (SELECT unit, t, did, 'y' AS channel, y AS v FROM p UNION ALL SELECT unit, t, did, 'x', x FROM p), z AS (SELECT *, (v - avg(v) OVER (PARTITION BY channel)) / stddev_pop(v) OVER (PARTITION BY channel) AS s FROM l),
w AS (SELECT channel, {HET.format(c='s', g='channel')} AS y, {HET.format(c='did', g='channel')} AS x FROM z) SELECT channel, round(sum(x * y) / sum(x * x), 6) AS coef, count(*) AS n_obs FROM w GROUP BY 1""")
def k12_mechanism(spark, sf):
    return r(R.mechanism(_syd(spark, sf), ["y", "x"], "did"), "coef")


@query(f"""WITH {TW}, c AS (SELECT cl::VARCHAR AS c, sum(x * y) AS xy FROM w GROUP BY 1), d AS (SELECT *, unnest(range(1, 101))::INT AS draw FROM c), n AS (SELECT draw, sum(CASE WHEN ('0x' || substr(md5(draw || ':' || c), 1, 8))::BIGINT / 4294967296.0 < 0.5 THEN -xy ELSE xy END) AS s FROM d GROUP BY 1)
SELECT round(any_value(b.b), 6) AS coef, round(avg((abs(s / b.xx) >= abs(b.b))::INT), 6) AS p FROM n, b""")
def l3_wild_bootstrap(spark, sf):
    return r(R.wild_bootstrap(_syd(spark, sf), "y", "did", 100), "coef", "p")


U32 = "('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
OBSERVED = f"""{TW}, cs AS (SELECT cl, sum(x * (y - b.b * x)) AS s FROM w, b GROUP BY 1), o AS (SELECT any_value(b.b) AS coef, sqrt(sum(s * s) * count(*) / (count(*) - 1)) / any_value(b.xx) AS stderr FROM cs, b)"""


@query(f"""WITH {OBSERVED}, un AS (SELECT unit, row_number() OVER (ORDER BY {U32.format(k="'0:' || unit")}, unit) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM p)),
sl AS (SELECT draw, floor({U32.format(k="draw || ':' || slot")} * n)::BIGINT + 1 AS i FROM (SELECT draw, n, unnest(range(1, n + 1)) AS slot FROM (SELECT unnest(range(1, 161)) AS draw, n FROM (SELECT DISTINCT n FROM un)))),
s AS (SELECT draw, unit, y, did, t, copy FROM (SELECT draw, i, row_number() OVER (PARTITION BY draw, i) AS copy FROM sl) JOIN un USING (i) JOIN p USING (unit)),
bw AS (SELECT draw, y - avg(y) OVER (PARTITION BY draw, unit, copy) - avg(y) OVER (PARTITION BY draw, t) + avg(y) OVER (PARTITION BY draw) AS y, did - avg(did) OVER (PARTITION BY draw, unit, copy) - avg(did) OVER (PARTITION BY draw, t) + avg(did) OVER (PARTITION BY draw) AS x FROM s),
c AS (SELECT draw, sum(x * y) / sum(x * x) AS c FROM bw GROUP BY 1 HAVING sum(x * x) > 1e-9),
f AS (SELECT count(*) AS draws_used, avg(c) AS m, stddev_samp(c) AS sd, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi, 2 * least(avg((c <= 0)::INT), avg((c >= 0)::INT)) AS p, count(*) >= 48 AND (SELECT count(*) FROM un) >= 8 AS ok FROM c)
SELECT round(coef, 6) AS coef, round(stderr, 6) AS stderr, round(coef / stderr, 5) AS t_value, draws_used, CASE WHEN ok THEN round(m, 6) END AS boot_mean, CASE WHEN ok THEN round(sd, 6) END AS boot_sd, CASE WHEN ok THEN round(lo, 6) END AS low, CASE WHEN ok THEN round(hi, 6) END AS high, CASE WHEN ok THEN round(p, 6) END AS p FROM o, f""")
def l1_twfe_bootstrap(spark, sf):
    return r(r(R.unit_bootstrap(_syd(spark, sf), "y", "did"), "coef", "stderr", "boot_mean", "boot_sd", "low", "high", "p"), "t_value", digits=5)


@query(f"""WITH {OBSERVED}, co AS (SELECT unit, coalesce(min(CASE WHEN did >= 0.5 THEN t END), 9999) AS cohort FROM p GROUP BY 1), k AS (SELECT cohort, row_number() OVER (ORDER BY {U32.format(k="'0:' || unit")}, unit) AS i FROM co),
dl AS (SELECT draw, unit, row_number() OVER (PARTITION BY draw ORDER BY {U32.format(k="draw || ':' || unit")}, unit) AS i FROM (SELECT unit, unnest(range(1, 201)) AS draw FROM co)),
s AS (SELECT draw, unit, t, cl, y, (cohort < 9999 AND t >= cohort)::INT::DOUBLE AS did FROM dl JOIN k USING (i) JOIN p USING (unit)),
pw AS (SELECT draw, cl, y - avg(y) OVER (PARTITION BY draw, unit) - avg(y) OVER (PARTITION BY draw, t) + avg(y) OVER (PARTITION BY draw) AS y, did - avg(did) OVER (PARTITION BY draw, unit) - avg(did) OVER (PARTITION BY draw, t) + avg(did) OVER (PARTITION BY draw) AS x FROM s),
pb AS (SELECT draw, sum(x * y) / sum(x * x) AS c, sum(x * x) AS xx FROM pw GROUP BY 1 HAVING sum(x * x) > 1e-9), ps AS (SELECT draw, cl, sum(x * (y - c * x)) AS s FROM pw JOIN pb USING (draw) GROUP BY ALL), pt AS (SELECT draw, c, abs(c) / (sqrt(sum(s * s) * count(*) / (count(*) - 1)) / xx) AS t FROM ps JOIN pb USING (draw) GROUP BY draw, c, xx)
SELECT round(any_value(coef), 6) AS coef, round(any_value(coef / stderr), 5) AS t_value, count(*) AS draws_used, round(avg(c), 6) AS null_mean, round(stddev_samp(c), 6) AS null_sd, round(quantile_cont(t, 0.95), 5) AS null_t95, round((1 + sum((round(abs(c), 9) >= round(abs(coef), 9))::INT)) / (1 + count(*)), 6) AS p_coef, round((1 + sum((round(t, 9) >= round(abs(coef / stderr), 9))::INT)) / (1 + count(*)), 6) AS p_t FROM pt, o""")
def l2_schedule_permutation(spark, sf):
    return r(r(R.schedule_permutation(_syd(spark, sf), "y", "did"), "coef", "null_mean", "null_sd", "p_coef", "p_t"), "t_value", "null_t95", digits=5)


@query(f"""WITH {PAIRS}, {DID}, ex AS (SELECT src AS unit, t + 1 AS t, avg(did) AS near FROM near JOIN did ON near.dst = did.unit GROUP BY ALL),
d AS (SELECT 1 AS one, did.unit, cl, did.t, ln(1 + value) AS y, did::DOUBLE AS own, ex.near AS nb FROM did JOIN ex ON did.unit = ex.unit AND did.t = ex.t), w AS ({within("d", ["y", "own", "nb"], "unit", "one")}), {every({"own": "did_w", "nb": "near_w"}, "w", "y", "cl")}""")
def k8_spillover(spark, sf):
    near = spatial.nearest_edges(spatial.near_pairs(V.coords(spark, sf), 6000.0), 4)
    p = _did(spark, sf).withColumn("y", F.log1p("value")).withColumn("did", F.col("did").cast("double"))
    seen = spatial.neighbour_exposure(near, p, "did")
    return r(R.spillover(p, seen, "y", "did"), "coef", "stderr", "t_value")
