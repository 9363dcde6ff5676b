"""Queries of the shock operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import shocks as K
from tessella.plans import views as V
from tessella.plans.dynamics_queries import STATES, _states
from tessella.plans.events_queries import NM, _np
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.plans.sql import POISSON

SHOCK = f"""{V.REGISTRY}, {NM}, st AS (SELECT start_t AS t, count(*) AS events, count(DISTINCT cl) / 25.0::DOUBLE AS covered, avg(intensity) AS intensity FROM registry GROUP BY 1), gr AS (SELECT unnest(range(0, 80))::INT AS t),
g AS (SELECT gr.t, coalesce(events, 0) AS events, coalesce(covered, 0) AS covered, coalesce(intensity, 0) AS intensity FROM gr LEFT JOIN st ON gr.t = st.t),
z AS (SELECT *, (CASE WHEN stddev_pop(events) OVER () > {K.ROUNDING} * abs(avg(events) OVER ()) THEN (events - avg(events) OVER ()) / stddev_pop(events) OVER () ELSE 0 END + CASE WHEN stddev_pop(covered) OVER () > {K.ROUNDING} * abs(avg(covered) OVER ()) THEN (covered - avg(covered) OVER ()) / stddev_pop(covered) OVER () ELSE 0 END + CASE WHEN stddev_pop(intensity) OVER () > {K.ROUNDING} * abs(avg(intensity) OVER ()) THEN (intensity - avg(intensity) OVER ()) / stddev_pop(intensity) OVER () ELSE 0 END) / 3 AS idx FROM g),
sh AS (SELECT *, (idx >= (SELECT quantile_cont(idx, 0.75) FROM z) - {K.ROUNDING})::INT AS is_shock FROM z)"""


def _index(spark, sf):
    return K.shock_index(V.registry(spark, sf), 0, 79, 25)


@query(f'WITH {SHOCK} SELECT t, events, round(covered, 6) AS covered, round(intensity, 6) AS intensity, round(idx, 6) AS "index", is_shock FROM sh')
def j1_shock_index(spark, sf):
    return r(_index(spark, sf), "covered", "intensity", "index")


EXPO = f"""{SHOCK}, u AS (SELECT unit, avg(value) AS base FROM np WHERE t <= 24 GROUP BY 1), q AS (SELECT quantile_cont(base, 0.3) AS lo, quantile_cont(base, 0.7) AS hi FROM u), expo AS (SELECT unit, base, CASE WHEN base <= lo + {K.ROUNDING} * abs(lo) THEN 'low' WHEN base >= hi - {K.ROUNDING} * abs(hi) THEN 'high' ELSE 'middle' END AS exposure FROM u, q)"""


@query(f"WITH {EXPO} SELECT unit, round(base, 4) AS base, exposure FROM expo")
def j3_baseline_exposure(spark, sf):
    return r(K.baseline_exposure(_np(spark, sf), 24), "base", digits=4)


RESP = f"""{EXPO}, p AS (SELECT np.unit, t, ln(1 + value) AS v, exposure FROM np JOIN expo ON np.unit = expo.unit WHERE exposure <> 'middle'), s AS (SELECT t AS shock, unnest(range(-2, 3))::INT AS e FROM sh WHERE is_shock = 1),
m AS (SELECT s.shock, s.e, p.exposure, p.v - b.v AS d FROM s JOIN p ON p.t = s.shock + s.e JOIN p b ON b.unit = p.unit AND b.t = s.shock - 1),
resp AS (SELECT shock, e AS event_t, avg(CASE WHEN exposure = 'high' THEN d END) AS high, avg(CASE WHEN exposure = 'low' THEN d END) AS low, count(*) AS n FROM m GROUP BY ALL)"""


def _response(spark, sf):
    p = _np(spark, sf)
    return K.event_response(p, K.baseline_exposure(p, 24), _index(spark, sf).filter("is_shock = 1").select("t"), 2)


@query(f"WITH {RESP} SELECT shock, event_t, round(high, 6) AS high, round(low, 6) AS low, n, round(high - low, 6) AS contrast FROM resp")
def j4_event_response(spark, sf):
    return r(_response(spark, sf), "high", "low", "contrast")


@query(f"WITH {RESP.replace('WHERE is_shock = 1', 'WHERE t BETWEEN 2 AND 77')} SELECT shock, round(avg(high - low), 6) AS contrast FROM resp WHERE event_t >= 0 GROUP BY 1")
def j5_placebo(spark, sf):
    """The same response for every period that has its whole window."""
    p = _np(spark, sf)
    every = _index(spark, sf).filter("t BETWEEN 2 AND 77").select("t")
    resp = K.event_response(p, K.baseline_exposure(p, 24), every, 2)
    return r(resp.filter("event_t >= 0").groupBy("shock").agg(F.avg("contrast").alias("contrast")), "contrast")


@query(f"WITH {RESP}, pp AS (SELECT shock, sum(high - low) AS s, count(*) AS n FROM resp WHERE event_t >= 0 AND high - low IS NOT NULL GROUP BY 1) SELECT shock, round((sum(s) OVER () - s) / nullif(sum(n) OVER () - n, 0), 6) AS mean_without FROM pp")
def j6_leave_one_out(spark, sf):
    return r(K.leave_one_out(_response(spark, sf)), "mean_without")


@query(f"""WITH {V.PANEL_SY}, l AS (SELECT t, 'value' AS channel, value AS v FROM panel UNION ALL SELECT t, 'qty', qty::DOUBLE FROM panel UNION ALL SELECT t, 'disc', disc FROM panel), f AS (SELECT * FROM l WHERE t BETWEEN 1997 AND 2000)
SELECT channel, round(avg(CASE WHEN t < 1999 THEN v END), 4) AS before, round(avg(CASE WHEN t >= 1999 THEN v END), 4) AS after, round(avg(CASE WHEN t >= 1999 THEN v END) - avg(CASE WHEN t < 1999 THEN v END), 4) AS change FROM f GROUP BY 1""")
def j7_channel_means(spark, sf):
    return r(K.channel_means(V.panel_sy(spark, sf), ["value", "qty", "disc"], 1999, 2), "before", "after", "change", digits=4)


@query(f"""WITH {STATES}, v AS (SELECT s.unit, s.t, s.state, ln(1 + p.value) - avg(ln(1 + p.value)) OVER (PARTITION BY s.t) AS y FROM states s JOIN panel p ON s.unit = p.unit AND s.t = p.t),
e AS (SELECT unit, t AS entry FROM (SELECT *, (state = 'low' AND lag(state) OVER w <> 'low' AND lag(t) OVER w = t - 1) AS en FROM v WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE en)
SELECT (v.t - entry)::INT AS event_t, round(avg(v.y - b.y), 6) AS effect, count(*) AS n FROM e JOIN v ON v.unit = e.unit AND v.t BETWEEN entry - 2 AND entry + 2 JOIN v b ON b.unit = e.unit AND b.t = entry - 1 GROUP BY 1""")
def j9_entry_study(spark, sf):
    s = _states(spark, sf).join(V.panel_nm(spark, sf).select("unit", "t", "value"), ["unit", "t"])
    return r(K.entry_study(s, "low"), "effect")


@query(f"""WITH {V.PANEL_NM}, gp AS (SELECT grp, t, sum(round(value * 100)::BIGINT)::DOUBLE / 100 AS value FROM panel GROUP BY ALL), g AS (SELECT grp, t, value / lag(value) OVER w - 1 AS g FROM gp WINDOW w AS (PARTITION BY grp ORDER BY t)), n AS (SELECT *, lead(g) OVER (PARTITION BY grp ORDER BY t) AS g_next FROM g WHERE g IS NOT NULL),
m AS (SELECT a.grp AS lead_, b.grp AS follow, a.t, a.g AS x, b.g, b.g_next FROM n a JOIN n b ON a.t = b.t AND a.grp <> b.grp WHERE b.g_next IS NOT NULL), s AS (SELECT lead_, follow, corr(x, g_next) - corr(x, g) AS gain, count(*) AS n FROM m GROUP BY ALL),
d AS (SELECT m.*, unnest(range(1, 51))::INT AS draw FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY lead_, follow, draw ORDER BY ('0x' || substr(md5(draw || ':' || t), 1, 8))::BIGINT, t) AS p, row_number() OVER (PARTITION BY lead_, follow, draw ORDER BY t) AS q FROM d),
z AS (SELECT a.lead_, a.follow, a.draw, corr(a.x, b.g_next) - corr(a.x, b.g) AS gain FROM k a JOIN k b ON a.lead_ = b.lead_ AND a.follow = b.follow AND a.draw = b.draw AND a.q = b.p GROUP BY ALL)
SELECT s.lead_ AS lead, s.follow, round(s.gain, 6) AS lead_gain, s.n, round(avg((abs(z.gain) >= abs(s.gain))::INT), 6) AS p FROM s JOIN z ON s.lead_ = z.lead_ AND s.follow = z.follow GROUP BY ALL""")
def j11_lead_lag(spark, sf):
    g = V.panel_nm(spark, sf).groupBy("grp", "t").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0).alias("value"))
    return r(K.lead_lag(g), "lead_gain", "p")


@query(f"""WITH {RESP}, c AS (SELECT event_t, high - low AS c FROM resp) SELECT event_t, round(min(c), 6) AS low, round(quantile_cont(c, 0.25), 6) AS q25, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.75), 6) AS q75, round(max(c), 6) AS high, round(avg(c), 6) AS mean, (min(c) < 0 AND max(c) > 0)::INT AS conflict FROM c GROUP BY 1""")
def j12_envelope(spark, sf):
    return r(K.envelope(_response(spark, sf)), "low", "q25", "median", "q75", "high", "mean")


@query(f"""WITH {V.REGISTRY}, g AS (SELECT kind, start_t AS t, count(*) AS events, sum(intensity) AS intensity FROM registry GROUP BY ALL)
SELECT kind, t, events, round(intensity, 9) AS intensity, round((coalesce((events - avg(events) OVER w) / nullif(stddev_pop(events) OVER w, 0), 0) + coalesce((intensity - avg(intensity) OVER w) / nullif(stddev_pop(intensity) OVER w, 0), 0)) / 2, 6) AS "index" FROM g WINDOW w AS (PARTITION BY kind)""")
def j2_kind_index(spark, sf):
    return r(r(K.kind_index(V.registry(spark, sf)), "intensity", digits=9), "index")


_DOSE = "d0 AS (SELECT cl, t, sum(intensity) AS dose FROM (SELECT *, unnest(range(start_t, end_t + 1))::INT AS t FROM registry WHERE end_t >= start_t) GROUP BY ALL)"


@query(f"""WITH {EXPO}, {_DOSE}, j AS (SELECT np.unit, np.t, value / 1e6 AS y, coalesce(dose, 0) AS d, base / 1e6 * idx AS z FROM np JOIN expo ON np.unit = expo.unit JOIN sh ON sh.t = np.t LEFT JOIN d0 ON d0.cl = np.cl AND d0.t = np.t),
w AS (SELECT z - avg(z) OVER u - avg(z) OVER p + avg(z) OVER () AS z, d - avg(d) OVER u - avg(d) OVER p + avg(d) OVER () AS d, y - avg(y) OVER u - avg(y) OVER p + avg(y) OVER () AS y FROM j WINDOW u AS (PARTITION BY unit), p AS (PARTITION BY t)),
s AS (SELECT sum(z * z) AS zz, sum(z * d) AS zd, sum(z * y) AS zy, sum(d * d) AS dd, count(*) AS n FROM w)
SELECT round(zd / zz, 5) AS first_stage, round(zy / zz, 5) AS reduced_form, round(zy / zd, 4) AS wald, round((zd * zd / zz) / ((dd - zd * zd / zz) / (n - 1)), 3) AS f, n FROM s""")
def j8_shift_share(spark, sf):
    from tessella.operators.events import expand_intervals

    p = _np(spark, sf)
    dose = expand_intervals(V.registry(spark, sf)).groupBy("cl", "t").agg(F.sum("intensity").alias("dose"))
    j = p.join(dose, ["cl", "t"], "left").fillna({"dose": 0.0}).withColumn("value", F.col("value") / 1e6)
    expo = K.baseline_exposure(p, 24).withColumn("base", F.col("base") / 1e6)
    return r(r(r(K.shift_share(j, expo, _index(spark, sf)), "first_stage", "reduced_form", digits=5), "wald", digits=4), "f", digits=3)


@query(f"""WITH {RESP}, c AS (SELECT shock, event_t, high - low AS c FROM resp WHERE high - low IS NOT NULL), d AS (SELECT *, unnest(range(1, 801))::INT AS draw FROM c), uu AS (SELECT *, ('0x' || substr(md5(draw || ':' || shock), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d),
w AS (SELECT *, {POISSON} AS w FROM uu),
mm AS (SELECT event_t, draw, sum(w * c) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), ci AS (SELECT event_t, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS sd FROM mm GROUP BY 1), me AS (SELECT event_t, avg(c) AS mean FROM c GROUP BY 1)
SELECT event_t, round(mean, 6) AS mean, round(lo, 6) AS low, round(hi, 6) AS high, round(CASE WHEN sd > {K.ROUNDING} * abs(mean) THEN abs(mean) / sd END, 4) AS signal_to_noise FROM me JOIN ci USING (event_t)""")
def j13_envelope_bootstrap(spark, sf):
    return r(K.envelope_bootstrap(_response(spark, sf), 800).select("event_t", "mean", "low", "high", F.round("signal_to_noise", 4).alias("signal_to_noise")), "mean", "low", "high")


@query(f"""WITH {RESP}, pre AS (SELECT shock, regr_slope(high - low, event_t) AS slope, regr_sxx(high - low, event_t) AS sxx, regr_syy(high - low, event_t) AS syy, regr_sxy(high - low, event_t) AS sxy, count(*) AS n, max(abs(high - low)) AS largest FROM resp WHERE event_t < 1 AND high - low IS NOT NULL GROUP BY 1),
rest AS (SELECT *, syy - sxy * sxy / nullif(sxx, 0) AS rest FROM pre), tt AS (SELECT *, slope / sqrt(CASE WHEN rest > {K.ROUNDING} * syy THEN rest END / nullif(n - 2, 0) / sxx) AS t FROM rest)
SELECT shock, n, round(slope, 6) AS slope, round(t, 4) AS t, round(largest, 6) AS largest, (coalesce(abs(t), 0) < 2)::INT AS passed FROM tt""")
def j15_pretrend(spark, sf):
    """Event time 0 counts as before here, so that there are three points."""
    resp = _response(spark, sf).withColumn("event_t", F.col("event_t") - 1)
    return r(r(K.pretrend(resp), "slope", "largest"), "t", digits=4)


@query(f"""WITH {SHOCK}, e AS (SELECT kind AS name, avg(intensity) AS coef, stddev_samp(intensity) / sqrt(count(*)) AS stderr FROM registry GROUP BY 1),
j AS (SELECT a.name AS name_a, b.name AS name_b, (sign(a.coef) = sign(b.coef))::INT AS same_sign, (abs(a.coef - b.coef) <= 1.96 * (a.stderr + b.stderr))::INT AS overlap, ((abs(a.coef) >= 1.645 * a.stderr) = (abs(b.coef) >= 1.645 * b.stderr))::INT AS same_class,
 abs(a.coef - b.coef) / sqrt(a.stderr ** 2 + b.stderr ** 2) AS distance, greatest(1 - abs(a.coef - b.coef) / (abs(a.coef) + abs(b.coef) + 1e-6), 0) AS closeness FROM e a JOIN e b ON a.name < b.name)
SELECT name_a, name_b, same_sign, overlap, same_class, round(distance, 5) AS distance, round(closeness, 5) AS closeness, round((same_sign + overlap + same_class + closeness) / 4, 5) AS concordance FROM j""")
def j16_concordance(spark, sf):
    e = V.registry(spark, sf).groupBy(F.col("kind").alias("name")).agg(F.avg("intensity").alias("coef"), (F.stddev_samp("intensity") / F.sqrt(F.count("*"))).alias("stderr"))
    return r(K.concordance(e), "distance", "closeness", "concordance", digits=5)
