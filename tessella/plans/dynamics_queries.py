"""Queries of the dynamics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r

W = "(PARTITION BY unit ORDER BY t)"

PULSE = f"""{V.PANEL_NM}, p1 AS (SELECT unit, t, ln(1 + avg(value) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING)) AS l, avg(value) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING) AS smooth FROM panel),
p2 AS (SELECT *, l - lag(l) OVER {W} AS v FROM p1), p3 AS (SELECT *, v - lag(v) OVER {W} AS a, CASE WHEN count(v) OVER (PARTITION BY unit ORDER BY t ROWS 3 PRECEDING) >= 2 THEN stddev_samp(v) OVER (PARTITION BY unit ORDER BY t ROWS 3 PRECEDING) END AS s FROM p2),
p4 AS (SELECT *, coalesce((v - avg(v) OVER u) / stddev_samp(v) OVER u, 0) AS zv, coalesce((a - avg(a) OVER u) / stddev_samp(a) OVER u, 0) AS za, coalesce((s - avg(s) OVER u) / stddev_samp(s) OVER u, 0) AS zs FROM p3 WINDOW u AS (PARTITION BY unit)),
p5 AS (SELECT *, exp(zv + 0.5 * za - 0.2 * zs) AS e1, exp(za - 0.5 * zv) AS e2, exp(-abs(zv) - 0.3 * zs) AS e3, exp(-zv - 0.5 * za + 0.2 * zs) AS e4 FROM p4)"""


@query(f"""WITH {PULSE} SELECT unit, t, round(smooth, 4) AS smooth, round(v, 6) AS velocity, round(a, 6) AS acceleration, round(s, 6) AS volatility, round(e1 / (e1 + e2 + e3 + e4), 6) AS p_expansion, round(e2 / (e1 + e2 + e3 + e4), 6) AS p_recovery,
 round(e3 / (e1 + e2 + e3 + e4), 6) AS p_stagnation, round(e4 / (e1 + e2 + e3 + e4), 6) AS p_decline, CASE WHEN e1 >= greatest(e2, e3, e4) THEN 'expansion' WHEN e2 >= greatest(e3, e4) THEN 'recovery' WHEN e3 >= e4 THEN 'stagnation' ELSE 'decline' END AS state FROM p5""")
def h1_pulse_state(spark, sf):
    out = D.pulse_state(V.panel_nm(spark, sf))
    return r(r(out, *[c for c in out.columns if c.startswith("p_")], "velocity", "acceleration", "volatility"), "smooth", digits=4)


DYN = f"""{V.PANEL_NM}, g AS (SELECT *, value - lag(value) OVER {W} AS growth FROM panel),
dyn AS (SELECT *, growth - lag(growth) OVER {W} AS accel, CASE WHEN count(growth) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING) >= 2 THEN stddev_samp(growth) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING) END AS vol_3,
  avg(growth) OVER (PARTITION BY unit ORDER BY t ROWS 1 PRECEDING) AS momentum_2, lead(growth) OVER {W} AS growth_next, rank() OVER (PARTITION BY t ORDER BY value) / count(*) OVER (PARTITION BY t) AS rank_pct,
  (value - avg(value) OVER (PARTITION BY unit)) / stddev_samp(value) OVER (PARTITION BY unit) AS z_unit FROM g)"""


@query(f"""WITH {DYN}, q AS (SELECT quantile_cont(growth_next, 0.25) AS lo, quantile_cont(growth_next, 0.75) AS hi FROM dyn WHERE t <= 60)
SELECT unit, grp, t, round(value, 4) AS value, round(growth, 4) AS growth, round(accel, 4) AS accel, round(vol_3, 4) AS vol_3, round(momentum_2, 4) AS momentum_2, round(growth_next, 4) AS growth_next, round(rank_pct, 6) AS rank_pct, round(z_unit, 6) AS z_unit,
 (growth_next <= lo)::INT AS stall_next, (growth_next >= hi)::INT AS surge_next FROM dyn, q""")
def h2_dynamics_table(spark, sf):
    return r(r(D.dynamics_table(V.panel_nm(spark, sf), 60), "rank_pct", "z_unit"), "value", "growth", "accel", "vol_3", "momentum_2", "growth_next", digits=4)


@query(f"""WITH {DYN}, k AS (SELECT *, accel - lag(accel) OVER {W} AS jerk, (sign(growth) <> sign(lag(growth) OVER {W}))::INT AS flip FROM dyn),
q AS (SELECT quantile_cont(growth, 0.35) AS gl, quantile_cont(growth, 0.65) AS gh, quantile_cont(accel, 0.35) AS al, quantile_cont(accel, 0.65) AS ah FROM dyn)
SELECT unit, t, round(growth, 2) AS growth, round(accel, 2) AS accel, round(jerk, 2) AS jerk, flip, round((growth / 1000) ** 2 + (accel / 1000) ** 2, 2) AS energy, round(avg(flip) OVER (PARTITION BY unit ORDER BY t ROWS 3 PRECEDING), 6) AS turning, round(-accel / nullif(abs(growth), 0), 4) AS damping,
 CASE WHEN accel IS NULL THEN NULL WHEN growth >= gh AND accel >= ah THEN 'take_off' WHEN growth >= gh AND accel <= al THEN 'overheating' WHEN growth <= gl AND accel >= ah THEN 'rebound' WHEN growth <= gl AND accel <= al THEN 'free_fall' WHEN growth >= gh THEN 'cruise' ELSE 'drift' END AS state FROM k, q""")
def h3_kinetic_structure(spark, sf):
    out = D.kinetic_structure(V.panel_nm(spark, sf)).withColumn("energy", F.col("energy") / 1e6)
    return r(r(r(out, "growth", "accel", "jerk", "energy", digits=2), "turning"), "damping", digits=4)


@query(f"""WITH {V.PANEL_NM}, x AS (SELECT unit, t, value / 1e6 AS x FROM panel), y AS (SELECT *, lag(x) OVER {W} AS p FROM x),
z AS (SELECT *, count(x) OVER f AS k, corr(CASE WHEN p IS NOT NULL THEN x END, p) OVER (PARTITION BY unit ORDER BY t ROWS 4 PRECEDING) AS ar1, var_samp(x) OVER f AS variance, skewness(x) OVER f AS skew,
 regr_slope(x, t) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING) - regr_slope(x, t) OVER f AS gap, 1 - x / max(x) OVER (PARTITION BY unit ORDER BY t) AS drawdown FROM y WINDOW f AS (PARTITION BY unit ORDER BY t ROWS 5 PRECEDING))
SELECT unit, t, CASE WHEN k = 6 THEN round(ar1, 4) END AS ar1, CASE WHEN k = 6 THEN round(variance, 6) END AS variance, CASE WHEN k = 6 THEN round(skew, 4) END AS skew, CASE WHEN k = 6 THEN round(gap, 6) END AS slope_gap, round(drawdown, 6) AS drawdown FROM z""")
def h4_early_warning(spark, sf):
    return r(r(D.early_warning(V.panel_nm(spark, sf)), "variance", "slope_gap", "drawdown"), "ar1", "skew", digits=4)


def _states(spark, sf):
    """Three states of each cell by its rank share in the period."""
    p = D.dynamics_table(V.panel_nm(spark, sf), 60)
    return p.select("unit", "grp", "t", F.when(F.col("rank_pct") <= 0.33, "low").when(F.col("rank_pct") <= 0.67, "middle").otherwise("high").alias("state"))


STATES = f"""{V.PANEL_NM}, states AS (SELECT unit, grp, t, CASE WHEN rk <= 0.33 THEN 'low' WHEN rk <= 0.67 THEN 'middle' ELSE 'high' END AS state FROM (SELECT *, rank() OVER (PARTITION BY t ORDER BY value) / count(*) OVER (PARTITION BY t) AS rk FROM panel))"""


@query(f"""WITH {STATES}, s AS (SELECT *, CASE WHEN lag(t) OVER {W} IS NULL THEN 0 ELSE (state IS DISTINCT FROM lag(state) OVER {W})::INT END AS switch FROM states), b AS (SELECT *, sum(switch) OVER {W} AS block FROM s)
SELECT unit, grp, t, state, switch, block::BIGINT AS block, row_number() OVER (PARTITION BY unit, block ORDER BY t)::INT AS run, round(avg(switch) OVER (PARTITION BY unit ORDER BY t ROWS 2 PRECEDING), 6) AS rate_3, round(avg(switch) OVER (PARTITION BY unit ORDER BY t ROWS 4 PRECEDING), 6) AS rate_5,
 round(row_number() OVER (PARTITION BY unit, state ORDER BY t) / row_number() OVER {W}, 6) AS share FROM b""")
def h5_regime_features(spark, sf):
    return r(D.regime_features(_states(spark, sf)), "rate_3", "rate_5", "share")


@query(f"""WITH {STATES}, n AS (SELECT state, CASE WHEN lead(t) OVER {W} = t + 1 THEN lead(state) OVER {W} END AS nxt FROM states), c AS (SELECT state, nxt, count(*) AS c FROM n WHERE nxt IS NOT NULL GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY state) AS p FROM c)
SELECT state, sum(c)::BIGINT AS n, round(sum(CASE WHEN state = nxt THEN p ELSE 0 END), 6) AS stay, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1""")
def h6_regime_network(spark, sf):
    return r(D.regime_network(_states(spark, sf)), "stay", "entropy")


INDEX = f"""{V.PANEL_NM}, v AS (SELECT unit, grp, t, ln(1 + value) AS level FROM panel), v2 AS (SELECT *, level - lag(level) OVER {W} AS velocity FROM v), b AS (SELECT min(level) AS lo, max(level) AS hi, min(velocity) AS vlo, max(velocity) AS vhi FROM v2),
ix AS (SELECT unit, grp, t, 100 * (0.6 * (level - lo) / (hi - lo) + 0.4 * coalesce((velocity - vlo) / (vhi - vlo), 0.5)) AS idx FROM v2, b), q AS (SELECT quantile_cont(idx, 0.3) AS q30, quantile_cont(idx, 0.7) AS q70 FROM ix),
st AS (SELECT ix.*, CASE WHEN idx <= q30 THEN 'weak' WHEN idx >= q70 THEN 'strong' ELSE 'steady' END AS state FROM ix, q)"""


@query(f"""WITH {INDEX} SELECT unit, grp, t, round(idx, 6) AS "index", round(idx - lag(idx) OVER {W}, 6) AS delta, round((idx - lag(idx, 3) OVER {W}) / 3, 6) AS trend, state FROM st""")
def h8_pulse_index(spark, sf):
    return r(D.pulse_index(V.panel_nm(spark, sf)), "index", "delta", "trend")


def _cuts(c: str) -> str:
    """Low and high cut of a score of l."""
    q = f"(SELECT quantile_cont({c}, 0.35) AS lo, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.65) AS hi FROM l)"
    w = f"(SELECT CASE WHEN hi <= lo + 8 THEN least(lo, m - 4) ELSE lo END AS lo, CASE WHEN hi <= lo + 8 THEN greatest(hi, m + 4) ELSE hi END AS hi FROM {q})"
    return f"(SELECT least(greatest(lo, 8), 92) AS {c}l, least(greatest(hi, least(greatest(lo, 8), 92) + 5), 96) AS {c}h FROM {w})"


@query(f"""WITH {V.PANEL_SY}, l AS (SELECT unit, value / 4000000.0 AS a, disc * 1000 AS r FROM panel QUALIFY row_number() OVER (PARTITION BY unit ORDER BY t DESC) = 1)
SELECT unit, CASE WHEN a >= ah AND r <= rl THEN 'accelerating' WHEN a <= al AND r >= rh THEN 'stalling' WHEN a >= ah AND r >= rh THEN 'fragile_boom' WHEN a <= al AND r <= rl THEN 'recovery_window' ELSE 'steady' END AS quadrant FROM l, {_cuts('a')}, {_cuts('r')}""")
def h9_quadrants(spark, sf):
    p = V.panel_sy(spark, sf).select("unit", "t", (F.col("value") / 4000000.0).alias("a"), (F.col("disc") * 1000).alias("r"))
    return D.quadrants(V.edge_rows(p), "a", "r").select("unit", "quadrant")


@query(f"""WITH {INDEX}, p AS (SELECT t, avg(idx) AS mean, avg((state = 'weak')::INT) AS weak, avg((state = 'steady')::INT) AS steady, avg((state = 'strong')::INT) AS strong FROM st GROUP BY 1), z AS (SELECT quantile_cont(mean, 0.33) AS lo, quantile_cont(mean, 0.67) AS hi FROM p)
SELECT t, round(mean, 6) AS mean, round(weak, 6) AS weak, round(steady, 6) AS steady, round(strong, 6) AS strong, round(weak * strong * 4, 6) AS tension, CASE WHEN mean <= lo THEN 'trough' WHEN mean >= hi THEN 'peak' ELSE 'middle' END AS phase FROM p, z""")
def h10_global_cycle(spark, sf):
    return r(D.global_cycle(D.pulse_index(V.panel_nm(spark, sf))), "mean", "weak", "steady", "strong", "tension")


@query(f"WITH {V.PANEL_SY} SELECT unit, round(regr_slope(value, t), 4) AS slope, round(regr_intercept(value, t), -2) AS intercept, count(value) AS n FROM panel GROUP BY 1")
def h11_trend(spark, sf):
    return r(r(D.trend(V.panel_sy(spark, sf)), "slope", digits=4), "intercept", digits=-2)


@query(f"""WITH {V.PANEL_NM}, g AS (SELECT *, value - lag(value) OVER {W} AS growth, row_number() OVER (PARTITION BY unit ORDER BY t DESC) AS back FROM panel),
a AS (SELECT unit, regr_slope(CASE WHEN back <= 6 THEN value END, t) AS slope, max(CASE WHEN back = 1 THEN growth END) AS last, avg(CASE WHEN back > 1 THEN growth END) AS m, stddev_samp(CASE WHEN back > 1 THEN growth END) AS s,
 list(growth ORDER BY t) FILTER (growth IS NOT NULL) AS gs FROM g GROUP BY 1)
SELECT unit, round(slope, 2) AS slope, round((last - m) / s, 6) AS shock_z, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(gs, lambda x: (x - m) / s)), lambda acc, x: greatest(0, acc + x - 0.5)), 6) AS cusum_up,
 round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(gs, lambda x: (x - m) / s)), lambda acc, x: greatest(0, acc - x - 0.5)), 6) AS cusum_down FROM a""")
def h12_trend_shock(spark, sf):
    return r(r(D.trend_shock(V.panel_nm(spark, sf)), "shock_z", "cusum_up", "cusum_down"), "slope", digits=2)


PARTS = " + ".join(f"{w} * coalesce({'1 - ' if less else ''}({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0.5)" for c, (w, less) in D.ENVELOPE.items())


@query(f"""WITH {V.PANEL_SY}, ix AS (SELECT unit, t, 10 * ln(1 + value) AS "index", disc * 1000 AS risk, qty / 100.0 AS q FROM panel),
dl AS (SELECT *, "index" - lag("index") OVER {W} AS d, q - lag(q) OVER {W} AS av, risk - lag(risk) OVER {W} AS rv, row_number() OVER (PARTITION BY unit ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY unit) AS n FROM ix),
u AS (SELECT unit, max("index") FILTER (back = 1) - max("index") FILTER (back = least(3, n)) AS trend, stddev_pop(d) FILTER (back <= 5) AS volatility, max("index") FILTER (back <= 5) - max("index") FILTER (back = 1) AS drawdown,
 avg((d > 0)::INT) FILTER (back <= 5) AS rises, coalesce(max(av) FILTER (back = 1), 0) - coalesce(max(rv) FILTER (back = 1), 0) AS gap, max(risk) FILTER (back = 1) AS risk FROM dl GROUP BY 1), e AS (SELECT *, 100 * ({PARTS}) AS envelope FROM u)
SELECT unit, round(trend, 6) AS trend, round(volatility, 6) AS volatility, round(drawdown, 6) AS drawdown, round(rises, 6) AS rises, round(gap, 6) AS gap, round(risk, 6) AS risk, round(envelope, 5) AS envelope, round(risk - envelope, 5) AS fragility,
 CASE WHEN envelope >= 70 AND risk <= 45 THEN 'resilient_accelerator' WHEN envelope >= 58 AND risk > 45 THEN 'pressured_growth' WHEN envelope < 45 AND risk >= 60 THEN 'stall_trap' WHEN gap >= 0 THEN 'adaptive_transition' ELSE 'fragile_transition' END AS class FROM e""")
def h13_unit_envelope(spark, sf):
    own = D.own_order()
    p = V.panel_sy(spark, sf).select("unit", "t", (10 * F.log1p("value")).alias("index"), (F.col("disc") * 1000).alias("risk"), (F.col("qty") / 100.0).alias("q"))
    p = p.select("unit", "t", "index", "risk", (F.col("q") - F.lag("q").over(own)).alias("accel_velocity"), (F.col("risk") - F.lag("risk").over(own)).alias("risk_velocity"))
    return r(r(D.unit_envelope(p), "trend", "volatility", "drawdown", "rises", "gap", "risk"), "envelope", "fragility", digits=5)


@query(f"""WITH {V.PANEL_NM}, g AS (SELECT grp, t, avg(value) AS mean, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, stddev_samp(value) AS sd FROM panel GROUP BY ALL)
SELECT grp, t, round(mean, 4) AS mean, round(p25, 4) AS p25, round(p75, 4) AS p75, round(sd, 4) AS sd, round(mean / lag(mean) OVER (PARTITION BY grp ORDER BY t) - 1, 4) AS yoy FROM g""")
def h14_group_envelope(spark, sf):
    return r(D.group_envelope(V.panel_nm(spark, sf)), "mean", "p25", "p75", "sd", "yoy", digits=4)


@query(f"""WITH {V.PANEL_NM}, c AS (SELECT *, avg(value) OVER (PARTITION BY grp, t) AS gm, avg(value) OVER (PARTITION BY t) AS am FROM panel)
SELECT unit, t, value, lag(value) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, round(gm, 5) AS group_mean, round(gm - lag(gm) OVER w, 5) AS group_delta, round(am - lag(am) OVER w, 5) AS all_delta, lead(value) OVER w AS target FROM c WINDOW w AS (PARTITION BY unit ORDER BY t)""")
def h16_lag_panel(spark, sf):
    return r(D.lag_panel(V.panel_nm(spark, sf)), "group_mean", "group_delta", "all_delta", digits=5)


@query(f"""WITH {V.PANEL_NM}, d AS (SELECT *, value - lag(value) OVER {W} AS d FROM panel), o AS (SELECT *, d - avg(d) OVER (PARTITION BY grp, t) AS own FROM d)
SELECT unit, t, round(own, 7) AS own, round(avg(own) OVER w, 7) AS past_mean, round(stddev_samp(own) OVER w, 7) AS past_sd FROM o WINDOW w AS (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def h17_first_differences(spark, sf):
    return r(D.first_differences(V.panel_nm(spark, sf)), "own", "past_mean", "past_sd", digits=7)


@query(f"WITH {V.PANEL_UD} SELECT unit, t, value, round(value - lead(value) OVER (PARTITION BY unit ORDER BY t DESC), 2) AS shift FROM panel QUALIFY row_number() OVER (PARTITION BY unit ORDER BY t DESC) = 1")
def h19_latest_shift(spark, sf):
    return r(D.latest_shift(V.panel_ud(spark, sf)), "shift", digits=2)


@query(f"""WITH {V.PANEL_NM}, p AS (SELECT grp, t, avg(value) / 1000000 AS score FROM panel GROUP BY ALL), d AS (SELECT *, score - lag(score) OVER w AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY grp) AS n FROM p WINDOW w AS (PARTITION BY grp ORDER BY t)),
g AS (SELECT grp, count(*) AS periods, max_by(score, t) AS last, avg(score) AS mean, regr_slope(score, t) AS slope, stddev_pop(coalesce(d, 0)) AS vol, avg((coalesce(d, 0) > 0)::INT) AS pos FROM d GROUP BY 1),
s AS (SELECT grp, n, i AS slot, unnest(range(1, 401))::INT AS draw FROM d WHERE n >= 3), k AS (SELECT grp, draw, floor(('0x' || substr(md5(draw || ':' || grp || ':' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT + 1 AS i FROM s),
b AS (SELECT grp, draw, regr_slope(score, t) AS b FROM k JOIN d USING (grp, i) GROUP BY ALL), ci AS (SELECT grp, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b GROUP BY 1),
x AS (SELECT g.*, lo, hi, 100 * (0.36 * (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) + 0.28 * (slope - min(slope) OVER ()) / (max(slope) OVER () - min(slope) OVER ()) + 0.22 * (1 - (vol - min(vol) OVER ()) / (max(vol) OVER () - min(vol) OVER ())) + 0.14 * CASE WHEN max(pos) OVER () > min(pos) OVER () THEN (pos - min(pos) OVER ()) / (max(pos) OVER () - min(pos) OVER ()) ELSE 0.5 END) AS st FROM g JOIN ci USING (grp))
SELECT grp, periods, round(last, 6) AS last, round(mean, 6) AS mean, round(slope, 6) AS slope, round(lo, 6) AS low, round(hi, 6) AS high, round(vol, 6) AS volatility, round(pos, 6) AS positive, round(st, 4) AS stability, row_number() OVER (ORDER BY round(st, 9) DESC, grp)::INT AS rank FROM x""")
def h15_group_stability(spark, sf):
    g = V.panel_nm(spark, sf).groupBy("grp", "t").agg((F.avg("value") / 1000000).alias("score"))
    return r(r(D.group_stability(g), "last", "mean", "slope", "low", "high", "volatility", "positive"), "stability", digits=4)


FEATURES = ["level", "sd", "trend", "growth", "volatility"]


@query()
def h18_unit_embeddings(spark, sf):
    """Eigenvectors of a matrix of moments; tested against plain Python."""
    return r(D.unit_embeddings(D.unit_features(V.panel_sy(spark, sf)), FEATURES), "e1", "e2", digits=4)


@query()
def i11_archetypes(spark, sf):
    """k-means; tested by what its clusters are."""
    return D.archetypes(D.unit_features(V.panel_sy(spark, sf)), FEATURES, {"growth": 1.0, "trend": 0.45, "volatility": -0.8})
