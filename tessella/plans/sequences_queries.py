"""Queries of the state-sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.operators import sequences as Q
from tessella.plans import views as V
from tessella.plans.dynamics_queries import DYN, STATES, W, _states
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r


def _five(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60)
    return Q.five_states(d.select("unit", "grp", "t", F.col("growth").alias("up"), F.col("vol_3").alias("down")), "up", "down")


FIVE = f"""{DYN}, five AS (SELECT unit, grp, t, CASE WHEN growth IS NULL OR vol_3 IS NULL THEN NULL WHEN uh AND dh THEN 'volatile' WHEN uh THEN 'surge' WHEN dh THEN 'stall' WHEN ul AND dl THEN 'calm' ELSE 'mixed' END AS state FROM
 (SELECT *, growth >= quantile_cont(growth, 0.65) OVER p AS uh, growth <= quantile_cont(growth, 0.35) OVER p AS ul, vol_3 >= quantile_cont(vol_3, 0.65) OVER p AS dh, vol_3 <= quantile_cont(vol_3, 0.35) OVER p AS dl FROM dyn WINDOW p AS (PARTITION BY t)))"""


@query(f"WITH {FIVE} SELECT unit, t, state FROM five")
def i1_five_states(spark, sf):
    return _five(spark, sf).select("unit", "t", "state")


@query(f"""WITH {FIVE}, n AS (SELECT grp, state AS f, CASE WHEN lead(t) OVER {W} = t + 1 THEN lead(state) OVER {W} END AS x FROM five),
c AS (SELECT grp, f, x, count(*) AS n FROM n WHERE f IS NOT NULL AND x IS NOT NULL GROUP BY GROUPING SETS ((f, x), (grp, f, x))), s AS (SELECT *, sum(n) OVER (PARTITION BY grp, f) AS total FROM c), p AS (SELECT *, n / total AS p, 3.8416 AS zz FROM s)
SELECT grp, f AS from_state, x AS to_state, n, total::BIGINT AS total, round(p, 6) AS share, round(((p + zz / (2 * total)) - 1.96 * sqrt(p * (1 - p) / total + zz / (4 * total * total))) / (1 + zz / total), 6) AS low,
 round(((p + zz / (2 * total)) + 1.96 * sqrt(p * (1 - p) / total + zz / (4 * total * total))) / (1 + zz / total), 6) AS high FROM p""")
def i2_transition_tensor(spark, sf):
    return r(Q.transition_tensor(_five(spark, sf)), "share", "low", "high")


@query(f"""WITH {STATES}, c AS (SELECT state AS from_state, lead(state) OVER {W} AS to_state FROM states) SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM (SELECT from_state, to_state, count(*) AS n FROM c WHERE to_state IS NOT NULL GROUP BY ALL)""")
def i3_transition_matrix(spark, sf):
    return r(Q.transition_matrix(_states(spark, sf)), "share")


SPELLS = f"""{STATES}, sn AS (SELECT *, lead(t) OVER {W} AS nt FROM states), isl AS (SELECT *, t - row_number() OVER (PARTITION BY unit ORDER BY t) AS island FROM sn WHERE state = 'low'),
spells AS (SELECT unit, min(t) AS start, max(t) AS "end", (max(t) - min(t) + 1)::INT AS duration, coalesce((max_by(coalesce(nt, -1), t) = max(t) + 1)::INT, 0) AS "left" FROM isl GROUP BY unit, island)"""


@query(f"WITH {SPELLS} SELECT * FROM spells")
def i4_spells(spark, sf):
    return Q.spells(_states(spark, sf), "low")


@query(f"""WITH {SPELLS}, d AS (SELECT duration, count(*) AS ends, sum("left")::BIGINT AS exits FROM spells GROUP BY 1), h AS (SELECT *, sum(ends) OVER (ORDER BY duration DESC)::BIGINT AS at_risk FROM d), p AS (SELECT *, exits / at_risk AS p, 3.8416 AS zz FROM h)
SELECT duration, at_risk, exits, round(p, 6) AS hazard, round(((p + zz / (2 * at_risk)) - 1.96 * sqrt(p * (1 - p) / at_risk + zz / (4 * at_risk * at_risk))) / (1 + zz / at_risk), 6) AS low,
 round(((p + zz / (2 * at_risk)) + 1.96 * sqrt(p * (1 - p) / at_risk + zz / (4 * at_risk * at_risk))) / (1 + zz / at_risk), 6) AS high, round(product(1 - p) OVER (ORDER BY duration), 6) AS survival FROM p""")
def i5_spell_hazard(spark, sf):
    return r(Q.spell_hazard(Q.spells(_states(spark, sf), "low")), "hazard", "low", "high", "survival")


@query(f"""WITH {SPELLS}, g AS (SELECT DISTINCT unit, grp FROM states), a AS (SELECT grp, count(*) AS spells, avg(duration) AS m, ceil(quantile_cont(duration, 0.5))::INT AS half_life FROM spells JOIN g USING (unit) GROUP BY 1)
SELECT grp, spells, round(m, 6) AS mean_duration, half_life, dense_rank() OVER (ORDER BY half_life)::INT AS rank FROM a""")
def i6_half_life(spark, sf):
    s = _states(spark, sf)
    return r(Q.half_life(Q.spells(s, "low"), s.select("unit", "grp").distinct()), "mean_duration")


def _spells(state: str) -> str:
    return f"""{state}_n AS (SELECT *, lead(t) OVER {W} AS nt FROM states), {state}_i AS (SELECT *, t - row_number() OVER (PARTITION BY unit ORDER BY t) AS island FROM {state}_n WHERE state = '{state}'),
{state}_s AS (SELECT unit, (max(t) - min(t) + 1)::INT AS duration, coalesce((max_by(coalesce(nt, -1), t) = max(t) + 1)::INT, 0) AS "left" FROM {state}_i GROUP BY unit, island),
{state}_e AS (SELECT grp, duration, "left" FROM {state}_s JOIN g USING (unit) UNION ALL SELECT '', duration, "left" FROM {state}_s),
{state}_d AS (SELECT grp, duration, count(*) AS ends, sum("left") AS exits FROM {state}_e GROUP BY ALL), {state}_h AS (SELECT *, exits / sum(ends) OVER (PARTITION BY grp ORDER BY duration DESC) AS h FROM {state}_d),
{state}_a AS (SELECT *, product(1 - h) OVER (PARTITION BY grp ORDER BY duration) AS alive FROM {state}_h),
{state}_g AS (SELECT grp, sum(ends)::BIGINT AS spells, sum(ends * duration) / sum(ends) AS mean, min(duration) FILTER (round(alive, 9) <= 0.5) AS half, max_by(alive, duration) AS survival FROM {state}_a GROUP BY 1)"""


@query(f"""WITH {STATES}, g AS (SELECT DISTINCT unit, grp FROM states), {_spells('low')}, {_spells('high')},
j AS (SELECT coalesce(b.grp, a.grp) AS grp, coalesce(b.spells, 0) AS bs, coalesce(a.spells, 0) AS gs, b.mean AS bm, b.half AS bh, b.survival AS bv, a.mean AS gm, a.half AS gh, a.survival AS gv FROM low_g b FULL JOIN high_g a ON b.grp = a.grp),
s AS (SELECT *, 100 * (coalesce(0.5 * least(1, greatest(0, (4 - bh) / 4)), 0) + coalesce(0.5 * least(1, greatest(0, gh / 4)), 0)) AS score FROM j)
SELECT nullif(grp, '') AS grp, bs AS bad_spells, gs AS good_spells, round(bm, 6) AS bad_mean, bh AS bad_half_life, round(bv, 6) AS bad_survival, round(gm, 6) AS good_mean, gh AS good_half_life, round(gv, 6) AS good_survival, gh - bh AS gap, round(score, 5) AS score,
 dense_rank() OVER (ORDER BY round(score, 9) DESC)::INT AS rank FROM s""")
def i6_resilience(spark, sf):
    s = _states(spark, sf)
    found = Q.resilience(Q.spells(s, "low"), Q.spells(s, "high"), s.select("unit", "grp").distinct())
    return r(r(found, "bad_mean", "bad_survival", "good_mean", "good_survival"), "score", digits=5)


WARNED = f"""{DYN}, e AS (SELECT unit, t, vol_3 AS score, (growth < 0)::INT AS event FROM dyn),
l AS (SELECT 1 AS h, score, lead(event) OVER w AS hit FROM e WINDOW w AS (PARTITION BY unit ORDER BY t) UNION ALL SELECT 2, score, CASE WHEN lead(event, 2) OVER w IS NOT NULL THEN greatest(lead(event) OVER w, lead(event, 2) OVER w) END FROM e WINDOW w AS (PARTITION BY unit ORDER BY t)
 UNION ALL SELECT 3, score, CASE WHEN lead(event, 3) OVER w IS NOT NULL THEN greatest(lead(event) OVER w, lead(event, 2) OVER w, lead(event, 3) OVER w) END FROM e WINDOW w AS (PARTITION BY unit ORDER BY t))"""


@query(f"""WITH {WARNED}, k AS (SELECT h, hit, rank() OVER (PARTITION BY h ORDER BY score) + (count(*) OVER (PARTITION BY h, score) - 1) / 2 AS rk FROM l WHERE score IS NOT NULL AND hit IS NOT NULL)
SELECT h AS horizon, count(*) AS "rows", round(avg(hit), 6) AS base_rate, round((sum(CASE WHEN hit = 1 THEN rk END) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))), 6) AS auc FROM k GROUP BY 1""")
def i7_warning_horizon(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60).select("unit", "t", F.col("vol_3").alias("score"), (F.col("growth") < 0).cast("int").alias("event"))
    return r(Q.warning_horizon(d, "score", "event"), "base_rate", "auc")


@query(f"""WITH {STATES}, n AS (SELECT DISTINCT state FROM states), c AS (SELECT state AS f, lead(state) OVER {W} AS x FROM states), k AS (SELECT f, x, count(*) AS c FROM c WHERE x IS NOT NULL GROUP BY ALL),
m AS (SELECT a.state AS f, b.state AS x, coalesce(k.c, 0) + 1 AS c FROM n a CROSS JOIN n b LEFT JOIN k ON k.f = a.state AND k.x = b.state), p1 AS (SELECT f, x, c / sum(c) OVER (PARTITION BY f) AS p FROM m),
p2 AS (SELECT a.f, b.x, sum(a.p * b.p) AS p FROM p1 a JOIN p1 b ON a.x = b.f GROUP BY ALL), p3 AS (SELECT a.f, b.x, sum(a.p * b.p) AS p FROM p2 a JOIN p1 b ON a.x = b.f GROUP BY ALL)
SELECT f AS from_state, x AS to_state, round(p, 6) AS p, 1 AS h FROM p1 UNION ALL SELECT f, x, round(p, 6), 2 FROM p2 UNION ALL SELECT f, x, round(p, 6), 3 FROM p3""")
def i8_regime_forecast(spark, sf):
    return r(Q.regime_forecast(_states(spark, sf)), "p")


@query(f"""WITH {WARNED}, w AS (SELECT h, score, hit FROM l WHERE score IS NOT NULL AND hit IS NOT NULL), b AS (SELECT h, score, sum(hit) AS pos, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT h, pos, sum(pos) OVER (PARTITION BY h ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY h ORDER BY score DESC) AS k FROM b),
ap AS (SELECT h, sum(pos * tp / k) / sum(pos) AS ap FROM c GROUP BY 1), q AS (SELECT h, quantile_cont(score, 0.9) AS cut FROM w GROUP BY 1)
SELECT w.h AS horizon, round(any_value(ap), 6) AS average_precision, round(avg((least(greatest(score, 0), 1) - hit) ** 2), 6) AS brier, round(avg(CASE WHEN score >= cut THEN hit END) / avg(hit), 6) AS top_lift FROM w JOIN q USING (h) JOIN ap USING (h) GROUP BY 1""")
def i7_warning_scores(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60).select("unit", "t", F.col("vol_3").alias("score"), (F.col("growth") < 0).cast("int").alias("event"))
    return r(Q.warning_scores(d, "score", "event"), "average_precision", "brier", "top_lift")
