"""Queries of phase rules and external validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.operators import phase as P
from tessella.operators import validity as X
from tessella.plans import views as V
from tessella.plans.phase_queries import PHASE
from tessella.plans.regression_queries import SYD, _syd
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.plans.sql import solved, within
from tessella.sources.tables import Stages


START = 48


def _nations(spark, sf):
    """Nations by month as units of their regions: y (log value), did (odd ones from START on), treated."""
    p = V.panel_nm(spark, sf)
    odd = (F.ascii(F.substring("unit", -1, 1)) % 2).cast("int")
    return p.select("unit", F.col("grp").alias("cl"), "t", F.log1p("value").alias("y"), (odd * (F.col("t") >= START).cast("int")).alias("did"), odd.alias("treated"))


XS = ["did", "did_x_rule", "rule_trend", "treated_trend"]
FLAGS = {
    "phase_label_fragility_set": "label IN ('centrifugal_fragility', 'rotational_transition')", "phase_flow_speed_q60": "speed >= s60", "phase_flow_speed_q67": "speed >= s67", "phase_flow_speed_q75": "speed >= s75",
    "phase_vorticity_abs_q67": "abs(vorticity) >= v67", "phase_vorticity_abs_q75": "abs(vorticity) >= v75", "phase_flow_x_vorticity_q67": "speed >= s67 AND abs(vorticity) >= v67",
}
STACKED = " UNION ALL ".join(f"SELECT unit, '{k}' AS rule, coalesce(({c})::INT, 0) AS flag FROM base, cuts" for k, c in FLAGS.items())
LEAST = 4


@query(f"""WITH {PHASE}, np AS (SELECT unit, grp AS cl, t, ln(1 + value) AS y, (ascii(right(unit, 1)) % 2) * (t >= {START})::INT AS did, ascii(right(unit, 1)) % 2 AS treated FROM panel),
base AS (SELECT unit, speed, label, vorticity FROM portrait WHERE t = (SELECT max(t) FROM np WHERE t < {START}) AND speed IS NOT NULL),
cuts AS (SELECT quantile_cont(speed, 0.6) AS s60, quantile_cont(speed, 0.67) AS s67, quantile_cont(speed, 0.75) AS s75, quantile_cont(abs(vorticity), 0.67) AS v67, quantile_cont(abs(vorticity), 0.75) AS v75 FROM base),
flags AS (SELECT * FROM ({STACKED}) WHERE (SELECT count(vorticity) FROM base) >= {2 * LEAST} OR rule NOT LIKE '%vorticity%'),
u AS (SELECT a.unit, r.rule, coalesce(flag, 0) AS flag, share FROM (SELECT DISTINCT unit FROM np) a CROSS JOIN (SELECT rule, avg(flag) AS share FROM flags GROUP BY 1) r LEFT JOIN flags f ON f.unit = a.unit AND f.rule = r.rule),
sizes AS (SELECT rule, any_value(share) AS share, sum(flag)::BIGINT AS flagged, sum(1 - flag)::BIGINT AS others, CASE WHEN any_value(share) NOT BETWEEN 0.08 AND 0.92 THEN 'extreme_group_share' WHEN least(sum(flag), sum(1 - flag)) < {LEAST} THEN 'too_few_units_in_rule_group' ELSE 'ok' END AS status FROM u GROUP BY 1),
x AS (SELECT u.rule, np.unit, cl, t, y, did::DOUBLE AS did, (did * flag)::DOUBLE AS did_x_rule, (flag * (t - (SELECT min(t) FROM np)))::DOUBLE AS rule_trend, (treated * (t - (SELECT min(t) FROM np)))::DOUBLE AS treated_trend FROM np JOIN u USING (unit) WHERE rule IN (SELECT rule FROM sizes WHERE status = 'ok')),
w AS ({within("x", ["y", *XS], "unit", "rule")}), {solved("mn", "w", "rule", "y", ["did_x_rule", "rule_trend", "treated_trend", "did"], "cl")}, {solved("it", "w", "rule", "y", ["did", "rule_trend", "treated_trend", "did_x_rule"], "cl")}
SELECT s.rule, round(share, 6) AS share, flagged, others, status, round(mn.coef, 5) AS coef_main, round(mn.stderr, 5) AS stderr_main, round(it.coef, 5) AS coef_interaction, round(it.stderr, 5) AS stderr_interaction, round(mn.coef + it.coef, 5) AS effect_flagged, mn.n AS n_obs, mn.g AS n_clusters
FROM sizes s LEFT JOIN mn ON mn.rule = s.rule LEFT JOIN it ON it.rule = s.rule""")
def k11_phase_rules(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60)
    scores = Stages(spark, "phase").cut(d.select("unit", "t", (100 * F.col("rank_pct")).alias("risk"), (50 + 10 * F.col("z_unit")).alias("accel")), "scores")
    found = X.phase_rule_grid(_nations(spark, sf), P.phase_portrait(scores, "risk", "accel"), START, LEAST)
    return r(r(found.drop("p_main", "p_interaction"), "share"), "coef_main", "stderr_main", "coef_interaction", "stderr_interaction", "effect_flagged", digits=5)


INDICATORS, CONTROLS = ("ind_value", "ind_price"), ("c_qty", "c_disc", "c_n")


def _base(first: str, base: list[str], y: str) -> str:
    """SQL: y's residual in all rows by regressions learned from the rows that aren't ``test``, column by column."""
    cols = ["one", *base]
    steps = [f"{first}0 AS (SELECT *, one AS o0 FROM parted)"]
    for j in range(1, len(cols)):
        less = " - ".join(f"o{i} * (sum({cols[j]} * o{i}) FILTER (NOT test) OVER q / sum(o{i} * o{i}) FILTER (NOT test) OVER q)" for i in range(j))
        steps.append(f"{first}{j} AS (SELECT *, {cols[j]} - {less} AS o{j} FROM {first}{j - 1} WINDOW q AS (PARTITION BY indicator))")
    left = " - ".join(f"o{i} * (sum({y} * o{i}) FILTER (NOT test) OVER q / sum(o{i} * o{i}) FILTER (NOT test) OVER q)" for i in range(len(cols)))
    steps.append(f"{first}e AS (SELECT *, {y} - {left} AS e FROM {first}{len(cols) - 1} WINDOW q AS (PARTITION BY indicator))")
    steps.append(f"{first} AS (SELECT indicator, 1 - sum(e * e) / (sum({y} * {y}) - sum({y}) ** 2 / count(*)) AS r2 FROM {first}e WHERE test GROUP BY 1)")
    return ", ".join(steps)


@query(f"""WITH {V.PANEL_SY}, m AS (SELECT cl, t, avg(ln(1 + value)) AS score, avg(qty::DOUBLE) AS c_qty, avg(disc) AS c_disc, avg(n::DOUBLE) AS c_n, avg(value / n) AS ind_price, avg(value) AS ind_value FROM panel GROUP BY ALL),
long AS (SELECT 'ind_value' AS indicator, cl, t, score, c_qty, c_disc, c_n, ind_value AS now FROM m UNION ALL SELECT 'ind_price', cl, t, score, c_qty, c_disc, c_n, ind_price FROM m),
led AS (SELECT *, lead(now) OVER (PARTITION BY indicator, cl ORDER BY t) AS y FROM long), d AS (SELECT * FROM led WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY indicator) >= 60),
w AS ({within("d", ["y", "score", *CONTROLS], "cl", "indicator")}), {solved("f", "w", "indicator", "y", [*CONTROLS, "score"])},
sp AS (SELECT indicator, list_sort(list(DISTINCT t)) AS ts FROM d GROUP BY 1), parted AS (SELECT d.*, 1.0::DOUBLE AS one, t > CASE WHEN len(ts) >= 5 THEN ts[len(ts) - 2] ELSE ts[len(ts) - 1] END AS test FROM d JOIN sp USING (indicator)),
{_base("v", list(CONTROLS), "y")}, {_base("p", [*CONTROLS, "score"], "y")}, sz AS (SELECT indicator, count(*) FILTER (NOT test) >= 80 AND count(*) FILTER (test) >= 40 AS enough FROM parted GROUP BY 1),
rk AS (SELECT indicator, t, rank() OVER (PARTITION BY indicator, t ORDER BY score) + (count(*) OVER (PARTITION BY indicator, t, score) - 1) / 2 AS a, rank() OVER (PARTITION BY indicator, t ORDER BY now) + (count(*) OVER (PARTITION BY indicator, t, now) - 1) / 2 AS b FROM d),
rho AS (SELECT indicator, corr(a, b) AS rho FROM rk GROUP BY indicator, t HAVING count(*) >= 12), rm AS (SELECT indicator, avg(rho) AS rho, count(*) AS periods FROM rho GROUP BY 1)
SELECT f.indicator, round(coef, 2) AS coef, round(stderr, 2) AS stderr, round(coef / stderr, 5) AS t_value, n AS n_obs, round(f.r2, 6) AS r2, round(CASE WHEN enough THEN v.r2 END, 6) AS r2_base, round(CASE WHEN enough THEN p.r2 END, 6) AS r2_plus, round(CASE WHEN enough THEN p.r2 - v.r2 END, 6) AS uplift, round(rho, 6) AS rank_correlation, periods
FROM f LEFT JOIN v USING (indicator) LEFT JOIN p USING (indicator) LEFT JOIN sz USING (indicator) LEFT JOIN rm USING (indicator)""")
def k30_external_validity(spark, sf):
    p = V.panel_sy(spark, sf)
    n = F.col("n").cast("double")
    p = p.select("unit", "cl", "t", F.log1p("value").alias("score"), F.col("qty").cast("double").alias("qty"), "disc", n.alias("n"), (F.col("value") / n).alias("ind_price"), F.col("value").alias("ind_value"))
    found = X.external_validity(p, "score", ["qty", "disc", "n"], list(INDICATORS), least=60)
    return r(r(r(found, "r2", "r2_base", "r2_plus", "uplift", "rank_correlation"), "coef", "stderr", digits=2), "t_value", digits=5)


@query(f"""WITH {SYD}, pc AS (SELECT unit, cl, t, y, x, CASE unit % 4 WHEN 0 THEN 1999 WHEN 1 THEN 2000 ELSE 9999 END AS cohort FROM p), lim AS (SELECT min(t) AS low, max(t) AS high FROM pc),
us AS (SELECT DISTINCT unit, cohort FROM pc), fk AS (SELECT lead, unit, greatest(cohort - lead, low + 2) AS g FROM us, lim, (VALUES (2), (3)) l(lead) WHERE cohort < 9999 AND greatest(cohort - lead, low + 2) <= high - 2),
ce AS (SELECT lead, g, count(*) AS n_treated FROM fk GROUP BY ALL HAVING count(*) >= 3), mb AS (SELECT ce.lead, ce.g, us.unit, n_treated, (fk.unit IS NOT NULL)::INT AS own, count(*) OVER (PARTITION BY ce.lead, ce.g) AS n_members FROM ce JOIN us ON cohort > ce.g LEFT JOIN fk ON fk.unit = us.unit AND fk.lead = ce.lead AND fk.g = ce.g),
xr AS (SELECT mb.lead || ':' || mb.g AS cell, mb.lead, pc.unit, pc.cl, pc.t, y, x, (own * (pc.t >= g)::INT)::DOUBLE AS did, (own * (pc.t - g))::DOUBLE AS trend, n_treated, n_members FROM mb JOIN pc ON pc.unit = mb.unit AND pc.t BETWEEN g - 2 AND g + 2 WHERE n_members >= 6),
ok AS (SELECT cell FROM xr GROUP BY 1 HAVING count(*) >= 60 AND count(DISTINCT unit) >= 10 AND count(DISTINCT t) >= 4), d AS (SELECT cell, unit, cl, t, y, x, did, trend FROM xr WHERE cell IN (SELECT cell FROM ok)),
w AS ({within("d", ["y", "x", "did", "trend"], "unit", "cell")}), {solved("f", "w", "cell", "y", ["x", "trend", "did"], "cl")},
told AS (SELECT i.lead, f.cell, coef, stderr, i.n_treated, i.n_members, n AS n_obs FROM f JOIN (SELECT DISTINCT cell, lead, n_treated, n_members FROM xr) i USING (cell)),
every AS (SELECT * FROM told UNION ALL SELECT lead, NULL, sum(n_treated * coef) / sum(n_treated), sqrt(sum((n_treated * stderr) ** 2)) / sum(n_treated), sum(n_treated)::BIGINT, sum(n_members)::BIGINT, sum(n_obs)::BIGINT FROM told GROUP BY lead)
SELECT lead, cell, round(coef, 6) AS coef, round(stderr, 6) AS stderr, n_treated, n_members, n_obs, round(coef / stderr, 5) AS t_value FROM every""")
def k9_stacked_placebo(spark, sf):
    cohort = F.when(F.col("unit") % 4 == 0, 1999).when(F.col("unit") % 4 == 1, 2000).otherwise(9999)
    found = X.stacked_placebo(_syd(spark, sf).withColumn("cohort", cohort), "y", controls=("x",))
    return r(r(found, "coef", "stderr"), "t_value", digits=5)
