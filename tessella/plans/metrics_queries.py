"""Queries of the metric and resampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import metrics as M
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.plans.sql import POISSON


@query(f"""WITH {V.SCORES}, s AS (SELECT 'all' AS scope, p, y FROM scores UNION ALL SELECT grp, p, y FROM scores), k AS (SELECT scope, y, rank() OVER (PARTITION BY scope ORDER BY p) + (count(*) OVER (PARTITION BY scope, p) - 1) / 2 AS rk FROM s)
SELECT scope, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY 1""")
def m1_auc(spark, sf):
    return r(M.auc(V.scores(spark, sf), "y", "p", "grp"), "auc")


@query(f"""WITH {V.SCORES}, b AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM b), x AS (SELECT quantile_cont(p, 0.9) AS x FROM scores)
SELECT round((SELECT sum(pos * tp / k) / sum(pos) FROM c), 6) AS average_precision, round((SELECT avg(CASE WHEN p >= x THEN y END) / avg(y) FROM scores, x), 6) AS top_lift""")
def m2_average_precision(spark, sf):
    return r(M.average_precision(V.scores(spark, sf), "y", "p"), "average_precision", "top_lift")


BINS = f"""{V.SCORES}, e AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scores), b AS (SELECT len(list_filter(e, lambda x: p > x))::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM scores, e GROUP BY 1)"""


@query(f"WITH {BINS} SELECT bin, n, round(mp, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mp - rate), 6) AS gap FROM b")
def m3_calibration(spark, sf):
    return r(M.calibration(V.scores(spark, sf), "y", "p"), "mean_p", "rate", "gap")


@query(f"WITH {BINS} SELECT round(sum(abs(mp - rate) * n) / sum(n), 6) AS ece, round(max(abs(mp - rate)), 6) AS mce, round((SELECT avg((p - y) ** 2) FROM scores), 6) AS brier FROM b")
def m3_calibration_error(spark, sf):
    return r(M.calibration_error(V.scores(spark, sf), "y", "p"), "ece", "mce", "brier")


@query(f"""WITH {V.PANEL_NM}, f AS (SELECT grp, ln(value) AS y, ln(lag(value) OVER w) AS naive, (ln(lag(value) OVER w) + ln(lag(value, 2) OVER w)) / 2 AS p FROM panel WINDOW w AS (PARTITION BY unit ORDER BY t)), d AS (SELECT * FROM f WHERE p IS NOT NULL)
SELECT grp, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg((sign(p - naive) = sign(y - naive))::INT), 6) AS directional, round(1 - sqrt(avg((p - y) ** 2)) / sqrt(avg((naive - y) ** 2)), 6) AS skill
FROM d GROUP BY GROUPING SETS ((grp), ())""")
def m4_regression_metrics(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("t")
    lag = lambda k: F.log(F.lag("value", k).over(w))
    f = V.panel_nm(spark, sf).select("grp", F.log("value").alias("y"), lag(1).alias("naive"), ((lag(1) + lag(2)) / 2).alias("p")).filter("p IS NOT NULL")
    return r(M.regression_metrics(f, "y", "p", "naive", "grp"), "rmse", "mae", "r2", "directional", "skill")


@query(f"""WITH {V.SCORES}, a AS (SELECT avg(y) AS y, avg(p) AS p, avg((p - y) ** 2) AS b FROM scores) SELECT grp, count(*) AS n, round(avg(s.y), 6) AS rate, round(avg(s.p), 6) AS mean_p, round(avg((s.p - s.y) ** 2), 6) AS brier, round(avg(s.y) - any_value(a.y), 6) AS rate_gap, round(avg(s.p) - any_value(a.p), 6) AS mean_p_gap, round(avg((s.p - s.y) ** 2) - any_value(a.b), 6) AS brier_gap FROM scores s, a GROUP BY 1""")
def m5_group_gaps(spark, sf):
    return r(M.group_gaps(V.scores(spark, sf), "y", "p", "grp"), "rate", "mean_p", "brier", "rate_gap", "mean_p_gap", "brier_gap")


@query(f"""WITH {V.SCORES}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS th) SELECT th AS threshold, round((sum(CASE WHEN p >= th THEN y ELSE 0 END) - sum(CASE WHEN p >= th THEN 1 - y ELSE 0 END) * th / (1 - th)) / count(*), 6) AS net_benefit, round((sum(y) - (count(*) - sum(y)) * th / (1 - th)) / count(*), 6) AS act_always FROM scores, t GROUP BY 1""")
def m6_decision_curve(spark, sf):
    return r(M.decision_curve(V.scores(spark, sf), "y", "p", [0.1, 0.3, 0.5, 0.7]), "net_benefit", "act_always")


@query(f"""WITH {V.SCORES}, b AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scores GROUP BY 1), d AS (SELECT n, pos, floor(coalesce(sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 / (SELECT count(*) FROM scores))::INT + 1 AS decile FROM b)
SELECT decile, sum(n)::BIGINT AS n, round(sum(pos) / sum(n), 6) AS rate, round(sum(pos) / sum(n) / (SELECT avg(y) FROM scores), 6) AS lift FROM d GROUP BY 1""")
def m18_decile_table(spark, sf):
    return r(M.decile_table(V.scores(spark, sf), "y", "p", "id"), "rate", "lift")


@query(f"""WITH {V.SCORES}, k AS (SELECT id, grp, 1 - p AS pv, row_number() OVER (PARTITION BY grp ORDER BY 1 - p, id) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM scores) SELECT id, grp, round(least(1.0, min(pv * n / rk) OVER (PARTITION BY grp ORDER BY rk DESC)), 6) AS p_adjusted FROM k""")
def l5_bh_adjust(spark, sf):
    s = V.scores(spark, sf).select("id", "grp", (1 - F.col("p")).alias("pv"))
    return r(M.bh_adjust(s, "pv", "grp", "id").select("id", "grp", "p_adjusted"), "p_adjusted")


@query(f"""WITH {V.SCORES}, c AS (SELECT (id % 40)::VARCHAR AS c, sum(y) AS s, count(y) AS n FROM scores GROUP BY 1), d AS (SELECT *, unnest(range(1, 21))::INT AS draw FROM c), u AS (SELECT *, ('0x' || substr(md5(draw || ':' || c), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d),
w AS (SELECT *, {POISSON} AS w FROM u)
SELECT draw, round(sum(w * s) / nullif(sum(w * n), 0), 6) AS mean FROM w GROUP BY 1""")
def l1_cluster_bootstrap(spark, sf):
    return r(M.cluster_bootstrap(V.scores(spark, sf).withColumn("c", F.col("id") % 40), "y", "c", 20), "mean")


@query(f"""WITH {V.SCORES}, d AS (SELECT grp, y, CASE WHEN q > 0.5 THEN 'a' ELSE 'b' END AS act, CASE WHEN p > 0.5 THEN 'a' ELSE 'b' END AS ch, 0.2 + 0.6 * q / 1.01 AS pr FROM scores), w AS (SELECT *, CASE WHEN act = ch THEN 1 / pr ELSE 0.0 END AS w FROM d)
SELECT grp, round(avg(y), 6) AS logged, round(avg(w * y), 6) AS ips, round(sum(w * y) / nullif(sum(w), 0), 6) AS snips, round(avg(least(w, 2.0) * y), 6) AS clipped, round(sum(w) ** 2 / nullif(sum(w * w), 0), 4) AS ess FROM w GROUP BY 1""")
def m17_off_policy(spark, sf):
    pick = lambda c: F.when(F.col(c) > 0.5, "a").otherwise("b")
    d = V.scores(spark, sf).select("grp", "y", pick("q").alias("act"), pick("p").alias("ch"), (0.2 + 0.6 * F.col("q") / 1.01).alias("pr"))
    return r(r(M.off_policy(d, "y", "act", "ch", "pr", "grp", 2.0), "logged", "ips", "snips", "clipped"), "ess", digits=4)


@query(f"""WITH {V.SCORES}, c AS (SELECT quantile_cont(abs(q - p), least(1, 0.9 * (1 + 1 / count(*)))) AS w FROM (SELECT *, count(*) OVER () AS n FROM scores WHERE id % 2 = 0) GROUP BY n) SELECT id, round(p - w, 6) AS low, round(p + w, 6) AS high, (q BETWEEN p - w AND p + w)::INT AS inside FROM scores, c WHERE id % 2 = 1""".replace("least(1, 0.9 * (1 + 1 / count(*)))", "0.9"))
def m13_conformal_intervals(spark, sf):
    s = V.scores(spark, sf)
    even = s.filter("id % 2 = 0")
    # the sample correction is undone, so that the SQL can take a constant quantile
    alpha = 1 - 0.9 / (1 + 1 / max(even.count(), 1))
    return r(M.conformal_intervals(even, s.filter("id % 2 = 1"), "q", "p", alpha).select("id", "low", "high", "inside"), "low", "high")


@query(f"""WITH {V.SCORES}, c AS (SELECT unnest(['0.2', '0.4']) AS quantile, unnest(quantile_cont(q, [0.2, 0.4])) AS cut FROM scores), l AS (SELECT quantile, (q <= cut)::INT AS y, p FROM scores, c), k AS (SELECT quantile, y, rank() OVER (PARTITION BY quantile ORDER BY p) + (count(*) OVER (PARTITION BY quantile, p) - 1) / 2 AS rk FROM l)
SELECT quantile, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY 1""")
def m7_threshold_sensitivity(spark, sf):
    return r(M.threshold_sensitivity(V.scores(spark, sf), "q", "p", [0.2, 0.4]), "auc")


@query(f"""WITH {V.SCORES}, o AS (SELECT avg(CASE WHEN toxic = 1 THEN p END) - avg(CASE WHEN toxic = 0 THEN p END) AS d, sum(toxic) AS k FROM scores), d AS (SELECT id, p, unnest(range(1, 41))::INT AS draw FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substr(md5(draw || ':' || id), 1, 8))::BIGINT, id) AS r FROM d),
n AS (SELECT draw, avg(CASE WHEN r <= k THEN p END) - avg(CASE WHEN r > k THEN p END) AS d FROM r, o GROUP BY draw) SELECT round(any_value(o.d), 6) AS diff, round(avg((abs(n.d) >= abs(o.d))::INT), 6) AS p FROM n, o""")
def l2_permutation(spark, sf):
    return r(M.permutation_p(V.scores(spark, sf), "p", "toxic", "id", 40), "diff", "p")


@query(f"""WITH {V.SCORES}, d AS (SELECT id, grp, abs(q - y) - abs(p - y) AS d FROM scores), m AS (SELECT grp, avg(d) AS gain, count(*) AS n FROM d GROUP BY 1), b AS (SELECT *, unnest(range(1, 21))::INT AS draw FROM d), u AS (SELECT *, ('0x' || substr(md5(draw || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b),
w AS (SELECT *, {POISSON} AS w FROM u), g AS (SELECT grp, draw, sum(w * d) / nullif(sum(w), 0) AS g FROM w GROUP BY ALL)
SELECT m.grp, round(any_value(gain), 6) AS gain, any_value(n) AS n, round(avg((g > 0)::INT), 6) AS share_better FROM m JOIN g USING (grp) GROUP BY 1""")
def l6_paired_delta(spark, sf):
    return r(M.paired_delta(V.scores(spark, sf), "y", "q", "p", "grp", 20), "gain", "share_better")


@query(f"""WITH {V.SCORES}, d AS (SELECT grp, y, CASE WHEN q > 0.5 THEN 'a' ELSE 'b' END AS act, CASE WHEN p > 0.5 THEN 'a' ELSE 'b' END AS ch, 0.2 + 0.6 * q / 1.01 AS pr FROM scores), m AS (SELECT grp, act, avg(y) AS m FROM d GROUP BY ALL)
SELECT d.grp, round(avg(coalesce(c.m, 0) + CASE WHEN d.act = ch THEN (y - a.m) / pr ELSE 0 END), 6) AS dr, count(*) AS n FROM d LEFT JOIN m c ON c.grp = d.grp AND c.act = ch LEFT JOIN m a ON a.grp = d.grp AND a.act = d.act GROUP BY 1""")
def m17_doubly_robust(spark, sf):
    pick = lambda c: F.when(F.col(c) > 0.5, "a").otherwise("b")
    d = V.scores(spark, sf).select("grp", "y", pick("q").alias("act"), pick("p").alias("ch"), (0.2 + 0.6 * F.col("q") / 1.01).alias("pr"))
    return r(M.doubly_robust_value(d, "y", "act", "ch", "pr", "grp"), "dr")


@query(f"""WITH {V.SCORES}, d0 AS (SELECT id, grp, abs(q - y) - abs(p - y) AS g, (sign(p - 0.5) = sign(y - 0.5))::INT - (sign(q - 0.5) = sign(y - 0.5))::INT AS s FROM scores), d AS (SELECT id, 'all' AS scope, g, s FROM d0 UNION ALL SELECT id, grp, g, s FROM d0), b AS (SELECT *, unnest(range(1, 201))::INT AS draw FROM d), u AS (SELECT *, ('0x' || substr(md5(draw || ':' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b),
w AS (SELECT *, {POISSON} AS w FROM u),
n AS (SELECT scope, draw, sum(w * g) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), ci AS (SELECT scope, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p FROM n GROUP BY 1)
SELECT d.scope, round(avg(g), 6) AS gain, round(avg(s), 6) AS direction_gain, count(*) AS n, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, round(any_value(ci.p), 6)::DOUBLE AS p FROM d JOIN ci USING (scope) GROUP BY 1""")
def l6_paired_interval(spark, sf):
    s = V.scores(spark, sf).withColumn("half", F.lit(0.5))
    return r(M.paired_interval(s, "y", "q", "p", "half", "grp"), "gain", "direction_gain", "low", "high", "p")


SCALE = "sqrt(least(greatest(p * (1 - p), 1e-3), 0.25))"


@query(f"""WITH {V.SCORES}, qt AS (SELECT least(greatest(quantile_cont(abs(y - p) / {SCALE}, 0.9), 0), 4) AS qq FROM scores WHERE id % 2 = 0), c AS (SELECT unnest([1.0, 0.45, 0.4, 0.35, 0.3, 0.25])::DOUBLE AS cap, unnest(range(0, 6)) AS nr),
b AS (SELECT cap, nr, y, least(greatest(p - least(qq * {SCALE}, cap), 0), 1) AS lo, least(greatest(p + least(qq * {SCALE}, cap), 0), 1) AS hi FROM scores, qt, c WHERE id % 2 = 0), k AS (SELECT cap FROM b GROUP BY cap, nr ORDER BY round(avg((y BETWEEN lo AND hi)::INT) - 0.33 * avg(hi - lo), 12) DESC, nr LIMIT 1)
SELECT id, round(least(greatest(p - least(qq * {SCALE}, cap), 0), 1), 6) AS low, round(least(greatest(p + least(qq * {SCALE}, cap), 0), 1), 6) AS high, cap FROM scores, qt, k WHERE id % 2 = 1""")
def m13_capped_intervals(spark, sf):
    s = V.scores(spark, sf)
    return r(M.capped_intervals(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), "y", "p").select("id", "low", "high", "cap"), "low", "high")
