"""Queries of the monitoring and text operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import monitoring as N
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r

GOOD, BAD = ["the", "of", "and", "la"], ["in", "to", "die", "de"]
_list = lambda ws: ", ".join(f"'{w}'" for w in ws)
POSTS = f"""w AS (SELECT conv_id, turn, role, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') AS w FROM conversations), h AS (SELECT conv_id, turn, role, len(list_filter(w, lambda x: x IN ({_list(GOOD)}))) AS g, len(list_filter(w, lambda x: x IN ({_list(BAD)}))) AS b FROM w),
posts AS (SELECT conv_id % 20 AS unit, turn AS t, role AS platform, conv_id, CASE WHEN g + b > 0 THEN (g - b) / (g + b) ELSE 0 END AS score FROM h)"""


def _posts(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") % 20).alias("unit"), F.col("turn").alias("t"), F.col("role").alias("platform"), "conv_id", N.lexicon_score(F.col("text"), GOOD, BAD).alias("score"))


@query(f"WITH {POSTS} SELECT conv_id, t AS turn, round(score, 6) AS score FROM posts")
def o1_lexicon_score(spark, sf):
    return r(_posts(spark, sf).select("conv_id", F.col("t").alias("turn"), "score"), "score")


@query("SELECT event_id, round(least(greatest(CASE WHEN abs(value) > 1 THEN value / 100 ELSE value END, -1), 1), 6) AS tone FROM events")
def o2_rescale_tone(spark, sf):
    return r(V.table(spark, sf, "events").select("event_id", N.rescale_tone(F.col("value")).alias("tone")), "tone")


@query(f"""WITH {POSTS} SELECT unit, t, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(avg((score > 0.15)::INT), 6) AS positive, round(avg((score < -0.15)::INT), 6) AS negative, count(*) AS volume, count(DISTINCT platform) AS platforms, round(ln(1 + count(*)), 6) AS buzz FROM posts GROUP BY ALL""")
def o3_sentiment_panel(spark, sf):
    return r(N.sentiment_panel(_posts(spark, sf)), "mean", "sd", "positive", "negative", "buzz")


MON = f"""{V.PANEL_NM}, g AS (SELECT unit, grp, t, ln(1 + value) AS x, ln(1 + value) - lag(ln(1 + value)) OVER (PARTITION BY unit ORDER BY t) AS d, row_number() OVER (PARTITION BY unit ORDER BY t DESC) AS back FROM panel),
u AS (SELECT unit, grp, max(t) AS t, max(CASE WHEN back = 1 THEN x END) AS level, regr_slope(CASE WHEN back <= 6 THEN x END, t) AS slope, stddev_samp(CASE WHEN back <= 6 THEN d END) AS vol, max(CASE WHEN back = 1 THEN d END) AS last, avg(CASE WHEN back > 1 THEN d END) AS m, stddev_samp(CASE WHEN back > 1 THEN d END) AS s FROM g GROUP BY ALL),
r1 AS (SELECT unit, grp, t, level + slope AS nowcast, 1 / (1 + exp(8 * slope - vol)) AS risk, (last - m) / s AS shock_z FROM u),
mon AS (SELECT *, CASE WHEN risk >= 0.75 THEN 'red' WHEN risk >= 0.6 THEN 'orange' WHEN risk >= 0.5 THEN 'yellow' ELSE 'green' END AS alert, CASE WHEN shock_z <= -1 THEN 'sudden_drop' WHEN shock_z >= 1 THEN 'sudden_rise' ELSE 'none' END AS sentinel, row_number() OVER (ORDER BY round(risk, 9) DESC, unit)::INT AS rank FROM r1)"""


@query(f"WITH {MON} SELECT unit, grp, t, round(nowcast, 6) AS nowcast, round(risk, 6) AS risk, round(shock_z, 6) AS shock_z, alert, sentinel, rank FROM mon")
def p1_unit_monitor(spark, sf):
    return r(N.unit_monitor(V.panel_nm(spark, sf)), "nowcast", "risk", "shock_z")


@query(f"""WITH {MON}, gr AS (SELECT grp, count(*) AS units, sum((alert IN ('red', 'orange'))::INT)::BIGINT AS alerts, avg(risk) AS m, min_by(unit, rank) AS top_unit FROM mon GROUP BY 1) SELECT grp, units, alerts, round(m, 6) AS mean_risk, top_unit, round(alerts / units, 6) AS share, row_number() OVER (ORDER BY round(m, 9) DESC, grp)::INT AS rank FROM gr""")
def p2_group_rollup(spark, sf):
    return r(N.group_rollup(N.unit_monitor(V.panel_nm(spark, sf))), "mean_risk", "share")


@query(f"WITH {MON} SELECT unit, alert, round(risk, 6) AS risk, rank FROM mon WHERE alert <> 'green' ORDER BY rank LIMIT 10")
def p4_top_alerts(spark, sf):
    return r(N.top_alerts(N.unit_monitor(V.panel_nm(spark, sf)), 10).select("unit", "alert", "risk", "rank"), "risk")


MON_SY = MON.replace(V.PANEL_NM, f"{V.PANEL_SY.replace('panel AS', 'sy AS', 1)}, panel AS (SELECT unit, cl AS grp, t, value FROM sy)")


@query(f"""WITH {MON_SY}, gr AS (SELECT grp, count(*) AS units, avg(risk) AS m FROM mon GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY round(m, 9) DESC, grp) AS rank FROM gr)
SELECT n_regionkey AS region, count(*) AS groups, sum(units)::BIGINT AS units, round(avg(m), 6) AS mean_risk, round(avg((m >= 0.6)::INT), 6) AS high_share, round(avg((m >= 0.5 AND m < 0.6)::INT), 6) AS warning_share, min_by(grp, rank) AS top_group FROM rk JOIN nation ON n_nationkey = grp GROUP BY 1""")
def p3_parent_rollup(spark, sf):
    p = V.panel_sy(spark, sf).select("unit", F.col("cl").alias("grp"), "t", "value")
    groups = N.group_rollup(N.unit_monitor(p)).join(V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_regionkey").alias("region")), "grp")
    return r(N.rollup_of_groups(groups, "region"), "mean_risk", "high_share", "warning_share")


@query(f"""WITH {POSTS}, c AS (SELECT unit, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE t END AS t, score, CASE WHEN platform = 'user' THEN NULL ELSE platform END AS source, conv_id FROM posts WHERE unit < 15)
SELECT unit, t::INT AS t, round(score, 6) AS score, coalesce(source, 'missing') AS source FROM c WHERE t BETWEEN 1 AND 6 QUALIFY row_number() OVER (PARTITION BY unit, t ORDER BY conv_id DESC) = 1""")
def o4_standard_cache(spark, sf):
    posts = _posts(spark, sf)
    t = F.when(F.col("conv_id") % 9 == 0, "n/a").otherwise(F.col("t").cast("string"))
    cached = posts.select("unit", t.alias("t"), F.col("score").cast("string").alias("score"), F.when(F.col("platform") != "user", F.col("platform")).alias("source"), "conv_id")
    return r(N.standard_cache(cached, posts.select("unit").filter("unit < 15"), 1, 6, "conv_id"), "score")


STATE = f"""{V.PANEL_SY}, sc AS (SELECT unit, t, 100 * value / max(value) OVER (PARTITION BY t) AS score FROM panel), d0 AS (SELECT *, score - lag(score) OVER (PARTITION BY unit ORDER BY t) AS d, row_number() OVER (PARTITION BY unit ORDER BY t DESC) AS back FROM sc),
d1 AS (SELECT *, CASE WHEN back > 1 OR count(d) OVER (PARTITION BY unit) < 2 THEN d END AS e FROM d0), d2 AS (SELECT *, coalesce(avg(e) OVER (PARTITION BY unit), 0) AS m, coalesce(stddev_pop(e) OVER (PARTITION BY unit), 0) AS s0 FROM d1),
d3 AS (SELECT *, CASE WHEN s0 < 1e-6 THEN greatest(0.5, coalesce(stddev_pop(d) OVER (PARTITION BY unit), 0.5)) ELSE s0 END AS sd FROM d2), d4 AS (SELECT *, coalesce((d - m) / greatest(sd, 0.6), 0) AS c, CASE WHEN d IS NULL THEN 0 ELSE 0.2 END AS k FROM d3),
d5 AS (SELECT *, sum(c - k) OVER (PARTITION BY unit ORDER BY t) AS up, sum(-c - k) OVER (PARTITION BY unit ORDER BY t) AS down FROM d4),
g AS (SELECT unit, max(t) AS t, max(CASE WHEN back = 1 THEN score END) AS level, max(CASE WHEN back = 2 THEN score END) AS pv, coalesce(regr_slope(CASE WHEN back <= 3 THEN score END, t), 0) AS slope, coalesce(stddev_pop(CASE WHEN back < 3 THEN d END), 0) AS vol,
 coalesce((max(CASE WHEN back = 1 THEN d END) - max(CASE WHEN back = 1 THEN m END)) / max(CASE WHEN back = 1 THEN sd END), 0) AS shock_z, greatest(max(CASE WHEN back = 1 THEN up END) - least(0, min(up)), max(CASE WHEN back = 1 THEN down END) - least(0, min(down))) AS c FROM d5 GROUP BY unit),
state AS (SELECT unit, t, level, coalesce(pv, level) AS prev, slope, vol, shock_z, 1 - exp(-c / 3) AS cp FROM g)"""


def _state(spark, sf):
    p = V.panel_sy(spark, sf)
    return N.trend_state(p.select("unit", "t", (100 * F.col("value") / F.max("value").over(Window.partitionBy("t"))).alias("score")))


@query(f"WITH {STATE} SELECT unit, t, round(level, 6) AS level, round(prev, 6) AS prev, round(slope, 6) AS slope, round(vol, 6) AS volatility, round(shock_z, 6) AS shock_z, round(cp, 6) AS changepoint FROM state")
def p1_trend_state(spark, sf):
    return r(_state(spark, sf), "level", "prev", "slope", "volatility", "shock_z", "changepoint")


@query(f"""WITH {STATE}, pts AS (SELECT *, least(greatest(50 + 2 * slope, 0), 100) AS accel, slope AS accel_shift, least(greatest(55 - (level - prev), 0), 100) AS risk, -slope AS risk_shift, vol / 4 AS width, CASE WHEN unit % 4 > 0 THEN (unit % 5) / 4.0 END AS verified FROM state),
n AS (SELECT *, least(greatest(level + slope * 0.25, 0), 100) AS nowcast, least(greatest(accel + 0.35 * accel_shift, 0), 100) AS na, least(greatest(risk + 0.8 * risk_shift * 0.25, 0), 100) AS nr, least(greatest(3.2 * width + 1.6 * vol, 0), 100) AS unc, least(greatest(coalesce(verified * 100, 65), 0), 100) AS q, level - prev AS drift FROM pts),
k AS (SELECT *, CASE WHEN nr >= 85 AND na <= 45 THEN 'critical_stall' WHEN nr >= 70 THEN 'stall_warning' WHEN na >= 70 AND nr <= 40 THEN 'acceleration_opportunity' WHEN q < 75 THEN 'data_watch' ELSE 'stable_watch' END AS alert,
 CASE WHEN shock_z <= -2 AND nr >= 70 THEN 'downshift_break' WHEN shock_z >= 2 AND na >= 70 AND nr <= 70 THEN 'upshift_break' WHEN cp >= 0.72 AND nr >= 70 THEN 'fragile_transition' WHEN abs(shock_z) >= 2 THEN 'volatility_jump' WHEN drift <= -2 AND nr >= 60 THEN 'slowdown_watch' WHEN cp >= 0.57 THEN 'transition_watch' ELSE 'steady_transition' END AS sentinel,
 least(greatest(nr - 0.55 * na + 0.25 * unc + 0.18 * (100 - q), 0), 200) AS a, least(greatest(0.36 * nr + 0.24 * least(greatest(-drift * 8, 0), 100) + 0.18 * least(greatest(cp * 100, 0), 100) + 0.12 * least(greatest(abs(shock_z) * 25, 0), 100) + 0.06 * unc + 0.04 * least(greatest(100 - q, 0), 100), 0), 200) AS s FROM n)
SELECT unit, round(nowcast, 6) AS nowcast, round(na, 6) AS now_accel, round(nr, 6) AS now_risk, round(unc, 6) AS uncertainty, round(q, 6) AS quality, alert, sentinel, round(a, 6) AS alert_score, round(s, 6) AS sentinel_score,
 row_number() OVER (ORDER BY list_position(['critical_stall', 'stall_warning', 'data_watch', 'acceleration_opportunity', 'stable_watch'], alert), round(a, 9) DESC, unit) AS alert_rank, row_number() OVER (ORDER BY list_position(['downshift_break', 'fragile_transition', 'volatility_jump', 'slowdown_watch', 'transition_watch', 'upshift_break', 'steady_transition'], sentinel), round(s, 9) DESC, unit) AS sentinel_rank FROM k""")
def p1_unit_watch(spark, sf):
    s, slope = _state(spark, sf), F.col("slope")
    hundred = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    points = s.select("*", hundred(50 + 2 * slope).alias("accel"), slope.alias("accel_shift"), hundred(55 - (F.col("level") - F.col("prev"))).alias("risk"), (-slope).alias("risk_shift"), (F.col("volatility") / 4).alias("width"), F.when(F.col("unit") % 4 > 0, (F.col("unit") % 5) / 4.0).alias("verified"))
    kept = ["unit", "nowcast", "now_accel", "now_risk", "uncertainty", "quality", "alert", "sentinel", "alert_score", "sentinel_score", "alert_rank", "sentinel_rank"]
    return r(N.unit_watch(points).select(*kept), "nowcast", "now_accel", "now_risk", "uncertainty", "quality", "alert_score", "sentinel_score")
