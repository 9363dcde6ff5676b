"""Queries of shock responses, event envelopes and the enriched registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.operators import enrichment as N
from tessella.operators import responses as P
from tessella.plans import views as V
from tessella.plans.dynamics_queries import DYN
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources.tables import Stages

LATEST = 79


def _dyn(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60)
    regime = F.when(F.col("rank_pct") <= 0.33, "low").when(F.col("rank_pct") <= 0.67, "middle").otherwise("high")
    scaled = [(F.col(c) / 1e6).alias(c) for c in ("value", "growth", "accel")]
    return Stages(spark, "responses").cut(d.select("unit", "t", *scaled, (100 * (1 - F.col("rank_pct"))).alias("risk"), regime.alias("regime")), "dynamics")


SHOCKS = f"""{DYN}, dn AS (SELECT unit, t, value / 1e6 AS value, growth / 1e6 AS growth, accel / 1e6 AS accel, 100 * (1 - rank_pct) AS risk, CASE WHEN rank_pct <= 0.33 THEN 'low' WHEN rank_pct <= 0.67 THEN 'middle' ELSE 'high' END AS regime FROM dyn),
yg AS (SELECT t, avg(growth) AS mean_growth, avg(accel) AS mean_accel FROM dn GROUP BY 1 HAVING avg(growth) IS NOT NULL), ys AS (SELECT *, (avg(mean_growth) OVER () - mean_growth) / stddev_pop(mean_growth) OVER () AS strength FROM yg),
may AS (SELECT t, row_number() OVER (ORDER BY round(mean_growth, 9), t) AS k FROM ys WHERE t > (SELECT min(t) FROM ys) AND t < {LATEST}),
pick AS (SELECT 0 AS k, []::INT[] AS chosen UNION ALL SELECT p.k + 1, CASE WHEN len(chosen) < 3 AND len(list_filter(chosen, lambda y: abs(y - t) < 2)) = 0 THEN list_append(chosen, t) ELSE chosen END FROM pick p JOIN may ON may.k = p.k + 1),
shocks AS (SELECT unnest(chosen) AS shock_t FROM (SELECT chosen FROM pick ORDER BY k DESC LIMIT 1))"""


@query(f"WITH RECURSIVE {SHOCKS} SELECT shock_t, round(strength, 6) AS strength, round(mean_growth, 6) AS mean_growth, round(mean_accel, 6) AS mean_accel FROM shocks JOIN ys ON t = shock_t")
def j10_shock_periods(spark, sf):
    return r(P.shock_periods(_dyn(spark, sf), LATEST), "strength", "mean_growth", "mean_accel")


@query(f"""WITH RECURSIVE {SHOCKS}, b AS (SELECT shock_t, unit, value AS v0, risk AS r0 FROM dn JOIN shocks ON t = shock_t - 1), c AS (SELECT shock_t, quantile_cont(r0, 0.7) AS hi, quantile_cont(r0, 0.3) AS lo FROM b GROUP BY 1 HAVING count(*) >= 10),
grp_ AS (SELECT b.shock_t, unit, v0, CASE WHEN r0 >= hi THEN 'high_risk' WHEN r0 <= lo THEN 'low_risk' ELSE 'mid_risk' END AS vulnerability FROM b JOIN c USING (shock_t)),
m AS (SELECT shock_t, (t - shock_t)::INT AS event_t, regime, vulnerability, value - v0 AS rel, growth FROM grp_ JOIN dn USING (unit) WHERE t BETWEEN shock_t - 2 AND shock_t + 2)
SELECT shock_t, event_t, regime, vulnerability, count(*) AS rows, round(avg(rel), 6) AS rel_change, round(avg(growth), 6) AS growth FROM m GROUP BY GROUPING SETS ((shock_t, event_t, regime), (shock_t, event_t, vulnerability)) HAVING vulnerability IS NULL OR vulnerability <> 'mid_risk'""")
def j10_shock_response(spark, sf):
    d = _dyn(spark, sf)
    return r(P.shock_response(d, P.shock_periods(d, LATEST), least=10), "rel_change", "growth")


ENVELOPE = f"""{DYN}, dn AS (SELECT unit, t, growth / 1e6 AS growth, 100 * (1 - rank_pct) AS risk, CASE WHEN rank_pct <= 0.33 THEN 'low' WHEN rank_pct <= 0.67 THEN 'middle' ELSE 'high' END AS state FROM dyn),
v AS (SELECT unit, t, state, growth - avg(growth) OVER (PARTITION BY t) AS g, risk - avg(risk) OVER (PARTITION BY t) AS r FROM dn),
en AS (SELECT unit, t AS at_, state AS event_type, g0, r0 FROM (SELECT *, lag(state) OVER w <> state AND lag(t) OVER w = t - 1 AS new, lag(g) OVER w AS g0, lag(r) OVER w AS r0 FROM v WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE new),
st AS (SELECT event_type, (t - at_)::INT AS event_t, count(*) AS n, avg(g - g0) AS growth, avg(r - r0) AS risk FROM en JOIN v ON v.unit = en.unit AND t BETWEEN at_ - 2 AND at_ + 2 GROUP BY ALL),
sh AS (SELECT *, lead(risk) OVER (PARTITION BY event_type ORDER BY event_t) - risk AS shift FROM st),
z AS (SELECT event_type, event_t, n, growth, risk, coalesce((growth - avg(growth) OVER w) / nullif(stddev_pop(growth) OVER w, 0), 0) AS growth_z, coalesce((risk - avg(risk) OVER w) / nullif(stddev_pop(risk) OVER w, 0), 0) AS risk_z,
 coalesce((shift - avg(shift) OVER w) / nullif(stddev_pop(shift) OVER w, 0), 0) AS shift_z, CASE WHEN event_t < 0 THEN 'pre' WHEN event_t = 0 THEN 'impact' ELSE 'post' END AS phase FROM sh WINDOW w AS (PARTITION BY event_type)),
env AS (SELECT *, 0.62 * growth_z - 0.48 * risk_z - 0.22 * shift_z AS signal FROM z)"""
MEASURES = ("growth", "risk", "growth_z", "risk_z", "shift_z", "signal")


def _envelope(spark, sf):
    study = P.entry_responses(_dyn(spark, sf).withColumnRenamed("regime", "state"), "growth", "risk")
    return P.event_envelope(study)


@query(f"WITH {ENVELOPE} SELECT event_type, event_t, n, phase, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES)} FROM env")
def j14_event_envelope(spark, sf):
    return r(_envelope(spark, sf), *MEASURES)


@query(f"""WITH {ENVELOPE}, s AS (SELECT event_type, count(*) AS rows, sum(n)::BIGINT AS n, avg(signal) FILTER (phase = 'pre') AS pre_signal, avg(signal) FILTER (phase = 'impact') AS impact_signal, avg(signal) FILTER (phase = 'post') AS post_signal,
 avg(growth) FILTER (phase = 'impact') AS growth_impact, avg(risk) FILTER (phase = 'impact') AS risk_impact, avg(risk) FILTER (phase = 'pre') - avg(risk) FILTER (phase = 'post') AS relief FROM env GROUP BY 1),
q AS (SELECT *, 0.38 * coalesce(pre_signal, 0) + 0.34 * coalesce(post_signal, 0) + 0.2 * coalesce(relief, 0) - 0.08 * coalesce(risk_impact, 0) AS raw FROM s)
SELECT event_type, rows, n, round(pre_signal, 6) AS pre_signal, round(impact_signal, 6) AS impact_signal, round(post_signal, 6) AS post_signal, round(growth_impact, 6) AS growth_impact, round(risk_impact, 6) AS risk_impact, round(relief, 6) AS relief,
 round(100 * coalesce((raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0), 0.5), 4) AS absorption FROM q""")
def j14_envelope_summary(spark, sf):
    s = P.envelope_summary(_envelope(spark, sf))
    return r(r(s, "pre_signal", "impact_signal", "post_signal", "growth_impact", "risk_impact", "relief"), "absorption", digits=4)


TRACKS = [
    N.Track("external_direct", "A", ("wb_project", "wb_project_regional"), "https://projects.example.org/P/", each=True, assignment="explicit"),
    N.Track("objective_indicator", "B", ("wb_indicator_event",), "https://data.example.org/indicator"),
    N.Track("objective_macro", "B", ("objective_macro_rule",), "https://data.example.org/macro"),
    N.Track("ai_inferred", "C", ("ai_inferred",), objective=False),
]


def _registry(spark, sf):
    """Orders as events of the customers' nations; their references are packed lists of customer and order, indicators, rules, or nothing known."""
    o, c, n = (V.table(spark, sf, x) for x in ("orders", "customer", "nation"))
    j = o.filter("o_totalprice > 250000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    part, who, year = F.col("o_orderkey") % 7, F.col("o_custkey"), F.year("o_orderdate")
    ref = F.when(part == 0, F.concat(F.lit("wb_project:C"), who, F.lit("|| O"), F.col("o_orderkey"))).when(part == 1, F.concat(F.lit(" wb_project_regional:C"), who, F.lit("|C"), who + 1))
    ref = ref.when(part == 2, F.lit("wb_indicator_event:structural_break@2000")).when(part == 3, F.lit("objective_macro_rule:x;score=1")).when(part == 4, F.lit("ai_inferred:y")).when(part == 5, F.lit("plain note"))
    end = F.when(part != 3, (year + part - 1).cast("string"))
    amount = F.when(part != 6, F.col("o_totalprice") / 400000.0)
    return j.select(F.concat(F.lit(" "), F.lower("n_name")).alias("cl"), year.alias("start_t"), end.alias("end_t"), amount.alias("intensity"), F.concat(F.col("o_orderpriority"), F.lit(" ")).alias("name"), ref.alias("ref"))


PARTS = "list_filter(list_transform(string_split(CASE WHEN contains(ref, ':') THEN substr(ref, instr(ref, ':') + 1) ELSE ref END, '|'), lambda z: trim(z)), lambda z: z <> '')"
ENRICHED = f"""reg AS (SELECT upper(trim(n_name)) AS cl, year(o_orderdate)::INT AS start_t, CASE WHEN k <> 3 THEN (year(o_orderdate) + k - 1)::INT END AS e, CASE WHEN k <> 6 THEN o_totalprice / 400000.0 END AS intensity, trim(o_orderpriority) AS name,
 trim(CASE k WHEN 0 THEN 'wb_project:C' || o_custkey || '|| O' || o_orderkey WHEN 1 THEN ' wb_project_regional:C' || o_custkey || '|C' || (o_custkey + 1) WHEN 2 THEN 'wb_indicator_event:structural_break@2000' WHEN 3 THEN 'objective_macro_rule:x;score=1' WHEN 4 THEN 'ai_inferred:y' WHEN 5 THEN 'plain note' END) AS ref
 FROM (SELECT *, o_orderkey % 7 AS k FROM orders WHERE o_totalprice > 250000) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ok AS (SELECT cl, start_t, coalesce(e, start_t) AS end_t, intensity, name, ref FROM reg WHERE ref IS NOT NULL),
d AS (SELECT cl, start_t, name, ref, count(*) AS copies, max(intensity) AS intensity, arg_max(end_t, (coalesce(intensity, -1), end_t)) AS end_t FROM ok GROUP BY ALL),
t AS (SELECT row_number() OVER (ORDER BY cl, start_t, name, ref) AS event, *, CASE WHEN ref LIKE 'wb_project:%' OR ref LIKE 'wb_project_regional:%' THEN 'external_direct' WHEN ref LIKE 'wb_indicator_event:%' THEN 'objective_indicator' WHEN ref LIKE 'objective_macro_rule:%' THEN 'objective_macro' WHEN ref LIKE 'ai_inferred:%' THEN 'ai_inferred' ELSE 'unknown' END AS track FROM d),
enr AS (SELECT *, CASE track WHEN 'external_direct' THEN 'A' WHEN 'objective_indicator' THEN 'B' WHEN 'objective_macro' THEN 'B' ELSE 'C' END AS grade, (track IN ('external_direct', 'objective_indicator', 'objective_macro'))::INT AS objective, CASE WHEN track = 'external_direct' THEN 'explicit' ELSE 'rule_based' END AS assignment,
 CASE WHEN track = 'external_direct' THEN {PARTS} ELSE [] END AS refs, CASE track WHEN 'external_direct' THEN list_transform({PARTS}, lambda z: 'https://projects.example.org/P/' || z) WHEN 'objective_indicator' THEN ['https://data.example.org/indicator'] WHEN 'objective_macro' THEN ['https://data.example.org/macro'] ELSE [] END AS links,
 CASE track WHEN 'external_direct' THEN 'projects.example.org' WHEN 'objective_indicator' THEN 'data.example.org' WHEN 'objective_macro' THEN 'data.example.org' ELSE '' END AS host FROM t)"""


def _enriched(spark, sf):
    return Stages(spark, "registry").cut(N.enrich(_registry(spark, sf), TRACKS), "events")


@query(f"WITH {ENRICHED} SELECT event, cl, start_t, end_t, name, ref, round(intensity, 9) AS intensity, copies, track, grade, objective, assignment, array_to_string(refs, ' ') AS refs, array_to_string(links, ' ') AS links, host FROM enr")
def f22_enriched_registry(spark, sf):
    e = _enriched(spark, sf)
    return r(e.select(*[F.array_join(c, " ").alias(c) if c in ("refs", "links") else F.col(c) for c in e.columns]), "intensity", digits=9)  # cents over 4e7: exact at nine digits, halves at six


@query(f"WITH {ENRICHED}, l AS (SELECT event, track, unnest(range(1, len(links) + 1))::INT AS rank, links FROM enr) SELECT event, rank, links[rank] AS url, regexp_extract(links[rank], '^[a-z]+://([^/?#]+)', 1) AS host, track FROM l")
def f22_source_links(spark, sf):
    return N.source_links(_enriched(spark, sf))


@query(f"WITH {ENRICHED}, x AS (SELECT event, cl, start_t, unnest(refs) AS ref FROM enr) SELECT ref, count(DISTINCT event) AS events, count(DISTINCT cl) AS clusters, min(start_t) AS first, max(start_t) AS last FROM x GROUP BY 1 HAVING count(DISTINCT event) > 1")
def f22_shared_references(spark, sf):
    return N.shared_references(_enriched(spark, sf))


@query(f"""WITH {ENRICHED}, o AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT cl)::DOUBLE AS clusters, min(start_t)::DOUBLE AS first_start, max(start_t)::DOUBLE AS last_start, sum(copies - 1)::DOUBLE AS repeats_removed, count(*) FILTER (intensity IS NULL)::DOUBLE AS without_intensity,
 count(*) FILTER (end_t < start_t)::DOUBLE AS ends_before_start, count(*) FILTER (intensity NOT BETWEEN 0 AND 1)::DOUBLE AS intensity_outside, avg((len(links) > 0)::INT) AS linked_share FROM enr),
u AS (UNPIVOT o ON COLUMNS(*) INTO NAME measure VALUE value),
c AS (SELECT s.m AS measure, s.i AS item, count(*)::DOUBLE AS value FROM (SELECT unnest([{{'m': 'track', 'i': track}}, {{'m': 'grade', 'i': grade}}, {{'m': 'assignment', 'i': assignment}}, {{'m': 'host', 'i': host}}, {{'m': 'name', 'i': name}}]) AS s FROM enr) WHERE s.i <> '' GROUP BY ALL)
SELECT measure, '' AS item, round(value, 6) AS value FROM u UNION ALL (SELECT measure, item, value FROM c QUALIFY measure IN ('track', 'grade', 'assignment') OR row_number() OVER (PARTITION BY measure ORDER BY value DESC, item) <= CASE measure WHEN 'host' THEN 10 ELSE 15 END)""")
def f22_quality_report(spark, sf):
    return r(N.quality_report(_enriched(spark, sf)), "value")
