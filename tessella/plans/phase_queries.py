"""Queries of the phase portrait: the rank (risk) and the unit's own score of nations by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.operators import phase as P
from tessella.plans import views as V
from tessella.plans.dynamics_queries import DYN
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources.tables import Stages


def _scores(spark, sf):
    d = D.dynamics_table(V.panel_nm(spark, sf), 60)
    return Stages(spark, "phase").cut(d.select("unit", "t", (100 * F.col("rank_pct")).alias("risk"), (50 + 10 * F.col("z_unit")).alias("accel")), "scores")


def _edges(c: str) -> str:
    """Quantiles; equal ones are moved up by a thousandth each (8 bins: as often as it takes)."""
    raw = ", ".join(f"quantile_cont({c}, {i / 8}) AS q{i}" for i in range(9))
    steps, last = [], "q0"
    for i in range(1, 9):
        steps.append(f"CASE WHEN q{i} <= {last} THEN {last} + 1e-3 ELSE q{i} END")
        last = f"e{i}"
    named = f"SELECT q0 AS e0, {steps[0]} AS e1, * FROM (SELECT {raw} FROM valid)"
    for i in range(2, 9):
        named = f"SELECT {steps[i - 1]} AS e{i}, * FROM ({named})"
    return f"SELECT [{', '.join(f'e{i}' for i in range(9))}] AS e FROM ({named})"


def _slope(v: str, centre: str, line: str, along: str) -> str:
    w = f"(PARTITION BY {line} ORDER BY {along})"
    low, high = f"coalesce(lag({v}) OVER {w}, {v})", f"coalesce(lead({v}) OVER {w}, {v})"
    return f"({high} - {low}) / nullif(coalesce(lead({centre}) OVER {w}, {centre}) - coalesce(lag({centre}) OVER {w}, {centre}), 0)"


PHASE = f"""{DYN}, sc AS (SELECT unit, t, 100 * rank_pct AS x, 50 + 10 * z_unit AS y FROM dyn),
v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM sc WINDOW w AS (PARTITION BY unit ORDER BY t)),
a AS (SELECT *, vx - lag(vx) OVER w AS ax, vy - lag(vy) OVER w AS ay, sqrt(coalesce(vx, 0) ** 2 + coalesce(vy, 0) ** 2) AS speed FROM v WINDOW w AS (PARTITION BY unit ORDER BY t)),
moved AS (SELECT *, least(greatest((coalesce(vx, 0) * coalesce(ay, 0) - coalesce(vy, 0) * coalesce(ax, 0)) / (speed ** 3 + 1e-6), -3), 3) AS curvature FROM a),
valid AS (SELECT * FROM moved WHERE x IS NOT NULL AND y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL), ex AS ({_edges("x")}), ey AS ({_edges("y")}),
b AS (SELECT valid.*, list_position(list_transform(ex.e[2:], lambda z: z >= x), true) - 1 AS xb, list_position(list_transform(ey.e[2:], lambda z: z >= y), true) - 1 AS yb FROM valid, ex, ey),
c AS (SELECT xb, yb, avg(x) AS cx, avg(y) AS cy, avg(vx) AS mx, avg(vy) AS my, avg(speed) AS sp, avg(curvature) AS cu, count(*) AS n FROM b WHERE xb >= 0 AND yb >= 0 GROUP BY ALL),
o AS (SELECT *, avg(cx) OVER (PARTITION BY xb) AS x0, avg(cy) OVER (PARTITION BY yb) AS y0 FROM c),
f AS (SELECT *, {_slope("mx", "x0", "yb", "xb")} + {_slope("my", "y0", "xb", "yb")} AS dv, {_slope("my", "x0", "yb", "xb")} - {_slope("mx", "y0", "xb", "yb")} AS vo FROM o),
q AS (SELECT greatest(quantile_cont(abs(dv), 0.6), 0.012) AS qd, greatest(quantile_cont(abs(vo), 0.7), 0.012) AS qv, greatest(quantile_cont(sp, 0.55), 1.6) AS qs FROM f),
cells AS (SELECT f.*, CASE WHEN dv >= qd AND sp >= qs THEN 'centrifugal_fragility' WHEN dv <= -qd AND sp >= qs THEN 'centripetal_recovery' WHEN abs(vo) >= qv AND sp >= 0.8 * qs THEN 'rotational_transition'
 WHEN sp <= 0.55 * qs THEN 'stable_anchor' ELSE 'directional_drift' END AS label FROM f, q),
portrait AS (SELECT m.unit, m.t, m.vx, m.vy, m.speed, m.curvature, dv AS divergence, vo AS vorticity, coalesce(label, 'insufficient_history') AS label,
 m.speed + 6 * greatest(coalesce(dv, 0), 0) + 4 * abs(coalesce(vo, 0)) + 2 * abs(m.curvature) AS instability
 FROM moved m LEFT JOIN b ON m.unit = b.unit AND m.t = b.t LEFT JOIN cells ON b.xb = cells.xb AND b.yb = cells.yb)"""
NAMES = ("vx", "vy", "speed", "curvature", "divergence", "vorticity", "instability")


@query(f"WITH {PHASE} SELECT unit, t, label, {', '.join(f'round({c}, 5) AS {c}' for c in NAMES)} FROM portrait")
def h7_phase_portrait(spark, sf):
    return r(P.phase_portrait(_scores(spark, sf), "risk", "accel"), *NAMES, digits=5)


@query(f"WITH {PHASE} SELECT xb::INT AS xb, yb::INT AS yb, round(cx, 5) AS cx, round(cy, 5) AS cy, round(mx, 5) AS vx, round(my, 5) AS vy, round(sp, 5) AS speed, round(cu, 5) AS curvature, n AS rows, round(dv, 5) AS divergence, round(vo, 5) AS vorticity, label FROM cells")
def h7_phase_field(spark, sf):
    cells = P.field(P.binned(P.motion(_scores(spark, sf), "risk", "accel")))
    return r(cells, "cx", "cy", *NAMES[:-1], digits=5)


@query(f"WITH {PHASE}, l AS (SELECT * FROM portrait WHERE t = (SELECT max(t) FROM portrait)) SELECT label, count(*) AS units, round(count(*) / (SELECT count(*) FROM l), 6) AS share, round(avg(instability), 5) AS instability FROM l GROUP BY 1")
def h7_phase_shares(spark, sf):
    return r(r(P.phase_shares(P.phase_portrait(_scores(spark, sf), "risk", "accel")), "share"), "instability", digits=5)
