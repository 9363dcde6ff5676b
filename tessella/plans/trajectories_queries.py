"""Queries of the trajectory, diffusion and phase operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import diffusion as D
from tessella.operators import sequences as Q
from tessella.operators import trajectories as T
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources.tables import Stages


def _suppliers(spark, sf):
    """Panel, sequences and fitted regimes of suppliers by year, their mean discount as risk."""
    work = Stages(spark, "regimes")
    panel = work.cut(V.panel_sy(spark, sf).select("unit", "t", "value", F.col("disc").alias("risk")), "panel")
    seqs = work.cut(T.sequences(panel), "sequences")
    return panel, seqs, T.fit_regimes(seqs)


@query()
def i10_trajectory_regimes(spark, sf):
    """Medoids of warped distances; tested against plain Python."""
    panel, seqs, fit = _suppliers(spark, sf)
    found = Stages(spark, "assigned").cut(T.assign_regimes(seqs, fit), "units")
    return r(found.join(T.regime_names(found, panel, "risk").drop("units"), "cluster"), "distance", "silhouette")


@query()
def i10_user_regimes(spark, sf):
    """Users' daily values, a month long; tested with the above."""
    seqs = Stages(spark, "user_regimes").cut(T.sequences(V.panel_ud(spark, sf)), "sequences")
    return r(T.assign_regimes(seqs, T.fit_regimes(seqs)), "distance", "silhouette")


def _by_period(spark, sf):
    panel, seqs, fit = _suppliers(spark, sf)
    work = Stages(spark, "by_period")
    names = T.regime_names(work.cut(T.assign_regimes(seqs, fit), "units"), panel, "risk").select("cluster", "regime")
    by = work.cut(T.prefix_regimes(seqs, fit, T.periods_of(panel)), "prefixes")
    return by.join(names, "cluster", "left").select("unit", "t", "cluster", F.coalesce("regime", F.lit("mixed_transition")).alias("regime"))


@query()
def i9_regime_by_period(spark, sf):
    """Tested: the last period's groups are those of i10."""
    return _by_period(spark, sf)


@query()
def i9_regime_share(spark, sf):
    return r(T.regime_share(_by_period(spark, sf)), "share")


@query()
def i9_regime_transitions(spark, sf):
    """Chances of going from one period's regime to the next one's."""
    return r(Q.transition_matrix(_by_period(spark, sf).select("unit", "t", F.col("regime").alias("state"))), "share")


def _round(i: int) -> str:
    return f"""p{i} AS MATERIALIZED (SELECT id, any_value(seed) AS seed, least(greatest(0.35 * any_value(seed) + 0.65 * sum(w * q), 0), 1) AS p
 FROM (SELECT a.id, a.seed, w, b.p AS q FROM p{i - 1} a JOIN e USING (id) JOIN p{i - 1} b ON e.other = b.id) GROUP BY id)"""


FEATURES = ("value", "qty", "disc", "n")
SCORED = ", ".join(f"({c} - (SELECT avg({c}) FROM d)) / (SELECT stddev_pop({c}) FROM d) AS x{i}" for i, c in enumerate(FEATURES))
FAR = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(5))


@query(f"""WITH {V.PANEL_SY}, d AS (SELECT unit * 10000 + t AS id, value, qty::DOUBLE AS qty, disc, n::DOUBLE AS n, t, n / (n + 100.0) AS seed, least(disc * 10, 1) AS other FROM panel),
s AS MATERIALIZED (SELECT id, {SCORED}, 0.45 * (t - (SELECT avg(t) FROM d)) / (SELECT stddev_pop(t) FROM d) AS x4 FROM d),
k AS MATERIALIZED (SELECT a.id, b.id AS other, sqrt({FAR}) AS far FROM s a JOIN s b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY far, b.id) <= 14),
g AS (SELECT median(far) AS sigma FROM k WHERE far > 0), w AS (SELECT id, other, exp(-far * far / (2 * sigma * sigma)) AS w FROM k, g),
e AS MATERIALIZED (SELECT id, other, w / sum(w) OVER (PARTITION BY id) AS w FROM w), p0 AS (SELECT id, seed, 0.7 * seed + 0.3 * other AS p FROM d),
{", ".join(_round(i) for i in range(1, 11))} SELECT id, round(seed, 6) AS seed, round(p, 6) AS p FROM p10""")
def m15_graph_diffusion(spark, sf):
    work = Stages(spark, "diffusion")
    p = V.panel_sy(spark, sf).withColumn("id", F.col("unit") * 10000 + F.col("t"))
    n = F.col("n").cast("double")
    seeds = p.select("id", *FEATURES, "t", (n / (n + 100)).alias("seed"), F.least(F.col("disc") * 10, F.lit(1.0)).alias("other"))
    seeds = work.cut(seeds, "rows")
    points = work.cut(D.standardised(seeds, "id", list(FEATURES), {"t": 0.45}), "points")
    edges = work.cut(D.nearest(points, 14, work), "edges")
    return r(D.diffuse(seeds, D.kernel_weights(edges), work), "seed", "p")
