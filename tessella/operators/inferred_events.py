"""Events for clusters that a registry doesn't cover, inferred from breaks in their indicators."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip, quantiles

#: 50 and 97.5 % points of chi-square with 1 to 8 degrees of freedom; fixed values.
CHI_MEDIAN = (0.454936, 1.386294, 2.365974, 3.356694, 4.351460, 5.348121, 6.345811, 7.344121)
CHI_HIGH = (5.023886, 7.377759, 9.348404, 11.143287, 12.832502, 14.449375, 16.012764, 17.534546)


@dataclass
class Rule:
    """How events are inferred.

    ``signals``: name to (column, use), where use is ``rise``, ``fall`` (the change with its sign turned) or ``level``.
    ``weights``: of the signals' robust scores, and ``size`` of their absolute ones. ``classes``: name to signals' weights; the largest names the event.
    ``intensity``: base, span, least and most of what the scaled score gives.
    """

    signals: dict[str, tuple[str, str]]
    weights: dict[str, float]
    size: dict[str, float] = field(default_factory=dict)
    classes: dict[str, dict[str, float]] = field(default_factory=dict)
    intensity: tuple[float, float, float, float] = (0.25, 0.60, 0.25, 0.90)
    suffix: str = ""
    drivers: int = 3


def signal_scores(panel: DataFrame, rule: Rule) -> DataFrame:
    """cl, t and z_<signal>: means by cluster and period, their changes (0 in the first period), as robust scores in the cluster."""
    own, every = Window.partitionBy("cl").orderBy("t"), Window.partitionBy("cl")  # a cluster's periods
    names = sorted({c for c, _ in rule.signals.values()})
    d = panel.groupBy("cl", "t").agg(*[F.avg(c).alias(c) for c in names])
    change = lambda c: F.coalesce(F.col(c) - F.lag(c).over(own), F.lit(0.0))
    use = {"rise": change, "fall": lambda c: -change(c), "level": F.col}
    d = d.select("cl", "t", *[use[how](c).alias(f"x_{s}") for s, (c, how) in rule.signals.items()])
    d = d.select("*", *[(F.col(f"x_{s}") - F.percentile(f"x_{s}", 0.5).over(every)).alias(f"d_{s}") for s in rule.signals])
    out = []
    for s in rule.signals:
        mad, sd = F.percentile(F.abs(f"d_{s}"), 0.5).over(every), F.stddev_samp(f"x_{s}").over(every)
        z = F.when(mad > 1e-8, F.col(f"d_{s}") / (1.4826 * mad)).when(sd > 1e-8, F.col(f"d_{s}") / sd)
        out.append(F.coalesce(z, F.lit(0.0)).alias(f"z_{s}"))
    return d.select("cl", "t", *out)


def weighted(rule: Rule) -> Column:
    z = [F.lit(w) * F.col(f"z_{s}") for s, w in rule.weights.items()] + [F.lit(w) * F.abs(f"z_{s}") for s, w in rule.size.items()]
    return sum(z, F.lit(0.0))


def scaled(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the column from 0 to 1 over all rows; 0 where all are equal."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    same = low is None or abs(high - low) <= 1e-9 * max(abs(low), abs(high))
    return df.withColumn(name, F.lit(0.0) if same else (F.col(column) - F.lit(low)) / F.lit(high - low))


def inside(scores: DataFrame) -> DataFrame:
    """Without the first two and last two periods, if any are left."""
    low, high = scores.agg(F.min("t"), F.max("t")).first()
    return scores if low is None or low + 2 > high - 2 else scores.filter(F.col("t").between(low + 2, high - 2))


def named(rule: Rule) -> Column:
    """The class of the largest sum; of equal ones the first."""
    sums = {c: sum((F.lit(w) * F.col(f"z_{s}") for s, w in ws.items()), F.lit(0.0)) for c, ws in rule.classes.items()}
    best = F.greatest(*sums.values())
    return F.concat(F.coalesce(*[F.when(x == best, c) for c, x in sums.items()]), F.lit(rule.suffix))


def top_drivers(rule: Rule) -> Column:
    """The signals of largest score with it, joined by bars; of equal ones the first named."""
    parts = F.array(*[F.struct((-F.col(f"z_{s}")).alias("less"), F.lit(i).alias("i"), F.concat(F.lit(f"{s}:"), F.format_string("%.2f", F.col(f"z_{s}"))).alias("text")) for i, s in enumerate(rule.signals)])
    return F.array_join(F.transform(F.slice(F.array_sort(parts), 1, rule.drivers), lambda x: x["text"]), "|")


def rule_events(panel: DataFrame, covered: DataFrame, rule: Rule, target: float) -> DataFrame:
    """cl, start_t, score, intensity, name, drivers: for clusters of ``panel`` not in ``covered`` the period of the highest weighted score, the highest clusters
    first, as many as bring the covered share of clusters to ``target``. None are needed: no rows. Ties: earlier period, smaller cluster.
    """
    clusters = panel.select("cl").distinct()
    has = covered.select("cl").distinct()
    n, known = clusters.agg(F.count("*")).first()[0], clusters.join(has, "cl", "left_semi").count()
    needed = max(0, min(n, int(np.ceil(target * n))) - known)
    if n and known / n >= target:
        needed = 0
    scores = inside(signal_scores(panel, rule)).withColumn("score", weighted(rule)).join(has, "cl", "left_anti")
    best = scores.withColumn("_r", F.row_number().over(Window.partitionBy("cl").orderBy(F.round("score", 9).desc(), "t"))).filter("_r = 1")
    top = best.orderBy(F.round("score", 9).desc(), "cl").limit(needed)
    base, span, least, most = rule.intensity
    out = scaled(top, "score", "s")
    return out.select("cl", F.col("t").alias("start_t"), "score", clip(base + span * F.col("s"), least, most).alias("intensity"), named(rule).alias("name"), top_drivers(rule).alias("drivers"))


def _moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*[F.avg(c) for c in names], *[F.covar_samp(a, b) for a, b in pairs]).first()
    cov = np.zeros((len(names),) * 2)
    for (a, b), v in zip(pairs, row[len(names) :], strict=True):
        cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = v or 0.0
    return np.array([v or 0.0 for v in row[: len(names)]]), cov


def _squared(names: list[str], centre: np.ndarray, cov: np.ndarray) -> Column:
    """The squared distance from the centre in the metric of the covariance (its pseudo-inverse where it is singular)."""
    inverse = np.linalg.pinv(cov)
    off = [F.col(c) - F.lit(float(m)) for c, m in zip(names, centre, strict=True)]
    return sum((F.lit(float(inverse[i, j])) * off[i] * off[j] for i in range(len(names)) for j in range(len(names))), F.lit(0.0))


def robust_distance(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with ``distance``: how far each row is from the bulk in all columns together.

    The half of the rows nearest to the medians, by scores of MAD, gives a first centre and covariance, scaled so that the median squared distance is
    that of normal rows; the rows inside its 97.5 % bound give those that distances are told by. Only medians and k-by-k moments reach the driver.
    Nulls must have been filled; columns with a MAD of 0 don't choose the half.
    """
    k = len(names)
    medians = {c: quantiles(df, c, [0.5])[0] for c in names}
    if None in medians.values():
        return df.withColumn("distance", F.lit(None).cast("double"))
    spread = {c: quantiles(df.select(F.abs(F.col(c) - F.lit(m)).alias("d")), "d", [0.5])[0] for c, m in medians.items()}
    first = sum((F.pow((F.col(c) - F.lit(m)) / F.lit(1.4826 * spread[c]), 2) for c, m in medians.items() if spread[c] > 1e-8), F.lit(0.0))
    d = df.withColumn("_d0", first)
    half = quantiles(d, "_d0", [0.5])[0]
    centre, cov = _moments(d.filter(F.col("_d0") <= F.lit(half)), names)
    d = d.withColumn("_d1", _squared(names, centre, cov))
    factor = quantiles(d, "_d1", [0.5])[0] / CHI_MEDIAN[k - 1]
    centre, cov = _moments(d.filter(F.col("_d1") <= F.lit(CHI_HIGH[k - 1] * factor)), names)
    return d.withColumn("distance", F.sqrt(F.greatest(_squared(names, centre, cov), F.lit(0.0)))).drop("_d0", "_d1")


def anomaly_events(panel: DataFrame, covered: DataFrame, rule: Rule, target: float, impulse: float = 0.62) -> DataFrame:
    """cl, start_t, score, anomaly, intensity, name: as ``rule_events``, for all uncovered clusters, by ``impulse`` of the weighted score and the rest of the
    robust distance of all signals together, each scaled to 0..1 over all rows. No rows where the target is covered already.
    """
    clusters, has = panel.select("cl").distinct(), covered.select("cl").distinct()
    n, known = clusters.count(), clusters.join(has, "cl", "left_semi").count()
    z = [f"z_{s}" for s in rule.signals]
    d = robust_distance(signal_scores(panel, rule), z).withColumn("_i", weighted(rule))
    d = scaled(scaled(d, "distance", "anomaly"), "_i", "impulse")
    d = inside(d.withColumn("score", clip(impulse * F.col("impulse") + (1 - impulse) * F.col("anomaly"), 0.0, 1.0))).join(has, "cl", "left_anti")
    order = Window.partitionBy("cl").orderBy(F.round("score", 9).desc(), F.round("impulse", 9).desc(), "t")
    best = d.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= (0 if n and known / n >= target else 1))
    base, span, least, most = rule.intensity
    return best.select("cl", F.col("t").alias("start_t"), "score", "anomaly", clip(base + span * F.col("score"), least, most).alias("intensity"), named(rule).alias("name"))


def with_inferred(registry: DataFrame, inferred: DataFrame) -> DataFrame:
    """The registry's events and the inferred ones (cl, start_t, intensity, name); of several of one cluster, start and name the most intense."""
    names = ["cl", "start_t", "intensity", "name"]
    both = registry.select(*names, F.lit(0).alias("inferred")).union(inferred.select(*names, F.lit(1)))
    order = Window.partitionBy("cl", "start_t", "name").orderBy(F.desc("intensity"), "inferred")
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
