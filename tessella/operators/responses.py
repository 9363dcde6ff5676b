"""Responses of units around common shocks and around their own changes of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of growth, risk and the next period's shift of risk in the envelope's signal; of the signal before and after, the relief of risk and the risk at impact in absorption; fixed values.
SIGNAL, ABSORPTION = (0.62, -0.48, -0.22), (0.38, 0.34, 0.20, -0.08)


def shock_periods(dyn: DataFrame, latest: int, first: int | None = None, most: int = 3, gap: int = 2) -> DataFrame:
    """shock_t, strength, mean_growth, mean_accel: up to ``most`` periods of least mean growth that are ``gap`` or more apart, chosen one by one; ``first`` before all others, if it may be chosen.

    The first period and those from ``latest`` on can't be chosen, unless there are no others. Strength is the growth's score over all periods with its sign
    turned, 0 where all are equal. ``dyn``: unit, t, growth, accel; periods without growth don't count. Ties go to the earlier period.
    """
    by = dyn.groupBy("t").agg(F.avg("growth").alias("mean_growth"), F.avg("accel").alias("mean_accel")).filter("mean_growth IS NOT NULL")
    every = Window.partitionBy()  # a row for each period
    z = F.coalesce((F.avg("mean_growth").over(every) - F.col("mean_growth")) / F.nullif(F.stddev_pop("mean_growth").over(every), F.lit(0.0)), F.lit(0.0))
    by = by.select("*", z.alias("strength"), F.min("t").over(every).alias("_first"))
    may = (F.col("t") > F.col("_first")) & (F.col("t") < latest)
    by = by.select("*", may.alias("_may"), F.max(may).over(every).alias("_any")).withColumn("_may", F.col("_may") | ~F.col("_any"))
    ranked = by.agg(F.array_sort(F.collect_list(F.when(F.col("_may"), F.struct(F.round("mean_growth", 9).alias("g"), "t")))).alias("ranked"))
    wanted = F.array(F.lit(first)).cast("array<int>") if first is not None else F.array().cast("array<int>")
    start = F.filter(wanted, lambda y: F.exists("ranked", lambda x: x["t"] == y))
    apart = lambda chosen, t: (F.size(chosen) < most) & F.forall(chosen, lambda y: F.abs(y - t) >= gap)
    chosen = F.aggregate("ranked", start, lambda a, x: F.when(apart(a, x["t"]), F.concat(a, F.array(x["t"].cast("int")))).otherwise(a))
    picks = ranked.select(F.explode(chosen).alias("shock_t"))
    return by.join(picks, F.col("t") == F.col("shock_t")).select("shock_t", "strength", "mean_growth", "mean_accel")


def shock_response(dyn: DataFrame, shocks: DataFrame, window: int = 2, least: int = 20) -> DataFrame:
    """shock_t, event_t, regime, vulnerability, rows, rel_change, growth: mean change of the value since the period before each shock, by the regime of the
    row (vulnerability null) and by the unit's risk then, high or low by its 70 and 30 % quantiles over units (regime null).

    ``dyn``: unit, t, value, growth, risk, regime. Units without a row in the period before take no part; shocks with under ``least`` units are left out.
    """
    base = dyn.join(shocks.select("shock_t"), F.col("t") == F.col("shock_t") - 1).select("shock_t", F.col("unit").alias("u"), F.col("value").alias("v0"), F.col("risk").alias("r0"))
    cuts = base.groupBy("shock_t").agg(F.percentile("r0", 0.7).alias("high"), F.percentile("r0", 0.3).alias("low"), F.count("*").alias("n")).filter(F.col("n") >= least)
    group = F.when(F.col("r0") >= F.col("high"), "high_risk").when(F.col("r0") <= F.col("low"), "low_risk").otherwise("mid_risk")
    base = base.join(cuts, "shock_t").select("shock_t", "u", "v0", group.alias("vulnerability"))
    met = dyn.join(base, (F.col("unit") == F.col("u")) & F.col("t").between(F.col("shock_t") - window, F.col("shock_t") + window))
    met = met.select("shock_t", (F.col("t") - F.col("shock_t")).alias("event_t"), "regime", "vulnerability", (F.col("value") - F.col("v0")).alias("rel"), "growth")
    sets = [("shock_t", "event_t", "regime"), ("shock_t", "event_t", "vulnerability")]
    g = met.groupingSets(sets, "shock_t", "event_t", "regime", "vulnerability")
    out = g.agg(F.grouping("regime").alias("_by"), F.count("*").alias("rows"), F.avg("rel").alias("rel_change"), F.avg("growth").alias("growth"))
    return out.filter("_by = 0 OR vulnerability <> 'mid_risk'").drop("_by")


def entry_responses(states: DataFrame, growth: str, risk: str, window: int = 2) -> DataFrame:
    """event_type, event_t, n, growth, risk: around each entry to a state (another one in the period before), means of growth and risk less their period's
    means, less what they were in the period before the entry. All states in one pass. ``states``: unit, t, state and both measures."""
    own = Window.partitionBy("unit").orderBy("t")
    means = states.groupBy(F.col("t").alias("_t")).agg(F.avg(growth).alias("_g"), F.avg(risk).alias("_r"))
    v = states.join(means, F.col("t") == F.col("_t")).select("unit", "t", "state", (F.col(growth) - F.col("_g")).alias("g"), (F.col(risk) - F.col("_r")).alias("r"))
    before = (F.lag("state").over(own) != F.col("state")) & (F.lag("t").over(own) == F.col("t") - 1)
    entries = v.withColumns({"_new": before, "g0": F.lag("g").over(own), "r0": F.lag("r").over(own)}).filter("_new")
    entries = entries.select(F.col("unit").alias("u"), F.col("t").alias("at"), F.col("state").alias("event_type"), "g0", "r0")
    met = v.join(entries, (F.col("unit") == F.col("u")) & F.col("t").between(F.col("at") - window, F.col("at") + window))
    g = met.groupBy("event_type", (F.col("t") - F.col("at")).alias("event_t"))
    return g.agg(F.count("*").alias("n"), F.avg(F.col("g") - F.col("g0")).alias("growth"), F.avg(F.col("r") - F.col("r0")).alias("risk"))


def _z(x: Column, over) -> Column:
    """Score over the window (population); 0 where all are equal, null for nulls."""
    return F.when(x.isNotNull(), F.coalesce((x - F.avg(x).over(over)) / F.nullif(F.stddev_pop(x).over(over), F.lit(0.0)), F.lit(0.0)))


def event_envelope(study: DataFrame) -> DataFrame:
    """``study`` (event_type, event_t, n, growth, risk) with its phase (pre, impact, post), scores of growth, risk and the next event time's change of risk within the
    event type, and their weighted signal. Rows without a type or time are left out; the last time's change counts as 0."""
    kind = Window.partitionBy("event_type")  # a row for each event time
    d = study.filter("event_type IS NOT NULL AND event_t IS NOT NULL")
    d = d.withColumn("_shift", F.lead("risk").over(kind.orderBy("event_t")) - F.col("risk"))
    d = d.select("event_type", "event_t", "n", "growth", "risk", _z(F.col("growth"), kind).alias("growth_z"), _z(F.col("risk"), kind).alias("risk_z"), F.coalesce(_z(F.col("_shift"), kind), F.lit(0.0)).alias("shift_z"))
    phase = F.when(F.col("event_t") < 0, "pre").when(F.col("event_t") == 0, "impact").otherwise("post")
    a, b, c = SIGNAL
    return d.select("*", phase.alias("phase"), (a * F.col("growth_z") + b * F.col("risk_z") + c * F.col("shift_z")).alias("signal"))


def envelope_summary(envelope: DataFrame) -> DataFrame:
    """By event type: rows, observations, mean signal before, at and after, growth and risk at impact, relief (risk before less after), and the absorption, scaled to 0..100 over types (50 where all are equal)."""
    at = lambda phase, c: F.avg(F.when(F.col("phase") == phase, F.col(c)))
    g = envelope.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), at("pre", "signal").alias("pre_signal"), at("impact", "signal").alias("impact_signal"), at("post", "signal").alias("post_signal"),
        at("impact", "growth").alias("growth_impact"), at("impact", "risk").alias("risk_impact"), (at("pre", "risk") - at("post", "risk")).alias("relief"),
    )
    parts = zip(ABSORPTION, ("pre_signal", "post_signal", "relief", "risk_impact"), strict=True)
    raw = sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    every = Window.partitionBy()  # a row for each event type
    g = g.withColumn("_s", raw).withColumns({"_l": F.min("_s").over(every), "_h": F.max("_s").over(every)})
    scaled = F.when(F.col("_h") - F.col("_l") > 1e-12, (F.col("_s") - F.col("_l")) / (F.col("_h") - F.col("_l"))).otherwise(0.5)
    return g.withColumn("absorption", 100 * scaled).drop("_s", "_l", "_h")
