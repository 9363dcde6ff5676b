"""Dynamics of each unit over its periods. Lags are by row, as in the unit's own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.functions.columns import keyed_draw, minmax, rank_pct, rolling, safe_div, zscore

def own_order() -> WindowSpec:
    """Each unit's rows by period."""
    return Window.partitionBy("unit").orderBy("t")


def one_unit() -> WindowSpec:
    return Window.partitionBy("unit")


def pulse_state(panel: DataFrame) -> DataFrame:
    """Three-row mean, log, velocity, acceleration, four-row volatility, z in the unit, softmax of four linear scores, the likeliest state."""
    m = panel.select("unit", "t", "value", rolling(F.avg, F.col("value"), own_order(), 3).alias("smooth"))
    m = m.withColumn("log", F.log1p("smooth"))
    m = m.withColumn("velocity", F.col("log") - F.lag("log").over(own_order()))
    m = m.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(own_order())).withColumn("volatility", rolling(F.stddev_samp, F.col("velocity"), own_order(), 4, 2))
    z = {c: F.coalesce(zscore(F.col(c), one_unit(), population=False), F.lit(0.0)) for c in ("velocity", "acceleration", "volatility")}
    m = m.select("*", *[x.alias(f"z_{c}") for c, x in z.items()])
    v, a, s = (F.col(f"z_{c}") for c in z)
    raw = {"expansion": v + 0.5 * a - 0.2 * s, "recovery": a - 0.5 * v, "stagnation": -F.abs(v) - 0.3 * s, "decline": -v - 0.5 * a + 0.2 * s}
    total = sum((F.exp(x) for x in raw.values()), F.lit(0.0))
    m = m.select("*", *[(F.exp(x) / total).alias(f"p_{n}") for n, x in raw.items()])
    best = F.greatest(*[F.col(f"p_{n}") for n in raw])
    state = F.coalesce(*[F.when(F.col(f"p_{n}") == best, n) for n in raw])
    return m.select("unit", "t", "smooth", "velocity", "acceleration", "volatility", *[f"p_{n}" for n in raw], state.alias("state"))


def growths(panel: DataFrame) -> DataFrame:
    """``panel`` with growth, three-row volatility and next growth, and nothing that takes more than a unit's own rows."""
    g = panel.withColumn("growth", F.col("value") - F.lag("value").over(own_order()))
    return g.select("*", rolling(F.stddev_samp, F.col("growth"), own_order(), 3, 2).alias("vol_3"), F.lead("growth").over(own_order()).alias("growth_next"))


def dynamics_table(panel: DataFrame, reference_end: int) -> DataFrame:
    """growth, acceleration, three-row volatility, two-row momentum, next growth, rank share in the period, z in the unit; stall and surge of the next growth by quantiles of the periods up to ``reference_end``."""
    g = panel.withColumn("growth", F.col("value") - F.lag("value").over(own_order()))
    g = g.select(
        "unit", "grp", "t", "value", "growth", (F.col("growth") - F.lag("growth").over(own_order())).alias("accel"),
        rolling(F.stddev_samp, F.col("growth"), own_order(), 3, 2).alias("vol_3"), rolling(F.avg, F.col("growth"), own_order(), 2).alias("momentum_2"),
        F.lead("growth").over(own_order()).alias("growth_next"), rank_pct(F.col("value"), Window.partitionBy("t")).alias("rank_pct"), zscore(F.col("value"), one_unit(), population=False).alias("z_unit"),
    )
    low, high = g.filter(F.col("t") <= reference_end).agg(F.percentile("growth_next", 0.25), F.percentile("growth_next", 0.75)).first()
    return g.select("*", (F.col("growth_next") <= F.lit(low)).cast("int").alias("stall_next"), (F.col("growth_next") >= F.lit(high)).cast("int").alias("surge_next"))


def kinetic_structure(panel: DataFrame) -> DataFrame:
    """Jerk, sign flip, energy, turning risk, damping, and one of six states by the 35 and 65 % quantiles of growth and acceleration."""
    g = panel.withColumn("growth", F.col("value") - F.lag("value").over(own_order()))
    g = g.withColumn("accel", F.col("growth") - F.lag("growth").over(own_order())).withColumn("jerk", F.col("accel") - F.lag("accel").over(own_order()))
    g_low, g_high, a_low, a_high = g.agg(*[F.percentile(c, q) for c in ("growth", "accel") for q in (0.35, 0.65)]).first()
    flip = (F.signum("growth") != F.signum(F.lag("growth").over(own_order()))).cast("int")
    k = g.select("unit", "t", "growth", "accel", "jerk", flip.alias("flip"), (F.col("growth") ** 2 + F.col("accel") ** 2).alias("energy"))
    k = k.select("*", rolling(F.avg, F.col("flip"), own_order(), 4).alias("turning"), (-safe_div(F.col("accel"), F.abs("growth"))).alias("damping"))
    state = (
        F.when(F.col("accel").isNull(), None).when((F.col("growth") >= g_high) & (F.col("accel") >= a_high), "take_off").when((F.col("growth") >= g_high) & (F.col("accel") <= a_low), "overheating")
        .when((F.col("growth") <= g_low) & (F.col("accel") >= a_high), "rebound").when((F.col("growth") <= g_low) & (F.col("accel") <= a_low), "free_fall")
        .when(F.col("growth") >= g_high, "cruise").otherwise("drift")
    )
    return k.select("*", state.alias("state"))


def early_warning(panel: DataFrame, size: int = 6) -> DataFrame:
    """Rolling AR(1), variance and bias-corrected skew of the value, short and long slopes, fall from the running peak.

    AR(1) is the correlation of the window's values with those before them inside
    the window, in moments; the skew is population skew times sqrt(n (n - 1)) / (n - 2).
    """
    x, p = F.col("value") / 1e6, F.lag(F.col("value") / 1e6).over(own_order())
    m = panel.select("unit", "t", x.alias("x"), p.alias("p"))
    pair, full = own_order().rowsBetween(-(size - 2), 0), own_order().rowsBetween(-(size - 1), 0)
    s = lambda e: F.sum(e).over(pair)
    both = F.when(F.col("p").isNotNull(), 1)
    n = s(both)
    xy, sx, sp = s(F.col("x") * F.col("p")), s(F.col("x") * both), s(F.col("p"))
    xx, pp = s(F.col("x") * F.col("x") * both), s(F.col("p") * F.col("p"))
    spread = F.sqrt((n * xx - sx * sx) * (n * pp - sp * sp))
    k = F.count("x").over(full)
    kd = k.cast("double")
    skew = F.skewness("x").over(full) * F.sqrt(kd * (kd - 1)) / (kd - 2)
    slope = lambda w: F.regr_slope("x", "t").over(own_order().rowsBetween(-(w - 1), 0))
    peak = F.max("x").over(own_order().rowsBetween(Window.unboundedPreceding, 0))
    full_n = k == size
    return m.select(
        "unit", "t", F.when(full_n & (spread > 1e-9), (n * xy - sx * sp) / spread).alias("ar1"), F.when(full_n, F.var_samp("x").over(full)).alias("variance"),
        F.when(full_n, skew).alias("skew"), F.when(full_n, slope(3) - slope(size)).alias("slope_gap"), (1 - F.col("x") / peak).alias("drawdown"),
    )


def regime_features(states: DataFrame) -> DataFrame:
    """Switch flag, block, run length, switch rate of three and five rows, and the share of the unit's rows so far in the state."""
    flag = F.when(F.lag("t").over(own_order()).isNull(), 0).otherwise((~F.col("state").eqNullSafe(F.lag("state").over(own_order()))).cast("int"))
    s = states.withColumn("switch", flag)
    so_far = own_order().rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("block", F.sum("switch").over(so_far))
    in_block, in_state = Window.partitionBy("unit", "block").orderBy("t"), Window.partitionBy("unit", "state").orderBy("t")
    return s.select("*", F.row_number().over(in_block).alias("run"), rolling(F.avg, F.col("switch"), own_order(), 3).alias("rate_3"), rolling(F.avg, F.col("switch"), own_order(), 5).alias("rate_5"), (F.row_number().over(in_state) / F.row_number().over(own_order())).alias("share"))


def regime_network(states: DataFrame) -> DataFrame:
    """For each state: transitions to consecutive periods, the chance to stay, and the entropy of where it goes."""
    nxt = states.select("state", F.when(F.lead("t").over(own_order()) == F.col("t") + 1, F.lead("state").over(own_order())).alias("next")).filter("next IS NOT NULL AND state IS NOT NULL")
    counts = nxt.groupBy("state", "next").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("state"))
    return counts.withColumn("p", p).groupBy("state").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("state") == F.col("next"), F.col("p")).otherwise(0.0)).alias("stay"), F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def pulse_index(panel: DataFrame) -> DataFrame:
    """0..100 of .6 level and .4 velocity (each scaled over all rows), its change, three-row trend, and state by the 30 and 70 % quantiles."""
    v = panel.select("unit", "grp", "t", F.log1p("value").alias("level")).withColumn("velocity", F.col("level") - F.lag("level").over(own_order()))
    lo, hi, vlo, vhi = v.agg(F.min("level"), F.max("level"), F.min("velocity"), F.max("velocity")).first()
    index = 100 * (0.6 * (F.col("level") - lo) / (hi - lo) + 0.4 * F.coalesce((F.col("velocity") - vlo) / (vhi - vlo), F.lit(0.5)))
    i = v.withColumn("index", index)
    q30, q70 = i.agg(F.percentile("index", 0.3), F.percentile("index", 0.7)).first()
    state = F.when(F.col("index") <= q30, "weak").when(F.col("index") >= q70, "strong").otherwise("steady")
    return i.select("unit", "grp", "t", "index", (F.col("index") - F.lag("index").over(own_order())).alias("delta"), ((F.col("index") - F.lag("index", 3).over(own_order())) / 3).alias("trend"), state.alias("state"))


def quadrant_cuts(latest: DataFrame, columns: list[str], spread: float = 8.0, step: float = 5.0) -> dict[str, tuple[float, float]]:
    """Low and high cut of each score of 0 to 100: its 35 and 65 % quantiles; ``spread`` / 2 around the median, where they are no farther apart than ``spread``; low within 8 to 92,
    high at least ``step`` above it and at most 96. 35 and 65, where a score has no values."""
    qs = latest.agg(*[F.percentile(c, q) for c in columns for q in (0.35, 0.5, 0.65)]).first()
    out = {}
    for i, c in enumerate(columns):
        low, middle, high = qs[3 * i : 3 * i + 3]
        if None in qs[:]:
            low, high = 35.0, 65.0
        elif high <= low + spread:
            low, high = min(low, middle - spread / 2), max(high, middle + spread / 2)
        low = min(max(low, 8.0), 92.0)
        out[c] = (low, min(max(high, low + step), 96.0))
    return out


def quadrants(latest: DataFrame, accel: str, risk: str) -> DataFrame:
    """Rows by the cuts of two scores of 0 to 100: accelerating (fast, safe), stalling (slow, at risk), fragile_boom (fast, at risk), recovery_window (slow, safe), steady."""
    cuts = quadrant_cuts(latest, [accel, risk])
    low, high = (lambda c: F.col(c) <= F.lit(cuts[c][0])), (lambda c: F.col(c) >= F.lit(cuts[c][1]))
    kind = F.when(high(accel) & low(risk), "accelerating").when(low(accel) & high(risk), "stalling").when(high(accel) & high(risk), "fragile_boom").when(low(accel) & low(risk), "recovery_window")
    return latest.select("*", kind.otherwise("steady").alias("quadrant"))


def global_cycle(index: DataFrame) -> DataFrame:
    """By period: mean index, shares of the states, their tension, and the phase by thirds of the mean."""
    p = index.groupBy("t").agg(F.avg("index").alias("mean"), *[F.avg((F.col("state") == s).cast("double")).alias(s) for s in ("weak", "steady", "strong")])
    low, high = p.agg(F.percentile("mean", 0.33), F.percentile("mean", 0.67)).first()
    return p.select("*", (F.col("weak") * F.col("strong") * 4).alias("tension"), F.when(F.col("mean") <= low, "trough").when(F.col("mean") >= high, "peak").otherwise("middle").alias("phase"))


def trend(panel: DataFrame) -> DataFrame:
    return panel.groupBy("unit").agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.count("value").alias("n"))


def trend_shock(panel: DataFrame, recent: int = 6) -> DataFrame:
    """Per unit: slope of the last rows, the last growth's z against the growths before, and CUSUM sums of the standardised growths.

    The CUSUM (slack .5) is a fold over the unit's growths in order, an array of one number a period.
    """
    g = panel.withColumn("growth", F.col("value") - F.lag("value").over(own_order())).withColumn("back", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("t").desc())))
    a = g.groupBy("unit").agg(
        F.regr_slope(F.when(F.col("back") <= recent, F.col("value")), "t").alias("slope"), F.max(F.when(F.col("back") == 1, F.col("growth"))).alias("last"),
        F.avg(F.when(F.col("back") > 1, F.col("growth"))).alias("m"), F.stddev_samp(F.when(F.col("back") > 1, F.col("growth"))).alias("s"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("growth").isNotNull(), F.struct("t", "growth")))), lambda x: x["growth"]).alias("gs"),
    )
    fold = lambda sign: F.aggregate("gs", F.lit(0.0), lambda acc, x: F.greatest(F.lit(0.0), acc + sign * (x - F.col("m")) / F.col("s") - 0.5))
    ok = F.col("s") > 0
    return a.select("unit", "slope", F.when(ok, (F.col("last") - F.col("m")) / F.col("s")).alias("shock_z"), F.when(ok, fold(1)).alias("cusum_up"), F.when(ok, fold(-1)).alias("cusum_down"))


#: Weights of the envelope's parts, and whether little of them is good; fixed values.
ENVELOPE = {"trend": (0.26, False), "volatility": (0.19, True), "drawdown": (0.13, True), "rises": (0.15, False), "gap": (0.11, False), "risk": (0.16, True)}


def unit_envelope(panel: DataFrame) -> DataFrame:
    """Per unit of ``panel`` (unit, t, index, accel_velocity, risk_velocity, risk): change of the index over the last three rows, deviation of its last five changes, fall from the last five rows' peak,
    share of rises among those changes, momentum gap (the last row's velocities, nulls 0) and last risk; their blend of 0 to 100 (each part scaled over units, 0.5 where all are equal
    or it is null), the gap of risk over it, and a class by both."""
    d = panel.select("*", (F.col("index") - F.lag("index").over(own_order())).alias("d"), F.row_number().over(Window.partitionBy("unit").orderBy(F.col("t").desc())).alias("back"))
    late, last = F.col("back") <= 5, lambda c: F.max(F.when(F.col("back") == 1, F.col(c)))
    three = F.max(F.when(F.col("back") == F.least(F.lit(3), F.col("_n")), F.col("index")))
    d = d.withColumn("_n", F.count("*").over(one_unit()))
    u = d.groupBy("unit").agg(
        (last("index") - three).alias("trend"), F.stddev_pop(F.when(late, F.col("d"))).alias("volatility"), (F.max(F.when(late, F.col("index"))) - last("index")).alias("drawdown"),
        F.avg(F.when(late, (F.col("d") > 0).cast("double"))).alias("rises"), (F.coalesce(last("accel_velocity"), F.lit(0.0)) - F.coalesce(last("risk_velocity"), F.lit(0.0))).alias("gap"), last("risk").alias("risk"),
    )
    ends = u.agg(*[f(c).alias(f"_{e}_{c}") for c in ENVELOPE for e, f in (("low", F.min), ("high", F.max))])
    score = F.lit(0.0)
    for c, (weight, less) in ENVELOPE.items():
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        part = F.coalesce(F.when(high - low > 1e-12, (F.col(c) - low) / (high - low)), F.lit(0.5))
        score = score + weight * ((1 - part) if less else part)
    e, risk = F.col("envelope"), F.coalesce("risk", F.lit(50.0))
    kind = F.when((e >= 70) & (risk <= 45), "resilient_accelerator").when((e >= 58) & (risk > 45), "pressured_growth").when((e < 45) & (risk >= 60), "stall_trap").when(F.col("gap") >= 0, "adaptive_transition")
    out = u.join(ends, F.lit(True)).withColumn("envelope", 100 * score)  # one row
    return out.select("unit", *ENVELOPE, "envelope", (risk - e).alias("fragility"), kind.otherwise("fragile_transition").alias("class"))


def group_envelope(panel: DataFrame) -> DataFrame:
    g = panel.groupBy("grp", "t").agg(F.avg("value").alias("mean"), F.percentile("value", 0.25).alias("p25"), F.percentile("value", 0.75).alias("p75"), F.stddev_samp("value").alias("sd"))
    return g.select("*", (safe_div(F.col("mean"), F.lag("mean").over(Window.partitionBy("grp").orderBy("t"))) - 1).alias("yoy"))


def lag_panel(panel: DataFrame) -> DataFrame:
    """Supervised rows: value, two lags, mean of the group and of all in the period, their changes, and the target one row on."""
    group, all_ = Window.partitionBy("grp", "t"), Window.partitionBy("t")
    c = panel.select("unit", "grp", "t", "value", F.avg("value").over(group).alias("group_mean"), F.avg("value").over(all_).alias("all_mean"))
    lag = lambda x, k=1: F.lag(x, k).over(own_order())
    return c.select("unit", "t", "value", lag("value").alias("lag_1"), lag("value", 2).alias("lag_2"), "group_mean", (F.col("group_mean") - lag("group_mean")).alias("group_delta"), (F.col("all_mean") - lag("all_mean")).alias("all_delta"), F.lead("value").over(own_order()).alias("target"))


def first_differences(panel: DataFrame) -> DataFrame:
    """Change to the row before less the group's mean change in the period; mean and deviation of the unit's earlier ones."""
    d = panel.withColumn("d", F.col("value") - F.lag("value").over(own_order()))
    d = d.withColumn("own", F.col("d") - F.avg("d").over(Window.partitionBy("grp", "t")))
    before = own_order().rowsBetween(Window.unboundedPreceding, -1)
    return d.select("unit", "t", "own", F.avg("own").over(before).alias("past_mean"), F.stddev_samp("own").over(before).alias("past_sd"))


def latest_shift(panel: DataFrame) -> DataFrame:
    """The latest row of each unit with its change to the row before."""
    w = Window.partitionBy("unit").orderBy(F.col("t").desc())
    return panel.select("unit", "t", "value", (F.col("value") - F.lead("value").over(w)).alias("shift"), F.row_number().over(w).alias("_r")).filter("_r = 1").drop("_r")


def group_stability(groups: DataFrame, draws: int = 400) -> DataFrame:
    """By group of a (grp, t, score) table: periods, last and mean score, trend slope with its 95 % interval over resampled periods, deviation of the yearly changes and their
    share above 0, a score of 0 to 100 blended from the scaled parts (.36 mean, .28 slope, .22 low deviation, .14 share) and its rank.

    A draw takes as many of the group's periods as there are, with replacement, by keyed draws; groups of under 3 periods have their slope as both bounds.
    """
    own = Window.partitionBy("grp").orderBy("t")
    d = groups.select("grp", "t", "score", (F.col("score") - F.lag("score").over(own)).alias("d"), F.row_number().over(own).alias("i"), F.count("*").over(Window.partitionBy("grp")).alias("n"))
    change = F.coalesce("d", F.lit(0.0))
    g = d.groupBy("grp").agg(F.count("*").alias("periods"), F.max_by("score", "t").alias("last"), F.avg("score").alias("mean"), F.regr_slope("score", F.col("t")).alias("slope"), F.stddev_pop(change).alias("volatility"), F.avg((change > 0).cast("double")).alias("positive"))
    slots = d.filter("n >= 3").select("grp", "n", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    taken = slots.select("grp", "draw", (F.floor(keyed_draw(F.col("draw"), F.col("grp"), F.col("slot")) * F.col("n")) + 1).alias("i"))
    boot = taken.join(d.select("grp", "i", "t", "score"), ["grp", "i"]).groupBy("grp", "draw").agg(F.regr_slope("score", F.col("t")).alias("b"))
    ci = boot.groupBy("grp").agg(F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"))
    every = Window.partitionBy()  # a row for each group
    part = lambda c: minmax(F.col(c), every)
    score = 100 * (0.36 * part("mean") + 0.28 * part("slope") + 0.22 * (1 - part("volatility")) + 0.14 * part("positive"))
    out = g.join(ci, "grp", "left").withColumn("low", F.coalesce("low", "slope")).withColumn("high", F.coalesce("high", "slope")).withColumn("stability", score)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("stability", 9).desc(), "grp")))


def unit_features(panel: DataFrame) -> DataFrame:
    """One row a unit: mean log value, its deviation and trend, mean and deviation of growth; missing ones by the median of all."""
    own = Window.partitionBy("unit").orderBy("t")
    x = panel.select("unit", "t", F.log1p("value").alias("x")).withColumn("g", F.col("x") - F.lag("x").over(own))
    u = x.groupBy("unit").agg(F.avg("x").alias("level"), F.stddev_samp("x").alias("sd"), F.regr_slope("x", F.col("t")).alias("trend"), F.avg("g").alias("growth"), F.stddev_samp("g").alias("volatility"))
    names = ["level", "sd", "trend", "growth", "volatility"]
    medians = u.agg(*[F.percentile(c, 0.5) for c in names]).first()
    return u.select("unit", *[F.coalesce(c, F.lit(float(m or 0.0))).alias(c) for c, m in zip(names, medians, strict=True)])


def _standard(features: DataFrame, names: list[str]) -> DataFrame:
    row = features.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    k = len(names)
    return features.select("*", *[((F.col(c) - F.lit(row[i])) / F.lit(row[k + i] or 1.0)).alias(f"{c}_z") for i, c in enumerate(names)])


def unit_embeddings(features: DataFrame, names: list[str], components: int = 2) -> DataFrame:
    """unit and its first principal components of the standardised features, each with the sign that makes its largest loading positive. Only a k-by-k matrix reaches the driver."""
    import numpy as np

    z = _standard(features, names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = z.agg(*[F.avg(F.col(f"{names[i]}_z") * F.col(f"{names[j]}_z")) for i, j in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row, strict=True):
        cov[i, j] = cov[j, i] = v
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(components)])
    return z.select("unit", *[sum((F.col(f"{c}_z") * float(w) for c, w in zip(names, v, strict=True)), F.lit(0.0)).alias(f"e{i + 1}") for i, v in enumerate(vectors.T)])


#: Names of archetypes, the best first; fixed values.
ARCHETYPES = ["frontier_accelerator", "resilient_steady", "fragile_rebound", "structural_stall"]


def archetypes(features: DataFrame, names: list[str], quality: dict[str, float], k: int = 4, seed: int = 42) -> DataFrame:
    """unit, cluster by k-means of the standardised features, and the cluster's name, given in the order of a weighted sum of its mean features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    z = _standard(features, names)
    vectors = VectorAssembler(inputCols=[f"{c}_z" for c in names], outputCol="v").transform(z)
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster", maxIter=50).fit(vectors)
    d = model.transform(vectors)
    score = sum((F.avg(c) * w for c, w in quality.items()), F.lit(0.0))
    ranked = d.groupBy("cluster").agg(score.alias("q")).withColumn("place", F.row_number().over(Window.orderBy(F.col("q").desc(), "cluster")))  # k rows
    return d.join(ranked, "cluster").select("unit", "cluster", F.element_at(F.array(*[F.lit(a) for a in ARCHETYPES[:k]]), F.col("place")).alias("archetype"))
