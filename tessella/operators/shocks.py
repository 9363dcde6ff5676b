"""Shock periods and event-window responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import keyed_draw, poisson_weight

#: Share of a figure up to which a distance from it is rounding: a signal with no more deviation than that from its mean is constant.
ROUNDING = 1e-9


def shock_index(registry: DataFrame, low: int, high: int, clusters: int) -> DataFrame:
    """By period of the full grid: new events, clusters covered, mean intensity, the mean of their z (population), and is_shock from the 75 % quantile on (less ``ROUNDING``, so that periods tied there are on one side). A constant signal has z 0."""
    starts = registry.groupBy(F.col("start_t").alias("t")).agg(F.count("*").alias("events"), (F.countDistinct("cl") / F.lit(float(clusters))).alias("covered"), F.avg("intensity").alias("intensity"))
    grid = registry.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    g = grid.join(starts, "t", "left").fillna({"events": 0, "covered": 0.0, "intensity": 0.0})
    names = ("events", "covered", "intensity")
    s = g.agg(*[x for c in names for x in (F.avg(c), F.stddev_pop(c))]).first()
    varies = [s[2 * i + 1] > ROUNDING * abs(s[2 * i]) for i in range(len(names))]
    z = sum(((F.col(c) - s[2 * i]) / s[2 * i + 1] if varies[i] else F.lit(0.0) for i, c in enumerate(names)), F.lit(0.0)) / 3
    g = g.withColumn("index", z)
    cut = g.agg(F.percentile("index", 0.75)).first()[0]
    return g.withColumn("is_shock", (F.col("index") >= F.lit(cut) - ROUNDING).cast("int"))


def baseline_exposure(panel: DataFrame, end: int) -> DataFrame:
    """Unit means up to ``end``; low up to the 30 % quantile, high from the 70 % one, else middle. Means that differ from a quantile by rounding alone count as equal to it."""
    u = panel.filter(F.col("t") <= end).groupBy("unit").agg(F.avg("value").alias("base"))
    low, high = (F.lit(q).cast("double") for q in u.agg(F.percentile("base", 0.3), F.percentile("base", 0.7)).first())
    is_low, is_high = F.col("base") <= low + ROUNDING * F.abs(low), F.col("base") >= high - ROUNDING * F.abs(high)
    return u.withColumn("exposure", F.when(is_low, "low").when(is_high, "high").otherwise("middle"))


def event_response(panel: DataFrame, exposure: DataFrame, shocks: DataFrame, window: int) -> DataFrame:
    """By shock and event time: mean of log value less that of the period before the shock, for high and low exposure, and their contrast."""
    p = panel.select("unit", "t", F.log1p("value").alias("v")).join(exposure.select("unit", "exposure").filter("exposure <> 'middle'"), "unit")
    s = shocks.select(F.col("t").alias("shock")).withColumn("e", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("t", F.col("shock") + F.col("e"))
    base = p.select("unit", F.col("t").alias("_b"), F.col("v").alias("v0"))
    met = p.join(s, "t").join(base, ["unit"]).filter("_b = shock - 1")
    g = met.groupBy("shock", F.col("e").alias("event_t")).agg(*[F.avg(F.when(F.col("exposure") == x, F.col("v") - F.col("v0"))).alias(x) for x in ("high", "low")], F.count("*").alias("n"))
    return g.withColumn("contrast", F.col("high") - F.col("low"))


def leave_one_out(response: DataFrame) -> DataFrame:
    """For each shock: the mean contrast after it (event time 0 and on) over all other shocks."""
    per = response.filter("event_t >= 0 AND contrast IS NOT NULL").groupBy("shock").agg(F.sum("contrast").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy()
    return per.select("shock", ((F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))).alias("mean_without"))


def channel_means(panel: DataFrame, channels: list[str], at: int, window: int) -> DataFrame:
    """Means of each channel in the ``window`` periods before and from ``at`` on."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in channels)
    long = panel.filter(F.col("t").between(at - window, at + window - 1)).select("t", F.expr(f"stack({len(channels)}, {names}) AS (channel, v)"))
    g = long.groupBy("channel").agg(F.avg(F.when(F.col("t") < at, F.col("v"))).alias("before"), F.avg(F.when(F.col("t") >= at, F.col("v"))).alias("after"))
    return g.withColumn("change", F.col("after") - F.col("before"))


def entry_study(states: DataFrame, state: str, window: int = 2) -> DataFrame:
    """Entries to a state: mean period-demeaned log value around them, less that of the row's period before."""
    own = Window.partitionBy("unit").orderBy("t")
    v = states.withColumn("y", F.log1p("value") - F.avg(F.log1p("value")).over(Window.partitionBy("t")))
    v = v.withColumn("enters", (F.col("state") == state) & (F.lag("state").over(own) != state) & (F.lag("t").over(own) == F.col("t") - 1))
    entries = v.filter("enters").select("unit", F.col("t").alias("at"))
    base = v.select("unit", F.col("t").alias("_b"), F.col("y").alias("y0"))
    met = v.join(entries, "unit").filter(F.col("t").between(F.col("at") - window, F.col("at") + window)).join(base, "unit").filter("_b = at - 1")
    return met.groupBy((F.col("t") - F.col("at")).alias("event_t")).agg(F.avg(F.col("y") - F.col("y0")).alias("effect"), F.count("*").alias("n"))


def lead_lag(group_panel: DataFrame, draws: int = 50) -> DataFrame:
    """For ordered pairs of groups: correlation of one's growth with the other's next less the one of the same period, and the share of reordered pairs at least as far from 0.

    Reorderings shift nothing but the second series: its periods are ranked by a keyed draw.
    """
    own = Window.partitionBy("grp").orderBy("t")
    g = group_panel.withColumn("g", F.col("value") / F.lag("value").over(own) - 1).filter("g IS NOT NULL").select("grp", "t", "g", F.lead("g").over(own).alias("g_next"))
    a, b = g.select(F.col("grp").alias("lead"), "t", F.col("g").alias("x")), g.select(F.col("grp").alias("follow"), "t", "g", "g_next")
    met = a.join(b, "t").filter("lead <> follow AND g_next IS NOT NULL")
    seen = met.groupBy("lead", "follow").agg((F.corr("x", "g_next") - F.corr("x", "g")).alias("lead_gain"), F.count("*").alias("n"))
    drawn = met.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pair = Window.partitionBy("lead", "follow", "draw")
    shuffled = drawn.withColumn("_p", F.row_number().over(pair.orderBy(keyed_draw(F.col("draw"), F.col("t")), "t"))).withColumn("_q", F.row_number().over(pair.orderBy("t")))
    left = shuffled.select("lead", "follow", "draw", F.col("_q").alias("k"), "x")
    right = shuffled.select("lead", "follow", "draw", F.col("_p").alias("k"), "g", "g_next")
    null = left.join(right, ["lead", "follow", "draw", "k"]).groupBy("lead", "follow", "draw").agg((F.corr("x", "g_next") - F.corr("x", "g")).alias("gain"))
    share = null.join(seen, ["lead", "follow"]).groupBy("lead", "follow").agg(F.avg((F.abs("gain") >= F.abs("lead_gain")).cast("double")).alias("p"))
    return seen.join(share, ["lead", "follow"])


def envelope(points: DataFrame) -> DataFrame:
    """Over variants at each event time: least, quartiles, greatest, mean, and whether signs conflict."""
    return points.groupBy("event_t").agg(F.min("contrast").alias("low"), F.percentile("contrast", 0.25).alias("q25"), F.percentile("contrast", 0.5).alias("median"), F.percentile("contrast", 0.75).alias("q75"), F.max("contrast").alias("high"), F.avg("contrast").alias("mean"), ((F.min("contrast") < 0) & (F.max("contrast") > 0)).cast("int").alias("conflict"))


def kind_index(registry: DataFrame) -> DataFrame:
    """By kind and start period: new events, intensity, and their z in the kind (population)."""
    g = registry.groupBy("kind", F.col("start_t").alias("t")).agg(F.count("*").alias("events"), F.sum("intensity").alias("intensity"))
    w = Window.partitionBy("kind")
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))
    return g.select("*", ((z("events") + z("intensity")) / 2).alias("index"))


def shift_share(panel: DataFrame, exposure: DataFrame, shocks: DataFrame) -> DataFrame:
    """The instrument exposure times shock index: slopes of dose and value on it (period and unit means out), their ratio, and the first stage's F.

    ``panel``: unit, t, value, dose.
    """
    j = panel.join(exposure.select("unit", "base"), "unit").join(shocks.select("t", "index"), "t").withColumn("iv", F.col("base") * F.col("index"))
    u, t = Window.partitionBy("unit"), Window.partitionBy("t")
    means = j.agg(*[F.avg(c).alias(f"_{c}") for c in ("iv", "dose", "value")])
    within = lambda c: F.col(c) - F.avg(c).over(u) - F.avg(c).over(t) + F.col(f"_{c}")
    w = j.join(means, F.lit(True)).select(within("iv").alias("z"), within("dose").alias("d"), within("value").alias("y"))
    s = w.agg(F.sum(F.col("z") ** 2).alias("zz"), F.sum(F.col("z") * F.col("d")).alias("zd"), F.sum(F.col("z") * F.col("y")).alias("zy"), F.sum(F.col("d") ** 2).alias("dd"), F.count("*").alias("n"))
    first, reduced = F.col("zd") / F.col("zz"), F.col("zy") / F.col("zz")
    rss = F.col("dd") - F.col("zd") ** 2 / F.col("zz")
    return s.select(first.alias("first_stage"), reduced.alias("reduced_form"), (F.col("zy") / F.nullif("zd", F.lit(0.0))).alias("wald"), ((F.col("zd") ** 2 / F.col("zz")) / (rss / (F.col("n") - 1))).alias("f"), "n")


def envelope_bootstrap(points: DataFrame, draws: int) -> DataFrame:
    """By event time: mean contrast, its 2.5 and 97.5 % quantiles over resamples of variants by keyed Poisson weights, and signal to noise (null where the resamples differ by rounding alone)."""
    weight = poisson_weight(keyed_draw(F.col("draw"), F.col("shock")))
    p = points.filter("contrast IS NOT NULL")
    b = p.select("shock", "event_t", "contrast", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight)
    m = b.groupBy("event_t", "draw").agg((F.sum(F.col("w") * F.col("contrast")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ci = m.groupBy("event_t").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.stddev_samp("m").alias("sd"))
    mean = p.groupBy("event_t").agg(F.avg("contrast").alias("mean"))
    ratio = F.when(F.col("sd") > ROUNDING * F.abs("mean"), F.abs("mean") / F.col("sd"))
    return mean.join(ci, "event_t").select("event_t", "mean", "low", "high", ratio.alias("signal_to_noise"))


def pretrend(points: DataFrame) -> DataFrame:
    """By shock: slope of the contrast on event time before it, its t (null where nothing but rounding is left beside the slope), largest size, and whether the slope's t is under 2."""
    pre = points.filter("event_t < 0 AND contrast IS NOT NULL").groupBy("shock").agg(F.regr_slope("contrast", "event_t").alias("slope"), F.regr_sxx("contrast", "event_t").alias("sxx"), F.regr_syy("contrast", "event_t").alias("syy"), F.regr_sxy("contrast", "event_t").alias("sxy"), F.count("*").alias("n"), F.max(F.abs("contrast")).alias("largest"))
    sxx = F.nullif("sxx", F.lit(0.0))
    rest = F.col("syy") - F.col("sxy") ** 2 / sxx
    t = F.col("slope") / F.sqrt(F.when(rest > ROUNDING * F.col("syy"), rest) / F.nullif(F.col("n") - 2, F.lit(0)) / sxx)
    return pre.select("shock", "n", "slope", t.alias("t"), "largest", (F.coalesce(F.abs(t), F.lit(0.0)) < 2).cast("int").alias("passed"))


def concordance(estimates: DataFrame, significant: float = 1.645) -> DataFrame:
    """Pairs of designs (name, coef, stderr): equal sign, overlap of 95 % intervals, equal class (|t| of ``significant`` or more, or not), distance in standard errors, closeness
    (1 - |a - b| / (|a| + |b|), at least 0), and the mean of sign, overlap, class and closeness, without those that a missing stderr leaves null."""
    a, b = (estimates.select(*[F.col(c).alias(f"{c}_{k}") for c in ("name", "coef", "stderr")]) for k in "ab")
    p = a.join(b, F.col("name_a") < F.col("name_b"))  # a handful of designs
    gap = F.abs(F.col("coef_a") - F.col("coef_b"))
    clear = lambda k: F.abs(F.col(f"coef_{k}")) >= significant * F.col(f"stderr_{k}")
    p = p.select(
        "name_a", "name_b", (F.signum("coef_a") == F.signum("coef_b")).cast("int").alias("same_sign"), (gap <= 1.96 * (F.col("stderr_a") + F.col("stderr_b"))).cast("int").alias("overlap"),
        (clear("a") == clear("b")).cast("int").alias("same_class"), (gap / F.sqrt(F.col("stderr_a") ** 2 + F.col("stderr_b") ** 2)).alias("distance"),
        F.greatest(1 - gap / (F.abs("coef_a") + F.abs("coef_b") + 1e-6), F.lit(0.0)).alias("closeness"),
    )
    parts = [F.col(c) for c in ("same_sign", "overlap", "same_class", "closeness")]
    total, known = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in parts), F.lit(0.0)), sum((c.isNotNull().cast("int") for c in parts), F.lit(0))
    return p.withColumn("concordance", total / known)
