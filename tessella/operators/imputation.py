"""Filling and back-casting of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import minmax


def fill_group_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """Median of the group, else of all, else 0."""
    overall = df.agg(F.percentile(value, 0.5)).first()[0]
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.percentile(value, 0.5).alias("_m"))
    joined = df.join(groups, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.select(*df.columns, F.coalesce(value, "_m", F.lit(overall), F.lit(0.0)).alias("filled"))


def interpolate(df: DataFrame, value: str, unit: str = "unit", period: str = "t", edges: bool = True) -> DataFrame:
    """Linear between a unit's neighbouring values by row position; with ``edges`` the first and last values go on outward."""
    own = Window.partitionBy(unit).orderBy(period)
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col("_i"))
    rows = df.withColumn("_i", F.row_number().over(own)).select(
        "*", F.last(value, True).over(back).alias("_v0"), F.last(known, True).over(back).alias("_i0"), F.first(value, True).over(ahead).alias("_v1"), F.first(known, True).over(ahead).alias("_i1")
    )
    inside = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    filled = F.coalesce(F.col(value), inside)
    if edges:
        filled = F.coalesce(filled, F.col("_v0"), F.col("_v1"))
    return rows.select(*df.columns, filled.alias("filled"))


def pool_fill(df: DataFrame, value: str, group: str, period: str = "t") -> DataFrame:
    """Median of (group, period), else of the period, else of all; strategy says which."""
    both = df.groupBy(F.col(group).alias("_g"), F.col(period).alias("_t")).agg(F.percentile(value, 0.5).alias("_gt"))
    each = df.groupBy(F.col(period).alias("_p")).agg(F.percentile(value, 0.5).alias("_pm"))
    overall = df.agg(F.percentile(value, 0.5)).first()[0]
    joined = df.join(both, (F.col(group) == F.col("_g")) & (F.col(period) == F.col("_t")), "left").join(each, F.col(period) == F.col("_p"), "left")
    strategy = F.when(F.col(value).isNotNull(), "observed").when(F.col("_gt").isNotNull(), "group").when(F.col("_pm").isNotNull(), "period").otherwise("all")
    return joined.select(*df.columns, F.coalesce(value, "_gt", "_pm", F.lit(overall)).alias("filled"), strategy.alias("strategy"))


def cascade_fill(df: DataFrame, value: str, group: str, unit: str = "unit", period: str = "t") -> DataFrame:
    """Interpolation inside a unit, then (group, period) median, group median, global median; strategy says which."""
    inner = interpolate(df, value, unit, period, edges=False).withColumnRenamed("filled", "_in")
    both = inner.groupBy(F.col(group).alias("_g"), F.col(period).alias("_t")).agg(F.percentile("_in", 0.5).alias("_gt"))
    alone = inner.groupBy(F.col(group).alias("_h")).agg(F.percentile("_in", 0.5).alias("_gm"))
    overall = inner.agg(F.percentile("_in", 0.5)).first()[0]
    joined = inner.join(both, (F.col(group) == F.col("_g")) & (F.col(period) == F.col("_t")), "left").join(alone, F.col(group) == F.col("_h"), "left")
    strategy = F.when(F.col(value).isNotNull(), "observed").when(F.col("_in").isNotNull(), "interpolated").when(F.col("_gt").isNotNull(), "group_period").when(F.col("_gm").isNotNull(), "group").otherwise("all")
    return joined.select(*df.columns, F.coalesce("_in", "_gt", "_gm", F.lit(overall)).alias("filled"), strategy.alias("strategy"))


def knn_fill(df: DataFrame, value: str, features: list[str], block: list[str], key: str = "unit", k: int = 5) -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest rows of the block that have the value; features scaled to 0..1 in the block.

    Only rows without the value are compared, with those of their own block that have it.
    """
    over = Window.partitionBy(*block)
    scaled = df.select("*", *[minmax(F.col(f), over, 0.0).alias(f"_{f}") for f in features])
    gaps, donors = scaled.filter(F.col(value).isNull()), scaled.filter(F.col(value).isNotNull())
    d = donors.select(*[F.col(b).alias(f"d_{b}") for b in block], F.col(key).alias("d_key"), F.col(value).alias("d_value"), *[F.col(f"_{f}").alias(f"d_{f}") for f in features])
    on = [F.col(b) == F.col(f"d_{b}") for b in block]
    distance = F.sqrt(sum((F.pow(F.col(f"_{f}") - F.col(f"d_{f}"), F.lit(2)) for f in features), F.lit(0.0)))
    near = gaps.join(d, on).withColumn("_d", distance)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*block, key).orderBy("_d", "d_key"))).filter(F.col("_r") <= k)
    weight = 1 / (F.col("_d") + 1e-9)
    filled = near.groupBy(*block, key).agg((F.sum(weight * F.col("d_value")) / F.sum(weight)).alias("_k"))
    return df.join(filled, [*block, key], "left").select(*df.columns, F.coalesce(value, "_k").alias("filled"))


def backcast(df: DataFrame, snapshot: str, history: str, unit: str = "unit", period: str = "t") -> DataFrame:
    """The unit's last known snapshot, scaled by history / history at that period; null where there is no history. source says which."""
    everything = Window.partitionBy(unit)
    rows = df.select("*", F.max(F.when(F.col(snapshot).isNotNull() & (F.col(history) > 0), F.struct(F.col(period), F.col(snapshot).alias("s"), F.col(history).alias("h")))).over(everything).alias("_b"))
    scaled = F.col("_b.s") * F.col(history) / F.col("_b.h")
    source = F.when(F.col(snapshot).isNotNull(), "snapshot").when(scaled.isNotNull(), "history").otherwise("missing")
    return rows.select(*df.columns, F.coalesce(F.col(snapshot), scaled).alias("filled"), source.alias("source"))


def resolve_features(df: DataFrame, features: list[str], train, least: float = 0.55) -> DataFrame:
    """Keeps features with values in at least ``least`` of the training rows and fills them with the training median. One aggregate decides."""
    of = df.filter(train)
    stats = of.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f"s_{f}") for f in features], *[F.percentile(f, 0.5).alias(f"m_{f}") for f in features]).first()
    kept = [f for f in features if (stats[f"s_{f}"] or 0) >= least]
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *[F.coalesce(F.col(f), F.lit(stats[f"m_{f}"])).alias(f) for f in kept])


def derived_proxy(df: DataFrame, a: str, b: str, weight: float = 0.7) -> DataFrame:
    """``weight`` of a and the rest of b, each scaled to 0..1 over all rows."""
    low = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    scale = lambda c, lo, hi: (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi is not None and hi > lo else F.lit(0.0)
    return df.select("*", (weight * scale(a, low[0], low[1]) + (1 - weight) * scale(b, low[2], low[3])).alias("proxy"))


def model_backcast(panel: DataFrame, y: str, xs: list[str], fit_end: int) -> DataFrame:
    """``panel`` with filled, filled_flag and filled_source: ``y``, and where it is missing the prediction of a linear model of the rows with a value up to ``fit_end``; null where a covariate is missing."""
    from tessella.operators.estimators import grams, linear, solved

    seen = panel.filter((F.col("t") <= fit_end) & F.col(y).isNotNull()).withColumn("_k", F.lit(0))
    gram = grams(seen, [*xs, y], "_k").get(0)
    model = linear(solved(gram), xs) if gram is not None else F.lit(None).cast("double")
    out = panel.withColumn("filled", F.coalesce(F.col(y), model))
    flag = (F.col(y).isNull() & F.col("filled").isNotNull()).cast("int")
    return out.withColumn("filled_flag", flag).withColumn("filled_source", F.when(F.col(y).isNotNull(), "observed").when(F.col("filled").isNotNull(), "model").otherwise("missing"))
