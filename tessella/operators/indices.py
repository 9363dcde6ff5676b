"""Normalisation and composite indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip, minmax, rank_pct, zscore


def scale_by_period(df: DataFrame, value: str, period: str = "t") -> DataFrame:
    """The three scalings: within the period (a constant gives 0), over all rows (0.5), plain (0)."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    x = F.col(value)
    flat = high is None or high <= low
    over_all = F.when(x.isNotNull(), F.lit(0.5) if flat else (x - F.lit(low)) / F.lit(high - low))
    plain = F.when(x.isNotNull(), F.lit(0.0) if flat else (x - F.lit(low)) / F.lit(high - low))
    return df.select("*", minmax(x, Window.partitionBy(period), 0.0).alias("in_period"), over_all.alias("in_all"), plain.alias("plain"))


def zscores(df: DataFrame, value: str, period: str = "t") -> DataFrame:
    w = Window.partitionBy(period)
    return df.select("*", zscore(F.col(value), w).alias("z"), zscore(F.col(value), w, population=False).alias("z_sample"))


def robust_z(df: DataFrame, value: str, part: str) -> DataFrame:
    """(x - median) / (1.4826 * MAD); where MAD is 0, by the standard deviation; else 0."""
    w = Window.partitionBy(part)
    d = df.withColumn("_d", F.col(value) - F.percentile(value, 0.5).over(w))
    mad = F.percentile(F.abs("_d"), 0.5).over(w) * 1.4826
    sd = F.stddev_samp(value).over(w)
    return d.select(*df.columns, F.when(F.col(value).isNotNull(), F.when(mad > 0, F.col("_d") / mad).when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)).alias("robust_z"))


def percent_rank(df: DataFrame, value: str, part: str) -> DataFrame:
    """Average rank share; rows without a value get the mean rank share of their part."""
    r = df.withColumn("_r", rank_pct(F.col(value), Window.partitionBy(part)))
    return r.select(*df.columns, F.coalesce("_r", F.avg("_r").over(Window.partitionBy(part))).alias("rank_pct"))


def weighted_blend(parts: list[tuple[Column, float]], default: float | None = None) -> Column:
    """Weighted mean over the parts that have a value, re-weighted."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    weight = add([F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts])
    total = add([F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    return F.when(weight > 0, total / weight).otherwise(F.lit(default))


def one_minus(x: Column) -> Column:
    return clip(1 - x, 0.0, 1.0)


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, weight) by the entropy method on columns scaled to 0..1: the less even a column, the more it weighs."""
    lows = df.agg(*[F.min(c).alias(f"l_{c}") for c in columns], *[F.max(c).alias(f"h_{c}") for c in columns], F.count("*").alias("n")).first()
    scaled = df.select(*[((F.col(c) - F.lit(lows[f"l_{c}"])) / F.lit(lows[f"h_{c}"] - lows[f"l_{c}"]) + 1e-12).alias(c) if lows[f"h_{c}"] > lows[f"l_{c}"] else F.lit(1.0).alias(c) for c in columns])
    sums = scaled.agg(*[F.sum(c).alias(c) for c in columns]).first()
    import math

    entropy = scaled.agg(*[(-F.sum(F.col(c) / F.lit(sums[c]) * F.log(F.col(c) / F.lit(sums[c]))) / F.lit(math.log(lows["n"]))).alias(c) for c in columns])
    spread = entropy.select(F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, 1 - `{c}`' for c in columns)}) AS (column, spread)"))
    return spread.select("column", (F.col("spread") / F.sum("spread").over(Window.partitionBy())).alias("weight"))


def weight_sensitivity(df: DataFrame, key: str, columns: list[str], schemes: dict[str, list[float]], baseline: str, top: int = 10) -> DataFrame:
    """For each scheme of weights the Spearman correlation of its composite with the baseline's, and how many of the top rows they share."""
    composites = {s: reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(columns, ws, strict=True)]) for s, ws in schemes.items()}
    wide = df.select(key, *[c.alias(s) for s, c in composites.items()])
    names = list(schemes)
    long = wide.select(key, F.col(baseline).alias("_b"), F.expr(f"stack({len(names)}, {', '.join(f'{s!r}, `{s}`' for s in names)}) AS (scheme, score)"))
    w = Window.partitionBy("scheme")
    ranks = long.select("*", rank_pct(F.col("score"), w).alias("r"), rank_pct(F.col("_b"), w).alias("rb"), F.row_number().over(w.orderBy(F.col("score").desc(), key)).alias("p"), F.row_number().over(w.orderBy(F.col("_b").desc(), key)).alias("pb"))
    return ranks.groupBy("scheme").agg(F.corr("r", "rb").alias("spearman"), F.sum(((F.col("p") <= top) & (F.col("pb") <= top)).cast("long")).alias("shared_top"))


def tiers(df: DataFrame, value: str, period: str = "t", least: int = 12) -> DataFrame:
    """low, middle, high by the period's thirds; unclassified where it has fewer than ``least`` values."""
    w = Window.partitionBy(period)
    x, low, high = F.col(value), F.percentile(value, 0.33).over(w), F.percentile(value, 0.67).over(w)
    return df.select("*", F.when(F.count(value).over(w) < least, "unclassified").when(x <= low, "low").when(x <= high, "middle").otherwise("high").alias("tier"))


def disaggregate(df: DataFrame, total: str, signal: str, cluster: str, period: str = "t") -> DataFrame:
    """The cluster's total dealt by each unit's share of the signal, evenly where the signal adds to nothing."""
    w = Window.partitionBy(cluster, period)
    all_ = F.sum(signal).over(w)
    share = F.when(all_ > 0, F.coalesce(F.col(signal), F.lit(0.0)) / all_).otherwise(1 / F.count("*").over(w))
    return df.select("*", share.alias("share"), (share * F.sum(total).over(w)).alias("part"))


def variation_share(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The share of groups with more than one value."""
    return df.groupBy(*keys).agg((F.countDistinct(value) > 1).cast("double").alias("_v")).agg(F.avg("_v").alias("share"), F.count("*").alias("groups"))


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    """Bins 0.. by inner quantile edges, right-closed; equal edges are one."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(1, q)]))).alias("e")).first()["e"] or []
    place = reduce(lambda a, b: a + b, [(F.col(value) > F.lit(e)).cast("int") for e in edges], F.lit(0))
    return df.select("*", F.when(F.col(value).isNotNull(), place).alias(name))


def pareto(df: DataFrame, best_high: str, best_low: str, key: str, part: str) -> DataFrame:
    """Within each part the rows that none beats in both: the greatest ``best_high`` so far, going up in ``best_low``."""
    w = Window.partitionBy(part).orderBy(F.col(best_low), F.col(best_high).desc(), F.col(key))
    top = F.max(best_high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_t", top).filter(F.col("_t").isNull() | (F.col(best_high) > F.col("_t"))).drop("_t")


def production_fit(df: DataFrame, y: str, inputs: list[str]) -> DataFrame:
    """log y on the inputs' logs by least squares: fitted, residual, and fitted scaled to 0..1. Moments in one aggregation, a k-by-k solve on the driver."""
    import numpy as np

    logs = df.select("*", F.log(y).alias("_y"), *[F.log(x).alias(f"_{x}") for x in inputs])
    xs = ["_one", *[f"_{x}" for x in inputs]]
    d = logs.withColumn("_one", F.lit(1.0))
    row = d.agg(*[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs], *[F.sum(F.col(a) * F.col("_y")) for a in xs]).first()
    k = len(xs)
    beta = np.linalg.pinv(np.array(row[: k * k], dtype=float).reshape(k, k)) @ np.array(row[k * k :], dtype=float)
    fitted = d.withColumn("fitted", reduce(lambda a, b: a + b, [F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)]))
    low, high = fitted.agg(F.min("fitted"), F.max("fitted")).first()
    scaled = (F.col("fitted") - F.lit(low)) / F.lit(high - low) if high is not None and high > low else F.lit(0.0)
    return fitted.select(*df.columns, "fitted", (F.col("_y") - F.col("fitted")).alias("residual"), scaled.alias("index"))


def principal_component(df: DataFrame, columns: list[str]) -> DataFrame:
    """First principal component of the standardised columns, signed so that the first weighs positive, rescaled to 0..100, and the variance it explains."""
    import numpy as np

    s = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    k = len(columns)
    z = [(F.col(c) - F.lit(s[i])) / F.lit(s[k + i] or 1.0) for i, c in enumerate(columns)]
    row = df.agg(*[F.avg(a * b) for a in z for b in z]).first()
    values, vectors = np.linalg.eigh(np.array(row, dtype=float).reshape(k, k))
    v = vectors[:, -1] * (1.0 if vectors[0, -1] >= 0 else -1.0)
    scored = df.withColumn("_s", reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(z, v, strict=True)]))
    low, high = scored.agg(F.min("_s"), F.max("_s")).first()
    return scored.select(*df.columns, ((F.col("_s") - F.lit(low)) * (100 / (high - low))).alias("component"), F.lit(float(values[-1] / values.sum())).alias("explained"))


def scheme_auc(panel: DataFrame, columns: list[str], schemes: dict[str, list[float]], share: float = 0.3) -> DataFrame:
    """For each scheme of weights: how well a small change of its composite tells (AUC) that the unit's next change is among the least ``share`` of all changes."""
    from tessella.operators.metrics import auc

    names = list(schemes)
    parts = [reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(columns, ws, strict=True)]).alias(n) for n, ws in schemes.items()]
    long = panel.select("unit", "t", *parts).select("unit", "t", F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, `{n}`' for n in names)}) AS (scheme, x)"))
    own = Window.partitionBy("scheme", "unit").orderBy("t")
    d = long.withColumn("d", F.col("x") - F.lag("x").over(own))
    cut = d.groupBy("scheme").agg(F.percentile("d", share).alias("cut"))
    d = d.withColumn("next", F.lead("d").over(own)).join(cut, "scheme").filter("d IS NOT NULL AND next IS NOT NULL").withColumn("stall", (F.col("next") <= F.col("cut")).cast("int"))
    return auc(d.withColumn("s", -F.col("d")), "stall", "s", "scheme").filter("scope <> 'all'").withColumnRenamed("scope", "scheme")
