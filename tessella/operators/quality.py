"""Provenance, coverage and evidence quality."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import zscore


def source_masks(df: DataFrame, allowed: dict[str, list[str]], verified: dict[str, list[str]]) -> DataFrame:
    """is_objective and is_verified: every source column is on its list; a null source is on none."""
    both = lambda lists: F.forall(F.array(*[F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in lists.items()]), lambda x: x).cast("int")
    return df.select("*", both(allowed).alias("is_objective"), both(verified).alias("is_verified"))


def strict_filter(masked: DataFrame, least_retention: float) -> DataFrame:
    """Rows of units all of whose rows are verified, if that keeps ``least_retention`` of the units; else of units all objective."""
    units = masked.groupBy("unit").agg(F.min("is_objective").alias("o"), F.min("is_verified").alias("v"))
    kept = units.agg(F.avg(F.col("v").cast("double"))).first()[0] or 0.0
    good = units.filter("v = 1" if kept >= least_retention else "o = 1").select("unit")
    return masked.join(good, "unit", "left_semi")


def source_combinations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*[F.coalesce(F.col(c), F.lit("missing")).alias(c) for c in columns]).agg(F.count("*").alias("n"))


def coverage(panel: DataFrame, periods: int) -> DataFrame:
    """Units, rows, expected rows and their ratio by group and in total (grp null)."""
    g = panel.groupingSets([("grp",), ()], "grp").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("rows"))
    return g.select("*", (F.col("units") * periods).alias("expected"), (F.col("rows") / (F.col("units") * periods)).alias("ratio"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics (metric, value) against thresholds (metric, threshold, direction max or min): passed and gap ratio."""
    j = metrics.join(thresholds, "metric")
    ok = F.when(F.col("direction") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return j.select("metric", "value", "threshold", "direction", ok.cast("int").alias("passed"), F.when(F.col("threshold") != 0, (F.col("value") - F.col("threshold")) / F.abs("threshold")).alias("gap"))


def measurement_audit(df: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """Presence of each channel, how many are there, and a tier."""
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(f"has_{n}") for n, c in channels.items()]
    d = df.select("*", *flags)
    n = sum((F.col(f"has_{c}") for c in channels), F.lit(0))
    return d.select("*", n.alias("channels"), F.when(n == len(channels), "full").when(n >= 2, "partial").when(n == 1, "thin").otherwise("none").alias("tier"))


def signal_consistency(df: DataFrame, signals: list[str]) -> DataFrame:
    """z of each signal in the period, their spread, and the share of signal pairs of one sign, from counts of signs."""
    w = Window.partitionBy("t")
    z = df.select("unit", "t", *[zscore(F.col(s), w).alias(s) for s in signals])
    arr = F.array(*[F.col(s) for s in signals])
    count = lambda cond: F.size(F.filter(arr, cond)).cast("double")
    plus, minus = count(lambda x: x > 0), count(lambda x: x < 0)
    zero, n = count(lambda x: x == 0), count(lambda x: x.isNotNull())
    pairs = lambda k: k * (k - 1) / 2
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n
    spread = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(F.pow(x - mean, F.lit(2)), F.lit(0.0))) / n)
    agree = F.when(n >= 2, (pairs(plus) + pairs(minus) + pairs(zero)) / pairs(n))
    out = z.select("unit", "t", spread.alias("dispersion"), agree.alias("agreement"))
    return out.withColumn("band", F.when(F.col("agreement") >= 0.99, "consistent").when(F.col("agreement") >= 0.3, "mixed").otherwise("conflicting"))


def signal_pairs(df: DataFrame, signals: list[str]) -> DataFrame:
    """For each pair of signals: rows with both, correlation, share of equal signs. One aggregation over the rows."""
    stats = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"), F.corr(a, b).alias("corr"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("same_sign"))
        for a, b in combinations(signals, 2)
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    names = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    return df.select(F.expr(f"stack({len(columns)}, {names}) AS (column, value)")).groupBy("column", F.coalesce("value", F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))


def incomplete_units(panel: DataFrame, units: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Units that lack a value in any period from ``low`` to ``high``."""
    done = panel.filter(F.col("t").between(low, high) & F.col(value).isNotNull()).groupBy("unit").agg(F.countDistinct("t").alias("n")).filter(F.col("n") == high - low + 1)
    return units.select("unit").distinct().join(done, "unit", "left_anti")
