"""Projection, reshaping and roll-up of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip, norm_key, safe_div


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each target from the first of its aliases that ``df`` has; null if none. Other columns stay."""
    picked = {target: next((a for a in names if a in df.columns), None) for target, names in aliases.items()}
    used = set(picked.values())
    rest = [c for c in df.columns if c not in used and c not in picked]
    return df.select(*rest, *[(F.col(a) if a else F.lit(None)).alias(t) for t, a in picked.items()])


def derive_period(df: DataFrame, candidates: list[str]) -> DataFrame:
    """year and month of the first candidate that reads as a date."""
    when = F.coalesce(*[F.expr(f"try_to_timestamp(CAST({c} AS STRING))") for c in candidates])
    return df.select("*", F.year(when).alias("year"), F.month(when).alias("month"))


def override_dim(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """All keys of both; the override's value wins where it has one."""
    o = override.select(key, *[F.col(c).alias(f"_{c}") for c in override.columns if c != key])
    joined = base.join(o, key, "full_outer")
    return joined.select(key, *[(F.coalesce(f"_{c}", c) if c in override.columns else F.col(c)).alias(c) for c in base.columns if c != key])


def densify(panel: DataFrame, units: DataFrame, low: int, high: int, unit: str = "unit", period: str = "t") -> DataFrame:
    """A row for each unit and period from ``low`` to ``high``; has_obs tells which were there."""
    grid = units.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(low), F.lit(high))).alias(period))
    return grid.join(panel.withColumn("has_obs", F.lit(1)), [unit, period], "left").fillna({"has_obs": 0})


def expand_snapshot(snapshot: DataFrame, low: int, high: int, period: str = "t") -> DataFrame:
    return snapshot.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(period))


def rollup(df: DataFrame, keys: list[Column | str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def seasonal_year_panel(panel: DataFrame) -> DataFrame:
    """Months (unit, t, value) to years: mean, sum, 90th percentile, months with a value, their share of 12, change of the mean."""
    years = panel.groupBy("unit", F.floor(F.col("t") / 12).cast("int").alias("year")).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("total"), F.percentile("value", 0.9).alias("p90"), F.count("value").alias("months")
    )
    own = Window.partitionBy("unit").orderBy("year")
    return years.select("*", F.least(F.lit(1.0), F.col("months") / 12).alias("coverage"), (F.col("months") > 0).cast("int").alias("has_obs"), (F.col("mean") - F.lag("mean").over(own)).alias("change"))


def intra_period_shape(panel: DataFrame) -> DataFrame:
    """In each year: slope of log(1 + value) on the month as recovery or decline, and how far the last month is below the peak."""
    month = F.col("t") % 12
    rows = panel.withColumn("year", F.floor(F.col("t") / 12).cast("int")).withColumn("l", F.log1p("value"))
    out = rows.groupBy("unit", "year").agg(F.regr_slope("l", month).alias("slope"), F.max("value").alias("peak"), F.max_by("value", "t").alias("last"))
    return out.select("unit", "year", F.greatest("slope", F.lit(0.0)).alias("recovery"), F.greatest(-F.col("slope"), F.lit(0.0)).alias("decline"), F.greatest(F.col("peak") - F.col("last"), F.lit(0.0)).alias("drop"))


def seasonal_anomaly(panel: DataFrame) -> DataFrame:
    """Value less the unit's mean of that month; difference to twelve rows before; yearly mean absolute anomaly and largest spike."""
    own = Window.partitionBy("unit").orderBy("t")
    rows = panel.select("unit", "t", "value", (F.col("value") - F.avg("value").over(Window.partitionBy("unit", F.col("t") % 12))).alias("anomaly"), (F.col("value") - F.lag("value", 12).over(own)).alias("diff12"))
    return rows.groupBy("unit", F.floor(F.col("t") / 12).cast("int").alias("year")).agg(F.avg(F.abs("anomaly")).alias("mean_abs"), F.max("anomaly").alias("spike"), F.avg("diff12").alias("mean_diff12"))


def stock_panel(panel: DataFrame, volume: str, area: str) -> DataFrame:
    """Density and its yearly changes, absolute and as a share."""
    own = Window.partitionBy("unit").orderBy("t")
    d = panel.withColumn("density", safe_div(F.col(volume), F.col(area)))
    return d.select("unit", "t", "density", (F.col("density") - F.lag("density").over(own)).alias("change"), (safe_div(F.col("density"), F.lag("density").over(own)) - 1).alias("growth"))


def history_panel(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column by unit and period, and its change to the row before."""
    own = Window.partitionBy("unit").orderBy("t")
    means = panel.groupBy("unit", "t").agg(*[F.avg(c).alias(c) for c in columns])
    return means.select("*", *[(F.col(c) - F.lag(c).over(own)).alias(f"{c}_yoy") for c in columns])


def diversity(counts: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Total and Shannon diversity of the amounts of each key; empty parts add nothing."""
    share = F.col(amount) / F.sum(amount).over(Window.partitionBy(*keys))
    rows = counts.withColumn("_s", F.when(F.col(amount) > 0, -share * F.log(share)).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.sum(amount).alias("total"), F.sum("_s").alias("diversity"))


def classify_tags(df: DataFrame, rules: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """Counts of rows by the first rule that holds, one column a class, other for none."""
    kind = F.lit("other")
    for name, rule in reversed(rules):
        kind = F.when(rule, name).otherwise(kind)
    rows = df.withColumn("_kind", kind)
    return rows.groupBy(*keys).agg(*[F.sum((F.col("_kind") == n).cast("long")).alias(n) for n in [*[r for r, _ in rules], "other"]])


def pivot_measures(df: DataFrame, keys: list[str], measure: str, values: list[str], amount: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(measure, values).agg(amount)


def collapse_sources(df: DataFrame, keys: list[str], priority: str, columns: list[str]) -> DataFrame:
    """One row a key: best (least) priority, then the most values, then the least values."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    order = Window.partitionBy(*keys).orderBy(priority, filled.desc(), *columns)
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def collapse_columns(df: DataFrame, keys: list[str], priority: str, columns: list[str]) -> DataFrame:
    """Each column's value of the highest priority that has one; of several, the largest."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(priority, F.col(c).alias("v"))))["v"].alias(c) for c in columns])


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def attach_id_by_name(df: DataFrame, dim: DataFrame, name: str, dim_name: str, dim_id: str) -> DataFrame:
    """The dimension's id where lower-cased, trimmed names agree; the dimension's least id if several do."""
    ids = dim.groupBy(F.lower(F.trim(dim_name)).alias("_k")).agg(F.min(dim_id).alias(dim_id))
    return df.withColumn("_k", F.lower(F.trim(name))).join(ids, "_k", "left").drop("_k")


def with_norm_key(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("key", norm_key(F.col(name)))


def balanced_sample(df: DataFrame, n: int, group: str, stratum: str, key: str) -> DataFrame:
    """``n`` rows: round-robin over strata inside each group; groups by the share of them already taken, then place, then name."""
    inner = Window.partitionBy(group, stratum).orderBy(key)
    turn = df.withColumn("_turn", F.row_number().over(inner))
    placed = turn.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy("_turn", stratum, key))).withColumn("_size", F.count("*").over(Window.partitionBy(group)))
    return placed.orderBy((F.col("_place") - 1) / F.col("_size"), "_place", group).limit(n).drop("_turn", "_place", "_size")


def ratio_features(df: DataFrame, amount: str, count: str) -> DataFrame:
    per = safe_div(F.col(amount), F.col(count).cast("double"))
    return df.select("*", F.log1p(amount).alias("log_amount"), per.alias("per_item"), F.exp(-F.abs(F.log1p(per) - 11.5)).alias("comfort"))


def surge_flag(panel: DataFrame, threshold: float = 0.3) -> DataFrame:
    """1 for units any of whose period growths passes the threshold."""
    growth = safe_div(F.col("value"), F.lag("value").over(Window.partitionBy("unit").orderBy("t"))) - 1
    return panel.withColumn("_g", growth).groupBy("unit").agg(F.max(F.when(F.col("_g") > threshold, 1).otherwise(0)).alias("surge"), F.max("_g").alias("top_growth"))


def split_growth(panel: DataFrame, share: Column) -> DataFrame:
    """Growth (clipped to -0.5..1) split by a share into a main and a local part."""
    growth = clip(safe_div(F.col("value"), F.lag("value").over(Window.partitionBy("unit").orderBy("t"))) - 1, -0.5, 1.0)
    return panel.select("unit", "t", growth.alias("growth"), (growth * share).alias("main"), (growth * (1 - share)).alias("local"))


def grid_bin(points: DataFrame, x: Column, y: Column, step: float, kinds: dict[str, Column]) -> DataFrame:
    """Counts of points in cells of a regular grid, in all and by kind."""
    cells = points.groupBy(F.floor(y / step).cast("int").alias("row"), F.floor(x / step).cast("int").alias("col"))
    return cells.agg(F.count("*").alias("n"), *[F.sum(k.cast("long")).alias(name) for name, k in kinds.items()])


def collapse_to_cluster(panel: DataFrame, cluster: str, means: list[str], sums: list[str]) -> DataFrame:
    return panel.groupBy(cluster, "t").agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums], F.countDistinct("unit").alias("units"))


def explode_refs(df: DataFrame, key: str, refs: Column, separator: str) -> DataFrame:
    """Packed references to one row each, with their place (from 1); empty ones are dropped."""
    parts = F.filter(F.transform(F.split(refs, separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.posexplode(parts).alias("place", "ref")).withColumn("place", F.col("place") + 1)


def unique_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on keys that occur once on either side."""
    one = lambda df, k: df.join(df.groupBy(k).count().filter("count = 1").select(k), k, "left_semi")
    return one(left, left_key).join(one(right, right_key), F.col(left_key) == F.col(right_key))


def connectivity_panel(routes: DataFrame, low: int, high: int) -> DataFrame:
    """Flow out of each unit and its number of partners, in every period from ``low`` to ``high``."""
    return expand_snapshot(routes.groupBy(F.col("src").alias("unit")).agg(F.sum("w").alias("flow"), F.countDistinct("dst").alias("partners")), low, high)


def sourced_means(df: DataFrame, value: str, source: str) -> DataFrame:
    """Mean by unit and period, filled both ways over the unit's periods, with the period's source or interpolated."""
    from tessella.operators.imputation import interpolate

    g = df.groupBy("unit", "t").agg(F.avg(value).alias("value"), F.min(source).alias("source"))
    filled = interpolate(g, "value")
    return filled.select("unit", "t", F.col("filled").alias("value"), F.when(F.col("value").isNotNull(), F.col("source")).otherwise("interpolated").alias("source"))
