"""Ranking, calibration and regression metrics, resampling by keyed draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import keyed_draw, numbered, poisson_weight, sums_before


def auc(df: DataFrame, y: str, p: str, group: str | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties half, overall (scope all) and by group; distinct scores are counted first."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    scoped = rows.select(F.explode(F.array(F.lit("all"), *([F.col(group)] if group else []))).alias("scope"), F.col(p).alias("_p"), F.col(y).alias("_y"))
    by = scoped.groupBy("scope", "_p").agg(F.sum("_y").alias("pos"), (F.count("*") - F.sum("_y")).alias("neg"))
    by = sums_before(by, F.col("_p"), ["neg"], ("scope",)).withColumnRenamed("before_neg", "below")
    return by.groupBy("scope").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Average precision over distinct scores, and the lift of the rows from the 90 % quantile of the score on."""
    by = df.groupBy(F.col(p).alias("_p")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    by = sums_before(by, -F.col("_p"), ["pos", "n"]).select("pos", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_n") + F.col("n")).alias("k"))
    ap = by.agg((F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos")).alias("average_precision"))
    cut = df.agg(F.percentile(p, 0.9)).first()[0]
    lift = df.agg((F.avg(F.when(F.col(p) >= F.lit(cut), F.col(y))) / F.avg(y)).alias("top_lift"))
    return ap.join(lift, F.lit(True))  # one row each


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the score: rows, mean score, rate, gap."""
    edges = df.agg(F.array_distinct(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)])))).first()[0] or []
    bin_ = sum(((F.col(p) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    g = df.withColumn("bin", bin_).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    brier = df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))
    table = calibration(df, y, p, bins)
    return table.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce")).join(brier, F.lit(True))  # one row each


def regression_metrics(df: DataFrame, y: str, p: str, naive: str, group: str) -> DataFrame:
    """rmse, mae, r2, share of right directions against the naive value, skill over it; overall (null) and by group."""
    e, b = F.col(p) - F.col(y), F.col(naive) - F.col(y)
    g = df.groupingSets([(group,), ()], group).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0))).alias("r2"),
        F.avg((F.signum(F.col(p) - F.col(naive)) == F.signum(F.col(y) - F.col(naive))).cast("double")).alias("directional"), (1 - F.sqrt(F.avg(e * e)) / F.nullif(F.sqrt(F.avg(b * b)), F.lit(0))).alias("skill"),
    )
    return g


def group_gaps(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """By group: rows, rate, mean score, Brier score, and each one's gap to all rows."""
    one = lambda d, *k: d.groupBy(*k).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.avg(p).alias("mean_p"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))
    total = one(df).first()
    return one(df, group).select("*", *[(F.col(c) - F.lit(total[c])).alias(f"{c}_gap") for c in ("rate", "mean_p", "brier")])


def decision_curve(df: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Net benefit of acting above each threshold, and of acting always."""
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.sum(F.when(F.col(p) >= t, F.col(y)).otherwise(0)).alias("tp"), F.sum(F.when(F.col(p) >= t, 1 - F.col(y)).otherwise(0)).alias("fp")) for t in thresholds])
    rows = df.agg(each.alias("x"), F.count("*").alias("n"), F.sum(y).alias("pos")).select("n", "pos", F.explode("x").alias("x")).select("n", "pos", "x.*")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return rows.select("threshold", ((F.col("tp") - F.col("fp") * odds) / F.col("n")).alias("net_benefit"), ((F.col("pos") - (F.col("n") - F.col("pos")) * odds) / F.col("n")).alias("act_always"))


def decile_table(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Ten equal runs of rows by falling score: rows, rate, lift. Places come from counts by distinct score, so rows of one score share a decile."""
    by = df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    total = df.agg(F.count("*"), F.avg(y)).first()
    d = sums_before(by, -F.col("_p"), ["n"]).withColumn("decile", F.floor(F.col("before_n") * 10 / F.lit(total[0])).cast("int") + 1)
    return d.groupBy("decile").agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("rate")).withColumn("lift", F.col("rate") / F.lit(total[1]))


def bh_adjust(df: DataFrame, p: str, family: str, key: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p in each family."""
    rank = F.row_number().over(Window.partitionBy(family).orderBy(p, key))
    r = df.withColumn("_r", rank).withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy(family)) / F.col("_r"))
    up = Window.partitionBy(family).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_q").over(up))).drop("_r", "_q")


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, draws: int) -> DataFrame:
    """Mean of ``value`` in each of ``draws`` resamples of clusters: cluster sums first, then Poisson(1) weights by keyed draw."""
    sums = df.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    d = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weight = poisson_weight(keyed_draw(F.col("draw"), F.col("c")))
    w = d.withColumn("w", weight)
    return w.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("mean"))


def off_policy(df: DataFrame, reward: str, action: str, chosen: str, propensity: str, group: str, clip: float = 10.0) -> DataFrame:
    """By group: logged value, inverse propensity value, its self-normalised and clipped forms, effective sample size."""
    w = F.when(F.col(action) == F.col(chosen), 1 / F.col(propensity)).otherwise(0.0)
    d = df.withColumn("_w", w)
    clipped = F.least("_w", F.lit(clip))
    return d.groupBy(group).agg(F.avg(reward).alias("logged"), F.avg(F.col("_w") * F.col(reward)).alias("ips"), (F.sum(F.col("_w") * F.col(reward)) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("snips"), F.avg(clipped * F.col(reward)).alias("clipped"), (F.pow(F.sum("_w"), F.lit(2)) / F.nullif(F.sum(F.col("_w") * F.col("_w")), F.lit(0.0))).alias("ess"))


def conformal_intervals(calibration: DataFrame, test: DataFrame, y: str, p: str, alpha: float = 0.1) -> DataFrame:
    """``test`` with split-conformal bounds: p plus and minus the (1 - alpha)(1 + 1/n) quantile of the calibration's absolute residuals."""
    n = calibration.count()
    q = calibration.agg(F.percentile(F.abs(F.col(y) - F.col(p)), min(1.0, (1 - alpha) * (1 + 1 / max(n, 1))))).first()[0]
    return test.select("*", (F.col(p) - F.lit(q)).alias("low"), (F.col(p) + F.lit(q)).alias("high"), F.col(y).between(F.col(p) - F.lit(q), F.col(p) + F.lit(q)).cast("int").alias("inside"))


def threshold_sensitivity(df: DataFrame, value: str, p: str, quantiles: list[float]) -> DataFrame:
    """The AUC of a score for events below each quantile of a value."""
    cuts = df.agg(F.percentile(value, F.array(*map(F.lit, quantiles)))).first()[0]
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(float(c)).alias("cut")) for q, c in zip(quantiles, cuts, strict=True)]))
    long = df.select(p, value, each.alias("c")).select(F.col("c.q").cast("string").alias("quantile"), (F.col(value) <= F.col("c.cut")).cast("int").alias("event"), p)
    return auc(long, "event", p, "quantile").filter("scope <> 'all'").withColumnRenamed("scope", "quantile")


def permutation_p(df: DataFrame, value: str, treated: str, unit: str, draws: int) -> DataFrame:
    """Difference in means of treated and other units, and the share of keyed reorderings of the units' treatment at least as far from 0."""
    u = df.select(unit, value, treated)
    seen = u.agg((F.avg(F.when(F.col(treated) == 1, F.col(value))) - F.avg(F.when(F.col(treated) == 0, F.col(value)))).alias("diff"), F.sum(treated).alias("k"))
    k = seen.first()["k"]
    d = u.select(unit, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    placed = numbered(d, keyed_draw(F.col("draw"), F.col(unit)), unit, "_r", ("draw",))
    null = placed.groupBy("draw").agg((F.avg(F.when(F.col("_r") <= k, F.col(value))) - F.avg(F.when(F.col("_r") > k, F.col(value)))).alias("d"))
    return null.join(seen, F.lit(True)).groupBy("diff").agg(F.avg((F.abs("d") >= F.abs("diff")).cast("double")).alias("p"))  # one row


def paired_delta(df: DataFrame, y: str, a: str, b: str, scope: str, draws: int) -> DataFrame:
    """By scope: mean gain in absolute error of b over a, and its share above 0 in resamples with Poisson weights of keyed draws by row id."""
    d = df.withColumn("_d", F.abs(F.col(a) - F.col(y)) - F.abs(F.col(b) - F.col(y)))
    mean = d.groupBy(scope).agg(F.avg("_d").alias("gain"), F.count("*").alias("n"))
    boots = d.select(scope, "id", "_d", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weight = poisson_weight(keyed_draw(F.col("draw"), F.col("id")))
    parts = boots.withColumn("w", weight).groupBy(scope, "draw").agg((F.sum(F.col("w") * F.col("_d")) / F.nullif(F.sum("w"), F.lit(0))).alias("g"))
    share = parts.groupBy(scope).agg(F.avg((F.col("g") > 0).cast("double")).alias("share_better"))
    return mean.join(share, scope)


def doubly_robust_value(df: DataFrame, reward: str, action: str, chosen: str, propensity: str, group: str) -> DataFrame:
    """By group: the value of the chosen actions by the mean reward of each (group, action), corrected by the weighted error where the logged action is the chosen one."""
    means = df.groupBy(F.col(group).alias("_g"), F.col(action).alias("_a")).agg(F.avg(reward).alias("m"))
    side = lambda c, name: means.select(F.col("_g").alias(f"_g{name}"), F.col("_a").alias(f"_a{name}"), F.col("m").alias(name))
    d = df.join(side(chosen, "mc"), (F.col(group) == F.col("_gmc")) & (F.col(chosen) == F.col("_amc")), "left").join(side(action, "ma"), (F.col(group) == F.col("_gma")) & (F.col(action) == F.col("_ama")), "left")
    overall = F.coalesce("mc", F.lit(0.0))
    hit = F.when(F.col(action) == F.col(chosen), (F.col(reward) - F.col("ma")) / F.col(propensity)).otherwise(0.0)
    return d.groupBy(group).agg(F.avg(overall + hit).alias("dr"), F.count("*").alias("n"))


def paired_interval(df: DataFrame, y: str, a: str, b: str, naive: str, scope: str, draws: int = 200) -> DataFrame:
    """By scope, and over all rows (scope all): mean gain in absolute error of b over a, its 95 % interval and two-sided sign p over resamples with Poisson weights of keyed draws by row id,
    and b's gain in the share of right directions against ``naive``."""
    right = lambda c: (F.signum(F.col(c) - F.col(naive)) == F.signum(F.col(y) - F.col(naive))).cast("double")
    d = df.select("id", F.explode(F.array(F.lit("all"), F.col(scope).cast("string"))).alias("scope"), (F.abs(F.col(a) - F.col(y)) - F.abs(F.col(b) - F.col(y))).alias("g"), (right(b) - right(a)).alias("s"))
    mean = d.groupBy("scope").agg(F.avg("g").alias("gain"), F.avg("s").alias("direction_gain"), F.count("*").alias("n"))
    weight = poisson_weight(keyed_draw(F.col("draw"), F.col("id")))
    boots = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    parts = boots.groupBy("scope", "draw").agg((F.sum(F.col("w") * F.col("g")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    share = lambda c: F.avg(c.cast("double"))
    ci = parts.groupBy("scope").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))).alias("p"))
    return mean.join(ci, "scope")


def capped_intervals(calibration: DataFrame, test: DataFrame, y: str, p: str, alpha: float = 0.1, caps: tuple[float, ...] = (1.0, 0.45, 0.4, 0.35, 0.3, 0.25)) -> DataFrame:
    """``test`` with conformal bounds low and high of a probability: residuals are scaled by sqrt(p (1 - p)), their (1 - alpha) quantile is at most 4, and half the width is at most the
    cap of largest coverage less .33 of the mean width on the calibration rows (ties: the earlier cap). cap is given too."""
    scale = lambda: F.sqrt(F.least(F.greatest(F.col(p) * (1 - F.col(p)), F.lit(1e-3)), F.lit(0.25)))
    q = calibration.agg(F.percentile(F.abs(F.col(y) - F.col(p)) / scale(), 1 - alpha)).first()[0]
    q = min(max(q or 0.0, 0.0), 4.0)
    bound = lambda cap, sign: F.least(F.greatest(F.col(p) + sign * F.least(F.lit(q) * scale(), cap), F.lit(0.0)), F.lit(1.0))
    each = calibration.select(y, p, F.explode(F.lit(list(caps))).alias("cap"))
    low, high = bound(F.col("cap"), -1), bound(F.col("cap"), 1)
    tried = each.groupBy("cap").agg((F.avg(F.col(y).between(low, high).cast("double")) - 0.33 * F.avg(high - low)).alias("s")).collect()
    score = {r.cap: round(r.s, 12) for r in tried}
    best = max(caps, key=lambda c: (score.get(c, 0.0), -caps.index(c)))
    return test.select("*", bound(F.lit(best), -1).alias("low"), bound(F.lit(best), 1).alias("high"), F.lit(best).alias("cap"))
