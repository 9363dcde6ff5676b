"""Hold-outs, forecasts and fusion. Linear models come from moments by key; predictions and their errors stay in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import keyed_draw, poisson_weight
from tessella.operators.estimators import by_key, grams, linear, solved


def errors(y: str, p: str, name: str) -> list[Column]:
    """Aggregates: rmse, mae and r2 of a prediction."""
    e = F.col(p) - F.col(y)
    return [F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"), F.avg(F.abs(e)).alias(f"{name}_mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias(f"{name}_r2")]


def lead_target(panel: DataFrame, y: str) -> DataFrame:
    """Rows with target, the unit's next value of ``y``."""
    return panel.withColumn("target", F.lead(y).over(Window.partitionBy("unit").orderBy("t")))


def prospective(panel: DataFrame, y: str, xs: list[str], least_periods: int = 2) -> DataFrame:
    """By period t from the ``least_periods``-th on: errors of next-period forecasts by a linear model of the periods before t, the training mean, and the
    present value, with the share of right directions. Moments by period are added up, so each row is read once however many origins there are."""
    rows = lead_target(panel, y).na.drop(subset=["target", *xs])
    by_t = grams(rows, [*xs, "target"], "t")
    times, betas, means, n_train, total = sorted(by_t), {}, {}, {}, 0
    for i, t in enumerate(times):
        if i >= least_periods:
            betas[t], means[t], n_train[t] = solved(total), np.array([total[0, -1] / total[0, 0]]), int(total[0, 0])
        total = total + by_t[t]
    found = rows.filter(F.col("t").isin(list(betas))).withColumn("linear", by_key(betas, xs, "t")).withColumn("mean", by_key(means, [], "t"))
    count = F.lit(None).cast("long")
    for t, n in n_train.items():
        count = F.when(F.col("t") == t, n).otherwise(count)
    right = F.avg((F.signum(F.col("linear") - F.col(y)) == F.signum(F.col("target") - F.col(y))).cast("double"))
    g = found.withColumn("n_train", count).groupBy("t", "n_train")
    return g.agg(F.count("*").alias("n_test"), *errors("target", "linear", "linear"), *errors("target", "mean", "mean"), *errors("target", y, "persistence"), right.alias("directional"))


def temporal_holdout(panel: DataFrame, y: str, feature_sets: dict[str, list[str]], split: int) -> DataFrame:
    """By feature set: rows, rmse, mae and r2 after ``split`` of linear models of the rows up to it, and each set's rmse less the best one's."""
    rows, out = lead_target(panel, y).filter("target IS NOT NULL"), None
    for name, xs in feature_sets.items():
        d = rows.na.drop(subset=xs)
        gram = grams(d.filter(F.col("t") <= split).withColumn("_k", F.lit(0)), [*xs, "target"], "_k").get(0)
        if gram is None:
            continue
        tested = d.filter(F.col("t") > split).withColumn("p", linear(solved(gram), xs)).agg(F.lit(name).alias("features"), F.count("*").alias("n_test"), *errors("target", "p", "linear"))
        out = tested if out is None else out.union(tested)
    return out.withColumn("rmse_over_best", F.col("linear_rmse") - F.min("linear_rmse").over(Window.partitionBy()))  # a row for each set


def spatial_holdout(panel: DataFrame, y: str, xs: list[str], group: str) -> DataFrame:
    """By group: errors in it of the linear model of all other groups."""
    rows = lead_target(panel, y).na.drop(subset=["target", *xs])
    by_group = grams(rows, [*xs, "target"], group)
    total = sum(by_group.values())
    d = rows.withColumn("p", by_key({g: solved(total - m) for g, m in by_group.items()}, xs, group))
    return d.groupBy(F.col(group).alias("left_out")).agg(F.count("*").alias("n_test"), *errors("target", "p", "linear"))


def transfer_matrix(panel: DataFrame, y: str, xs: list[str], group: str) -> DataFrame:
    """By training and test group, not the same: errors of the one's linear model in the other."""
    rows = lead_target(panel, y).na.drop(subset=["target", *xs])
    betas = {g: solved(m) for g, m in grams(rows, [*xs, "target"], group).items()}
    each = rows.withColumn("trained_on", F.explode(F.lit(sorted(betas)))).filter(F.col("trained_on") != F.col(group))
    d = each.withColumn("p", by_key(betas, xs, "trained_on"))
    return d.groupBy("trained_on", F.col(group).alias("tested_on")).agg(F.count("*").alias("n_test"), *errors("target", "p", "linear"))


def logistic(df: DataFrame, y: str, xs: list[str], weight: Column | None = None, rounds: int = 8, ridge: float = 1e-6) -> np.ndarray:
    """Coefficients (the constant first) of a weighted logistic regression by Newton steps: one aggregation of moments a step."""
    names = ["_one", *xs]
    d = df.withColumn("_one", F.lit(1.0)).withColumn("_w", weight if weight is not None else F.lit(1.0)).select(F.col(y).cast("double").alias("_y"), "_w", *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    beta = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-linear(beta, xs)))
        v = d.withColumn("_p", p).withColumn("_v", F.col("_w") * F.col("_p") * (1 - F.col("_p")))
        row = v.agg(*[F.sum(F.col("_v") * F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * F.col(c)) for c in names]).first()
        hess = np.zeros((len(names), len(names)))
        for (i, j), h in zip(pairs, row, strict=False):
            hess[i, j] = hess[j, i] = h or 0.0
        step = np.linalg.solve(hess + ridge * np.eye(len(names)), np.array([g or 0.0 for g in row[len(pairs) :]]) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def balanced_weights(df: DataFrame, y: str) -> Column:
    """Weights that give both classes half of the total."""
    n, pos = df.agg(F.count(y), F.sum(y)).first()
    pos = pos or 0
    return F.when(F.col(y) == 1, F.lit(n / (2 * max(pos, 1)))).otherwise(F.lit(n / (2 * max(n - pos, 1))))


def trained_classifier(train: DataFrame, test: DataFrame, y: str, candidates: dict[str, list[str]]) -> DataFrame:
    """By candidate feature set: AUC and Brier score on ``test`` of a balanced logistic model of ``train``, the objective AUC - 0.15 Brier, and whether it is the best."""
    from tessella.operators.metrics import auc

    out = None
    for name, xs in candidates.items():
        d = test.withColumn("p", 1 / (1 + F.exp(-linear(logistic(train, y, xs, balanced_weights(train, y)), xs))))
        row = auc(d, y, "p").select(F.lit(name).alias("features"), "auc").join(d.agg(F.avg(F.pow(F.col("p") - F.col(y), 2)).alias("brier")), F.lit(True))  # one row each
        out = row if out is None else out.union(row)
    out = out.withColumn("objective", F.col("auc") - 0.15 * F.col("brier"))
    return out.withColumn("best", (F.rank().over(Window.orderBy(F.col("objective").desc())) == 1).cast("int"))  # a row for each candidate


def platt(calibration: DataFrame, df: DataFrame, y: str, score: str) -> DataFrame:
    """``df`` with p, its score through a one-feature logistic model of ``calibration``."""
    return df.withColumn("p", 1 / (1 + F.exp(-linear(logistic(calibration, y, [score]), [score]))))


def prior_shrinkage(df: DataFrame, test: DataFrame, y: str, p: str, group: str, strengths: list[float], mix: float = 0.5) -> DataFrame:
    """By strength k: the Brier score on ``test`` of (1 - ``mix``) p + ``mix`` times the group's rate, shrunk to the overall rate as if that had been seen in k more rows."""
    rate = df.agg(F.avg(y).alias("r"))
    g = df.groupBy(group).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    each = g.join(rate, F.lit(True)).withColumn("strength", F.explode(F.lit([float(k) for k in strengths])))  # one row
    priors = each.select(group, "strength", ((F.col("s") + F.col("strength") * F.col("r")) / (F.col("n") + F.col("strength"))).alias("prior"))
    d = test.join(priors, group).withColumn("q", (1 - mix) * F.col(p) + mix * F.col("prior"))
    return d.groupBy("strength").agg(F.count("*").alias("n_test"), F.avg(F.pow(F.col("q") - F.col(y), 2)).alias("brier"))


def fusion_grid(df: DataFrame, y: str, a: str, b: str, steps: int = 10) -> DataFrame:
    """By weight of ``a`` in steps from 0 to 1: AUC and Brier score of the mean of the two scores, the objective AUC - 0.15 Brier, and whether it is the best (ties: the least weight)."""
    from tessella.operators.metrics import auc

    each = df.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("f", (F.col("w") * F.col(a) + (steps - F.col("w")) * F.col(b)) / steps)
    scored = auc(each.withColumn("scope_", F.col("w").cast("string")), y, "f", "scope_").filter("scope <> 'all'").select(F.col("scope").cast("int").alias("w"), "auc")
    brier = each.groupBy("w").agg(F.avg(F.pow(F.col("f") - F.col(y), 2)).alias("brier"))
    out = scored.join(brier, "w").withColumn("objective", F.col("auc") - 0.15 * F.col("brier"))
    return out.withColumn("best", (F.row_number().over(Window.orderBy(F.round("objective", 9).desc(), "w")) == 1).cast("int"))  # a row for each step


def blend_grid(df: DataFrame, y: str, a: str, b: str, dev: Column, steps: int = 10) -> DataFrame:
    """By weight of ``a``: rmse of the blend on the rows of ``dev`` and on the others; chosen is the weight of least rmse on ``dev``."""
    each = df.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("dev", dev)
    e = (F.col("w") * F.col(a) + (steps - F.col("w")) * F.col(b)) / steps - F.col(y)
    g = each.groupBy("w").agg(F.sqrt(F.avg(F.when(F.col("dev"), e * e))).alias("dev_rmse"), F.sqrt(F.avg(F.when(~F.col("dev"), e * e))).alias("test_rmse"))
    return g.withColumn("chosen", (F.row_number().over(Window.orderBy(F.round("dev_rmse", 9), "w")) == 1).cast("int"))  # a row for each step


def rolling_forecasts(panel: DataFrame, y: str, ridge: float = 1.0, least: int = 5) -> DataFrame:
    """unit, t, actual, naive (the last value) and ar: the forecast for t by a ridge regression of the unit's values on the ones before, over all pairs up to the origin."""
    own = Window.partitionBy("unit").orderBy("t")
    d = panel.select("unit", "t", F.col(y).alias("v"), F.lag(y).over(own).alias("x")).filter("x IS NOT NULL")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    n, sx, sy = F.count("*").over(past), F.sum("x").over(past), F.sum("v").over(past)
    sxx, sxy = F.sum(F.col("x") * F.col("x")).over(past), F.sum(F.col("x") * F.col("v")).over(past)
    slope = (sxy - sx * sy / n) / (sxx - sx * sx / n + ridge)
    d = d.withColumn("n", n).withColumn("slope", slope).withColumn("mx", sx / n).withColumn("my", sy / n).filter(F.col("n") >= least)
    return d.select("unit", "t", F.col("v").alias("actual"), F.col("x").alias("naive"), (F.col("my") + F.col("slope") * (F.col("x") - F.col("mx"))).alias("ar"))


def bootstrap_brier_gain(df: DataFrame, y: str, a: str, b: str, key: str, draws: int = 200) -> DataFrame:
    """One row: Brier score of ``b`` less that of ``a`` (above 0: a is better), its 95 % interval and two-sided sign p over resamples of rows with Poisson weights by keyed draws.

    Rows are dealt to 64 slices by a draw and a slice's weighted sums travel, so each draw is one partial aggregation.
    """
    d = df.select(F.col(key), (F.pow(F.col(b) - F.col(y), 2) - F.pow(F.col(a) - F.col(y), 2)).alias("g")).na.drop()
    point = d.agg(F.avg("g").alias("gain"), F.count("*").alias("n"))
    each = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    weight = poisson_weight(keyed_draw(F.col("draw"), F.col(key)))
    null = each.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("g")) / F.nullif(F.sum("w"), F.lit(0))).alias("b"))
    share = lambda c: F.avg(c.cast("double"))
    ci = null.agg(F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("b") <= 0), share(F.col("b") >= 0))).alias("p"))
    return point.join(ci, F.lit(True))  # one row each


def permutation_importance(df: DataFrame, y: str, betas: dict[str, float], key: str) -> DataFrame:
    """By feature of a linear score: the AUC lost when the feature's values are dealt anew over the rows, by keyed draws. Rows meet their new value by place in the order of the draw."""
    from tessella.functions.columns import numbered
    from tessella.operators.metrics import auc

    score = lambda cols: sum((F.col(c) * float(b) for c, b in cols), F.lit(0.0))
    base = auc(df.withColumn("p", score(betas.items())), y, "p").select(F.col("auc").alias("base"))
    out = None
    for feature in betas:
        a = numbered(df.select(key, y, *betas), keyed_draw(F.lit("rows"), F.col(key)), key, "_i")
        b = numbered(df.select(F.col(key).alias("_k"), F.col(feature).alias("_v")), keyed_draw(F.lit(feature), F.col("_k")), "_k", "_i")
        d = a.join(b, "_i").withColumn("p", score([("_v" if c == feature else c, w) for c, w in betas.items()]))
        row = auc(d, y, "p").join(base, F.lit(True)).select(F.lit(feature).alias("feature"), (F.col("base") - F.col("auc")).alias("auc_drop"))  # one row each
        out = row if out is None else out.union(row)
    return out
