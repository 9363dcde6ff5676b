"""Nowcasts of many series at once: harmonic regressions on the moments of every prefix, blended with a smoothed trend."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Candidate periods of the harmonics: 2 to 6.75 in quarters.
PERIODS = [2 + i / 4 for i in range(20)]
#: Share of the harmonic forecast, weight of the last change in the trend, ridge; least rows before a blended forecast, least values of a series; fixed values.
HARMONIC, LAST_CHANGE, RIDGE, FIRST, LEAST = 0.68, 0.24, 1.2, 5, 4
#: Weights of direction and error in the choice of a period; least standard errors of forecast and change; chance and lead that a signal takes; fixed values.
CHOICE, LEAST_ERROR, LEAST_SPREAD, CHANCE, LEAD = (0.78, 0.22), 0.8, 0.5, 0.45, 0.10
#: Terms of the regression: constant, line, two harmonics.
TERMS = 6
_UPPER = [(i, j) for i in range(TERMS) for j in range(i, TERMS)]


def basis(x: Column, period: Column) -> list[Column]:
    angle = 2 * math.pi * x / period
    return [F.lit(1.0), x, F.sin(angle), F.cos(angle), F.sin(2 * angle), F.cos(2 * angle)]


@pandas_udf(DoubleType())
def forecast(moments: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
    """Ridge forecasts, the constant free, from the sums of products of ``n`` rows and of products with y, all solved together; with fewer rows than terms the smallest exact fit."""
    if not len(n):
        return pd.Series([], dtype=float)
    m, x = np.stack(moments.to_numpy()), np.stack(at.to_numpy())
    gram = np.zeros((len(m), TERMS, TERMS))
    for k, (i, j) in enumerate(_UPPER):
        gram[:, i, j] = gram[:, j, i] = m[:, k]
    right, few = m[:, len(_UPPER) :], n.to_numpy() < TERMS
    beta = np.zeros((len(m), TERMS))
    if few.any():
        beta[few] = np.einsum("nij,nj->ni", np.linalg.pinv(gram[few], rcond=1e-11, hermitian=True), right[few])
    if not few.all():
        ridge = RIDGE * np.diag([0.0] + [1.0] * (TERMS - 1))
        beta[~few] = np.linalg.solve(gram[~few] + ridge, right[~few][:, :, None])[:, :, 0]
    return pd.Series((beta * x).sum(axis=1))


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))


def prefixes(series: DataFrame) -> DataFrame:
    """grp, t, i, n, x (periods since the first), y, prev, trend (as it stood before the row), sd, for every value of ``series`` (grp, t, score) and, as i = n, the period after the last.

    The trend begins as the median change and moves towards each change; it is folded over the series' changes, as many as there are periods.
    """
    s = series.select(F.col("grp").cast("string").alias("grp"), F.col("t").cast("int").alias("t"), F.col("score").cast("double").alias("score"))
    s = s.filter("score IS NOT NULL AND NOT isnan(score)")
    g = s.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("t", "score"))).alias("s"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    g = g.withColumn("d", F.expr("transform(sequence(1, size(s) - 1), i -> s[i].score - s[i - 1].score)"))
    g = g.withColumn("o", F.expr("array_sort(d)"))
    g = g.withColumn("median", F.expr("(o[cast((size(o) - 1) div 2 as int)] + o[cast(size(o) div 2 as int)]) / 2"))
    step = f"(a, c) -> array_append(a, {1 - LAST_CHANGE}D * a[size(a) - 1] + {LAST_CHANGE}D * c)"
    g = g.withColumn("trends", F.expr(f"aggregate(d, array(median), {step})"))
    row = "struct(i, IF(i = n, s[i - 1].t + 1, s[i].t) as t, s[i].score as y, s[i - 1].score as prev, trends[i - 1] as trend)"
    each = F.expr(f"transform(sequence(0, cast(n as int)), i -> IF(i = 0, struct(i, s[0].t as t, s[0].score as y, cast(null as double) as prev, cast(null as double) as trend), {row.replace('s[i].score', 'get(s, i).score').replace('s[i].t', 'get(s, i).t')}))")
    out = g.select("grp", "n", "sd", F.expr("s[0].t").alias("t0"), F.explode(each).alias("r"))
    return out.select("grp", "n", "sd", "r.i", "r.t", (F.col("r.t") - F.col("t0")).cast("double").alias("x"), "r.y", "r.prev", "r.trend")


def back_tests(rows: DataFrame) -> DataFrame:
    """``rows`` of ``prefixes`` for each candidate period with pred: the last value and trend, from row max(FIRST, n / 2) on blended with the forecast of the rows before.

    The moments of every prefix are running sums, so no regression reads its rows again.
    """
    each = rows.withColumn("period", F.explode(F.array(*[F.lit(p) for p in PERIODS])))
    for k, b in enumerate(basis(F.col("x"), F.col("period"))):
        each = each.withColumn(f"b{k}", b)
    before = Window.partitionBy("grp", "period").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    known = lambda x: F.sum(F.when(F.col("y").isNotNull(), x)).over(before)
    products = [known(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in _UPPER] + [known(F.col(f"b{k}") * F.col("y")) for k in range(TERMS)]
    first = F.greatest(F.lit(FIRST), F.floor(F.col("n") / 2)).cast("int")
    each = each.select("grp", "period", "n", "sd", "i", "t", "y", "prev", "trend", first.alias("first"), F.array(*products).alias("m"), F.array(*[f"b{k}" for k in range(TERMS)]).alias("at"))
    naive, blended = F.col("prev") + F.col("trend"), (F.col("i") >= F.col("first")) | (F.col("i") == F.col("n"))
    few = each.filter((F.col("i") > 0) & ~blended).select("*", naive.alias("pred"))
    far = each.filter(blended).select("*", (HARMONIC * forecast("m", "at", F.col("i")) + (1 - HARMONIC) * naive).alias("pred"))
    return few.union(far).drop("m", "at")


def nowcasts(series: DataFrame, band: float = 2.0) -> DataFrame:
    """One row for each ``grp`` of ``series`` (grp, t, score) with LEAST values: the forecast for the period after its last, its bounds, the chances of a rise or fall beyond ``band``, and back-test errors.

    The period is the candidate with the best direction and error of the blended forecasts of earlier rows (ties, and series too short for any: the shortest). Nulls and NaN are skipped.
    """
    tests = back_tests(prefixes(series))
    seen, late = F.col("i") < F.col("n"), (F.col("i") < F.col("n")) & (F.col("i") >= F.col("first"))
    error, change, guess = F.col("y") - F.col("pred"), F.col("y") - F.col("prev"), F.col("pred") - F.col("prev")
    right = (F.signum(change) == F.signum(guess)).cast("double")
    of = lambda f, cond, x: f(F.when(cond, x))
    after = lambda c: F.max(F.when(~seen, F.col(c)))
    g = tests.groupBy("grp", "period").agg(
        of(F.avg, late, right).alias("late_right"), F.sqrt(of(F.avg, late, error * error)).alias("late_rmse"), F.max("sd").alias("sd"),
        after("t").alias("t"), after("prev").alias("level"), after("trend").alias("trend"), after("pred").alias("nowcast"),
        of(F.stddev_pop, seen, error).alias("error_sd"), of(F.stddev_pop, seen, change).alias("change_sd"), F.count_if(seen).cast("int").alias("n_backtest"),
        of(F.avg, seen, F.abs(error)).alias("mae"), F.sqrt(of(F.avg, seen, error * error)).alias("rmse"), of(F.avg, seen, right).alias("directional"), F.collect_list(F.when(seen, F.abs(error))).alias("errors"),
    )
    skill = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("late_rmse") / F.when(F.col("sd") > 1e-6, F.col("sd")).otherwise(1.0)))
    g = g.withColumn("choice", F.coalesce(CHOICE[0] * F.col("late_right") + CHOICE[1] * skill, F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy("grp").orderBy(F.round("choice", 9).desc(), "period"))  # a row for each candidate
    g = g.withColumn("_r", best).filter("_r = 1")
    sd = F.greatest(F.lit(LEAST_ERROR), F.when(F.col("error_sd") > 1e-6, F.col("error_sd")).otherwise(F.col("change_sd")))
    g = g.withColumn("s", sd).withColumn("spread", F.greatest(F.lit(LEAST_SPREAD), F.col("change_sd")))
    g = g.withColumns({"p_down": normal_cdf((-band - F.col("trend")) / F.col("spread")), "p_up": 1 - normal_cdf((band - F.col("trend")) / F.col("spread"))})
    wins = lambda a, b: F.col(a) >= F.greatest(F.lit(CHANCE), F.col(b) + LEAD)
    signal = F.when(wins("p_down", "p_up"), "decelerate_risk").when(wins("p_up", "p_down"), "accelerate_window").otherwise("mixed")
    bound = lambda z, name: (F.col("nowcast") + z * F.col("s")).alias(name)
    coverage = F.expr("size(filter(errors, e -> e <= 1.96 * s)) / size(errors)")
    return g.select(
        "grp", "t", "level", "nowcast", bound(-1.28155, "low80"), bound(1.28155, "high80"), bound(-1.96, "low95"), bound(1.96, "high95"), "trend", "period", "p_up", "p_down", signal.alias("signal"),
        "n_backtest", "mae", "rmse", "directional", coverage.alias("coverage95"),
    )
