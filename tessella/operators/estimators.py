"""Causal estimators on panels. Nuisances are linear and cross-fitted from moments by fold: one aggregation each, and only k-by-k matrices reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import clip, keyed_draw
from tessella.sources.tables import Stages

#: Propensities are kept this far from 0 and 1.
EDGE = 1e-4


def fold_of(unit: str, folds: int) -> Column:
    """A fold from 0 on for all rows of a unit, by a keyed draw."""
    return F.floor(keyed_draw(F.lit("fold"), F.col(unit)) * folds).cast("int")


def grams(df: DataFrame, columns: list[str], key: str) -> dict:
    """By ``key`` (few values) the moments of 1 and ``columns``, rows with a null left out."""
    names = ["_one", *columns]
    d = df.withColumn("_one", F.lit(1.0)).select(key, *[F.col(c).cast("double").alias(c) for c in names]).na.drop(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = {}
    for row in d.groupBy(key).agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).collect():
        out[row[0]] = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, row[1:], strict=True):
            out[row[0]][i, j] = out[row[0]][j, i] = v
    return out


def solved(gram: np.ndarray) -> np.ndarray:
    """Least squares of the last column on the others; a constant column that repeats the first has no part."""
    return np.linalg.pinv(gram[:-1, :-1], rcond=1e-12, hermitian=True) @ gram[:-1, -1]


def linear(beta: np.ndarray, xs: list[str]) -> Column:
    return sum((F.col(x) * float(b) for x, b in zip(xs, beta[1:], strict=True)), F.lit(float(beta[0])))


def by_key(betas: dict, xs: list[str], key: str) -> Column:
    """The prediction of the key's own model; null where it has none."""
    out = F.lit(None).cast("double")
    for k, beta in betas.items():
        out = F.when(F.col(key) == k, linear(beta, xs)).otherwise(out)
    return out


def cross_fit(df: DataFrame, y: str, xs: list[str], fold: str = "fold", rows: Column | None = None) -> Column:
    """Each row's prediction of ``y`` from the model of all other folds' rows (those of ``rows``)."""
    by_fold = grams(df.filter(rows) if rows is not None else df, [*xs, y], fold)
    total = sum(by_fold.values()) if by_fold else np.zeros((len(xs) + 2, len(xs) + 2))
    every = [r[0] for r in df.select(fold).distinct().collect()]
    return by_key({k: solved(total - by_fold.get(k, 0)) for k in every}, xs, fold)


def overlapping(df: DataFrame, p: str, bounds: tuple[float, float], share: float, least: int = 60) -> DataFrame:
    """The rows with ``p`` inside the bounds, and the share left out; all rows if too few would stay."""
    inside = F.col(p).between(*bounds)
    n, kept = df.agg(F.count("*"), F.count_if(inside)).first()
    enough = kept >= max(least, int(share * n))
    return (df.filter(inside) if enough else df).withColumn("trimmed_share", F.lit(1 - kept / n if enough and n else 0.0))


def double_ml(panel: DataFrame, y: str, d: str, xs: list[str], folds: int = 3, bounds: tuple[float, float] = (0.03, 0.97)) -> DataFrame:
    """One row: the effect of ``d`` on ``y`` by residual on residual, both cross-fitted over folds of whole units, after trimming rows whose propensity is outside ``bounds``."""
    rows = panel.select("unit", y, d, *xs).na.drop()
    rows = rows.withColumn("ps", clip(linear(solved(grams(rows.withColumn("_k", F.lit(0)), [*xs, d], "_k").get(0, np.zeros((len(xs) + 2,) * 2))), xs), EDGE, 1 - EDGE))
    kept = overlapping(rows, "ps", bounds, 0.45).withColumn("fold", fold_of("unit", folds))
    res = kept.select("trimmed_share", (F.col(y) - cross_fit(kept, y, xs)).alias("yt"), (F.col(d) - clip(cross_fit(kept, d, xs), EDGE, 1 - EDGE)).alias("dt"))
    both = res.agg(F.sum(F.expr("dt * yt")).alias("dy"), F.sum(F.expr("dt * dt")).alias("dd"))
    theta = both.select((F.col("dy") / F.when(F.col("dd") > 1e-10, F.col("dd"))).alias("theta"), "dd")
    met = res.join(theta, F.lit(True))  # one row
    out = met.groupBy("theta", "dd", "trimmed_share").agg(F.count("*").alias("n_obs"), F.avg(F.pow(F.expr("dt * (yt - theta * dt)"), 2)).alias("m"))
    return out.select(F.col("theta").alias("coef"), (F.sqrt(F.col("m") / F.col("n_obs")) / (F.col("dd") / F.col("n_obs"))).alias("stderr"), "n_obs", "trimmed_share")


def first_differences(panel: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Rows with the change of ``y`` as dy and the earlier values of ``xs`` as <x>_lag."""
    own = Window.partitionBy("unit").orderBy("t")
    lags = [F.lag(x).over(own).alias(f"{x}_lag") for x in xs]
    return panel.select("*", (F.col(y) - F.lag(y).over(own)).alias("dy"), *lags).na.drop(subset=["dy", *[f"{x}_lag" for x in xs]])


def doubly_robust_did(panel: DataFrame, y: str, d: str, xs: list[str], folds: int = 3, bounds: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """One row: the effect on the treated by first differences, cross-fitted propensities and control outcomes, trimmed to ``bounds``."""
    lags = [f"{x}_lag" for x in xs]
    rows = first_differences(panel, y, xs).select("unit", "dy", F.col(d).alias("d"), *lags).withColumn("fold", fold_of("unit", folds))
    p, m0 = clip(cross_fit(rows, "d", lags), EDGE, 1 - EDGE), cross_fit(rows, "dy", lags, rows=F.col("d") == 0)
    kept = overlapping(rows.select("d", p.alias("p"), (F.col("dy") - m0).alias("e")), "p", bounds, 0.55)
    rate = kept.agg(F.avg("d").alias("rate"))
    scored = kept.join(rate, F.lit(True)).withColumn("c", F.expr("(d - (1 - d) * p / greatest(1 - p, 1e-4)) * e / rate"))  # one row
    out = scored.groupBy("trimmed_share").agg(F.avg("c").alias("coef"), F.var_pop("c").alias("v"), F.count("*").alias("n_obs"))
    return out.select("coef", F.sqrt(F.col("v") / F.col("n_obs")).alias("stderr"), "n_obs", "trimmed_share")


def pseudo_outcomes(panel: DataFrame, y: str, d: str, xs: list[str], folds: int = 3, bounds: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """``panel``'s complete rows with tau, the doubly robust pseudo-outcome of the effect: means of tau are effects. Propensities are clipped to ``bounds``."""
    rows = panel.na.drop(subset=[y, d, *xs]).withColumn("fold", fold_of("unit", folds))
    m1, m0 = (cross_fit(rows, y, xs, rows=F.col(d) == k) for k in (1, 0))
    rows = rows.withColumn("m1", m1).withColumn("m0", m0).withColumn("e", clip(cross_fit(rows, d, xs), *bounds))
    return rows.withColumn("tau", F.expr(f"m1 - m0 + {d} * ({y} - m1) / e - (1 - {d}) * ({y} - m0) / (1 - e)")).drop("m1", "m0", "fold")


def effects(pseudo: DataFrame, d: str, by: list[str]) -> DataFrame:
    """Mean effect over all rows and over the treated, with the former's error: overall (nulls) and by each of ``by``."""
    g = pseudo.groupingSets([(), *[(b,) for b in by]], *by)
    return g.agg(F.avg("tau").alias("ate"), (F.stddev_pop("tau") / F.sqrt(F.count("*"))).alias("stderr"), F.avg(F.when(F.col(d) == 1, F.col("tau"))).alias("att"), F.count("*").alias("n_obs"))


def ablation(panel: DataFrame, y: str, d: str, variants: dict[str, list[str]]) -> DataFrame:
    """Overall effects by design variant (its covariates), and whether each is within two errors of the first variant's."""
    out = None
    for name, xs in variants.items():
        rows = effects(pseudo_outcomes(panel, y, d, xs), d, []).select(F.lit(name).alias("variant"), "ate", "stderr", "n_obs")
        out = rows if out is None else out.union(rows)
    base = out.filter(F.col("variant") == next(iter(variants))).select(F.col("ate").alias("a"), F.col("stderr").alias("s"))
    return out.join(base, F.lit(True)).select("variant", "ate", "stderr", "n_obs", (F.abs(F.col("ate") - F.col("a")) <= 2 * F.col("s")).cast("int").alias("agrees"))  # one row


def pre_features(panel: DataFrame, y: str, at: int) -> DataFrame:
    """One row a unit: mean and slope of ``y`` before ``at``, its mean from then on less the former."""
    before = F.when(F.col("t") < at, F.col(y))
    u = panel.groupBy("unit", "treated").agg(F.avg(before).alias("pre_mean"), F.regr_slope(before, F.col("t")).alias("pre_slope"), (F.avg(F.when(F.col("t") >= at, F.col(y))) - F.avg(before)).alias("change"))
    return u.na.drop()


def matched_did(panel: DataFrame, y: str, at: int, caliper: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(effect, balance) of treated units against their nearest control by propensity, with replacement, within ``caliper`` deviations of it.

    The propensity is linear in the mean and the slope of ``y`` before ``at``. Units meet in ranges of one caliper's width, and a control stands in
    its own and the two next to it; there the nearest is the last before or the first after the treated unit in the order of the propensity. effect has one row:
    matched treated, their share, mean difference of changes and its error. balance: standardised mean differences before and after matching.
    """
    xs = ["pre_mean", "pre_slope"]
    u = pre_features(panel, y, at)
    u = u.withColumn("ps", linear(solved(grams(u.withColumn("_k", F.lit(0)), [*xs, "treated"], "_k").get(0, np.zeros((4, 4)))), xs))
    width = u.agg(F.stddev_pop("ps")).first()[0] or 0.0
    width = caliper * width if width > 0 else 1.0
    place = F.floor(F.col("ps") / width)
    side = lambda k: F.struct("ps", "unit", "change", *xs).alias(k)
    treated = u.filter("treated = 1").select(place.alias("place"), F.col("ps").alias("at"), side("me"), F.lit(None).cast("struct<ps:double,unit:bigint,change:double,pre_mean:double,pre_slope:double>").alias("other"))
    control = u.filter("treated = 0").select(F.explode(F.array(place - 1, place, place + 1)).alias("place"), F.col("ps").alias("at"), F.lit(None).cast("struct<ps:double,unit:bigint,change:double,pre_mean:double,pre_slope:double>").alias("me"), side("other"))
    # of equal propensities the control of the smallest unit comes nearest on either side
    order = Window.partitionBy("place").orderBy("at", F.coalesce(-F.col("other.unit"), F.lit(1)))
    back = Window.partitionBy("place").orderBy(F.col("at").desc(), F.coalesce(-F.col("other.unit"), F.lit(1)))
    near = treated.unionByName(control).withColumn("a", F.last("other", True).over(order)).withColumn("b", F.last("other", True).over(back)).filter("me IS NOT NULL")
    gap = lambda k: F.abs(F.col(f"{k}.ps") - F.col("at"))
    first = F.col("b").isNull() | (gap("a") < gap("b")) | ((gap("a") == gap("b")) & (F.col("a.unit") <= F.col("b.unit")))
    pairs = near.withColumn("c", F.when(first, F.col("a")).otherwise(F.col("b"))).filter(F.abs(F.col("c.ps") - F.col("at")) <= width)
    diff = F.col("me.change") - F.col("c.change")
    n = u.filter("treated = 1").agg(F.count("*").alias("n_treated"))
    effect = pairs.agg(F.count("*").alias("n_matched"), F.avg(diff).alias("coef"), (F.stddev_samp(diff) / F.sqrt(F.count("*"))).alias("stderr")).join(n, F.lit(True))  # one row
    sd = lambda x: F.sqrt((F.var_samp(F.when(F.col("treated") == 1, F.col(x))) + F.var_samp(F.when(F.col("treated") == 0, F.col(x)))) / 2)
    before = u.agg(*[F.struct(sd(x).alias("sd"), ((F.avg(F.when(F.col("treated") == 1, F.col(x))) - F.avg(F.when(F.col("treated") == 0, F.col(x)))) / sd(x)).alias("d")).alias(x) for x in xs])
    after = pairs.agg(*[F.avg(F.col(f"me.{x}") - F.col(f"c.{x}")).alias(f"after_{x}") for x in xs])
    met = before.join(after, F.lit(True))  # one row each
    balance = met.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}.d").alias("before"), (F.col(f"after_{x}") / F.col(f"{x}.sd")).alias("after")) for x in xs])).alias("x")).select("x.*")
    return effect.select("n_treated", "n_matched", "coef", "stderr"), balance


def synthetic_control(panel: DataFrame, y: str, at: int, ridge: float = 1.0) -> DataFrame:
    """t, actual, synthetic, gap of the treated unit of highest mean against a weighted mean of donors complete over its periods before ``at``.

    ``panel``: unit, t, y, cohort. Donors are not treated until after ``at``. Ridge weights in their dual form: w = Y'(YY' + ridge I)^-1 y needs
    only moments by pairs of periods; each donor's weight is a dot product in Spark; then negative ones go and the rest are scaled to sum to 1.
    """
    means = panel.filter("cohort < 9999").groupBy("unit").agg(F.round(F.avg(y), 9).alias("m")).orderBy(F.col("m").desc(), "unit").limit(1)
    one = panel.join(F.broadcast(means.select("unit")), "unit", "left_semi").filter(F.col(y).isNotNull())
    series = {r.t: r[y] for r in one.select("t", y).collect()}  # one value a period
    before = sorted(t for t in series if t < at)
    donors = panel.filter(F.col("cohort") > at).join(F.broadcast(means.select("unit")), "unit", "left_anti")
    rows = donors.filter(F.col("t").isin(before) & F.col(y).isNotNull()).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", F.col(y).alias("v")))).alias("s")).filter(F.size("s") == len(before))
    at_ = lambda i: F.col("s")[i]["v"]
    k = len(before)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(F.count("*"), *[F.sum(at_(i) * at_(j)) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, found[1:], strict=True):
        gram[i, j] = gram[j, i] = v or 0.0
    dual = np.linalg.solve(gram + ridge * np.eye(k), np.array([series[t] for t in before])) if k else np.zeros(0)
    weight = F.greatest(sum((at_(i) * float(a) for i, a in enumerate(dual)), F.lit(0.0)), F.lit(0.0))
    weighed = rows.select("unit", weight.alias("w")).filter("w > 0")
    mixed = donors.join(weighed, "unit").groupBy("t").agg((F.sum(F.col(y) * F.col("w")) / F.sum(F.when(F.col(y).isNotNull(), F.col("w")))).alias("synthetic"), F.count("*").alias("donors"))
    return one.select("t", F.col(y).alias("actual")).join(mixed, "t").withColumn("gap", F.col("actual") - F.col("synthetic"))


def low_rank_counterfactual(panel: DataFrame, y: str, shrink: float, rounds: int = 25, tolerance: float = 1e-5) -> DataFrame:
    """unit, t, actual, counterfactual, effect for every treated cell (t at or after the unit's cohort) of ``panel`` (unit, t, y, cohort).

    Treated and missing cells are filled by iterated soft-thresholded singular values. A unit's periods are one row; a round takes the periods' moments (period by period, the sum over
    rows), their eigenvectors give the matrix that every row is multiplied by. Rows are cut to files every fifth round.
    """
    import pyarrow as pa

    times = [r.t for r in panel.select("t").distinct().orderBy("t").collect()]
    seen = F.when(F.col("t") < F.col("cohort"), F.col(y).cast("double"))
    cells = panel.groupBy("unit", "cohort").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct(seen.alias("v"), F.col(y).cast("double").alias("y"))))).alias("m"))
    means = panel.select("t", seen.alias("v")).groupBy("t").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("v")).collect()
    mean = {r.t: r.v for r in means}
    cells = cells.select("unit", "cohort", F.array(*[F.col("m")[t]["v"] for t in times]).alias("seen"), F.array(*[F.col("m")[t]["y"] for t in times]).alias("all"))
    cells = cells.withColumn("now", F.array(*[F.coalesce(F.col("seen")[i], F.lit(float(mean[t]))) for i, t in enumerate(times)]))

    work = Stages(panel.sparkSession, "low_rank")
    cells = work.cut(cells.select("unit", "cohort", "all", "seen", "now"), "cells0")
    pending = []  # the matrices of the rounds since the rows were cut

    def matrix(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(times))

    def stepped(batch):
        """The rows after the pending rounds, and those before the last of them: all rounds in one worker, not one for each."""
        seen, now = matrix(batch.column(3)), matrix(batch.column(4))
        before = now
        for w in pending:
            before, now = now, np.where(np.isnan(seen), now @ w, seen)
        return before, now

    def moments(batches):
        total = np.zeros((len(times), len(times)))
        for batch in batches:
            x = stepped(batch)[1]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    def advanced(batches):
        for batch in batches:
            before, now = stepped(batch)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(times))
            columns = [*batch.columns[:4], pa.ListArray.from_arrays(ends, pa.array(now.ravel())), pa.array(((now - before) ** 2).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "off"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", off double"
    for turn in range(rounds):
        gram = sum((np.array(r.g).reshape(len(times), -1) for r in cells.mapInArrow(moments, "g array<double>").collect()), np.zeros((len(times),) * 2))
        values, vectors = np.linalg.eigh(gram)
        s = np.sqrt(np.maximum(values, 0))
        pending.append((vectors * np.where(s > shrink, 1 - shrink / np.maximum(s, 1e-300), 0.0)) @ vectors.T)
        if turn % 5 == 4 or turn == rounds - 1:
            step = work.cut(cells.mapInArrow(advanced, schema), f"cells{turn + 1}")
            cells, pending = step.drop("off"), []
            if np.sqrt(step.agg(F.sum("off")).first()[0] or 0.0) < tolerance * max(np.sqrt(np.trace(gram)), 1e-10):
                break
    long = cells.select("unit", "cohort", F.explode(F.arrays_zip(F.lit(times).alias("t"), F.col("all").alias("actual"), F.col("now").alias("counterfactual"))).alias("c")).select("unit", "cohort", "c.*")
    return long.filter("t >= cohort AND actual IS NOT NULL").select("unit", "t", "actual", "counterfactual", (F.col("actual") - F.col("counterfactual")).alias("effect"))


def pretrend_joint_test(pre: DataFrame, draws: int = 2000) -> DataFrame:
    """One row: the sum of squared weighted z of ``pre`` (event_t, att, stderr, weight), and its p among keyed normal draws (Box-Muller)."""
    z = pre.filter("stderr > 0 AND att IS NOT NULL").withColumn("w", F.greatest(F.col("weight").cast("double"), F.lit(1.0)))
    z = z.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy())).select("event_t", "w", F.pow(F.col("w") * F.col("att") / F.col("stderr"), 2).alias("s"))  # a row for each event time
    seen = z.agg(F.sum("s").alias("joint_stat"), F.count("*").alias("dof"))
    d = z.select("event_t", "w", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = lambda k: F.greatest(keyed_draw(F.lit(k), F.col("draw"), F.col("event_t")), F.lit(1e-12))
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * np.pi * u("b"))
    null = d.groupBy("draw").agg(F.sum(F.pow(F.col("w") * normal, 2)).alias("s"))
    return null.join(seen, F.lit(True)).groupBy("joint_stat", "dof").agg(F.avg((F.round("s", 9) >= F.round("joint_stat", 9)).cast("double")).alias("p"))  # one row


def pretrend_effects(panel: DataFrame, low: int = -4) -> DataFrame:
    """event_t (from ``low`` to -2), att, stderr, weight: mean change from the period before a unit's start, less that of units never treated in the same period."""
    base = panel.select(F.col("unit").alias("u"), F.col("t").alias("bt"), F.col("value").alias("b"))
    starts = panel.filter("cohort < 9999").select(F.col("cohort").alias("g")).distinct().withColumn("event_t", F.explode(F.sequence(F.lit(low), F.lit(-2))))
    met = panel.join(starts, (F.col("t") == F.col("g") + F.col("event_t")) & ((F.col("cohort") == F.col("g")) | (F.col("cohort") == 9999))).join(base, (F.col("unit") == F.col("u")) & (F.col("bt") == F.col("g") - 1))
    own, d = F.col("cohort") < 9999, F.col("value") - F.col("b")
    part = lambda f, c: f(F.when(c, d))
    g = met.groupBy("event_t").agg(part(F.avg, own).alias("a"), part(F.avg, ~own).alias("c"), part(F.var_samp, own).alias("va"), part(F.var_samp, ~own).alias("vc"), F.count_if(own).alias("weight"), F.count_if(~own).alias("nc"))
    return g.select("event_t", (F.col("a") - F.col("c")).alias("att"), F.sqrt(F.col("va") / F.col("weight") + F.col("vc") / F.col("nc")).alias("stderr"), "weight")


def placebo_periods(panel: DataFrame, outcome: str, start: int, periods: list[int]) -> DataFrame:
    """Two-way effects on rows before ``start`` as if units marked ``treated`` had started at each of ``periods``: should be near 0."""
    from tessella.operators.regression import heterogeneity

    rows = panel.filter(F.col("t") < start).withColumn("placebo_t", F.explode(F.lit(periods)))
    return heterogeneity(rows.withColumn("_did", (F.col("treated") * (F.col("t") >= F.col("placebo_t")).cast("int")).cast("double")), outcome, "_did", "placebo_t")


def specification_curve(panel: DataFrame, outcomes: list[str], did: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Two-way effects by outcome and window of periods, all in one aggregation, with their rank and the share above 0."""
    from tessella.operators.regression import heterogeneity

    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in outcomes)
    long = panel.select("unit", "t", F.col(did).alias("_did"), F.expr(f"stack({len(outcomes)}, {names}) AS (outcome, v)"))
    inside = F.array(*[F.when(F.col("t").between(*span), F.lit(name)) for name, span in windows.items()])
    each = long.select("unit", "t", "_did", "v", F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("w"), "outcome")
    c = heterogeneity(each.withColumn("spec", F.concat_ws(":", "outcome", "w")), "v", "_did", "spec")
    return c.select("*", F.row_number().over(Window.orderBy(F.round("coef", 9), "spec")).alias("rank"), F.avg((F.col("coef") > 0).cast("double")).over(Window.partitionBy()).alias("positive_share"))  # a row for each specification


def response_matrix(panel: DataFrame, registry: DataFrame, kinds: list[str], outcomes: list[str]) -> DataFrame:
    """Two-way effects by kind of event and outcome: treated from the cluster's first event of the kind on."""
    from tessella.operators.regression import heterogeneity

    starts = registry.groupBy("kind", "cl").agg(F.min("start_t").alias("c"))
    each = panel.withColumn("kind", F.explode(F.lit(kinds))).join(starts, ["kind", "cl"], "left").withColumn("_did", F.coalesce((F.col("t") >= F.col("c")).cast("double"), F.lit(0.0)))
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in outcomes)
    long = each.select("unit", "t", "_did", "kind", F.expr(f"stack({len(outcomes)}, {names}) AS (outcome, v)"))
    return heterogeneity(long.withColumn("cell", F.concat_ws(":", "kind", "outcome")), "v", "_did", "cell")
