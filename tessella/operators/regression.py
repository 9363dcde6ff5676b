"""Panel regressions. One aggregation gives the moments; only k-by-k matrices reach the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import keyed_draw, numbered
from tessella.sources.tables import Stages, spread


def two_way_within(df: DataFrame, columns: list[str], unit: str = "unit", period: str = "t", group: tuple[str, ...] = ()) -> DataFrame:
    """x less its unit's and its period's mean plus the overall mean, as ``<x>_w``: the two-way effect on balanced panels; all within ``group`` if named.

    Means are aggregates joined back, so no task holds a period or a group. The rows are written once, since all of them are read for each of the means.
    """
    d = Stages(df.sparkSession, "within").cut(df, "rows")
    out, parts = d, {"u": (*group, unit), "p": (*group, period), "g": group}
    for name, by in parts.items():
        means = d.groupBy(*[F.col(c).alias(f"_{name}_{c}") for c in by]).agg(*[F.avg(c).alias(f"_{name}{i}") for i, c in enumerate(columns)])
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{name}_{c}")) for c in by], F.lit(True))
        out = out.join(means, same, "left")  # without by: one row
    within = [(F.col(c) - F.col(f"_u{i}") - F.col(f"_p{i}") + F.col(f"_g{i}")).alias(f"{c}_w") for i, c in enumerate(columns)]
    return out.select(*df.columns, *within)


def _gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    d = df.select(F.col(y).cast("double"), *[F.col(x).cast("double") for x in xs]).na.drop()
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    row = d.agg(F.count("*"), *[F.sum(F.col(a) * F.col(b)) for a, b in pairs], *[F.sum(F.col(a) * F.col(y)) for a in xs]).first()
    k, gram = len(xs), np.zeros((len(xs), len(xs)))
    for (a, b), v in zip(pairs, row[1 : 1 + len(pairs)], strict=True):
        i, j = xs.index(a), xs.index(b)
        gram[i, j] = gram[j, i] = v or 0.0
    return gram, np.array([v or 0.0 for v in row[1 + len(pairs) :]]).reshape(k), row[0]


def inverse(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The (pseudo-)inverse of a matrix of moments, taken at unit scale, and which columns are identified: those that vary, and not only with the others."""
    size = np.diag(gram)
    varies = size > 1e-24 * max(n, 1)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, size, 1.0)), 0.0)
    g, k = gram * np.outer(scale, scale), len(gram)
    rest = [[j for j in range(k) if j != i] for i in range(k)]
    left = np.array([g[i, i] - g[i, r] @ np.linalg.pinv(g[np.ix_(r, r)], 1e-12, True) @ g[r, i] if r else g[i, i] for i, r in enumerate(rest)])
    return np.linalg.pinv(g, 1e-12, True) * np.outer(scale, scale), varies & (left > 1e-10)


def ols(df: DataFrame, y: str, xs: list[str], cluster: str | None = None, extra_dof: int = 0) -> DataFrame:
    """(term, coef, stderr, t_value, n_obs, n_clusters): least squares with HC1, or CR1 errors by ``cluster``.

    Two passes: moments for the coefficients, then the scores' squares. No intercept is added. Terms that don't vary, or only with the others, have nulls.
    """
    gram, xy, n = _gram(df, y, xs)
    inv, known = inverse(gram, n)
    beta = inv @ xy
    d = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double") for x in xs], *([F.col(cluster).alias("_c")] if cluster else [])).na.drop()
    fitted = sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    scores = d.select(*[(F.col(x) * (F.col("_y") - fitted)).alias(f"_s{i}") for i, x in enumerate(xs)], *(["_c"] if cluster else []))
    names = [f"_s{i}" for i in range(len(xs))]
    groups = n
    if cluster:
        scores = scores.groupBy("_c").agg(*[F.sum(s).alias(s) for s in names])
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = scores.agg(F.count("*"), *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    meat, k = np.zeros_like(gram), len(xs) + extra_dof
    for (i, j), v in zip(pairs, row[1:], strict=True):
        meat[i, j] = meat[j, i] = v or 0.0
    if cluster:
        groups = row[0]
        meat *= groups / max(groups - 1, 1) * (n - 1) / max(n - k, 1)
    else:
        meat *= n / max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    rows = [(x, float(b) if i else None, float(s) if i else None, float(b / s) if i and s > 0 else None, int(n), int(groups) if cluster else None) for x, b, s, i in zip(xs, beta, se, known, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, stderr double, t_value double, n_obs long, n_clusters long")


def twfe(panel: DataFrame, outcome: str, treatment: str, controls: tuple[str, ...] = (), cluster: str = "cl") -> DataFrame:
    """Two-way fixed effects with a treatment and controls, errors clustered. Rows with a null in any of them go before means are taken."""
    names = [outcome, treatment, *controls]
    w = two_way_within(panel.na.drop(subset=names), names)
    return ols(w, f"{outcome}_w", [f"{c}_w" for c in names[1:]], cluster)


def staggered_att(panel: DataFrame, low: int = -3, high: int = 3) -> DataFrame:
    """By cohort and event time: mean change since the period before the cohort's start, less that of units not yet treated then.

    ``panel``: unit, t, value, cohort (9999: never).
    """
    treated = panel.filter("cohort < 9999")
    starts = treated.select(F.col("cohort").alias("g")).distinct().withColumn("e", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("tt", F.col("g") + F.col("e"))
    base = panel.select(F.col("unit").alias("u"), F.col("t").alias("t0"), F.col("value").alias("v0"))
    now = panel.join(starts, F.col("t") == F.col("tt")).filter("cohort = g OR cohort > greatest(tt, g)")
    met = now.join(base, (F.col("unit") == F.col("u")) & (F.col("t0") == F.col("g") - 1)).withColumn("d", F.col("value") - F.col("v0"))
    own = F.col("cohort") == F.col("g")
    g = met.groupBy(F.col("g").alias("cohort"), F.col("e").alias("event_t")).agg(F.avg(F.when(own, F.col("d"))).alias("own"), F.avg(F.when(~own, F.col("d"))).alias("control"), F.sum(own.cast("long")).alias("treated"))
    return g.filter("own IS NOT NULL AND control IS NOT NULL").select("cohort", "event_t", "treated", (F.col("own") - F.col("control")).alias("att"))


def event_time_att(att: DataFrame) -> DataFrame:
    return att.groupBy("event_t").agg((F.sum(F.col("att") * F.col("treated")) / F.sum("treated")).alias("att"), F.count("*").alias("cohorts"))


def event_study(panel: DataFrame, outcome: str, low: int = -3, high: int = 3, cluster: str = "unit") -> DataFrame:
    """Two-way fixed effects on dummies of event time (ends pooled, -1 left out) for units with a cohort."""
    e = F.greatest(F.least(F.col("t") - F.col("cohort"), F.lit(high)), F.lit(low))
    d = panel.na.drop(subset=[outcome]).withColumn("_e", F.when(F.col("cohort") < 9999, e))
    times = [k for k in range(low, high + 1) if k != -1]
    names = [f"e{'m' if k < 0 else 'p'}{abs(k)}" for k in times]
    d = d.select("*", *[F.coalesce((F.col("_e") == k).cast("double"), F.lit(0.0)).alias(n) for k, n in zip(times, names, strict=True)])
    w = two_way_within(d, [outcome, *names])
    return ols(w, f"{outcome}_w", [f"{n}_w" for n in names], cluster)


def beta_convergence(panel: DataFrame) -> DataFrame:
    """Mean log growth on the first log level over units, with HC1 errors."""
    u = panel.groupBy("unit").agg(F.log(F.min_by("value", "t")).alias("start"), F.log(F.max_by("value", "t")).alias("end"), (F.max("t") - F.min("t")).alias("span")).filter("span > 0")
    u = u.select(((F.col("end") - F.col("start")) / F.col("span")).alias("growth"), "start", F.lit(1.0).alias("const"))
    return ols(u, "growth", ["const", "start"])


def elasticity(panel: DataFrame, y: str, x: str) -> DataFrame:
    d = panel.select("unit", "t", F.log(y).alias("ly"), F.log(x).alias("lx")).na.drop(subset=["ly", "lx"])
    return ols(two_way_within(d, ["ly", "lx"]), "ly_w", ["lx_w"])


def lead_placebo(panel: DataFrame, outcome: str, did: str, leads: tuple[int, ...], cluster: str = "cl") -> DataFrame:
    """The treatment moved ``lead`` rows earlier, on rows not yet treated: coefficients should be near 0."""
    out = None
    for k in leads:
        d = panel.withColumn("lead_did", F.lead(did, k).over(Window.partitionBy("unit").orderBy("t"))).filter(F.col(did) == 0).na.drop(subset=["lead_did"])
        rows = twfe(d, outcome, "lead_did", cluster=cluster).withColumn("lead", F.lit(k))
        out = rows if out is None else out.union(rows)
    return out


def heterogeneity(panel: DataFrame, outcome: str, did: str, group: str) -> DataFrame:
    """Two-way effects of the treatment inside each group, all groups in one aggregation (one regressor needs only sums)."""
    d = panel.na.drop(subset=[outcome, did]).select(group, "unit", "t", F.col(outcome).cast("double").alias("y"), F.col(did).cast("double").alias("x"))
    w = two_way_within(d, ["y", "x"], group=(group,))
    s = w.groupBy(group).agg(F.sum(F.col("x_w") * F.col("y_w")).alias("xy"), F.sum(F.col("x_w") * F.col("x_w")).alias("xx"), F.count("*").alias("n_obs"))
    return s.select(group, F.when(F.col("xx") > 1e-9, F.col("xy") / F.col("xx")).alias("coef"), "n_obs")


def leave_one_group_out(panel: DataFrame, outcome: str, did: str, group: str) -> DataFrame:
    """The two-way effect without each group in turn. A unit's rows are all of one group, so its means stay.

    Sums of the units' deviations by group and period are all it needs: what is left without a group is the total less the group's sums.
    """
    d = panel.na.drop(subset=[outcome, did]).select("unit", "t", F.col(group).alias("grp"), F.col(did).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    d = Stages(panel.sparkSession, "left_out").cut(d, "rows")
    means = d.groupBy("unit").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dev = d.join(means, "unit").withColumns({"a": F.col("x") - F.col("mx"), "b": F.col("y") - F.col("my")})
    sums = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "ab": F.col("a") * F.col("b")}
    own = dev.groupBy("grp", "t").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    every = own.groupBy("t").agg(*[F.sum(k).alias(f"all_{k}") for k in sums])
    groups = own.select(F.col("grp").alias("left_out")).distinct()
    grid = groups.join(every.withColumnRenamed("t", "at"), F.lit(True))  # a row for each group and period
    met = grid.join(own, F.col("left_out").eqNullSafe(F.col("grp")) & (F.col("at") == F.col("t")), "left")
    rest = met.select("left_out", "at", *[(F.col(f"all_{k}") - F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in sums]).filter("n > 0.5")
    total = rest.groupBy(F.col("left_out").alias("_l")).agg(*[F.sum(k).alias(f"t_{k}") for k in ("n", "x", "y")])
    rest = rest.join(total, F.col("left_out").eqNullSafe(F.col("_l")))
    rest = rest.withColumns({"p": F.expr("x / n - t_x / t_n"), "q": F.expr("y / n - t_y / t_n")})
    xx, xy = F.sum(F.expr("aa - 2 * p * a + n * p * p")), F.sum(F.expr("ab - p * b - q * a + n * p * q"))
    return rest.groupBy("left_out").agg(F.when(xx > 1e-9, xy / xx).alias("coef"), F.sum("n").cast("long").alias("n_obs"))


def ols_by(df: DataFrame, group: str, y: str, xs: list[str], cluster: str | None = None) -> DataFrame:
    """``ols`` in each of a few groups, all in two passes: group, term, coef, stderr, t_value, n_obs, n_clusters, r2 (of the columns as they are)."""
    c = [F.col(cluster).alias("_c")] if cluster else []
    names = [f"_x{i}" for i in range(len(xs))]
    d = df.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names, strict=True)], *c).na.drop()
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs] + [F.sum(F.col(n) * F.col("_y")) for n in names]
    sums += [F.sum(F.col("_y") * F.col("_y")), F.sum("_y"), F.count("*")]
    fits = {}
    for r in d.groupBy("_g").agg(*sums).collect():  # k-by-k numbers for each group
        gram = np.zeros((len(xs),) * 2)
        for (i, j), v in zip(pairs, r[1:], strict=False):
            gram[i, j] = gram[j, i] = v
        xy, (yy, sy, n) = np.array(r[1 + len(pairs) : 1 + len(pairs) + len(xs)]), r[-3:]
        inv = inverse(gram, n)[0]
        fits[r[0]] = (inv @ xy, inv, n, float(1 - (yy - xy @ inv @ xy) / (yy - sy * sy / n)) if yy - sy * sy / n > 0 else None)
    kind = d.schema["_g"].dataType.simpleString()
    spark = df.sparkSession
    betas = spark.createDataFrame([(g, [float(b) for b in f[0]]) for g, f in fits.items()], f"_k {kind}, _b array<double>")
    fitted = sum((F.col(n) * F.col("_b")[i] for i, n in enumerate(names)), F.lit(0.0))
    scores = d.join(betas, F.col("_g") == F.col("_k")).select("_g", *[(F.col(n) * (F.col("_y") - fitted)).alias(f"_s{i}") for i, n in enumerate(names)], *(["_c"] if cluster else []))
    if cluster:
        scores = scores.groupBy("_g", "_c").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(xs))])
    rows = []
    for r in scores.groupBy("_g").agg(F.count("*"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).collect():
        beta, inv, n, r2 = fits[r[0]]
        meat, k = np.zeros_like(inv), len(xs)
        for (i, j), v in zip(pairs, r[2:], strict=True):
            meat[i, j] = meat[j, i] = v
        g = r[1] if cluster else None
        meat *= g / max(g - 1, 1) * (n - 1) / max(n - k, 1) if cluster else n / max(n - k, 1)
        se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
        rows += [(r[0], x, float(b), float(s), float(b / s) if s > 0 else None, n, g, r2) for x, b, s in zip(xs, beta, se, strict=True)]
    return spark.createDataFrame(rows, f"{group} {kind}, term string, coef double, stderr double, t_value double, n_obs long, n_clusters long, r2 double")


def p_value(t: float, dof: int) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= (a + 1) / (a + b + 2):
        return 1 - _fraction(1 - x, b, a) * front / b if 0 < x < 1 else 1.0
    return _fraction(x, a, b) * front / a


def _fraction(x: float, a: float, b: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def dose_bins(panel: DataFrame, outcome: str, dose: str, bins: int = 3, cluster: str = "cl") -> DataFrame:
    """Two-way effects of quantile bins of the positive doses, against none."""
    edges = panel.filter(F.col(dose) > 0).agg(F.array_distinct(F.percentile(dose, F.array(*[F.lit(i / bins) for i in range(1, bins)])))).first()[0] or []
    place = sum(((F.col(dose) > F.lit(e)).cast("int") for e in edges), F.lit(1))
    d = panel.na.drop(subset=[outcome, dose]).withColumn("_b", F.when(F.col(dose) > 0, place).otherwise(0))
    names = [f"bin_{b}" for b in range(1, len(edges) + 2)]
    d = d.select("*", *[(F.col("_b") == i + 1).cast("double").alias(n) for i, n in enumerate(names)])
    w = two_way_within(d, [outcome, *names])
    return ols(w, f"{outcome}_w", [f"{n}_w" for n in names], cluster)


def mechanism(panel: DataFrame, outcomes: list[str], did: str) -> DataFrame:
    """Two-way effect of the treatment on each outcome, standardised over all rows; one aggregation for all."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in outcomes)
    long = panel.select("unit", "t", F.col(did).alias("_did"), F.expr(f"stack({len(outcomes)}, {names}) AS (channel, v)")).filter("v IS NOT NULL")
    scale = long.groupBy("channel").agg(F.avg("v").alias("mean"), F.nullif(F.stddev_pop("v"), F.lit(0.0)).alias("sd"))
    z = long.join(scale, "channel").select("unit", "t", "_did", "channel", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("v"))
    return heterogeneity(z, "v", "_did", "channel")


def wild_bootstrap(panel: DataFrame, outcome: str, treatment: str, draws: int, cluster: str = "cl") -> DataFrame:
    """Two-way coefficient and the share of sign-flipped draws at least as large: clusters' outcomes under no effect, signs by keyed draw.

    Only each cluster's sum of x times y changes from draw to draw.
    """
    from tessella.functions.columns import keyed_draw

    w = two_way_within(panel.na.drop(subset=[outcome, treatment]), [outcome, treatment])
    c = w.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(F.col(f"{treatment}_w") * F.col(f"{outcome}_w")).alias("xy"), F.sum(F.col(f"{treatment}_w") ** 2).alias("xx"))
    xx, coef = c.agg(F.sum("xx"), F.sum("xy") / F.sum("xx")).first()
    d = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.when(keyed_draw(F.col("draw"), F.col("c")) < 0.5, -1.0).otherwise(1.0)
    null = d.groupBy("draw").agg((F.sum(sign * F.col("xy")) / F.lit(xx)).alias("b"))
    return null.agg(F.lit(coef).alias("coef"), F.avg((F.abs("b") >= F.lit(abs(coef))).cast("double")).alias("p"))


def spillover(panel: DataFrame, exposure: DataFrame, outcome: str, did: str, cluster: str = "cl") -> DataFrame:
    """Two-way effects of the own treatment and of the neighbours' earlier one (unit, t, exposure)."""
    j = panel.join(exposure.select("unit", "t", F.col("exposure").alias("near")), ["unit", "t"]).na.drop(subset=["near"])
    return twfe(j, outcome, did, ("near",), cluster)


def unit_bootstrap(panel: DataFrame, outcome: str, treatment: str, draws: int = 160, cluster: str = "cl") -> DataFrame:
    """Two-way coefficient with its clustered error, and over resamples of whole units its mean, deviation, 95 % percentile interval and two-sided sign p.

    Each draw takes as many units as there are, with replacement, by keyed draws; a unit taken twice is two units. Unit means don't change
    then, so a draw's sums by period of the units' deviations give its moments. Draws without variation of the treatment are left out; under 8
    units, or with too few draws left (20, and 30 %), the figures of the draws are null.
    """
    d = panel.select("unit", cluster, "t", F.col(outcome).cast("double").alias("y"), F.col(treatment).cast("double").alias("x")).na.drop()
    units = numbered(d.select("unit").distinct(), keyed_draw(F.lit(0), F.col("unit")), "unit", "_i")
    n = units.count()
    slot = d.sparkSession.range(n * draws).select((F.expr(f"id div {max(n, 1)}") + 1).alias("draw"), (F.col("id") % max(n, 1) + 1).alias("slot"))
    taken = slot.withColumn("_i", F.floor(keyed_draw(F.col("draw"), F.col("slot")) * n) + 1).groupBy("draw", "_i").agg(F.count("*").alias("w")).join(units, "_i").select("draw", "unit", "w")
    u = Window.partitionBy("unit")
    dev = d.select("unit", "t", "x", "y", (F.col("x") - F.avg("x").over(u)).alias("a"), (F.col("y") - F.avg("y").over(u)).alias("b"))
    w = F.col("w")
    sums = {"n": w, "x": w * F.col("x"), "y": w * F.col("y"), "a": w * F.col("a"), "b": w * F.col("b"), "aa": w * F.col("a") * F.col("a"), "ab": w * F.col("a") * F.col("b")}
    by = dev.join(taken, "unit").groupBy("draw", "t").agg(*[F.sum(v).alias(f"s_{k}") for k, v in sums.items()])
    each = Window.partitionBy("draw")
    off = lambda c: F.col(f"s_{c}") / F.col("s_n") - F.sum(f"s_{c}").over(each) / F.sum("s_n").over(each)
    by = by.withColumn("p", off("x")).withColumn("q", off("y"))
    xx = F.sum(F.expr("s_aa - 2 * p * s_a + s_n * p * p"))
    xy = F.sum(F.expr("s_ab - p * s_b - q * s_a + s_n * p * q"))
    coefs = by.groupBy("draw").agg(F.when(xx > 1e-9, xy / xx).alias("c")).filter("c IS NOT NULL")
    share = lambda hit: F.avg(hit.cast("double"))
    boot = coefs.agg(
        F.count("*").alias("draws_used"), F.avg("c").alias("boot_mean"), F.stddev_samp("c").alias("boot_sd"), F.percentile("c", 0.025).alias("low"), F.percentile("c", 0.975).alias("high"),
        (2 * F.least(share(F.col("c") <= 0), share(F.col("c") >= 0))).alias("p"),
    )
    enough = (F.lit(n) >= 8) & (F.col("draws_used") >= max(20, int(0.3 * draws)))
    base = twfe(d, "y", "x", cluster=cluster).select("coef", "stderr", "t_value")
    return base.join(boot, F.lit(True)).select("coef", "stderr", "t_value", "draws_used", *[F.when(enough, F.col(c)).alias(c) for c in ("boot_mean", "boot_sd", "low", "high", "p")])  # one row each


def schedule_permutation(panel: DataFrame, outcome: str, treatment: str, draws: int = 200, cluster: str = "cl") -> DataFrame:
    """Two-way coefficient and clustered t, and how they lie among refits with the units' start periods dealt anew.

    A unit's cohort is its first treated period (9999: never); a draw reorders the cohorts over the units, so their numbers stay. p counts
    the observed schedule among the draws. Draws without variation are left out; without two cohorts, or with too few draws left (30, and
    30 %), the figures of the draws are null.

    Units times draws are merge-joined, since Spark's size check counts the units alone and would send them all through the driver.
    """
    work = Stages(panel.sparkSession, "permutation")
    d = work.cut(panel.select("unit", cluster, "t", F.col(outcome).cast("double").alias("y"), F.col(treatment).cast("double").alias("x")).na.drop(), "rows")
    cohorts = d.groupBy("unit").agg(F.coalesce(F.min(F.when(F.col("x") >= 0.5, F.col("t"))), F.lit(9999)).alias("cohort"))
    kinds, units = cohorts.agg(F.countDistinct("cohort"), F.count("*")).first()
    slots = numbered(cohorts, keyed_draw(F.lit(0), F.col("unit")), "unit", "_i").select("_i", "cohort")
    each = spread(cohorts.select("unit"), units * draws, "unit").select("unit", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    dealt = numbered(each, keyed_draw(F.col("draw"), F.col("unit")), "unit", "_i", ("draw",)).join(slots.hint("merge"), "_i").select("draw", "unit", "cohort")
    y = two_way_within(d, ["y"]).select("unit", F.col(cluster).alias("c"), "t", F.col("y_w").alias("y"))
    # a unit's few rows go along with its draws in one array: no row of a draw is shuffled or sorted, and the unit's mean is a count
    on = lambda t: (F.col("cohort") < 9999) & (t >= F.col("cohort"))
    rows = y.groupBy("unit").agg(F.collect_list(F.struct("c", "t", "y")).alias("rows"))
    x = dealt.join(rows.hint("merge"), "unit").select("draw", "cohort", (F.size(F.filter("rows", lambda row: on(row["t"]))) / F.size("rows")).alias("mean"), F.explode("rows").alias("row"))
    x = x.select("draw", "row.*", on(F.col("row.t")).cast("double").alias("x"), "mean")
    # x less the unit's mean has few values: rows of a draw, cluster and period that are alike in it are counted, and only these counts are joined
    alike = work.cut(x.groupBy("draw", "c", "t", "x", "mean").agg(F.count("*").alias("n"), F.sum("y").alias("y")), "alike")
    one = Window.partitionBy("draw")
    period = alike.groupBy("draw", "t").agg(F.sum(F.col("x") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    period = period.select("draw", "t", (F.col("s") / F.col("n") - F.sum("s").over(one) / F.sum("n").over(one)).alias("p"))
    w = alike.join(period, ["draw", "t"]).select("draw", "c", "y", "n", (F.col("x") - F.col("mean") - F.col("p")).alias("x"))
    by = w.groupBy("draw", "c").agg(F.sum(F.col("n") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("n").alias("n"))
    by = by.withColumn("b", F.sum("xy").over(one) / F.when(F.sum("xx").over(one) > 1e-9, F.sum("xx").over(one)))
    fit = by.groupBy("draw").agg(F.first("b").alias("b"), F.sum("xx").alias("xx"), F.sum((F.col("xy") - F.col("b") * F.col("xx")) ** 2).alias("m"), F.count("*").alias("g"), F.sum("n").alias("n")).filter("b IS NOT NULL")
    small = F.col("g") / F.greatest(F.col("g") - 1, F.lit(1))
    null = fit.select("b", F.abs(F.col("b") * F.col("xx") / F.nullif(F.sqrt(F.col("m") * small), F.lit(0.0))).alias("t"))
    base = twfe(d, "y", "x", cluster=cluster).select("coef", "t_value")
    seen = base.first()
    far = lambda c, v: (1 + F.sum(F.coalesce((F.round(c, 9) >= F.lit(round(abs(v), 9))).cast("int"), F.lit(0)))) / (1 + F.count("*")) if v is not None else F.lit(None).cast("double")
    tests = null.withColumn("size", F.abs("b")).agg(
        F.count("*").alias("draws_used"), F.avg("b").alias("null_mean"), F.stddev_samp("b").alias("null_sd"), F.percentile("t", 0.95).alias("null_t95"),
        far("size", seen["coef"]).alias("p_coef"), far("t", seen["t_value"]).alias("p_t"),
    )
    enough = (F.lit(kinds) >= 2) & (F.col("draws_used") >= max(30, int(0.3 * draws)))
    return base.join(tests, F.lit(True)).select("coef", "t_value", "draws_used", *[F.when(enough, F.col(c)).alias(c) for c in ("null_mean", "null_sd", "null_t95", "p_coef", "p_t")])  # one row each
