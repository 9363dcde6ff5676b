"""Whether effects and scores hold elsewhere: rules of phases, outcomes outside of the panel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import quantiles, rank_pct
from tessella.operators.regression import inverse, ols_by, p_value, two_way_within
from tessella.sources.tables import Stages

#: Labels of the phase portrait that count as fragile; fixed values.
FRAGILE = ("centrifugal_fragility", "rotational_transition")
#: Quantiles of speed and |vorticity| that rules cut at; fixed values.
SPEED_CUTS, VORTICITY_CUTS, JOINT_CUT = (0.60, 0.67, 0.75), (0.67, 0.75), 0.67
#: Shares of flagged units between which a rule is estimated; fixed values.
SHARES = (0.08, 0.92)


def phase_flags(base: DataFrame, least: int) -> DataFrame:
    """(unit, rule, flag): every rule's flag of every unit of ``base`` (unit, speed, label, vorticity), which has a row a unit. Rows without a speed go; a null
    vorticity flags nothing, and its rules are made only if 2 * ``least`` units have one."""
    b = base.filter("speed IS NOT NULL").select("unit", "speed", "label", F.abs("vorticity").alias("v"))
    name = lambda what, q: f"phase_{what}_q{round(100 * q)}"
    fast = dict(zip(SPEED_CUTS, quantiles(b, "speed", list(SPEED_CUTS)), strict=True))
    at_least = lambda c, cut: F.coalesce(F.col(c) >= F.lit(cut), F.lit(False))
    rules = {"phase_label_fragility_set": F.coalesce(F.col("label").isin(*FRAGILE), F.lit(False))}
    rules |= {name("flow_speed", q): at_least("speed", cut) for q, cut in fast.items()}
    if b.filter("v IS NOT NULL").limit(2 * least).count() >= 2 * least:
        turning = dict(zip(VORTICITY_CUTS, quantiles(b, "v", list(VORTICITY_CUTS)), strict=True))
        rules |= {name("vorticity_abs", q): at_least("v", cut) for q, cut in turning.items()}
        rules[name("flow_x_vorticity", JOINT_CUT)] = at_least("speed", fast[JOINT_CUT]) & at_least("v", turning[JOINT_CUT])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.cast("int").alias("flag")) for k, c in rules.items()]))
    return b.select("unit", each.alias("x")).select("unit", "x.rule", "x.flag")


def phase_rule_grid(panel: DataFrame, phase: DataFrame, start: int, least: int = 18, cluster: str = "cl") -> DataFrame:
    """For each rule by which units are called fragile: the two-way effect, its interaction with the flag, and the effect on either kind of units.

    ``panel``: unit, cl, t, y, did, treated; ``phase``: unit, t, speed, label, vorticity, of which the last period before ``start`` that both have
    counts. Flag and treated units have trends of their own; errors are clustered. Units without a phase have the flag 0. Rules with a share of
    flagged units outside of SHARES, or with under ``least`` units of a kind, are told by ``status``. All rules are estimated in the same passes.
    """
    work = Stages(panel.sparkSession, "rules")
    d = work.cut(panel.select("unit", F.col(cluster).alias("cl"), "t", "y", "did", "treated"), "panel")
    both = d.filter(F.col("t") < start).select("t").distinct().join(phase.select("t").distinct(), "t").agg(F.max("t")).first()[0]
    base = phase.filter(F.col("t") == F.lit(both)).groupBy("unit").agg(*[F.first(c).alias(c) for c in ("speed", "label", "vorticity")])
    flags = work.cut(phase_flags(base, least), "flags")
    rules = flags.groupBy("rule").agg(F.avg("flag").alias("share"))
    units = d.select("unit").distinct().join(flags.select("rule").distinct(), F.lit(True)).join(flags, ["unit", "rule"], "left").fillna(0, ["flag"])  # a row a unit and rule
    units = work.cut(units.join(rules, "rule"), "units")
    sizes = units.groupBy("rule").agg(F.first("share").alias("share"), F.sum("flag").alias("flagged"), F.sum(1 - F.col("flag")).alias("others"))
    told = F.when(~F.col("share").between(*SHARES), "extreme_group_share").when(F.least("flagged", "others") < least, "too_few_units_in_rule_group").otherwise("ok")
    sizes = work.cut(sizes.withColumn("status", told), "sizes")
    first = d.agg(F.min("t")).first()[0]
    since = (F.col("t") - F.lit(first)).cast("double")
    x = d.na.drop().join(units.join(sizes.filter("status = 'ok'").select("rule"), "rule"), "unit")
    x = x.withColumns({"did": F.col("did").cast("double"), "did_x_rule": F.col("did") * F.col("flag"), "rule_trend": F.col("flag") * since, "treated_trend": F.col("treated") * since})
    xs = ["did", "did_x_rule", "rule_trend", "treated_trend"]
    w = work.cut(two_way_within(x.select("rule", "unit", "cl", "t", "y", *xs), ["y", *xs], group=("rule",)), "within")
    fit = ols_by(w, "rule", "y_w", [f"{c}_w" for c in xs], "cl").collect()  # four rows a rule
    got: dict = {}
    for r in fit:
        got.setdefault(r.rule, {})[r.term] = r
    rows = []
    for rule, terms in got.items():
        main, inter = terms["did_w"], terms["did_x_rule_w"]
        ps = [None if r.t_value is None else p_value(abs(r.t_value), max(1, r.n_clusters - 1)) for r in (main, inter)]
        rows.append((rule, main.coef, main.stderr, ps[0], inter.coef, inter.stderr, ps[1], main.coef + inter.coef, main.n_obs, main.n_clusters))
    names = "rule string, coef_main double, stderr_main double, p_main double, coef_interaction double, stderr_interaction double, p_interaction double, effect_flagged double, n_obs long, n_clusters long"
    return sizes.join(panel.sparkSession.createDataFrame(rows, names), "rule", "left")


def outside_panel(panel: DataFrame, score: str, controls: list[str], indicators: list[str]) -> DataFrame:
    """(indicator, cl, t, y, now, score, controls): cluster means by period of ``panel`` (unit, cl, t), stacked by indicator, with its value one row later as y; rows without one go."""
    means = panel.groupBy("cl", "t").agg(*[F.avg(c).alias(c) for c in dict.fromkeys([score, *controls, *indicators])])
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in indicators)
    long = means.select("cl", "t", F.col(score).alias("score"), *[F.col(c).alias(f"c_{c}") for c in controls], F.expr(f"stack({len(indicators)}, {stack}) AS (indicator, now)"))
    return long.withColumn("y", F.lead("now").over(Window.partitionBy("indicator", "cl").orderBy("t"))).filter("y IS NOT NULL")


def _fits(rows: list, names: list[str]) -> dict[str, float]:
    """Out-of-sample R2 of least squares with an intercept, from the moments of both parts: of the controls, and with the score."""
    size, out = len(names), {}
    part = {r.test: r for r in rows}
    if set(part) != {False, True}:
        return {}

    def gram(r) -> np.ndarray:
        g, it = np.zeros((size, size)), iter(r[2:])
        for i in range(size):
            for j in range(i, size):
                g[i, j] = g[j, i] = next(it)
        return g

    train, test = gram(part[False]), gram(part[True])
    y = names.index("y")
    for key, used in (("base", [n for n in names if n not in ("y", "score")]), ("plus", [n for n in names if n != "y"])):
        at = [names.index(n) for n in used]
        beta = inverse(train[np.ix_(at, at)], train[0, 0])[0] @ train[at, y]
        left = test[y, y] - 2 * beta @ test[at, y] + beta @ test[np.ix_(at, at)] @ beta
        total = test[y, y] - test[0, y] ** 2 / test[0, 0]
        out[key] = float(1 - left / total) if total > 0 else None
    return out


def external_validity(panel: DataFrame, score: str, controls: list[str], indicators: list[str], least: int = 120, ranked: int = 12) -> DataFrame:
    """A row for each indicator with ``least`` rows: the score's two-way coefficient on the indicator one period later (HC1) beside the controls, R2
    within, out-of-sample R2 of the controls and with the score in the last periods (three; two of four), their difference, and the mean over periods with ``ranked``
    clusters of the rank correlation of score and indicator. Both R2 are null with fewer than 80 rows to learn from or 40 to test.
    """
    work, spark = Stages(panel.sparkSession, "validity"), panel.sparkSession
    d = work.cut(outside_panel(panel, score, controls, indicators), "rows")
    enough = d.groupBy("indicator").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("indicator")
    d = work.cut(d.join(enough, "indicator"), "kept")
    cs = [f"c_{c}" for c in controls]
    w = work.cut(two_way_within(d.select("indicator", "cl", "t", "y", "score", *cs), ["y", "score", *cs], unit="cl", group=("indicator",)), "within")
    fit = ols_by(w, "indicator", "y_w", ["score_w", *[f"{c}_w" for c in cs]]).filter("term = 'score_w'")

    times = d.select("indicator", "t").distinct().groupBy("indicator").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    split = times.filter("size(ts) >= 4").select("indicator", F.expr("CASE WHEN size(ts) >= 5 THEN ts[size(ts) - 3] ELSE ts[size(ts) - 2] END").alias("split"))
    names = ["one", *cs, "score", "y"]
    parted = d.join(split, "indicator").withColumn("one", F.lit(1.0)).withColumn("test", F.col("t") > F.col("split")).na.drop(subset=names)
    # Moments of deviations: the intercept takes up the shift, and what varies little keeps its digits.
    centre = parted.groupBy("indicator").agg(*[F.avg(c).alias(f"_m_{c}") for c in names[1:]])
    parted = parted.join(centre, "indicator").withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in names[1:]})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments: dict = {}
    for r in parted.groupBy("indicator", "test").agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).collect():  # two rows an indicator
        moments.setdefault(r.indicator, []).append(r)
    rows = []
    for name, parts in moments.items():
        size = {r.test: r[2] for r in parts}
        r2 = _fits(parts, names) if size.get(False, 0) >= 80 and size.get(True, 0) >= 40 else {}
        rows.append((name, r2.get("base"), r2.get("plus")))
    uplift = spark.createDataFrame(rows, "indicator string, r2_base double, r2_plus double")

    part = Window.partitionBy("indicator", "t")  # a period's clusters
    pair = d.filter("score IS NOT NULL AND now IS NOT NULL").select("indicator", "t", rank_pct(F.col("score"), part).alias("a"), rank_pct(F.col("now"), part).alias("b"))
    by = pair.groupBy("indicator", "t").agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n")).filter((F.col("n") >= ranked) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    rho = by.groupBy("indicator").agg(F.avg("rho").alias("rank_correlation"), F.count("*").alias("periods"))
    out = fit.join(uplift, "indicator", "left").join(rho, "indicator", "left")
    return out.select("indicator", "coef", "stderr", "t_value", "n_obs", "r2", "r2_base", "r2_plus", (F.col("r2_plus") - F.col("r2_base")).alias("uplift"), "rank_correlation", "periods")


def stacked_placebo(panel: DataFrame, outcome: str, leads: tuple[int, ...] = (2, 3), pre: int = 2, post: int = 2, controls: tuple[str, ...] = (), least_treated: int = 3, least_members: int = 6, least_rows: int = 60, cluster: str = "cl") -> DataFrame:
    """lead, cell, coef, stderr, t_value, n_treated, n_members, n_obs of two-way effects of treatments that never were, and (cell null) their mean by treated units.

    ``panel``: unit, t, cohort (9999: never), ``cluster``, the outcome and controls. Every cohort is moved ``lead`` periods ahead, not before the first period plus ``pre``; a cell is a
    lead and a moved start, with ``least_treated`` units that have it and ``least_members`` with a true start after it (those of the cell among them), in the periods from ``pre`` before to
    ``post`` after. Treated units have a trend of their own. Cells of under ``least_rows`` rows, 10 units or 4 periods are left out. All cells are estimated in the same passes; the pooled
    error takes cells as independent.
    """
    work = Stages(panel.sparkSession, "stacked")
    names = list(dict.fromkeys([outcome, *controls]))
    d = work.cut(panel.select("unit", F.col(cluster).alias("cl"), "t", "cohort", *names).na.drop(), "panel")
    low, high = d.agg(F.min("t"), F.max("t")).first()
    units = work.cut(d.groupBy("unit").agg(F.min("cohort").alias("cohort")), "units")
    moved = F.greatest(F.col("cohort") - F.col("lead"), F.lit((low or 0) + max(1, pre)))
    fake = units.filter("cohort < 9999").withColumn("lead", F.explode(F.array(*[F.lit(k) for k in leads]))).withColumn("g", moved).filter(F.col("g") <= (high or 0) - max(1, post))
    fake = work.cut(fake.select("lead", "g", "unit"), "fake")
    cells = fake.groupBy("lead", "g").agg(F.count("*").alias("n_treated")).filter(F.col("n_treated") >= least_treated)
    member = cells.join(units, F.col("cohort") > F.col("g")).join(fake.withColumn("own", F.lit(1)), ["lead", "g", "unit"], "left").fillna(0, ["own"])  # few cells: leads x cohorts
    sizes = member.groupBy("lead", "g").agg(F.count("*").alias("n_members")).filter(F.col("n_members") >= least_members)
    member = work.cut(member.join(sizes, ["lead", "g"]).select(F.concat_ws(":", "lead", "g").alias("cell"), "lead", "g", "unit", "own", "n_treated", "n_members"), "members")
    x = d.join(member, "unit").filter(F.col("t").between(F.col("g") - pre, F.col("g") + post))
    x = x.withColumns({"did": (F.col("own") * (F.col("t") >= F.col("g")).cast("int")).cast("double"), "trend": (F.col("own") * (F.col("t") - F.col("g"))).cast("double")})
    x = work.cut(x, "rows")
    enough = x.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("u"), F.countDistinct("t").alias("p")).filter((F.col("n") >= least_rows) & (F.col("u") >= 10) & (F.col("p") >= 4)).select("cell")
    xs = ["did", *controls, "trend"]
    w = work.cut(two_way_within(x.join(enough, "cell").select("cell", "unit", "cl", "t", outcome, *xs), [outcome, *xs], group=("cell",)), "within")
    fit = ols_by(w, "cell", f"{outcome}_w", [f"{c}_w" for c in xs], "cl").filter("term = 'did_w'").select("cell", "coef", "stderr", "n_obs")
    told = fit.join(member.groupBy("cell").agg(*[F.first(c).alias(c) for c in ("lead", "n_treated", "n_members")]), "cell")
    told = work.cut(told, "cells")
    share = told.groupBy("lead").agg(F.sum("n_treated").alias("total"))
    v = F.col("n_treated") / F.col("total")
    both = told.join(share, "lead").groupBy("lead").agg(
        F.sum(v * F.col("coef")).alias("coef"), F.sqrt(F.sum(v * v * F.col("stderr") * F.col("stderr"))).alias("stderr"), F.sum("n_treated").alias("n_treated"), F.sum("n_members").alias("n_members"), F.sum("n_obs").alias("n_obs"),
    )
    columns = ["lead", "cell", "coef", "stderr", "n_treated", "n_members", "n_obs"]
    out = told.select(columns).union(both.withColumn("cell", F.lit(None).cast("string")).select(columns))
    return out.withColumn("t_value", F.col("coef") / F.nullif(F.col("stderr"), F.lit(0.0)))
