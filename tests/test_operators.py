"""Edge cases: nulls and NaN, single periods, gaps, constants, ties, one class, empty input."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.columns import norm_key, zscore
from tessella.operators import dynamics, events, imputation, indices, metrics, quality, regression, sequences, shaping
from tessella.sources import tables
from tessella.streaming import monitor

PANEL = "unit string, grp string, t int, value double"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def test_tolerant_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("unit,t,value\na,1,2.5\nb,x,NaN\n,3,oops\n")
    schema = T.StructType([T.StructField("unit", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("more", T.LongType())])
    got = [tuple(r) for r in tables.read_panel(spark, str(tmp_path / "a.csv"), schema).collect()]
    assert got == [("a", 1, 2.5, None), ("b", None, None, None), (None, 3, None, None)]


def test_sinks(spark, tmp_path):
    df = panel(spark, [("a", "g", 1, 1.0)])
    tables.write_table(df.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).schema.names == df.schema.names
    for v in ("v1", "v2"):
        tables.write_snapshot({"panel": df}, str(tmp_path), v)
        tables.append_history(df, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 2 and spark.read.json(str(tmp_path / "history")).count() == 2
    assert tables.signature(df).first() == tables.signature(df.repartition(3)).first()
    assert tables.signature(df).first() != tables.signature(df.withColumn("value", F.lit(2.0))).first()


def test_spells_stop_at_gaps(spark):
    rows = [("a", "g", t, 0.0) for t in (1, 2, 4, 5, 6)] + [("b", "g", 1, 0.0)]
    s = panel(spark, rows).withColumn("state", F.when(F.col("t") == 6, "y").otherwise("x"))
    got = sorted(tuple(r) for r in sequences.spells(s, "x").collect())
    assert got == [("a", 1, 2, 2, 0), ("a", 4, 5, 2, 1), ("b", 1, 1, 1, 0)]
    assert sequences.spells(s, "none").count() == 0


def test_constant_series(spark):
    df = panel(spark, [("a", "g", 1, 5.0), ("b", "g", 1, 5.0), ("c", "g", 1, None)])
    got = {r.unit: (r.in_period, r.in_all, r.plain) for r in indices.scale_by_period(df, "value").collect()}
    assert got == {"a": (0.0, 0.5, 0.0), "b": (0.0, 0.5, 0.0), "c": (None, None, None)}
    assert {r.z for r in indices.zscores(df, "value").collect()} == {0.0, None}


def test_interpolation(spark):
    df = panel(spark, [("a", "g", t, v) for t, v in ((1, None), (2, 1.0), (5, None), (6, 3.0), (9, None))] + [("b", "g", 1, None)])
    both = [r.filled for r in imputation.interpolate(df, "value").orderBy("unit", "t").collect()]
    assert both == [1.0, 1.0, 2.0, 3.0, 3.0, None]
    inside = [r.filled for r in imputation.interpolate(df, "value", edges=False).orderBy("unit", "t").collect()]
    assert inside == [None, 1.0, 2.0, 3.0, None, None]


def test_single_rows_and_empty_input(spark):
    one = panel(spark, [("a", "g", 1, 2.0)])
    assert dynamics.dynamics_table(one, 1).first().growth is None
    assert dynamics.early_warning(one).first().ar1 is None
    empty = one.limit(0)
    for fn in (dynamics.pulse_state, dynamics.early_warning, dynamics.group_envelope, shaping.seasonal_year_panel):
        assert fn(empty).count() == 0


def test_bad_intervals_have_no_periods(spark):
    reg = spark.createDataFrame([(1, 1, 5, 3, 0.5, "F"), (2, 1, 5, 6, 0.5, "F")], "event long, cl int, start_t int, end_t int, intensity double, kind string")
    assert [r.t for r in events.expand_intervals(reg).orderBy("t").collect()] == [5, 6]


def test_auc_of_one_class_and_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.auc(tied, "y", "p").first().auc == 0.5


def test_strict_filter_falls_back(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 0, 0)], "unit string, is_objective int, is_verified int")
    assert {r.unit for r in quality.strict_filter(df, 0.3).collect()} == {"a"}
    assert {r.unit for r in quality.strict_filter(df, 0.9).collect()} == {"a", "b"}


def test_weighted_blend(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.5), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(indices.weighted_blend([(F.col("a"), 0.7), (F.col("b"), 0.3)])).collect()]
    assert got == pytest.approx([0.7, 0.5, None]) if None not in got else got[:2] == pytest.approx([0.7, 0.5]) and got[2] is None


def test_never_treated_units_are_controls(spark):
    rows = [(u, t, float(t + (5 if u == "a" and t >= 3 else 0)), 3 if u == "a" else 9999) for u in ("a", "b", "c") for t in range(6)]
    att = regression.staggered_att(spark.createDataFrame(rows, "unit string, t int, value double, cohort int"), -2, 2)
    got = {r.event_t: r.att for r in att.collect()}
    assert got == pytest.approx({-2: 0.0, -1: 0.0, 0: 5.0, 1: 5.0, 2: 5.0})


def test_p_values():
    assert regression.p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert regression.p_value(0.0, 5) == pytest.approx(1.0)


def test_norm_key(spark):
    df = spark.createDataFrame([("  São-Tomé & Co. ",), (None,)], "x string")
    assert [r[0] for r in df.select(norm_key(F.col("x"))).collect()] == ["sao tome and co", None]


def test_stream_appends_finished_windows(spark, tmp_path):
    stream = monitor.windowed_alerts(monitor.read_events(spark, "/root/testdata/sf0.001"))
    for _ in range(2):  # the second run finds nothing new
        monitor.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("start", "event_type").distinct().count() > 0


def test_zscore_has_no_division_by_zero(spark):
    from pyspark.sql import Window

    df = panel(spark, [("a", "g", 1, 1.0)])
    assert df.select(zscore(F.col("value"), Window.partitionBy("t"), population=False).alias("z")).first().z == 0.0


def _twfe_by_hand(rows):
    """(unit copy, t, y, x): the two-way coefficient, None without variation."""
    import numpy as np

    y, x = (np.array([r[i] for r in rows], dtype=float) for i in (2, 3))
    mean = lambda v, i: np.array([np.mean([b for q, b in zip(rows, v) if q[i] == r[i]]) for r in rows])
    within = lambda v: v - mean(v, 0) - mean(v, 1) + v.mean()
    x, y = within(x), within(y)
    return float(x @ y / (x @ x)) if x @ x > 1e-9 else None


def test_unit_bootstrap_and_schedule_permutation(spark):
    import hashlib

    import numpy as np

    start = {0: 2, 1: 2, 2: 3, 3: 9999, 4: 9999, 5: 3, 6: 9999, 7: 2, 8: 9999, 9: 9999}
    draw = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    # unit 4 lacks a period
    rows = [(u, u, t, draw("y", u, t) + t + 2.0 * (t >= start[u]), float(t >= start[u])) for u in start for t in range(5) if (u, t) != (4, 1)]
    df = spark.createDataFrame(rows, "unit int, cl int, t int, y double, did double")
    plain = [(u, t, y, x) for u, _, t, y, x in rows]
    order = sorted(start, key=lambda u: (draw(0, u), u))
    got = regression.unit_bootstrap(df, "y", "did", 40).first()
    coefs = [_twfe_by_hand([((k, u), t, y, x) for k in range(1, 11) for u in [order[int(draw(d, k) * 10)]] for v, t, y, x in plain if v == u]) for d in range(1, 41)]
    coefs = np.array([c for c in coefs if c is not None])
    assert got.coef == pytest.approx(_twfe_by_hand(plain)) and got.draws_used == len(coefs)
    assert (got.boot_mean, got.boot_sd, got.low, got.high) == pytest.approx((coefs.mean(), coefs.std(ddof=1), *np.quantile(coefs, [0.025, 0.975])))
    assert got.p == pytest.approx(2 * min((coefs <= 0).mean(), (coefs >= 0).mean()))
    got = regression.schedule_permutation(df, "y", "did", 40).first()
    coefs = []
    for d in range(1, 41):
        new = {u: start[order[i]] for i, u in enumerate(sorted(start, key=lambda u: (draw(d, u), u)))}
        coefs.append(_twfe_by_hand([(u, t, y, float(t >= new[u])) for u, t, y, _ in plain]))
    assert got.draws_used == 40 and (got.null_mean, got.null_sd) == pytest.approx((np.mean(coefs), np.std(coefs, ddof=1)))
    assert got.p_coef == pytest.approx((1 + sum(abs(c) >= abs(got.coef) for c in coefs)) / 41)
    few = regression.unit_bootstrap(df.filter("unit < 5"), "y", "did", 40).first()
    assert few.coef is not None and few.p is None


def test_no_window_over_all_units(spark):
    df = spark.createDataFrame([(f"u{i}", "g", t, float((i * 7 + t * 3) % 11 + 1)) for i in range(4) for t in range(6)], PANEL)
    flags = spark.createDataFrame([(i, float(i), i % 2) for i in range(30)], "id int, p double, toxic int")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(specified" not in plan(dynamics.unit_envelope(df.selectExpr("unit", "t", "value AS index", "value AS risk", "value AS accel_velocity", "value AS risk_velocity")))
    ranked = [x for x in plan(metrics.permutation_p(flags, "p", "toxic", "id", 3)).split("\n") if "row_number" in x]
    assert ranked and all("_range" in x for x in ranked)


def test_twfe_drops_incomplete_rows_first(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"u{u}", u % 2, t, float(rng.normal() + u + t) if (u, t) != (1, 2) else None, float(u % 2 and t >= 2), float(rng.normal())) for u in range(4) for t in range(4)]
    df = spark.createDataFrame(rows, "unit string, cl int, t int, y double, d double, x double")
    got = regression.twfe(df, "y", "d").first()
    kept = [r for r in rows if r[3] is not None]
    means = lambda k, i: np.array([np.mean([q[i] for q in kept if q[k] == r[k]]) for r in kept])
    w = lambda i: np.array([r[i] for r in kept]) - means(0, i) - means(2, i) + np.mean([r[i] for r in kept])
    assert got.coef == pytest.approx(float(w(4) @ w(3) / (w(4) @ w(4)))) and got.n_obs == 15


def _within(rows, unit, period, x):
    import numpy as np

    x = np.asarray(x, dtype=float)
    mean = lambda keys: np.array([x[[k == j for k in keys]].mean() for j in keys])
    return x - mean(unit) - mean(period) + x.mean()


@pytest.mark.parametrize("kind", ["event_study", "dose_bins"])
def test_several_dummies(spark, kind):
    """Coefficients and clustered errors of the multi-regressor designs against plain least squares."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(u, t, float(rng.normal()), 5 if u % 3 == 0 else 7 if u % 3 == 1 else 9999, float(rng.random() * (u % 3 > 0))) for u in range(18) for t in range(12)]
    df = spark.createDataFrame(rows, "unit long, t int, y double, cohort int, dose double")
    unit, period, y = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
    if kind == "event_study":
        got = {r.term: r for r in regression.event_study(df, "y").collect()}
        e = [max(-3, min(3, r[1] - r[3])) if r[3] < 9999 else None for r in rows]
        dummies = {f"e{'m' if k < 0 else 'p'}{abs(k)}_w": [float(v == k) for v in e] for k in (-3, -2, 0, 1, 2, 3)}
    else:
        got = {r.term: r for r in regression.dose_bins(df, "y", "dose", cluster="unit").collect()}
        edges = np.quantile([r[4] for r in rows if r[4] > 0], [1 / 3, 2 / 3])
        place = [0 if r[4] <= 0 else 1 + int((r[4] > edges).sum()) for r in rows]
        dummies = {f"bin_{b}_w": [float(v == b) for v in place] for b in (1, 2, 3)}
    x = np.column_stack([_within(rows, unit, period, d) for d in dummies.values()])
    yw = _within(rows, unit, period, y)
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ yw
    scores = np.array([sum(x[i] * (yw[i] - x[i] @ beta) for i in range(len(rows)) if unit[i] == u) for u in sorted(set(unit))])
    g, n, k = len(scores), len(rows), x.shape[1]
    se = np.sqrt(np.diag(inv @ (scores.T @ scores * g / (g - 1) * (n - 1) / (n - k)) @ inv))
    for i, name in enumerate(dummies):
        assert got[name].coef == pytest.approx(beta[i], abs=1e-8) and got[name].stderr == pytest.approx(se[i], rel=1e-6)


def test_synthetic_control(spark):
    import numpy as np

    from tessella.operators import estimators

    rng = np.random.default_rng(5)
    y = {u: rng.normal(size=8).cumsum() + 20 + (5 if u == 3 else 0) for u in range(12)}
    cohort = {u: 5 if u in (2, 3) else 9999 for u in y}
    rows = [(u, t, float(y[u][t]), cohort[u]) for u in y for t in range(8) if (u, t) != (7, 1)] + [(20, t, None, 9999) for t in range(8)]
    got = {r.t: r for r in estimators.synthetic_control(spark.createDataFrame(rows, "unit long, t int, y double, cohort int"), "y", 5).collect()}
    donors = [u for u in y if cohort[u] > 5 and u != 7]
    pre = np.stack([y[u][:5] for u in donors], axis=1)
    w = np.maximum(pre.T @ np.linalg.solve(pre @ pre.T + np.eye(5), y[3][:5]), 0)
    for t in range(8):
        assert got[t].actual == pytest.approx(y[3][t]) and got[t].synthetic == pytest.approx(sum(y[u][t] * v for u, v in zip(donors, w)) / w.sum())


def test_low_rank_counterfactual(spark):
    import numpy as np

    from tessella.operators import estimators

    rng = np.random.default_rng(7)
    full = rng.normal(size=(20, 1)) @ rng.normal(size=(1, 8)) * 4 + 10 + rng.normal(size=(20, 8)) * 0.01
    rows = [(u, t, float(full[u, t]) if (u, t) != (9, 3) else None, 6 if u < 5 else 9999) for u in range(20) for t in range(8)]
    got = {(r.unit, r.t): r.counterfactual for r in estimators.low_rank_counterfactual(spark.createDataFrame(rows, "unit long, t int, y double, cohort int"), "y", 0.5, rounds=10, tolerance=0).collect()}
    seen = np.array([[t < (6 if u < 5 else 9999) and (u, t) != (9, 3) for t in range(8)] for u in range(20)])
    mat = np.where(seen, full, np.array([full[seen[:, t], t].mean() for t in range(8)]))
    for _ in range(10):
        a, s, b = np.linalg.svd(mat, full_matrices=False)
        mat = np.where(seen, full, (a * np.maximum(s - 0.5, 0)) @ b)
    assert set(got) == {(u, t) for u in range(5) for t in (6, 7)}
    assert all(v == pytest.approx(mat[k], abs=1e-6) for k, v in got.items())


def test_logistic(spark):
    import numpy as np

    from tessella.operators import learning

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, r)) for b, r in zip(y, x)] + [(1, None, 0.0)], "y int, a double, b double")
    weight = learning.balanced_weights(df, "y")
    got = learning.logistic(df, "y", ["a", "b"], weight)
    n, pos = 401, int(y.sum()) + 1
    w, z, beta = np.where(y == 1, n / 2 / pos, n / 2 / (n - pos)), np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z, z.T @ (w * (y - p)))
    assert got == pytest.approx(beta, abs=1e-5)
    both = learning.trained_classifier(df, df, "y", {"a": ["a"], "both": ["a", "b"]}).collect()
    assert {r.features: r.best for r in both} == {"a": 0, "both": 1}
    shown = learning.platt(df, df, "y", "b").select("p").na.drop().collect()
    assert all(0 < r.p < 1 for r in shown)


def test_embeddings_and_archetypes(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = [(u, t, float(np.exp(5 + (u % 4) + 0.3 * t * (u % 4 == 3) + rng.normal() * 0.05 * (1 + 5 * (u % 4 == 1))))) for u in range(24) for t in range(10)]
    f = dynamics.unit_features(spark.createDataFrame(rows, "unit long, t int, value double"))
    names = ["level", "sd", "trend", "growth", "volatility"]
    table = sorted(f.collect())
    z = np.array([[r[c] for c in names] for r in table])
    z = (z - z.mean(0)) / z.std(0)
    vec = np.linalg.eigh(z.T @ z / len(z))[1][:, ::-1][:, :2]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), [0, 1]])
    got = {r.unit: (r.e1, r.e2) for r in dynamics.unit_embeddings(f, names).collect()}
    assert all(got[r.unit] == pytest.approx(tuple(p), abs=1e-8) for r, p in zip(table, z @ vec))
    kinds = {r.unit: r.archetype for r in dynamics.archetypes(f, names, {"growth": 1.0, "trend": 0.45, "volatility": -0.8}).collect()}
    assert len({kinds[u] for u in range(24) if u % 4 == 3}) == 1 and kinds[3] == "frontier" and kinds[1] != kinds[3]


def test_cusum_over_two_batches(spark, tmp_path):
    """The running sum is kept from batch to batch."""
    import datetime

    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)
    values = [(i, i % 3, float(40 + (i * 37) % 50)) for i in range(90)]
    want, total = [], {}
    for i, user, v in values:
        total[user] = max(0.0, total.get(user, 0.0) + v - 60 - 2)
        if total[user] > 30:
            want.append((user, i, round(total[user], 6)))
            total[user] = 0.0
    for part in (values[:40], values[40:]):
        rows = spark.createDataFrame([(i, u, v, at(i)) for i, u, v in part], "event_id long, user_id long, value double, ts timestamp")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        monitor.append_to(monitor.cusum_alarms(stream.select("user_id", "event_id", "ts", "value"), 60.0, 2.0, 30.0), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.schema("user_id long, event_id long, ts timestamp, total double").parquet(str(tmp_path / "out")).collect()
    assert want and sorted((r.user_id, r.event_id, round(r.total, 6)) for r in got) == sorted(want)


def test_nowcasts(spark):
    """The forecast of one series by hand, and that short series have none."""
    import numpy as np

    from tessella.operators import nowcast as learning

    y = [10 + 2 * t + 3 * np.sin(2 * np.pi * t / 4) for t in range(14)]
    rows = [("a", t, float(v)) for t, v in enumerate(y)] + [("b", t, 1.0) for t in range(3)] + [("a", 20, None)]
    got = learning.nowcasts(spark.createDataFrame(rows, "grp string, t int, score double")).collect()
    assert [r.grp for r in got] == ["a"] and got[0].t == 14
    trend = float(np.median(np.diff(y)))
    for d in np.diff(y):
        trend = 0.76 * trend + 0.24 * d
    t = np.arange(15.0)
    w = 2 * np.pi / got[0].period
    x = np.stack([t**0, t, np.sin(w * t), np.cos(w * t), np.sin(2 * w * t), np.cos(2 * w * t)], axis=1)
    beta = np.linalg.solve(x[:14].T @ x[:14] + 1.2 * np.diag([0, 1, 1, 1, 1, 1]), x[:14].T @ np.array(y))
    assert got[0].trend == pytest.approx(trend) and got[0].nowcast == pytest.approx(0.68 * x[14] @ beta + 0.32 * (y[-1] + trend))
    assert got[0].directional > 0.6 and got[0].low95 < got[0].low80 < got[0].nowcast < got[0].high80 < got[0].high95


def test_low_rank_rounds_share_a_worker(spark, monkeypatch):
    """Rounds are not chained in a plan: a task's Python would take a worker for each."""
    from tessella.operators import estimators

    kind, plans = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), collect(df))[1])
    rows = [(u, t, float(u % 3 + t), 3 if u % 2 else 9999) for u in range(12) for t in range(5)]
    assert estimators.low_rank_counterfactual(spark.createDataFrame(rows, "unit long, t int, y double, cohort int"), "y", 0.5, rounds=4, tolerance=0).count() == 12
    python = [sum(p.count(x) for x in ("MapInArrow", "MapInPandas", "EvalPython")) for p in plans]
    assert max(python) == 1


def test_dealt_rows_are_not_sorted(spark):
    """A draw's rows (units times periods) pass without a window by unit: only units are dealt, and sorted, for each draw."""
    df = spark.createDataFrame([(u, u % 4, t, float(u * t % 7), float(u % 3 == 0 and t >= 2)) for u in range(12) for t in range(4)], "unit long, cl long, t int, y double, did double")
    plan = regression.schedule_permutation(df, "y", "did", 30)._jdf.queryExecution().optimizedPlan().toString()
    assert not [w for w in plan.split("windowspecdefinition(")[1:] if w.startswith("draw#") and w.split(", ")[1].startswith("unit#")]


def test_rows_of_draws_are_not_broadcast(spark, monkeypatch):
    """Units times draws, which Spark's size check takes for the units alone, are merge-joined: in the result's plan and in those of what is written on the way."""
    import re

    from tessella.functions.columns import keyed_draw, numbered
    from tessella.sources.tables import Stages

    keys = set()

    def look(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys.update(tuple(re.findall(r"(\w+)#", x)) for x in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan))

    cut = Stages.cut
    monkeypatch.setattr(Stages, "cut", lambda self, df, name: (look(df), cut(self, df, name))[1])
    unit, t = F.expr("id div 4"), F.col("id") % 4
    df = spark.range(48).select(unit.alias("unit"), (unit % 4).alias("cl"), t.cast("int").alias("t"), (unit * t % 7).cast("double").alias("y"), ((unit % 3 == 0) & (t >= 2)).cast("double").alias("did"))
    look(regression.schedule_permutation(df, "y", "did", 30))
    look(numbered(spark.range(12).selectExpr("id AS unit", "explode(sequence(1, 30)) AS draw"), keyed_draw(F.col("draw"), F.col("unit")), "unit", "_i", ("draw",)))
    assert not keys & {("_i",), ("unit",), ("_range",), ("draw", "_range")}


def test_parts_grow_with_the_rows(spark):
    from tessella.operators import spatial
    from tessella.sources.tables import spread

    assert spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 4
    assert spread(spark.range(10), 1000, "id", most=100).rdd.getNumPartitions() == 10
    ways = spark.createDataFrame([(1, 1, [1, 2, 9, 3]), (1, 2, [3, 1]), (2, 3, [])], "unit long, way long, nodes array<long>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 2.0)], "node long, lat double, lon double")
    found = spatial.way_metrics(ways, nodes).collect()  # the unknown node is passed over
    assert [(r.unit, round(r.km, 1), r.ways, r.crossings) for r in found] == [(1, 444.8, 2, 0)]
