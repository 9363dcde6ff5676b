"""Tree ensembles on tables with known answers: interactions that no linear model sees, effects beside curved confounders."""

import random

import pytest

from tessella.operators import trees as T


def panel(seed=3, units=150, periods=6):
    """y is 1 where the signs of a and b agree, in nine of ten rows."""
    rng, rows = random.Random(seed), []
    for u in range(units):
        for t in range(periods):
            a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
            y = int((a > 0) == (b > 0)) if rng.random() < 0.9 else rng.randrange(2)
            rows.append((u, t, None if rng.random() < 0.02 and t % 2 else y, a if rng.random() < 0.95 else None, b))
    return rows


SCHEMA = "unit long, t int, y int, a double, b double"


def test_classifier_sees_interactions_and_reruns_agree(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    got, again = ({(r.learner, r.weights): r for r in T.chosen_classifier(d, "y", ["a", "b"], trees=20).collect()} for d in (df.repartition(3), df.repartition(7)))
    same = lambda rows: {k: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for k, r in rows.items()}
    assert len(got) == 6 and same(got) == same(again)
    best = [r for r in got.values() if r.chosen]
    assert len(best) == 1 and best[0].learner in ("forest", "boosting") and best[0].test_auc > 0.8 and best[0].test_brier < 0.2
    assert abs(got["logit", "none"].auc - 0.5) < 0.15 and best[0].objective == max(r.objective for r in got.values())
    assert all(r.test_auc is None for r in got.values() if not r.chosen)
    assert T.chosen_classifier(df.filter("t < 2"), "y", ["a"]).count() == 0 and T.chosen_classifier(df.filter("y = 1"), "y", ["a"]).count() == 0
    assert T.chosen_classifier(df.limit(0), "y", ["a"]).count() == 0


def test_rows_are_dealt_once_and_the_last_period_is_scored_once(spark, monkeypatch):
    """Medians of columns with gaps only; of six models only the chosen one sees the last period."""
    calls = {"ordered": [], "quantiles": [], "auc": []}
    for name, seen in calls.items():
        plain = getattr(T, name)
        monkeypatch.setattr(T, name, lambda *a, plain=plain, seen=seen: (seen.append(a), plain(*a))[1])
    assert T.chosen_classifier(spark.createDataFrame(panel(units=60), SCHEMA), "y", ["a", "b"], trees=3).count() == 6
    assert {k: len(v) for k, v in calls.items()} == {"ordered": 1, "quantiles": 1, "auc": 7}


def test_classifier_query_takes_no_table_of_all_units(spark, monkeypatch):
    from tessella.operators import dynamics
    from tessella.plans import registry

    monkeypatch.setattr(dynamics, "dynamics_table", None)
    assert registry.QUERIES["m11_tree_classifier"](spark, "/root/testdata/sf0.001").count() == 6


def test_holdout_of_a_curved_panel(spark):
    rng, rows = random.Random(5), []
    for u in range(200):
        v = rng.uniform(-2, 2)
        for t in range(6):
            rows.append((u, t, v, rng.random()))
            v = 4 * (v / 2) ** 2 - 2 + rng.gauss(0, 0.1)
            v = max(-2.0, min(2.0, v))
    df = spark.createDataFrame([*rows, (999, 0, None, 0.1)], "unit long, t int, v double, w double")
    r = T.tree_holdout(df, "v", ["v", "w"], 3, trees=20).first()
    assert r.n_test == 200 and r.forest_r2 > 0.8 > 0.3 > r.linear_r2 and r.gain == pytest.approx(r.linear_rmse - r.forest_rmse) and r.gain > 0.3
    assert T.tree_holdout(df.limit(0), "v", ["v"], 3).count() == 0 and T.tree_holdout(df, "v", ["v"], 9).count() == 0


def test_double_ml_beside_a_curved_confounder(spark):
    rng, rows = random.Random(7), []
    for u in range(2400):
        x = rng.uniform(-2, 2)
        d = x * x + rng.gauss(0, 1)
        rows.append((u, u % 60, 0, 0.5 * d + 3 * x * x + rng.gauss(0, 0.5), d, x))
    df = spark.createDataFrame(rows, "unit long, cl long, t int, y double, d double, x double")
    r = T.forest_double_ml(df, "y", "d", ["x"], trees=20).first()
    assert abs(r.coef - 0.5) < 0.12 and 0 < r.stderr < 0.05 and r.n_obs == 2400 and r.n_clusters == 60
    assert T.forest_double_ml(df.limit(0), "y", "d", ["x"]).count() == 0 and T.forest_double_ml(df.filter("cl = 1"), "y", "d", ["x"]).count() == 0
