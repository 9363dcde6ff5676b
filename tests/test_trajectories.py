"""Regimes of trajectories against plain Python."""

import random

import numpy as np
import pytest

from tessella.functions.columns import kth_value, quantiles
from tessella.operators import trajectories as T


def plain_distance(a, b, window):
    w = max(window, abs(len(a) - len(b)))
    cost = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(max(1, i - w), min(len(b), i + w) + 1):
            before = [cost.get(x, np.inf) for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(before)
    return cost[len(a), len(b)]


def rows():
    """Rising, falling, late and flat units; two constant ones, one with gaps, one with a single period, copies, one without values."""
    rng, out = random.Random(2), []
    for u in range(24):
        for t in range(9):
            base = [t, -t, max(0, t - 5) * 3, (t % 2) * 2][u % 4]
            if u == 3 and t in (2, 3, 7):
                continue
            out.append((u, t, float(base + rng.random()), rng.random()))
    out += [(100, t, 5.0, 0.1) for t in range(9)] + [(101, t, 5.0, 0.1) for t in range(9)] + [(102, 4, 1.0, None), (103, 2, None, None)]
    out += [(104, t, v, x) for u, t, v, x in out if u == 0] + [(0, 0, out[0][2], 0.5)]
    return out


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(rows(), "unit long, t int, value double, risk double").repartition(3).persist()


def plain_sequences():
    cells = {}
    for u, t, v, _ in rows():
        if v is not None:
            cells.setdefault(u, {}).setdefault(t, []).append(v)
    out = {}
    for u, c in cells.items():
        have = sorted(c)
        y = np.interp(range(9), have, [np.mean(c[t]) for t in have])
        level = y - y[0]
        sd = level.std()
        level = level / (sd if sd > 1e-8 else 1)
        out[u] = 0.72 * level + 0.28 * np.diff(level, prepend=level[0])
    return out


def test_sequences(panel):
    got, want = {r.unit: r.seq for r in T.sequences(panel).collect()}, plain_sequences()
    assert got.keys() == want.keys() and all(np.allclose(got[u], want[u]) for u in want)


def test_warped_distances_of_all_prefixes():
    rng = np.random.default_rng(1)
    x, m = rng.normal(size=(5, 12)), rng.normal(size=(3, 12))
    for window in (1, 2, 5):
        for p, d in T.warped(x, m, window, range(1, 13)).items():
            assert np.allclose(d, [[plain_distance(a[:p], b[:p], window) for b in m] for a in x])


def test_regimes(panel):
    seqs = T.sequences(panel).persist()
    fit, plain = T.fit_regimes(seqs, clusters=4), plain_sequences()
    assert set(fit.units) == set(plain)
    medoids = [plain[fit.units[i]] for i in fit.medoids]
    got = {r.unit: r for r in T.assign_regimes(seqs, fit).collect()}
    near = {u: [plain_distance(s, m, T.band(9)) for m in medoids] for u, s in plain.items()}
    label = {u: int(np.argmin(d)) for u, d in near.items()}
    for u, s in plain.items():
        assert got[u].cluster == label[u] and got[u].distance == pytest.approx(min(near[u]))
        mean = {}
        for k in set(label.values()):
            others = [plain_distance(s, plain[v], T.band(9)) for v in plain if label[v] == k and v != u]
            if others:
                mean[k] = np.mean(others)
        a, b = mean.get(label[u]), [v for k, v in mean.items() if k != label[u]]
        assert got[u].silhouette == pytest.approx(0.0 if a is None else (min(b) - a) / max(a, *b and [min(b)], 1e-12), abs=1e-9)
    # no other member of a group is more central
    for k, i in enumerate(fit.medoids):
        own = [plain[u] for u in fit.units if label[u] == k]
        cost = [sum(plain_distance(a, b, T.band(9)) for b in own) for a in own]
        assert sum(plain_distance(plain[fit.units[i]], b, T.band(9)) for b in own) == pytest.approx(min(cost))
    # rising and falling units are apart, copies together
    assert label[0] == label[104] == label[4] and label[1] == label[5] != label[0] and label[100] == label[101]

    names = {r.cluster: r.regime for r in T.regime_names(T.assign_regimes(seqs, fit), panel, "risk").collect()}
    assert sorted(names.values()) == sorted(T.REGIMES[: len(names)])

    by = T.prefix_regimes(seqs, fit, T.periods_of(panel)).collect()
    assert {r.unit: r.cluster for r in by if r.t == 8} == label
    for r in by:
        p = r.t + 1
        d = [plain_distance(plain[r.unit][:p], m[:p], T.band(p)) for m in medoids]
        assert d[r.cluster] == pytest.approx(min(d))
    share = T.regime_share(T.prefix_regimes(seqs, fit, T.periods_of(panel)).withColumnRenamed("cluster", "regime")).groupBy("t").sum("share").collect()
    assert all(r[1] == pytest.approx(1) for r in share) and len(share) == 9


def test_samples_and_small_tables(spark, panel):
    seqs = T.sequences(panel)
    fit = T.fit_regimes(seqs, most=10)
    assert len(fit.units) == 10 and len(fit.medoids) == 3 and T.assign_regimes(seqs, fit).count() == len(plain_sequences())
    assert T.fit_regimes(T.sequences(panel.filter("unit < 5"))) is None
    assert T.sequences(panel.filter("unit < 0")).count() == 0


def test_quantiles_by_counting(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) ** 5 for _ in range(3000)] + [0.0] * 500 + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    assert [kth_value(df, "v", i, 50) for i in (0, 17, 1800, len(values) - 1)] == [sorted(values)[i] for i in (0, 17, 1800, len(values) - 1)]
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    want = pytest.approx(list(np.quantile(values, shares)))
    assert quantiles(df, "v", shares, 10) == want and quantiles(df, "v", shares) == want
    assert quantiles(df.filter("v > 1e13"), "v", [0.5]) == [None]


def test_tables_of_distances_are_bounded(spark, monkeypatch):
    """Whatever the size of a batch, a table of warped distances (rows, sample, periods) has at most TABLE numbers."""
    largest, whole = spark.sparkContext.accumulator(0), T.whole

    def seen(x, m):
        largest.add(len(x) * m.size > 1 << 21)
        return whole(x, m)

    monkeypatch.setattr(T, "whole", seen)
    rng = np.random.default_rng(3)
    seqs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 30)))], "unit long, seq array<double>").coalesce(1)
    found = T.assign_regimes(seqs, T.Regimes(list(range(300)), rng.normal(size=(300, 30)), np.arange(3), np.arange(300) % 3))
    assert found.count() == 1500 and found.filter("distance IS NULL").count() == 0 and largest.value == 0
