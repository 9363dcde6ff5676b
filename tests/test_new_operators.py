"""Phase portrait, inferred events, phase rules, external validity, responses and enrichment on nulls, ties, constants and empty tables."""

import math

import numpy as np
import pytest

from tessella.operators import enrichment as N
from tessella.operators import inferred_events as I
from tessella.operators import phase as P
from tessella.operators import regression as R
from tessella.operators import responses as S
from tessella.operators import validity as X

SCORES = "unit long, t int, x double, y double"


def spiral(units=30, periods=12):
    rng = np.random.default_rng(5)
    out = []
    for u in range(units):
        for t in range(periods):
            a = 0.5 * t + u
            out.append((u, t, float(50 + 30 * math.cos(a) + rng.normal()), float(50 + 30 * math.sin(a) + rng.normal())))
    return out


def plain_field(rows):
    """Cells by numpy: bins, means, and differences to the nearest populated neighbours."""
    by = {}
    for u, t, x, y in sorted(r for r in rows if r[2] is not None and r[3] is not None):
        by.setdefault(u, []).append((x, y))
    moved = [(b[0], b[1], b[0] - a[0], b[1] - a[1]) for s in by.values() for a, b in zip(s, s[1:])]
    m = np.array(moved)
    bins = []
    for c in (0, 1):
        e = np.quantile(m[:, c], np.linspace(0, 1, 9))
        bins.append(np.clip(np.searchsorted(e[1:], m[:, c], side="left"), 0, 7))
    cells = {k: m[(bins[0] == k[0]) & (bins[1] == k[1])].mean(axis=0) for k in set(zip(bins[0].tolist(), bins[1].tolist()))}
    centre = [{i: np.mean([v[axis] for k, v in cells.items() if k[axis] == i]) for i in {k[axis] for k in cells}} for axis in (0, 1)]

    def slope(k, column, axis):
        line = sorted(q[axis] for q in cells if q[1 - axis] == k[1 - axis])
        at = line.index(k[axis])
        lo, hi = line[max(at - 1, 0)], line[min(at + 1, len(line) - 1)]
        cell = lambda i: cells[(i, k[1]) if axis == 0 else (k[0], i)]
        wide = centre[axis][hi] - centre[axis][lo]
        return None if abs(wide) <= 1e-12 else (cell(hi)[column] - cell(lo)[column]) / wide

    out = {}
    for k in cells:
        a, b, c, d = slope(k, 2, 0), slope(k, 3, 1), slope(k, 3, 0), slope(k, 2, 1)
        out[k] = (None if a is None or b is None else a + b, None if c is None or d is None else c - d)
    return out


def test_phase_field(spark):
    df = spark.createDataFrame(spiral(), SCORES)
    got = {(r.xb, r.yb): (r.divergence, r.vorticity) for r in P.field(P.binned(P.motion(df, "x", "y"))).collect()}
    want = plain_field(spiral())
    assert got.keys() == want.keys()
    for k, w in want.items():
        for a, b in zip(got[k], w, strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9)), k


def test_phase_portrait_of_little_and_constant_rows(spark):
    few = spark.createDataFrame([(1, 0, 1.0, None), (1, 1, 2.0, 3.0), (2, 0, None, None), (1, 2, 2.5, 2.0)], SCORES)
    rows = P.phase_portrait(few, "x", "y").collect()
    assert len(rows) == 4 and {r.label for r in rows} == {"insufficient_history"} and all(r.speed is not None for r in rows)
    still = spark.createDataFrame([(u, t, 5.0, 5.0) for u in range(40) for t in range(6)], SCORES)
    rows = P.phase_portrait(still, "x", "y").collect()
    assert {r.label for r in rows if r.t} == {"stable_anchor"} and {r.label for r in rows if not r.t} == {"insufficient_history"}
    assert P.phase_portrait(few.limit(0), "x", "y").count() == 0


def test_equal_edges_rise(spark):
    df = spark.createDataFrame([(1, i, float(min(i, 5)), 0.0) for i in range(100)], SCORES)
    edges = P.edges_of(df, "x")
    assert all(a < b for a, b in zip(edges, edges[1:])) and P.edges_of(df, "y")[-1] == 100.0 and P.edges_of(df.limit(0), "x")[0] == 0.0


RULE = I.Rule({"a": ("va", "rise"), "b": ("vb", "fall"), "c": ("va", "level")}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"b": -0.1}, {"up": {"a": 1.0}, "down": {"b": 1.0}}, suffix="_x")


def macro(clusters=9, periods=10):
    rng = np.random.default_rng(2)
    rows = [(c, t, float(rng.normal() + (6 if t == 3 + c % 4 else 0)), float(rng.normal())) for c in range(clusters) for t in range(periods)]
    return rows + [(100, t, 1.0, 1.0) for t in range(periods)] + [(101, 4, None, 2.0)]


def robust(x):
    off = x - np.median(x)
    mad = np.median(np.abs(off))
    sd = np.std(x, ddof=1) if len(x) > 1 else 0.0
    return off / (1.4826 * mad) if mad > 1e-8 else off / sd if sd > 1e-8 else np.zeros(len(x))


def test_rule_events(spark):
    df = spark.createDataFrame(macro(), "cl long, t int, va double, vb double")
    covered = spark.createDataFrame([(0,), (1,), (555,)], "cl long")
    got = {r.cl: r for r in I.rule_events(df, covered, RULE, 0.8).collect()}
    best = {}
    for c in range(2, 9):
        a, b = (np.array([r[i] for r in macro() if r[0] == c]) for i in (2, 3))
        za, zb, zc = robust(np.diff(a, prepend=a[0])), robust(-np.diff(b, prepend=b[0])), robust(a)
        score = 0.5 * za + 0.4 * zb + 0.1 * zc - 0.1 * np.abs(zb)
        t = max(range(2, 8), key=lambda i: score[i])
        best[c] = (score[t], t, za[t], zb[t])
    best[100] = (0.0, 2, 0.0, 0.0)
    best[101] = (0.0, 4, 0.0, 0.0)
    needed = math.ceil(0.8 * 11) - 2
    top = sorted(best, key=lambda c: (-round(best[c][0], 9), c))[:needed]
    assert sorted(got) == sorted(top)
    low, high = best[top[-1]][0], best[top[0]][0]
    for c in top:
        score, t, za, zb = best[c]
        assert got[c].start_t == t and got[c].score == pytest.approx(score) and got[c].name == ("up_x" if za >= zb else "down_x")
        assert got[c].intensity == pytest.approx(min(max(0.25 + 0.6 * (score - low) / (high - low), 0.25), 0.9))
    assert I.rule_events(df, df.select("cl"), RULE, 0.95).count() == 0 and I.rule_events(df.limit(0), covered, RULE, 0.95).count() == 0


def test_robust_distance_and_anomaly_events(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.multivariate_normal([1, 2], [[2, 1.2], [1.2, 1]], 300), [[1, 30], [-20, 2]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    got = np.array([r.distance for r in I.robust_distance(df, ["a", "b"]).orderBy("i").collect()])
    med = np.median(x, axis=0)
    d0 = (((x - med) / (1.4826 * np.median(np.abs(x - med), axis=0))) ** 2).sum(1)

    def mahalanobis(rows):
        off = x - rows.mean(0)
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(rows.T)), off)

    d1 = mahalanobis(x[d0 <= np.median(d0)])
    d2 = mahalanobis(x[d1 <= I.CHI_HIGH[1] * np.median(d1) / I.CHI_MEDIAN[1]])
    assert np.allclose(got, np.sqrt(d2)) and set(np.argsort(got)[-2:]) == {300, 301}
    panel = spark.createDataFrame(macro(), "cl long, t int, va double, vb double")
    none = spark.createDataFrame([], "cl long")
    rows = I.anomaly_events(panel, none, RULE, 0.95).collect()
    assert sorted(r.cl for r in rows) == [*range(9), 100, 101] and all(0.25 <= r.intensity <= 0.9 for r in rows)
    assert I.anomaly_events(panel, panel.select("cl"), RULE, 0.95).count() == 0 and I.anomaly_events(panel.limit(0), none, RULE, 0.95).count() == 0
    events = I.rule_events(panel, none, RULE, 0.95)
    assert I.with_inferred(events, events).count() == events.count()


def test_two_way_within_and_groups_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(u, u % 4, t, float(rng.normal()), float(rng.random() < 0.4)) for u in range(20) for t in range(6) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "unit long, grp long, t int, y double, x double")

    def coefficient(some):
        a = np.array([(u, t, y, x) for u, _, t, y, x in some])
        out = []
        for c in (2, 3):
            v = a[:, c].copy()
            for k in (0, 1):
                for i in np.unique(a[:, k]):
                    v[a[:, k] == i] -= a[a[:, k] == i, c].mean()
            out.append(v + a[:, c].mean())
        return (out[0] * out[1]).sum() / (out[1] ** 2).sum()

    got = {r.left_out: (r.coef, r.n_obs) for r in R.leave_one_group_out(df, "y", "x", "grp").collect()}
    for g in range(4):
        some = [r for r in rows if r[1] != g]
        assert got[g] == (pytest.approx(coefficient(some)), len(some))
    each = {r.grp: r.coef for r in R.heterogeneity(df, "y", "x", "grp").collect()}
    assert each == {g: pytest.approx(coefficient([r for r in rows if r[1] == g])) for g in range(4)}
    plans = [R.two_way_within(df, ["y", "x"], group=("grp",)), R.leave_one_group_out(df, "y", "x", "grp"), R.mechanism(df, ["y"], "x")]
    assert not any("Window" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_ols_by(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g in ("a", "b"):
        x, c = rng.normal(size=(80, 2)), rng.integers(0, 9, 80)
        y = x @ [1.0, -2.0] + rng.normal(size=80)
        rows += [(g, float(a), float(b), float(v), int(k)) for (a, b), v, k in zip(x, y, c)]
        inv, beta = np.linalg.inv(x.T @ x), np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        s = np.stack([(x * e[:, None])[c == k].sum(0) for k in np.unique(c)])
        n = len(s)
        want[g] = (beta, np.sqrt(np.diag(inv @ (s.T @ s) @ inv) * n / (n - 1) * 79 / 78))
    df = spark.createDataFrame(rows + [("a", None, 1.0, 1.0, 1)], "g string, p double, q double, y double, c long")
    for i, r in enumerate(sorted(R.ols_by(df, "g", "y", ["p", "q"], "c").collect(), key=lambda r: (r.g, r.term))):
        beta, se = want[r.g]
        assert (r.coef, r.stderr, r.n_obs) == (pytest.approx(beta[i % 2]), pytest.approx(se[i % 2]), 80)


def test_phase_rules_skip_extreme_and_small_groups(spark):
    base = spark.createDataFrame([(u, 3, float(u), "stable_anchor", None) for u in range(40)], "unit long, t int, speed double, label string, vorticity double")
    rng = np.random.default_rng(1)
    panel = spark.createDataFrame([(u, u % 5, t, float(rng.normal()), int(u % 2 and t >= 4), u % 2) for u in range(42) for t in range(8)], "unit long, cl long, t int, y double, did int, treated int")
    got = {r.rule: r for r in X.phase_rule_grid(panel, base, 4, least=15).collect()}
    assert got["phase_label_fragility_set"].status == "extreme_group_share" and got["phase_label_fragility_set"].coef_main is None
    assert got["phase_flow_speed_q60"].status == "ok" and got["phase_flow_speed_q60"].flagged == 16 and got["phase_flow_speed_q60"].others == 26
    assert got["phase_flow_speed_q75"].status == "too_few_units_in_rule_group" and not any("vorticity" in k for k in got)
    assert 0 <= got["phase_flow_speed_q60"].p_main <= 1


def test_external_validity_needs_rows(spark):
    panel = spark.createDataFrame([(1, 1, t, 1.0, 2.0, 3.0) for t in range(5)], "unit long, cl long, t int, s double, c double, i double")
    assert X.external_validity(panel, "s", ["c"], ["i"]).count() == 0


def test_shocks_are_apart_and_may_be_named(spark):
    growth = {0: -9.0, 1: 0.0, 2: -5.0, 3: -4.0, 4: 1.0, 5: -3.0, 6: 2.0, 7: -1.0, 8: -2.0, 9: -8.0}
    rows = [(u, t, float(u), g, None) for t, g in growth.items() for u in (1, 2)] + [(3, 2, 0.0, None, None)]
    df = spark.createDataFrame(rows, "unit long, t int, value double, growth double, accel double")
    pick = lambda **k: sorted(r.shock_t for r in S.shock_periods(df, 9, **k).collect())
    assert pick() == [2, 5, 8] and pick(first=7) == [2, 5, 7] and pick(first=0) == [2, 5, 8] and pick(most=1) == [2] and pick(gap=4) == [2, 8]
    assert sorted(r.shock_t for r in S.shock_periods(df.filter("t < 2"), 1).collect()) == [0]
    assert S.shock_periods(df.limit(0), 9).count() == 0


def test_envelopes_of_constants_and_gaps(spark):
    study = spark.createDataFrame([("a", e, 5, 1.0, 2.0) for e in range(-2, 3)] + [("b", 0, 3, None, 1.0), (None, 1, 2, 1.0, 1.0), ("b", None, 2, 1.0, 1.0)], "event_type string, event_t int, n long, growth double, risk double")
    env = S.event_envelope(study)
    assert env.count() == 6 and {r.signal for r in env.filter("event_type = 'a'").collect()} == {0.0}
    s = {r.event_type: r for r in S.envelope_summary(env).collect()}
    assert s["a"].relief == 0.0 and s["b"].pre_signal is None and {s["a"].absorption, s["b"].absorption} == {0.0, 100.0}
    assert S.envelope_summary(S.event_envelope(study.filter("event_type = 'a'"))).first().absorption == 50.0
    assert S.envelope_summary(S.event_envelope(study.limit(0))).count() == 0


def test_enrichment(spark):
    tracks = [N.Track("direct", "A", ("p",), "https://x.org/", each=True, assignment="explicit"), N.Track("index", "B", ("i",), "http://y.org/a?b")]
    rows = [(" fr", "2001", None, "0.5", "n ", "p:1| 2||"), ("FR ", "2001", "2000", "0.9", "n", "p:1| 2||"), ("de", "2003", "x", "7", "m", "i:z"), ("de", "bad", None, "1", "m", "i:z"), ("it", "2000", None, None, "q", "p"), (None, "2000", None, "1", "q", "p:3"), ("us", "2002", "2002", "1", "", "p:2")]
    df = spark.createDataFrame(rows, "cl string, start_t string, end_t string, intensity string, name string, ref string")
    e = N.enrich(df, tracks)
    got = {r.event: r for r in e.collect()}
    assert [got[i].cl for i in (1, 2, 3, 4)] == ["DE", "FR", "IT", "US"] and len(got) == 4
    assert (got[2].copies, got[2].intensity, got[2].end_t, got[2].refs, got[2].links, got[2].host) == (2, 0.9, 2000, ["1", "2"], ["https://x.org/1", "https://x.org/2"], "x.org")
    assert (got[1].track, got[1].links, got[1].host, got[3].track, got[3].grade, got[3].links) == ("index", ["http://y.org/a?b"], "y.org", "unknown", "C", [])
    assert [(r.event, r["rank"], r.url) for r in N.source_links(e).orderBy("event", "rank").collect()] == [(1, 1, "http://y.org/a?b"), (2, 1, "https://x.org/1"), (2, 2, "https://x.org/2"), (4, 1, "https://x.org/2")]
    assert [(r.ref, r.events, r.clusters) for r in N.shared_references(e).collect()] == [("2", 2, 2)]
    q = {(r.measure, r.item): r.value for r in N.quality_report(e).collect()}
    assert q["rows", ""] == 4 and q["repeats_removed", ""] == 1 and q["without_intensity", ""] == 1 and q["ends_before_start", ""] == 1 and q["intensity_outside", ""] == 1 and q["linked_share", ""] == 0.75 and q["track", "direct"] == 2
    assert N.enrich(df.limit(0), tracks).count() == 0


def test_envelopes_of_units(spark):
    from tessella.operators import dynamics as D

    rows = [(1, t, 10.0 + t, 1.0, 0.5, 20.0) for t in range(8)] + [(2, t, 30.0 - 2 * t, None, 3.0, 80.0) for t in range(8)] + [(3, 0, 5.0, None, None, None)]
    df = spark.createDataFrame(rows, "unit long, t int, index double, accel_velocity double, risk_velocity double, risk double")
    got = {r.unit: r for r in D.unit_envelope(df).collect()}
    assert (got[1].trend, got[1].drawdown, got[1].rises, got[1].gap) == (2.0, 0.0, 1.0, 0.5) and (got[2].trend, got[2].drawdown, got[2].rises, got[2].gap) == (-4.0, 8.0, 0.0, -3.0)
    assert got[1]["class"] == "resilient_accelerator" and got[2]["class"] == "stall_trap" and got[3].trend == 0.0 and got[3].volatility is None and got[3].rises is None
    assert D.unit_envelope(df.limit(0)).count() == 0


def test_quadrant_cuts(spark):
    from tessella.operators import dynamics as D

    same = spark.createDataFrame([(i, 50.0, float(i)) for i in range(101)] + [(200, None, None)], "unit long, a double, r double")
    cuts = D.quadrant_cuts(same, ["a", "r"])
    assert cuts == {"a": (46.0, 54.0), "r": (35.0, 65.0)} and D.quadrant_cuts(same.limit(0), ["a"]) == {"a": (35.0, 65.0)}
    high = spark.createDataFrame([(i, 99.0) for i in range(5)], "unit long, a double")
    assert D.quadrant_cuts(high, ["a"]) == {"a": (92.0, 96.0)}
    assert {r.quadrant for r in D.quadrants(same, "a", "r").collect()} == {"steady"}


def test_resilience(spark):
    from tessella.operators import sequences as Q

    spells = lambda rows: spark.createDataFrame(rows, "unit long, start int, end int, duration int, left int")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "unit long, grp string")
    bad = spells([(1, 0, 0, 1, 1), (2, 0, 0, 1, 1), (3, 0, 2, 3, 0)])
    good = spells([(1, 0, 3, 4, 1), (2, 0, 7, 8, 1)])
    got = {r.grp: r for r in Q.resilience(bad, good, groups).collect()}
    assert (got["a"].bad_half_life, got["a"].good_half_life, got["a"].gap, got["a"].score) == (1, 4, 3, pytest.approx(100 * (0.375 + 0.5)))
    assert (got["b"].bad_half_life, got["b"].bad_survival, got["b"].good_spells, got["b"].score) == (None, 1.0, 0, 0.0)
    assert got[None].bad_spells == 3 and got["a"]["rank"] <= got["b"]["rank"] and Q.resilience(bad.limit(0), good.limit(0), groups).count() == 0


def test_concordance_without_errors(spark):
    from tessella.operators import shocks as K

    df = spark.createDataFrame([("a", 1.0, 0.2), ("b", -1.0, None), ("c", 1.1, 0.2)], "name string, coef double, stderr double")
    got = {(r.name_a, r.name_b): r for r in K.concordance(df).collect()}
    assert got["a", "b"].overlap is None and got["a", "b"].concordance < 1e-6 and got["a", "c"].same_class == 1 and got["a", "c"].concordance > 0.95


def test_stacked_placebo_of_no_effect(spark):
    rng = np.random.default_rng(3)
    rows = [(u, u % 8, t, float(rng.normal() + u), 5 if u % 3 == 0 else 6 if u % 3 == 1 else 9999) for u in range(60) for t in range(9)]
    df = spark.createDataFrame([*rows, (99, 1, 1, None, 5)], "unit long, cl long, t int, y double, cohort int")
    got = X.stacked_placebo(df, "y", leads=(2,)).collect()
    cells = {r.cell: r for r in got if r.cell}
    assert set(cells) == {"2:3", "2:4"} and cells["2:3"].n_treated == 20 and cells["2:3"].n_members == 60
    (pooled,) = [r for r in got if r.cell is None]
    assert abs(pooled.t_value) < 4 and pooled.coef == pytest.approx(sum(r.coef for r in cells.values()) / 2)
    assert X.stacked_placebo(df.limit(0), "y").count() == 0


def test_streams_drop_repeats_and_late_rows(spark, tmp_path):
    """Four files, a batch each: repeats within the watermark go, a row that comes two batches after it has passed goes as late, and the windows it would be in are closed."""
    import datetime as dt

    from tessella.streaming import monitor

    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    batches = [[(1, at(1), 7, "a", 1.0), (1, at(1), 7, "a", 1.0), (2, at(2), 7, "b", 2.0)], [(2, at(2), 7, "b", 2.0), (3, at(9), 8, "a", 3.0)], [(6, at(9, 6), 8, "a", 6.0)], [(4, at(1, 5), 8, "a", 4.0), (5, at(9, 5), 8, "a", 5.0)]]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    monitor.append_to(monitor.deduplicated(read()).select("event_id"), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "once")).collect())
    assert got == [1, 2, 3, 5, 6]
    monitor.append_to(monitor.sliding_alerts(read(), "2 days", "1 day").select("start", "event_type", "n"), str(tmp_path / "slide"), str(tmp_path / "c2")).awaitTermination()
    closed = {(r.start.day, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "slide")).collect()}
    assert closed[(1, "b")] == 2 and closed[(2, "b")] == 2 and closed[(1, "a")] == 2  # the late one isn't in it
