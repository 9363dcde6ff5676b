"""Queries and their SQL on tables that reach what the small ones don't: copies, ties, constant signals, terms without variation."""

import duckdb
import pytest

from tessella.plans import registry
from test_oracles import SF, plain


def agree(spark, tmp_path, name, changed):
    """Both sides on the smallest tables, of which ``changed`` (table to DuckDB's select) are others; gives the query's rows."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"COPY ({changed.get(t, f'SELECT * FROM {t}').replace(f'FROM {t}', f'''FROM '{SF}/{t}.parquet' ''')}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    result = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    return got


COPIES = {"supplier": "SELECT * REPLACE (s_suppkey + i * 100000 AS s_suppkey) FROM supplier, range(2) c(i)", "lineitem": "SELECT * REPLACE (l_suppkey + i * 100000 AS l_suppkey) FROM lineitem, range(2) c(i)"}


def test_salience_of_tied_values(spark, tmp_path):
    assert agree(spark, tmp_path, "f12_salience", COPIES)


def test_registry_amounts_have_no_halves(spark, tmp_path):
    """386,772.60 / 400,000 is half way between two numbers of six digits."""
    rows = agree(spark, tmp_path, "f22_enriched_registry", {"orders": "SELECT * REPLACE (CASE WHEN o_totalprice > 250000 THEN 386772.6 ELSE o_totalprice END AS o_totalprice) FROM orders"})
    assert {r.intensity for r in rows} - {None} == {0.9669315}


EVERYWHERE = "SELECT o_orderkey + 1000000 + m * 25 + n AS o_orderkey, c AS o_custkey, o_orderstatus, 300001.0 + m * 1000 + n AS o_totalprice, (TIMESTAMP '1995-01-05' + to_months(m::INT))::TIMESTAMP AS o_orderdate, '1-URGENT' AS o_orderpriority FROM (SELECT * FROM orders LIMIT 1), range(80) a(m), (SELECT row_number() OVER () - 1 AS n, c FROM (SELECT min(c_custkey) AS c FROM (SELECT * REPLACE (c_custkey % 25 AS c_nationkey) FROM customer) GROUP BY c_nationkey))"


@pytest.mark.parametrize("name", ["j1_shock_index", "j4_event_response", "j6_leave_one_out", "j8_shift_share", "j12_envelope", "j13_envelope_bootstrap", "j15_pretrend"])
def test_a_signal_that_is_the_same_in_all_periods(spark, tmp_path, name):
    """Every cluster has events in every period, as in large tables."""
    customer = "SELECT * REPLACE (c_custkey % 25 AS c_nationkey) FROM customer"
    orders = EVERYWHERE.replace("FROM customer)", f"FROM '{SF}/customer.parquet')")
    agree(spark, tmp_path, name, {"customer": customer, "orders": f"SELECT * FROM orders UNION ALL ({orders.replace('FROM orders', f'''FROM '{SF}/orders.parquet' ''')})"})


@pytest.mark.parametrize("name", ["j1_shock_index", "j13_envelope_bootstrap", "j15_pretrend", "j4_event_response", "j6_leave_one_out"])
def test_a_signal_that_is_constant_but_for_rounding(spark, tmp_path, name):
    """The same 23 of 25 clusters in every period: 0.92 has no exact mean, and its deviation comes to 0 or to 1e-17. The same amounts in every period in another order, too."""
    customer = "SELECT * REPLACE (c_custkey % 23 AS c_nationkey) FROM customer"
    orders = EVERYWHERE.replace("FROM customer)", f"FROM '{SF}/customer.parquet')").replace("% 25 AS c_nationkey", "% 23 AS c_nationkey").replace("300001.0 + m * 1000 + n", "300001.1 + (n * 7 + m) % 23 * 1000 + (n = m % 5)::INT * (m % 9) * 3e4 * RAISED")
    plain_orders = "SELECT * REPLACE (o_totalprice % 1000 AS o_totalprice) FROM orders"
    for raised in (0, 1):
        folder = tmp_path / str(raised)
        folder.mkdir()
        made = orders.replace("RAISED", str(raised)).replace("FROM orders", f"FROM '{SF}/orders.parquet' ")
        got = agree(spark, folder, name, {"customer": customer, "orders": f"{plain_orders} UNION ALL ({made})"})
        if name == "j1_shock_index":
            assert {r.covered for r in got} == {0.92} and ({r["index"] for r in got} == {0.0}) == (not raised)


#: Copies of all clusters, customers and orders: units tie at the quantiles of exposure but for the rounding of their means.
CLUSTERS = {
    "customer": "SELECT * REPLACE (c_custkey + i * 1000000 AS c_custkey, (c_nationkey + i * 25)::INT AS c_nationkey) FROM customer, range(40) c(i)",
    "orders": "SELECT * REPLACE (o_orderkey + i * 1000000 AS o_orderkey, o_custkey + i * 1000000 AS o_custkey) FROM orders, range(40) c(i) ORDER BY hash(o_orderkey)",
}


@pytest.mark.parametrize("name", ["j3_baseline_exposure", "j4_event_response", "j6_leave_one_out", "j13_envelope_bootstrap", "j15_pretrend"])
def test_units_tied_at_the_quantiles_of_exposure(spark, tmp_path, name):
    got = agree(spark, tmp_path, name, CLUSTERS)
    if name == "j3_baseline_exposure":
        of = {}
        for row in got:
            of.setdefault(row.unit % 25, set()).add(row.exposure)
        assert {len(x) for x in of.values()} == {1}


@pytest.mark.parametrize("name", ["j1_shock_index", "j6_leave_one_out"])
def test_periods_tied_at_the_cut_of_shocks(spark, tmp_path, name):
    """Runs of eight periods have the same amounts in other orders, so that their mean intensities tie but for rounding: a whole run is a shock, or none of it."""
    customer = "SELECT * REPLACE (c_custkey % 25 AS c_nationkey) FROM customer"
    orders = EVERYWHERE.replace("FROM customer)", f"FROM '{SF}/customer.parquet')").replace("300001.0 + m * 1000 + n", "300001.1 + n * (m % 8 + 1 + (m % 8 >= 4)::INT) % 25 * 3001.37 + m // 8 * 1013.7")
    orders = orders.replace("FROM orders", f"FROM '{SF}/orders.parquet' ")
    plain_orders = "SELECT * REPLACE (0.0 + o_totalprice % 1000 AS o_totalprice) FROM orders"
    runs = {}
    for row in agree(spark, tmp_path, name, {"customer": customer, "orders": f"{plain_orders} UNION ALL ({orders})"}):
        t, found = (row.t, row.is_shock) if name == "j1_shock_index" else (row.shock, row.shock)
        runs.setdefault(t // 8, set()).add(found)
    assert {len(x) for x in runs.values()} == {1 if name == "j1_shock_index" else 8}


@pytest.mark.parametrize("name", ["j13_envelope_bootstrap", "j15_pretrend"])
def test_clusters_that_grow_evenly(spark, tmp_path, name):
    """Every period is a shock and all have the same contrasts, on a line, but for rounding: no noise to measure a signal by, no error of a slope."""
    orders = EVERYWHERE.replace("FROM customer)", f"FROM '{SF}/customer.parquet')").replace("300001.0 + m * 1000 + n", "round(1e12 * exp(0.001 * (n + 1) * m) * (25 + n), 2)").replace("FROM orders", f"FROM '{SF}/orders.parquet' ")
    got = agree(spark, tmp_path, name, {"customer": "SELECT * REPLACE (c_custkey % 25 AS c_nationkey) FROM customer", "orders": orders})
    if name == "j13_envelope_bootstrap":
        assert {r.signal_to_noise for r in got} == {None} and all(r.low == r.mean == r.high for r in got)
    else:
        assert {(r.slope, r.t) for r in got} == {(0.017, None)} and len(got) == 79


def test_terms_without_variation_are_null(spark, tmp_path):
    """All clusters start in the same period, so that event times and treatments are periods."""
    orders = EVERYWHERE.replace("FROM customer)", f"FROM '{SF}/customer.parquet')").replace("300001.0", "450001.0 * ((m >= 20)::INT)")
    tables = {"customer": "SELECT * REPLACE (c_custkey % 25 AS c_nationkey) FROM customer", "orders": orders.replace("FROM orders", f"FROM '{SF}/orders.parquet'") + " UNION ALL SELECT * REPLACE (0.0 + o_totalprice % 1000 AS o_totalprice) FROM orders"}
    for name in ("k17_event_study", "k8_spillover"):
        folder = tmp_path / name
        folder.mkdir()
        assert {r.coef for r in agree(spark, folder, name, tables)} == {None}


def test_the_inverse_of_moments(spark):
    """Columns of very different sizes are inverted alike; of columns that repeat each other none is identified, the rest is."""
    import numpy as np

    from tessella.operators.regression import inverse

    x = np.random.default_rng(4).normal(size=(500, 3)) * [1e9, 1.0, 1e-6]
    inv, known = inverse(x.T @ x, 500)
    unit = np.array([1e9, 1.0, 1e-6])
    assert known.all() and np.allclose((inv @ (x.T @ x)) * np.outer(unit, 1 / unit), np.eye(3), atol=1e-9)
    x = np.column_stack([x, 2 * x[:, 1], np.zeros(500)])
    assert list(inverse(x.T @ x, 500)[1]) == [True, False, True, False, False]
