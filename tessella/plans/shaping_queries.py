"""Queries of the shaping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.columns import rounded
from tessella.operators import shaping as S
from tessella.plans import views as V
from tessella.plans.registry import query


def r(df, *names, digits=6):
    """The named columns rounded, the others as they are."""
    return df.select(*[rounded(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance, CAST(NULL AS INTEGER) AS missing FROM customer")
def a2_resolve_aliases(spark, sf):
    df = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return S.resolve_aliases(df, {"id": ["key", "c_custkey"], "label": ["title", "c_name"], "balance": ["c_acctbal", "c_balance"], "missing": ["nothing"]}).withColumn("missing", F.col("missing").cast("int"))


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month FROM events")
def a3_derive_period(spark, sf):
    df = V.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.date").alias("d"), "ts")
    return S.derive_period(df, ["d", "ts"]).select("event_id", "year", "month")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, a.region AS region FROM
 (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation) a FULL JOIN
 (SELECT n_nationkey + 5 AS k, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS name FROM nation) b ON a.k = b.k""")
def a9_override_dim(spark, sf):
    n = V.table(spark, sf, "nation")
    base = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    over = n.select((F.col("n_nationkey") + 5).alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("name"))
    return S.override_dim(base, over, "k")


@query(f"""WITH {V.PANEL_NM}, units AS (SELECT DISTINCT unit FROM panel), grid AS (SELECT unit, unnest(range(0, 80))::INT AS t FROM units)
SELECT g.unit, g.t, p.value, p.n, CASE WHEN p.unit IS NULL THEN 0 ELSE 1 END AS has_obs FROM grid g LEFT JOIN panel p ON g.unit = p.unit AND g.t = p.t""")
def b1_densify(spark, sf):
    p = V.panel_nm(spark, sf).drop("grp")
    return S.densify(p, p, 0, 79).select("unit", "t", "value", "n", "has_obs")


@query("SELECT s_suppkey AS unit, s_acctbal AS level, unnest(range(1995, 2002))::INT AS t FROM supplier")
def b2_expand_snapshot(spark, sf):
    return S.expand_snapshot(V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("level")), 1995, 2001)


@query(f"""WITH {V.PANEL_UD} SELECT unit, (t // 7)::INT AS week, round(avg(value), 6) AS mean, sum(n)::BIGINT AS n, max(value) AS peak FROM panel GROUP BY ALL""")
def b3_rollup_weeks(spark, sf):
    p = V.panel_ud(spark, sf)
    return S.rollup(p, ["unit", F.floor(F.col("t") / 7).cast("int").alias("week")], {"mean": rounded(F.avg("value")), "n": F.sum("n"), "peak": F.max("value")})


@query(f"""WITH {V.PANEL_UD} SELECT unit, year(DATE '1970-01-01' + t::INT)::INT AS year, round(avg(n), 6) AS mean_n, round(sum(value), 4) AS total FROM panel GROUP BY ALL""")
def b4_rollup_years(spark, sf):
    return S.rollup(V.panel_ud(spark, sf), ["unit", F.year(F.date_from_unix_date("t")).alias("year")], {"mean_n": rounded(F.avg("n")), "total": rounded(F.sum("value"), 4)})


@query(f"""WITH {V.PANEL_NM}, y AS (SELECT unit, (t // 12)::INT AS year, avg(value) AS mean, sum(value) AS total, quantile_cont(value, 0.9) AS p90, count(value) AS months FROM panel GROUP BY ALL)
SELECT unit, year, round(mean, 4) AS mean, round(total, 2) AS total, round(p90, 4) AS p90, months, round(least(1.0, months / 12), 6) AS coverage, CASE WHEN months > 0 THEN 1 ELSE 0 END AS has_obs,
 round(mean - lag(mean) OVER (PARTITION BY unit ORDER BY year), 4) AS change FROM y""")
def b5_seasonal_year_panel(spark, sf):
    return r(r(r(S.seasonal_year_panel(V.panel_nm(spark, sf)), "mean", "p90", "change", digits=4), "total", digits=2), "coverage")


@query(f"""WITH {V.PANEL_NM}, y AS (SELECT unit, (t // 12)::INT AS year, regr_slope(ln(1 + value), t % 12) AS slope, max(value) AS peak, max_by(value, t) AS last FROM panel GROUP BY ALL)
SELECT unit, year, round(greatest(CASE WHEN NOT isnan(slope) THEN slope END, 0), 6) AS recovery, round(greatest(CASE WHEN NOT isnan(slope) THEN -slope END, 0), 6) AS decline, round(greatest(peak - last, 0), 4) AS drop FROM y""")
def b6_intra_period_shape(spark, sf):
    return r(r(S.intra_period_shape(V.panel_nm(spark, sf)), "recovery", "decline"), "drop", digits=4)


@query(f"""WITH {V.PANEL_NM}, a AS (SELECT unit, t, value - avg(value) OVER (PARTITION BY unit, t % 12) AS anomaly, value - lag(value, 12) OVER (PARTITION BY unit ORDER BY t) AS d FROM panel)
SELECT unit, (t // 12)::INT AS year, round(avg(abs(anomaly)), 4) AS mean_abs, round(max(anomaly), 4) AS spike, round(avg(d), 4) AS mean_diff12 FROM a GROUP BY ALL""")
def b7_seasonal_anomaly(spark, sf):
    return r(S.seasonal_anomaly(V.panel_nm(spark, sf)), "mean_abs", "spike", "mean_diff12", digits=4)


@query(f"""WITH {V.PANEL_SY}, d AS (SELECT unit, t, CASE WHEN qty <> 0 THEN value / qty END AS density FROM panel)
SELECT unit, t, round(density, 6) AS density, round(density - lag(density) OVER w, 6) AS change, round(density / nullif(lag(density) OVER w, 0) - 1, 6) AS growth FROM d WINDOW w AS (PARTITION BY unit ORDER BY t)""")
def b8_stock_panel(spark, sf):
    return r(S.stock_panel(V.panel_sy(spark, sf), "value", "qty"), "density", "change", "growth")


@query(f"""WITH {V.PANEL_SY} SELECT unit, t, round(value, 4) AS value, round(disc, 6) AS disc, round(value - lag(value) OVER w, 4) AS value_yoy, round(disc - lag(disc) OVER w, 6) AS disc_yoy FROM panel WINDOW w AS (PARTITION BY unit ORDER BY t)""")
def b9_history_panel(spark, sf):
    return r(r(S.history_panel(V.panel_sy(spark, sf), ["value", "disc"]), "value", "value_yoy", digits=4), "disc", "disc_yoy")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, sum(n)::BIGINT AS total, round(sum(-p * ln(p)), 6) AS diversity FROM s GROUP BY ALL""")
def b11_diversity(spark, sf):
    counts = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return r(S.diversity(counts, ["user_id"], "n"), "diversity")


@query("""SELECT p_brand, sum((p_size > 40)::INT)::BIGINT AS large, sum((p_size <= 40 AND contains(p_type, 'STEEL'))::INT)::BIGINT AS steel,
 sum((NOT (p_size > 40) AND NOT contains(p_type, 'STEEL'))::INT)::BIGINT AS other FROM part GROUP BY ALL""")
def b12_classify_tags(spark, sf):
    return S.classify_tags(V.table(spark, sf, "part"), [("large", F.col("p_size") > 40), ("steel", F.col("p_type").contains("STEEL"))], ["p_brand"])


@query("""SELECT c_nationkey, (sum(CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 100)::BIGINT END) / 100.0)::DOUBLE AS BUILDING, (sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN round(c_acctbal * 100)::BIGINT END) / 100.0)::DOUBLE AS MACHINERY
 FROM customer GROUP BY ALL""")
def b13_pivot_measures(spark, sf):
    return S.pivot_measures(V.table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"], F.sum(V.cents("c_acctbal")) / 100.0)


_SRC = """src AS (SELECT l_orderkey AS unit, l_linenumber AS prio, CASE WHEN l_quantity > 10 THEN l_quantity END AS a, CASE WHEN l_discount > 0.03 THEN l_discount END AS b FROM lineitem)"""


def _sources(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("prio"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("b"))


@query(f"""WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY prio % 3, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, a ASC NULLS FIRST, b ASC NULLS FIRST, prio) AS k FROM src)
SELECT unit, (prio % 3)::INT AS prio, a, b FROM r WHERE k = 1""")
def b14_collapse_sources(spark, sf):
    src = _sources(spark, sf).withColumn("prio", (F.col("prio") % 3).cast("int"))
    return S.collapse_sources(src, ["unit"], "prio", ["a", "b"])


@query(f"""WITH {_SRC} SELECT unit, max_by(a, prio * 1000 + a) FILTER (a IS NOT NULL) AS a, max_by(b, prio * 1000 + b) FILTER (b IS NOT NULL) AS b FROM src GROUP BY ALL""")
def b15_collapse_columns(spark, sf):
    return S.collapse_columns(_sources(spark, sf), ["unit"], "prio", ["a", "b"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def b16_dedup(spark, sf):
    return S.dedup(V.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT s_suppkey, n.id AS n_nationkey FROM (SELECT s_suppkey, ' ' || lower(n_name) || ' ' AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
 LEFT JOIN (SELECT lower(trim(n_name)) AS k, min(n_nationkey) AS id FROM nation GROUP BY 1) n ON trim(s.nm) = n.k""")
def b17_attach_by_name(spark, sf):
    n, s = V.table(spark, sf, "nation"), V.table(spark, sf, "supplier")
    named = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("nm"))
    return S.attach_id_by_name(named, n, "nm", "n_name", "n_nationkey").select("s_suppkey", "n_nationkey")


@query("""SELECT p_partkey, trim(regexp_replace(replace(translate(lower(p_name || ' & É ' || p_type), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM part""")
def b18_norm_key(spark, sf):
    df = V.table(spark, sf, "part").withColumn("label", F.concat("p_name", F.lit(" & É "), "p_type"))
    return S.with_norm_key(df, "label").select("p_partkey", "key")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS turn FROM customer),
b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY turn, c_nationkey, c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM a)
SELECT c_custkey, c_mktsegment, c_nationkey FROM b ORDER BY (place - 1) / size, place, c_mktsegment LIMIT 40""")
def b19_balanced_sample(spark, sf):
    return S.balanced_sample(V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), 40, "c_mktsegment", "c_nationkey", "c_custkey")


@query(f"WITH {V.PANEL_NM} SELECT unit, t, round(ln(1 + value), 6) AS log_amount, round(value / n, 4) AS per_item, round(exp(-abs(ln(1 + value / n) - 11.5)), 6) AS comfort FROM panel")
def b20_ratio_features(spark, sf):
    return r(r(S.ratio_features(V.panel_nm(spark, sf), "value", "n").drop("grp", "value", "n"), "log_amount", "comfort"), "per_item", digits=4)


@query(f"""WITH {V.PANEL_SY}, g AS (SELECT unit, value / nullif(lag(value) OVER (PARTITION BY unit ORDER BY t), 0) - 1 AS g FROM panel)
SELECT unit, max(CASE WHEN g > 0.3 THEN 1 ELSE 0 END) AS surge, round(max(g), 6) AS top_growth FROM g GROUP BY ALL""")
def b21_surge_flag(spark, sf):
    return r(S.surge_flag(V.panel_sy(spark, sf)), "top_growth")


@query(f"""WITH {V.PANEL_SY}, g AS (SELECT unit, t, disc, value / nullif(lag(value) OVER (PARTITION BY unit ORDER BY t), 0) - 1 AS g0 FROM panel), c AS (SELECT *, CASE WHEN g0 IS NOT NULL THEN least(greatest(g0, -0.5), 1.0) END AS g FROM g)
SELECT unit, t, round(g, 6) AS growth, round(g * disc * 10, 6) AS main, round(g * (1 - disc * 10), 6) AS local FROM c""")
def b22_split_growth(spark, sf):
    return r(S.split_growth(V.panel_sy(spark, sf), F.col("disc") * 10), "growth", "main", "local")


@query("""SELECT floor(l_discount * 100 / 3)::INT AS row, floor(l_quantity / 10)::INT AS col, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS returned, sum((l_linestatus = 'O')::INT)::BIGINT AS open FROM lineitem GROUP BY ALL""")
def b23_grid_bin(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("y", F.col("l_discount") * 100)
    return S.grid_bin(li.withColumn("x", F.col("l_quantity") * 3 / 10), F.col("x"), F.col("y"), 3.0, {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})


@query(f"WITH {V.PANEL_SY} SELECT cl, t, round(avg(disc), 6) AS disc, round(avg(value), 4) AS value, sum(qty)::BIGINT AS qty_sum, count(DISTINCT unit) AS units FROM panel GROUP BY ALL")
def b24_collapse_to_cluster(spark, sf):
    return r(r(S.collapse_to_cluster(V.panel_sy(spark, sf), "cl", ["disc", "value"], ["qty"]), "disc"), "value", digits=4)


@query("""WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ' | ') || ' | ', '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, unnest(range(1, len(l) + 1))::INT AS place, unnest(l) AS ref FROM p""")
def b25_explode_refs(spark, sf):
    return S.explode_refs(V.table(spark, sf, "part"), "p_partkey", F.concat(F.regexp_replace("p_type", " ", " | "), F.lit(" | ")), "\\|")


@query("""WITH s AS (SELECT s_suppkey, round(s_acctbal)::BIGINT AS k FROM supplier), c AS (SELECT c_custkey, round(c_acctbal)::BIGINT AS j FROM customer)
SELECT s_suppkey, k, c_custkey, j FROM s JOIN c ON k = j WHERE k IN (SELECT k FROM s GROUP BY 1 HAVING count(*) = 1) AND j IN (SELECT j FROM c GROUP BY 1 HAVING count(*) = 1)""")
def b27_unique_match(spark, sf):
    s = V.table(spark, sf, "supplier").select("s_suppkey", F.round("s_acctbal").cast("long").alias("k"))
    c = V.table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal").cast("long").alias("j"))
    return S.unique_match(s, c, "k", "j").select("s_suppkey", "k", "c_custkey", "j")


@query(f"WITH {V.ROUTES}, g AS (SELECT src AS unit, sum(w)::BIGINT AS flow, count(DISTINCT dst) AS partners FROM routes GROUP BY 1) SELECT *, unnest(range(1995, 2002))::INT AS t FROM g")
def b10_connectivity_panel(spark, sf):
    return S.connectivity_panel(V.routes(spark, sf), 1995, 2001)


@query("""WITH g AS (SELECT l_suppkey AS unit, year(l_shipdate)::INT AS t, sum(CASE WHEN l_discount > 0.09 AND l_linenumber = 2 THEN round(l_quantity)::BIGINT END)::DOUBLE / count(CASE WHEN l_discount > 0.09 AND l_linenumber = 2 THEN 1 END) AS v, min(l_returnflag) AS s FROM lineitem GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i FROM g),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM p
 WINDOW b AS (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT unit, t, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1), 5) AS value, CASE WHEN v IS NOT NULL THEN s ELSE 'interpolated' END AS source FROM n""")
def b26_sourced_means(spark, sf):
    li = V.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("t"), F.when((F.col("l_discount") > 0.09) & (F.col("l_linenumber") == 2), F.round("l_quantity")).alias("q"), "l_returnflag")
    return r(S.sourced_means(rows, "q", "l_returnflag"), "value", digits=5)
