"""Queries of the provenance and coverage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import quality as G
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r

MASK = """m AS (SELECT o_custkey AS unit, o_orderkey, o_orderpriority AS a, o_orderstatus AS b, (coalesce(o_orderpriority <> '5-LOW', false) AND coalesce(o_orderstatus IN ('F', 'O', 'P'), false))::INT AS is_objective,
 (coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), false) AND coalesce(o_orderstatus IN ('F', 'O'), false))::INT AS is_verified FROM orders)"""


def _masked(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    allowed = {"a": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "b": ["F", "O", "P"]}
    return G.source_masks(o, allowed, {"a": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "b": ["F", "O"]})


@query(f"WITH {MASK} SELECT o_orderkey, is_objective, is_verified FROM m")
def g1_source_masks(spark, sf):
    return _masked(spark, sf).select("o_orderkey", "is_objective", "is_verified")


@query(f"WITH {MASK}, u AS (SELECT unit, min(is_objective) AS o, min(is_verified) AS v FROM m GROUP BY 1) SELECT m.unit, o_orderkey FROM m JOIN u ON m.unit = u.unit WHERE CASE WHEN (SELECT avg(v) FROM u) >= 0.5 THEN v = 1 ELSE o = 1 END")
def g2_strict_filter(spark, sf):
    return G.strict_filter(_masked(spark, sf), 0.5).select("unit", "o_orderkey")


@query("SELECT coalesce(o_orderpriority, 'missing') AS a, coalesce(o_orderstatus, 'missing') AS b, count(*) AS n FROM orders GROUP BY ALL")
def g3_source_combinations(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return G.source_combinations(o, ["a", "b"])


COV = f"""{V.PANEL_NM}, cov AS (SELECT grp, count(DISTINCT unit) AS units, count(*) AS rows_ FROM panel GROUP BY GROUPING SETS ((grp), ()))"""


@query(f'WITH {COV} SELECT grp, units, rows_ AS "rows", units * 80 AS expected, round(rows_ / (units * 80), 6) AS ratio FROM cov')
def g4_coverage(spark, sf):
    return r(G.coverage(V.panel_nm(spark, sf), 80), "ratio")


@query(f"""WITH {COV}, m AS (SELECT 'ratio_' || lower(grp) AS metric, rows_ / (units * 80) AS value FROM cov WHERE grp IS NOT NULL), x(metric, threshold, direction) AS (VALUES ('ratio_asia', 0.95::DOUBLE, 'min'), ('ratio_africa', 0.99, 'min'), ('ratio_europe', 0.5, 'max'))
SELECT metric, round(value, 6) AS value, threshold, direction, (CASE WHEN direction = 'max' THEN value <= threshold ELSE value >= threshold END)::INT AS passed, round((value - threshold) / abs(threshold), 6) AS gap FROM m JOIN x USING (metric)""")
def g5_gates(spark, sf):
    m = G.coverage(V.panel_nm(spark, sf), 80).filter("grp IS NOT NULL").select(F.concat(F.lit("ratio_"), F.lower("grp")).alias("metric"), F.col("ratio").alias("value"))
    limits = spark.createDataFrame([("ratio_asia", 0.95, "min"), ("ratio_africa", 0.99, "min"), ("ratio_europe", 0.5, "max")], "metric string, threshold double, direction string")
    return r(G.gates(m, limits), "value", "gap")


@query("""WITH c AS (SELECT doc_id, (contains(text, '@'))::INT AS a, (contains(text, 'http'))::INT AS b, (n_chars > 2000)::INT AS c FROM documents) SELECT doc_id, a AS has_mail, b AS has_link, c AS has_length, a + b + c AS channels, CASE a + b + c WHEN 3 THEN 'full' WHEN 2 THEN 'partial' WHEN 1 THEN 'thin' ELSE 'none' END AS tier FROM c""")
def g6_measurement_audit(spark, sf):
    d = V.table(spark, sf, "documents")
    channels = {"mail": F.contains("text", F.lit("@")), "link": F.contains("text", F.lit("http")), "length": F.col("n_chars") > 2000}
    return G.measurement_audit(d, channels).select("doc_id", "has_mail", "has_link", "has_length", "channels", "tier")


@query(f"""WITH {V.PANEL_SY}, z AS (SELECT unit, t, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS a, (qty - avg(qty) OVER w) / stddev_pop(qty) OVER w AS b, (disc - avg(disc) OVER w) / stddev_pop(disc) OVER w AS c FROM panel WINDOW w AS (PARTITION BY t)),
s AS (SELECT unit, t, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3) AS d, ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) AS p, ((a < 0)::INT + (b < 0)::INT + (c < 0)::INT) AS m FROM z), g AS (SELECT *, (p * (p - 1) / 2 + m * (m - 1) / 2 + (3 - p - m) * (2 - p - m) / 2) / 3 AS agree FROM s)
SELECT unit, t, round(d, 6) AS dispersion, round(agree, 6) AS agreement, CASE WHEN agree >= 0.99 THEN 'consistent' WHEN agree >= 0.3 THEN 'mixed' ELSE 'conflicting' END AS band FROM g""")
def g7_signal_consistency(spark, sf):
    p = V.panel_sy(spark, sf).withColumn("qty", F.col("qty").cast("double"))
    return r(G.signal_consistency(p, ["value", "qty", "disc"]), "dispersion", "agreement")


@query(f"""WITH {V.PANEL_SY}, d AS (SELECT value - 3000000 AS v, qty - 2000.0 AS q, disc - 0.05 AS d FROM panel)
SELECT 'v' AS a, 'q' AS b, count(*) AS n, round(corr(v, q), 6) AS corr, round(avg((sign(v) = sign(q))::INT), 6) AS same_sign FROM d UNION ALL SELECT 'v', 'd', count(*), round(corr(v, d), 6), round(avg((sign(v) = sign(d))::INT), 6) FROM d UNION ALL SELECT 'q', 'd', count(*), round(corr(q, d), 6), round(avg((sign(q) = sign(d))::INT), 6) FROM d""")
def g8_signal_pairs(spark, sf):
    p = V.panel_sy(spark, sf).select((F.col("value") - 3000000).alias("v"), (F.col("qty") - 2000.0).alias("q"), (F.col("disc") - 0.05).alias("d"))
    return r(G.signal_pairs(p, ["v", "q", "d"]), "corr", "same_sign")


@query("""SELECT 'lang' AS "column", coalesce(lang, 'missing') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'missing'), count(*) FROM documents GROUP BY ALL""")
def g9_value_counts(spark, sf):
    return G.value_counts(V.table(spark, sf, "documents"), ["lang", "source"])


@query(f"WITH {V.PANEL_NM} SELECT DISTINCT unit FROM panel WHERE unit NOT IN (SELECT unit FROM panel WHERE t BETWEEN 0 AND 78 AND value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT t) = 79)")
def g10_incomplete_units(spark, sf):
    p = V.panel_nm(spark, sf)
    return G.incomplete_units(p, p, "value", 0, 78)
