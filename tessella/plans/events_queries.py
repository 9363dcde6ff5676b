"""Queries of the event-registry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import events as E
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r

EXP = f"{V.REGISTRY}, ex AS (SELECT *, unnest(range(start_t, end_t + 1))::INT AS t FROM registry WHERE end_t >= start_t)"
NM = """np AS (SELECT c_nationkey AS unit, c_nationkey AS cl, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _np(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("cl"), month.alias("t")).agg((F.sum(V.cents("o_totalprice")) / 100.0).alias("value")).withColumn("unit", F.col("cl"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), 'mail') THEN 'contact' ELSE 'other' END AS kind FROM documents""")
def f1_keyword_class(spark, sf):
    rules = [("legal", ["license"]), ("secret", ["password", "token"]), ("contact", ["mail"])]
    return V.table(spark, sf, "documents").select("doc_id", E.keyword_class(F.col("text"), rules).alias("kind"))


@query(f"""WITH {V.REGISTRY} SELECT event, CASE WHEN kind = 'F' AND intensity >= 0.8 THEN 'A' WHEN kind IN ('F', 'O') THEN 'B' ELSE 'C' END AS grade, (CASE WHEN kind = 'F' AND intensity >= 0.8 THEN 1.0 WHEN kind IN ('F', 'O') THEN 0.6 ELSE 0.3 END)::DOUBLE AS score FROM registry""")
def f2_evidence_grade(spark, sf):
    grade, score = E.evidence_grade(F.col("kind"), F.col("intensity"))
    return V.registry(spark, sf).select("event", grade.alias("grade"), score.alias("score"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') AS w FROM conversations), h AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('the', 'and')))::INT AS a, len(list_filter(w, lambda x: x IN ('die', 'und', 'der')))::INT AS b FROM w)
SELECT conv_id, turn, a AS hits_en, b AS hits_de, CASE WHEN greatest(a, b) > 0 THEN CASE WHEN a >= b THEN 'en' ELSE 'de' END END AS best FROM h""")
def f3_keyword_scores(spark, sf):
    return E.keyword_scores(V.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", {"en": ["the", "and"], "de": ["die", "und", "der"]}).drop("text")


@query(f"WITH {EXP} SELECT event, cl, t, (t = start_t)::INT AS is_new FROM ex")
def f6_expand_intervals(spark, sf):
    return E.expand_intervals(V.registry(spark, sf)).select("event", "cl", "t", "is_new")


@query(f"""WITH {EXP}, g AS (SELECT cl, t, count(*) AS events, sum((t = start_t)::INT)::BIGINT AS new_events, sum(intensity) AS i, sum(CASE WHEN kind = 'F' THEN intensity ELSE 0 END) AS f, sum(CASE WHEN kind = 'O' THEN intensity ELSE 0 END) AS o FROM ex GROUP BY ALL)
SELECT cl, t, events, new_events, round(i, 9) AS intensity, round(f, 9) AS "intensity_F", round(o, 9) AS "intensity_O", CASE WHEN greatest(f, o) > 0 THEN CASE WHEN f >= o THEN 'F' ELSE 'O' END END AS dominant FROM g""")
def f7_period_intensity(spark, sf):
    return r(E.period_intensity(V.registry(spark, sf), ["F", "O"]), "intensity", "intensity_F", "intensity_O", digits=9)


@query(f"WITH {V.REGISTRY} SELECT cl, min(start_t) AS cohort_all, min(CASE WHEN kind = 'F' THEN start_t END) AS cohort_final, min(CASE WHEN intensity > 0.8 THEN start_t END) AS cohort_strong FROM registry GROUP BY 1")
def f8_cohorts(spark, sf):
    return E.cohorts(V.registry(spark, sf), {"all": F.lit(True), "final": F.col("kind") == "F", "strong": F.col("intensity") > 0.8})


@query(f"""WITH {EXP}, g AS (SELECT cl, t, round(sum(intensity), 9) AS i FROM ex GROUP BY ALL), p AS (SELECT cl, i AS peak, t AS peak_t FROM g QUALIFY row_number() OVER (PARTITION BY cl ORDER BY i DESC, t) = 1)
SELECT cl, round(peak, 6) AS peak, peak_t FROM p ORDER BY p.peak DESC, cl LIMIT 8""")
def f10_intense_cohort(spark, sf):
    return r(E.intense_cohort(V.registry(spark, sf), 8), "peak")


DID = f"""{V.REGISTRY}, {NM}, co AS (SELECT cl, min(CASE WHEN intensity > 0.8 THEN start_t END) AS c FROM registry GROUP BY 1), did AS (SELECT unit, np.cl, t, value, coalesce(c, 9999)::INT AS cohort, (coalesce(c, 9999) < 9999)::INT AS treated, (t >= coalesce(c, 9999))::INT AS post, ((coalesce(c, 9999) < 9999) AND t >= coalesce(c, 9999))::INT AS did FROM np LEFT JOIN co ON np.cl = co.cl)"""


def _did(spark, sf):
    c = E.cohorts(V.registry(spark, sf), {"x": F.col("intensity") > 0.8}).withColumnRenamed("cohort_x", "cohort")
    return E.rollout(_np(spark, sf), c)


@query(f"WITH {DID} SELECT unit, cl, t, value, cohort, treated, post, did FROM did")
def f11_rollout(spark, sf):
    return _did(spark, sf).select("unit", "cl", "t", "value", "cohort", "treated", "post", "did")


@query(f"""WITH {V.PANEL_SY}, f AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY unit ORDER BY t) = 1), s AS (SELECT unit, cl, 0.6 * (rank() OVER (PARTITION BY cl ORDER BY value) + (count(*) OVER (PARTITION BY cl, value) - 1) / 2) / count(*) OVER (PARTITION BY cl) + 0.4 * (rank() OVER (PARTITION BY cl ORDER BY qty) + (count(*) OVER (PARTITION BY cl, qty) - 1) / 2) / count(*) OVER (PARTITION BY cl) AS s FROM f)
SELECT unit, cl, round(s, 6) AS salience, row_number() OVER (PARTITION BY cl ORDER BY round(s, 9) DESC, unit)::INT AS rank, count(*) OVER (PARTITION BY cl) AS units FROM s""")
def f12_salience(spark, sf):
    return r(E.salience(V.edge_rows(V.panel_sy(spark, sf), last=False), {"value": 0.6, "qty": 0.4}), "salience")


@query(f"""WITH {DID}, ex AS (SELECT *, unnest(range(start_t, end_t + 1))::INT AS t FROM registry WHERE end_t >= start_t), g AS (SELECT cl, t, count(*) AS events, sum(intensity) AS i FROM ex GROUP BY ALL),
j AS (SELECT did.unit, did.cl, did.t, post * coalesce(i, 0) AS dose, coalesce(events, 0) AS events FROM did LEFT JOIN g ON did.cl = g.cl AND did.t = g.t)
SELECT unit, cl, t, round(dose, 6) AS dose, round(max(dose) OVER (PARTITION BY cl), 6) AS peak_dose, round(avg(dose) OVER (PARTITION BY cl), 6) AS mean_dose, sum((dose > 0)::INT) OVER (PARTITION BY cl)::BIGINT AS active, events - lag(events) OVER (PARTITION BY unit ORDER BY t) AS event_delta FROM j""")
def f13_doses(spark, sf):
    return r(E.doses(_did(spark, sf), E.period_intensity(V.registry(spark, sf), ["F", "O"])), "dose", "peak_dose", "mean_dose")


@query(f"""WITH {V.REGISTRY}, {NM}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY cl ORDER BY t) AS d FROM np WHERE cl NOT IN (SELECT cl FROM registry WHERE intensity > 0.99)), e AS (SELECT *, d - quantile_cont(d, 0.5) OVER (PARTITION BY cl) AS dev FROM d),
z AS (SELECT *, dev / nullif(1.4826 * quantile_cont(abs(dev), 0.5) OVER (PARTITION BY cl), 0) AS z FROM e), b AS (SELECT * FROM z WHERE z IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cl ORDER BY z DESC, t) = 1)
SELECT cl, t AS start_t, round(z, 6) AS z, round(least(1.0, z / 5), 6) AS intensity FROM b WHERE z > 1""")
def f14_indicator_breaks(spark, sf):
    covered = V.registry(spark, sf).filter("intensity > 0.99").select("cl").distinct()
    return r(E.indicator_breaks(_np(spark, sf), covered), "z", "intensity")


@query(f"""WITH {V.PANEL_SY}, u AS (SELECT unit, avg(CASE WHEN t >= 1999 THEN value END) - avg(CASE WHEN t < 1999 THEN value END) AS j FROM panel GROUP BY 1) SELECT unit, round(j, 1) AS jump, (j >= (SELECT quantile_cont(j, 0.75) FROM u))::INT AS treated FROM u""")
def f17_jump_design(spark, sf):
    return r(E.jump_design(V.panel_sy(spark, sf), 1999), "jump", digits=1)


@query(f"""WITH {V.PANEL_SY}, g AS (SELECT unit, t, value / nullif(lag(value) OVER (PARTITION BY unit ORDER BY t), 0) - 1 AS g FROM panel), n AS (SELECT *, lead(g) OVER (PARTITION BY unit ORDER BY t) AS n FROM g) SELECT unit, min(CASE WHEN g >= 0.05 AND n >= 0.05 THEN t END) AS cohort FROM n GROUP BY 1""")
def f18_sustained_jump(spark, sf):
    return E.sustained_jump(V.panel_sy(spark, sf), 0.05)


@query(f"WITH {DID} SELECT unit, coalesce(min(CASE WHEN cohort < 9999 THEN cohort END), min(CASE WHEN did = 1 THEN t END), 9999)::INT AS cohort FROM did GROUP BY 1")
def f19_schedule(spark, sf):
    return E.schedule(_did(spark, sf))


READY = f"""{DID}, ok AS (SELECT cohort FROM (SELECT DISTINCT unit, cohort FROM did) WHERE cohort BETWEEN 2 AND 70 GROUP BY 1 HAVING count(*) >= 2), ready AS (SELECT unit, t, value, coalesce(ok.cohort, 9999)::INT AS cohort, (t >= coalesce(ok.cohort, 9999))::INT AS did FROM did LEFT JOIN ok ON did.cohort = ok.cohort WHERE t BETWEEN 2 AND 70)"""


@query(f"WITH {READY} SELECT * FROM ready")
def f20_timing_ready(spark, sf):
    return E.timing_ready(_did(spark, sf), 2, 70, 2)


@query(f"WITH {V.REGISTRY} SELECT kind, count(*) AS events, count(DISTINCT cl) AS clusters, round(avg(intensity), 6) AS mean_intensity, round(count(DISTINCT cl) / 25.0, 6)::DOUBLE AS coverage FROM registry GROUP BY GROUPING SETS ((kind), ())")
def f21_registry_audit(spark, sf):
    return r(E.registry_audit(V.registry(spark, sf), 25), "mean_intensity", "coverage")


@query(f"WITH {V.REGISTRY} SELECT event, cl, end_t AS start_t FROM registry")
def f23_switch_variant(spark, sf):
    df = V.registry(spark, sf).select("event", "cl", "start_t", F.col("end_t").alias("start_t_alt"))
    return E.switch_variant(df, "_alt")


PROJECTS = """o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'n' || c_nationkey || '; N' || (c_nationkey + 7) % 25 ELSE 'X' END AS codes, CASE WHEN o_orderkey % 4 = 1 THEN ' ' || lower(n_name) || '!' ELSE '' END AS name, CASE WHEN o_orderkey % 4 = 2 THEN r_name ELSE '?' END AS region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {PROJECTS}, n AS (SELECT n_nationkey AS cl, 'N' || n_nationkey AS code, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS name, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT id, cl, 1 AS level FROM (SELECT id, unnest(regexp_split_to_array(upper(codes), '[^A-Z0-9]+')) AS k FROM o) JOIN n ON k = code UNION SELECT id, cl, 2 FROM o JOIN n ON trim(regexp_replace(lower(o.name), '[^a-z0-9]+', ' ', 'g')) = n.name UNION SELECT id, cl, 3 FROM o JOIN n ON lower(o.region) = n.region),
b AS (SELECT * FROM m QUALIFY level = min(level) OVER (PARTITION BY id)) SELECT o.id, cl, CASE level WHEN 1 THEN 'code' WHEN 2 THEN 'name' WHEN 3 THEN 'region' ELSE 'unresolved' END AS how FROM o LEFT JOIN b ON o.id = b.id""")
def f4_resolve_codes(spark, sf):
    o, c, n, g = (V.table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    nations = n.join(g, n.n_regionkey == g.r_regionkey)
    j = o.join(c, o.o_custkey == c.c_custkey).join(nations, c.c_nationkey == nations.n_nationkey)
    k, part = F.col("c_nationkey"), F.col("o_orderkey") % 4
    codes = F.when(part == 0, F.concat(F.lit("n"), k.cast("string"), F.lit("; N"), ((k + 7) % 25).cast("string"))).otherwise("X")
    name = F.when(part == 1, F.concat(F.lit(" "), F.lower("n_name"), F.lit("!"))).otherwise("")
    rows = j.select(F.col("o_orderkey").alias("id"), codes.alias("codes"), name.alias("name"), F.when(part == 2, F.col("r_name")).otherwise("?").alias("region"))
    return E.resolve_codes(rows, nations.select(F.col("n_nationkey").alias("cl"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region")))


@query("""WITH p AS (SELECT c_nationkey AS cl, year(o_orderdate)::INT AS t, o_orderpriority AS name, round(o_totalprice * 100)::BIGINT AS cents, o_custkey::VARCHAR AS project FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT cl, t, name, sum(cents)::DOUBLE / 100.0 AS amount, count(DISTINCT project) AS projects, array_to_string(list_sort(list(DISTINCT project))[1:6], '|') AS refs FROM p GROUP BY ALL),
s AS (SELECT *, CASE WHEN max(amount) OVER w > min(amount) OVER w THEN (ln(1 + amount) - min(ln(1 + amount)) OVER w) / (max(ln(1 + amount)) OVER w - min(ln(1 + amount)) OVER w) ELSE 1 END AS a, CASE WHEN max(projects) OVER w > min(projects) OVER w THEN (projects - min(projects) OVER w) / (max(projects) OVER w - min(projects) OVER w) ELSE 1 END AS b, quantile_cont(amount, 0.55) OVER w AS q FROM g WINDOW w AS (PARTITION BY cl))
SELECT cl, t, name, amount, projects, refs, round(least(greatest(0.75 * a + 0.25 * b, 0.05), 1), 6) AS intensity FROM s WHERE amount >= q OR projects >= 2 OR NOT EXISTS (SELECT 1 FROM s WHERE amount >= q OR projects >= 2)""")
def f5_project_events(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    p = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("cl"), F.year("o_orderdate").alias("t"), F.col("o_orderpriority").alias("name"), V.cents("o_totalprice").alias("cents"), F.col("o_custkey").alias("project"))
    return r(E.project_events(p), "intensity")


@query(f"""WITH {V.REGISTRY}, {NM}, g AS (SELECT *, kind IN ('F', 'O') AS external, CASE WHEN kind = 'F' AND intensity >= 0.8 THEN 'A' ELSE 'B' END AS grade FROM registry), base AS (SELECT * FROM g WHERE grade = 'A' OR NOT EXISTS (SELECT 1 FROM g WHERE grade = 'A') AND (external OR NOT EXISTS (SELECT 1 FROM g WHERE external))),
c0 AS (SELECT * FROM base WHERE intensity >= 0.7 AND start_t <= 60), core AS (SELECT * FROM c0 UNION ALL SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM c0) AND start_t <= 60 AND intensity >= (SELECT quantile_cont(intensity, 0.6) FROM base)),
n AS (SELECT count(DISTINCT cl) AS n FROM np), tr AS (SELECT 'core' AS k, cl, min(start_t) AS cohort FROM core GROUP BY ALL UNION ALL SELECT 'external', cl, min(start_t) FROM g WHERE external GROUP BY ALL UNION ALL SELECT 'all', cl, min(start_t) FROM g GROUP BY ALL),
sh AS (SELECT k, count(*) / any_value(n) AS s FROM tr, n WHERE cl IN (SELECT cl FROM np) GROUP BY 1),
opts AS (SELECT * FROM (VALUES (1, 'direct_core', 'core', 0.08, 0.7), (2, 'external_direct', 'external', 0.05, 0.7), (3, 'direct_non_ai_fallback', 'all', 0.05, 0.8), (4, 'external_direct_high_coverage_fallback', 'external', 0, 1), (5, 'direct_non_ai_fallback', 'all', 0, 1)) v(o, name, k, low, high)),
pick AS (SELECT k, name FROM opts JOIN sh USING (k) WHERE s BETWEEN low AND high ORDER BY o LIMIT 1)
SELECT cl, cohort, name AS track FROM tr JOIN pick USING (k)""")
def f9_core_design(spark, sf):
    g = V.registry(spark, sf)
    g = g.withColumn("external", F.col("kind").isin("F", "O")).withColumn("grade", F.when((F.col("kind") == "F") & (F.col("intensity") >= 0.8), "A").otherwise("B"))
    return E.core_design(g, _np(spark, sf), 60)
