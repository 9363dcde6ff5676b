"""Queries of the spatial and network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.columns import haversine_km
from tessella.operators import spatial as S
from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources.tables import spread

KM = "2 * 6371.0 * asin(sqrt(least(1.0, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)))"
_KM = KM.format(a="a.lat", b="a.lon", c="b.lat", d="b.lon")
PAIRS = f"""{V.COORDS}, pairs AS (SELECT a.unit AS src, b.unit AS dst, {_KM} AS km FROM coords a JOIN coords b ON a.unit <> b.unit WHERE {_KM} <= 6000),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY km, dst) <= 4), idw AS (SELECT src, dst, km, (1 / greatest(km, 1)) / sum(1 / greatest(km, 1)) OVER (PARTITION BY src) AS w FROM near)"""
#: The same of customers' places, within 1,000 km.
PLACE_PAIRS = PAIRS.replace(V.COORDS, V.PLACES).replace("<= 6000", "<= 1000")
#: The supplier panel by nation, and the nations' order panel by nation key.
PANEL_NK = f"""{V.PANEL_SY}, np AS (SELECT cl AS unit, t, sum(qty)::BIGINT AS qty FROM panel GROUP BY ALL)"""


def _near(spark, sf):
    return S.nearest_edges(S.near_pairs(V.coords(spark, sf), 6000.0), 4)


def _near_places(spark, sf):
    return S.nearest_units(V.places(spark, sf), 1000.0, 4)


def _panel(spark, sf):
    return V.panel_sy(spark, sf).groupBy(F.col("cl").alias("unit"), "t").agg(F.sum("qty").alias("qty"))


@query(f"""WITH {V.PLACES} SELECT unit, round({KM.format(a="lat", b="lon", c="10.0", d="20.0")}, 4) AS km, round({KM.format(a="lat", b="lon", c="-lat", d="lon + 90")}, 4) AS far FROM coords""")
def e2_great_circle(spark, sf):
    c = V.places(spark, sf)
    return r(c.select("unit", haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)).alias("km"), haversine_km(F.col("lat"), F.col("lon"), -F.col("lat"), F.col("lon") + 90).alias("far")), "km", "far", digits=4)


@query(f"""WITH {V.PLACES}, k AS (SELECT 111.19492664455873 AS ky, 111.19492664455873 * cos(radians(-10.0)) AS kx), s AS (SELECT unit, (lon + 20) * kx AS x, (lat + 10) * ky AS y, 60 * kx AS dx, 30 * ky AS dy FROM coords, k),
a AS (SELECT *, least(greatest((x * dx + y * dy) / (dx * dx + dy * dy), 0), 1) AS f FROM s) SELECT unit, round(sqrt((x - f * dx) ** 2 + (y - f * dy) ** 2), 4) AS km, (sqrt((x - f * dx) ** 2 + (y - f * dy) ** 2) <= 2500)::INT AS treated FROM a""")
def e3_segment_distance(spark, sf):
    c = V.places(spark, sf).withColumn("km", S.segment_km(F.col("lat"), F.col("lon"), (-10.0, -20.0), (20.0, 40.0)))
    return r(c.select("unit", "km", (F.col("km") <= 2500).cast("int").alias("treated")), "km", digits=4)


@query(f"WITH {PLACE_PAIRS} SELECT src, dst, round(km, 4) AS km, row_number() OVER (PARTITION BY src ORDER BY km, dst)::INT AS rank FROM near")
def e4_nearest_units(spark, sf):
    return r(_near_places(spark, sf), "km", digits=4)


@query(f"WITH {PLACE_PAIRS} SELECT src, dst, round(w, 6) AS w FROM idw")
def e5_inverse_distance(spark, sf):
    return r(S.inverse_distance(_near_places(spark, sf)).select("src", "dst", "w"), "w")


@query(f"""WITH {PLACE_PAIRS}, g AS (SELECT n.src, n.dst, 1 / greatest(abs(a.mass - b.mass), 2) AS w FROM near n JOIN coords a ON n.src = a.unit JOIN coords b ON n.dst = b.unit) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM g""")
def e6_similarity_weights(spark, sf):
    return r(S.similarity_weights(_near_places(spark, sf).select("src", "dst", "km"), V.places(spark, sf), "mass", 2.0), "w")


@query(f"WITH {V.ROUTES} SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst)::INT AS rank FROM routes QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 3")
def e7_top_edges(spark, sf):
    return S.top_edges(V.routes(spark, sf), 3).select("src", "dst", "w", "rank")


@query(f"WITH {PAIRS}, {PANEL_NK} SELECT src AS unit, t, round(sum(qty / greatest(km, 1)), 6) AS access FROM near JOIN np ON near.dst = np.unit GROUP BY ALL")
def e8_accessibility(spark, sf):
    return r(S.accessibility(_near(spark, sf), _panel(spark, sf), "qty"), "access")


@query(f"""WITH {PAIRS}, {PANEL_NK}, l AS (SELECT src AS unit, t, sum(w * qty) / sum(w) AS lag FROM idw JOIN np ON idw.dst = np.unit GROUP BY ALL), m AS (SELECT t, quantile_cont(qty, 0.5) AS m FROM np GROUP BY 1)
SELECT np.unit, np.t, round(coalesce(lag, m), 6) AS spatial_lag FROM np LEFT JOIN l ON np.unit = l.unit AND np.t = l.t JOIN m ON np.t = m.t""")
def e9_spatial_lag(spark, sf):
    return r(S.spatial_lag(S.inverse_distance(_near(spark, sf)), _panel(spark, sf), "qty"), "spatial_lag")


@query(f"""WITH {PAIRS}, {PANEL_NK}, x AS (SELECT src AS unit, t + 1 AS t, avg(qty) AS e, count(*) AS k FROM near JOIN np ON near.dst = np.unit GROUP BY ALL) SELECT np.unit, np.t, round(e, 4) AS exposure, k AS neighbours FROM np LEFT JOIN x ON np.unit = x.unit AND np.t = x.t""")
def e10_neighbour_exposure(spark, sf):
    return r(S.neighbour_exposure(_near(spark, sf), _panel(spark, sf), "qty"), "exposure", digits=4)


@query(f"""WITH {PAIRS}, {PANEL_NK}, x AS (SELECT src AS unit, t, avg(qty) AS m FROM near JOIN np ON near.dst = np.unit GROUP BY ALL), j AS (SELECT np.unit, np.t, m, qty - m AS gap FROM np LEFT JOIN x ON np.unit = x.unit AND np.t = x.t)
SELECT unit, t, round(m, 4) AS mean, round(gap, 4) AS gap, round(m - lag(m) OVER (PARTITION BY unit ORDER BY t), 4) AS delta FROM j""")
def e11_spillover_features(spark, sf):
    return r(S.spillover_features(_near(spark, sf), _panel(spark, sf), "qty"), "mean", "gap", "delta", digits=4)


@query(f"""WITH {V.ROUTES}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM routes WHERE src <> dst) SELECT src, dst, rank::INT AS rank, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM k WHERE rank <= 5""")
def e12_route_weights(spark, sf):
    return r(S.route_weights(V.routes(spark, sf), 5), "w")


@query(f"""WITH {PLACE_PAIRS}, s AS (SELECT src, dst, sqrt(a.mass * b.mass) / greatest(km, 25) AS w FROM pairs JOIN coords a ON src = a.unit JOIN coords b ON dst = b.unit WHERE a.grp = b.grp), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM s)
SELECT src, dst, rank::INT AS rank, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM k WHERE rank <= 3""")
def e13_proxy_access(spark, sf):
    return r(S.proxy_access(V.places(spark, sf), 1000.0, 3), "w")


@query(f"""WITH {V.ROUTES}, {V.COORDS}, j AS (SELECT src, dst, w, a.grp <> b.grp AS far FROM routes JOIN coords a ON src = a.unit JOIN coords b ON dst = b.unit), e AS (SELECT src AS unit, dst AS other, w, 1 AS o, far FROM j UNION ALL SELECT dst, src, w, 0, far FROM j)
SELECT unit, sum(w * o)::BIGINT AS flow_out, sum(w * (1 - o))::BIGINT AS flow_in, count(DISTINCT other) AS partners, round(sum(CASE WHEN far THEN w ELSE 0 END) / sum(w), 6) AS far_share FROM e GROUP BY 1""")
def e14_node_features(spark, sf):
    return r(S.node_features(V.routes(spark, sf), V.coords(spark, sf)), "far_share")


_POINTS = """points AS (SELECT s_suppkey AS point, ((s_suppkey * 53) % 121 - 60)::DOUBLE AS lat, ((s_suppkey * 91) % 351 - 175)::DOUBLE AS lon, CASE WHEN s_suppkey % 4 = 0 THEN n_name ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"""WITH {V.COORDS}, {_POINTS}, c AS (SELECT coords.*, n_name AS name FROM coords JOIN nation ON unit = n_nationkey),
m AS (SELECT point, unit, 0 AS how, 0.0 AS km FROM points JOIN c ON lower(points.name) = lower(c.name) UNION ALL SELECT a.point, b.unit, 1, {_KM} FROM points a JOIN c b ON {_KM} <= 2000)
SELECT point, unit, how, round(km, 4) AS km FROM m QUALIFY row_number() OVER (PARTITION BY point ORDER BY how, km, unit) = 1""")
def e15_assign_nearest(spark, sf):
    n, s = V.table(spark, sf, "nation"), V.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    points = s.join(n, s.s_nationkey == n.n_nationkey).select(k.alias("point"), ((k * 53) % 121 - 60).cast("double").alias("lat"), ((k * 91) % 351 - 175).cast("double").alias("lon"), F.when(k % 4 == 0, F.col("n_name")).otherwise(F.col("s_name")).alias("name"))
    places = V.coords(spark, sf).join(n.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name")), "unit")
    return r(S.assign_nearest(points, places, 2000.0), "km", digits=4)


@query("""WITH l AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS b FROM customer), x AS (SELECT s_suppkey AS other_id, s_name AS other, s_nationkey AS b FROM supplier),
s AS (SELECT id, other_id, 1 - levenshtein(name, other) / greatest(length(name), length(other)) AS ratio FROM l JOIN x USING (b))
SELECT id, other_id, round(ratio, 6) AS ratio, round(ratio - lead(ratio) OVER w, 6) AS ahead FROM s WINDOW w AS (PARTITION BY id ORDER BY ratio DESC, other_id) QUALIFY row_number() OVER w = 1""")
def e16_fuzzy_match(spark, sf):
    left = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("b"))
    right = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("b"))
    return r(S.fuzzy_match(left, right, "b"), "ratio", "ahead")


@query("""WITH p AS (SELECT c_custkey AS point, (c_custkey * 7 % 100) / 10.0::DOUBLE + 0.01 AS x, (c_custkey * 13 % 100) / 10.0::DOUBLE + 0.05 AS y FROM customer), g AS (SELECT r_regionkey AS polygon, r_regionkey * 1.5::DOUBLE AS o FROM region)
SELECT point, polygon FROM p JOIN g ON x > o AND y > 0 AND x - o < 3 AND y < 3 * (x - o)""")
def e17_in_polygon(spark, sf):
    k = F.col("c_custkey")
    points = V.table(spark, sf, "customer").select(k.alias("point"), ((k * 7 % 100) / 10.0 + 0.01).alias("x"), ((k * 13 % 100) / 10.0 + 0.05).alias("y"))
    o = F.col("r_regionkey") * 1.5
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    polygons = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("polygon"), F.array(corner(o, 0.0), corner(o + 3, 0.0), corner(o + 3, 9.0)).alias("corners"))
    return S.in_polygon(points, polygons)


@query(f"""WITH w AS (SELECT o_custkey AS unit, l_orderkey AS way, l_linenumber AS pos, l_suppkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT s_suppkey AS node, ((s_suppkey * 53) % 121 - 60)::DOUBLE AS lat, ((s_suppkey * 91) % 351 - 175)::DOUBLE AS lon FROM supplier),
a AS (SELECT unit, way, pos, node, lat, lon, lead(node) OVER o AS nxt, lead(lat) OVER o AS lat2, lead(lon) OVER o AS lon2 FROM w JOIN n USING (node) WINDOW o AS (PARTITION BY unit, way ORDER BY pos, node)),
s AS (SELECT * FROM a WHERE nxt IS NOT NULL), d AS (SELECT unit, node, count(*) AS c FROM (SELECT unit, node FROM s UNION ALL SELECT unit, nxt FROM s) GROUP BY ALL)
SELECT s.unit, round(sum({KM.format(a="lat", b="lon", c="lat2", d="lon2")}), 3) AS km, count(DISTINCT way) AS ways, any_value(x.c) AS crossings FROM s JOIN (SELECT unit, sum((c >= 3)::INT)::BIGINT AS c FROM d GROUP BY 1) x ON s.unit = x.unit GROUP BY s.unit""")
def e18_way_metrics(spark, sf):
    k = F.col("s_suppkey")
    nodes = V.table(spark, sf, "supplier").select(k.alias("node"), ((k * 53) % 121 - 60).cast("double").alias("lat"), ((k * 91) % 351 - 175).cast("double").alias("lon"))
    li, o = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    n = li.count()
    ways = spread(li, n, "l_orderkey").join(spread(o, n, "o_orderkey"), li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("unit"), F.col("l_orderkey").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("nodes"))
    return r(S.way_metrics(ways, nodes), "km", digits=3)


@query(f"""WITH {V.PLACES} SELECT unit, place::INT AS place, lat + a * 0.25 AS lat, lon + b * 0.25 AS lon FROM coords, (VALUES (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)) o(place, a, b)""")
def e19_sample_points(spark, sf):
    return S.sample_points(V.places(spark, sf), 0.25)


@query(f"WITH {PAIRS}, {PANEL_NK} SELECT unit, t, qty FROM np WHERE unit IN (SELECT src FROM near GROUP BY 1 HAVING count(*) >= 4)")
def e20_with_degree(spark, sf):
    return S.with_degree(_panel(spark, sf), _near(spark, sf), 4)


@query("""SELECT n_name, r_name, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def e1_assembly(spark, sf):
    """N-way left joins; the two fixed dimensions are small enough for Spark to broadcast by itself."""
    o, c, n, g = (V.table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(g, n.n_regionkey == g.r_regionkey, "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), (F.sum(V.cents("o_totalprice")) / 100.0).alias("amount"))
