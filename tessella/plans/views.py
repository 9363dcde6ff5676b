"""Panels over the driver tables, as DataFrames and as DuckDB common table expressions.

Money is summed in whole cents, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


def panel_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, month): unit, grp (region), t (months since 1995), value (order prices), n."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    rows = joined.groupBy(F.col("n_name").alias("unit"), F.col("r_name").alias("grp"), month.alias("t"))
    return rows.agg((F.sum(cents("o_totalprice")) / 100.0).alias("value"), F.count("*").alias("n"))


PANEL_NM = """panel AS (
  SELECT n_name AS unit, r_name AS grp, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t,
         sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS value, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def panel_sy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, ship year): unit, cl (nation key), t (year), value (extended prices), qty, disc (mean discount), n."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    joined = li.join(s, li.l_suppkey == s.s_suppkey)
    rows = joined.groupBy(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("cl"), F.year("l_shipdate").alias("t"))
    return rows.agg(
        (F.sum(cents("l_extendedprice")) / 100.0).alias("value"), F.sum(F.round("l_quantity").cast("long")).alias("qty"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100.0).alias("disc"), F.count("*").alias("n"),
    )


PANEL_SY = """panel AS (
  SELECT s_suppkey AS unit, s_nationkey AS cl, year(l_shipdate)::INT AS t, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0 AS value,
         sum(round(l_quantity)::BIGINT)::BIGINT AS qty, sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) / 100.0 AS disc, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def panel_ud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, day): unit, t (days since 1970), value (sum of values, to the cent), n, kinds."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.col("user_id").alias("unit"), F.unix_date(F.col("ts").cast("date")).alias("t"))
    return rows.agg((F.sum(cents("value")) / 100.0).alias("value"), F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


PANEL_UD = """panel AS (
  SELECT user_id AS unit, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS t, sum(round(value * 100)::BIGINT)::DOUBLE / 100.0 AS value,
         count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, grp (lang), y (quality), p (a squashed length), q (another score)."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars").cast("double")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.col("quality").alias("y"), (n / (n + 1500)).alias("p"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("q"), "toxic")


SCORES = """scores AS (
  SELECT doc_id AS id, lang AS grp, quality AS y, n_chars::DOUBLE / (n_chars::DOUBLE + 1500) AS p, (doc_id * 37 % 101) / 100.0::DOUBLE AS q, toxic
  FROM documents JOIN labels USING (doc_id))"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval events: urgent orders of more than 300,000: event, cl (nation key), start_t, end_t (months since 1995), intensity, kind (status)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    start = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    rows = o.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("o_orderkey").alias("event"), F.col("c_nationkey").alias("cl"), start.alias("start_t"), (start + (F.col("o_orderkey") % 5)).cast("int").alias("end_t"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("intensity"), F.col("o_orderstatus").alias("kind"))


REGISTRY = """registry AS (
  SELECT o_orderkey AS event, c_nationkey AS cl, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS start_t,
         ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 + o_orderkey % 5)::INT AS end_t, least(1.0, o_totalprice / 500000.0) AS intensity, o_orderstatus AS kind
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)"""


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the nations, by arithmetic: unit, grp, lat, lon, mass."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("unit"), F.col("n_regionkey").alias("grp"), ((k * 37) % 121 - 60).cast("double").alias("lat"), ((k * 71) % 351 - 175).cast("double").alias("lon"), (k + 1).cast("double").alias("mass"))


COORDS = """coords AS (
  SELECT n_nationkey AS unit, n_regionkey AS grp, ((n_nationkey * 37) % 121 - 60)::DOUBLE AS lat, ((n_nationkey * 71) % 351 - 175)::DOUBLE AS lon, (n_nationkey + 1)::DOUBLE AS mass FROM nation)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the customers, by digests of their keys: unit, grp, lat, lon, mass."""
    c = table(spark, sf_dir, "customer")
    part = lambda i: F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), i, 8), 16, 10).cast("long")
    lat, lon = part(1) % 140_000 / 1000.0 - 70, part(9) % 360_000 / 1000.0 - 180
    return c.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("grp"), lat.alias("lat"), lon.alias("lon"), (F.col("c_custkey") % 17 + 1).cast("double").alias("mass"))


PLACES = """coords AS (
  SELECT c_custkey AS unit, c_nationkey AS grp, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 140000 / 1000.0::DOUBLE - 70 AS lat,
         ('0x' || substr(md5(c_custkey::VARCHAR), 9, 8))::BIGINT % 360000 / 1000.0::DOUBLE - 180 AS lon, (c_custkey % 17 + 1)::DOUBLE AS mass FROM customer)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed network: src (supplier nation), dst (customer nation), w (line items)."""
    li, s, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "supplier", "orders", "customer"))
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("w"))


ROUTES = """routes AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def edge_rows(panel: DataFrame, last: bool = True) -> DataFrame:
    """Each unit's last row, or first."""
    order = F.col("t").desc() if last else F.col("t")
    return panel.withColumn("_nr", F.row_number().over(Window.partitionBy("unit").orderBy(order))).filter("_nr = 1").drop("_nr")
