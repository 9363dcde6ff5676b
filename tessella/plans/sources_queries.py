"""Queries of the sources, sinks and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r
from tessella.sources import tables as S
from tessella.streaming import monitor


@query("SELECT event_id, CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 THEN value END AS value, try_cast(event_type AS INT) AS kind, CAST(NULL AS INTEGER) AS absent FROM events")
def a1_typed_scan(spark, sf):
    """Events as a delimited file with bad cells, and its typed scan."""
    value = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "NaN").otherwise(F.col("value").cast("string"))
    path = S.scratch(spark, "events-csv")
    V.table(spark, sf, "events").select("event_id", value.alias("value"), F.col("event_type").alias("kind")).write.option("header", True).csv(path)
    return S.read_panel(spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("kind", T.IntegerType()), T.StructField("absent", T.IntegerType())]))


@query("SELECT 'lineitem' AS name, 'parquet' AS kind, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def a4_file_meta(spark, sf):
    named = S.file_meta(V.table(spark, sf, "lineitem").select("l_returnflag", "_metadata"), r"/(\w+)\.(parquet)", ["name", "kind"])
    return named.groupBy("name", "kind", F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query(f"WITH {V.PANEL_SY} SELECT unit, t, qty, n FROM panel WHERE t < 2000")
def a5_table_sink(spark, sf):
    """The panel written with a folder for each period, and an empty table of the same columns, both read back as one."""
    p, path = V.panel_sy(spark, sf).filter("t < 2000").select("unit", "qty", "n", "t"), S.scratch(spark, "sink")
    S.write_table(p, f"{path}/full", ("t",))
    S.write_table(p.limit(0), f"{path}/none")
    return spark.read.parquet(f"{path}/full").unionByName(spark.read.parquet(f"{path}/none")).select("unit", "t", "qty", "n")


@query(f"WITH {V.PANEL_SY} SELECT version, count(*) AS rows, sum(qty)::BIGINT AS qty FROM (SELECT 'v1' AS version, qty FROM panel WHERE t < 1998 UNION ALL SELECT 'v2', qty FROM panel) GROUP BY 1")
def a6_snapshots(spark, sf):
    """Two versions of the panel: the later doesn't touch the earlier."""
    p, path = V.panel_sy(spark, sf), S.scratch(spark, "snapshots")
    S.write_snapshot({"panel": p.filter("t < 1998")}, path, "v1")
    S.write_snapshot({"panel": p}, path, "v2")
    return spark.read.parquet(f"{path}/panel").groupBy("version").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@query(f"WITH {V.PANEL_SY} SELECT run, t, count(*) AS units FROM panel, (SELECT unnest([1, 2])::BIGINT AS run) GROUP BY ALL")
def a7_run_history(spark, sf):
    """Two runs' counts by period, appended to one history of JSON lines."""
    g, path = V.panel_sy(spark, sf).groupBy("t").agg(F.count("*").alias("units")), S.scratch(spark, "history")
    for run in (1, 2):
        S.append_history(g.withColumn("run", F.lit(run).cast("long")), path)
    return spark.read.schema("run long, t int, units long").json(path)


@query("""WITH h AS (SELECT md5(o_custkey || '|' || o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus) AS m FROM orders), s AS (SELECT count(*) AS rows, sum(('0x' || substr(m, 1, 12))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(m, 13, 12))::BIGINT::HUGEINT) AS b FROM h) SELECT rows, sha256(rows || ':' || a || ':' || b) AS signature FROM s""")
def a8_signature(spark, sf):
    return S.signature(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("""WITH g AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT) AS c FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, (c / 100.0)::DOUBLE AS total, round(c / 100.0 / n, 6) AS mean, (c / 100.0 / n >= 50)::INT AS alert FROM g""")
def p5_stream_alerts(spark, sf):
    """The whole table as a stream; finished windows go to files, the last ones when the stream is told that it has ended."""
    path = S.scratch(spark, "alerts")
    monitor.all_windows(monitor.windowed_alerts(monitor.read_events(spark, sf)), path)
    return r(spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", "mean", "alert"), "mean")


@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true)::INT AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, (sum(round(value * 100)::BIGINT) / 100.0)::DOUBLE AS total FROM g GROUP BY user_id, s""")
def p5_stream_sessions(spark, sf):
    """The whole table as a stream, by user and session."""
    path = S.scratch(spark, "sessions")
    monitor.all_windows(monitor.sessions(monitor.read_events(spark, sf)), path)
    return spark.read.parquet(f"{path}/out").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query("WITH h AS (SELECT event_type, round(avg(value), 2) AS high FROM events GROUP BY 1) SELECT event_id, user_id FROM events JOIN h USING (event_type) WHERE value > high")
def p5_stream_limits(spark, sf):
    """Events of the stream above the mean of their type, a static table."""
    path = S.scratch(spark, "limits")
    limits = V.table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("high"))
    monitor.append_to(monitor.with_limits(monitor.read_events(spark, sf), limits).select("event_id", "user_id"), f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query()
def p5_stream_cusum(spark, sf):
    """Alarms of a running sum kept as keyed state; tested against plain Python."""
    path = S.scratch(spark, "cusum")
    monitor.append_to(monitor.cusum_alarms(monitor.read_events(spark, sf).select("user_id", "event_id", "ts", "value"), 50.0, 5.0, 150.0), f"{path}/out", f"{path}/check").awaitTermination()
    return r(spark.read.schema("user_id long, event_id long, ts timestamp, total double").parquet(f"{path}/out").select("user_id", "event_id", "total"), "total", digits=4)


@query("""WITH w AS (SELECT date_trunc('day', ts) - to_days(o) AS start, event_type, value FROM events, (VALUES (0), (1), (2)) v(o))
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, count(*) AS n, (sum(round(value * 100)::BIGINT) / 100.0)::DOUBLE AS total FROM w GROUP BY ALL""")
def p5_stream_sliding(spark, sf):
    """The whole table as a stream, in windows of three days that begin every day."""
    path = S.scratch(spark, "sliding")
    monitor.all_windows(monitor.sliding_alerts(monitor.read_events(spark, sf)), path)
    return spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events")
def p5_stream_dedup(spark, sf):
    """The table delivered twice; each event comes out once."""
    path = S.scratch(spark, "dedup")
    twice = monitor.read_events(spark, sf).union(monitor.read_events(spark, sf))
    once = monitor.deduplicated(twice).select("event_id", "user_id", "event_type", F.round("value", 2).alias("value"))
    monitor.append_to(once, f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.parquet(f"{path}/out")
