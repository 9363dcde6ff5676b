"""Searches by density and names in tiles give what all pairs give."""

import math
import random
import re

from pyspark.sql import functions as F

from tessella.operators import spatial


def km(a, b):
    (y, x), (v, u) = a, b
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def places(spark):
    """A sparse world with the poles and both sides of 180 degrees, a dense town, forty units at one place, and masses of zero."""
    draw = random.Random(5)
    spots = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(250)] + [(90.0, 0.0), (-90.0, 12.0), (0.0, 179.99), (0.0, -179.99), (0.0, 0.0)]
    spots += [(48 + draw.gauss(0, 0.05), 11 + draw.gauss(0, 0.05)) for _ in range(300)] + [(48.0, 11.0)] * 40
    rows = [(i, i % 3, *spot, float(i * 7 % 11)) for i, spot in enumerate(draw.sample(spots, len(spots)))]
    return rows, spark.createDataFrame(rows, "unit long, grp int, lat double, lon double, mass double")


def test_nearest_units(spark):
    rows, df = places(spark)
    for radius in (30.0, 1000.0, 21000.0):
        got = {(r.src, r["rank"]): r.dst for r in spatial.nearest_units(df, radius, 4).collect()}
        want = {}
        for a in rows:
            near = sorted((d, b[0]) for b in rows if b[0] != a[0] and (d := km(a[2:4], b[2:4])) <= radius)[:4]
            want |= {(a[0], i + 1): unit for i, (_, unit) in enumerate(near)}
        assert got == want


def test_proxy_access_takes_the_strongest_of_all_pairs(spark):
    rows, df = places(spark)
    got = {(r.src, r["rank"]): r.dst for r in spatial.proxy_access(df, 1000.0, 3).collect()}
    want = {}
    for a in rows:
        near = [(-math.sqrt(a[4] * b[4]) / max(d, 25.0), b[0]) for b in rows if b[0] != a[0] and b[1] == a[1] and (d := km(a[2:4], b[2:4])) <= 1000]
        want |= {(a[0], i + 1): unit for i, (_, unit) in enumerate(sorted(near)[:3])}
    assert got == want


def test_dense_places_search_less(spark):
    """At a hundred times the density every unit still meets some dozens of others, not a hundred times as many."""
    for n in (200, 20_000):
        df = spark.range(n).select(F.col("id").alias("unit"), (F.rand(1) * 20).alias("lat"), (F.rand(2) * 20).alias("lon"), F.lit(1.0).alias("mass"))
        met = spatial._searched_pairs(spatial._searches(df, 1000.0, 4, 0.0, []), 1000.0, [], df).count()
        assert met < 120 * n


def broadcast_keys(df):
    """The left keys of the broadcast joins of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return {tuple(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}


def small(spark):
    """Places whose estimated size is far below what Spark broadcasts."""
    return spark.range(500).select(F.col("id").alias("unit"), (F.col("id") % 3).alias("grp"), (F.rand(1) * 20).alias("lat"), (F.rand(2) * 20).alias("lon"), (F.col("id") % 5).cast("double").alias("mass"))


def test_proxy_access_sends_no_rows_of_levels_through_the_driver(spark):
    """Each place is a row for each of 13 levels: these are never a broadcast, whatever Spark's estimate of their size."""
    assert not any("level" in keys for keys in broadcast_keys(spatial.proxy_access(small(spark), 1000.0, 3)))


def test_nearest_units_send_no_rows_of_levels_through_the_driver(spark):
    assert not any("level" in keys for keys in broadcast_keys(spatial.nearest_units(small(spark), 1000.0, 4)))


def test_inverse_distance_sends_no_rows_of_levels_through_the_driver(spark):
    assert not any("level" in keys for keys in broadcast_keys(spatial.inverse_distance(spatial.nearest_units(small(spark), 1000.0, 4))))


def test_similarity_weights_send_no_units_through_the_driver(spark):
    """Neither the rows of levels nor the units' values, however small Spark thinks they are."""
    df = small(spark)
    keys = broadcast_keys(spatial.similarity_weights(spatial.nearest_units(df, 1000.0, 4).select("src", "dst"), df, "mass", 2.0))
    assert not any({"level", "src", "dst"} & set(k) for k in keys)


def test_similarity_weights_do_not_depend_on_the_order_of_edges(spark):
    """To the last bit: 35 / 128 is half way between two numbers of six digits."""
    units = spark.createDataFrame([(i, float(i % 17 + 1)) for i in range(200)], "unit long, mass double")
    edges = [(i, (i * 7 + j * 31 + 1) % 200, float(j)) for i in range(200) for j in range(6)]
    got = []
    for rows in (edges, edges[::-1], random.Random(2).sample(edges, len(edges))):
        df = spark.createDataFrame(rows, "src long, dst long, km double")
        got.append(sorted(map(tuple, spatial.similarity_weights(df, units, "mass", 2.0).collect())))
    assert got[0] == got[1] == got[2]


def test_fuzzy_match(spark):
    """Against the built-in distance on all pairs: ties, nulls, empty and long names, letters beyond the basic plane, and more than one tile on both sides."""
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcé\U0001f600 ") for _ in range(n))
    some = [word(draw.choice([0, 1, 3, 8, 20])) for _ in range(60)] + [word(n) for n in (62, 63, 64, 65, 126, 127, 140)] + [None]
    left = [(i, draw.choice(some), i % 3) for i in range(300)] + [(10_000 + i, f"C#{i}", 7) for i in range(2100)] + [(20_000, "alone", 9), (20_001, "one", 11), (20_002, None, 7)]
    right = [(i, draw.choice(some), i % 3) for i in range(200, 0, -1)] + [(30_000 + i, f"S#{i}", 7) for i in range(4200)] + [(1, "once", 11)]
    schema = "id long, name string, b int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r.id: (r.other_id, r.ratio, r.ahead) for r in spatial.fuzzy_match(a, b, "b").collect()}
    some_left = a.filter("id < 300 OR id % 100 = 1 OR id >= 20000")  # the plain way is slow
    pairs = some_left.join(b.select(F.col("id").alias("other_id"), F.col("name").alias("other"), "b"), "b")
    longest = F.nullif(F.greatest(F.length("name"), F.length("other")), F.lit(0))
    best = pairs.withColumn("ratio", F.when(F.col("name").isNotNull() & F.col("other").isNotNull(), 1 - F.levenshtein("name", "other") / longest))
    want = {}
    for r in best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("ratio", F.lit(-1.0))).alias("n"), "other_id", "ratio"))), 1, 2).alias("two")).collect():
        two = r.two
        want[r.id] = (two[0].other_id, two[0].ratio, two[0].ratio - two[1].ratio if len(two) > 1 and two[0].ratio is not None and two[1].ratio is not None else None)
    assert len(got) == len(left) - 1 and {k: got[k] for k in want} == want
