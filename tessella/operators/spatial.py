"""Distances, neighbour graphs and what units get over them.

Graphs are edge tables (src, dst, w). Units are few against periods, but pairs are found
through grid cells, so that no operator compares all units with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import haversine_km
from tessella.sources.tables import Stages, spread

KM_A_DEGREE = 111.19492664455873  # 6371 km * pi / 180
#: For joins of tables with all units, or many rows of each: Spark's size check goes by compressed files and doesn't count the rows that explode makes, and would send them all through the driver.
MERGED = "merge"


def near_pairs(places: DataFrame, radius_km: float) -> DataFrame:
    """(src, dst, km) of different units within ``radius_km``.

    Rows of latitude are ``radius_km`` high and cut into cells as wide, where the row is narrowest, as the largest difference of longitude of such a pair, so pairs
    lie in the same or adjoining rows and cells; the distance decides the rest.
    """
    radius = F.lit(float(radius_km))
    a = _around(places.select(F.col("unit").alias("src"), F.col("lat").alias("a"), F.col("lon").alias("b")), "a", "b", radius)
    b = _cell_of(places.select(F.col("unit").alias("dst"), F.col("lat").alias("c"), F.col("lon").alias("d")), "c", "d", radius)
    km = haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return a.join(b.hint(MERGED), ["band", "cell"]).filter("src <> dst").select("src", "dst", km.alias("km")).filter(F.col("km") <= radius_km)


def _cell_of(df: DataFrame, lat: str, lon: str, radius: Column) -> DataFrame:
    """``df`` with the band (row of latitude) and cell of its place."""
    d = df.withColumn("band", F.floor(F.col(lat) / (radius / KM_A_DEGREE)))
    n = _cells(F.col("band"), radius)
    return d.withColumn("cell", F.pmod(F.floor((F.col(lon) + 180) / 360 * n), n))


def _around(df: DataFrame, lat: str, lon: str, radius: Column) -> DataFrame:
    """``df`` once for each band and cell that holds places within ``radius``."""
    band = F.floor(F.col(lat) / (radius / KM_A_DEGREE))
    d = df.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("n", _cells(F.col("band"), radius))
    at = F.floor((F.col(lon) + 180) / 360 * F.col("n"))
    return d.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.pmod(at + i, F.col("n")))))).drop("n")


def _cells(band: Column, radius: Column) -> Column:
    """The number of cells of a row of latitude: 1 near the poles, and where there would be under three."""
    high = radius / KM_A_DEGREE
    widest = F.least(F.lit(89.9), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * high)
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(radius / 2 / 6371.0) / F.cos(F.radians(widest)))))
    n = F.floor(360 / reach)
    return F.when(n >= 3, n).otherwise(F.lit(1).cast("long"))


#: Radii are halved so often at most: down to 1 / 4,096 of the largest.
HALVINGS = 12


def _radius_at(level: Column, most_km: float) -> Column:
    return F.lit(float(most_km)) / F.pow(F.lit(2.0), level)


def _searches(places: DataFrame, most_km: float, k: int, floor_km: float, group: list[str]) -> DataFrame:
    """``places`` with the level of radius (0: ``most_km``, halved at each next one) that is sure to hold its ``k`` best others, by sqrt of the masses' product over the distance (``floor_km`` at least).

    At each level places are put into squares whose diagonal is within the radius. Where the square of a place holds more than ``k`` of its group, the k + 1st mass bounds its
    k-th best score from below, and this and the group's largest mass the distance of all that may score as well. The level of the least such distance is taken; places
    without one, or whose own mass is not above 0, search ``most_km``. ``places``: unit, lat, lon, mass and ``group``; masses are not negative.
    """
    levels = places.select("unit", "lat", "lon", "mass", *group, F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("level"))
    radius = _radius_at(F.col("level"), most_km)
    side = 0.999 * 2**0.5 * F.sin(F.least(radius / 2 / 6371.0, F.lit(1.5707963))) * 6371.0 / KM_A_DEGREE  # degrees of latitude
    row = F.floor(F.col("lat") / side)
    nearest = F.least(F.abs(row), F.abs(row + 1)) * side  # to the equator, where the row is widest
    across = F.greatest(F.lit(1.0), F.ceil(360 * F.cos(F.radians(F.least(nearest, F.lit(90.0)))) / side))
    keyed = levels.withColumn("_row", row).withColumn("_square", F.floor((F.col("lon") + 180) / 360 * across))
    square = ["level", *group, "_row", "_square"]
    place = F.row_number().over(Window.partitionBy(*square).orderBy(F.col("mass").desc_nulls_last()))
    full = keyed.filter("mass > 0").withColumn("_p", place).filter(F.col("_p") <= k + 1).filter(F.col("_p") == k + 1).select(*square, F.col("mass").alias("_kth"))
    top = places.groupBy(*group).agg(F.max("mass").alias("_top"))
    full = full.join(top, group) if group else full.crossJoin(top)
    bound = F.greatest(radius, F.lit(float(floor_km)))
    full = full.withColumn("_reach", F.when((F.col("_top") == F.col("_kth")) & (radius > floor_km * 1.01), radius).otherwise(1.0001 * bound * F.sqrt(F.col("_top") / F.col("_kth"))))
    found = keyed.filter("mass > 0").join(full.hint(MERGED), square).groupBy("unit").agg(F.min("_reach").alias("_reach"))
    level = sum((F.coalesce((F.lit(most_km / 2.0**i) >= F.col("_reach")).cast("int"), F.lit(0)) for i in range(1, HALVINGS + 1)), F.lit(0))
    return places.join(found, "unit", "left").withColumn("level", level).drop("_reach")


def _searched_pairs(searches: DataFrame, most_km: float, group: list[str], kept: DataFrame) -> DataFrame:
    """(src, dst, km, ms, md): pairs of each place of ``searches`` with those of ``kept`` within its level's radius."""
    radius = _radius_at(F.col("level"), most_km)
    a = _around(searches.select(F.col("unit").alias("src"), F.col("lat").alias("a"), F.col("lon").alias("b"), F.col("mass").alias("ms"), *group, "level"), "a", "b", radius)
    used = searches.select("level").distinct()
    b = kept.select(F.col("unit").alias("dst"), F.col("lat").alias("c"), F.col("lon").alias("d"), F.col("mass").alias("md"), *group).crossJoin(F.broadcast(used))  # at most 13 levels
    b = _cell_of(b, "c", "d", radius)
    km = haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    met = a.join(b.hint(MERGED), ["level", "band", "cell", *group]).filter("src <> dst").select("src", "dst", km.alias("km"), "ms", "md", "level")
    return met.filter(F.col("km") <= F.when(F.col("level") == 0, F.lit(float(most_km))).otherwise(radius)).drop("level")


def nearest_units(places: DataFrame, radius_km: float, k: int) -> DataFrame:
    """(src, dst, km, rank): each unit's ``k`` nearest others within ``radius_km``, ties to the smaller one.

    Every unit searches a radius by the density around it, so the pairs grow as the units. Of the units at one place the first k + 1 are enough to be found.
    """
    p = places.select("unit", "lat", "lon", F.lit(1.0).alias("mass"))
    kept = p.withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("unit"))).filter(F.col("_n") <= k + 1).drop("_n")
    pairs = _searched_pairs(_searches(p, radius_km, k, 0.0, []), radius_km, [], kept)
    return nearest_edges(pairs.select("src", "dst", "km"), k)


def segment_km(lat: Column, lon: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Distance from points to a segment, on the plane tangent at its first end."""
    import math

    kx = KM_A_DEGREE * math.cos(math.radians(a[0]))
    dx, dy = (b[1] - a[1]) * kx, (b[0] - a[0]) * KM_A_DEGREE
    x, y = (lon - a[1]) * kx, (lat - a[0]) * KM_A_DEGREE
    along = F.least(F.greatest((x * dx + y * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - along * dx, F.lit(2)) + F.pow(y - along * dy, F.lit(2)))


def nearest_edges(pairs: DataFrame, k: int) -> DataFrame:
    """Each source's ``k`` nearest of its pairs, ties to the smaller destination."""
    order = Window.partitionBy("src").orderBy("km", "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def standardised(edges: DataFrame, weight: Column, *order: str) -> DataFrame:
    """The weights over their sum for each source, added up in ``order`` (as the rows come, if none is named)."""
    w, over = edges.withColumn("w", weight), Window.partitionBy("src")
    if order:
        over = over.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w.withColumn("w", F.col("w") / F.nullif(F.sum("w").over(over), F.lit(0.0)))


def inverse_distance(edges: DataFrame, floor_km: float = 1.0) -> DataFrame:
    return standardised(edges, 1 / F.greatest(F.col("km"), F.lit(floor_km)))


def similarity_weights(edges: DataFrame, units: DataFrame, value: str, floor: float) -> DataFrame:
    """1 / the gap of two units' values, at least ``floor``, adding to 1 for each source; added up by km (where ``edges`` has it) and destination, so that reruns agree to the last digit."""
    v = units.select("unit", F.col(value).alias("v"))
    of = lambda end, name: v.select(F.col("unit").alias(end), F.col("v").alias(name)).hint(MERGED)
    both = edges.join(of("src", "vs"), "src").join(of("dst", "vd"), "dst")
    return standardised(both, 1 / F.greatest(F.abs(F.col("vs") - F.col("vd")), F.lit(floor)), *[c for c in ("km", "dst") if c in edges.columns]).select("src", "dst", "w")


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.col("w").desc(), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def accessibility(edges: DataFrame, panel: DataFrame, value: str) -> DataFrame:
    """Sum of neighbours' values over their distance (1 km at least), by unit and period."""
    p = panel.select(F.col("unit").alias("dst"), "t", F.col(value).alias("v"))
    return edges.join(p, "dst").groupBy(F.col("src").alias("unit"), "t").agg(F.sum(F.col("v") / F.greatest(F.col("km"), F.lit(1.0))).alias("access"))


def spatial_lag(edges: DataFrame, panel: DataFrame, value: str) -> DataFrame:
    """Weighted mean of the neighbours that have the period; the period's median where none has."""
    p = panel.select(F.col("unit").alias("dst"), "t", F.col(value).alias("v"))
    lag = edges.join(p, "dst").groupBy(F.col("src").alias("unit"), "t").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_lag"))
    medians = panel.groupBy("t").agg(F.percentile(value, 0.5).alias("_m"))
    return panel.join(lag, ["unit", "t"], "left").join(medians, "t").select("unit", "t", F.coalesce("_lag", "_m").alias("spatial_lag"))


def neighbour_exposure(edges: DataFrame, panel: DataFrame, value: str, lag: int = 1) -> DataFrame:
    """Mean of the neighbours' values ``lag`` periods earlier (later, if negative)."""
    p = panel.select(F.col("unit").alias("dst"), (F.col("t") + lag).alias("t"), F.col(value).alias("v"))
    seen = edges.join(p, "dst").groupBy(F.col("src").alias("unit"), "t").agg(F.avg("v").alias("exposure"), F.count("*").alias("neighbours"))
    return panel.select("unit", "t").join(seen, ["unit", "t"], "left")


def spillover_features(edges: DataFrame, panel: DataFrame, value: str) -> DataFrame:
    """The neighbours' mean, the unit's gap to it, and the mean's change."""
    p = panel.select(F.col("unit").alias("dst"), "t", F.col(value).alias("v"))
    mean = edges.join(p, "dst").groupBy(F.col("src").alias("unit"), "t").agg(F.avg("v").alias("mean"))
    joined = panel.select("unit", "t", F.col(value).alias("v")).join(mean, ["unit", "t"], "left")
    return joined.select("unit", "t", "mean", (F.col("v") - F.col("mean")).alias("gap"), (F.col("mean") - F.lag("mean").over(Window.partitionBy("unit").orderBy("t"))).alias("delta"))


def route_weights(routes: DataFrame, k: int) -> DataFrame:
    """Routes added up, loops left out, the ``k`` strongest of each source, adding to 1."""
    summed = routes.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return standardised(top_edges(summed, k), F.col("w").cast("double")).select("src", "dst", "rank", "w")


def proxy_access(places: DataFrame, max_km: float, k: int) -> DataFrame:
    """Same group, within ``max_km``: sqrt of the masses' product over the distance (25 km at least), the ``k`` strongest, adding to 1. Masses are not negative.

    Every unit searches a radius by the masses around it. Of a group's units at one place the first k + 1 by mass are enough to be found (and by unit, for where masses don't count).
    """
    p = places.select("unit", "lat", "lon", "mass", "grp").filter("grp IS NOT NULL")
    same = Window.partitionBy("grp", "lat", "lon")
    first = F.least(F.row_number().over(same.orderBy(F.col("mass").desc_nulls_last(), "unit")), F.row_number().over(same.orderBy("unit")))
    pairs = _searched_pairs(_searches(p, max_km, k, 25.0, ["grp"]), max_km, ["grp"], p.withColumn("_n", first).filter(F.col("_n") <= k + 1).drop("_n"))
    scored = pairs.withColumn("w", F.sqrt(F.col("ms") * F.col("md")) / F.greatest(F.col("km"), F.lit(25.0)))
    return standardised(top_edges(scored, k), F.col("w")).select("src", "dst", "rank", "w")


def node_features(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """Per node: flow out and in, different partners, share of the flow that crosses groups."""
    g = groups.select("unit", "grp")
    r = routes.join(g.select(F.col("unit").alias("src"), F.col("grp").alias("gs")), "src").join(g.select(F.col("unit").alias("dst"), F.col("grp").alias("gd")), "dst")
    ends = r.select(F.col("src").alias("unit"), F.col("dst").alias("other"), "w", F.lit(1).alias("out"), (F.col("gs") != F.col("gd")).alias("far"))
    ends = ends.union(r.select(F.col("dst"), F.col("src"), "w", F.lit(0), F.col("gs") != F.col("gd")))
    return ends.groupBy("unit").agg(F.sum(F.col("w") * F.col("out")).alias("flow_out"), F.sum(F.col("w") * (1 - F.col("out"))).alias("flow_in"), F.countDistinct("other").alias("partners"), (F.sum(F.when(F.col("far"), F.col("w")).otherwise(0)) / F.sum("w")).alias("far_share"))


def assign_nearest(points: DataFrame, places: DataFrame, max_km: float) -> DataFrame:
    """Each point's unit: by equal name first, else the nearest within ``max_km``; ties to the smaller unit."""
    band = F.floor(F.col("lat") / (max_km / KM_A_DEGREE))
    named = points.join(places.select("unit", F.lower("name").alias("k")), F.lower(points["name"]) == F.col("k")).select("point", "unit", F.lit(0).alias("how"), F.lit(0.0).alias("km"))
    p = points.select("point", F.col("lat").alias("a"), F.col("lon").alias("b"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    u = places.select("unit", F.col("lat").alias("c"), F.col("lon").alias("d"), band.alias("band"))
    near = p.join(u, "band").select("point", "unit", F.lit(1).alias("how"), haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).filter(F.col("km") <= max_km)
    order = Window.partitionBy("point").orderBy("how", "km", "unit")
    return named.union(near).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def fuzzy_match(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """Best name of the same block by Levenshtein ratio, with the second best's distance behind it; ties to the smaller id. Ids of ``left`` are unique.

    Pairs of a block are compared in tiles of some 2,048 by 4,096 names, and each tile gives a name's two best, so blocks of any size are spread over tasks.
    """
    sizes = lambda df, n: df.groupBy(F.col(block).alias("_b")).agg(F.ceil(F.count("*") / n).cast("int").alias("_parts"))
    lefts, rights = sizes(left, 2048).withColumnRenamed("_parts", "_lefts"), sizes(right, 4096).withColumnRenamed("_parts", "_rights")
    tiles = lefts.join(rights, "_b")
    dealt = lambda df, own, other, part, copy: df.select("id", "name", F.col(block).alias("_b")).join(tiles, "_b").select(
        "id", "name", "_b", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(part), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(copy))
    a = dealt(left, "_lefts", "_rights", "_l", "_r").groupBy("_b", "_l", "_r")
    b = dealt(right, "_rights", "_lefts", "_r", "_l").groupBy("_b", "_l", "_r")
    kinds = f"id {left.schema['id'].dataType.simpleString()}, other_id {right.schema['id'].dataType.simpleString()}, ratio double"
    scored = a.cogroup(b).applyInArrow(_two_best(), kinds)
    order = Window.partitionBy("id").orderBy(F.col("ratio").desc_nulls_last(), "other_id")
    return scored.select("id", "other_id", "ratio", (F.col("ratio") - F.lead("ratio").over(order)).alias("ahead"), F.row_number().over(order).alias("_r")).filter("_r = 1").drop("_r")


def _two_best():
    """The function of a tile. Inner functions travel to tasks by themselves, so executors need no copy of this package."""

    def distances(names, others, batch: int = 32):
        """(start, matrix) of the Levenshtein distances of ``batch`` names at a time to all others: Myers' bit vectors in words of 63 code points, one step for each different beginning of the others."""
        import numpy as np

        texts = [x or "" for x in others]
        firsts, levels = np.zeros(len(texts), int), []  # each level: the last characters of the different beginnings, and where each continues
        ends = [(0, 0)] * len(texts)
        for depth in range(1, max(map(len, texts), default=0) + 1):
            known, parents, letters = {}, [], []
            for i, x in enumerate(texts):
                if len(x) >= depth:
                    key = (int(firsts[i]), x[depth - 1])
                    if key not in known:
                        known[key] = len(known)
                        parents.append(key[0])
                        letters.append(key[1])
                    firsts[i] = known[key]
                    ends[i] = (depth, known[key])
            levels.append((np.array(parents), letters))
        depth_of, node_of = (np.array([e[k] for e in ends], int) for k in (0, 1))
        one, full = np.uint64(1), np.uint64((1 << 63) - 1)
        for start in range(0, len(names), batch):
            part = [x or "" for x in names[start : start + batch]]
            words = max(1, max((len(x) + 62) // 63 for x in part))
            size = np.array([len(x) for x in part], np.int64)
            alphabet = {c: i for i, c in enumerate(sorted(set("".join(part))))}
            peq = np.zeros((words, len(part), len(alphabet) + 1), np.uint64)  # the last column: letters of no name
            for i, x in enumerate(part):
                for j, c in enumerate(x):
                    peq[j // 63, i, alphabet[c]] |= one << np.uint64(j % 63)
            last_word, last_bit = np.maximum(size - 1, 0) // 63, (np.maximum(size - 1, 0) % 63).astype(np.uint64)[:, None]
            out = np.empty((len(part), len(texts)), np.int64)
            out[:, depth_of == 0] = size[:, None]
            plus, minus = [np.full((len(part), 1), full) for _ in range(words)], [np.zeros((len(part), 1), np.uint64) for _ in range(words)]
            score = size[:, None]
            for depth, (parents, letters) in enumerate(levels, 1):
                column = np.array([alphabet.get(c, len(alphabet)) for c in letters])
                score = score[:, parents]
                carry_plus, carry_minus = one, np.uint64(0)  # the first row grows by one with each letter
                for w in range(words):
                    pv, mv, eq = plus[w][:, parents], minus[w][:, parents], peq[w][:, column]
                    xv = eq | mv
                    eq = eq | carry_minus
                    xh = ((((eq & pv) + pv) ^ pv) | eq) & full
                    ph, mh = (mv | ~(xh | pv)) & full, pv & xh
                    own = (last_word == w)[:, None]
                    if own.any():
                        score = score + np.where(own, ((ph >> last_bit) & one).astype(np.int64) - ((mh >> last_bit) & one).astype(np.int64), 0)
                    next_plus, next_minus = (ph >> np.uint64(62)) & one, (mh >> np.uint64(62)) & one
                    ph, mh = ((ph << one) | carry_plus) & full, ((mh << one) | carry_minus) & full
                    plus[w], minus[w] = (mh | ~(xv | ph)) & full, ph & xv
                    carry_plus, carry_minus = next_plus, next_minus
                done = depth_of == depth
                out[:, done] = score[:, node_of[done]]
            empty = size == 0
            out[empty] = np.array([len(x) for x in texts])
            yield start, out

    def two_best(left, right):
        """(id, other_id, ratio) of each left name's two best right ones of a tile; a null ratio where a name is null or both are empty."""
        import numpy as np
        import pyarrow as pa

        right = right.sort_by("id")  # so the first of equal ratios has the smallest id
        names, others = left["name"].to_pylist(), right["name"].to_pylist()
        met = distances(names, others)
        lengths, other_lengths = (np.array([0 if x is None else len(x) for x in y], float) for y in (names, others))
        missing = np.array([x is None for x in others], bool)
        rows, found, ratios = [], [], []
        for start, d in met:
            longest = np.maximum(lengths[start : start + len(d), None], other_lengths)
            unknown = missing | (longest == 0) | np.array([x is None for x in names[start : start + len(d)]], bool)[:, None]
            ratio = np.where(unknown, -1.0, 1 - d / np.where(longest == 0, 1, longest))  # ratios are not negative
            for _ in range(min(2, len(others))):
                at = ratio.argmax(1)
                best = ratio[np.arange(len(d)), at]
                rows.append(np.arange(start, start + len(d)))
                found.append(at)
                ratios.append(best)
                ratio[np.arange(len(d)), at] = -2.0
        if not rows:
            return pa.table({"id": left["id"].slice(0, 0), "other_id": right["id"].slice(0, 0), "ratio": pa.array([], pa.float64())})
        rows, found, ratios = map(np.concatenate, (rows, found, ratios))
        return pa.table({"id": left["id"].take(pa.array(rows)), "other_id": right["id"].take(pa.array(found)), "ratio": pa.array(ratios, mask=ratios < 0)})

    return two_best


def in_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point, polygon): even-odd rule over each polygon's corner array [(x, y)], inside its bounding box. Unit cells of the box's x range join first."""
    p = polygons.select("polygon", "corners", F.array_min(F.transform("corners", lambda c: c["x"])).alias("x0"), F.array_max(F.transform("corners", lambda c: c["x"])).alias("x1"))
    cells = p.select("*", F.explode(F.sequence(F.floor("x0"), F.floor("x1"))).alias("cell"))
    met = points.withColumn("cell", F.floor("x")).join(cells, "cell").filter("x BETWEEN x0 AND x1")
    n = F.size("corners")
    crossings = F.expr("""aggregate(sequence(0, size(corners) - 1), 0, (a, i) -> a + CASE WHEN (corners[i].y > y) <> (corners[(i + 1) % size(corners)].y > y)
        AND x < (corners[(i + 1) % size(corners)].x - corners[i].x) * (y - corners[i].y) / nullif(corners[(i + 1) % size(corners)].y - corners[i].y, 0) + corners[i].x THEN 1 ELSE 0 END)""")
    return met.filter((n > 2) & (crossings % 2 == 1)).select("point", "polygon")


def way_metrics(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per unit of ways (unit, way, nodes): length in km, and nodes on three or more segment ends."""
    ways = Stages(ways.sparkSession, "ways").cut(ways, "ways")
    n = ways.agg(F.sum(F.greatest(F.size("nodes"), F.lit(0)))).first()[0] or 0
    steps = spread(ways.select("unit", "way", F.posexplode("nodes").alias("pos", "node")), n, "node").join(nodes, "node")
    steps = spread(steps, n, "unit", "way")
    own = Window.partitionBy("unit", "way").orderBy("pos")
    seg = steps.select("unit", "way", "node", F.lead("node").over(own).alias("to"), haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(own), F.lead("lon").over(own)).alias("km")).filter("to IS NOT NULL")
    length = seg.groupBy("unit", "way").agg(F.sum("km").alias("km")).groupBy("unit").agg(F.sum("km").alias("km"), F.count("way").alias("ways"))
    degree = spread(seg.select("unit", F.explode(F.array("node", "to")).alias("node")), 2 * n, "unit", "node").groupBy("unit", "node").count()
    crossings = degree.groupBy("unit").agg(F.sum((F.col("count") >= 3).cast("long")).alias("crossings"))
    return length.join(crossings, "unit")


def sample_points(places: DataFrame, step: float) -> DataFrame:
    """Five points around each unit: its own place and one step to each side."""
    offsets = F.array(*[F.struct(F.lit(a * step).alias("dlat"), F.lit(b * step).alias("dlon")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return places.select("unit", "lat", "lon", F.posexplode(offsets).alias("place", "o")).select("unit", "place", (F.col("lat") + F.col("o.dlat")).alias("lat"), (F.col("lon") + F.col("o.dlon")).alias("lon"))


def with_degree(panel: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Rows of units with ``least`` neighbours or more."""
    return panel.join(edges.groupBy(F.col("src").alias("unit")).count().filter(F.col("count") >= least), "unit", "left_semi")
