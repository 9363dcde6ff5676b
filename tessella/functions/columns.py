"""Column helpers: null-safe arithmetic, window statistics, keyed draws. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a / b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def minmax(x: Column, over: WindowSpec, constant: float = 0.5) -> Column:
    """To 0..1 within the window; ``constant`` where all values are equal."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(x.isNotNull(), F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(constant)))


def zscore(x: Column, over: WindowSpec, population: bool = True) -> Column:
    """Standard score within the window; 0 where the deviation is 0 or undefined."""
    sd = (F.stddev_pop if population else F.stddev_samp)(x).over(over)
    return F.when(x.isNotNull(), F.when(sd > 0, (x - F.avg(x).over(over)) / sd).otherwise(0.0))


def rank_pct(x: Column, part: WindowSpec) -> Column:
    """Average rank over the number of values; nulls stay null. ``part`` is only partitioned."""
    ordered = part.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(0, 0))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(part))


def rolling(fn, x: Column, ordered: WindowSpec, size: int, least: int = 1) -> Column:
    """``fn`` of the last ``size`` rows; null where fewer than ``least`` of them have a value."""
    frame = ordered.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def keyed_draw(*keys: Column) -> Column:
    """A draw from [0, 1) that depends on the keys alone, from the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_edges() -> list[float]:
    """The chances that a Poisson count of mean 1 is 0, at most 1, at most 2 and so on, until the rest is less than a keyed draw can tell (2**-32)."""
    edges, mass, k = [], 0.36787944117144233, 0
    while not edges or 1 - edges[-1] >= 2.0**-32:
        edges.append((edges[-1] if edges else 0.0) + mass)
        k += 1
        mass /= k
    return edges


def poisson_weight(u: Column) -> Column:
    """A Poisson count of mean 1 by a draw from [0, 1)."""
    return sum(((u >= edge).cast("int") for edge in poisson_edges()), F.lit(0))


def numbered(df: DataFrame, draw: Column, tie: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place from 1 on by ``draw`` (in [0, 1)) and ``tie``; places are counted in 256 ranges of the draw and the ranges' counts summed on top.

    The two are merged, as the rows lie by range anyway: where ``df`` has a row for each of many draws, Spark's size check doesn't count them.
    """
    d = df.withColumn("_u", draw).withColumn("_range", F.floor(F.col("_u") * 256).cast("int"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*within, "_range").agg(F.count("*").alias("_n")).select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*within, "_range").orderBy("_u", tie))
    return d.withColumn("_place", place).join(sizes.hint("merge"), [*within, "_range"]).select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def sums_before(df: DataFrame, by: Column, values: list[str], within: tuple[str, ...] = (), ranges: int = 64) -> DataFrame:
    """``df`` with before_<value>: the sum over the rows of smaller ``by`` (rows of equal ``by``, in any order, count too where they come first).

    Rows are dealt into ranges of ``by`` at its approximate quantiles; what is before in the range comes on top of the earlier ranges' sums, so no task sees all rows.
    """
    keyed = df.withColumn("_by", by)
    edges = keyed.agg(F.array_distinct(F.approx_percentile("_by", [i / ranges for i in range(1, ranges)], 1000))).first()[0] or []
    d = keyed.withColumn("_range", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("_by"))) if edges else F.lit(0))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*within, "_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    sums = sums.select(*within, "_range", *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy(*within, "_range").orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{v}") for v in values]).join(sums, [*within, "_range"])
    return d.select(*df.columns, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"before_{v}") for v in values])


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def norm_key(x: Column) -> Column:
    """Lower case without the accents of common Latin letters, & as and, other signs as single spaces."""
    plain = F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), "[^a-z0-9]+", " "))


def kth_value(df: DataFrame, column: str, place: int, most: int = 100_000) -> float:
    """The value at ``place`` (from 0) among the sorted non-null values of a double column.

    Each pass counts 1,024 equal ranges and goes on with the one that holds the place, until ``most`` values are left or all are equal:
    only counts and so many values reach the driver, whatever the size of the table.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    while low < high and n > most:
        width = (high - low) / 1024
        bin_ = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(1023)).cast("int")
        found = sorted(rows.groupBy(bin_.alias("b")).agg(F.count("*"), F.min("x"), F.max("x")).collect())
        for b, size, least, greatest in found:
            if place < size:
                break
            place -= size
        if size == n:  # one range holds all: the values are too close for ranges of equal width
            break
        rows, n, low, high = rows.filter(bin_ == b), size, least, greatest
    return low if low == high else rows.orderBy("x").limit(place + 1).agg(F.max("x")).first()[0]


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = 1_000_000) -> list[float | None]:
    """Interpolated quantiles: by one exact aggregate up to ``most`` rows, beyond that by counting ranges; nulls where there is no value."""
    n = df.agg(F.count(column)).first()[0]
    if n <= most:
        return list(df.agg(F.percentile(column, F.array(*[F.lit(float(q)) for q in shares]))).first()[0] or [None] * len(shares))
    out = []
    for q in shares:
        at = q * (n - 1)
        low = kth_value(df, column, int(at))
        out.append(low if at == int(at) else low + (at - int(at)) * (kth_value(df, column, int(at) + 1) - low))
    return out
