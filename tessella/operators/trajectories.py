"""Groups of units by the course of their values: warped distances to medoids of a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.imputation import interpolate

#: Share of a sequence's length by which a path may leave the diagonal.
BAND = 0.4
#: Units that medoids are chosen from; more are drawn by hash.
MOST = 512
#: Numbers in a table of warped distances, at most.
TABLE = 1 << 21
#: Units, at least, for which there are regimes.
LEAST = 8
#: Names of regimes, the best first; fixed values.
REGIMES = ["persistent_accelerator", "late_takeoff", "stable_mature", "volatile_rebound", "stalling_plateau", "structural_decline"]
#: What a regime is ordered by: weights of its units' mean slope, last value, deviation of growth and last risk, as scores over regimes; fixed values.
ORDER = {"slope": 1.20, "last": 0.55, "deviation": -0.90, "risk": -0.95}


def band(length: int) -> int:
    return max(1, round(length * BAND))


def periods_of(panel: DataFrame) -> list:
    """The panel's periods: as many as the calendar has."""
    return [r.t for r in panel.select("t").distinct().orderBy("t").collect()]


def sequences(panel: DataFrame, value: str = "value") -> DataFrame:
    """(unit, seq): the unit's means by period, interpolated and carried to both ends, less the first, over their deviation; .72 of these levels and .28 of their changes.

    Constant units have zeros; units without any value are left out.
    """
    times = F.array(*[F.lit(t) for t in periods_of(panel)])
    cells = panel.filter(F.col(value).isNotNull()).groupBy("unit", "t").agg(F.avg(value).alias("v"))
    known = cells.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    grid = known.select("unit", F.explode(times).alias("t"), "m").select("unit", "t", F.expr("try_element_at(m, t)").alias("v"))
    filled = interpolate(grid, "v", "unit", "t", edges=True).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", "filled"))).alias("s"))
    level = filled.select("unit", F.expr("transform(s, x -> x.filled - s[0].filled)").alias("y"))
    level = level.withColumn("mean", F.expr("aggregate(y, 0D, (a, x) -> a + x) / size(y)"))
    level = level.withColumn("sd", F.expr("sqrt(aggregate(y, 0D, (a, x) -> a + (x - mean) * (x - mean)) / size(y))"))
    level = level.select("unit", F.expr("transform(y, x -> x / CASE WHEN sd <= 1e-8 THEN 1D ELSE sd END)").alias("y"))
    return level.select("unit", F.expr("transform(y, (x, i) -> 0.72D * x + 0.28D * CASE WHEN i = 0 THEN 0D ELSE x - y[i - 1] END)").alias("seq"))


def warped(x: np.ndarray, m: np.ndarray, window: int, lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """Warped distances between each row's and each medoid's first ``p`` values, for each p of ``lengths``, from one table with this band.

    Rows (n, T) and medoids (k, T); the cell (p, p) of the table is the distance of the prefixes.
    """
    size, (n, k) = m.shape[1], (len(x), len(m))
    wanted, out = set(lengths), {}
    far = np.full((n, k), np.inf)
    before = [np.zeros((n, k))] + [far] * size
    for i in range(1, max(wanted) + 1):
        now = [far] * (size + 1)
        for j in range(max(1, i - window), min(size, i + window) + 1):
            now[j] = np.abs(x[:, i - 1, None] - m[None, :, j - 1]) + np.minimum(np.minimum(before[j], before[j - 1]), now[j - 1])
        before = now
        if i in wanted:
            out[i] = now[i]
    return out


def whole(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    size = m.shape[1]
    return warped(x, m, band(size), [size])[size]


def medoids_of(distance: np.ndarray, k: int, rounds: int = 80) -> np.ndarray:
    """Places of k medoids: the most central one, then always the one farthest from those chosen; then each group's most central member, until nothing changes."""
    chosen = [int(np.argmin(distance.sum(axis=1)))]
    while len(chosen) < k:
        chosen.append(int(np.argmax(distance[:, chosen].min(axis=1))))
    for _ in range(rounds):
        label = np.argmin(distance[:, chosen], axis=1)
        best = []
        for i, old in enumerate(chosen):
            own = np.flatnonzero(label == i)
            best.append(int(own[np.argmin(distance[np.ix_(own, own)].sum(axis=1))]) if len(own) else old)
        if best == chosen:
            break
        chosen = best
    return np.array(chosen)


@dataclass
class Regimes:
    """The sample's units and sequences (MOST at most), the places of the medoids in it, and each one's group."""

    units: list
    sample: np.ndarray
    medoids: np.ndarray
    label: np.ndarray


def _rows(batch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_regimes(seqs: DataFrame, clusters: int | None = None, most: int = MOST) -> Regimes | None:
    """Medoids of ``seqs`` (unit, seq), on the ``most`` units of smallest hash: 3 to 6 by their number unless named. None for under LEAST units.

    The sample's distances are computed by tasks, a row each; the driver gets most x most numbers.
    """
    import pyarrow as pa

    some = seqs.select("unit", "seq", F.xxhash64(F.col("unit").cast("string")).alias("h")).orderBy("h", "unit").limit(most).toArrow()
    n = some.num_rows
    if n < LEAST:
        return None
    sample = np.array(some.column("seq").to_pylist())
    k = min(clusters or min(6, max(3, round(sqrt(n / 12) + 2))), n)

    def distances(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(whole(_rows(batch), sample)), pa.list_(pa.float64()))], names=["i", "d"])

    spark = seqs.sparkSession
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(sample)], "i long, seq array<double>").repartition(max(1, n // 32), "i")
    found = rows.mapInArrow(distances, "i long, d array<double>").orderBy("i").toArrow()
    distance = np.array(found.column("d").to_pylist())
    medoids = medoids_of(distance, k)
    return Regimes(some.column("unit").to_pylist(), sample, medoids, np.argmin(distance[:, medoids], axis=1))


def assign_regimes(seqs: DataFrame, fit: Regimes) -> DataFrame:
    """unit, cluster, distance, silhouette for every unit of ``seqs``: the nearest medoid (ties: the first), and how much nearer the sample's
    members of its group are on average, the unit left out, than those of the next one. Exact where the sample holds all units."""
    import pyarrow as pa

    place, k = {u: i for i, u in enumerate(fit.units)}, len(fit.medoids)
    member = np.eye(k)[fit.label]
    many = max(1, TABLE // max(1, fit.sample.size))

    def assigned(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, many):
                batch = whole_batch.slice(at, many)
                d = whole(_rows(batch), fit.sample)
                near = d[:, fit.medoids]
                cluster = np.argmin(near, axis=1)
                total, size = d @ member, np.tile(member.sum(axis=0), (len(d), 1))
                rows = np.arange(len(d))
                own = [place.get(u) for u in batch.column(0).to_pylist()]
                for i, p in enumerate(own):
                    if p is not None:  # its distance to itself is 0
                        size[i, fit.label[p]] -= 1
                mean = np.where(size > 0, total / np.maximum(size, 1), np.inf)
                a = mean[rows, cluster]
                mean[rows, cluster] = np.inf
                b = mean.min(axis=1)
                b = np.where(np.isfinite(b), b, a)
                with np.errstate(invalid="ignore"):
                    s = np.where(np.isfinite(a), (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(near[rows, cluster]), pa.array(s)], names=["unit", "cluster", "distance", "silhouette"])

    kind = seqs.schema["unit"].dataType.simpleString()
    return seqs.select("unit", "seq").mapInArrow(assigned, f"unit {kind}, cluster int, distance double, silhouette double")


def prefix_regimes(seqs: DataFrame, fit: Regimes, times: list) -> DataFrame:
    """unit, t, cluster: the medoid nearest to the unit up to each period. One table of warped distances for each width of the band, not one for each prefix."""
    import pyarrow as pa

    medoids, widths = fit.sample[fit.medoids], {}
    for p in range(1, len(times) + 1):
        widths.setdefault(band(p), []).append(p)

    def assigned(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                x, cluster = _rows(batch), np.zeros((min(4096, batch.num_rows), len(times)), dtype=np.int32)
                for width, lengths in widths.items():
                    for p, d in warped(x, medoids, width, lengths).items():
                        cluster[:, p - 1] = np.argmin(d, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cluster), pa.list_(pa.int32()))], names=["unit", "cluster"])

    kind = seqs.schema["unit"].dataType.simpleString()
    found = seqs.select("unit", "seq").mapInArrow(assigned, f"unit {kind}, cluster array<int>")
    each = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in times]).alias("t"), "cluster"))
    return found.select("unit", each.alias("x")).select("unit", "x.t", "x.cluster")


def regime_names(assigned: DataFrame, panel: DataFrame, risk: str) -> DataFrame:
    """cluster, regime, units: names by the order of ORDER's weighted scores of the clusters' means; a cluster without a figure has 0 for its score."""
    own = Window.partitionBy("unit").orderBy("t")
    g = panel.withColumn("growth", F.col("value") - F.lag("value").over(own))
    n, x, y = F.count("value"), F.sum(F.when(F.col("value").isNotNull(), F.col("t"))), F.sum("value")
    slope = (n * F.sum(F.col("t") * F.col("value")) - x * y) / F.nullif(n * F.sum(F.when(F.col("value").isNotNull(), F.col("t") * F.col("t"))) - x * x, F.lit(0))
    units = g.groupBy("unit").agg(slope.alias("slope"), F.max_by("value", "t").alias("last"), F.stddev_samp("growth").alias("deviation"), F.max_by(risk, "t").alias("risk"))
    c = assigned.join(units, "unit").groupBy("cluster").agg(F.count("*").alias("units"), *[F.avg(k).alias(k) for k in ORDER])
    every = Window.partitionBy()  # a row for each cluster
    score = sum((F.lit(w) * F.coalesce((F.col(k) - F.avg(k).over(every)) / F.nullif(F.stddev_pop(k).over(every), F.lit(0.0)), F.lit(0.0)) for k, w in ORDER.items()), F.lit(0.0))
    place = F.row_number().over(Window.orderBy(F.round(score, 9).desc(), "cluster"))
    named = c.select("cluster", "units", place.alias("place"))
    regime = F.coalesce(F.get(F.array(*[F.lit(r) for r in REGIMES]), F.col("place") - 1), F.concat(F.lit("regime_"), F.col("place").cast("string")))
    return named.select("cluster", "units", regime.alias("regime"))


def regime_share(by_period: DataFrame) -> DataFrame:
    """t, regime, units, share of the period's units."""
    n = by_period.groupBy("t", "regime").agg(F.count("*").alias("units"))
    total = by_period.groupBy("t").agg(F.count("*").alias("total"))
    return n.join(total, "t").select("t", "regime", "units", (F.col("units") / F.col("total")).alias("share"))
