"""Sets that meet in nodes of few members: compared exhaustively, by sizes and sketches first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.llm.common import Sieve, WorkFolder, whole_groups
from tessella.llm.words import mix

_U = np.uint64
#: 64-bit words of the one-bit-a-shingle sketch that candidates are first compared by.
BITS = 16


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles at 64 * BITS places: their Hamming distance is at most the symmetric difference."""
    place = mix(shingles ^ _U(0x5DEECE66D5DEECE6))
    parity = np.bincount((place % _U(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix joins, and no more than that takes; from the members with most neighbours outward."""
    degree = near.sum(axis=1)
    left, out = degree > 0, []
    for root in np.argsort(-degree, kind="stable"):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            nxt = []
            for i in todo:
                found = np.flatnonzero(near[i] & left)
                left[found] = False
                out += [(int(i), int(j)) for j in found]
                nxt += found.tolist()
            todo = sorted(nxt, key=lambda j: -degree[j])
    return out


def close_pairs(n: np.ndarray, bits: np.ndarray, percent: int, rows: int = 256) -> np.ndarray:
    """Which of all pairs of members may be similar, by their sizes and their sketches' Hamming distance, ``rows`` of them at a time: never leaves out one that is."""
    near = np.zeros((len(n), len(n)), dtype=bool)
    for at in range(0, len(n), rows):
        own = n[at : at + rows, None]
        small, large = np.minimum(own, n), np.maximum(own, n)
        apart = np.zeros(small.shape, dtype=np.int64)
        for word in bits.T:
            apart += np.bitwise_count(word[at : at + rows, None] ^ word)
        near[at : at + rows] = (small * 100 >= large * percent) & (apart * (100 + percent) <= (small + large) * (100 - percent))
    np.fill_diagonal(near, False)
    return near


def least_agreeing(marks: int, percent: int) -> int:
    """Of so many minwise tokens, how many two sets that are as similar as asked for share at least, but for a chance below 1e-13: eight deviations under the mean."""
    p = percent / 100
    return max(0, int(np.floor(marks * p - 8 * np.sqrt(marks * p * (1 - p)))))


def agreeing(near: np.ndarray, marks: list, percent: int) -> np.ndarray:
    """``near`` without pairs whose marks, a byte of each minwise token, agree too seldom: tells sets apart that are too large for their sketches."""
    i, j = np.nonzero(np.triu(near))
    if not len(i) or marks[0] is None:
        return near
    each = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(len(marks), -1)
    least = least_agreeing(each.shape[1], percent)
    out = np.zeros_like(near)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[a, b] = (each[a] == each[b]).sum(axis=1) >= least
    return out | out.T


def _compared(batches, percent: int, every: bool):
    """Pairs (a, b) of the members (leaf, side, sid, label, n, bits, mark) of each leaf, compared exhaustively, that may be similar and have different labels.

    Unless ``every``, of each leaf only so many pairs that all the others are between sets that these pairs join; a
    row (null, null, leaf) tells that there are others.
    """
    import pyarrow as pa

    for some in whole_groups(batches):
        leaf, side, sid, label, n = (some.column(i).to_numpy() for i in range(5))
        bits = some.column(5).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS)
        marks = some.column(6).to_pylist()
        start = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        rows: list = []
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(leaf)], strict=True):
            if hi - lo < 2 or (label[lo:hi] == label[lo]).all():
                continue
            near = close_pairs(n[lo:hi], bits[lo:hi], percent) & (label[lo:hi, None] != label[None, lo:hi])
            if side[lo:hi].any():  # of two tiles: each is compared with the other
                near &= side[lo:hi, None] != side[None, lo:hi]
            near = agreeing(near, marks[lo:hi], percent)
            if every:
                pairs = list(zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True))
            else:
                pairs = forest(near)
                if len(pairs) < np.count_nonzero(near) // 2:
                    rows.append((None, None, int(leaf[lo])))
            rows += [(*sorted((int(sid[lo + i]), int(sid[lo + j]))), None) for i, j in pairs]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "leaf"])


def compare(rows: DataFrame, sketched: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, leaf) of ``rows`` (leaf, side, sid, label), as ``_compared`` tells."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.join(sketched, "sid").select("leaf", "side", "sid", "label", "n", "bits", "mark").repartition(parts, "leaf").sortWithinPartitions("leaf")
    return met.mapInArrow(lambda b: _compared(b, percent, every), "a long, b long, leaf long")


def tiles(members: DataFrame, small: int) -> DataFrame:
    """Leaves (leaf, side, sid) of ``members`` (node, sid, size): small nodes as they are; of large ones every tile by itself and with every other one."""
    numbered = members.select("node", "sid", F.expr(f"cast((size + {small - 1}) div {small} as int)").alias("tiles"))
    own = numbered.withColumn("own", F.expr("cast(pmod(xxhash64(sid), tiles) as int)"))
    met = own.select("node", "sid", "own", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    lower, upper = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("node", "sid", lower.alias("lo"), upper.alias("hi"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    return met.select(F.xxhash64("node", "lo", "hi").alias("leaf"), "side", "sid")


def _far(a: str, b: str, percent: int) -> str:
    """SQL: the sketches alone rule the pair out."""
    hamming = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITS))
    return f"least({a}.n, {b}.n) * 100 < greatest({a}.n, {b}.n) * {percent} OR ({hamming}) * {100 + percent} > ({a}.n + {b}.n) * {100 - percent}"


def passes(ids: DataFrame):
    """A test of a long column for being among ``ids``: true for all of these and few others, false for nulls."""
    sieve = Sieve(ids)

    @pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:  # without nulls, which would make doubles of longs
        return pd.Series(sieve(x.to_numpy()))

    return lambda c: F.col(c).isNotNull() & among(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))


def needed(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``ids``, and few others: filtered as they are read, so that the rest isn't shuffled."""
    return rows.filter(passes(ids)(column))


def similar(pairs: DataFrame, sets: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (sid, n, bits, shingles) are similar: first by size and sketches, unless ``sketched`` says that has been done, then exactly."""
    near = pairs
    if not sketched:
        light = sets.select("sid", "n", "bits")
        near = pairs.join(light.select(F.col("sid").alias("a"), F.struct("n", "bits").alias("x")), "a").join(light.select(F.col("sid").alias("b"), F.struct("n", "bits").alias("y")), "b")
        near = near.filter(f"NOT ({_far('x', 'y', percent)})").select("a", "b")
    near = WorkFolder(pairs.sparkSession, "pairs").cut(near, "near")
    whole = needed(sets.select("sid", "n", "shingles"), "sid", near.select("a").union(near.select("b")).distinct())
    side = lambda i: whole.select(F.col("sid").alias(i), F.struct("n", "shingles").alias(f"s{i}"))
    met = near.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("sa.shingles", "sb.shingles"))
    return met.select("a", "b", (F.col("sa.n") + F.col("sb.n")).alias("sum"), both.alias("both")).filter(f"100 * both >= {percent} * (sum - both)").select("a", "b")
