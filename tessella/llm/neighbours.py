"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder

#: Vectors that partitions and classifier are fitted on; every vector is indexed.
MOST_FITTED = 8192
#: Partitions at most: what so many fitted vectors can tell apart.
MOST_PARTS = 256
#: Rows of vectors, and of queries, that meet in one task at most (about: by a hash).
BLOCK = 8192
#: Rows from which on a partition is divided again, and vectors of it that this is fitted on.
LEAF_ROWS, MOST_FITTED_BELOW = 1 << 20, 4096


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer from vectors to partitions; a query goes to its ``probes`` most probable ones."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids of its k nearest in ``base``, its own id left out, and their distances; ties to the smaller id.

    Products of matrices find those that may be among the k, by bounds of their rounding errors, which grow with both
    norms; their distances are computed anew from the differences. Where a norm leaves the range of doubles all
    are; a distance that does is infinite, and comes last.
    """
    out, bound = [], 8 * (base.shape[1] + 4) * np.finfo(float).eps
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (base**2).sum(1)
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            size = norms + (some**2).sum(1)[:, None]
            square, error = size - 2 * some @ base.T, bound * size
            others = own[at : at + 256, None] != ids
            for q, row, wrong, other in zip(some, square, error, others, strict=True):
                near = other
                if other.sum() > k and np.isfinite(row + wrong).all():
                    most = np.partition(np.where(other, row + wrong, np.inf), k - 1)[k - 1]
                    near = other & (row - wrong <= most)
                near = np.flatnonzero(near)
                exact = np.sqrt(((base[near] - q) ** 2).sum(1))
                order = np.lexsort((ids[near], exact))[:k]
                out.append((ids[near][order], exact[order]))
    return out


def balanced_parts(neighbours: np.ndarray, n_parts: int, rounds: int = 20, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """Parts of at most ``slack`` times the mean size that cut few edges: breadth-first runs, then moves of vertices to where most of their neighbours are."""
    n, k = neighbours.shape
    rng, order, seen = np.random.default_rng(seed), [], np.zeros(n, dtype=bool)
    for root in rng.permutation(n):
        queue = [root] if not seen[root] else []
        seen[root] = True
        for v in queue:
            order.append(v)
            fresh = [u for u in neighbours[v] if not seen[u]]
            seen[fresh] = True
            queue.extend(fresh)
    part = np.empty(n, dtype=np.int64)
    part[order] = np.arange(n) * n_parts // n
    sizes, most = np.bincount(part, minlength=n_parts), int(np.ceil(slack * n / n_parts))
    source, target = np.repeat(np.arange(n), k), neighbours.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, n_parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, n_parts: int, hidden: int = 128, epochs: int = 40, rate: float = 3e-3, seed: int = 7) -> Router:
    """Cross-entropy by Adam in batches of 256."""
    rng = np.random.default_rng(seed)
    scale = 1 / max(float(np.sqrt((x**2).sum(1).mean())), 1e-12)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)) * np.sqrt(x.shape[1]) * scale, np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, n_parts)), np.zeros(n_parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // 256)):
            xs, ys, step = x[rows], part[rows], step + 1
            h = np.maximum(xs @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(rows)), ys] -= 1
            g /= len(rows)
            back = (g @ w[2].T) * (h > 0)
            for i, d in enumerate((xs.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d**2
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Router(*w, probes=1)


@dataclass(frozen=True)
class Routes:
    """Partitions, and of those that are too large the partitions below them; a leaf's number is its partition's times ``MOST_PARTS`` plus its own below."""

    top: Router
    below: dict[int, Router]

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Each vector's most probable leaf."""
        part = self.top.logits(x).argmax(1)
        leaf = part * MOST_PARTS
        for p in np.unique(part).tolist():
            if p in self.below:
                leaf[part == p] += self.below[p].logits(x[part == p]).argmax(1)
        return leaf.astype(np.int32)

    def probes(self, x: np.ndarray) -> list[list[int]]:
        """Each query's leaves: the most probable ones of its most probable partitions."""
        order = np.argsort(-self.top.logits(x), axis=1, kind="stable")[:, : self.top.probes]
        out: list[list[int]] = [[] for _ in x]
        for parts in order.T:
            for p in np.unique(parts).tolist():
                rows, below = np.flatnonzero(parts == p), self.below.get(p)
                subs = np.argsort(-below.logits(x[rows]), axis=1, kind="stable")[:, : below.probes] if below else np.zeros((len(rows), 1), dtype=np.int64)
                for r, some in zip(rows.tolist(), subs.tolist(), strict=True):
                    out[r].extend(p * MOST_PARTS + s for s in some)
        return out

    def leaves(self) -> list[int]:
        return [p * MOST_PARTS + s for p in range(len(self.top.b2)) for s in range(len(self.below[p].b2) if p in self.below else 1)]


def fit_router(sample: np.ndarray, n_parts: int, k: int, recall: float = 0.98, checked: int = 512) -> Router:
    """Partitions the sample's neighbour graph, trains the classifier, and takes as many probes as give ``checked`` sample vectors ``recall`` of their k nearest in the sample."""
    n_parts = int(max(1, min(MOST_PARTS, n_parts, len(sample) / 32)))
    ids, k = np.arange(len(sample)), min(k, len(sample) - 1)
    if n_parts == 1 or k < 1:
        d = sample.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = np.array([found for found, _ in nearest(sample, ids, sample, ids, k)])
    router = train_router(sample, balanced_parts(near, n_parts), n_parts)
    logits = router.logits(sample)
    home = logits.argmax(1)
    test = np.linspace(0, len(sample) - 1, min(checked, len(sample))).astype(int)
    place = (-logits[test]).argsort(1).argsort(1)  # of each part, in the query's order
    need = np.take_along_axis(place, home[near[test]], 1)
    probes = next(p for p in range(1, n_parts + 1) if (need < p).mean() >= recall)
    return Router(router.w1, router.b1, router.w2, router.b2, probes)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: no null or non-finite component, not all zero."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)")


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def search(embeddings: DataFrame, every: int = 100, k: int = 10, most_fitted: int = MOST_FITTED, block: int = BLOCK, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each vector of ``embeddings`` (vec_id, embedding) whose vec_id is divisible by ``every``, the k nearest of all others
    that its probes find; where those find fewer than k, of all others. Vectors of different lengths are no candidates for each other: each length is
    searched by itself.

    Null and zero vectors, and those with a null or non-finite component or without a vec_id, take no part. Of rows with one vec_id none is a
    candidate for another; rows that repeat a vec_id and vector count once. Ties go to the smaller vec_id. score is the Euclidean
    distance of the original vectors in double precision. No usable vectors, no rows. Other columns are not read.
    """
    rows = usable(embeddings)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()
    if not sizes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    found = [search_length(rows.filter(F.size("v") == r.n), r["count"], every, k, most_fitted, block, leaf_rows) for r in sizes]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def divided(rows: DataFrame, top: Router, n_rows: int, k: int, leaf_rows: int) -> dict[int, Router]:
    """Routers of the partitions of more than ``leaf_rows`` of ``rows``, each fitted in a task of its own on a bounded draw of its vectors.

    At most ``MOST_PARTS`` small models reach the driver, so there are at most its square of leaves.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Routes(top, {}))

    def home(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                part = shared.value.homes(_matrix(batch.column(1), batch.num_rows)) // MOST_PARTS
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    placed = rows.mapInArrow(home, "vec_id long, v array<double>, part int")
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().filter(F.col("count") > leaf_rows).collect()}
    if not counts:
        return {}
    draw = F.xxhash64(F.lit(5), "vec_id")
    least = min(counts.values())
    some = rows.filter(F.pmod(draw, F.lit(max(1, least // (4 * MOST_FITTED_BELOW)))) == 0).mapInArrow(home, "vec_id long, v array<double>, part int").filter(F.col("part").isin(list(counts)))
    bounded = some.withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy(draw, "vec_id"))).filter(F.col("_r") <= MOST_FITTED_BELOW).select("part", "v")

    def fit(key, table):
        import pyarrow as pa

        part = key[0].as_py()
        x = np.unique(_matrix(table.column("v").combine_chunks(), table.num_rows), axis=0)
        return pa.table({"part": pa.array([part], pa.int32()), "model": pa.array([pickle.dumps(fit_router(x, -(-counts[part] // leaf_rows), k))], pa.binary())})

    return {r.part: pickle.loads(r.model) for r in bounded.groupBy("part").applyInArrow(fit, "part int, model binary").collect()}  # made by this job


def search_length(rows: DataFrame, n_rows: int, every: int, k: int, most_fitted: int, block: int, leaf_rows: int) -> DataFrame:
    """``search`` of ``n_rows`` usable vectors of one length.

    The router is fitted on at most ``most_fitted`` distinct vectors of a draw by hash; partitions of more than ``leaf_rows`` are divided again in the
    same way, so that what a query is compared with hardly grows with the table. Every vector is indexed in its most
    probable leaf. Leaves, and the queries sent to them, are dealt by a hash into blocks of about ``block`` rows, and a
    task sees one block of each at a time, so that a crowded leaf or a vector with many copies is no
    task's burden.
    """
    work = WorkFolder(rows.sparkSession, "neighbours")
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(max(1, n_rows // (4 * most_fitted)))) == 0)
    found = drawn.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_fitted).select("v").toPandas()
    top = fit_router(np.array(found["v"].tolist(), dtype=np.float64), int(np.sqrt(n_rows) / 4), k)
    routes = work.spark.sparkContext.broadcast(Routes(top, divided(rows, top, n_rows, k, leaf_rows) if n_rows > leaf_rows else {}))

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, asked = _matrix(batch.column(1), batch.num_rows), batch.column(0).to_numpy() % every == 0
                parts = [[h] for h in routes.value.homes(x).tolist()]
                for i, leaves in zip(np.flatnonzero(asked).tolist(), routes.value.probes(x[asked]), strict=True):
                    parts[i] = leaves
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

    routed = work.cut(rows.mapInArrow(route, "vec_id long, v array<double>, parts array<int>"), "routed")
    base = routed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    asked = routed.filter(F.col("vec_id") % every == 0)
    # a row for each leaf: at most MOST_PARTS squared
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    def rank(vectors, asked):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not vectors.num_rows or not asked.num_rows:
            return schema.empty_table()
        side = lambda t, c: (t.column(f"{c}_id").to_numpy(), _matrix(t.column(c).combine_chunks(), t.num_rows))
        (ids, x), (own, q) = side(vectors, "x"), side(asked, "y")
        near = nearest(x, ids, q, own, k)
        return pa.table([np.repeat(own, [len(i) for i, _ in near]), np.concatenate([i for i, _ in near]), np.concatenate([d for _, d in near])], schema=schema)

    keys = ["part", "b", "q"]

    def meet(queries, name):
        sizes = F.broadcast(work.cut(blocks(base, "n_base").join(blocks(queries, "n_query"), "part"), name))
        spread = lambda df, own, other: df.join(sizes, "part").select(
            "vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), own).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other")
        )
        x = spread(base, F.col("n_base"), "n_query").select("part", F.col("own").alias("b"), F.col("other").alias("q"), F.col("vec_id").alias("x_id"), F.col("v").alias("x"))
        y = spread(queries, F.col("n_query"), "n_base").select("part", F.col("other").alias("b"), F.col("own").alias("q"), F.col("vec_id").alias("y_id"), F.col("v").alias("y"))
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")

    def first(met):
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return met.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = work.cut(first(meet(asked.select("vec_id", "v", F.explode("parts").alias("part")), "blocks")), "found")
    short = asked.select("vec_id").distinct().join(found.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").filter(F.coalesce("count", F.lit(0)) < k)
    short = work.cut(short.select("vec_id"), "short")
    if short.isEmpty():
        return found
    others = F.array_except(F.lit(routes.value.leaves()), "parts")
    more = meet(asked.join(short, "vec_id").select("vec_id", "v", F.explode(others).alias("part")), "more-blocks")
    return first(found.select("query_id", "vec_id", "score").union(more))
