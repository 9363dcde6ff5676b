"""Near-duplicate documents by a chosen-path set similarity join on word shingles."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Sieve, WorkFolder
from tessella.llm.components import components
from tessella.llm.nodes import bit_sketch, compare, similar, tiles
from tessella.llm.parity import digest, shingle_sets
from tessella.llm.words import mix

_U = np.uint64
#: Independent trees. A pair of the least similarity misses each other in all of them with a chance below 3e-6, see ``near_duplicates``.
TREES = 16
#: Minwise tokens of a document that branches below a root choose from.
TOKENS = 64
#: Members of a node that are compared exhaustively; larger nodes branch.
SMALL = 2048
#: Times a node branches; nodes that are large even then are compared tile by tile.
DEPTH = 8
#: Shingles that are hashed together.
HASHED = 1 << 18


def minwise(sets: list[np.ndarray], salt: int, n: int) -> np.ndarray:
    """For each set, none of them empty, its minwise tokens under ``n`` hashes, a row a set."""
    out = np.empty((len(sets), n), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= HASHED:
            size, end = size + len(sets[end]), end + 1
        joined = np.concatenate(sets[at:end])
        start = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for i in range(n):
            out[at:end, i] = np.minimum.reduceat(mix(joined ^ _U((salt + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), start)
        at = end
    return out


def _few(batches, rows: int = 64):
    """The batches' rows, few at a time, so that few sets are held at once however large a batch is."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _roots(batches, k: int):
    """Each document's size and digest; of a set that the task has not met, its node below each tree's root."""
    import pyarrow as pa

    seen: set = set()  # as far as it remembers
    longs = pa.list_(pa.int64())
    for batch in _few(batches):
        ids, sets = batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k)
        ds = [digest(s) if len(s) else (0, 0) for s in sets]
        if len(seen) > 100_000:
            seen.clear()
        fresh = []
        for i, d in enumerate(ds):
            if ids[i] is not None and len(sets[i]) and d not in seen:
                seen.add(d)
                fresh.append(i)
        keys: list = [None] * len(ids)
        nodes = mix(minwise([sets[i] for i in fresh], 0, TREES) ^ (np.arange(TREES, dtype=np.uint64) << _U(56))).view(np.int64)
        for i, row in zip(fresh, nodes, strict=True):
            keys[i] = row
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[j] for d in ds], pa.int64()) for j in (0, 1)), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "nodes"])


def _sets(batches, k: int, wanted: Sieve):
    """The whole sets, sketches and minwise tokens of the documents that ``wanted`` lets pass."""
    import pyarrow as pa

    longs = pa.list_(pa.int64())
    for batch in _few(batches):
        batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        batch = batch.filter(pa.array(wanted(batch.column(0).to_numpy())))
        found = [s for s in shingle_sets(batch.column(1).to_pylist(), k) if len(s)]
        while found:  # rows of a bounded size, long documents one by one
            size, end = np.cumsum([len(s) for s in found]), 1
            end = max(1, int(np.searchsorted(size, HASHED)))
            some, found = found[:end], found[end:]
            tokens = minwise(some, TREES, TOKENS)
            marks = [m.tobytes() for m in mix(tokens).astype(np.uint8)]
            columns = [pa.array([digest(s)[0] for s in some], pa.int64()), pa.array([len(s) for s in some], pa.int64()), pa.array(marks, pa.binary())]
            columns += [pa.array(c, longs) for c in ([bit_sketch(s) for s in some], list(tokens.view(np.int64)), [s.view(np.int64) for s in some])]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "mark", "bits", "tokens", "shingles"])


def _branched(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (node, sid) of the nodes one level below.

    The node chooses one of the minwise tokens, or two, 100 / percent on average, by its own hash; members of one value go
    on together. So a pair as similar as asked for keeps one common node on average, and others ever fewer.
    """
    def child(i: int) -> str:
        place = f"pmod(xxhash64(node, {i}), {TOKENS})"
        return f"xxhash64(node, {i}, element_at(tokens, cast({place} as int) + 1))"

    again = f"pmod(xxhash64(node, -1), 1000000) < {1_000_000 * (100 - percent) // percent}"
    both = f"CASE WHEN {again} THEN array({child(0)}, {child(1)}) ELSE array({child(0)}) END"
    return members.join(sets.select("sid", "tokens"), "sid").select("sid", F.explode(F.expr(both)).alias("node"))


def _sized(members: DataFrame) -> DataFrame:
    """(node, sid, size) of the nodes that two members share at least."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes.hint("merge"), "node").select("node", "sid", "size")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text); links are Jaccard similarities of k-word shingle sets of ``percent`` / 100 or more.

    1. A set's minwise tokens under TREES hashes are its nodes below the roots of as many trees. Copies of a set are one.
    2. A node of more than SMALL sets branches by minwise tokens that it chooses, until its nodes are small, DEPTH times at most. What is
       large even then (sets that are alike, but not as much as asked for) is compared tile by tile.
    3. Small nodes are compared exhaustively, by sizes and bit sketches, which leave out no similar pair, and by a byte of each minwise token, which leave
       out one with a chance below 1e-13; of what passes so many pairs as join the rest are
       confirmed on the full sets, then those that are still in different components.

    So links are exact, and a component is found whole unless one of its links that nothing else replaces is missed in every tree. With p the
    similarity, a pair shares a root's node with chance p and keeps a common node through a branching with chance p (1 + (1 - p) / p ...) or so:
    at 0.85 a tree misses it with chance 0.15 where nodes are small at once, and with 0.45 after six branchings. All 16 trees: 7e-14 and 3e-6.
    A set is known by 64 bits of its digest, a shingle by 64 bits. A document without words has no shingles and is alone, as is one without
    a doc_id, whose component_id and kept are null. Equal doc_ids with different texts link by each of their texts. An empty table gives no rows.
    """
    work = WorkFolder(docs.sparkSession, "chosen_path")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    small = work.cut(texts.mapInArrow(lambda b: _roots(b, k), "doc_id long, n long, d1 long, d2 long, nodes array<long>"), "small")
    classes = work.cut(small.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")

    rooted = small.filter("nodes IS NOT NULL").select(F.col("d1").alias("sid"), F.explode("nodes").alias("node")).distinct()
    members = work.cut(_sized(rooted), "level0")
    wanted = work.cut(members.select("sid").distinct().join(classes, F.col("sid") == F.col("d1")).select(F.col("rep").alias("doc_id")), "wanted")
    sieve = Sieve(wanted)
    small = work.cut(small.drop("nodes"), "narrow")
    work.drop("small", "wanted")
    found = texts.mapInArrow(lambda b: _sets(b, k, sieve), "sid long, n long, mark binary, bits array<long>, tokens array<long>, shingles array<long>")
    sets = work.cut(found, "sets")

    leaves, large = [members.filter(f"size <= {SMALL}")], members.filter(f"size > {SMALL}")
    for depth in range(1, DEPTH + 1):
        if large.isEmpty():
            break
        members = work.cut(_sized(_branched(large.select("node", "sid"), sets, percent).distinct()), f"level{depth}")
        leaves.append(members.filter(f"size <= {SMALL}"))
        large = members.filter(f"size > {SMALL}")
    leaves.append(large)

    tiled = work.cut(tiles(reduce(DataFrame.union, leaves), SMALL), "tiles")
    sketched = sets.select("sid", "n", "bits", "mark").dropDuplicates(["sid"])
    compared = work.cut(compare(tiled.select("leaf", "side", "sid", F.col("sid").alias("label")), sketched, percent, False), "compared")
    links = work.cut(similar(compared.filter("a IS NOT NULL").select("a", "b").distinct(), sets, percent, sketched=True), "links")
    label = components(links, work, "part").select(F.col("node").alias("sid"), "label")
    again = tiled.join(compared.filter("leaf IS NOT NULL").select("leaf").distinct(), "leaf", "left_semi")
    again = again.join(label, "sid", "left").select("leaf", "side", "sid", F.coalesce("label", "sid").alias("label"))
    others = work.cut(compare(again, sketched, percent, True).select("a", "b").distinct(), "others")
    links = links.union(work.cut(similar(others, sets, percent, sketched=True), "more"))
    joined = components(links, work, "all")

    by_set = classes.join(joined.select(F.col("node").alias("d1"), "label"), "d1", "left").select("n", "d1", "d2", "rep", F.coalesce("label", "d1").alias("label"))
    least = by_set.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = work.cut(by_set.join(least, "label").select("n", "d1", "d2", "component_id"), "components")
    work.drop("sets", "tiles", "links", "compared", "others", "more", "classes", *(f"level{i}" for i in range(DEPTH + 1)))
    out = small.join(final.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
