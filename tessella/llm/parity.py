"""Near-duplicate documents by a parity-sketch join on word shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, boxed, in_row, slices, unboxed
from tessella.llm.components import components
from tessella.llm.nodes import bit_sketch, compare, needed, passes, similar, tiles
from tessella.llm.words import Words, mix

_U = np.uint64
#: Members of a key's group that are compared together.
SMALL = 2048


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; of a text with fewer words, the whole sequence's one."""
    out = []
    for _, some in slices(texts):
        words = Words(some, lower=True)
        h = words.windows(k)
        short = [words.windows(j) for j in range(1, k)]
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            out.append(np.unique(h[a : b - k + 1] if b - a >= k else short[b - a - 1][a : a + 1] if b > a else h[:0]))
    return out


class Bands:
    """Size bands and the pigeonhole of pairs whose similarity is ``percent`` / 100 or more.

    Sets of such a pair differ in at most (a + b) * (100 - percent) / (100 + percent) shingles. A band holds
    sizes from one edge to the next, half as large again; sets just above it, of up to its
    largest size * 100 / percent, join it too, so every such pair shares a band.
    """

    def __init__(self, percent: int) -> None:
        self.percent, edges = percent, [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        self.edges = np.array(edges, dtype=np.int64)

    def of(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        return [band, band - 1] if band and n * self.percent <= (int(self.edges[band]) - 1) * 100 else [band]

    def most_apart(self, band: int) -> int:
        """The most shingles by which a pair in the band may differ."""
        top = int(self.edges[band + 1]) - 1
        return (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)


def sketch(shingles: np.ndarray, band: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The XOR of the shingles dealt to each block, hashed with block and band to a key; the number of shingles in each.

    A shingle that is in one set of two alone changes one block; so sets that differ in t shingles agree in all but t keys.
    """
    m = mix(shingles + _U((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    block = (((m >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    xor, count = np.zeros(blocks, dtype=np.uint64), np.bincount(block, minlength=blocks)
    if len(block):
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        xor[block[start]] = np.bitwise_xor.reduceat(mix(m[order]), start)
    return mix(xor ^ mix(np.arange(blocks, dtype=np.uint64) + (_U(band + 1) << _U(40)))), count


def heavy_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """In each band of the set t + 1 of 1.3 (t + 1) keys, those of the fullest blocks.

    A similar pair agrees in all but t keys; in one order of all keys (fuller first, then smaller), the first t + 1 of both then share one.
    """
    out = []
    for band in bands.of(len(shingles)):
        need = bands.most_apart(band) + 1
        key, count = sketch(shingles, band, need + need * 3 // 10)
        out.append(key[np.lexsort((key, -count))[:need]])
    return np.concatenate(out)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed numbers."""
    return int(mix(shingles).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5))).astype(np.int64))


def _small(batches, k: int, bands: Bands):
    import pyarrow as pa

    seen: set = set()  # of this task: copies of a set send its keys once, as far as it remembers
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, d1, d2, keys = batch.column(0), [], [], [], []
        for doc, s in zip(ids.to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
            d = digest(s) if len(s) else (0, 0)
            n.append(len(s))
            d1.append(d[0])
            d2.append(d[1])
            if len(seen) > 500_000:
                seen.clear()
            fresh = len(s) and doc is not None and d not in seen
            keys.append(heavy_keys(s, bands).view(np.int64) if fresh else None)
            if fresh:
                seen.add(d)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "keys"])


def _full(batches, k: int, bands: Bands):
    import pyarrow as pa

    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):  # few sets at a time, however large the batch
        rows = []
        for sid, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
            if not len(s) or digest(s)[0] != sid:
                continue  # another text of the same doc_id
            fine = []
            for band in bands.of(len(s)):
                need = bands.most_apart(band) + 1
                fine.append({"band": band, "need": need, "blocks": 2 * need, "keys": sketch(s, band, 2 * need)[0].view(np.int64)})
            rows.append((sid, len(s), bit_sketch(s), s.view(np.int64), fine))
            if sum(len(r[3]) for r in rows) > 500_000:
                yield _rows(pa, rows)
                rows = []
        if rows:
            yield _rows(pa, rows)


def _rows(pa, rows):
    longs = pa.list_(pa.int64())
    fine = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32()), ("blocks", pa.int32()), ("keys", longs)]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), longs, longs, fine), strict=True)], ["sid", "n", "bits", "shingles", "fine"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); links are Jaccard similarities of k-word shingle sets of ``percent`` / 100 or more.

    1. Each set's parity sketch is cut into blocks, by size band; sets that share a key with another
       set go on. Copies of a set are one from here on.
    2. Of those, finer sketches: their keys in order of how many sets have them, rarest first. Of t + 1 more
       than the pair may differ in, similar pairs share one of the first; sets with so many keys of their own are alone.
    3. In each key's group every set is compared with the most central one; components of these
       links; then only pairs in different components, in tiles of SMALL sets, if size and bit sketches allow.
       So all members of a component are found, but within a component not every pair is looked at.

    The large joins are sort-merge joins at every size: their sides grow with the documents.
    A set is known by 64 bits of its digest, a shingle by 64 bits. A document without words has no shingles and is alone,
    as is one without a doc_id, whose component_id is null. Equal doc_ids with different texts link by each of their texts.
    """
    spark, work, bands = docs.sparkSession, WorkFolder(docs.sparkSession, "parity"), Bands(percent)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    small = work.cut(texts.mapInArrow(lambda b: _small(b, k, bands), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "small")
    named = small.filter("n > 0 AND doc_id IS NOT NULL")
    classes = work.cut(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")

    # dealt by key once, for the counts and for the join with them
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = small.filter("keys IS NOT NULL").select(F.col("d1").alias("sid"), F.explode("keys").alias("key")).repartition(parts, "key")
    shared = keyed.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("key")
    chosen = keyed.join(shared.hint("merge"), "key", "left_semi").select("sid").distinct()
    chosen = work.cut(classes.join(chosen, classes["d1"] == chosen["sid"]).select(F.col("rep").alias("doc_id"), "sid"), "chosen")
    small = work.cut(small.drop("keys"), "narrow")
    work.drop("small")

    passed = needed(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", chosen.select("doc_id"))
    met = passed.join(chosen.hint("merge"), "doc_id").dropDuplicates(["doc_id", "sid", "text"])
    schema = "sid long, n long, bits array<long>, shingles array<long>, fine array<struct<band:int,need:int,blocks:int,keys:array<long>>>"
    sets = work.cut(met.select("sid", "text").repartition(parts, "sid").mapInArrow(lambda b: _full(b, k, bands), schema), "sets")

    fine = sets.select("sid", F.explode("fine").alias("f")).select("sid", "f.band", "f.need", "f.blocks", F.explode("f.keys").alias("key")).repartition(parts, "key")
    often = fine.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    own = Window.partitionBy("sid", "band")
    ranked = fine.join(often.hint("merge"), "key").select("*", F.count("*").over(own).alias("known"), F.sum("often").over(own).alias("central"), F.row_number().over(own.orderBy("often", "key")).alias("place"))
    first = work.cut(ranked.filter("place <= need - (blocks - known)").select("key", "sid", "central"), "first")
    work.drop("chosen")

    leaders = first.groupBy("key").agg(F.max(F.struct("central", F.col("sid").alias("leader"))).alias("l")).select("key", "l.leader")
    pairs = first.join(leaders, "key").filter("sid <> leader").select(F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b")).distinct()
    links = work.cut(similar(pairs, sets, percent), "links")
    found = components(links, work, "star")
    placed = first.join(found.select(F.col("node").alias("sid"), "label"), "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    open_ = work.cut(placed.join(mixed, "key").select(F.col("key").alias("node"), "sid", "label", "size"), "open")
    leaves = tiles(open_, SMALL).join(open_.select("sid", "label").distinct(), "sid")
    apart = work.cut(compare(leaves, sets.select("sid", "n", "bits", F.lit(None).cast("binary").alias("mark")), percent, True).select("a", "b").distinct(), "apart")
    more = similar(apart, sets, percent, sketched=True)
    joined = components(links.union(work.cut(more, "more")), work, "all")

    by_set = classes.join(joined.select(F.col("node").alias("d1"), "label"), "d1", "left").select("n", "d1", "d2", "rep", F.coalesce("label", "d1").alias("label"))
    least = by_set.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = work.cut(by_set.join(least, "label").select("n", "d1", "d2", "component_id"), "components")
    work.drop("sets", "first", "links", "open", "apart", "more", "classes")
    out = small.join(final.hint("merge"), ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that have a near duplicate of smaller doc_id in their component; of rows with one doc_id one stays.

    Rows without a doc_id all stay.
    """
    work = WorkFolder(docs.sparkSession, "one-of-each")
    found = work.cut(near_duplicates(docs.select("doc_id", "text"), k, percent).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "component_id"), "components")
    # rows that can't go as they are, a part of all: of those of repeated ids one stays, of those with a smaller one in their component none
    odd = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("kept"))
    odd = work.cut(odd.filter("n > 1 OR kept = 0").select(F.col("doc_id").alias("odd"), "kept"), "odd")
    rows = boxed(docs).withColumn("id", in_row("doc_id").cast("long"))
    sieve = passes(odd.select("odd"))
    maybe, plain = rows.filter(sieve("id")), rows.filter(~sieve("id"))
    met = maybe.join(odd.hint("merge"), F.col("id") == F.col("odd"), "left")
    alone = met.filter("odd IS NULL").select("row")
    one = met.filter("kept = 1").dropDuplicates(["id"]).select("row")
    return unboxed(plain.select("row").union(alone).union(one))
