"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, shuffles_removed, slices
from tessella.llm.words import Table, Words

#: Words of a window that counts as a repeat.
WINDOW = 35
#: Words of an anchor, the part of a window that the index holds.
ANCHOR = 17
#: Bytes of text that are looked at together.
BLOCK_BYTES = 8 << 20
_FINGERPRINTS = "fingerprint long, block long, places long"


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window, -1 for places that start none, and the hash of the anchor at each place.

    A window's anchor is its run of ``anchor`` words with the least hash, the last of
    equal ones. It follows from the window's words alone, so equal windows have equal anchors at the same distance.
    """
    h = words.windows(anchor, 1)
    n, spread = len(words.hash) - window + 1, window - anchor + 1
    at = np.full(len(words.hash), -1, dtype=np.int64)
    if n <= 0:
        return at, h
    value, best, width = h, np.arange(len(h)), 1
    while width < spread:  # the least of ``width`` places from each on; twice as many, or as many as are left, a round
        step = min(width, spread - width)
        later = value[step:] <= value[:-step]
        value, best, width = np.where(later, value[step:], value[:-step]), np.where(later, best[step:], best[:-step]), width + step
    first, end = words.doc_of_window(window)
    inside = np.zeros(len(words.hash) + 1, dtype=np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, end, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at[starts] = best[starts]
    return at, h


def block_fingerprints(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of the texts, and at how many places each stands."""
    parts = [np.zeros(0, dtype=np.int64)]
    for _, some in slices(texts):
        words = Words(some, lower=False)
        at, h = anchors(words, window, anchor)
        parts.append(h[np.unique(at[at >= 0])].view(np.int64))
    return np.unique(np.concatenate(parts), return_counts=True)


def window_hashes(words: Words, window: int) -> np.ndarray:
    """Two independent hashes of the words of every window, a row each."""
    return np.stack([words.windows(window, salt) for salt in (2, 3)])


def count_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``pairs``, and how often each stands."""
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    new = np.ones(pairs.shape[1], dtype=bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
    start = np.flatnonzero(new)
    return pairs[:, start], np.diff(start, append=pairs.shape[1])


def candidate_windows(texts: list[bytes], repeated: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of the texts whose anchor is among ``repeated``, as pairs of hashes, and how often each starts."""
    known, found = Table(np.unique(repeated).view(np.uint64)), [np.zeros((2, 0), dtype=np.uint64)]
    for _, some in slices(texts):
        words = Words(some, lower=False)
        at, h = anchors(words, window, anchor)
        place = np.flatnonzero(at >= 0)
        place = place[known.find(h[at[place]]) >= 0]
        if len(place):
            found.append(window_hashes(words, window)[:, place])
    return count_pairs(np.concatenate(found, axis=1))


def removed_words(texts: list[bytes], twice: np.ndarray, window: int) -> tuple[list[int], list[int], list[bytes]]:
    """Per text: its words, how many of them a window in ``twice`` (pairs of hashes) covers, and the words left, joined by one space."""
    total, gone, left = [], [], []
    known = Table(np.unique(twice[0] ^ (twice[1] << np.uint64(1))))
    for _, some in slices(texts):
        words = Words(some, lower=False)
        keep = np.ones(len(words.hash), dtype=bool)
        if known.n and len(words.hash) >= window:
            pairs = window_hashes(words, window)
            inside = np.zeros(len(words.hash) + 1, dtype=np.int8)
            first, end = words.doc_of_window(window)
            np.add.at(inside, first, 1)
            np.add.at(inside, end, -1)
            place = np.flatnonzero(np.cumsum(inside[: pairs.shape[1]]) > 0)
            place = place[known.find(pairs[0, place] ^ (pairs[1, place] << np.uint64(1))) >= 0]
            edge = np.bincount(place, minlength=len(words.hash) + window + 1) - np.bincount(place + window, minlength=len(words.hash) + window + 1)
            keep = np.cumsum(edge)[: len(words.hash)] == 0
        kept = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(words.first[:-1], len(keep))) * (np.diff(words.first) > 0)
        for text, a, b, k in zip(some, words.first[:-1].tolist(), words.first[1:].tolist(), kept.tolist(), strict=True):
            found = text.split()
            total.append(b - a)
            gone.append(b - a - k)
            left.append(b" ".join(found if k == b - a else [w for w, stays in zip(found, keep[a:b].tolist(), strict=True) if stays]))
    return total, gone, left


class FingerprintIndex:
    """Documents of many batches, and sorted, immutable runs of their fingerprints, in a folder that can be opened again.

    A run is a bucketed table: (fingerprint, block of documents, places), dealt by fingerprint into
    ``n_parts`` files and sorted in each, so that runs are joined
    without a shuffle. ``add`` writes a batch's documents and its run, merge-joins the run with all earlier ones, verifies what
    they share, and once ``fanout`` runs of one tier have gathered merges them into one of the next: each fingerprint is rewritten
    once a tier. The list of runs is written anew, as a file of its own, after each batch; what it doesn't name
    (the rest of a batch that failed) isn't read, and older runs go only after the new list is complete.
    """

    def __init__(self, spark: SparkSession, path: str, n_parts: int = 64, fanout: int = 4, window: int = WINDOW, anchor: int = ANCHOR) -> None:
        self.spark, self.path, self.fanout, self.window, self.anchor = spark, path, fanout, window, anchor
        self.state = {"n_parts": n_parts, "tiers": [[]], "batches": [], "made": 0, "version": 0}
        self.names: dict[str, str] = {}
        listed = self._versions()
        if listed:
            self.state = json.loads(spark.read.text(f"{path}/list/{max(listed)}").first()[0])

    def _hadoop(self, at: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _versions(self) -> list[int]:
        fs, at = self._hadoop("list")
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return [int(n) for n in names if fs.exists(self._hadoop(f"list/{n}/_SUCCESS")[1])]

    def _save(self) -> None:
        self.state["version"] += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "state string").coalesce(1).write.text(f"{self.path}/list/{self.state['version']}")

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table of this session."""
        if run not in self.names:
            self.names[run] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.names[run]} ({_FINGERPRINTS}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {self.state['n_parts']} BUCKETS LOCATION '{self.path}/runs/{run}'")
        return self.spark.table(self.names[run])

    def _write_run(self, rows: DataFrame, dealt: bool) -> str:
        run = f"{self.state['made']}-{uuid.uuid4().hex[:8]}"
        self.state["made"] += 1
        self.names[run] = f"run_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.state["n_parts"], "fingerprint")
        out = rows.write.option("path", f"{self.path}/runs/{run}").option("compression", "zstd")
        with shuffles_removed(self.spark):
            out.bucketBy(self.state["n_parts"], "fingerprint").sortBy("fingerprint").saveAsTable(self.names[run])
        return run

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            if run in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(run)}")
            fs, at = self._hadoop(f"runs/{run}")
            fs.delete(at, True)

    def runs(self) -> list[str]:
        return [run for tier in self.state["tiers"] for run in tier]

    def _merge(self, tier: int) -> list[str]:
        tiers = self.state["tiers"]
        if tier + 1 == len(tiers):
            tiers.append([])
        old, tiers[tier] = tiers[tier], []
        rows = self._table(old[0])
        for run in old[1:]:
            rows = rows.union(self._table(run))
        # a block is of one batch, so of one run: nothing to add up
        tiers[tier + 1].append(self._write_run(rows, dealt=False))
        return old

    def compact(self) -> None:
        """All runs into one."""
        tiers = self.state["tiers"]
        if len(self.runs()) > 1:
            self.state["tiers"] = [self.runs(), *[[] for _ in tiers[1:]]]
            old = self._merge(0)
            self._save()
            self._drop(old)

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame) -> str:
        """Takes in ``docs`` (doc_id, text); the name of the batch."""
        number = self.state["made"]
        batch = f"{number}-{uuid.uuid4().hex[:8]}"
        stored = self._cut(stored_blocks(docs, number, self.window, self.anchor), f"documents/{batch}")
        prints = stored.select(F.explode(F.arrays_zip("fingerprints", "places")).alias("p"), "block").select("p.fingerprints", "block", "p.places").toDF("fingerprint", "block", "places")
        earlier = self.runs()
        run = self._write_run(prints, dealt=False)
        self._cut(self._shared(run, earlier), f"shared/{batch}")
        self.state["batches"].append(batch)
        self._cut(self._verified(batch), f"verified/{batch}")
        self.state["tiers"][0].append(run)
        old, tier = [], 0
        while len(self.state["tiers"][tier]) >= self.fanout:
            old += self._merge(tier)
            tier += 1
        self._save()
        self._drop(old)
        return batch

    def _shared(self, run: str, earlier: list[str]) -> DataFrame:
        """(block, fingerprint) wherever a fingerprint of ``run`` stands that has two places or more in it and the earlier runs: merge joins of sorted runs."""
        new = self._table(run)
        sums = new.groupBy("fingerprint").agg(F.sum("places").alias("places"))
        met, again, out = sums, F.col("places") > 1, []
        for i, name in enumerate(earlier):
            old = self._table(name)
            out.append(old.join(sums.select("fingerprint").hint("merge"), "fingerprint", "left_semi").select("block", "fingerprint"))
            met = met.join(old.groupBy("fingerprint").agg(F.lit(True).alias(f"in{i}")).hint("merge"), "fingerprint", "left")
            again = again | F.col(f"in{i}").isNotNull()
        out.append(new.join(met.filter(again).select("fingerprint").hint("merge"), "fingerprint", "left_semi").select("block", "fingerprint"))
        shared = out[0]
        for more in out[1:]:
            shared = shared.union(more)
        return shared

    def _read(self, what: str, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{what}/{b}" for b in batches])

    def _verified(self, batch: str) -> DataFrame:
        """(block, h1, h2) of the windows that start at two places or more, of those whose anchor the batch shares: of any batch, but only blocks that share are read."""
        shared = self._read("shared", [batch]).groupBy("block").agg(F.collect_list("fingerprint").alias("fingerprints"))  # of one block's text
        blocks = self._read("documents", self.state["batches"]).select("block", "sizes", "texts")
        window, anchor = self.window, self.anchor

        def windows(table):
            import pyarrow as pa

            repeated = table.column("fingerprints").combine_chunks().flatten().to_numpy()
            pairs, n = candidate_windows(block_texts(table.column("sizes")[0].as_py(), table.column("texts")[0].as_py()), repeated, window, anchor)
            return pa.table([pa.array(np.full(len(n), table.column("block")[0].as_py()), pa.int64()), *(pa.array(x.view(np.int64)) for x in pairs), pa.array(n, pa.int64())], ["block", "h1", "h2", "n"])

        counted = blocks.join(shared, "block").groupBy("block").applyInArrow(windows, "block long, h1 long, h2 long, n long")
        everywhere = F.sum("n").over(Window.partitionBy("h1", "h2"))
        return counted.withColumn("all", everywhere).filter("all > 1").select("block", "h1", "h2")

    def documents(self, batches: list[str] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_text of the documents of ``batches`` (None: all), judged on all that the index holds."""
        window = self.window
        blocks = self._read("documents", self.state["batches"] if batches is None else batches).select("block", "ids", "sizes", "texts")
        verified = self._read("verified", self.state["batches"])

        def cut(blocks, marks):
            import pyarrow as pa

            twice = np.stack([marks.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")])
            for i in range(blocks.num_rows):
                total, gone, left = removed_words(block_texts(blocks.column("sizes")[i].as_py(), blocks.column("texts")[i].as_py()), twice, window)
                return pa.table({"doc_id": blocks.column("ids")[i].values, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(left, pa.binary())})
            return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())]).empty_table()

        out = blocks.groupBy("block").cogroup(verified.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text binary")
        return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def block_texts(sizes: list[int], blob: bytes) -> list[bytes]:
    import pyarrow as pa

    whole, ends = pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True), np.cumsum(sizes).tolist()
    return [whole[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def stored_blocks(docs: DataFrame, batch: int, window: int, anchor: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of about ``block_bytes`` of text, in the order the tasks read them: block, ids, sizes, texts (compressed), fingerprints, places."""
    schema = "block long, ids array<long>, sizes array<long>, texts binary, fingerprints array<long>, places array<long>"

    def run(batches):
        import pyarrow as pa

        block, ids, texts, size = (batch << 44) | (TaskContext.get().partitionId() << 24), [], [], 0

        def flush():
            prints, places = block_fingerprints(texts, window, anchor)
            row = {"block": [block], "ids": [ids], "sizes": [[len(t) for t in texts]], "texts": [pa.compress(b"".join(texts), codec="zstd", asbytes=True)], "fingerprints": [prints], "places": [places]}
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row.values(), (pa.int64(), longs, longs, pa.binary(), longs, longs), strict=True)], list(row))

        for found in batches:
            for i in range(found.num_rows):
                ids.append(found.column(0)[i].as_py())
                texts.append(found.column(1)[i].as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield flush()
                    block, ids, texts, size = block + 1, [], [], 0
        if texts:
            yield flush()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, index_path: str | None = None, batches: int = 2, n_parts: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text; null: no words).

    A word goes if a window of ``WINDOW`` words that covers it starts anywhere else with the
    same words: in ``docs``, or in what the index at ``index_path`` holds from before (None: a new, empty one).
    Documents enter the index in ``batches``, by a hash of their ids. Equal windows share an anchor, so only windows whose anchor a
    merge join of runs finds twice can repeat. Those are verified by 128 more bits of hashes of their words. Windows are judged on all
    batches, so these don't matter for the result. Documents taken in before lose what later ones repeat, too:
    ``FingerprintIndex(...).documents()`` has them. Texts of less than a window lose nothing; equal rows all lose what they share.
    An empty table gives no rows. Other columns are not read.
    """
    if index_path is None:
        index_path = f"{WorkFolder(docs.sparkSession, 'fingerprints').path}/index"
    rows = docs.select("doc_id", "text")
    if n_parts is None:
        n_parts = max(8, min(4096, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (64 << 20)))
    index = FingerprintIndex(docs.sparkSession, index_path, n_parts)
    taken = [index.add(rows.filter(F.pmod(F.hash("doc_id", F.lit(7)), F.lit(batches)) == b)) for b in range(batches)]
    return index.documents(taken)


#: The query's rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM dup, (SELECT unnest(range(0, 35)) AS o)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY 1),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
