"""Language-model scores by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, slices
from tessella.llm.words import Table, Words, mix

#: Bytes of context.
DEPTH = 6
#: Bytes of context by which subtrees are dealt to tasks; the nodes above are summed up by Spark.
TOP = 3
#: Bytes of text that are counted and scored together.
BUCKET_BYTES = 16 << 20
#: Lists of one chunk that meet in one task.
FANIN = 256
#: Bytes of text for each chunk of subtrees; chunks at most.
CHUNK_BYTES, MOST_CHUNKS = 4 << 20, 4096
#: Grams whose tree is in memory at once.
PART = 400_000
#: Stands before each text, as its first context, and after it, as its end: no UTF-8 text has this byte.
EDGE = b"\xff"
_BYTE = np.uint64(255)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def text_parts(texts: list[bytes], depth: int, most: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Each text with its edges, in parts of at most ``most`` bytes after ``depth`` bytes of context, and the text's number."""
    for i, text in enumerate(texts):
        whole = EDGE * depth + text + EDGE
        for at in range(0, len(whole) - depth, most):
            yield i, whole[at : at + most + depth]


def word_parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Each text in parts of at most ``most`` bytes, or of one longer word, cut at spaces, and the text's number."""
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            cut = text.rfind(b" ", at + 1, at + most)
            cut = cut if cut > 0 else text.find(b" ", at + most)
            if cut < 0:
                break
            yield i, text[at:cut]
            at = cut
        yield i, text[at:]


def grams(parts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte after the first ``depth`` of every part the number of its ``depth`` bytes of context, the nearest first, and itself; how many each part has.

    So the grams of one subtree are a range of numbers, at every depth.
    """
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    key = np.zeros(len(data) - depth, dtype=np.uint64)
    for i in [*range(depth - 1, -1, -1), depth]:
        key = (key << np.uint64(8)) | data[i : len(key) + i]
    n = np.array([len(t) - depth for t in parts])
    first = np.cumsum(n + depth) - (n + depth)
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    return key[at], n


def chunk_of(keys: np.ndarray, n_chunks: int, depth: int) -> np.ndarray:
    """All grams with the same last ``TOP`` bytes of context share a chunk, so that it holds whole subtrees from that depth on."""
    return (mix(keys >> np.uint64(8 * (depth - TOP + 1))) % np.uint64(n_chunks)).astype(np.int64)


def normal(text: bytes) -> bytes:
    """The text as its tokens: A-Z in lower case, the words joined by one space."""
    return b" ".join(text.lower().split())


def sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their ``n``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[start], np.add.reduceat(n[order], start) if len(key) else n


class Runs:
    """Sums by key, kept as sorted runs; a run is merged with the one before it unless that is twice as long."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.runs.append(sum_by(key, n))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            self._merge()

    def _merge(self) -> None:
        (a, n), (b, m) = self.runs.pop(), self.runs.pop()
        self.runs.append(sum_by(np.concatenate([b, a]), np.concatenate([m, n])))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.runs) > 1:
            self._merge()
        return self.runs[0] if self.runs else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def count_bucket(texts: list[bytes], held: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams, and the words by a hash, of the texts, each in rising order with its count in those not held out."""
    of_grams, of_words = Runs(), Runs()
    for owner, parts in numbered_slices(text_parts(texts, depth)):
        key, n = grams(parts, depth)
        of_grams.add(key, np.repeat(~held[owner], n).astype(np.int64))
    for owner, parts in numbered_slices(word_parts(texts)):
        words = Words(parts, lower=False)
        of_words.add(words.hash, np.repeat(~held[owner], np.diff(words.first)).astype(np.int64))
    return [of_grams.whole(), of_words.whole()]


def numbered_slices(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of consecutive parts of about a megabyte, with their numbers."""
    owners: list[int] = []

    def bodies():
        for i, part in parts:
            owners.append(i)
            yield part

    for first, some in slices(bodies()):
        yield np.array(owners[first : first + len(some)]), some


def packed(x: np.ndarray) -> bytes:
    """An array as its length and the planes of its bytes, compressed; ``unpacked`` reads it."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[4:], n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def packed_keys(key: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return packed(np.diff(key, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


class _Lookup:
    """Values by number; every number that is asked for has one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.table, self.values = Table(keys), values

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.table.find(keys)]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; about 1e-14 of the value for x of 1/2 and more."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def up(key: np.ndarray) -> np.ndarray:
    """The parents of nodes: those of one byte of context less, the same bits so far."""
    return ((key >> 16) << 8) | (key & 255)


class Level:
    """The nodes (context of one depth, the nearest byte first; bits so far) with counts, log KT probability e and log tree weight w.

    ``below`` is the sum of the children's w, None at full depth.
    """

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.n0, self.n1, self.e = key, n0, n1, kt_block(n0, n1)
        self.w = self.e if below is None else np.logaddexp(self.e, below) - np.log(2)
        self.stop = np.exp(self.e - self.w) * (1.0 if below is None else 0.5)

    def above(self) -> tuple[Level, np.ndarray]:
        """The nodes one byte of context less, and each node's parent."""
        key, parent = np.unique(up(self.key), return_inverse=True)
        add = lambda x: np.bincount(parent, x, len(key))
        return Level(key, add(self.n0), add(self.n1), add(self.w)), parent

    def read(self, mixed: np.ndarray, rest: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the path so far to this node's probability of a 1, and what its children go on from.

        mixed: what shorter contexts put in; rest: the share of trees that go on; shorter: the
        parent's probability, kept where no training data is left.
        """
        p = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        q = np.where(self.n0 + self.n1 > 0, mixed + rest * p, shorter)
        return mixed + rest * self.stop * p, rest * (1 - self.stop), q


def subtrees(grams_: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray], list[np.ndarray]]:
    """Levels ``top`` to ``depth`` of whole subtrees, each but the first's parents, and for each bit of a byte every gram's node; the grams rise."""
    byte, context = (grams_ & _BYTE).astype(np.int64), (grams_ >> np.uint64(8)).astype(np.int64)
    keys, n0, n1, at, first = [], [], [], [], 0
    for i in range(8):
        node = (context << 8) | (1 << i) | (byte >> (8 - i))
        new = np.concatenate([[True], node[1:] != node[:-1]])  # rising grams make rising nodes of one length
        start = np.flatnonzero(new)
        ones = np.add.reduceat(n * ((byte >> (7 - i)) & 1), start).astype(np.float64)
        keys.append(node[start])
        n1.append(ones)
        n0.append(np.add.reduceat(n, start) - ones)
        at.append((np.cumsum(new) + (first - 1)).astype(np.int32))
        first += len(start)
    levels, parents = [Level(np.concatenate(keys), np.concatenate(n0), np.concatenate(n1), None)], []
    for _ in range(depth - top):
        level, parent = levels[0].above()
        levels.insert(0, level)
        parents.insert(0, parent)
    return levels, parents, at


def ranges(grams_: np.ndarray, depth: int, d: int, part: int) -> list[tuple[int, int]]:
    """Ranges of whole contexts of ``d`` bytes, about ``part`` grams each (more if one context has more)."""
    context = grams_ >> np.uint64(8 * (depth - d + 1))
    start = np.concatenate([[0], np.flatnonzero(context[1:] != context[:-1]) + 1])
    start = start[np.flatnonzero(np.diff(start // part, prepend=-1))]
    return list(zip(start.tolist(), [*start[1:].tolist(), len(grams_)], strict=True))


def level_of(grams_: np.ndarray, n: np.ndarray, depth: int, d: int, part: int = PART) -> Level:
    """Level ``d`` of whole subtrees; of more than ``part`` grams the deeper levels are in memory for a part at a time."""
    if len(grams_) <= part or d == depth:
        return subtrees(grams_, n, depth, d)[0][0]
    found = [level_of(grams_[a:b], n[a:b], depth, d + 1, part) for a, b in ranges(grams_, depth, d + 1, part)]
    key, parent = np.unique(up(np.concatenate([x.key for x in found])), return_inverse=True)
    return Level(key, *(np.bincount(parent, np.concatenate(x), len(key)) for x in ([f.n0 for f in found], [f.n1 for f in found], [f.w for f in found])))


def sums_above(level: Level) -> tuple[np.ndarray, ...]:
    """What the level's nodes add to their parents: key (last bytes of context, bits so far), n0, n1, below."""
    key, parent = np.unique(up(level.key), return_inverse=True)
    return key, *(np.bincount(parent, x, len(key)) for x in (level.n0, level.n1, level.w))


def top_sums(grams_: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[np.ndarray, ...]:
    """What these subtrees, whole from depth ``top`` on, add to the nodes one level above."""
    return sums_above(level_of(grams_, n, depth, top))


def top_paths(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> np.ndarray:
    """mixed, rest and shorter for the children of every node of depth 1, at [:, last byte of context << 8 | bits so far]."""
    first = Level(key, n0, n1, below)
    root, parent = first.above()
    zero = np.zeros(len(root.key))
    path = first.read(*(x[parent] for x in root.read(zero, zero + 1, zero + 0.5)))
    out = np.zeros((3, 1 << 16))
    out[:, key] = np.stack(path)
    return out


def gram_values(grams_: np.ndarray, n: np.ndarray, keys: np.ndarray, path: np.ndarray, depth: int, d: int = 2, part: int = PART) -> np.ndarray:
    """log10 of the model's probability of each gram's last byte after the others; ``path`` is what the nodes ``keys``, one level above ``d``, hand on."""
    handed = lambda node: path[:, np.searchsorted(keys, up(node))]
    if len(grams_) > part and d < depth:
        level = level_of(grams_, n, depth, d, part)
        here = np.stack(level.read(*handed(level.key)))
        return np.concatenate([gram_values(grams_[a:b], n[a:b], level.key, here, depth, d + 1, part) for a, b in ranges(grams_, depth, d + 1, part)])
    levels, parents, at = subtrees(grams_, n, depth, d)
    step = handed(levels[0].key)
    for i, level in enumerate(levels):
        step = level.read(*(step if i == 0 else [x[parents[i - 1]] for x in step]))
    total = np.zeros(len(grams_))
    for i in range(8):
        q = step[2][at[i]]
        total += np.log10(np.where((grams_ >> np.uint64(7 - i)) & np.uint64(1) == 1, q, 1 - q))
    return total


def score_bucket(texts: list[bytes], words: _Lookup, model: _Lookup, depth: int = DEPTH) -> np.ndarray:
    """A row each for words, known words, the sum of log10(count + 1) of the words, and the sum of the grams' values, of each text."""
    out = np.zeros((4, len(texts)))
    for owner, parts in numbered_slices(word_parts(texts)):
        found = Words(parts, lower=False)
        n = words(found.hash).astype(np.float64)
        whose = np.repeat(owner, np.diff(found.first))
        for i, x in enumerate((np.ones(len(n)), n > 0, np.log10(n + 1))):
            out[i] += np.bincount(whose, x, len(texts))
    for owner, parts in numbered_slices(text_parts(texts, depth)):
        key, n = grams(parts, depth)
        out[3] += np.bincount(owner, np.add.reduceat(model(key).astype(np.float64), np.cumsum(n) - n), len(texts))
    return out


def score_documents(docs: DataFrame, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES, fanin: int = FANIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs`` (doc_id, text).

    The text is modelled as its token sequence: A-Z lower-cased, words joined by one
    space, then an end. At each node (context of d bytes, bits so far) the training counts give the
    Krichevsky-Trofimov block probability e; w = (e + product of the children's w) / 2, or e at
    full depth, is the context-tree weight. A bit's probability mixes the KT estimates of the
    nodes on its path, each by the posterior share e / (2 w) of trees that end there; where training data end, so does the path.

    1. Each task cuts its documents into buckets of about ``bucket_bytes`` of text, and writes their texts, and their
       grams and words with counts in lists by chunk: a chunk has whole subtrees, or words by a hash.
    2. Lists of a chunk are added up ``fanin`` at a time, level by level, until one task can take those that are left:
       it reads no list of a bucket, so a common subtree doesn't grow with the number of buckets.
    3. A chunk's subtrees begin at depth ``TOP``. What they add to the nodes above is summed up by Spark, level by level; only the at most 65,280
       nodes of depth 1 pass through the driver.
    4. Each chunk's values go back down the same levels to the lists of the buckets, which meet their texts.

    Trees are in memory for ``PART`` grams at a time. A word is known by 64 bits. Every row is scored: repeated rows and
    ids each by themselves, and counted as often as they stand. A null text is empty: its score is that of the end
    alone. A null doc_id is not held out. An empty table gives no rows. Other columns are not read.
    """
    spark, work = docs.sparkSession, WorkFolder(docs.sparkSession, "context-tree")
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n_chunks = min(MOST_CHUNKS, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK_BYTES + 1)
    of_words = lambda chunk: chunk >= n_chunks
    counted = pa.schema([("bucket", pa.int64()), ("chunk", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def count(batches):
        bucket, size = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list = []
        texts: list[bytes] = []

        def flush():
            nonlocal bucket, size
            whole = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "ids": ids, "held": held, "sizes": [len(t) for t in texts], "texts": whole}], counted)
            for kind, (key, n) in enumerate(count_bucket(texts, np.array(held, dtype=bool), depth)):
                chunk = (mix(key) % np.uint64(n_chunks)).astype(np.int64) + n_chunks if kind else chunk_of(key, n_chunks, depth)
                order = np.argsort(chunk, kind="stable")
                chunk, key, n = chunk[order], key[order], n[order]
                start = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
                lists = [{"bucket": bucket, "chunk": int(chunk[a]), "keys": packed_keys(key[a:b]), "n": packed(n[a:b])} for a, b in zip(start, [*start[1:], len(key)], strict=True)]
                if lists:
                    yield pa.RecordBatch.from_pylist(lists, counted)
            bucket, size = bucket + 1, 0
            for x in (ids, held, texts):
                x.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(1)[i].as_py())
                texts.append(normal(batch.column(2)[i].as_py()))
                size += len(texts[-1])
                if size >= bucket_bytes:
                    yield from flush()
        if texts:
            yield from flush()

    counts = work.cut(rows.mapInArrow(count, "bucket long, chunk int, keys binary, n binary, ids array<long>, held array<boolean>, sizes array<long>, texts binary"), "counts")
    texts = counts.filter("chunk IS NULL").select("bucket", "ids", "held", "sizes", "texts")
    levels, groups = [counts.filter("chunk IS NOT NULL").select("bucket", "chunk", "keys", "n")], texts.count()

    def merged(table):
        runs = Runs()
        for k, n in zip(table.column("keys"), table.column("n"), strict=True):
            runs.add(unpacked_keys(k.as_py()), unpacked(n.as_py(), np.int64))
        return runs.whole()

    def add(key, table):
        keys, n = merged(table)
        return pa.table({"bucket": pa.array([key[1].as_py()], pa.int64()), "chunk": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([packed_keys(keys)]), "n": pa.array([packed(n)])})

    while groups > fanin:
        groups = -(-groups // fanin)
        levels[-1] = levels[-1].withColumn("group", F.pmod(F.xxhash64(F.lit(groups), "bucket"), F.lit(groups)))
        levels.append(work.cut(levels[-1].groupBy("chunk", "group").applyInArrow(add, "bucket long, chunk int, keys binary, n binary"), f"counts{groups}"))

    def tops(key, table):
        keys, n = merged(table)
        node, *sums = ([-1], [np.count_nonzero(n)], [0], [0]) if of_words(key[0].as_py()) else top_sums(keys, n, depth, TOP)
        return pa.table({"chunk": pa.array(np.full(len(node), key[0].as_py()), pa.int32()), "node": pa.array(node, pa.int64()), **{c: pa.array(x, pa.float64()) for c, x in zip(("n0", "n1", "below"), sums, strict=True)}})

    def level(batch):
        """The nodes of a batch (node, n0, n1, below)."""
        return Level(*(batch.column(i).to_numpy() for i in range(4)))

    def lift(batches):
        for batch in batches:
            if batch.num_rows:
                key, *sums = sums_above(level(batch))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(x, pa.float64()) for x in sums)], ["node", "n0", "n1", "below"])

    def lower_(batches):
        for batch in batches:
            if batch.num_rows:
                handed = level(batch).read(*paths.value[:, up(batch.column(0).to_numpy())])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in handed)], ["node", "mixed", "rest", "shorter"])

    # nodes of depth TOP - 1 by chunk: no more than there are nodes of depth TOP, each of which is in one chunk
    sums, added = "node long, n0 double, n1 double, below double", [F.sum(c).alias(c) for c in ("n0", "n1", "below")]
    by_chunk = work.cut(levels[-1].groupBy("chunk").applyInArrow(tops, f"chunk int, {sums}"), "nodes")
    distinct = int(by_chunk.filter("node < 0").agg(F.sum("n0")).first()[0] or 0)
    by_node = work.cut(by_chunk.filter("node >= 0").groupBy("node").agg(*added), "tops")
    nodes = by_node.mapInArrow(lift, sums).groupBy("node").agg(*added).orderBy("node").collect()
    paths = spark.sparkContext.broadcast(top_paths(np.array([r[0] for r in nodes], dtype=np.int64), *(np.array([r[i] for r in nodes], dtype=np.float64) for i in (1, 2, 3))))
    handed = by_chunk.filter("node >= 0").select("chunk", "node").join(by_node.mapInArrow(lower_, "node long, mixed double, rest double, shorter double"), "node")

    def answered(table, key, value):
        """The lists of ``table`` with the values of their keys."""
        each = [packed(value[np.searchsorted(key, unpacked_keys(k.as_py()))]) for k in table.column("keys")]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "keys": table.column("keys"), "value": pa.array(each, pa.binary())})

    def values(key, table, above):
        keys, n = merged(table)
        if of_words(key[0].as_py()):
            return answered(table, keys, n)
        above = above.sort_by("node")
        path = np.stack([above.column(c).to_numpy() for c in ("mixed", "rest", "shorter")])
        return answered(table, keys, gram_values(keys, n, above.column("node").to_numpy(), path, depth, TOP).astype(np.float32))

    def hand_down(key, table, model):
        kind = np.int64 if of_words(key[0].as_py()) else np.float32
        return answered(table, unpacked_keys(model.column("keys")[0].as_py()), unpacked(model.column("value")[0].as_py(), kind))

    schema = "bucket long, chunk int, keys binary, value binary"
    model = levels[-1].groupBy("chunk").cogroup(handed.groupBy("chunk")).applyInArrow(values, schema)
    for lower in reversed(levels[:-1]):
        model = lower.groupBy("chunk", "group").cogroup(model.groupBy("chunk", "bucket")).applyInArrow(hand_down, schema)

    def score(texts, model):
        looks = []
        for words, kind in ((False, np.float32), (True, np.int64)):
            some = [i for i, c in enumerate(model.column("chunk").to_pylist()) if of_words(c) == words]
            read = lambda c, f: np.concatenate([f(model.column(c)[i].as_py()) for i in some]) if some else f(packed(np.zeros(0, dtype=np.uint64)))  # noqa: E731, B023
            looks.append(_Lookup(read("keys", unpacked_keys), read("value", lambda b: unpacked(b, kind))))  # noqa: B023
        sizes = texts.column("sizes")[0].as_py()
        whole, ends = pa.decompress(texts.column("texts")[0].as_py(), sum(sizes), codec="zstd", asbytes=True), np.cumsum(sizes).tolist()
        found = score_bucket([whole[e - n : e] for e, n in zip(ends, sizes, strict=True)], looks[1], looks[0], depth)
        columns = [texts.column(c).combine_chunks().flatten() for c in ("ids", "held")]
        return pa.table([*columns, *(pa.array(x.astype(np.int64)) for x in found[:2]), *(pa.array(x) for x in found[2:]), pa.array(sizes, pa.int64())], ["doc_id", "held_out", "n_words", "n_known", "base", "score", "size"])

    scored = texts.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(score, "doc_id long, held_out boolean, n_words long, n_known long, base double, score double, size long")
    scored = work.cut(scored.withColumn("n_tokens", F.col("n_words") + 1), "documents")
    work.drop("counts")
    trained = F.when(~F.col("held_out"), F.col("n_tokens"))
    n, ends = scored.agg(F.sum(trained), F.count(trained)).first()
    n, distinct, known_end = n or 0, distinct + (1 if ends else 0), 1 if ends else 0
    base = F.col("base") + float(np.log10(ends + 1)) - F.col("n_tokens") * F.lit(float(np.log10(n + distinct + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known_end).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("size") + 1)).alias("bits_per_byte"))
