"""What the corpus operators share: the shared work folder, word patterns, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; a folder of this machine is made for it then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has ended, not when the driver's memory is cleared."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class WorkFolder:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    ``cut`` writes a table and reads it back, so that later steps start from
    files that outlive any executor; ``drop`` removes tables that no later step
    reads. What an operator's result reads stays until the folder's owner
    clears it. Shuffle files of a written table are removed at once.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            at = hadoop(f"{self.path}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def boxed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column, ``row``, beside which no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def in_row(name: str) -> Column:
    """A column of a boxed row."""
    return F.col("row").getField(name)


def unboxed(rows: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``row`` as they were, those named in ``new`` by these."""
    return rows.select(*[new.get(f.name, in_row(f.name)).alias(f.name) for f in rows.schema["row"].dataType.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    bare = F.regexp_replace(text, rf"^{GAP}|{GAP}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_draw(seed: int, *keys: Column) -> Column:
    """A draw from the open interval (0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def slices(blobs: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive blobs of about ``most`` bytes, one blob at least, with the first one's number."""
    first, size, run = 0, 0, []
    for i, blob in enumerate(blobs):
        if run and size + len(blob) > most:
            yield first, run
            first, size, run = i, 0, []
        run.append(blob)
        size += len(blob)
    if run:
        yield first, run


def whole_groups(batches: Iterable) -> Iterator:
    """Tables that each hold whole runs of equal values of the first column, a long or a string; the batches are sorted by it.

    No more than one batch and one run is held at a time.
    """
    import pyarrow as pa

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([left, now]) if left is not None else now
        keys = now.column(0).combine_chunks().to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            yield now.slice(0, int(change[-1]) + 1).combine_chunks()
            now = now.slice(int(change[-1]) + 1).combine_chunks()
        left = now
    if left is not None:
        yield left.combine_chunks()


class Sieve:
    """A Bloom filter of 8 MB over longs, for scans that need the rows of some ids: it lets all of these pass, and few others.

    Its size doesn't grow with the ids: beyond some ten million of them it passes more of the others, so what
    reads its output must not rely on it. At most 2**20 numbers reach the driver.
    """

    BITS, TIMES = 26, 3

    def __init__(self, ids: DataFrame) -> None:
        found = ids.mapInArrow(self._words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.BITS - 6), dtype=np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    @classmethod
    def _places(cls, ids: np.ndarray) -> np.ndarray:
        from tessella.llm.words import mix

        return np.stack([mix(ids.astype(np.int64).view(np.uint64) + np.uint64(i << 60)) >> np.uint64(64 - cls.BITS) for i in range(1, cls.TIMES + 1)])

    @classmethod
    def _words(cls, batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = np.unique(cls._places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)).ravel())
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            start = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(bit, start) if len(start) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[start], pa.int64()), pa.array(bits.view(np.int64), pa.int64())], ["word", "bits"])

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be among those of the filter."""
        at = self._places(ids)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
