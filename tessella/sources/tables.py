"""Reading and writing of panels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_panel(spark: SparkSession, path: str, schema: T.StructType, format: str = "csv") -> DataFrame:
    """Typed and tolerant: cells that don't read as their type, and NaN, are null; columns that the file lacks too."""
    raw = spark.read.option("header", True).csv(path) if format == "csv" else spark.read.format(format).load(path)
    return typed(raw, schema)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    out = []
    for f in schema.fields:
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        x = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        out.append(x.alias(f.name))
    return raw.select(*out)


def file_meta(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of ``pattern`` in each row's file path; empty where it doesn't match."""
    return df.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = (), format: str = "parquet") -> None:
    """An empty table still leaves a file with its schema."""
    w = df.write.mode("overwrite").format(format)
    (w.partitionBy(*partitions) if partitions else w).save(path)


def write_snapshot(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Each table into its folder under the version; other versions stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; only a local master may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """``df`` by ``keys`` in as many parts as shuffles have, and in more where ``rows`` rows come to over ``most`` a part: what a task sorts or groups doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)


class Stages:
    """Intermediate tables of one computation, as Parquet files in the shared folder: what follows starts from them, also when executors are lost."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, scratch(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def signature(df: DataFrame) -> DataFrame:
    """(rows, signature) of a table, whatever the order of its rows: a digest of the count and two sums of the rows' MD5, of their columns in order of names as text."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    part = lambda i: F.sum(F.conv(F.substring(F.md5(row), i, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), part(1).alias("a"), part(13).alias("b")).select("rows", F.sha2(F.concat_ws(":", "rows", "a", "b"), 256).alias("signature"))
