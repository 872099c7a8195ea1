"""Small results that a plan reads more than once, written so that the large table behind them is scanned once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; in a local one only where a local session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []
_named: list[str] = []


def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """``df`` from a table in the shared folder; ``forget`` deletes it."""
    path = shared_path(df.sparkSession, "stored")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, placed: bool = False) -> DataFrame:
    """``df`` from a table in the shared folder whose rows are laid out by a hash of the keys, each of the buckets one file.

    Joins and groups by all of these keys read tables of as many buckets without an exchange. ``placed``: the rows stand in
    that many partitions by the keys already. ``forget`` deletes it.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "bucketed")
    name = f"stored_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    _written.append(path)
    _named.append(name)
    return spark.table(name)


def observed(df: DataFrame, rows_a_file: int = 0, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows that are taken while they are written, without a job of their own.

    They stand right below the write, in the stage whose tasks count once however often they are run, so lost executors do not change them.
    """
    seen = Observation()
    table = stored(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), rows_a_file)
    return table, seen.get


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this process has stored; frames that read them end with it."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
