"""Readers and writers of the file formats: wide CSV and NetCDF ensembles, control-run text, parameter and result tables."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import netcdf

RESULT_KEYS = ["scenario", "ensemble_member", "variables", "regressed_years"]
#: A parameter table is parsed on the driver; a longer file is not one.
MOST_PARAMETER_LINES = 1000


def read_wide_csv(spark: SparkSession, path: str, time: str, keep: str = ".*", rename: dict[str, str] | None = None, name: str = "member") -> DataFrame:
    """Rows (name, t, value) of a CSV with one time column and one column for each series; ``keep`` is a pattern of their headers."""
    wide = spark.read.csv(path, header=True)
    series = [c for c in wide.columns if c != time and re.search(keep, c)]
    if not series:
        raise ValueError(f"no column of {path} matches {keep!r}")
    to = rename or {}
    cast = wide.select(F.floor(F.col(f"`{time}`").cast("double")).cast("int").alias("t"), *(F.col(f"`{c}`").cast("double").alias(to.get(c, c)) for c in series))
    return cast.unpivot("t", [F.col(f"`{to.get(c, c)}`") for c in series], name, "value").filter(F.col("value").isNotNull())


def read_control_text(spark: SparkSession, path: str, region: str = "WORLD") -> DataFrame:
    """model, experiment, member, t, value from control-run files at any depth.

    A file's name gives its metadata, split by ``_``; its table starts after the row that begins with YEARS and
    names the regions, whose places differ between files. One row of text for each file: files are small and many.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.MAG")
    named = files.select(F.split(F.element_at(F.split("_metadata.file_path", "/"), -1), "_").alias("name"), F.split("value", r"\r?\n").alias("lines"))
    header = F.array_position(F.transform("lines", lambda x: F.trim(x).startswith("YEARS")), True).cast("int")
    placed = named.withColumn("header", header).filter("header > 0")
    place = F.array_position(F.split(F.trim(F.element_at("lines", F.col("header"))), r"\s+"), region).cast("int")
    rows = placed.select("name", place.alias("place"), F.explode(F.slice("lines", F.col("header") + 1, F.size("lines"))).alias("line")).filter("place > 0")
    cells = F.split(F.trim("line"), r"\s+")
    part = lambda i: F.try_element_at("name", F.lit(i))
    return rows.filter(F.trim("line").rlike(r"^-?\d+\s")).select(part(4).alias("model"), part(5).alias("experiment"), part(6).alias("member"), cells[0].cast("int").alias("t"), F.try_element_at(cells, F.col("place")).cast("double").alias("value"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """model, box, d, q from a table with two header rows (model, box) and rows d and q."""
    lines = [x.value for x in spark.read.text(path).limit(MOST_PARAMETER_LINES + 1).collect()]
    if len(lines) > MOST_PARAMETER_LINES:
        raise ValueError(f"{path} is too long for a parameter table")
    rows = [r for r in csv.reader(lines) if r]
    models, boxes, values = rows[0][1:], rows[1][1:], {r[0]: r[1:] for r in rows[2:]}
    out = [(m, int(re.sub(r"\D", "", b)), float(d), float(q)) for m, b, d, q in zip(models, boxes, values["d"], values["q"], strict=True)]
    return spark.createDataFrame(out, "model string, box int, d double, q double")


def write_results(df: DataFrame, path: str, keys: list[str] = RESULT_KEYS) -> None:
    """Into a table partitioned by the run keys; only the partitions at hand are replaced. An empty frame writes nothing."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Columns of the table of finished runs.
FINISHED = [*RESULT_KEYS, "samples", "repeat", "run_id"]


def mark_finished(spark: SparkSession, path: str, keys: dict[str, str], run_id: str) -> None:
    """Appends a run to the table of finished ones, after its results."""
    row = {**keys, "run_id": run_id}
    spark.createDataFrame([tuple(row[c] for c in FINISHED)], ", ".join(f"{c} string" for c in FINISHED)).coalesce(1).write.mode("append").parquet(f"{path}/finished")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The finished runs of a folder of results; none where there is no such table yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/finished")
    schema = ", ".join(f"{c} string" for c in FINISHED)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/finished")


def catalog(spark: SparkSession, path: str, keys: list[str] = RESULT_KEYS) -> DataFrame:
    """The distinct runs of a result table, from its partitions."""
    return spark.read.parquet(path).select(*keys).distinct()


def write_result_csv(df: DataFrame, path: str, index: str = "Year") -> None:
    """One wide CSV file with header rows variable and percentile, from (label, variable, percentile, value); a report, so a few columns."""
    columns = [(r.variable, r.percentile) for r in df.select("variable", "percentile").distinct().orderBy("variable", "percentile").collect()]
    cell = lambda v, q: F.max(F.when((F.col("variable") == v) & (F.col("percentile") == q), F.col("value"))).cast("string")
    body = df.groupBy("label").agg(*(cell(v, q).alias(f"c{i}") for i, (v, q) in enumerate(columns))).select(F.lit(3).alias("part"), F.col("label").cast("string").alias("label"), *(f"c{i}" for i in range(len(columns))))
    head = df.sparkSession.createDataFrame([(0, "variable", *(v for v, _ in columns)), (1, "percentile", *(f"{q:g}" for _, q in columns)), (2, index, *([""] * len(columns)))], body.schema)
    head.union(body).coalesce(1).sortWithinPartitions("part", "label").drop("part").write.mode("overwrite").csv(path, emptyValue="")


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """label, variable, percentile, value from a CSV with those header rows."""
    raw = spark.read.csv(path)
    names = raw.columns
    rows = raw.filter(F.col(names[0]).isin("variable", "percentile")).collect()
    head = {r[0]: list(r)[1:] for r in rows}
    body = raw.filter(~F.col(names[0]).isin("variable", "percentile") & F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names[1:])).isNotNull())
    entries = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(float(q)).alias("percentile"), F.col(c).cast("double").alias("value")) for v, q, c in zip(head["variable"], head["percentile"], names[1:], strict=True)))
    return body.select(F.col(names[0]).alias("label"), F.explode(entries).alias("x")).select("label", "x.variable", "x.percentile", "x.value")


def read_netcdf(spark: SparkSession, path: str, variables: dict[str, str], dims: list[str] | None = None) -> DataFrame:
    """variable (renamed), one column for each dimension (renamed by position where ``dims`` are given), value, from classic NetCDF files; see ``netcdf``."""
    netcdf.register(spark)
    raw = spark.read.format(netcdf.NAME).option("variables", ",".join(variables)).load(path)
    own = raw.columns[1:-1]
    if dims and len(dims) != len(own):
        raise ValueError(f"{path} has the dimensions {own}, not {dims}")
    names = F.create_map(*(F.lit(x) for kv in variables.items() for x in kv))
    return raw.filter("value is not null").select(names[F.col("variable")].alias("variable"), *(F.col(f"`{o}`").alias(d) for o, d in zip(own, dims or own, strict=True)), "value")
