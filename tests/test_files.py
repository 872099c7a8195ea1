"""Round trips of the file formats, and streams."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files
from plumbline.streaming import refresh


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Time,Realization 1,Realization 2,Lower\n1850,0.1,0.2,9\n1851.5,,0.4,9\n")
    got = files.read_wide_csv(spark, str(tmp_path / "w.csv"), "Time", "Realization", {"Realization 1": "r1"})
    assert sorted((r.member, r.t, r.value) for r in got.collect()) == [("Realization 2", 1850, 0.2), ("Realization 2", 1851, 0.4), ("r1", 1850, 0.1)]
    with pytest.raises(ValueError):
        files.read_wide_csv(spark, str(tmp_path / "w.csv"), "Time", "nothing")


def test_control_text(spark, tmp_path):
    at = tmp_path / "a" / "b"
    at.mkdir(parents=True)
    (at / "x_tas_Amon_MODEL-A_piControl_r1i1p1_gn.MAG").write_text("header\n&NML\n/\n   VARIABLE  tas tas\n   UNITS K K\n   YEARS   NH   WORLD\n   1850  1.5  287.5\n   1851  1.6  287.6\n")
    (at / "note.txt").write_text("YEARS WORLD\n1 2\n")
    got = files.read_control_text(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.model, r.experiment, r.member, r.t, r.value) for r in got] == [("MODEL-A", "piControl", "r1i1p1", 1850, 287.5), ("MODEL-A", "piControl", "r1i1p1", 1851, 287.6)]


def test_parameters(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",M1,M1,M2\n,box 1,box 2,1\nd,1.5,20,3\nq,0.1,0.2,0.3\n")
    assert sorted(tuple(r) for r in files.read_parameters(spark, str(tmp_path / "p.csv")).collect()) == [("M1", 1, 1.5, 0.1), ("M1", 2, 20.0, 0.2), ("M2", 1, 3.0, 0.3)]


def test_results(spark, tmp_path):
    rows = [("s1", "all", "GHG", "a-b", str(y), "Tot", q, y * q) for y in (2000, 2001) for q in (5.0, 50.0)]
    df = spark.createDataFrame(rows, "scenario string, ensemble_member string, variables string, regressed_years string, label string, variable string, percentile double, value double")
    at = str(tmp_path / "results")
    files.write_results(df, at)
    files.write_results(df.withColumn("scenario", F.lit("s2")), at)
    files.write_results(df.filter("value = 2000 * 5"), at)  # replaces s1 only
    files.write_results(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert files.catalog(spark, at).count() == 2 and spark.read.parquet(at).filter("scenario = 's1'").count() == 1
    files.write_result_csv(df.select("label", "variable", "percentile", "value"), str(tmp_path / "csv"))
    back = files.read_result_csv(spark, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[4], r[5], r[6], r[7]) for r in rows)


def test_stream_of_sums(spark, tmp_path):
    at = str(tmp_path / "in")
    df = spark.createDataFrame([("a", float(i), 3.0 * i + 1) for i in range(20)], "k string, x double, y double")
    for part in range(2):
        df.filter(F.col("x") % 2 == part).write.mode("append").parquet(at)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = refresh.sums(stream, ["k"]).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        q.processAllAvailable()
        got = refresh.slopes(spark.table("sums"), ["k"]).first()
    finally:
        q.stop()
    assert math.isclose(got.slope, 3) and math.isclose(got.level, 1)
    assert refresh.windowed_means(spark.createDataFrame([("a", "2020-01-01 00:00:00", 2.0)], "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts")), "ts", "1 hour", "1 minute", ["k"]).first().mean == 2.0
