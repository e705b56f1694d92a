import numpy as np
from pyspark.sql import functions as F

from shapeflow.sources import series as src
from shapeflow.streaming import early_decision, windows


def test_text_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.5])], "series_id long, x array<double>")
    src.write_matrix(s, str(tmp_path / "m"))
    got = {r["series_id"]: r["x"] for r in src.load_series(spark, str(tmp_path / "m"), epsilon=0.0).collect()}
    assert got == {1: [1.0, 2.0], 2: [3.0, 4.5]}
    mask = spark.createDataFrame([(1, True), (2, False)], "series_id long, keep boolean")
    assert [r["series_id"] for r in src.load_series(spark, str(tmp_path / "m"), mask).collect()] == [1]


def test_features_need_a_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# id REF TOTAL\n7 1.5 2\n")
    (tmp_path / "b.txt").write_text("7 1.5 2\n")
    assert src.load_features(spark, str(tmp_path / "a.txt")).first().asDict() == {"series_id": 7, "REF": 1.5, "TOTAL": 2.0}
    assert src.load_features(spark, str(tmp_path / "b.txt")) is None
    (tmp_path / "c.txt").write_text("7 1\n8 0\n")
    assert src.load_vector(spark, str(tmp_path / "c.txt")).count() == 2


def test_long_and_short_series_agree(spark, monkeypatch):
    d = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (2, 2)], "k long, b int")
    wide = {r["series_id"]: r["x"] for r in src.build(d, "k", F.col("b"), 4).collect()}
    monkeypatch.setattr(src, "WIDE", 0)
    assert {r["series_id"]: r["x"] for r in src.build(d, "k", F.col("b"), 4).collect()} == wide == {1: [2, 0, 0, 1], 2: [0, 0, 1, 0]}


def test_stream_decides_once(spark, tmp_path):
    rows = [(1, f"2024-01-0{i + 1} 00:00:00", i, v) for i, v in enumerate([5.0, 1.0, 5.0, 1.0])]
    spark.createDataFrame(rows, "series_id long, ts string, place int, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("series_id long, ts timestamp, place int, value double").parquet(str(tmp_path / "in"))
    refs = np.array([[1.0, 1.0, 1.0, 1.0], [5.0, 1.0, 5.0, 1.0]])
    q = early_decision.decide(points, refs, [0, 1], {0: 0.55, 1: 0.52}, {0: 1, 1: 2}, gamma_max=4).writeStream.format("memory").queryName("decided").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("decided").collect()
    assert len(got) == 1 and got[0]["label"] == 1


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'a' k, 1D value union all select timestamp '2024-01-01 05:00:00', 'a', 2D").write.parquet(str(tmp_path / "in"))
    e = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "in"))
    q = windows.counts(e, "k").writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").where("n = 1").count() >= 1
