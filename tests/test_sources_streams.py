"""Files, generators and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.functions import time as tf
from lagoon.sources import generate, readers, writers
from lagoon.streaming import streams


def test_temporal_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("time,a,b\n2015-01-01 00:00:00, 1.5 ,2\nnot a time,1,2\n2015-01-01 00:05:00,x,3\n2015-01-01 00:10:00,1\n2015-01-01 00:15:00,4,\n")
    df, dims = readers.read_temporal_csv(spark, str(path), replace_na=-1.0)
    assert dims == 2 and [r["v"] for r in df.orderBy("ts").collect()] == [[1.5, 2.0], [-1.0, 3.0], [4.0, -1.0]]
    (tmp_path / "e.csv").write_text("")
    assert readers.read_temporal_csv(spark, str(tmp_path / "e.csv"))[0].collect() == []


def test_geo_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("t|lon|lat|x\n2015-01-01 00:00:00|1|2|3\n2015-01-01 00:00:01|1|?|3\n2015-01-01 00:00:02|5| 6 |7\n2015-01-01 00:00:03|5|6\n")
    df, dims = readers.read_geo_csv(spark, str(path), sep="|")
    assert dims == 1 and [tuple(r)[1:] for r in df.orderBy("ts").collect()] == [(1.0, 2.0, [3.0]), (5.0, 6.0, [7.0])]


def test_trip_detector_and_generic_files(spark, tmp_path):
    for name, day in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text(f'"Date/Time","Lat","Lon","Base"\n"4/{day}/2014 0:11:00",40.7,-73.9,"B02512"\n')
    trips = readers.read_trips(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [r["ts"].day for r in trips.orderBy("ts").collect()] == [1, 2]
    lanes = ",".join(str(i) for i in range(16))
    (tmp_path / "d.csv").write_text("Timestamp,Station ID," + ",".join(f"c{i}" for i in range(16)) + f"\n04/01/2014 00:00:00,S1,{lanes}\n")
    row = readers.read_detectors(spark, str(tmp_path / "d.csv")).first()
    assert row["station"] == "S1" and row["flow_8"] == 7.0 and row["occ_8"] == 15.0
    generic = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert generic.columns[1] == "Lat" and readers.described(generic).count() == 8


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "bin string, k long")
    writers.write_by_bin(df, str(tmp_path / "bins"), "bin")
    writers.write_wide(df, str(tmp_path / "wide"), "k")
    assert (tmp_path / "bins/bin=a").exists() and spark.read.option("header", True).csv(str(tmp_path / "wide")).count() == 2


def test_pictures(spark, tmp_path):
    from xml.dom import minidom

    cc = spark.createDataFrame([(lag, i, j, lag * 1.5 + i) for lag in range(-2, 3) for i in (0, 1) for j in (0, 1)], "lag int, i int, j int, value double")
    lines = lambda svg: [x.getAttribute("points").split() for x in minidom.parseString(svg).getElementsByTagName("polyline")]
    found = lines(writers.correlation_picture(cc, "a < b", str(tmp_path / "cc.svg")))
    assert [len(x) for x in found] == [5] * 4 and found[0][0] == "24.0,144.0" and found[0][-1] == "504.0,24.0"
    assert (tmp_path / "cc.svg").read_text().startswith("<svg")
    spectrum = cc.withColumnsRenamed({"lag": "freq_idx", "value": "magnitude"})
    assert len(lines(writers.spectrum_picture(spectrum))) == 4
    vector = spark.createDataFrame([("ar", 1, 0, 0, 0.5), ("ar", 2, 0, 0, None), ("ma", 1, 0, 0, 0.1), ("noise", 0, 0, 0, 1.0)], "kind string, lag int, i int, j int, value double")
    assert [len(x) for x in lines(writers.model_picture(vector))] == [1, 1]
    scalar = spark.createDataFrame([(0, "ar", 1, 0.5), (1, "ar", 1, 0.2)], "dim int, kind string, lag int, value double")
    assert len(lines(writers.model_picture(scalar))) == 2
    profile = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 2.0)], "bucket long, a double, b double")
    assert len(lines(writers.profile_picture(profile, ["a", "b"]))) == 2
    assert lines(writers.picture(cc.limit(0), "lag", "value", ["i"])) == []


def test_generators(spark):
    ones = generate.ones(spark, 2, 10, delta=4)
    assert [tuple(r) for r in ones.orderBy("t").collect()] == [(4 * i, 1.0, 1.0) for i in range(10)]
    n = 20_000
    u = generate.white_noise(spark, 1, n, kind="uniform", seed=1)
    lo, hi, mean, var = u.agg(F.min("v0"), F.max("v0"), F.avg("v0"), F.var_pop("v0")).first()
    assert -0.5 <= lo and hi <= 0.5 and abs(mean) < 5 / np.sqrt(12 * n) and abs(var - 1 / 12) < 0.003
    assert u.agg(F.sum("v0")).first() == generate.white_noise(spark, 1, n, kind="uniform", seed=1).agg(F.sum("v0")).first()
    a = spark.range(100).select(generate.hashed_noise(F.col("id"), 0, 1).alias("x"))
    assert a.agg(F.max(F.abs("x"))).first()[0] <= 0.5 and a.distinct().count() == 100
    phi, theta, m = [np.array([[0.5]])], [np.array([[0.3]])], np.array([2.0])
    e = np.arange(1.0, 5.0)[:, None]
    x = generate.simulate(4, phi, theta, e, m)[:, 0]
    ma = [1.0, 2 + 0.6, 3 + 1.2, 4 + 1.8]
    want = [ma[0]]
    for v in ma[1:]:
        want.append(v + want[-1])
    assert x == pytest.approx(want)
    assert generate.ones(spark, 1, 0).count() == 0


def test_ticks(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59' a, timestamp'2024-01-01 00:00:00' b, date'1970-01-02' c, 7L d")
    row = df.select(*(tf.micros(df, c) for c in "abcd")).first()
    assert tuple(row) == (-1_000_000, 1_704_067_200_000_000, 86_400_000_000, 7)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000001' a")
        assert gap.select(tf.micros(gap, "a")).first()[0] == 1_710_037_800_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tf.span("5m") == 300_000_000 and tf.span("h") == tf.MICROS["h"] and tf.span(3) == 3
    big = spark.range(1).select(tf.floor_div(F.lit(-(2**60) - 1), 7).alias("x"), tf.floor_div(F.lit(-1), 1).alias("y")).first()
    assert tuple(big) == ((-(2**60) - 1) // 7, -1)
    week = spark.sql("select timestamp'2024-01-01 00:00:00' t union all select timestamp'2024-01-02 00:06:00'")
    assert sorted(r[0] for r in week.select(tf.week_bucket(F.col("t"))).collect()) == [0, 289]


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), k, float(v)) for m, k, v in [(0, "a", 1), (1, "a", 2), (7, "a", 3), (40, "a", 4), (2, "b", 5), (300, "b", 6)]]
    schema = "ts timestamp, k string, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sums = run_stream(spark, streams.stream_resample(source(), "ts", "5 minutes", {"x": F.sum("v")}, ("k",)), "resampled")
    assert sorted((r["k"], r["x"]) for r in sums.collect()) == [("a", 3.0), ("a", 3.0), ("a", 4.0), ("b", 5.0)]
    slid = run_stream(spark, streams.stream_resample(source(), "ts", "10 minutes", {"n": F.count("*")}, slide="5 minutes"), "slid")
    assert slid.agg(F.sum("n")).first()[0] == 10
    ended = run_stream(spark, streams.stream_sessions(source(), "ts", "10 minutes", {"n": F.count("*")}, ("k",)), "sessions")
    assert sorted((r["k"], r["n"]) for r in ended.collect()) == [("a", 1), ("a", 3), ("b", 1)]
    ticks = source().withColumn("t", F.unix_seconds("ts"))
    got = run_stream(spark, streams.stream_ar_residuals(ticks, "k", "t", "v", [0.5]), "residuals")
    assert [r["residual"] for r in got.where("k = 'a'").orderBy("t").collect()] == [1.0, 1.5, 2.0, 2.5]
