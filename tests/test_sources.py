import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import windows as W
from vigil.sources import archives, records, reports
from vigil.streaming.scoring import score_stream


@pytest.mark.parametrize(("layout", "width"), [("simple_software", 44), ("simple_hardware", 28), ("model_prediction", 32), ("features:26", 116), ("features:78", 324), ("reference", 48), ("reliability_software", 48), ("reliability_hardware", 32), ("fused", 48)])
def test_record_widths(layout, width):
    assert records.layout_of({"layout": layout}).itemsize == width


def test_records_round_trip(spark, tmp_path):
    spark.dataSource.register(records.FixedRecords)
    path = str(tmp_path / "timeline")
    rows = spark.range(5000).select(F.col("id").alias("timestamp_ms"), (F.col("id") / 7).cast("float").alias("shi"), F.lit(0.5).cast("float").alias("feature_distance"), F.array(*[F.col("id").cast("float")] * 3).alias("signal"))
    rows.repartition(3).write.format("fixedrec").option("layout", "simple_hardware").mode("append").save(path)
    back = spark.read.format("fixedrec").option("layout", "simple_hardware").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    files = list((tmp_path / "timeline").iterdir())
    assert sum(f.stat().st_size for f in files) == 5000 * 28 and all(f.name.startswith("part-") for f in files)
    with open(files[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="no multiple of 28"):
        spark.read.format("fixedrec").option("layout", "simple_hardware").load(path).count()


@pytest.fixture(scope="module")
def zips(tmp_path_factory):
    top = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(top / "Experiment_A1.zip", "w") as z:
        z.writestr("01_Experiment_A1/Test/Converted/UNIT_0001_RUN_001/temperature.csv", "timestamp_ms,value\n" + "".join(f"{i * 10},{math.sin(i / 20) + (5 if i >= 500 else 0)}\n" for i in range(800)))
        z.writestr("01_Experiment_A1/Converted/proc_gyroscope.csv", "﻿timestamp_ms,x,y,z\n1,1,2,3\n2,4,5,nan\n")
        z.writestr("01_Experiment_A1/Converted/.hidden/vibration.csv", "timestamp_ms,value\n1,1\n")
        z.writestr("01_Experiment_A1/Converted/current.csv", "time,value\n1,1\n")
        z.writestr("fast_data.bin", b"123")
    with zipfile.ZipFile(top / "26 run.zip", "w") as z:
        z.writestr("run/medium_data.bin", b"1234")
        z.writestr("run/slow_data.bin", b"")
    return top


def test_jobs(spark, zips):
    jobs = {(r["archive"], r["sensor"]): r for r in archives.discover_jobs(spark, str(zips)).collect()}
    assert set(jobs) == {("Experiment_A1.zip", "temperature"), ("Experiment_A1.zip", "gyroscope"), ("26 run.zip", "current"), ("26 run.zip", "photodiode")}
    t = jobs["Experiment_A1.zip", "temperature"]
    assert (t["axes"], t["source_format"], t["protocol"]["baseline"], t["protocol"]["fault_offset_s"]) == (1, "csv", "pre_fault", 300.0)
    assert jobs["Experiment_A1.zip", "gyroscope"]["axes"] == 3 and jobs["26 run.zip", "current"]["source_format"] == "bin"
    only = archives.discover_jobs(spark, str(zips), "a1", "TEMPERATURE", 5.0).collect()
    assert len(only) == 1 and only[0]["protocol"]["confidence"] == "manual"


def test_samples_of_archives(spark, zips, tmp_path):
    jobs = archives.discover_jobs(spark, str(zips))
    rows = archives.read_samples(spark, str(zips), jobs)
    assert {(r["axes"], r["n"]) for r in rows.groupBy("recording_id", "axes").agg(F.count("*").alias("n")).collect()} == {(1, 800), (3, 2)}
    windows = W.sliding_windows(rows.where("axes = 1"), 64, 16).collect()
    assert len(windows) == (800 - 64) // 16 + 1
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("Converted/current.csv", "timestamp_ms,value\n1,1\n2,zwei\n")
    bad = archives.discover_jobs(spark, str(tmp_path))
    with pytest.raises(Exception, match="invalid row 3 in Converted/current.csv"):
        archives.read_samples(spark, str(tmp_path), bad).collect()


def test_reports_and_publication(spark, tmp_path):
    for name, status in (("a", "success"), ("b", "failed"), ("_interrupted/c", "success")):
        reports.write_json(str(tmp_path / "jobs" / name / "job_report.json"), {"status": status, "outputs": [{"sensor": "current", "path": name, "rows": 5}]})
    assert json.loads((tmp_path / "jobs/a/job_report.json").read_text())["status"] == "success"
    rows = reports.read_reports(spark, str(tmp_path / "jobs"))
    assert rows.count() == 2
    assert [tuple(r) for r in reports.outputs_by_sensor(rows).select("sensor", "path", "available_rows").collect()] == [("current", "a", 5)]
    table, none = spark.range(3), spark.createDataFrame([], "job string")
    assert not reports.publish({"metrics": table}, spark.createDataFrame([("x",)], "job string"), str(tmp_path / "out"))
    assert not (tmp_path / "out/metrics").exists() and (tmp_path / "out/failures").exists()
    assert reports.publish({"metrics": table}, none, str(tmp_path / "fine"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fine/metrics")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema = "recording_id string, seq long, ts_ms long, x double"
    rows = [(k, i + 1, i * 10, float(v)) for k in "ab" for i, v in enumerate(rng.normal(0, 1 if k == "a" else 3, 100))]
    for part, (lo, hi) in enumerate(((0, 37), (37, 41), (41, 100))):
        spark.createDataFrame([r for r in rows if lo < r[1] <= hi], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = score_stream(stream, 0.9, 16, 4).writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["recording_id"], r["win_no"]): (r["end_ts"], r["rms"], r["ewma"], r["breach"], r["persistent"]) for r in spark.table("scored").collect()}
    want = {}
    for k in "ab":
        x = np.array([r[3] for r in rows if r[0] == k])
        ewma, before = 0.0, False
        for w in range((100 - 16) // 4 + 1):
            rms = float(np.sqrt((x[4 * w : 4 * w + 16] ** 2).mean()))
            ewma = 0.9 * ewma + 0.1 * rms
            want[k, w + 1] = ((4 * w + 15) * 10, pytest.approx(rms), pytest.approx(ewma), ewma > 0.9, ewma > 0.9 and before)
            before = ewma > 0.9
    assert got == want
