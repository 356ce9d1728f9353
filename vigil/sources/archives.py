"""Sensor recordings in zip archives: the jobs they hold, and their samples.

Archives are read with Spark's binaryFile source, so from any store; one archive is one row and one task's work.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import IMU, TIERS
from vigil.functions.shipping import ship
from vigil.operators import rules as R

HEADERS = {"timestamp_ms,value": 1, "timestamp_ms,x,y,z": 3}


def _archives(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every file in the archives, with the axes that a known header promises (0: none)."""
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    axes = 0
                    if info.filename.lower().endswith(".csv"):
                        with z.open(info) as f:
                            axes = HEADERS.get(f.readline().decode("utf-8-sig", "replace").strip(), 0)
                    rows.append((path, info.filename, info.file_size, f"{info.CRC:08x}", axes))
            yield pd.DataFrame(rows, columns=["path", "member", "uncompressed_bytes", "crc32", "header_axes"])


def discover_jobs(spark: SparkSession, path: str, archive_filter: str = "", member_filter: str = "", override: float | None = None) -> DataFrame:
    """One row per recording: job_id, archive, member, sensor, axes, source_format, uncompressed_bytes, crc32, protocol, path.

    Converted CSV files of known sensors are taken; an archive without any gives a job per sensor of its raw tier files.
    """
    m = F.col("member")
    found = _archives(spark, path).select("path", "content").mapInPandas(_members, "path string, member string, uncompressed_bytes long, crc32 string, header_axes int")
    found = found.withColumn("archive", F.element_at(F.split("path", "/"), -1))
    found = found.where(F.contains(F.lower("archive"), F.lit(archive_filter.lower())) & F.contains(F.lower(m), F.lit(member_filter.lower())))
    csv = found.where(R.valid_member(m) & (F.col("header_axes") > 0)).withColumn("sensor", R.member_sensor(m)).withColumn("axes", F.col("header_axes")).withColumn("source_format", F.lit("csv"))
    tiers = F.create_map(*[c for k, v in TIERS.items() for c in (F.lit(f"{k}_data.bin"), F.array(*[F.lit(s) for s in v]))])
    parts = F.split(F.lower(m), "/")
    raw = found.where((F.col("uncompressed_bytes") > 0) & ~F.exists(parts, lambda p: p.startswith("."))).join(csv.select("path").distinct(), "path", "left_anti")
    raw = raw.withColumn("sensor", F.explode(F.try_element_at(tiers, F.element_at(parts, -1)))).withColumn("axes", F.when(F.col("sensor").isin(*IMU), 3).otherwise(1)).withColumn("source_format", F.lit("bin"))
    identity = F.when(F.col("source_format") == "csv", R.job_id(F.col("archive"), m)).otherwise(R.job_id(F.col("archive"), m, F.col("sensor")))
    jobs = csv.unionByName(raw).withColumn("job_id", identity).withColumn("protocol", R.protocol(m, F.lit(override).cast("double")))
    return jobs.select("job_id", "archive", "member", "sensor", "axes", "source_format", "uncompressed_bytes", "crc32", "protocol", "path")


def _samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content, jobs in zip(frame["content"], frame["jobs"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for job in jobs:
                    with z.open(job["member"]) as f:
                        yield from _rows(job["job_id"], job["member"], f)


def _rows(job_id: str, member: str, f: io.BufferedIOBase) -> Iterator[pd.DataFrame]:
    done = 0
    for chunk in pd.read_csv(f, encoding="utf-8-sig", chunksize=100_000, dtype=str, keep_default_na=False):
        names = list(chunk.columns)
        if ",".join(names) not in HEADERS:
            raise ValueError(f"unsupported columns {names} in {member}")
        times = pd.to_numeric(chunk["timestamp_ms"], errors="coerce")
        values = [pd.to_numeric(chunk[c], errors="coerce") for c in names[1:]]
        bad = times.isna() | (times % 1 != 0)
        for c, v in zip(names[1:], values, strict=True):
            bad |= v.isna() & (chunk[c].str.strip().str.lower() != "nan")
        if bad.any():
            raise ValueError(f"invalid row {done + int(bad.to_numpy().argmax()) + 2} in {member}")
        out = pd.DataFrame({"recording_id": job_id, "seq": range(done + 1, done + len(chunk) + 1), "ts_ms": times.astype("int64").to_numpy(), "axes": len(values)})
        for name, v in zip("xyz", [*values, *[0.0] * (3 - len(values))], strict=True):
            out[name] = v.to_numpy(float) if hasattr(v, "to_numpy") else v
        done += len(chunk)
        yield out


def read_samples(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """Samples (recording_id = job_id, seq, ts_ms, axes, x, y, z) of CSV jobs; axes that aren't there are 0.

    A row that is no number fails with its line; so does another header.
    """
    wanted = jobs.where("source_format = 'csv'").groupBy("path").agg(F.collect_list(F.struct("job_id", "member")).alias("jobs"))
    rows = _archives(spark, path).select("path", "content").join(wanted, "path").select("content", "jobs")
    return rows.mapInPandas(_samples, "recording_id string, seq long, ts_ms long, axes int, x double, y double, z double")
