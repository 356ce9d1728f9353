"""JSON reports of jobs, and tables that are published whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Every job_report.json below ``path`` outside _interrupted folders, with its folder."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "job_report.json")
    rows = (reader.schema(schema) if schema else reader).json(path)
    rows = rows.withColumn("folder", F.regexp_replace(F.input_file_name(), "/job_report[.]json$", ""))
    return rows.where(~F.contains("folder", F.lit("/_interrupted")))


def outputs_by_sensor(reports: DataFrame) -> DataFrame:
    """Successful jobs' outputs (array of struct sensor, path, rows), one row each with the sensor's total."""
    out = reports.where("status = 'success'").select("folder", F.explode("outputs").alias("o")).select("folder", "o.*")
    totals = out.groupBy("sensor").agg(F.sum("rows").alias("available_rows"))
    return out.join(totals, "sensor")


def write_json(path: str, data: Any) -> None:
    """Writes to another name and renames, so readers see the old or the new file."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    temporary = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    temporary.write_text(json.dumps(data, indent=2, sort_keys=True) + "\n")
    os.replace(temporary, p)


def publish(tables: dict[str, DataFrame], failures: DataFrame, path: str, strict: bool = True) -> bool:
    """Writes the tables as CSV with headers. In strict mode any failure leaves only the failures' table; else both are written."""
    failed = not failures.isEmpty()
    if failed:
        failures.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/failures")
    if failed and strict:
        return False
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return True


def write_scores(df: DataFrame, path: str) -> None:
    """Timelines as Parquet, a folder per sensor and scenario."""
    df.write.mode("overwrite").partitionBy("sensor", "scenario").parquet(path)
