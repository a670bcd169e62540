"""Immutable runs and the pointer that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def publish(df: DataFrame, path: str, run_id: str) -> None:
    """Write runs/run_id and then latest.json: whatever reads the pointer sees a whole run."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/runs/{run_id}")
    fs, _, jvm = _file_system(spark, path)
    temp, final = jvm.org.apache.hadoop.fs.Path(f"{path}/latest.json.new"), jvm.org.apache.hadoop.fs.Path(f"{path}/latest.json")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"run_id": run_id}).encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(temp, final)


def latest_run(spark: SparkSession, path: str) -> str | None:
    fs, _, jvm = _file_system(spark, path)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/latest.json")):
        return None
    return json.loads(spark.read.text(f"{path}/latest.json").first()[0])["run_id"]


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    run = latest_run(spark, path)
    return None if run is None else spark.read.parquet(f"{path}/runs/{run}")
