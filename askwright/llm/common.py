"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII strings take lower(), which is a byte loop; others translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset on a local master
    (tests).  On a cluster without the setting this is an error: a machine's own folder is not seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="askwright-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: dict[str, list[tuple[str, str | None]]] = {}


def _new_path(spark: SparkSession, name: str, table_name: str | None = None) -> str:
    path = f"{shared_dir(spark)}/askwright/{name}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((path, table_name))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables that this application wrote; to be called once the results are read or saved."""
    for path, table_name in _written.pop(spark.sparkContext.applicationId, []):
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        discard(spark, path)


def materialize(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors.

    rows_a_file bounds what a reader's batch holds where rows are large.
    """
    spark = df.sparkSession
    path = _new_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, rows_a_file: int = 0) -> DataFrame:
    """materialize() as a table bucketed by key, one bucket for each shuffle partition: joins and groups by the key read it
    where it lies, without a shuffle."""
    spark = df.sparkSession
    made = f"askwright_{name}_{uuid.uuid4().hex}"
    path = _new_path(spark, made, made)
    df.write.option("maxRecordsPerFile", rows_a_file).option("path", path).bucketBy(partitions(df), key).saveAsTable(made, format="parquet")
    return spark.table(made)


def slices(batch, text_index: int, most_bytes: int = 4 << 20):
    """Cut an Arrow batch into runs of rows holding about most_bytes of text each (one row at least)."""
    lengths = batch.column(text_index).nbytes
    if lengths <= most_bytes or batch.num_rows <= 1:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, which the cluster sets to suit the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def summed(parts: DataFrame, size: int, kind: str = "float32") -> dict[str, np.ndarray]:
    """Sums of arrays by key: parts has key, salt (a task's number) and sums (bytes of an array).  Sixteen are added at a time,
    level by level, so that no task, and not the driver, holds more than sixteen of a key, whatever their number."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.float64)
        for x in rows["sums"]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "salt": [int(rows["salt"].iloc[0])], "sums": [total.astype(kind).tobytes()]})

    found, groups = parts.select("key", "salt", "sums"), parts.rdd.getNumPartitions()
    while groups > 4:
        groups = -(-groups // 16)
        found = found.withColumn("salt", F.floor(F.col("salt") / 16).cast("int")).groupBy("key", "salt").applyInPandas(lambda p: add(p[["key", "salt", "sums"]]), "key string, salt int, sums binary")
    out: dict[str, np.ndarray] = {}
    for row in found.toLocalIterator():
        out.setdefault(row["key"], np.zeros(size))
        out[row["key"]] += np.frombuffer(row["sums"], kind)
    return out


def without(docs: DataFrame, judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that judge names, each judged by its own id and text; rows with a null id stay.

    judge takes rows (id, text), of which the id is a hash of both, and returns a frame whose column id_col holds those to drop.
    Two rows of one hash are told apart by their ids; rows repeated whole go or stay together.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    gone = judge(docs.select(key.alias(id_col), F.col(text_col).alias(text_col))).select(F.col(id_col).alias("__gone")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__named"), key.alias("__key")).join(gone, F.col("__key") == F.col("__gone"), "left_semi").distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(id_col).alias("__own"), key.alias("__hash"))
    kept = packed.join(named, (F.col("__hash") == F.col("__key")) & (F.col("__own") == F.col("__named")), "left_anti")
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
