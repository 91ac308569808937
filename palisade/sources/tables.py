"""Reading texts and writing results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.ship import ship


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors
    share; on a session without one that runs on one machine, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "palisade")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. Scanning costs far more than moving texts, so a table whose
    files give fewer partitions than there are cores is dealt anew."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Texts from Parquet, ORC, JSON lines, CSV or plain text (a row per line).
    Formats without a schema of their own need one: nothing is inferred."""
    reader = spark.read.options(**options)
    if fmt in ("json", "csv"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def chunk_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    """A stream of chunks (stream_id, chunk_seq, chunk, is_last) from files."""
    kind = "stream_id string, chunk_seq int, chunk string, is_last boolean"
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def write_audit(df: DataFrame, path: str, column: str = "audit", partition_by_day: bool = True) -> None:
    """Appends audit records, a folder per day."""
    rows = df.select(f"{column}.*")
    if partition_by_day:
        rows = rows.withColumn("day", F.to_date(F.timestamp_micros("timestamp_us")))
        rows.write.mode("append").partitionBy("day").parquet(path)
    else:
        rows.write.mode("append").parquet(path)
