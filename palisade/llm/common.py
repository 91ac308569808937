"""What the operators share: tables, the shared folder and files in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from palisade.sources.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary
    folder is made and set for the rest of the session; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = root.rsplit("/", 1)[0] if root else "file://" + tempfile.mkdtemp(prefix="palisade-")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for one run of an operator, below the shared folder."""
    return f"{shared_root(spark)}/palisade-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps don't compute it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Store:
    """Files below a shared folder, from Python on the driver or an executor.

    ``file:`` paths go through ``open``; all others through pyarrow's file
    systems (hdfs, s3, gs). A file appears under its name only when it is whole.
    """

    def __init__(self, root: str):
        from pyarrow import fs

        if root.startswith("file:"):
            self.base, self.fs = "/" + root[5:].lstrip("/"), fs.LocalFileSystem()
        else:
            self.fs, self.base = fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.base, recursive=True)

    def create(self, name: str):
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.base}/{name}")

    def rename(self, old: str, new: str) -> None:
        self.fs.move(f"{self.base}/{old}", f"{self.base}/{new}")

    def put(self, temp: str, name: str) -> None:
        """Give a whole file its name; another attempt may have written the same file before."""
        try:
            self.rename(temp, name)
        except OSError:
            if name not in self.names():
                raise
            self.delete(temp)

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.base}/{name}")

    def names(self) -> list[str]:
        from pyarrow import fs

        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.base)) if x.is_file)
