"""Tables cut out of the lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sparsewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> str:
    """Write ``df`` to the shared folder, one folder for each value of ``by``; its path there. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparsewright/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def parts(path: str):
    """In a task: the row groups of what was written to ``path``, as Arrow tables, file by file."""
    files, folder = pa.fs.FileSystem.from_uri(path)
    names = [f.path for f in files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
    for name in sorted(names):
        with files.open_input_file(name) as f:
            file = pq.ParquetFile(f)
            for i in range(file.num_row_groups):
                yield file.read_row_group(i)
