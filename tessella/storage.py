"""Tables in the folder that all executors share: what cuts lineage and outlives an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local session without spark.checkpoint.dir, made when it is first needed and deleted when the process ends.
_LOCAL: list[str] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessella-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a full URI, under spark.checkpoint.dir, which all executors reach. Where that is unset, a local session gets a temporary one; on a cluster that would be a folder of each machine's own, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{re.sub(r'^file:/+', 'file:///', uri).rstrip('/')}/tessella-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of stored() once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
