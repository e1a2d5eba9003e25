"""Storage that the driver and all executors share: checkpoints, new folders, and files by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession

#: Where checkpoints go with a local master that names no folder; a cluster must name one.
LOCAL_BASE = "file:///tmp/checkpoints"
#: Schemes of Hadoop's file systems, and what pyarrow's file systems call the same.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def checkpoint_base(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Unset, it is a local folder with a local master, and an error on a cluster.

    A machine's own folder would lose what an executor wrote there, or hide it from the others.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_BASE
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder under checkpoint_base()."""
    return f"{checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from it from now on."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), in Parquet files beside the checkpoints: for tables of very many rows, of which later steps read some columns."""
    path = shared_dir(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_uri(uri: str) -> str:
    """A URI as Spark takes it, in the form that pyarrow takes."""
    for scheme, ours in SCHEMES.items():
        if uri.startswith(scheme):
            return ours + uri.removeprefix(scheme).lstrip("/")
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri.removeprefix("file:")
    return uri


def opened(uri: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return filesystems.FileSystem.from_uri(arrow_uri(uri))
