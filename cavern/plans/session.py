"""What the operators need of a session."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=4)
def _loaded(data: bytes) -> Any:
    return cloudpickle.loads(data)


class Shared:
    """A broadcast object that may hold functions of the user's; a worker unpacks it once."""

    def __init__(self, spark: SparkSession, value: Any):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        return _loaded(self.data.value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where none is named, a local master gets
    a temporary one, and a cluster is refused: its executors couldn't read what others wrote."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the folder that all executors share, so that lost executors cost no lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that is read again; it is removed when the session's JVM ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path
