"""Tables written to the folder that a cluster's driver and executors share, to end lineage where a job needs that."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A job's shuffled files go when it ends, not when the driver happens to collect its garbage.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """The session's settings for the jobs within, set back afterwards."""
    before = {k: spark.conf.get(k, None) for k in some}
    try:
        for k, v in some.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; only where that is unset on a single machine, a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corvane/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
