"""Where iterative jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure(spark: SparkSession) -> None:
    """The session's ``spark.checkpoint.dir`` as the checkpoint directory; a temporary one where
    that is unset and everything runs on this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    ensure(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint directory, read back. Unlike a checkpoint, the frame
    read carries no constraints of the plan that made it, which in loops of joins multiply
    until planning takes longer than the work."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
