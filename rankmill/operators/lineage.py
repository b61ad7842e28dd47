"""Results computed once and kept in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or the one that spark.checkpoint.dir names, set now.

    Only a session that is one process makes a temporary one: on a cluster, executors would not see a folder of the driver's.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            import tempfile

            named = tempfile.mkdtemp(prefix="rankmill-")
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed now and reread from checkpoint files."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder, which driver and executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to spark.sql.shuffle.partitions partitions, so that all that is grouped by it and more stays where it is.

    For steps that make many rows of one, such as the terms of a text: the texts are shuffled once, their terms are not.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
