"""Cutting lineage in a folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only where the setting is unset a local one, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        named = tempfile.mkdtemp(prefix="docgraph-")
        context.setCheckpointDir(named)
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; survives lost executors and bounds the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
