"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set for checkpoints.

    Where neither is set, a session within one machine gets a temporary folder; on a cluster that would be a different folder on
    each machine, so that an error is raised.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    before = context._jsc.sc().getCheckpointDir()
    if not named and before.isDefined():
        named = before.get()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not before.isDefined():
        context.setCheckpointDir(named)
    return named.rstrip("/")
