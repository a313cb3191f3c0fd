"""Folders that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the one that the application has set.

    Without either, a session on one machine takes a new temporary folder; a cluster has none that its executors could
    all read, so there it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-", dir=context.getConf().get("spark.local.dir", None) or os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, whose owner clears it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
