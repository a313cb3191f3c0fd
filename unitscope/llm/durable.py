"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from unitscope.sources.shared import shared_folder

#: Whether Spark deletes an execution's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder: a later loss of executors recomputes nothing before this point.

    The shuffle files that led to them serve nobody any more and are deleted at once. (Those of df itself, if it was
    executed before, stay.)"""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # A new query, since each takes the setting of the time at which it is made.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)
