"""Long generated expressions that leave nothing in the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Spark holds its parser's caches itself, and drops them after each text.
_DROPPED = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1"}


@contextmanager
def parsed_once(spark: SparkSession) -> Iterator[None]:
    """What the parser learns from the SQL of columns that are used within it is dropped once it is parsed.

    Else it stays as long as the driver lives: of deeply nested text some 3 kB to a character. The caches of all other texts stay."""
    before = {name: spark.conf.get(name, None) for name in _DROPPED}
    for name, value in _DROPPED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
