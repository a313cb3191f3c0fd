"""Places of rows in an order of the whole table, and exact quantiles, without a window over all rows.

Rows are dealt into ranges of the order by sampled bounds and sorted inside them; the sorted rows are stored, so that bounds
cannot change between their uses, and a table with a row to each range says how many rows lie before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitscope.operators.ranges import running
from unitscope.sources.shared import shared_folder

_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str | Column], ordinal: str = "ordinal") -> DataFrame:
    """rows with their place in the order, from 1. Rows that are equal in the order have any places among theirs and lie in one range: name columns that tell rows apart."""
    spark = rows.sparkSession
    shared_folder(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = sorted_.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}).checkpoint()
    before, total = [], 0
    for row in placed.groupBy("_part").count().orderBy("_part").collect():  # one row to each range
        before.append((row["_part"], total))
        total += row["count"]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(ordinal, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def quantiles(rows: DataFrame, value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """One row (name, n): the exact quantiles of the values, by linear interpolation between neighbours, as an array, and how many values there are. Nulls are none; without values quantiles are null.

    Distinct values are counted range by range, and each share needs two of them at most."""
    counts = rows.select(F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_c"))
    held = running(counts, [], "_v", "_c")
    place = lambda share: (F.col("total") - 1) * F.lit(share)
    has = lambda at: (F.col("upto") - F.col("_c") <= at) & (at < F.col("upto"))
    picked = [F.max(F.when(has(f(place(share))), F.col("_v"))).alias(f"_{side}{k}") for k, share in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))]
    found = held.agg(F.max("total").alias("total"), *picked)
    between = [F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (place(share) - F.floor(place(share))) for k, share in enumerate(shares)]
    return found.select(F.when(F.col("total") > 0, F.array(*between)).alias(name), F.coalesce("total", F.lit(0)).alias("n"))
