"""Benjamini-Hochberg q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitscope.operators.ranges import join_by, least_from, running


def benjamini_hochberg(
    rows: DataFrame, p: str = "p_value", q: str = "q_value", by: list[str] | None = None, scope: str | None = None, null_as_one: bool = False, few: bool = False
) -> DataFrame:
    """rows with q, the smallest p * n / rank from each p upwards, at most 1; null p and rows out of scope have a null q.

    The work is done on the distinct p-values of each group with their counts, and comes back by a join. They are ranked
    range by range, so there may be as many as rows. With few, the caller knows that there are few to a group, such as
    N + 1 for ranks among N nulls; then one window per group ranks them."""
    by = by or []
    value = F.coalesce(p, F.lit(1.0)) if null_as_one else F.col(p)
    tested = rows.withColumn("_p", F.when(F.expr(scope), value) if scope else value)
    counts = tested.filter("_p IS NOT NULL").groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    ratio = F.col("_p") * F.col("total") / F.col("upto")
    if few:
        group = Window.partitionBy(*by)
        ranked = counts.withColumn("upto", F.sum("_c").over(group.orderBy("_p"))).withColumn("total", F.sum("_c").over(group))
        adjusted = ranked.withColumn("least", F.min(ratio).over(group.orderBy(F.desc("_p"))))
    else:
        adjusted = least_from(running(counts, by, "_p", "_c").withColumn("_ratio", ratio), by, "_p", "_ratio")
    table = adjusted.select(*by, "_p", F.least(F.lit(1.0), "least").alias(q))
    # A null p meets no row of the table.
    return join_by(tested, table, [*by, "_p"]).drop("_p")


def recompute_audit(rows: DataFrame, by: str, p: str = "p_value", q: str = "q_value", unit: str = "unit_id", few: bool = False, tie: Column | None = None) -> DataFrame:
    """Per method: n, missing q, the largest |q - recomputed q|, how many differ by more than 1e-9 and the worst unit: that of the largest gap and then the largest unit, or
    with tie, a small number, that of the largest sum of 1e9 gaps and tie, so that gaps that differ by rounding are told apart by it."""
    again = benjamini_hochberg(rows, p, "_again", [by], few=few).withColumn("_gap", F.abs(F.col(q) - F.col("_again")))
    return again.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(q).isNull()).alias("n_missing"),
        F.max("_gap").alias("max_gap"),
        F.count_if(F.col("_gap") > 1e-9).alias("n_differ"),
        F.max_by(unit, F.struct("_gap", unit) if tie is None else F.col("_gap") * 1e9 + tie).alias("worst_unit"),
    )
