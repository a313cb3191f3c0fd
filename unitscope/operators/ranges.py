"""Running totals in the order of a number without a window over the whole table.

Values are dealt into ranges whose bounds are quantiles of the values themselves, from a sketch that tasks build and merge, so a
range holds about as many rows as any other, unless one value alone has more. A window runs inside each range, and another over
the totals of the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most, rows from which on a table has more than one, and rows to a range that are aimed at.
RANGES, RANGE_ROWS = 1024, 50_000
#: The sketch's ranks are right to one in so many rows.
ACCURACY = 1 << 14
#: Bounds that generated code compares with one by one, halving them; more are searched for in an array.
INLINE = 128


def bounds(rows: DataFrame, value: str, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> list[float]:
    """The largest values of all ranges but the last, in order. One pass over the rows; as many numbers as ranges reach the driver."""
    number = F.col(value).cast("double")
    known = F.when(~F.isnan(number), number)
    row = rows.agg(F.count(known).alias("n"), F.percentile_approx(known, [k / ranges for k in range(1, ranges)], ACCURACY).alias("at")).first()
    wanted = min(ranges, -(-row["n"] // range_rows))
    if wanted <= 1:
        return []
    picked = (row["at"][-(-k * ranges // wanted) - 1] for k in range(1, wanted))
    return sorted({x for x in picked if x == x})


def range_of(value: Column, at: list[float]) -> Column:
    """How many of the bounds are smaller than a value; it never falls as the value grows. Null for null."""
    number = value.cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number <= F.lit(at[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    if len(at) <= INLINE:
        place = search(0, len(at))
    else:
        table = F.array(*(F.lit(x) for x in at))
        step = lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(_halved(s, number, table))
        start = F.struct(F.lit(0).alias("low"), F.lit(len(at)).alias("high"))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(len(at).bit_length() + 1)), start, step)["low"]
    return F.when(number.isNotNull(), place)


def _halved(s: Column, number: Column, table: Column) -> Column:
    middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
    below = number <= F.get(table, middle)
    return F.struct(F.when(below, s["low"]).otherwise(middle + 1).alias("low"), F.when(below, middle).otherwise(s["high"]).alias("high"))


def join_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the other columns of right, where the columns by are equal; nulls are equal. right has one row to each."""
    named = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [left[c].eqNullSafe(named[f"_by_{c}"]) for c in by]
    return left.join(named, same, "left").drop(*(f"_by_{c}" for c in by))


def running(rows: DataFrame, by: list[str], value: str, amount: str) -> DataFrame:
    """rows with upto, the sum of amount over the rows of the group whose value is at most theirs, total, that over the group, and _range."""
    ranged = rows.withColumn("_range", range_of(F.col(value), bounds(rows, value)))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(amount).alias("_sum"))
    group = Window.partitionBy(*by)
    before = F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("total"))
    placed = join_by(ranged, offsets, [*by, "_range"])
    within = F.sum(amount).over(Window.partitionBy(*by, "_range").orderBy(value))
    return placed.withColumn("upto", F.col("_before") + within).drop("_before")


def least_from(rows: DataFrame, by: list[str], value: str, what: str) -> DataFrame:
    """Of running's rows: with least, the smallest `what` of the rows of the group whose value is at least theirs."""
    lows = rows.groupBy(*by, "_range").agg(F.min(what).alias("_low"))
    after = F.min("_low").over(Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    placed = join_by(rows, lows.select(*by, "_range", after.alias("_after")), [*by, "_range"])
    within = F.min(what).over(Window.partitionBy(*by, "_range").orderBy(F.desc(value)))
    return placed.withColumn("least", F.least(within, "_after")).drop("_after")
