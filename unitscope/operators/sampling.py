"""Deterministic sampling and splitting: every choice follows from a seed and an id by md5, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitscope.operators.ordinals import numbered
from unitscope.operators.ranges import running


def shuffle_key(seed: int | str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def uniform_cap(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    return rows.orderBy(shuffle_key(seed, key), key).limit(most)


def stratified(rows: DataFrame, name: str, stratum: Column, most: int, seed: int) -> DataFrame:
    """At most `most` rows: of each stratum (blank: unknown) an equal share in seeded order, then the first by name; all rows when there are few."""
    placed = rows.withColumn("_s", F.coalesce(F.nullif(F.trim(stratum), F.lit("")), F.lit("unknown")))
    sizes = placed.groupBy("_s").agg(F.count("*").alias("_c")).agg(F.count("*").alias("_strata"), F.sum("_c").alias("_total"))
    order = Window.partitionBy("_s").orderBy(shuffle_key(seed, name), name)
    ranked = placed.withColumn("_n", F.row_number().over(order)).crossJoin(F.broadcast(sizes))
    kept = ranked.filter((F.col("_total") <= most) | (F.col("_n") <= F.ceil(F.lit(most) / F.col("_strata"))))
    return kept.orderBy(name).limit(most).drop("_s", "_n", "_strata", "_total")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def split_units(units: DataFrame, unit: str, seed: int, share: float = 0.2, least_test: int = 1) -> DataFrame:
    """(unit, side): round-half-even(n * share) units for training, from 1 to n - 1 and leaving least_test; a single unit stands on both sides.

    Units are ranked by their seeded hash, range by range."""
    distinct = units.select(unit).distinct()
    n = distinct.agg(F.count("*").alias("_n"))
    ranked = numbered(distinct.withColumn("_order", shuffle_key(seed, unit)), ["_order", unit], "_rank").crossJoin(F.broadcast(n))
    k = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * share), F.col("_n") - 1, F.greatest(F.lit(1), F.col("_n") - least_test)))
    one = F.array(F.lit("train"), F.lit("test"))
    sides = F.when(F.col("_n") == 1, one).when(F.col("_rank") <= k, F.array(F.lit("train"))).otherwise(F.array(F.lit("test")))
    return ranked.select(unit, F.explode(sides).alias("side"))


def with_required(split: DataFrame, unit: str, tokens: list[str], seed: int) -> DataFrame:
    """The split with a unit of each required token on the test side; a unit without any token goes back in its place.

    For each token that no test unit has, the first training unit that has it moves; as many test units without a token, in seeded order, take the freed places."""
    has = lambda t: F.contains(F.col(unit).cast("string"), F.lit(t))
    moves = None
    for token in tokens:
        covered = split.filter((F.col("side") == "test") & has(token)).select(F.lit(1).alias("_x")).limit(1)
        one = split.filter((F.col("side") == "train") & has(token)).orderBy(unit).limit(1).select(unit).join(covered, F.lit(True), "left_anti")
        moves = one if moves is None else moves.unionByName(one)
    if moves is None:
        return split
    moved = moves.distinct().withColumn("_move", F.lit(True))
    free = split.filter("side = 'test'")
    for token in tokens:
        free = free.filter(~has(token))
    n = moved.agg(F.count("*").alias("_n"))
    order = Window.orderBy(shuffle_key(seed, unit), unit)
    # No more units move back than there are tokens.
    back = free.orderBy(shuffle_key(seed, unit), unit).limit(len(tokens)).withColumn("_k", F.row_number().over(order)).crossJoin(F.broadcast(n)).filter("_k <= _n").select(unit, F.lit(True).alias("_back"))
    joined = split.join(moved, unit, "left").join(back, unit, "left")
    side = F.when(F.col("_move"), "test").when(F.col("_back"), "train").otherwise(F.col("side"))
    return joined.select(unit, side.alias("side"))


def spread_pick(rows: DataFrame, value: str, unit: str, m: int) -> DataFrame:
    """m rows spread over the order of a value: ranks 0, 1, last, evenly spaced ones, then in order."""
    ranked = numbered(rows, [value, unit], "rank").withColumn("rank", F.col("rank") - 1)
    n = ranked.count()
    even = [round(i * (n - 1) / max(m - 1, 1)) for i in range(m)]
    wanted = list(dict.fromkeys(k for k in [0, 1, n - 1, *even, *range(min(n, 2 * m))] if 0 <= k < n))[:m]
    return ranked.filter(F.col("rank").isin(wanted))


def largest_remainder(rows: DataFrame, by: list[str], weight: str, order: str, total: int) -> DataFrame:
    """rows with `share`: total split over weights within each group, rounded down, the rest to the largest fractions, ties by order; equal where all weights are 0."""
    group = Window.partitionBy(*by)
    positive = F.greatest(F.col(weight), F.lit(0))
    summed = F.sum(positive).over(group)
    exact = F.when(summed > 0, positive / summed * total).otherwise(F.lit(total) / F.count("*").over(group))
    # Rounded, so that fractions equal in exact arithmetic tie.
    each = rows.withColumn("_x", F.round(exact, 9)).withColumn("_f", F.floor("_x")).withColumn("_r", F.round(F.col("_x") - F.col("_f"), 9))
    left = F.lit(total) - F.sum("_f").over(group)
    rank = F.row_number().over(group.orderBy(F.desc("_r"), order))
    return each.withColumn("share", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_x", "_f", "_r")


def balanced_replicates(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """(g, unit) for g below replicates: successive passes over all units, each in its own seeded order, so counts differ by one at most."""
    n = units.select(unit).distinct().count()
    cycles = units.sparkSession.range(-(-replicates // n)).withColumnRenamed("id", "cycle")
    each = units.select(unit).distinct().crossJoin(cycles)
    order = Window.partitionBy("cycle").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cycle").cast("string"), F.col(unit).cast("string"))), unit)
    placed = each.withColumn("g", F.col("cycle") * n + F.row_number().over(order) - 1)
    return placed.filter(F.col("g") < replicates).select("g", unit)


def capped_in_order(rows: DataFrame, keep: str, order: str, most: int) -> DataFrame:
    """rows with `kept`: those that want to be kept while fewer than `most` before them were, in the order of a number; rows of one number count together. A null wish is none."""
    wish = F.coalesce(F.col(keep), F.lit(False))
    placed = running(rows.withColumn("_wish", wish.cast("int")), [], order, "_wish")
    before = F.col("upto") - F.sum("_wish").over(Window.partitionBy("_range", order))
    return placed.withColumn("kept", wish & (before < most)).drop("_wish", "upto", "total", "_range")
