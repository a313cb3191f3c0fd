"""Summary tables over results: size, power, failures, runtimes, histograms, enrichment and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitscope.functions.statistics import clipped_interval, log_factorial
from unitscope.operators.ordinals import quantiles

ALPHAS = (0.1, 0.05, 0.01, 0.001)
TAIL_CELLS = 45


def empirical_size(rows: DataFrame, by: list[str], p: str = "p", alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Per group and level: n, the share of p <= alpha, its interval and its distance from alpha."""
    each = rows.filter(F.col(p).isNotNull()).withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in alphas))))
    out = each.groupBy(*by, "alpha").agg(F.count("*").alias("n"), F.avg((F.col(p) <= F.col("alpha")).cast("int")).alias("size"))
    low, high = clipped_interval(F.col("size"), F.col("n"))
    return out.withColumns({"low": low, "high": high, "deviation": F.col("size") - F.col("alpha"), "abs_deviation": F.abs(F.col("size") - F.col("alpha"))})


def power_table(rows: DataFrame, by: list[str], p: str = "p", status: str = "status") -> DataFrame:
    """Per group: n_total, n_ok and power at .05 and .01 over OK rows, where a null p is not significant; zeros without an OK row."""
    ok = F.col(status) == "OK"
    hit = lambda level: F.coalesce(F.avg(F.when(ok, F.coalesce(F.col(p) <= level, F.lit(False)).cast("int"))), F.lit(0.0))
    out = rows.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_ok"), hit(0.05).alias("power_05"), hit(0.01).alias("power_01"))
    low, high = clipped_interval(F.col("power_05"), F.col("n_ok"))
    none = F.col("n_ok") == 0
    return out.withColumns({"low_05": F.when(none, 0.0).otherwise(low), "high_05": F.when(none, 0.0).otherwise(high)})


def failure_rates(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_if(F.col(status) != "OK").alias("n_fail"))
    return out.withColumn("rate", F.col("n_fail") / F.greatest(F.col("n_total"), F.lit(1)))


def failure_audit(*sources: DataFrame) -> DataFrame:
    """Failures of all sources (method, status, reason) counted."""
    rows = sources[0].select("method", "status", "reason")
    for source in sources[1:]:
        rows = rows.unionByName(source.select("method", "status", "reason"))
    return rows.filter("status <> 'OK'").groupBy("method", "status", "reason").agg(F.count("*").alias("n"))


def best_methods(power: DataFrame, by: list[str], method: str = "method", value: str = "power_05") -> DataFrame:
    """Per group the method with the most power, ties by name."""
    best = Window.partitionBy(*by).orderBy(F.desc(value), method)
    return power.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*by, method, value)


def power_pivot(rows: DataFrame, row: str, column: str, names: list[str], hit: Column) -> DataFrame:
    return rows.withColumn("_hit", hit.cast("int")).groupBy(row).pivot(column, names).agg(F.avg("_hit")).na.fill(0.0)


def scenario_summary(rows: DataFrame, by: str, p: str = "p") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col(p) <= 0.05).cast("int")).alias("share_05"))


def runtimes(rows: DataFrame, by: list[str], value: str = "runtime_sec") -> DataFrame:
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median_sec"), F.avg(value).alias("mean_sec"), F.stddev_samp(value).alias("std_sec"))


def discreteness(rows: DataFrame, size: str, p: str) -> DataFrame:
    return rows.groupBy(size).agg(F.count_distinct(p).alias("n_distinct"), F.count(p).alias("n"), F.first(1 / (F.col(size) + 1)).alias("step"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) in equal widths over the values' own range, the last bin closed; one distinct value stands in the middle bin."""
    clipped = rows.select(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)).alias("v")).filter("v IS NOT NULL")
    ends = clipped.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(F.col("low") == F.col("high"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    return clipped.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def enrichment(rows: DataFrame, hit: str, positive: str) -> DataFrame:
    """One row: the 2x2 counts, the one-sided hypergeometric tail, the odds ratio and its 95 % interval.

    The tail is a sum of weights over the possible first cells from the observed one on. Beyond the mode a weight is at most
    a share of the one before it, and far from the observed one nothing is added that a double could hold, so at most
    TAIL_CELLS standard deviations of cells are summed."""
    on = lambda h, p: F.count_if((F.col(hit) == F.lit(h)) & (F.col(positive) == F.lit(p)))
    counts = rows.agg(on(True, True).alias("a"), on(True, False).alias("b"), on(False, True).alias("c"), on(False, False).alias("d"))
    n, row, column = (F.col("a") + F.col("b") + F.col("c") + F.col("d")).cast("double"), F.col("a") + F.col("b"), F.col("a") + F.col("c")
    spread = F.sqrt(row * column / n * (n - row) / n * (n - column) / F.greatest(n - 1, F.lit(1.0)))
    last = F.least(row, column, F.greatest(F.col("a"), F.ceil(row * column / n)) + F.ceil(TAIL_CELLS * spread) + TAIL_CELLS)
    cells = counts.withColumn("x", F.explode(F.when(n > 0, F.sequence(F.col("a"), last))))
    # The hypergeometric weight of a table with first cell x and the same margins.
    plus, minus = ("a + b", "c + d", "a + c", "b + d"), ("a + b + c + d", "x", "a + b - x", "a + c - x", "d - a + x")
    weight = sum((log_factorial(F.expr(t)) for t in plus), F.lit(0.0)) - sum((log_factorial(F.expr(t)) for t in minus), F.lit(0.0))
    tail = cells.agg(F.least(F.lit(1.0), F.coalesce(F.sum(F.exp(weight)), F.lit(1.0))).alias("p_value"))
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    cell = {k: F.col(k) + add for k in "abcd"}
    log_ratio = F.log(cell["a"] * cell["d"] / (cell["b"] * cell["c"]))
    error = F.sqrt(1 / cell["a"] + 1 / cell["b"] + 1 / cell["c"] + 1 / cell["d"])
    return counts.withColumns({"odds_ratio": F.exp(log_ratio), "low": F.exp(log_ratio - 1.96 * error), "high": F.exp(log_ratio + 1.96 * error)}).crossJoin(tail)


def roll_up(rows: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row: median, mean, maximum and sum of every number, and the share of non-empty values of every text."""
    out = [f(c).alias(f"{name}_{c}") for c in numbers for name, f in (("mean", F.avg), ("max", F.max), ("sum", F.sum))]
    out += [F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int")).alias(f"filled_{c}") for c in texts]
    row = rows.agg(*out)
    for c in numbers:
        row = row.crossJoin(quantiles(rows, c, [0.5]).select(F.col("quantiles")[0].alias(f"median_{c}")))
    return row.select(*(f"{name}_{c}" for c in numbers for name in ("median", "mean", "max", "sum")), *(f"filled_{c}" for c in texts))


def gates(rows: DataFrame, rules: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row per gate (name, observed, required, passed) from one aggregation; observed values must reach what is required."""
    once = rows.agg(*(value.cast("double").alias(name) for name, (value, _) in rules.items()))
    stacked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("observed"), F.lit(float(required)).alias("required")) for name, (_, required) in rules.items())))
    return once.select(stacked.alias("g")).select("g.*").withColumn("passed", F.coalesce(F.col("observed") >= F.col("required"), F.lit(False)))


def invariant(events: DataFrame, event: str, value: str, expected: str | None = None) -> DataFrame:
    """Per event PASS if it has one distinct value, equal to the expected one where that is given."""
    out = events.groupBy(event).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("value"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    good = (F.col("n_values") == 1) & (F.col("n_missing") == 0)
    if expected is not None:
        good = good & (F.col("value") == expected)
    return out.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))


def provenance(rows: DataFrame, texts: list[str], seed: str) -> DataFrame:
    """One row: sorted distinct values of each text, and of the seeds their range, number and a hash of their sorted list."""
    out = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(c) for c in texts]
    distinct = F.array_join(F.sort_array(F.collect_set(F.col(seed).cast("long"))), ",")
    return rows.agg(*out, F.min(seed).alias("seed_min"), F.max(seed).alias("seed_max"), F.count_distinct(seed).alias("n_seeds"), F.sha2(distinct, 256).alias("seed_hash"))
