"""Calibration diagnostics of p-values: uniformity, null proportions, ranks, quantile tables.

Ranks come from the distinct values of a table with their counts, range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitscope.functions.statistics import beta_quantile, kolmogorov_tail, minus_log10, student_two_sided
from unitscope.operators.ordinals import quantiles
from unitscope.operators.ranges import running


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    """(v, c, upto, n): distinct values, their counts, how many rows are at most v, and how many there are."""
    counts = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    return running(counts, [], "v", "c").select("v", "c", "upto", F.col("total").alias("n"))


def storey(rows: DataFrame, p: str) -> DataFrame:
    """(lambda, pi0) for lambda .50 to .95 in steps of .05."""
    each = rows.select(F.col(p).alias("p")).filter("p IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5)))).withColumn("lambda", F.col("k") / 100)
    counts = each.groupBy("lambda").agg(F.count_if(F.col("p") > F.col("lambda")).alias("above"), F.count("*").alias("n"))
    return counts.select("lambda", "n", F.least(F.lit(1.0), F.col("above") / F.greatest((1 - F.col("lambda")) * F.col("n"), F.lit(1.0))).alias("pi0"))


def null_proportion(rows: DataFrame, p: str) -> DataFrame:
    """One row: n, pi0 as the median over lambdas, and the number of non-nulls."""
    return storey(rows, p).agg(F.max("n").alias("n"), F.percentile("pi0", F.lit(0.5)).alias("pi0")).withColumn("n_alternative", (1 - F.col("pi0")) * F.col("n"))


def ks_uniform(rows: DataFrame, p: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row: n, the distance of the values in [low, high], rescaled, from the uniform distribution, and its asymptotic tail."""
    tail = rows.filter(F.col(p).between(low, high)).withColumn("u", (F.col(p) - low) / (high - low))
    steps = value_counts(tail, "u")
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("v"), F.col("v") - (F.col("upto") - F.col("c")) / F.col("n"))
    return steps.agg(F.max("n").alias("n"), F.max(gap).alias("ks")).withColumn("ks_p", kolmogorov_tail("ks", F.col("n").cast("double")))


def ks_grid(rows: DataFrame, p: str, null_size: int) -> DataFrame:
    """One row: the largest gap between the distribution of p and k / (N + 1) on the grid of N + 1 values."""
    steps = value_counts(rows, p).select(F.round(F.col("v") * (null_size + 1)).cast("long").alias("k"), "c", "n").groupBy("k").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    grid = rows.sparkSession.range(1, null_size + 2).withColumnRenamed("id", "k").join(steps, "k", "left")
    below = grid.selectExpr("k", "coalesce(sum(c) OVER (ORDER BY k), 0) / max(n) OVER () AS share")
    return below.agg(F.max(F.abs(F.col("share") - F.col("k") / (null_size + 1))).alias("ks_discrete"))


def null_uniformity(rows: DataFrame, p: str, null_size: int) -> DataFrame:
    """One row: n, mean, tail mass at .05, its z-score, both distances, and whether the null is severely inflated."""
    base = rows.filter(F.col(p).isNotNull()).agg(F.count(p).alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col(p) <= 0.05).cast("int")).alias("tail_05"))
    z = F.try_divide(F.col("tail_05") - 0.05, F.sqrt(0.05 * 0.95 / F.when(F.col("n") > 0, F.col("n"))))
    out = base.withColumn("z", z).crossJoin(ks_uniform(rows, p).select("ks")).crossJoin(ks_grid(rows, p, null_size))
    severe = ((F.col("z") > 4) & (F.col("tail_05") > 0.05)) | (F.col("ks_discrete") > 0.08)
    return out.withColumn("severe", F.coalesce((F.col("n") > 0) & severe, F.lit(False)))


def exact_interval(hits: str, n: str) -> tuple:
    """Clopper-Pearson bounds of hits among n."""
    k, m = F.col(hits).cast("double"), F.col(n).cast("double")
    low = F.when(k == 0, 0.0).otherwise(beta_quantile(F.lit(0.025), k, m - k + 1))
    high = F.when(k == m, 1.0).otherwise(beta_quantile(F.lit(0.975), k + 1, m - k))
    return low, high


def spearman(pairs: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Per group: n, rho by average ranks over rows that have both values, and its t tail; null below three rows.

    Ranks come from the distinct values of either side with their counts."""
    by = by or []
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = both.groupBy(*by, c).agg(F.count("*").alias("_c"))
        return running(counts, by, c, "_c").select(*by, c, (F.col("upto") - (F.col("_c") - 1) / 2).alias(f"r_{c}"))

    ranked = both.join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr(f"r_{x}", f"r_{y}").alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("rho_p", student_two_sided(t, (F.col("n") - 2).cast("double")))


def correlation_table(rows: DataFrame, methods: list[str], covariates: list[str]) -> DataFrame:
    """(method, covariate, n, rho, rho_p) of every pair, each over its own complete rows."""
    each = rows.select(
        F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("x"), F.lit(c).alias("covariate"), F.col(c).cast("double").alias("y")) for m in methods for c in covariates))).alias("s")
    ).select("s.*")
    return spearman(each, "x", "y", ["method", "covariate"])


def confounders(correlations: DataFrame, covariates: list[str], level: float = 0.5) -> DataFrame:
    return correlations.filter(F.col("covariate").isin(*covariates) & (F.abs("rho") > level))


def quantile_rejections(rows: DataFrame, value: str, q: str, level: float = 0.1) -> DataFrame:
    """(bin, n, share of q <= level) by quartile bins, right-closed with the least value in the first; equal edges merge; empty below four rows."""
    known = rows.filter(F.col(value).isNotNull())
    edges = quantiles(known, value, [0.0, 0.25, 0.5, 0.75, 1.0]).select(F.array_distinct("quantiles").alias("edges"), F.col("n").alias("_n"))
    placed = known.crossJoin(F.broadcast(edges)).filter("_n >= 4")
    inner = F.filter("edges", lambda e: e < F.col(value))
    return placed.groupBy(F.greatest(F.lit(1), F.size(inner)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(q) <= level, F.lit(False)).cast("int")).alias("share"))


def grid_floor(rows: DataFrame, by: str, p: str, null_size: int) -> DataFrame:
    """Per cohort: n, the share at the smallest possible p, the share of p <= .002 and the mean."""
    least = 1 / (null_size + 1)
    at = F.abs(F.col(p) - least) <= 1e-8 + 1e-5 * least
    share = lambda c: F.avg(c.cast("int"))
    return rows.filter(F.col(p).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), share(at).alias("share_floor"), share(F.col(p) <= 0.002).alias("share_002"), F.avg(p).alias("mean_p"))


def null_validation(rows: DataFrame, p: str, null_size: int) -> DataFrame:
    least = 1 / (null_size + 1)
    share = lambda c: F.avg(c.cast("int"))
    return rows.agg(F.avg(p).alias("mean_p"), *(share(F.col(p) <= a).alias(f"share_{n}") for a, n in ((0.01, "01"), (0.05, "05"), (0.1, "10"))), share(F.abs(F.col(p) - least) <= 1e-8 + 1e-5 * least).alias("share_floor"))


def qq_table(rows: DataFrame, p: str, band: bool = False) -> DataFrame:
    """(p, i, expected, observed and expected score) per distinct p, i its last rank; optionally the 95 % band of that rank."""
    steps = value_counts(rows, p).select(F.col("v").alias("p"), F.col("upto").alias("i"), "n", ((F.col("upto") - 0.5) / F.col("n")).alias("expected"))
    out = steps.withColumns({"observed_score": minus_log10(F.col("p")), "expected_score": minus_log10(F.col("expected"))})
    if band:
        a, b = F.col("i").cast("double"), (F.col("n") + 1 - F.col("i")).cast("double")
        out = out.withColumns({"low": beta_quantile(F.lit(0.025), a, b), "high": beta_quantile(F.lit(0.975), a, b)})
    return out
