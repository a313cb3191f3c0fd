"""Energy model, calibration and q-values over order lines by supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.functions.statistics import DRAWS, drawn_sql
from unitscope.operators import calibrate, energy, fdr
from unitscope.plans.views import view, with_views

FEATURES = ["f1", "f2"]
#: Replicates as in the reference; the least p-value is one in a thousand.
REPLICATES, SEED = 999, 11
_KEY = ["unit_id", "l_orderkey", "l_linenumber", "l_partkey"]


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, energy.EnergyModel]:
    sites = view(spark, sf_dir, "sites")
    model = energy.fit(sites, FEATURES)
    return sites.select(*_KEY, *FEATURES, energy.energy(model).alias("energy")), model


def _null(scored: DataFrame, units: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    return calibrate.resampled_null(units, scored, "unit_id", "n_sites", replicates, SEED)


def _results(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    scored, model = _scored(spark, sf_dir)
    units = energy.dispersion(scored, "unit_id")
    ranked = calibrate.resampled_p_values(units, scored, "unit_id", "n_sites", replicates, SEED)
    indexed = ranked.withColumn("idx", calibrate.index(F.col("D"), F.col("mu0"), F.col("sigma0")))
    # There are at most replicates + 1 different p-values.
    return fdr.benjamini_hochberg(calibrate.guardrails(indexed, model.training_rows, replicates, "resampled"), few=True)


def _called(results: DataFrame) -> DataFrame:
    return results.select("unit_id", "n_sites", F.round("D", 6).alias("D"), F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value")).orderBy("q_value", "unit_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' order lines scatter abnormally: every supplier by its q-value, against REPLICATES draws from the energies of all rows."""
    return _called(_results(spark, sf_dir))


def flagship_199(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As flagship with 199 replicates, the smallest number for which calibration figures are published."""
    return _called(_results(spark, sf_dir, 199))


def flagship_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which flagship was registered while flagship itself drew from a part of the rows."""
    return flagship(spark, sf_dir)


def d3_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = energy.moments(view(spark, sf_dir, "sites"), ["f1", "f2", "f3", "f4"])
    return row.select("n", *(F.round(c, 4).alias(c) for c in row.columns[1:]))


def d4_training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites").select(*_KEY).distinct()
    return sites.orderBy(F.md5(F.concat_ws("|", F.lit("7"), *(F.col(c).cast("string") for c in _KEY))), *_KEY).limit(1000)


def d5_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(spark, sf_dir)
    return scored.select(*_KEY, F.round("energy", 6).alias("energy"))


def d6_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites")
    model = energy.fit(sites, FEATURES)
    g1, g2 = energy.gradient(model)
    return sites.select(*_KEY, F.round(g1, 6).alias("g1"), F.round(g2, 9).alias("g2"), F.round(energy.laplacian(model), 9).alias("laplacian"))


def d7_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = energy.dispersion(_scored(spark, sf_dir)[0], "unit_id")
    return units.select("unit_id", "n_sites", F.round("mean_energy", 6).alias("mean_energy"), F.round("D", 6).alias("D"))


def d8_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("unit_id", F.round("mu0", 6).alias("mu0"), F.round("sigma0", 6).alias("sigma0"), F.round("idx", 4).alias("idx"))


def d9_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(spark, sf_dir)
    units = energy.dispersion(scored, "unit_id")
    ranked = calibrate.resampled_p_values(units, scored, "unit_id", "n_sites", REPLICATES, SEED, tail="both")
    return ranked.select("unit_id", "null_size", F.round("p_value", 6).alias("p_right"), "status", F.round("p_left", 6).alias("p_left"))


def d10_two_sided_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(spark, sf_dir)
    units = energy.dispersion(scored, "unit_id")
    return calibrate.two_sided_p_values(units, _null(scored, units), "unit_id").select("unit_id", F.round("p_value", 6).alias("p_value"))


def d11_gaussian_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, model = _scored(spark, sf_dir)
    null = calibrate.gaussian_null(energy.dispersion(scored, "unit_id"), model, 5, SEED)
    return null.select("n_sites", "rep", F.round("D", 6).alias("D"))


def d11_gaussian_null_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an odd number of features."""
    model = energy.fit(view(spark, sf_dir, "sites"), ["f1", "f3", "f4"])
    null = calibrate.gaussian_null(energy.dispersion(_scored(spark, sf_dir)[0], "unit_id"), model, 3, SEED)
    return null.select("n_sites", "rep", F.round("D", 6).alias("D"))


def d12_resampled_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(spark, sf_dir)
    null = _null(scored, energy.dispersion(scored, "unit_id"))
    return null.select("unit_id", "rep", F.round("D", 6).alias("D"))


def d9_supplied_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit against null rows that are supplied for it, ranked by a sort."""
    scored, _ = _scored(spark, sf_dir)
    units = energy.dispersion(scored, "unit_id")
    ranked = calibrate.rank_p_values(units, _null(scored, units), "unit_id", tail="both")
    return ranked.select("unit_id", "null_size", F.round("p_value", 6).alias("p_right"), "status", F.round("p_left", 6).alias("p_left"))


def d12_large_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 replicates from a pool of more than the 4,000 values that may be sent to all tasks, as one is that no task can hold: it passes through the tasks."""
    scored, _ = _scored(spark, sf_dir)
    null = calibrate.resampled_null(energy.dispersion(scored, "unit_id"), scored, "unit_id", "n_sites", 19, SEED, most=4000)
    return null.select("unit_id", "rep", F.round("D", 6).alias("D"))


def d14_large_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of both tails from such a pool."""
    scored, _ = _scored(spark, sf_dir)
    ranked = calibrate.resampled_p_values(energy.dispersion(scored, "unit_id"), scored, "unit_id", "n_sites", 19, SEED, tail="both", most=4000)
    return ranked.select("unit_id", "null_size", F.round("p_value", 6).alias("p_right"), F.round("mu0", 6).alias("mu0"), F.round("p_left", 6).alias("p_left"))


def d13_shared_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed units against the null of their size class; units 0-4 of the null table are left out as missing contexts."""
    scored, _ = _scored(spark, sf_dir)
    units = energy.dispersion(scored, "unit_id")
    null = _null(scored, units).filter("unit_id >= 5").withColumn("size_class", F.col("unit_id") % 10)
    observed = units.withColumn("size_class", F.col("unit_id") % 20)
    return calibrate.with_shared_null(observed, null, "size_class").select("unit_id", "size_class", "null_size", F.round("p_value", 6).alias("p_value"), "reason")


def d14_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return rows.select("unit_id", "n_sites", F.round("D", 6).alias("D"), F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"), "guard", F.array_join("warnings", ";").alias("warnings"))


#: Training rows, null size, null kind, strict, override of the guardrails that are tried.
_GUARDS = [(2300, 999, "resampled", False, False), (2300, 1000, "gaussian", False, True), (2300, 999, "resampled", True, True), (5000, 1999, "gaussian", True, False), (5000, 999, "resampled", False, False), (100_000, 1000, "resampled", True, False)]


def b25_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches: units of a tenth and of a quarter of the training rows, strict and overridden, every tenth without null spread."""
    units = energy.dispersion(_scored(spark, sf_dir)[0], "unit_id").select("unit_id", "n_sites", F.when(F.col("unit_id") % 10 == 0, 0.0).otherwise(1.0).alias("sigma0"))
    out = None
    for k, (n_rows, null_size, kind, strict, override) in enumerate(_GUARDS):
        one = calibrate.guardrails(units, n_rows, null_size, kind, strict=strict, override=override).select("unit_id", F.lit(k).alias("setting"), "guard", F.array_join("warnings", ";").alias("warnings"))
        out = one if out is None else out.unionByName(one)
    return out


def d15_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = view(spark, sf_dir, "grid").withColumn("half", F.when(F.col("status") == "OK", F.col("p") / 2))
    rates = calibrate.error_rates(grid, "family", ["p", "half"])
    return rates.select("family", "n", F.round("rate_p", 6).alias("rate_p"), F.round("rate_half", 6).alias("rate_half"))


def d5_array_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 features held as an array, with the identity as precision around the overall mean."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    # A mean per place is an aggregate over places, not 64 columns.
    means = rows.select(F.posexplode("embedding").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("mean"))
    d = F.size("mean")
    eye = F.transform(F.sequence(F.lit(1), d), lambda i: F.transform(F.sequence(F.lit(1), d), lambda j: F.when(i == j, F.lit(1.0)).otherwise(0.0)))
    scored = rows.crossJoin(F.broadcast(mean.select("mean", eye.alias("precision")))).withColumn("energy", energy.array_energy(F.col("embedding"), F.col("mean"), F.col("precision")))
    return energy.dispersion(scored, "label").select("label", "n_sites", F.round("mean_energy", 4).alias("mean_energy"), F.round("D", 4).alias("D"))


def e1_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "grid").select("family", "p")
    return fdr.benjamini_hochberg(rows, "p", "q", few=True).groupBy("p").agg(F.count("*").alias("n"), F.round(F.max("q"), 9).alias("q"))


def e1_continuous_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood-ratio p-values, which hardly repeat, ranked range by range."""
    rows = view(spark, sf_dir, "sites").select("l_orderkey", "l_linenumber", F.exp(-F.col("f2") / 20000).alias("p"))
    return fdr.benjamini_hochberg(rows, "p", "q").select("l_orderkey", "l_linenumber", F.round("q", 9).alias("q"))


def e2_scoped_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "methods")
    return fdr.benjamini_hochberg(rows, scope="status = 'OK' AND unit_id % 2 = 0").select("ord", F.round("q_value", 9).alias("q_value"))


def e3_grouped_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "methods")
    # p-values of this table lie on a grid of a thousandth.
    both = fdr.benjamini_hochberg(fdr.benjamini_hochberg(rows, by=["method"], few=True), q="q_null_one", by=["method"], null_as_one=True, few=True)
    return both.select("ord", F.round("q_value", 9).alias("q_value"), F.round("q_null_one", 9).alias("q_null_one"))


def f39_recompute_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fdr.benjamini_hochberg(view(spark, sf_dir, "methods"), by=["method"]).withColumn("q_value", F.when(F.col("ord") % 50 == 0, F.col("q_value") + F.col("ord") % 7 / 1000).otherwise(F.col("q_value")))
    audit = fdr.recompute_audit(rows, "method", unit="ord", tie=F.col("ord") / 1e9)
    return audit.select("method", "n", "n_missing", F.round("max_gap", 9).alias("max_gap"), "n_differ", "worst_unit")


_MODEL = """model AS (SELECT count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, covar_samp(f1, f1) + 1e-5 AS a, covar_samp(f1, f2) AS b, covar_samp(f2, f2) + 1e-5 AS c FROM sites),
scored AS (SELECT unit_id, l_orderkey, l_linenumber, l_partkey, f1 - m1 AS x, f2 - m2 AS y, a, b, c, a * c - b * b AS det,
  (c * (f1 - m1) * (f1 - m1) - 2 * b * (f1 - m1) * (f2 - m2) + a * (f2 - m2) * (f2 - m2)) / (a * c - b * b) / 2 AS energy FROM sites, model),
units AS (SELECT unit_id, count(*) AS n_sites, avg(energy) AS mean_energy, var_pop(energy) AS D FROM scored GROUP BY unit_id)"""
_CORE = with_views("sites") + ", " + _MODEL
_DRAWN = drawn_sql("draws", "unit_id, rep", "key", "rep", "i")
_NULL = (
    _CORE
    + f""", total AS (SELECT count(*) AS k FROM scored),
pool AS (SELECT energy, row_number() OVER (ORDER BY energy) - 1 AS idx FROM scored),
draws AS (SELECT unit_id, key, rep, unnest(range(1, n_sites + 1)) AS i FROM (SELECT unit_id, n_sites, ('0x' || substr(md5(concat_ws('|', '{SEED}', unit_id)), 1, 7))::BIGINT AS key FROM units), (SELECT unnest(range({REPLICATES})) AS rep)),
{_DRAWN},
placed AS (SELECT unit_id, rep, x % (SELECT k FROM total) AS idx FROM drawn),
nulls AS (SELECT unit_id, rep, var_pop(energy) AS D FROM placed JOIN pool USING (idx) GROUP BY unit_id, rep),
ranked AS (SELECT u.unit_id, u.n_sites, u.D, count(n.D) AS null_size, (1 + count(*) FILTER (n.D >= u.D)) / (count(n.D) + 1) AS p_right,
  (1 + count(*) FILTER (n.D <= u.D)) / (count(n.D) + 1) AS p_left, avg(n.D) AS mu0, stddev_pop(n.D) AS sigma0
  FROM units u LEFT JOIN nulls n ON n.unit_id = u.unit_id GROUP BY u.unit_id, u.n_sites, u.D),
q AS (SELECT a.unit_id, least(1.0, min(b.p_right * (SELECT count(*) FROM ranked) / (SELECT count(*) FROM ranked c WHERE c.p_right <= b.p_right))) AS q_value
  FROM ranked a JOIN ranked b ON b.p_right >= a.p_right GROUP BY a.unit_id)"""
)
_FLAGSHIP = _NULL + "SELECT r.unit_id, n_sites, round(D, 6) AS D, round(p_right, 6) AS p_value, round(q_value, 6) AS q_value FROM ranked r JOIN q ON q.unit_id = r.unit_id"


def _bh(source: str, keys: str, p: str, on: str = "TRUE") -> str:
    """SQL of (keys, p, q) by comparing distinct p-values, for a table source with column p."""
    return f"""cnt AS (SELECT {keys} {p} AS p, count(*) AS c FROM {source} WHERE {p} IS NOT NULL GROUP BY ALL),
rk AS (SELECT {keys} p, sum(c) OVER (PARTITION BY {on} ORDER BY p) AS r, sum(c) OVER (PARTITION BY {on}) AS n FROM cnt),
bh AS (SELECT {keys} p, least(1.0, min(p * n / r) OVER (PARTITION BY {on} ORDER BY p DESC)) AS q FROM rk)"""


def _gaussian(replicates: int, uses: int, energy: str) -> str:
    """SQL of a Gaussian null from `uses` draws at each place."""
    each = ", ".join(drawn_sql("places", "n_sites, rep, i", "key", "rep", f"i * {uses} + {k}", f"drawn{k}") for k in range(uses))
    joined = "drawn0" + "".join(f" JOIN drawn{k} USING (n_sites, rep, i)" for k in range(1, uses))
    columns = ", ".join(f"drawn{k}.x AS x{k}" for k in range(uses))
    return (
        _CORE
        + f""", places AS (SELECT n_sites, key, rep, unnest(range(1, n_sites + 1)) AS i FROM (SELECT DISTINCT n_sites, ('0x' || substr(md5(concat_ws('|', '{SEED}', 'normal', n_sites)), 1, 7))::BIGINT AS key FROM units), (SELECT unnest(range({replicates})) AS rep)),
{each}, e AS (SELECT n_sites, rep, {columns} FROM {joined})
SELECT n_sites, rep, round(var_pop({energy.format(p=DRAWS)}), 6) AS D FROM e GROUP BY n_sites, rep"""
    )


QUERIES = {f.__name__: f for f in (flagship, flagship_199, flagship_all, d3_moments, d4_training_sample, d5_energy, d5_array_energy, d6_gradient, d7_dispersion, d8_index, d9_rank_p, d10_two_sided_p, d11_gaussian_null, d11_gaussian_null_of_three, d12_resampled_null, d9_supplied_null, d12_large_pool, d14_large_pool, d13_shared_null, b25_guardrails, d14_batch_scores, d15_error_rates, e1_benjamini_hochberg, e1_continuous_p, e2_scoped_q, e3_grouped_q, f39_recompute_audit)}
_PAIRS = [(f"f{i}", f"f{j}") for i in range(1, 5) for j in range(i, 5)]
ORACLE = {
    "flagship": _FLAGSHIP,
    "flagship_all": _FLAGSHIP,
    "flagship_199": _FLAGSHIP.replace(f"range({REPLICATES})", "range(199)"),
    "d11_gaussian_null": _gaussian(5, 1, "-ln((x0 + 0.5) / {p})"),
    "d11_gaussian_null_of_three": _gaussian(3, 3, "-ln((x0 + 0.5) / {p}) - ln((x1 + 0.5) / {p}) * pow(cos(2 * pi() * (x2 + 0.5) / {p}), 2)"),
    "d3_moments": with_views("sites") + "SELECT count(*) AS n, " + ", ".join(f"round(avg(f{i}), 4) AS avg_f{i}" for i in range(1, 5)) + ", " + ", ".join(f"round(covar_samp({a}, {b}), 4) AS cov_{a}_{b}" for a, b in _PAIRS) + " FROM sites",
    "d4_training_sample": with_views("sites") + f"SELECT DISTINCT {', '.join(_KEY)} FROM sites ORDER BY md5(concat_ws('|', '7', {', '.join(_KEY)})), {', '.join(_KEY)} LIMIT 1000",
    "d5_energy": _CORE + f"SELECT {', '.join(_KEY)}, round(energy, 6) AS energy FROM scored",
    "d5_array_energy": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
m AS (SELECT place, avg(x) AS m FROM e GROUP BY place), s AS (SELECT vec_id, label, sum((x - m) * (x - m)) / 2 AS energy FROM e JOIN m USING (place) GROUP BY vec_id, label)
SELECT label, count(*) AS n_sites, round(avg(energy), 4) AS mean_energy, round(var_pop(energy), 4) AS D FROM s GROUP BY label""",
    "d6_gradient": _CORE + f"SELECT {', '.join(_KEY)}, round((c * x - b * y) / det, 6) AS g1, round((a * y - b * x) / det, 9) AS g2, round((a + c) / det, 9) AS laplacian FROM scored",
    "d7_dispersion": _CORE + "SELECT unit_id, n_sites, round(mean_energy, 6) AS mean_energy, round(D, 6) AS D FROM units",
    "d8_index": _NULL + "SELECT unit_id, round(mu0, 6) AS mu0, round(sigma0, 6) AS sigma0, round(CASE WHEN sigma0 = 0 THEN 0 ELSE (D - mu0) / sigma0 END, 4) AS idx FROM ranked",
    "d9_rank_p": _NULL + "SELECT unit_id, null_size, round(p_right, 6) AS p_right, round(p_left, 6) AS p_left, 'OK' AS status FROM ranked",
    "d10_two_sided_p": _NULL + """, mid AS (SELECT unit_id, median(D) AS m FROM (SELECT unit_id, D FROM nulls UNION ALL SELECT unit_id, D FROM units) GROUP BY unit_id)
SELECT u.unit_id, round((1 + count(*) FILTER (round(abs(n.D - m), 12) >= round(abs(u.D - m), 12))) / (count(*) + 1), 6) AS p_value FROM units u JOIN mid USING (unit_id) JOIN nulls n ON n.unit_id = u.unit_id GROUP BY u.unit_id""",
    "d9_supplied_null": _NULL + "SELECT unit_id, null_size, round(p_right, 6) AS p_right, round(p_left, 6) AS p_left, 'OK' AS status FROM ranked",
    "d12_large_pool": _NULL.replace(f"range({REPLICATES})", "range(19)") + "SELECT unit_id, rep, round(D, 6) AS D FROM nulls",
    "d14_large_pool": _NULL.replace(f"range({REPLICATES})", "range(19)") + "SELECT unit_id, null_size, round(p_right, 6) AS p_right, round(mu0, 6) AS mu0, round(p_left, 6) AS p_left FROM ranked",
    "d12_resampled_null": _NULL + "SELECT unit_id, rep, round(D, 6) AS D FROM nulls",
    "d13_shared_null": _NULL + """SELECT u.unit_id, u.unit_id % 20 AS size_class, count(n.D) AS null_size, CASE WHEN count(n.D) > 0 THEN round((1 + count(*) FILTER (n.D >= u.D)) / (count(n.D) + 1), 6) END AS p_value,
CASE WHEN count(n.D) > 0 THEN 'ok' ELSE 'missing_context_calibration' END AS reason FROM units u LEFT JOIN nulls n ON n.unit_id >= 5 AND n.unit_id % 10 = u.unit_id % 20 GROUP BY u.unit_id""",
    "d14_batch_scores": _NULL + """SELECT r.unit_id, n_sites, round(D, 6) AS D, round(p_right, 6) AS p_value, round(q_value, 6) AS q_value,
CASE WHEN n_sites / (SELECT n FROM model) > 0.25 THEN 'FAIL' ELSE 'OK' END AS guard,
concat_ws(';', CASE WHEN n_sites / (SELECT n FROM model) > 0.1 THEN 'size_ratio' END, 'small_null', CASE WHEN sigma0 = 0 THEN 'zero_spread' END) AS warnings FROM ranked r JOIN q ON q.unit_id = r.unit_id""",
    "b25_guardrails": _CORE
    + f""", g AS (SELECT * FROM (VALUES {', '.join(f"({k}, {n}, {null}, '{kind}', {strict}, {override})" for k, (n, null, kind, strict, override) in enumerate(_GUARDS))}) AS t(setting, n_rows, null_size, kind, strict, override))
SELECT unit_id, setting, CASE WHEN (n_sites / n_rows > 0.25 AND NOT override) OR (n_sites / n_rows > 0.1 AND strict) THEN 'FAIL' ELSE 'OK' END AS guard,
concat_ws(';', CASE WHEN n_sites / n_rows > 0.1 THEN 'size_ratio' END, CASE WHEN null_size < 1000 THEN 'small_null' END, CASE WHEN unit_id % 10 = 0 THEN 'zero_spread' END, CASE WHEN kind = 'gaussian' THEN 'gaussian_null' END) AS warnings FROM units, g""",
    "d15_error_rates": with_views("grid") + "SELECT family, count(*) AS n, round(avg((p <= 0.05)::INT), 6) AS rate_p, round(avg(coalesce(CASE WHEN status = 'OK' THEN p / 2 END <= 0.05, FALSE)::INT), 6) AS rate_half FROM grid GROUP BY family",
    "e1_benjamini_hochberg": with_views("grid") + ", " + _bh("grid", "", "p") + "SELECT cnt.p, cnt.c AS n, round(q, 9) AS q FROM cnt JOIN bh USING (p)",
    "e1_continuous_p": with_views("sites") + ", c AS (SELECT l_orderkey, l_linenumber, exp(-f2 / 20000) AS p FROM sites), " + _bh("c", "", "p") + "SELECT l_orderkey, l_linenumber, round(q, 9) AS q FROM c JOIN bh USING (p)",
    "e2_scoped_q": with_views("methods") + ", s AS (SELECT * FROM methods WHERE status = 'OK' AND unit_id % 2 = 0), " + _bh("s", "", "p_value") + "SELECT ord, CASE WHEN status = 'OK' AND unit_id % 2 = 0 THEN round(q, 9) END AS q_value FROM methods LEFT JOIN bh ON bh.p = p_value",
    "e3_grouped_q": with_views("methods") + ", one AS (SELECT *, coalesce(p_value, 1.0) AS p1 FROM methods), " + _bh("one", "method,", "p_value", "method") + ", " + _bh("one", "method,", "p1", "method").replace("cnt", "cnt1").replace("rk", "rk1").replace("bh", "bh1") + "SELECT ord, round(bh.q, 9) AS q_value, round(bh1.q, 9) AS q_null_one FROM one LEFT JOIN bh ON bh.p = p_value AND bh.method = one.method LEFT JOIN bh1 ON bh1.p = p1 AND bh1.method = one.method",
    "f39_recompute_audit": with_views("methods") + ", " + _bh("methods", "method,", "p_value", "method") + """, g AS (SELECT m.method, ord, q, CASE WHEN ord % 50 = 0 THEN q + ord % 7 / 1000 ELSE q END AS stored FROM methods m LEFT JOIN bh ON bh.p = p_value AND bh.method = m.method)
SELECT method, count(*) AS n, count(*) FILTER (stored IS NULL) AS n_missing, round(max(abs(stored - q)), 9) AS max_gap, count(*) FILTER (abs(stored - q) > 1e-9) AS n_differ, arg_max(ord, abs(stored - q) * 1e9 + ord / 1e9) AS worst_unit FROM g GROUP BY method""",
}
