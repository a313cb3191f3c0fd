"""Joins, comparisons and summary tables over method results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.operators import compare as C
from unitscope.operators import fdr
from unitscope.operators import summary as Y
from unitscope.plans.views import register, table, view

QUERIES, ORACLE, query = register()
METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _r(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def _last(spark: SparkSession, d: str, method: str) -> DataFrame:
    return C.keep_last(view(spark, d, "methods").filter(F.col("method") == method), ["unit_id"], "ord")


_LAST = "lastm AS (SELECT * FROM methods QUALIFY row_number() OVER (PARTITION BY unit_id, method ORDER BY ord DESC) = 1)"


@query(f"{_LAST}, m AS (SELECT c_custkey AS unit_id FROM customer) SELECT m.unit_id, " + ", ".join(f"max(p_value) FILTER (method = '{m}') AS \"{m}_p\", max(status) FILTER (method = '{m}') AS \"{m}_status\", max(reason) FILTER (method = '{m}') AS \"{m}_reason\"" for m in METHODS) + " FROM m LEFT JOIN lastm ON lastm.unit_id = m.unit_id GROUP BY m.unit_id", "methods")
def c1_discovery_table(spark: SparkSession, d: str) -> DataFrame:
    return C.discovery_table(table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id")), view(spark, d, "methods"), METHODS)


@query(f"{_LAST} SELECT c_custkey AS unit_id, ord, p_value FROM customer LEFT JOIN lastm ON lastm.unit_id = c_custkey AND method = '2-HIGH'", "methods")
def c2_keep_last_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id")).join(_last(spark, d, "2-HIGH").select("unit_id", "ord", "p_value"), "unit_id", "left")


@query(f"{_LAST} SELECT a.unit_id, a.p_value AS p_a, b.p_value AS p_b FROM lastm a JOIN lastm b ON a.unit_id = b.unit_id AND a.method = '1-URGENT' AND b.method = '5-LOW' WHERE a.p_value IS NOT NULL AND b.p_value IS NOT NULL", "methods")
def c3_paired(spark: SparkSession, d: str) -> DataFrame:
    return C.paired(_last(spark, d, "1-URGENT"), _last(spark, d, "5-LOW"), "unit_id")


@query("k AS (SELECT family, taxa, L, avg(runtime_sec) AS cov FROM grid WHERE taxa < 6 GROUP BY ALL) SELECT g.family, g.taxa, g.L, count(*) AS n, round(max(cov), 6) AS cov FROM grid g LEFT JOIN k ON k.family = g.family AND k.taxa = g.taxa AND k.L = g.L GROUP BY ALL", "grid")
def c4_covariates(spark: SparkSession, d: str) -> DataFrame:
    grid = view(spark, d, "grid")
    cov = grid.filter("taxa < 6").groupBy("family", "taxa", "L").agg(F.avg("runtime_sec").alias("cov"))
    return _r(grid.join(cov, ["family", "taxa", "L"], "left").groupBy("family", "taxa", "L").agg(F.count("*").alias("n"), F.max("cov").alias("cov")), 6, "cov")


@query("""WITH l AS (SELECT p_partkey, p_size, unnest([p_brand, p_type, p_name]) AS k, unnest([0, 1, 2]) AS pr FROM part), f AS (SELECT k, p_size FROM l WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr, p_partkey) = 1),
n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'none' END AS name FROM part) SELECT p_partkey, name, p_size AS found FROM n LEFT JOIN f ON f.k = n.name""")
def c5_priority_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    names = part.selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'none' END AS name")
    lookup = part.selectExpr("p_brand", "p_type", "p_name", "p_partkey AS ord", "p_size AS found")
    return C.priority_lookup(names, "name", lookup, ["p_brand", "p_type", "p_name"], "ord", "found")


def _sets(spark: SparkSession, d: str) -> list[DataFrame]:
    m = view(spark, d, "methods")
    return [m.filter(F.col("method") == x).select("unit_id").distinct() for x in METHODS[:3]]


_SETS = "a AS (SELECT DISTINCT unit_id FROM methods WHERE method = '1-URGENT'), b AS (SELECT DISTINCT unit_id FROM methods WHERE method = '2-HIGH'), c AS (SELECT DISTINCT unit_id FROM methods WHERE method = '3-MEDIUM')"


@query(f"{_SETS}, u AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c), f AS (SELECT unit_id, unit_id IN (FROM a) AS in_a, unit_id IN (FROM b) AS in_b, unit_id IN (FROM c) AS in_c FROM u) SELECT *, concat_ws(';', CASE WHEN NOT in_a THEN 'missing_in_a' END, CASE WHEN NOT in_b THEN 'missing_in_b' END, CASE WHEN NOT in_c THEN 'missing_in_c' END) AS reasons FROM f WHERE NOT (in_a AND in_b AND in_c)", "methods")
def c6_set_differences(spark: SparkSession, d: str) -> DataFrame:
    return C.set_differences(*_sets(spark, d), "unit_id")


@query(f"{_SETS} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (unit_id)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_a_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_b_only, (SELECT string_agg(unit_id, ',' ORDER BY unit_id) FROM (SELECT * FROM (FROM a EXCEPT FROM b) ORDER BY unit_id LIMIT 20)) AS a_only_ids, (SELECT string_agg(unit_id, ',' ORDER BY unit_id) FROM (SELECT * FROM (FROM b EXCEPT FROM a) ORDER BY unit_id LIMIT 20)) AS b_only_ids, TRUE AS mismatch", "methods")
def c7_set_metrics(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sets(spark, d)
    return C.set_metrics(a, b, "unit_id")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS m FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS m FROM lineitem WHERE l_linenumber >= 3), f AS (SELECT coalesce(a.u, b.u) AS unit_id, a.m IS NOT NULL AS x, b.m IS NOT NULL AS y FROM a FULL JOIN b ON a.u = b.u AND a.m = b.m)
SELECT unit_id, count(*) FILTER (x AND y) AS n_shared, count(*) FILTER (x AND NOT y) AS n_missing, count(*) FILTER (y AND NOT x) AS n_extra, count(*) FILTER (x <> y) > 0 AS mismatch FROM f GROUP BY unit_id""")
def c8_membership(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").selectExpr("l_suppkey AS unit_id", "l_partkey AS m", "l_linenumber")
    return C.membership(lines.filter("l_linenumber <= 4"), lines.filter("l_linenumber >= 3"), "unit_id", "m")


@query("SELECT unit_id FROM methods WHERE method IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY unit_id HAVING count(DISTINCT method) = 3", "methods")
def c9_contains_all(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods")
    return C.contains_all(rows, rows.filter("method IN ('1-URGENT', '3-MEDIUM', '5-LOW')"), "unit_id", "method")


_RANK = "r AS (SELECT l_suppkey AS member, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_suppkey)"


@query(f"WITH {_RANK}, h AS (SELECT DISTINCT l_orderkey AS unit_id, rank FROM lineitem JOIN r ON member = l_suppkey WHERE rank <= 10), p AS (SELECT unit_id, rank, row_number() OVER (PARTITION BY unit_id ORDER BY rank) AS n FROM h), k AS (SELECT unit_id, max(rank) AS k FROM p WHERE n = rank GROUP BY unit_id) SELECT unit_id, k FROM k WHERE k = (SELECT max(k) FROM k)")
def c10_longest_core(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS unit_id", "l_suppkey AS member")
    return C.longest_core(rows, "unit_id", "member", 10)


@query("""WITH p AS (SELECT DISTINCT p_type AS k FROM part), q AS (SELECT p_partkey AS ord, substr(p_type, 1, 4 + p_partkey % 12) || CASE WHEN p_partkey % 12 = 11 THEN 'x' ELSE '' END AS v FROM part)
SELECT k, v FROM p JOIN q ON starts_with(k, v) OR starts_with(v, k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN k = v THEN 0 ELSE 1 END, ord) = 1""")
def c12_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    right = part.selectExpr("p_partkey AS ord", "concat(substr(p_type, 1, int(4 + p_partkey % 12)), if(p_partkey % 12 = 11, 'x', '')) AS v")
    return C.prefix_match(part.selectExpr("p_type AS k"), right, "k", "v", "ord")


@query("""WITH g AS (SELECT o, CASE WHEN o = 'fixed_lt1' THEN w END AS w, r, f FROM (SELECT unnest(['estimate', 'fixed_lt1']) AS o), (SELECT unnest([0.2, 0.5]) AS w), (SELECT unnest([FALSE, TRUE]) AS r), (SELECT unnest(['F3x4', 'F61']) AS f))
SELECT DISTINCT format('{}_{}_{}_{}', o, coalesce(format('{:.2f}', w), 'na'), CASE WHEN r THEN 'gamma' ELSE 'flat' END, f) AS name, s_suppkey AS unit_id, rep FROM g, supplier, (SELECT unnest(range(3))::INT AS rep)""")
def c13_parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Options crossed, with values for one mode only, and crossed with units and replicates."""
    lit = lambda *x: F.explode(F.array(*(F.lit(v) for v in x)))
    g = spark.range(1).select(lit("estimate", "fixed_lt1").alias("o")).withColumn("w", F.explode(F.when(F.col("o") == "fixed_lt1", F.array(F.lit(0.2), F.lit(0.5))).otherwise(F.array(F.lit(None).cast("double")))))
    g = g.withColumn("r", lit(False, True)).withColumn("f", lit("F3x4", "F61"))
    name = F.format_string("%s_%s_%s_%s", "o", F.when(F.col("w").isNull(), "na").otherwise(F.format_string("%.2f", "w")), F.when(F.col("r"), "gamma").otherwise("flat"), "f")
    return g.select(name.alias("name")).crossJoin(table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit_id"))).withColumn("rep", lit(0, 1, 2))


@query("SELECT m.ord, CASE WHEN k.method IS NULL THEN NULL ELSE p_value END AS p_value, CASE WHEN k.method IS NULL THEN 'FAIL' ELSE status END AS status, CASE WHEN k.method IS NULL THEN 'missing_context_calibration' ELSE reason END AS reason FROM methods m LEFT JOIN (SELECT DISTINCT method FROM methods WHERE method < '3') k ON k.method = m.method", "methods")
def c14_null_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods")
    known = rows.filter("method < '3'").select("method").distinct().withColumn("_k", F.lit(True))
    joined = rows.join(known, "method", "left")
    gone = F.col("_k").isNull()
    return joined.select("ord", F.when(~gone, F.col("p_value")).alias("p_value"), F.when(gone, "FAIL").otherwise(F.col("status")).alias("status"), F.when(gone, "missing_context_calibration").otherwise(F.col("reason")).alias("reason"))


@query("SELECT a.unit_id, a.taxon, substr(a.seq, 1, 30) || substr(b.seq, 31, 30) || substr(a.seq, 61, 30) || substr(b.seq, 91, 6) AS seq FROM aln a JOIN aln b ON a.unit_id = b.unit_id AND a.taxon = b.taxon", "aln")
def c15_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln")
    return C.interleave(rows, rows, ["unit_id", "taxon"], "seq", 30)


@query("SELECT unit_id, taxon, substr(seq, 1, 20) || substr(seq, 41, 20) || substr(seq, 21, 20) AS seq FROM aln", "aln")
def c16_concatenated(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln")
    parts = rows.select("unit_id", "taxon", F.posexplode(F.array(F.substring("seq", 1, 20), F.substring("seq", 41, 20), F.substring("seq", 21, 20))).alias("k", "seq"))
    return C.concatenated(parts, ["unit_id", "taxon"], "k", "seq")


@query("SELECT m.ord, o_custkey AS parent, o_totalprice AS price FROM methods m LEFT JOIN orders ON o_orderkey = ord AND o_orderkey % 2 = 0", "methods")
def c17_back_join(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS ord", "o_custkey AS parent", "o_totalprice AS price")
    return view(spark, d, "methods").select("ord").join(meta, "ord", "left")


_CI = lambda p, n: f"round(greatest(0, {p} - 1.96 * sqrt({p} * (1 - {p}) / greatest({n}, 1))), 6) AS low, round(least(1, {p} + 1.96 * sqrt({p} * (1 - {p}) / greatest({n}, 1))), 6) AS high"


@query(f"e AS (SELECT taxa, L, N AS size_n, alpha, count(*) AS n, avg((p <= alpha)::INT) AS s FROM grid, (SELECT unnest([0.1, 0.05, 0.01, 0.001])::DOUBLE AS alpha) GROUP BY ALL) SELECT taxa, L, size_n, alpha, n, round(s, 6) AS size, {_CI('s', 'n')}, round(s - alpha, 6) AS deviation, round(abs(s - alpha), 6) AS abs_deviation FROM e", "grid")
def f3_f4_empirical_size(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "grid").withColumnRenamed("N", "size_n")
    return _r(Y.empirical_size(rows, ["taxa", "L", "size_n"]), 6, "size", "low", "high", "deviation", "abs_deviation")


@query("""e AS (SELECT family, method, taxa, L, count(*) AS n_total, count(*) FILTER (status = 'OK') AS n_ok, coalesce(avg((p <= 0.05)::INT) FILTER (status = 'OK'), 0) AS a, coalesce(avg((p <= 0.01)::INT) FILTER (status = 'OK'), 0) AS b FROM grid GROUP BY ALL)
SELECT family, method, taxa, L, n_total, n_ok, round(a, 6) AS power_05, round(b, 6) AS power_01, CASE WHEN n_ok = 0 THEN 0 ELSE round(greatest(0, a - 1.96 * sqrt(a * (1 - a) / n_ok)), 6) END AS low_05, CASE WHEN n_ok = 0 THEN 0 ELSE round(least(1, a + 1.96 * sqrt(a * (1 - a) / n_ok)), 6) END AS high_05 FROM e""", "grid")
def f5_power(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.power_table(view(spark, d, "grid"), ["family", "method", "taxa", "L"]), 6, "power_05", "power_01", "low_05", "high_05")


@query("SELECT family, method, count(*) AS n_total, count(*) FILTER (status <> 'OK') AS n_fail, round(count(*) FILTER (status <> 'OK') / count(*), 6) AS rate FROM grid GROUP BY ALL", "grid")
def f6_failure_rates(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.failure_rates(view(spark, d, "grid"), ["family", "method"]), 6, "rate")


@query("u AS (SELECT method, status, reason FROM methods UNION ALL SELECT method, status, 'grid' AS reason FROM grid) SELECT method, status, reason, count(*) AS n FROM u WHERE status <> 'OK' GROUP BY ALL", "methods", "grid")
def f7_failure_audit(spark: SparkSession, d: str) -> DataFrame:
    return Y.failure_audit(view(spark, d, "methods"), view(spark, d, "grid").withColumn("reason", F.lit("grid")))


@query("e AS (SELECT family, method, taxa, L, coalesce(avg((p <= 0.05)::INT) FILTER (status = 'OK'), 0) AS a FROM grid GROUP BY ALL) SELECT family, taxa, L, method, round(a, 6) AS power_05 FROM e QUALIFY row_number() OVER (PARTITION BY family, taxa, L ORDER BY a DESC, method) = 1", "grid")
def f8_regime_map(spark: SparkSession, d: str) -> DataFrame:
    by = ["family", "taxa", "L"]
    return _r(Y.best_methods(Y.power_table(view(spark, d, "grid"), [*by, "method"]), by), 6, "power_05")


@query("SELECT family, round(coalesce(avg((p <= 0.05)::INT) FILTER (method = 'F'), 0), 6) AS F, round(coalesce(avg((p <= 0.05)::INT) FILTER (method = 'O'), 0), 6) AS O FROM grid GROUP BY family", "grid")
def f9_power_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.power_pivot(view(spark, d, "grid"), "family", "method", ["F", "O"], F.col("p") <= 0.05), 6, "F", "O")


@query("SELECT family, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg((p <= 0.05)::INT), 6) AS share_05 FROM grid GROUP BY family", "grid")
def f10_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.scenario_summary(view(spark, d, "grid"), "family"), 6, "mean_p", "share_05")


@query("SELECT taxa, L, method, median(runtime_sec) AS median_sec, round(avg(runtime_sec), 6) AS mean_sec, round(stddev_samp(runtime_sec), 6) AS std_sec FROM grid GROUP BY ALL", "grid")
def f11_runtimes(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.runtimes(view(spark, d, "grid"), ["taxa", "L", "method"]), 6, "mean_sec", "std_sec")


@query("SELECT N AS size_n, count(DISTINCT p) AS n_distinct, count(p) AS n, round(1 / (N + 1), 6) AS step FROM grid GROUP BY grid.N", "grid")
def f12_discreteness(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.discreteness(view(spark, d, "grid").withColumnRenamed("N", "size_n"), "size_n", "p"), 6, "step")


@query("e AS (SELECT min(p) AS lo, max(p) AS hi FROM grid) SELECT CAST(least(floor((p - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM grid, e GROUP BY ALL", "grid")
def f13_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Y.histogram(view(spark, d, "grid"), "p")


_BHM = "s AS (SELECT * FROM lastm WHERE status = 'OK'), cnt AS (SELECT method, p_value AS p, count(*) AS c FROM s GROUP BY ALL), rk AS (SELECT *, sum(c) OVER (PARTITION BY method ORDER BY p) AS r, sum(c) OVER (PARTITION BY method) AS n FROM cnt), bh AS (SELECT method, p, least(1.0, min(p * n / r) OVER (PARTITION BY method ORDER BY p DESC)) AS q FROM rk)"


def _with_q(spark: SparkSession, d: str) -> DataFrame:
    last = C.keep_last(view(spark, d, "methods"), ["unit_id", "method"], "ord")
    return fdr.benjamini_hochberg(last, by=["method"], scope="status = 'OK'")


@query(f"{_LAST}, {_BHM} SELECT m.method, count(*) AS n, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'OK' AND p_value <= 0.05) AS n_p05, count(*) FILTER (q <= 0.9) AS n_q FROM lastm m LEFT JOIN bh ON bh.method = m.method AND bh.p = p_value AND status = 'OK' GROUP BY m.method", "methods")
def f26_discovery_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_q(spark, d)
    ok = F.col("status") == "OK"
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(ok & (F.col("p_value") <= 0.05)).alias("n_p05"), F.count_if(F.col("q_value") <= 0.9).alias("n_q"))


@query(f"{_LAST}, w AS (SELECT unit_id, max(p_value) FILTER (method = '1-URGENT') AS a, max(p_value) FILTER (method = '2-HIGH') AS b, max(p_value) FILTER (method = '5-LOW') AS c FROM lastm GROUP BY unit_id) SELECT concat_ws('|', CASE WHEN a <= 0.3 THEN 'U' ELSE 'u' END, CASE WHEN b <= 0.3 THEN 'H' ELSE 'h' END, CASE WHEN c <= 0.3 THEN 'L' ELSE 'l' END) AS combination, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY 1", "methods")
def f27_combinations(spark: SparkSession, d: str) -> DataFrame:
    wide = C.keep_last(view(spark, d, "methods"), ["unit_id", "method"], "ord").groupBy("unit_id").pivot("method", METHODS).agg(F.first("p_value"))
    return C.combination_counts(wide, {"u": "`1-URGENT` <= 0.3", "h": "`2-HIGH` <= 0.3", "l": "`5-LOW` <= 0.3"}, "`1-URGENT` IS NOT NULL")


_PAIR = f"{_LAST}, {_BHM}, ab AS (SELECT a.unit_id, a.status AS sa, b.status AS sb, x.q AS q_a, y.q AS q_b, a.runtime_sec AS ta, b.runtime_sec AS tb FROM lastm a LEFT JOIN lastm b ON a.unit_id = b.unit_id AND b.method = '5-LOW' LEFT JOIN bh x ON x.method = a.method AND x.p = a.p_value AND a.status = 'OK' LEFT JOIN bh y ON y.method = b.method AND y.p = b.p_value AND b.status = 'OK' WHERE a.method = '1-URGENT')"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_q(spark, d)
    side = lambda method, s: rows.filter(F.col("method") == method).select("unit_id", F.col("status").alias(f"s{s}"), F.col("q_value").alias(f"q_{s}"), F.col("runtime_sec").alias(f"t{s}"))
    return side("1-URGENT", "a").join(side("5-LOW", "b"), "unit_id", "left")


@query(f"{_PAIR} SELECT count(*) AS n_units, count(*) FILTER (sa = 'OK') AS n_ok_a, count(*) FILTER (sb = 'OK') AS n_ok_b, count(*) FILTER (q_a <= 0.95) AS n_q_a, count(*) FILTER (q_b <= 0.95) AS n_q_b, count(*) FILTER (q_a <= 0.95 AND q_b <= 0.95) AS n_both, median(ta) AS median_a, median(tb) AS median_b, round(1 - count(*) FILTER (sa = 'OK') / count(*), 6) AS fail_a, round(1 - count(*) FILTER (sb = 'OK') / count(*), 6) AS fail_b FROM ab", "methods")
def f28_pack_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both failure rates are over the units of the main method."""
    ok = lambda s: F.count_if(F.col(s) == "OK")
    hit = lambda q: F.col(q) <= 0.95
    out = _pairs(spark, d).agg(F.count("*").alias("n_units"), ok("sa").alias("n_ok_a"), ok("sb").alias("n_ok_b"), F.count_if(hit("q_a")).alias("n_q_a"), F.count_if(hit("q_b")).alias("n_q_b"), F.count_if(hit("q_a") & hit("q_b")).alias("n_both"), F.percentile("ta", F.lit(0.5)).alias("median_a"), F.percentile("tb", F.lit(0.5)).alias("median_b"))
    return out.withColumns({"fail_a": F.round(1 - F.col("n_ok_a") / F.col("n_units"), 6), "fail_b": F.round(1 - F.col("n_ok_b") / F.col("n_units"), 6)})


@query(f"{_PAIR} SELECT count(*) AS n, count(*) FILTER (q_a < 0.95) AS n_a, count(*) FILTER (q_b < 0.95) AS n_b, count(*) FILTER (q_a < 0.95 AND q_b < 0.95) AS n_both, count(*) FILTER (q_a < 0.95 AND NOT coalesce(q_b < 0.95, FALSE)) AS n_a_only, count(*) FILTER (q_b < 0.95 AND NOT coalesce(q_a < 0.95, FALSE)) AS n_b_only, count(*) FILTER (NOT coalesce(q_a < 0.95, FALSE) AND NOT coalesce(q_b < 0.95, FALSE)) AS n_neither FROM ab WHERE sa = 'OK' AND sb = 'OK'", "methods")
def f29_paired_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_summary(_pairs(spark, d).filter("sa = 'OK' AND sb = 'OK'"), level=0.95)


@query("""k AS (SELECT count(*) FILTER (discovered AND positive) AS a, count(*) FILTER (discovered AND NOT positive) AS b, count(*) FILTER (NOT discovered AND positive) AS c, count(*) FILTER (NOT discovered AND NOT positive) AS d FROM labelled), h AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS z FROM k),
x AS (SELECT unnest(range(a, least(a + b, a + c) + 1)) AS x, a, b, c, d FROM k), t AS (SELECT sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1))) AS p FROM x),
l AS (SELECT *, ln((a + z) * (d + z) / ((b + z) * (c + z))) AS lr, sqrt(1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z)) AS se FROM h)
SELECT a, b, c, d, round(exp(lr), 6) AS odds_ratio, round(exp(lr - 1.96 * se), 6) AS low, round(exp(lr + 1.96 * se), 6) AS high, round(least(1, p), 6) AS p_value FROM l, t""", "labelled")
def f30_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return _r(Y.enrichment(view(spark, d, "labelled"), "discovered", "positive"), 6, "odds_ratio", "low", "high", "p_value")


@query("SELECT " + ", ".join(f"{f}({c}) AS {n}_{c}" for c in ("l_linenumber", "l_suppkey") for n, f in (("median", "median"), ("max", "max"), ("sum", "sum"))) + ", " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("l_linenumber", "l_suppkey")) + ", round(avg((trim(l_comment) <> '')::INT), 6) AS filled_l_comment FROM (SELECT l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN ' ' ELSE l_returnflag END AS l_comment FROM lineitem)")
def f31_roll_up(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_linenumber", "l_suppkey", "if(l_linenumber = 1, ' ', l_returnflag) AS l_comment")
    return _r(Y.roll_up(rows, ["l_linenumber", "l_suppkey"], ["l_comment"]), 6, "mean_l_linenumber", "mean_l_suppkey", "filled_l_comment")


@query("SELECT l_suppkey AS member, count(DISTINCT l_orderkey) AS n_units, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_suppkey")
def f34_member_ranking(spark: SparkSession, d: str) -> DataFrame:
    return C.member_ranking(table(spark, d, "lineitem").selectExpr("l_orderkey AS u", "l_suppkey AS member"), "u", "member")


@query("SELECT array_to_string(list_sort(list(DISTINCT method)), ',') AS method, array_to_string(list_sort(list(DISTINCT status)), ',') AS status, min(unit_id) AS seed_min, max(unit_id) AS seed_max, count(DISTINCT unit_id) AS n_seeds, sha256(array_to_string(list_sort(list(DISTINCT unit_id)), ',')) AS seed_hash FROM methods", "methods")
def f36_provenance(spark: SparkSession, d: str) -> DataFrame:
    return Y.provenance(view(spark, d, "methods"), ["method", "status"], "unit_id")


@query("e AS (SELECT method AS event, CASE WHEN method = '5-LOW' AND ord % 97 = 0 THEN 'drift' WHEN method = '4-NOT SPECIFIED' THEN 'other' ELSE 'frozen' END AS h FROM methods) SELECT event, count(DISTINCT h) AS n_values, min(h) AS \"value\", count(*) FILTER (h IS NULL) AS n_missing, CASE WHEN count(DISTINCT h) = 1 AND min(h) = 'frozen' THEN 'PASS' ELSE 'FAIL' END AS status FROM e GROUP BY event", "methods")
def f37_invariants(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "methods").selectExpr("method AS event", "CASE WHEN method = '5-LOW' AND ord % 97 = 0 THEN 'drift' WHEN method = '4-NOT SPECIFIED' THEN 'other' ELSE 'frozen' END AS h")
    return Y.invariant(events, "event", "h", "frozen")


@query(f"{_LAST}, top AS (SELECT unit_id FROM lastm WHERE method = '1-URGENT' AND p_value IS NOT NULL ORDER BY p_value, unit_id LIMIT 12) SELECT top.unit_id, " + ", ".join(f"round(coalesce(max(-log10(p_value)) FILTER (method = '{m}'), 0), 6) AS \"{m}\"" for m in METHODS) + " FROM top LEFT JOIN lastm USING (unit_id) GROUP BY top.unit_id", "methods")
def f40_best_unit_scores(spark: SparkSession, d: str) -> DataFrame:
    last = C.keep_last(view(spark, d, "methods"), ["unit_id", "method"], "ord")
    top = last.filter("method = '1-URGENT' AND p_value IS NOT NULL").orderBy("p_value", "unit_id").limit(12).select("unit_id")
    wide = last.join(F.broadcast(top), "unit_id", "left_semi").groupBy("unit_id").pivot("method", METHODS).agg(F.max(-F.log10("p_value"))).na.fill(0.0)
    return wide.select("unit_id", *(F.round(F.col(f"`{m}`"), 6).alias(m) for m in METHODS))


@query("SELECT * FROM (SELECT 'n_units' AS name, count(DISTINCT unit_id)::DOUBLE AS observed, 300.0::DOUBLE AS required FROM methods UNION ALL SELECT 'ok_share', round(avg((status = 'OK')::INT), 6), 0.95::DOUBLE FROM methods UNION ALL SELECT 'n_ok', count(*) FILTER (status = 'OK')::DOUBLE, 200.0::DOUBLE FROM methods) g, LATERAL (SELECT observed >= required AS passed)", "methods")
def b26_gates(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "OK"
    return _r(Y.gates(view(spark, d, "methods"), {"n_units": (F.count_distinct("unit_id"), 300), "ok_share": (F.avg(ok.cast("int")), 0.95), "n_ok": (F.count_if(ok), 200)}), 6, "observed")


@query("SELECT method, ord, kind, p_value, family FROM (SELECT method, ord, 'real' AS kind, p_value, NULL AS family FROM methods UNION ALL SELECT method, NULL, 'grid', p, family FROM grid)", "methods", "grid")
def h1_union(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "methods").select("method", "ord", F.lit("real").alias("kind"), "p_value")
    b = view(spark, d, "grid").select("method", F.lit("grid").alias("kind"), F.col("p").alias("p_value"), "family")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"{_SETS} SELECT 'both' AS part, unit_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'a_only', unit_id FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', unit_id FROM (FROM a UNION FROM b)", "methods")
def h2_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sets(spark, d)
    parts = {"both": a.intersect(b), "a_only": a.subtract(b), "any": a.union(b).distinct()}
    named = [df.select(F.lit(name).alias("part"), "unit_id") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT l_shipmode AS member, count(DISTINCT l_suppkey) AS n_units, count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS shared FROM (SELECT l_suppkey, l_returnflag || l_linenumber || CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE '' END AS l_shipmode FROM lineitem) GROUP BY 1")
def h3_in_every_unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS u", "concat(l_returnflag, l_linenumber, if(l_suppkey % 9 = 0, 'x', '')) AS member")
    return C.in_every_unit(rows, "u", "member")
