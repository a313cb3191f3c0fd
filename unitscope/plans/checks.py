"""Diagnostics, sampling, quality control, trees and table sources over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.functions import sequences as Q
from unitscope.functions.statistics import canonical_number_sql
from unitscope.operators import alignments as A
from unitscope.operators import compare as C
from unitscope.operators import diagnostics as D
from unitscope.operators import qc as V
from unitscope.operators import sampling as G
from unitscope.operators import summary as Y
from unitscope.operators import trees as T
from unitscope.plans.results import _with_q
from unitscope.plans.views import register, table, view
from unitscope.sources import tables as S

QUERIES, ORACLE, query = register()


def _r(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


_LAM = 'l AS (SELECT k / 100 AS "lambda", least(1.0, count(*) FILTER (p > k / 100) / greatest((1 - k / 100) * count(*), 1)) AS pi0, count(*) AS n FROM grid, (SELECT unnest(range(50, 100, 5)) AS k) GROUP BY k)'


@query(f"{_LAM} SELECT \"lambda\", n, round(pi0, 6) AS pi0 FROM l", "grid")
def f14_storey_rows(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.storey(view(spark, d, "grid"), "p"), 6, "pi0")


@query(f"{_LAM} SELECT max(n) AS n, round(median(pi0), 6) AS pi0, round((1 - median(pi0)) * max(n), 3) AS n_alternative FROM l", "grid")
def f14_null_proportion(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(D.null_proportion(view(spark, d, "grid"), "p"), 6, "pi0"), 3, "n_alternative")


def _ks(source: str, u: str) -> str:
    return f"ks AS (SELECT max(n) AS n, max(greatest(upto / n - v, v - (upto - c) / n)) AS ks FROM (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () AS n FROM (SELECT {u} AS v, count(*) AS c FROM {source} GROUP BY 1)))"


@query(f"t AS (SELECT (p - 0.2) / 0.8 AS u FROM grid WHERE p BETWEEN 0.2 AND 1), {_ks('t', 'u')} SELECT n, round(ks, 6) AS ks FROM ks", "grid")
def f15_ks_tail(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.ks_uniform(view(spark, d, "grid"), "p", 0.2, 1.0).select("n", "ks"), 6, "ks")


@query(f"{_ks('grid', 'p')} SELECT n, round(ks, 9) AS ks, round(CASE WHEN ks * sqrt(n) < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * (SELECT sum((CASE k % 2 WHEN 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * ks * ks * n)) FROM range(1, 101) t(k)))) END, 9) AS ks_p FROM ks", "grid")
def f15_ks_with_tail(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.ks_uniform(view(spark, d, "grid"), "p"), 9, "ks", "ks_p")


_GRIDKS = "kd AS (SELECT max(abs(s - k / 1000)) AS ks_discrete FROM (SELECT k, coalesce(sum(c) OVER (ORDER BY k), 0) / (SELECT count(*) FROM grid) AS s FROM (SELECT unnest(range(1, 1001)) AS k) LEFT JOIN (SELECT CAST(round(p * 1000) AS BIGINT) AS k, count(*) AS c FROM grid GROUP BY 1) USING (k)))"


@query(f"{_GRIDKS} SELECT round(ks_discrete, 6) AS ks_discrete FROM kd", "grid")
def f16_ks_grid(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.ks_grid(view(spark, d, "grid"), "p", 999), 6, "ks_discrete")


@query(f"{_GRIDKS}, {_ks('grid', 'p')}, b AS (SELECT count(*) AS n, avg(p) AS m, avg((p <= 0.05)::INT) AS t FROM grid) SELECT b.n, round(m, 6) AS mean_p, round(t, 6) AS tail_05, round((t - 0.05) / sqrt(0.05 * 0.95 / b.n), 6) AS z, round(ks, 6) AS ks, round(ks_discrete, 6) AS ks_discrete, ((t - 0.05) / sqrt(0.05 * 0.95 / b.n) > 4 AND t > 0.05) OR ks_discrete > 0.08 AS severe FROM b, ks, kd", "grid")
def f17_null_uniformity(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.null_uniformity(view(spark, d, "grid"), "p", 999), 6, "mean_p", "tail_05", "z", "ks", "ks_discrete")


@query("SELECT family, alpha, count(*) AS n, count(*) FILTER (p <= alpha) AS hits FROM grid, (SELECT unnest([0.1, 0.05, 0.01])::DOUBLE AS alpha) GROUP BY ALL", "grid")
def f18_size_counts(spark: SparkSession, d: str) -> DataFrame:
    each = view(spark, d, "grid").withColumn("alpha", F.explode(F.array(F.lit(0.1), F.lit(0.05), F.lit(0.01))))
    return each.groupBy("family", "alpha").agg(F.count("*").alias("n"), F.count_if(F.col("p") <= F.col("alpha")).alias("hits"))


#: The bounds are where a binomial tail reaches its share, by bisection.
_INTERVAL = """c AS (SELECT family, alpha, count(*) AS n, count(*) FILTER (p <= alpha) AS hits FROM grid, (SELECT unnest([0.1, 0.05, 0.01])::DOUBLE AS alpha) GROUP BY ALL),
q AS (SELECT family, alpha, side, hits + side AS k, n, CASE side WHEN 0 THEN 0.025 ELSE 0.975 END AS want FROM c, (SELECT unnest([0, 1]) AS side)),
b AS (SELECT family, alpha, side, k, n, want, 0::DOUBLE AS low, 1::DOUBLE AS high, 0 AS turn FROM q
  UNION ALL SELECT family, alpha, side, k, n, want, CASE WHEN t < want THEN (low + high) / 2 ELSE low END, CASE WHEN t < want THEN high ELSE (low + high) / 2 END, turn + 1
  FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((low + high) / 2) + (n - j) * ln(1 - (low + high) / 2)))) AS t FROM b WHERE turn < 45)),
e AS (SELECT family, alpha, max((low + high) / 2) FILTER (side = 0) AS low, max((low + high) / 2) FILTER (side = 1) AS high FROM b WHERE turn = 45 GROUP BY ALL),
i AS (SELECT c.*, CASE WHEN hits = 0 THEN 0 ELSE low END AS low, CASE WHEN hits = n THEN 1 ELSE high END AS high FROM c JOIN e USING (family, alpha))
SELECT family, alpha, n, hits, round(low, 6) AS low, round(high, 6) AS high, alpha BETWEEN low AND high AS inside, CASE WHEN alpha = 0.05 AND low > 0.05 THEN 'FAIL' ELSE 'OK' END AS status FROM i"""


@query(_INTERVAL, "grid")
def f18_exact_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes with their exact intervals; inflated ones at .05 fail."""
    counts = f18_size_counts(spark, d)
    low, high = D.exact_interval("hits", "n")
    out = counts.withColumns({"low": low, "high": high}).withColumn("inside", F.col("alpha").between(F.col("low"), F.col("high")))
    out = out.withColumn("status", F.when((F.col("alpha") == 0.05) & (F.col("low") > 0.05), "FAIL").otherwise("OK"))
    return _r(out, 6, "low", "high")


def _rank(c: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {(by + ', ') if by else ''}{c}) - 1) / 2"


@query(f"r AS (SELECT {_rank('p')} AS x, {_rank('runtime_sec')} AS y FROM grid) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r", "grid")
def f19_spearman(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.spearman(view(spark, d, "grid").select("p", "runtime_sec"), "p", "runtime_sec").select("n", "rho"), 6, "rho")


@query(f"""e AS (SELECT m AS method, v AS covariate, x, y FROM (SELECT *, unnest(['p', 'half']) AS m, unnest([p, CASE WHEN status = 'OK' THEN p END]) AS x FROM grid), LATERAL (SELECT unnest(['L', 'runtime', 'taxa']) AS v, unnest([L::DOUBLE, runtime_sec, taxa::DOUBLE]) AS y) WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT method, covariate, {_rank('x', 'method, covariate')} AS rx, {_rank('y', 'method, covariate')} AS ry FROM e) SELECT method, covariate, count(*) AS n, round(corr(rx, ry), 6) AS rho, abs(corr(rx, ry)) > 0.5 AS strong FROM r GROUP BY ALL""", "grid")
def f20_f21_correlations(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "grid").selectExpr("p", "if(status = 'OK', p, NULL) AS half", "L", "runtime_sec AS runtime", "taxa")
    out = D.correlation_table(rows, ["p", "half"], ["L", "runtime", "taxa"])
    return _r(out.select("method", "covariate", "n", "rho", (F.abs("rho") > 0.5).alias("strong")), 6, "rho")


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT CASE WHEN l_extendedprice <= q[1] THEN 1 WHEN l_extendedprice <= q[2] THEN 2 WHEN l_extendedprice <= q[3] THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg((l_discount <= 0.1)::INT), 6) AS share FROM lineitem, e GROUP BY 1""")
def f22_quartile_rejections(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.quantile_rejections(table(spark, d, "lineitem"), "l_extendedprice", "l_discount"), 6, "share")


@query("SELECT family, count(*) AS n, round(avg((abs(p - 0.001) <= 1e-8 + 1e-8)::INT), 6) AS share_floor, round(avg((p <= 0.002)::INT), 6) AS share_002, round(avg(p), 6) AS mean_p FROM grid GROUP BY family", "grid")
def f23_grid_floor(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.grid_floor(view(spark, d, "grid"), "family", "p", 999), 6, "share_floor", "share_002", "mean_p")


@query("SELECT round(avg(p), 6) AS mean_p, round(avg((p <= 0.01)::INT), 6) AS share_01, round(avg((p <= 0.05)::INT), 6) AS share_05, round(avg((p <= 0.1)::INT), 6) AS share_10, round(avg((p = 0.001)::INT), 6) AS share_floor FROM grid", "grid")
def f24_null_validation(spark: SparkSession, d: str) -> DataFrame:
    out = D.null_validation(view(spark, d, "grid"), "p", 999)
    return _r(out, 6, *out.columns)


_LASTQ = "lastm AS (SELECT * FROM methods QUALIFY row_number() OVER (PARTITION BY unit_id, method ORDER BY ord DESC) = 1), cnt AS (SELECT method, p_value AS p, count(*) AS c FROM lastm WHERE status = 'OK' GROUP BY ALL), rk AS (SELECT *, sum(c) OVER (PARTITION BY method ORDER BY p) AS r, sum(c) OVER (PARTITION BY method) AS n FROM cnt), bh AS (SELECT method, p, least(1.0, min(p * n / r) OVER (PARTITION BY method ORDER BY p DESC)) AS q FROM rk)"


@query(f"{_LASTQ} SELECT m.method, count(*) AS n, round(avg((coalesce(q, 1) < 0.9)::INT), 6) AS share_q, round(avg(p_value), 6) AS mean_p, round(avg(q), 6) AS mean_q, count(*) FILTER (p_value = 0.001) AS n_floor FROM lastm m LEFT JOIN bh ON bh.method = m.method AND bh.p = p_value AND status = 'OK' GROUP BY m.method", "methods")
def f25_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_q(spark, d)
    out = rows.groupBy("method").agg(F.count("*").alias("n"), F.avg((F.coalesce("q_value", F.lit(1.0)) < 0.9).cast("int")).alias("share_q"), F.avg("p_value").alias("mean_p"), F.avg("q_value").alias("mean_q"), F.count_if(F.col("p_value") == 0.001).alias("n_floor"))
    return _r(out, 6, "share_q", "mean_p", "mean_q")


@query("c AS (SELECT p, count(*) AS c FROM grid GROUP BY p), s AS (SELECT p, sum(c) OVER (ORDER BY p) AS i, sum(c) OVER () AS n FROM c) SELECT p, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, round((i - 0.5) / n, 6) AS expected, round(-log10(p), 6) AS observed_score, round(-log10((i - 0.5) / n), 6) AS expected_score FROM s", "grid")
def e4_qq_table(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.qq_table(view(spark, d, "grid"), "p"), 6, "expected", "observed_score", "expected_score")


#: The bounds of rank i are where the binomial tail from i on reaches its share, by bisection; terms beyond twelve deviations from the mean are nothing.
_BAND = """c AS (SELECT p, count(*) AS c FROM grid GROUP BY p), s AS (SELECT p, (sum(c) OVER (ORDER BY p))::BIGINT AS i, (sum(c) OVER ())::BIGINT AS n FROM c),
b AS (SELECT p, i, n, want, 0::DOUBLE AS low, 1::DOUBLE AS high, 0 AS turn FROM s, (SELECT unnest([0.025, 0.975]) AS want)
  UNION ALL SELECT p, i, n, want, CASE WHEN t < want THEN x ELSE low END, CASE WHEN t < want THEN high ELSE x END, turn + 1
  FROM (SELECT *, coalesce(list_sum(list_transform(range(greatest(i, (n * x - 12 * sqrt(n * x * (1 - x)) - 30)::BIGINT), least(n, (n * x + 12 * sqrt(n * x * (1 - x)) + 30)::BIGINT) + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(x) + (n - j) * ln(1 - x)))), 0) AS t FROM (SELECT *, (low + high) / 2 AS x FROM b WHERE turn < 32))),
e AS (SELECT p, max((low + high) / 2) FILTER (want = 0.025) AS low, max((low + high) / 2) FILTER (want = 0.975) AS high FROM b WHERE turn = 32 GROUP BY p)
SELECT p, i, n, round((i - 0.5) / n, 6) AS expected, round(-log10(p), 6) AS observed_score, round(-log10((i - 0.5) / n), 6) AS expected_score, round(low, 6) AS low, round(high, 6) AS high FROM s JOIN e USING (p)"""


@query(_BAND, "grid")
def e4_qq_band(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.qq_table(view(spark, d, "grid"), "p", band=True), 6, "expected", "observed_score", "expected_score", "low", "high")


@query("SELECT o_orderkey, w, w AND coalesce(sum(w::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS kept FROM (SELECT o_orderkey, o_orderstatus = 'F' AS w FROM orders)")
def e8_capped_in_order(spark: SparkSession, d: str) -> DataFrame:
    return G.capped_in_order(table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus = 'F' AS w"), "w", "o_orderkey", 500)


@query("SELECT unit_id, min(ord) AS first_ord, max(ord) AS last_ord FROM methods GROUP BY unit_id", "methods")
def e9_keep_first_last(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods")
    first = C.keep_first(rows, ["unit_id"], "ord").select("unit_id", F.col("ord").alias("first_ord"))
    return first.join(C.keep_last(rows, ["unit_id"], "ord").select("unit_id", F.col("ord").alias("last_ord")), "unit_id")


@query("SELECT * FROM (SELECT 'p' AS list, ord FROM methods WHERE p_value IS NOT NULL ORDER BY p_value, ord LIMIT 50) UNION ALL SELECT * FROM (SELECT 'status' AS list, ord FROM methods ORDER BY status, p_value NULLS LAST, ord LIMIT 200)", "methods")
def e10_top_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods")
    a = rows.filter("p_value IS NOT NULL").orderBy("p_value", "ord").limit(50).select(F.lit("p").alias("list"), "ord")
    return a.unionByName(rows.orderBy("status", F.asc_nulls_last("p_value"), "ord").limit(200).select(F.lit("status").alias("list"), "ord"))


@query("SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, count(*) OVER () AS n FROM customer) WHERE rank IN (0, 1, n - 1) OR rank IN (SELECT CAST(round_even(i * (SELECT count(*) - 1 FROM customer) / 7, 0) AS BIGINT) FROM range(8) t(i)) QUALIFY row_number() OVER (ORDER BY CASE rank WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN n - 1 THEN 2 ELSE 3 END, rank) <= 8")
def e11_spread_pick(spark: SparkSession, d: str) -> DataFrame:
    return G.spread_pick(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 8).select("c_custkey", "rank")


@query("""WITH x AS (SELECT s_suppkey, s_nationkey, round(CASE WHEN sum(greatest(s_acctbal, 0)) OVER w > 0 THEN greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) OVER w * 97 ELSE 97 / count(*) OVER w END, 9) AS x FROM supplier WINDOW w AS (PARTITION BY s_nationkey)),
f AS (SELECT *, floor(x) AS f, round(x - floor(x), 9) AS r FROM x) SELECT s_suppkey, CAST(f + CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY r DESC, s_suppkey) <= 97 - sum(f) OVER (PARTITION BY s_nationkey) THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def e12_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return G.largest_remainder(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey", 97).select("s_suppkey", "share")


@query("SELECT c * n + row_number() OVER (PARTITION BY c ORDER BY md5(concat_ws('|', '5', c, s_suppkey)), s_suppkey) - 1 AS g, s_suppkey FROM supplier, range(4) t(c), (SELECT count(*) AS n FROM supplier) QUALIFY g < n * 7 // 2")
def e13_balanced_replicates(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "supplier").select("s_suppkey")
    return G.balanced_replicates(units, "s_suppkey", units.count() * 7 // 2, 5)


@query("""s AS (SELECT strain, country, row_number() OVER (PARTITION BY CASE WHEN length(collection_date) >= 7 AND substr(collection_date, 5, 1) = '-' THEN substr(collection_date, 1, 7) ELSE 'unknown' END || country ORDER BY md5(concat_ws('|', '3', strain)), strain) AS n FROM meta), k AS (SELECT count(DISTINCT CASE WHEN length(collection_date) >= 7 AND substr(collection_date, 5, 1) = '-' THEN substr(collection_date, 1, 7) ELSE 'unknown' END || country) AS k FROM meta)
SELECT strain, country FROM s, k WHERE n <= ceil(200 / k) ORDER BY strain LIMIT 200""", "meta")
def g1_stratified(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "meta")
    return G.stratified(rows, "strain", F.concat(Q.month_of(F.col("collection_date")), "country"), 200, 3).select("strain", "country")


@query("""f AS (SELECT strain, country FROM meta WHERE CAST(coalesce(try_strptime(collection_date, '%Y-%m-%d'), try_strptime(collection_date, '%Y-%m'), try_strptime(collection_date, '%Y')) AS DATE) >= DATE '2024-01-05'), o AS (SELECT * FROM f ORDER BY md5(concat_ws('|', '3', strain)), strain LIMIT 150),
s AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5(concat_ws('|', '3', strain)), strain) AS n FROM o) SELECT strain, country FROM s WHERE (SELECT count(*) FROM o) <= 50 OR n <= ceil(50 / (SELECT count(DISTINCT country) FROM o)) ORDER BY strain LIMIT 50""", "meta")
def g2_selected(spark: SparkSession, d: str) -> DataFrame:
    """A date filter, one row per name, three times the wanted number by hash, then by strata."""
    dated = view(spark, d, "meta").filter(Q.in_dates(Q.date_of(F.col("collection_date")), "2024-01-05", None)).dropDuplicates(["strain"])
    return G.stratified(G.uniform_cap(dated, "strain", 150, 3), "strain", F.col("country"), 50, 3).select("strain", "country")


_SPLIT = "sp AS (SELECT p_brand AS u, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '9', p_brand)), p_brand) <= greatest(1, least(round_even(count(*) OVER () * 0.2, 0), count(*) OVER () - 1)) THEN 'train' ELSE 'test' END AS side FROM (SELECT DISTINCT p_brand FROM part))"


@query(f"WITH {_SPLIT} SELECT u, side FROM sp")
def g3_split(spark: SparkSession, d: str) -> DataFrame:
    return G.split_units(table(spark, d, "part").select(F.col("p_brand").alias("u")), "u", 9)


@query(f"""WITH {_SPLIT}, t AS (SELECT unnest(['#1', '#2', '#3']) AS t), mv AS (SELECT DISTINCT (SELECT min(u) FROM sp WHERE side = 'train' AND contains(u, t)) AS u FROM t WHERE NOT EXISTS (SELECT 1 FROM sp WHERE side = 'test' AND contains(u, t))), m AS (SELECT u FROM mv WHERE u IS NOT NULL),
b AS (SELECT u FROM sp WHERE side = 'test' AND NOT contains(u, '#1') AND NOT contains(u, '#2') AND NOT contains(u, '#3') QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', '9', u)), u) <= (SELECT count(*) FROM m)) SELECT u, CASE WHEN u IN (FROM m) THEN 'test' WHEN u IN (FROM b) THEN 'train' ELSE side END AS side FROM sp""")
def g4_required(spark: SparkSession, d: str) -> DataFrame:
    return G.with_required(g3_split(spark, d), "u", ["#1", "#2", "#3"], 9)


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', '4', o_orderkey)), o_orderkey LIMIT 5000")
def g5_uniform_cap(spark: SparkSession, d: str) -> DataFrame:
    return G.uniform_cap(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5000, 4)


_QC = """m AS (SELECT unit_id, count(*) AS n, round(avg(length(regexp_replace(seq, '[ACGT]', '', 'g')) / 96), 6) AS amb, max(len(list_filter(list_transform(range(0, 31), lambda i: substr(seq, i * 3 + 1, 3)), lambda c: c IN ('TAA', 'TAG', 'TGA')))) > 0 AS stops FROM aln GROUP BY unit_id),
f AS (SELECT *, CASE WHEN unit_id % 11 = 10 THEN 1 WHEN n < 2 THEN 2 WHEN stops THEN 3 WHEN amb > 0.28 THEN 4 ELSE 0 END AS k FROM m), g AS (SELECT *, coalesce(sum((k = 0)::INT) OVER (ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4 AS skip FROM f),
st AS (SELECT unnest([1, 2, 3, 4]) AS stage_no, unnest(['DISCOVER_FILES', 'TAXA_MATCH', 'CODON_QC', 'LENGTH_FILTER']) AS stage, unnest(['missing_path', 'too_few_taxa', 'internal_stop', 'ambiguous']) AS why),
au AS (SELECT unit_id, stage_no, stage, CASE WHEN stage_no = k THEN 'DROP' ELSE 'PASS' END AS status, CASE WHEN stage_no = k THEN why ELSE 'ok' END AS reason FROM g, st WHERE NOT skip AND (k = 0 OR stage_no <= k) UNION ALL SELECT unit_id, 5, 'FINAL_KEEP', CASE WHEN skip THEN 'SKIP' WHEN k > 0 THEN 'DROP' ELSE 'KEEP' END, CASE WHEN skip THEN 'MAX_UNITS_LIMIT' WHEN k > 0 THEN why ELSE 'ok' END FROM g LEFT JOIN st ON stage_no = k)"""


_SUMMARY = f"""{_QC}, fin AS (SELECT * FROM au WHERE stage = 'FINAL_KEEP')
SELECT 'total' AS item, count(*) AS n FROM fin UNION ALL SELECT 'kept', count(*) FROM fin WHERE status = 'KEEP'
UNION ALL SELECT 'drop:' || reason, count(*) FROM fin WHERE status = 'DROP' GROUP BY reason"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    unclear = F.length(F.translate("seq", "ACGT", "")) / 96
    metrics = view(spark, d, "aln").groupBy("unit_id").agg(F.count("*").alias("n"), F.round(F.avg(unclear), 6).alias("amb"), F.max(Q.has_internal_stop(F.col("seq"))).alias("stops"))
    stages = [
        ("DISCOVER_FILES", F.col("unit_id") % 11 == 10, "missing_path"),
        ("TAXA_MATCH", F.col("n") < 2, "too_few_taxa"),
        ("CODON_QC", F.col("stops"), "internal_stop"),
        ("LENGTH_FILTER", F.col("amb") > 0.28, "ambiguous"),
    ]
    return V.staged_audit(metrics, "unit_id", stages, "unit_id", 4)


@query(f"{_QC} SELECT unit_id, stage_no, stage, status, reason FROM au", "aln")
def f32_staged_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


@query(_SUMMARY, "aln")
def f33_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.audit_summary(_audit(spark, d))


@query(f"{_QC} SELECT unit_id, stage_no, stage, status, reason FROM au", "aln")
def f32_staged_audit_all(spark: SparkSession, d: str) -> DataFrame:
    """The name under which f32_staged_audit was registered while that took a part of the members."""
    return _audit(spark, d)


@query(_SUMMARY, "aln")
def f33_audit_summary_all(spark: SparkSession, d: str) -> DataFrame:
    return V.audit_summary(_audit(spark, d))


@query("""r AS (SELECT unnest(['a', 'b', 'c']) AS region, unnest([1, 2, 3]) AS o, unnest([1, 31, 40]) AS s, unnest([30, 60, 96]) AS e), x AS (SELECT unit_id, taxon, substr(seq, 1, 96 - CAST(taxon % 5 AS INT)) AS seq FROM aln),
t AS (SELECT unit_id, taxon, region, o, CASE WHEN length(seq) < e THEN 1 WHEN (e - s + 1) % 3 <> 0 THEN 2 WHEN len(list_filter(list_transform(range(0, (e - s + 1) // 3 - 1), lambda i: substr(seq, s + i * 3, 3)), lambda c: c IN ('TAA', 'TAG', 'TGA'))) > 0 THEN 3 END AS k FROM x, r),
f AS (SELECT unit_id, taxon, arg_min(region || CASE k WHEN 1 THEN ':short' WHEN 2 THEN ':frame' ELSE ':internal_stop' END, o * 10 + k) AS why FROM t WHERE k IS NOT NULL GROUP BY ALL)
SELECT x.unit_id, x.taxon, CASE WHEN length(regexp_replace(seq, '[^N]', '', 'g')) / length(seq) > 0.1 THEN 'too_many_n' ELSE coalesce(why, 'kept') END AS reason FROM x LEFT JOIN f ON f.unit_id = x.unit_id AND f.taxon = x.taxon""", "aln")
def b9_region_qc(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").selectExpr("unit_id", "taxon", "substr(seq, 1, int(96 - taxon % 5)) AS seq")
    regions = spark.createDataFrame([("a", 1, 1, 30), ("b", 2, 31, 60), ("c", 3, 40, 96)], "region string, region_order int, start int, end int")
    return V.region_qc(rows, regions, ["unit_id", "taxon"], "seq", 0.1).select("unit_id", "taxon", "reason")


@query("""SELECT name, CASE WHEN n > 0 THEN level ELSE 'PASS' END AS status, n, offenders, fix FROM (SELECT 'negative_balance' AS name, 'WARN' AS level, 'check balances' AS fix, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n, (SELECT string_agg(c_custkey, ',' ORDER BY c_custkey) FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 8)) AS offenders
UNION ALL SELECT 'no_name', 'FAIL', 'name customers', 0, '')""")
def f38_readiness(spark: SparkSession, d: str) -> DataFrame:
    rules = {"negative_balance": (F.col("c_acctbal") < 0, "WARN", "check balances"), "no_name": (F.trim("c_name") == "", "FAIL", "name customers")}
    return V.readiness(table(spark, d, "customer"), rules, "c_custkey")


@query("s AS (SELECT unit_id, taxon, seq, len(list_filter(list_transform(range(0, 32), lambda i: substr(seq, i * 3 + 1, 3)), lambda c: regexp_matches(c, '[^ACGT]'))) / 32 AS amb FROM aln) SELECT unit_id, max(length(seq)) AS length, count(*) AS n_before, count(*) FILTER (amb <= 0.6) AS n_after, round(avg(amb), 6) AS mean_ambiguity FROM s GROUP BY unit_id", "aln")
def f35_import_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "aln").withColumn("amb", Q.ambiguous_codon_fraction(F.col("seq")))
    return _r(rows.groupBy("unit_id").agg(F.max(F.length("seq")).alias("length"), F.count("*").alias("n_before"), F.count_if(F.col("amb") <= 0.6).alias("n_after"), F.avg("amb").alias("mean_ambiguity")), 6, "mean_ambiguity")


@query("SELECT unit_id, len(l) AS n_leaves, list_sum(v) AS tree_length, len(list_distinct(l)) = len(l) AS unique_leaves, FALSE AS bad_length, array_to_string(l, ',') AS leaves FROM (SELECT unit_id, regexp_extract_all(regexp_replace(newick, '\\)[^()]*$', ')'), '[(,]\\s*([^(),:;]+)', 1) AS l, list_transform(regexp_extract_all(regexp_replace(newick, '\\)[^()]*$', ')'), ':([0-9.eE+-]+)', 1), lambda x: x::DOUBLE) AS v FROM trees)", "trees")
def t1_tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    out = T.described(view(spark, d, "trees"))
    return out.select("unit_id", "n_leaves", "tree_length", "unique_leaves", "bad_length", F.array_join("leaves", ",").alias("leaves"))


@query("SELECT unit_id, 2 AS n_internal, CASE WHEN len(newick) - len(replace(newick, ',', '')) + 1 > 2 THEN 1 ELSE 0 END AS n_polytomies FROM trees", "trees")
def t2_polytomies(spark: SparkSession, d: str) -> DataFrame:
    nested = view(spark, d, "trees").selectExpr("unit_id", "concat('(', replace(newick, ';', ''), ',X:1);') AS newick")
    return T.polytomies(nested, "unit_id")


@query("SELECT s_nationkey, '(' || string_agg('S' || s_suppkey || ':0.1', ',' ORDER BY s_suppkey) || ');' AS tree FROM supplier GROUP BY s_nationkey")
def t3_star_tree(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("S"), x.cast("string")))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(names.alias("names")).select("s_nationkey", T.star(F.col("names")).alias("tree"))


@query("SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.accession')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) AS key FROM events WHERE coalesce(nullif(trim(json_extract_string(props, '$.accession')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) IS NOT NULL")
def a6_json_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", S.json_first("props", "$.accession", "$.k").alias("key"))
    return rows.filter("key IS NOT NULL")


@query("""SELECT page_id, i - 1 AS pos, u AS href FROM (SELECT page_id, unnest(l) AS u, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, list_filter(list_distinct_ordered, lambda x: x NOT IN ('./', '../')) AS l FROM (SELECT page_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: [trim(x)])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM pages)))""")
def a13_links(spark: SparkSession, d: str) -> DataFrame:
    return S.hrefs(table(spark, d, "pages"), "page_id", "html")


@query("SELECT unit_id, ord FROM methods WHERE ord % 4 <> 0", "methods")
def a10_unfinished(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods")
    return S.unfinished(rows, rows.filter("ord % 4 = 0"), ["ord"]).select("unit_id", "ord")


def _content(name: str, columns: str) -> str:
    """SQL of a table's row in the manifest: four sums over the first halves of hashes of its rows."""
    # A column's name ends in ! if its values are floating-point numbers.
    fields = ", ".join(f"coalesce({canonical_number_sql(c[:-1]) if c.endswith('!') else c + '::STRING'}, '')" for c in sorted(columns.split()))
    sums = ", ".join(f"sum(('0x' || substr(h, {k}, 8))::BIGINT)::STRING" for k in (1, 9, 17, 25))
    return f"SELECT '{name}' AS \"table\", count(*) AS n_rows, sha256(concat_ws('|', count(*)::STRING, {sums})) AS content_hash FROM (SELECT sha256(concat_ws(chr(31), {fields})) AS h FROM {name})"


@query(" UNION ALL ".join(_content(*t) for t in (("region", "r_regionkey r_name"), ("nation", "n_nationkey n_name n_regionkey"), ("supplier", "s_suppkey s_name s_nationkey"), ("customer", "c_custkey c_name c_nationkey"))))
def a12_bundle_manifest(spark: SparkSession, d: str) -> DataFrame:
    columns = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "customer": ["c_custkey", "c_name", "c_nationkey"]}
    return S.manifest({t: table(spark, d, t).select(*c) for t, c in columns.items()})


@query(" UNION ALL ".join(_content(*t) for t in (("region", "r_regionkey r_name"), ("nation", "n_nationkey n_name n_regionkey"), ("supplier", "s_suppkey s_name s_nationkey s_acctbal!"), ("part", "p_partkey p_name p_brand p_type p_size p_retailprice!"))))
def a12_whole_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All columns, among them floating-point numbers."""
    return S.manifest({t: table(spark, d, t) for t in ("region", "nation", "supplier", "part")})


@query("SELECT method, status, count(*) AS n, sum(runtime_sec) AS seconds FROM methods GROUP BY ALL", "methods")
def k2_progress(spark: SparkSession, d: str) -> DataFrame:
    """The aggregation of the progress stream, over a finished table."""
    from unitscope.streaming.scoring import progress

    return progress(view(spark, d, "methods"))
