"""Sequence, name, date and tree operators over the alignment views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.functions import sequences as S
from unitscope.functions import statistics as T
from unitscope.operators import alignments as A
from unitscope.plans.views import register, table, view

QUERIES, ORACLE, query = register()

_COD = "list_transform(range(0, length(seq) // 3), lambda i: substr(seq, i * 3 + 1, 3))"


@query("SELECT c_custkey, upper(regexp_replace(c_mktsegment || ' ' || c_name, '\\s+', '', 'g')) AS up, translate(upper(regexp_replace(c_name || ' u t', '\\s+', '', 'g')), 'U', 'T') AS dna FROM customer")
def b1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.normalised(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("up"), S.normalised(F.concat("c_name", F.lit(" u t")), True).alias("dna"))


@query("SELECT unit_id, taxon, unnest(range(1, 97)) AS pos, unnest(string_split(seq, '')) AS sym FROM aln", "aln")
def b2_sites(spark: SparkSession, d: str) -> DataFrame:
    return A.sites(view(spark, d, "aln"))


@query("SELECT unit_id, taxon, CASE WHEN taxon % 120 > taxon % 50 AND taxon % 120 <= 96 THEN substr(seq, taxon % 50 + 1, taxon % 120 - taxon % 50) END AS part FROM aln", "aln")
def b3_slice(spark: SparkSession, d: str) -> DataFrame:
    low, high = (F.col("taxon") % 50).cast("int"), (F.col("taxon") % 120).cast("int")
    return view(spark, d, "aln").select("unit_id", "taxon", S.part(F.col("seq"), low, high).alias("part"))


@query(f"SELECT unit_id, taxon, array_to_string({_COD}, '|') AS codons, len(list_filter({_COD}, lambda c: regexp_matches(c, '[^ACGT]'))) / 32 AS ambiguous, len(list_filter(({_COD})[1:31], lambda c: c IN ('TAA', 'TAG', 'TGA'))) > 0 AS stops FROM aln", "aln")
def b4_b5_b6_codons(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return view(spark, d, "aln").select("unit_id", "taxon", F.array_join(S.codons(s), "|").alias("codons"), S.ambiguous_codon_fraction(s).alias("ambiguous"), S.has_internal_stop(s).alias("stops"))


@query("SELECT unit_id, taxon, i * 3 + 1 AS nt_pos, substr(seq, i * 3 + 1, 3) AS codon FROM aln, (SELECT unnest(range(0, 31))::INT AS i) WHERE substr(seq, i * 3 + 1, 3) IN ('TAA', 'TAG', 'TGA')", "aln")
def b7_stop_places(spark: SparkSession, d: str) -> DataFrame:
    return A.internal_stops(view(spark, d, "aln"))


@query(f"""SELECT unit_id, CASE WHEN (length(seq) - taxon % 4) % 3 <> 0 THEN 'frame' WHEN len(list_filter(list_transform(range(0, (length(seq) - taxon % 4) // 3 - 1), lambda i: substr(seq, i * 3 + 1, 3)), lambda c: c IN ('TAA', 'TAG', 'TGA'))) > 0 THEN 'internal_stop'
  WHEN len(list_filter(list_transform(range(0, (length(seq) - taxon % 4) // 3), lambda i: substr(seq, i * 3 + 1, 3)), lambda c: regexp_matches(c, '[^ACGT]'))) / ((length(seq) - taxon % 4) // 3) > 0.3 THEN 'ambiguous' ELSE 'kept' END AS reason, count(*) AS n FROM aln GROUP BY ALL""", "aln")
def b8_sequence_qc(spark: SparkSession, d: str) -> DataFrame:
    cut = view(spark, d, "aln").withColumn("seq", F.expr("substr(seq, 1, int(length(seq) - taxon % 4))"))
    return A.judged(cut, 0.3).groupBy("unit_id", "reason").agg(F.count("*").alias("n"))


@query("SELECT unit_id, array_to_string(list_sort(list_distinct(list(s))), '') AS foreign_symbols FROM (SELECT unit_id, unnest(string_split(seq, '')) AS s FROM aln) WHERE s NOT IN ('A', 'C', 'G', 'T') GROUP BY unit_id", "aln")
def b10_alphabet(spark: SparkSession, d: str) -> DataFrame:
    extra = F.array_except(F.array_distinct(F.split("seq", "")), F.array(*(F.lit(x) for x in [*"ACGT", ""])))
    return view(spark, d, "aln").select("unit_id", F.explode(extra).alias("s")).groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("s")), "").alias("foreign_symbols"))


@query("""SELECT strain, CAST(coalesce(try_strptime(collection_date, '%Y-%m-%d'), try_strptime(collection_date, '%Y-%m'), try_strptime(collection_date, '%Y')) AS DATE) AS day,
  CASE WHEN length(collection_date) >= 7 AND substr(collection_date, 5, 1) = '-' THEN substr(collection_date, 1, 7) ELSE 'unknown' END AS month FROM meta""", "meta")
def b11_b13_dates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("collection_date")
    return view(spark, d, "meta").select("strain", S.date_of(c).alias("day"), S.month_of(c).alias("month"))


@query("SELECT strain FROM meta WHERE CAST(coalesce(try_strptime(collection_date, '%Y-%m-%d'), try_strptime(collection_date, '%Y-%m'), try_strptime(collection_date, '%Y')) AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'", "meta")
def b12_date_range(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "meta").filter(S.in_dates(S.date_of(F.col("collection_date")), "2024-01-02", "2024-01-20")).select("strain")


@query("SELECT p_partkey, lower(regexp_replace(trim(split_part(trim(split_part(' ' || p_name || ' / ' || p_type || '|' || p_brand, '|', 1)), '/', 1)), '\\s+', '_', 'g')) AS taxon FROM part")
def b14_taxon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.taxon(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_type", F.lit("|"), "p_brand")).alias("taxon"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace('._' || p_type || '#' || p_brand, '[^\\p{L}\\p{N}_.-]', '_', 'g'), '._'), ''), 'gene') AS id,
  coalesce(nullif(trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]', '_', 'g'), '_'), ''), 'baseline') AS col, coalesce(nullif(trim(regexp_replace(lower(trim(p_type || ' -- ' || p_brand)), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), ''), 'unknown') AS tok FROM part""")
def b15_identifiers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("._"), "p_type", F.lit("#"), "p_brand")
    return table(spark, d, "part").select("p_partkey", S.identifier(raw).alias("id"), S.column_name(F.col("p_type")).alias("col"), S.token(F.concat("p_type", F.lit(" -- "), "p_brand")).alias("tok"))


@query("SELECT p_partkey, p_brand || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS unique_id FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def b16_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    from unitscope.operators.compare import unique_ids

    return unique_ids(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "unique_id")


@query("SELECT ord, CASE WHEN status = 'OK' AND ord % 3 > 0 THEN 'OK' WHEN ord % 3 = 0 AND ord % 2 = 0 THEN 'SKIP_not_run' WHEN ord % 3 = 0 THEN 'SKIP_' || reason || '_' || ord % 5 ELSE 'FAIL_' || reason || '_' || ord % 5 END AS state FROM methods", "methods")
def b17_status(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "methods").withColumn("s", F.expr("CASE WHEN ord % 3 = 0 AND ord % 2 = 0 THEN ' ' WHEN ord % 3 = 0 THEN 'skipped' ELSE status END"))
    return rows.select("ord", S.status(F.col("s"), F.expr("concat(reason, ' -', ord % 5, ' ')")).alias("state"))


@query("SELECT o_orderkey, try_cast(CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE CAST(o_custkey AS STRING) || '.5' END AS DOUBLE) AS x FROM orders")
def b18_numbers(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN if(o_orderkey % 8 = 0, 'NaN', 'n/a') WHEN 1 THEN if(o_orderkey % 8 = 1, 'Infinity', '') ELSE concat(o_custkey, '.5') END")
    return table(spark, d, "orders").select("o_orderkey", T.number(text).alias("x"))


@query("""SELECT o_orderkey, 0.001 * (o_orderkey % 1000) AS p, CAST(o_custkey AS DOUBLE) + 0.25 AS lrt, -1.0 * o_custkey - 0.5 AS lnl FROM orders""")
def b19_log_numbers(spark: SparkSession, d: str) -> DataFrame:
    log = F.expr("concat('start\\nlnL(ntime: 4): -9.0\\nlnL(ntime: 5): -', o_custkey, '.5\\nLRT = ', o_custkey, '.25\\np-value: ', format_string('%.3f', 0.001D * (o_orderkey % 1000)))")
    first = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")
    last = F.element_at(F.regexp_extract_all("log", F.lit(r"lnL\([^)]*\):\s*(-?[0-9.]+)"), 1), -1).try_cast("double")
    rows = table(spark, d, "orders").select("o_orderkey", log.alias("log"))
    number = r"\s*[:=]\s*([-+0-9.eE]+)"
    return rows.select("o_orderkey", first(F.col("log"), "(?i)p-?value" + number).alias("p"), first(F.col("log"), "(?i)lrt" + number).alias("lrt"), last.alias("lnl"))


@query("""SELECT event_id, try_cast(nullif(regexp_extract(props, '(?i)"[^"]*(?:k|v)[^"]*"\\s*:\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS hit FROM events""")
def b20_json_number(spark: SparkSession, d: str) -> DataFrame:
    """The first number, in document order, under a key that contains one of the tokens."""
    found = F.regexp_extract("props", r'(?i)"[^"]*(?:k|v)[^"]*"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1)
    return table(spark, d, "events").select("event_id", F.nullif(found, F.lit("")).try_cast("double").alias("hit"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, 2 * (l_discount - l_tax)) * 50, 6) AS lrt, round(exp(-greatest(0, 2 * (l_discount - l_tax)) * 25), 9) AS p2 FROM lineitem")
def b21_likelihood_ratio(spark: SparkSession, d: str) -> DataFrame:
    lrt = T.likelihood_ratio(F.col("l_tax"), F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(lrt * 50, 6).alias("lrt"), F.round(T.chi2_tail_df2(lrt * 50), 9).alias("p2"))


@query("""WITH q AS (SELECT DISTINCT l_quantity AS x, sqrt(l_quantity / 20) AS z FROM lineitem),
e AS (SELECT x, 1 - 2 / sqrt(pi()) * sum(exp((2 * k + 1) * ln(z) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) - z * z)) AS p1 FROM q, range(0, 150) t(k) WHERE z > 0 GROUP BY x)
SELECT l_orderkey, l_linenumber, round(coalesce(p1, 1), 9) AS p1 FROM lineitem LEFT JOIN e ON x = l_quantity""")
def b21_chi2_one_degree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.chi2_tail_df1(F.col("l_quantity") / 10), 9).alias("p1"))


@query("SELECT ord, round(-log10(least(greatest(p_value, 1e-300), 1)), 6) AS score FROM methods", "methods")
def b22_minus_log10(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "methods").select("ord", F.round(T.minus_log10(F.col("p_value")), 6).alias("score"))


@query("SELECT unit_id, taxon, sha256(concat_ws(chr(31), seq, CAST(taxon AS STRING), CAST(unit_id AS STRING))) AS hash FROM aln", "aln")
def b23_record_hash(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "aln").select("unit_id", "taxon", S.record_hash("unit_id", "taxon", "seq").alias("hash"))


@query("SELECT p_partkey, greatest(3, p_size - p_size % 3) AS n FROM part")
def b24_frame_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.frame_length(F.col("p_size")).alias("n"))


@query("SELECT c_custkey, coalesce(regexp_replace(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || chr(9) || c_mktsegment || chr(10) END, '[\\t\\n]', ' ', 'g'), '') AS f FROM customer")
def a5_field_text(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(c_name, '\\t', c_mktsegment, '\\n') END")
    return table(spark, d, "customer").select("c_custkey", S.field_text(value).alias("f"))


_C = "s AS (SELECT unit_id, taxon, unnest(range(1, 97))::INT AS pos, unnest(string_split(seq, '')) AS sym FROM aln), c AS (SELECT unit_id, pos, sym, count(*) AS c FROM s GROUP BY ALL)"
_SCORE = "CASE sym " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.HYDROPHOBICITY.items()) + " END"


@query(f"""{_C}, f AS (SELECT *, sym IN ('-', '.') AS gap, sym IN ('?', 'X', 'N') AS amb, {_SCORE} AS score FROM c), n AS (SELECT *, sum(CASE WHEN NOT gap AND NOT amb THEN c ELSE 0 END) OVER (PARTITION BY unit_id, pos) AS n FROM f)
SELECT unit_id, pos, round(sum(c) FILTER (gap) / sum(c), 6) AS gap_fraction, round(sum(c) FILTER (amb) / sum(c), 6) AS amb_fraction, round(coalesce(max(c) FILTER (NOT gap AND NOT amb) / max(n), 0), 6) AS major, round(coalesce(min(c) FILTER (NOT gap AND NOT amb) / max(n), 0), 6) AS minor,
round(coalesce(CASE WHEN count(*) FILTER (NOT gap AND NOT amb) > 1 THEN -sum(c / n * ln(c / n + 1e-12)) FILTER (NOT gap AND NOT amb) / ln(count(*) FILTER (NOT gap AND NOT amb)) END, 0), 6) AS entropy,
round(CASE WHEN max(n) > 0 THEN coalesce(sum(c) FILTER (sym IN ('G', 'C')), 0) / max(n) ELSE 0 END, 6) AS gc, round(coalesce(sum(c * score) FILTER (NOT gap AND NOT amb) / max(n), 0), 7) AS score_mean FROM n GROUP BY unit_id, pos""", "aln")
def d1_site_features(spark: SparkSession, d: str) -> DataFrame:
    f = A.site_features(A.sites(view(spark, d, "aln")))
    r = lambda c: F.round(c, 6)
    none = lambda c: F.when(F.col(c) > 0, r(F.col(c)))
    return f.select("unit_id", "pos", none("gap_fraction").alias("gap_fraction"), none("ambiguous_fraction").alias("amb_fraction"), r("major_fraction").alias("major"), r("minor_fraction").alias("minor"), r("entropy").alias("entropy"), r("gc_fraction").alias("gc"), F.round("score_mean", 7).alias("score_mean"))


@query(f"{_C}, p AS (SELECT unit_id, pos, coalesce(ln(sum(c) FILTER (sym NOT IN ('-', 'N', 'X', '?'))) - sum(c * ln(c)) FILTER (sym NOT IN ('-', 'N', 'X', '?')) / sum(c) FILTER (sym NOT IN ('-', 'N', 'X', '?')), 0) AS h FROM c GROUP BY ALL) SELECT unit_id, round(avg(h), 6) AS mean_entropy FROM p GROUP BY unit_id", "aln")
def d2_mean_entropy(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_site_entropy(A.sites(view(spark, d, "aln"))).select("unit_id", F.round("mean_entropy", 6).alias("mean_entropy"))


@query("SELECT unit_id, count(*) AS n_seq, count(DISTINCT length(seq) - CASE WHEN unit_id % 3 = 0 THEN taxon % 2 ELSE 0 END) AS n_lengths, count(DISTINCT length(seq) - CASE WHEN unit_id % 3 = 0 THEN taxon % 2 ELSE 0 END) = 1 AS is_rectangular FROM aln GROUP BY unit_id", "aln")
def f1_rectangular(spark: SparkSession, d: str) -> DataFrame:
    return A.rectangular(view(spark, d, "aln").withColumn("seq", F.expr("if(unit_id % 3 = 0, substr(seq, 1, int(length(seq) - taxon % 2)), seq)")))


@query("""t AS (SELECT *, array_to_string(list_transform(range(1, 33), lambda i: substr(seq, i * 3, 1)), '') AS t3 FROM aln)
SELECT unit_id, round(sum(length(regexp_replace(seq, '[^-]', '', 'g'))) / sum(length(seq)), 6) AS gap_share, round(sum(length(regexp_replace(seq, '[-ACGT]', '', 'g'))) / sum(length(seq)), 6) AS ambiguous_share,
round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / sum(length(regexp_replace(seq, '[^ACGT]', '', 'g'))), 6) AS gc, round(sum(length(regexp_replace(t3, '[^GC]', '', 'g'))) / sum(length(regexp_replace(t3, '[^ACGT]', '', 'g'))), 6) AS gc3 FROM t GROUP BY unit_id""", "aln")
def f2_composition(spark: SparkSession, d: str) -> DataFrame:
    c = A.composition(view(spark, d, "aln"))
    return c.select("unit_id", *(F.round(x, 6).alias(x) for x in c.columns[1:]))


_PAIRS = """p AS (SELECT x.unit_id, list_filter(list_transform(range(1, 97), lambda i: CASE WHEN substr(x.seq, i, 1) IN ('A', 'C', 'G', 'T')
AND substr(y.seq, i, 1) IN ('A', 'C', 'G', 'T') THEN (substr(x.seq, i, 1) <> substr(y.seq, i, 1))::INT END), lambda v: v IS NOT NULL) AS v
FROM aln x JOIN aln y ON x.unit_id = y.unit_id AND x.taxon < y.taxon)
SELECT unit_id, count(CASE WHEN len(v) > 0 THEN 1 END) AS n_pairs, round(avg(CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) END), 6) AS mean_distance FROM p GROUP BY unit_id"""


@query(_PAIRS, "aln")
def c11_pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Over all pairs of all members of each unit."""
    return A.pairwise_distance_of_sequences(view(spark, d, "aln", spread=True)).select("unit_id", "n_pairs", F.round("mean_distance", 6).alias("mean_distance"))


@query(_PAIRS, "aln")
def c11_all_pairs_distance(spark: SparkSession, d: str) -> DataFrame:
    """The name under which c11_pairwise_distance was registered while that took a part of the members."""
    return c11_pairwise_distance(spark, d)


_CODONS = "dim AS (SELECT x, y, z, x || y || z AS codon FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x), (SELECT unnest(['A', 'C', 'G', 'T']) AS y), (SELECT unnest(['A', 'C', 'G', 'T']) AS z) WHERE x || y || z NOT IN ('TAA', 'TAG', 'TGA')), u AS (SELECT DISTINCT unit_id FROM aln)" + f", k AS (SELECT unit_id, unnest({_COD}) AS codon FROM aln)"


@query(f"{_CODONS}, n AS (SELECT unit_id, codon, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT u.unit_id, dim.codon, coalesce(n, 0) + 1e-6 AS x FROM u CROSS JOIN dim LEFT JOIN n ON n.unit_id = u.unit_id AND n.codon = dim.codon) SELECT unit_id, codon, round(x / sum(x) OVER (PARTITION BY unit_id), 9) AS freq FROM g", "aln")
def d16_codon_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return A.empirical_codon_frequencies(view(spark, d, "aln")).withColumn("freq", F.round("freq", 9))


@query(f"""{_CODONS}, b AS (SELECT unit_id, place, substr(codon, place, 1) AS b, count(*) AS n FROM k, (SELECT unnest([1, 2, 3]) AS place) WHERE substr(codon, place, 1) IN ('A', 'C', 'G', 'T') GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY unit_id, place) AS f FROM b),
h AS (SELECT unit_id, place, map_from_entries(list((b, f))) AS m FROM f GROUP BY ALL),
g AS (SELECT u.unit_id, codon, coalesce(f1.m[x], 0) * coalesce(f2.m[y], 0) * coalesce(f3.m[z], 0) + 1e-6 + CASE WHEN f1.m IS NULL OR f2.m IS NULL OR f3.m IS NULL THEN NULL ELSE 0 END AS x FROM u CROSS JOIN dim LEFT JOIN h f1 ON f1.unit_id = u.unit_id AND f1.place = 1 LEFT JOIN h f2 ON f2.unit_id = u.unit_id AND f2.place = 2 LEFT JOIN h f3 ON f3.unit_id = u.unit_id AND f3.place = 3)
SELECT unit_id, codon, round(x / sum(x) OVER (PARTITION BY unit_id), 9) AS freq FROM g""", "aln")
def d17_f3x4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return A.f3x4_codon_frequencies(view(spark, d, "aln")).withColumn("freq", F.round("freq", 9))


@query(f"""{_CODONS}, n AS (SELECT unit_id, codon, count(*)::DOUBLE AS value FROM k GROUP BY ALL), raw AS (SELECT * FROM n WHERE unit_id % 2 = 0 OR codon IN (SELECT codon FROM dim)), s AS (SELECT unit_id, bool_or(codon NOT IN (SELECT codon FROM dim)) AS foreign_, sum(value) AS total FROM raw GROUP BY unit_id)
SELECT s.unit_id, dim.codon, CASE WHEN foreign_ THEN NULL ELSE round(coalesce(value, 0) / total, 9) END AS freq, CASE WHEN foreign_ THEN 'not_sense' ELSE 'OK' END AS status FROM s CROSS JOIN dim LEFT JOIN raw ON raw.unit_id = s.unit_id AND raw.codon = dim.codon""", "aln")
def d18_normalised_frequencies(spark: SparkSession, d: str) -> DataFrame:
    counts = A.codon_counts(view(spark, d, "aln")).withColumn("value", F.col("n").cast("double")).drop("n")
    sense = A.sense_codons(counts).select("codon")
    raw = counts.filter("unit_id % 2 = 0").unionByName(counts.filter("unit_id % 2 = 1").join(F.broadcast(sense), "codon", "left_semi"))
    return A.normalised_frequencies(raw, "unit_id").withColumn("freq", F.round("freq", 9))


_E = "WITH e AS (SELECT l_suppkey AS unit_id, l_quantity AS energy, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS unit_id", "l_quantity AS energy", "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos")


@query(_E + " SELECT unit_id, (pos - 1) // 50 AS block, round(avg(energy), 6) AS mean_value, min(pos) AS start, max(pos) AS \"end\", (min(pos) + max(pos)) / 2 AS centre FROM e GROUP BY ALL")
def e5_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return A.tumbling_means(_positions(spark, d), "unit_id", 50).withColumn("mean_value", F.round("mean_value", 6))


@query("""WITH u AS (SELECT l_suppkey AS unit_id, count(*) AS L FROM lineitem GROUP BY ALL) SELECT unit_id, format('{}__w{:05d}_{:05d}', unit_id, s, s + 300) AS window_id, s AS start, s + 300 AS "end" FROM (SELECT unit_id, unnest(range(0, L - 300 + 1, 50)) AS s FROM u WHERE L >= 300)""")
def e6_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.count("*").alias("L"))
    return A.sliding_windows(units, "unit_id", "L", 300, 50)


@query("""WITH u AS (SELECT l_suppkey AS unit_id, count(*) AS L FROM lineitem GROUP BY ALL) SELECT unit_id, CASE WHEN L >= 600 THEN (L - 600) // 50 + 1 ELSE 0 END AS n_windows, CASE WHEN L >= 600 THEN 'KEEP' ELSE 'DROP' END AS status, CASE WHEN L >= 600 THEN 'n_windows=' || ((L - 600) // 50 + 1) ELSE 'length_lt_window' END AS reason FROM u""")
def e6_window_audit(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.count("*").alias("L"))
    return A.window_audit(units, "unit_id", "L", 600, 50)


@query(_E + ", s AS (SELECT unit_id, pos, pow(energy - avg(energy) OVER (PARTITION BY unit_id), 2) AS sq FROM e), r AS (SELECT unit_id, pos, row_number() OVER w AS rank, sum(sq) OVER (w ROWS UNBOUNDED PRECEDING) / greatest(sum(sq) OVER (PARTITION BY unit_id), 1e-12) AS share FROM s WINDOW w AS (PARTITION BY unit_id ORDER BY round(sq, 6) DESC, pos)) SELECT unit_id, pos, rank, round(share, 6) AS share FROM r WHERE rank <= 20")
def e7_contribution_curve(spark: SparkSession, d: str) -> DataFrame:
    """The 20 positions of each unit that add most to its spread."""
    ranked = A.contribution_curve(_positions(spark, d), "unit_id", "pos", "energy")
    return ranked.filter("rank <= 20").select("unit_id", "pos", "rank", F.round("share", 6).alias("share"))
