"""Files, stores and streams: what a query writes to a new shared folder is read again, and the result compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.operators import energy
from unitscope.plans.core import _CORE, FEATURES
from unitscope.plans.views import register, table, view
from unitscope.sources import tables as S
from unitscope.sources.shared import scratch
from unitscope.streaming import scoring

QUERIES, ORACLE, query = register()


@query("SELECT unit_id::STRING AS unit_id, taxon::STRING AS taxon, seq, 'OK' AS status FROM aln", "aln")
def a1_fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A9, A1 and A2: a folder of sequence files per unit, listed recursively and read."""
    S.write_fasta(view(spark, d, "aln"), path := scratch(spark, "fasta"))
    return S.read_fasta(spark, path, glob="*.txt", required=True)


@query("SELECT ord, method, status, reason, p_value, runtime_sec FROM methods", "methods")
def a3_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A4 and A3."""
    rows = view(spark, d, "methods").select("ord", "method", "status", "reason", "p_value", "runtime_sec")
    S.write_tsv(rows, path := scratch(spark, "tsv"))
    return S.read_tsv(spark, path, "ord long, method string, status string, reason string, p_value double, runtime_sec double")


@query(
    """SELECT 'tree' || s_nationkey AS tree_path, (row_number() OVER w - 1)::INT AS pos,
CASE WHEN s_suppkey % 3 = 0 THEN 'gene_' || row_number() OVER w ELSE s_name END AS gene_id, 'aln/' || s_suppkey AS alignment_path FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)"""
)
def a7_manifests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for each nation, whose suppliers are its genes; every third has a blank id."""
    gene = F.struct("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("gene_id"), F.concat(F.lit("aln/"), "s_suppkey").alias("alignment_path"))
    genes = F.transform(F.array_sort(F.collect_list(gene)), lambda g: F.struct(g["gene_id"].alias("gene_id"), g["alignment_path"].alias("alignment_path")))
    docs = table(spark, d, "supplier").groupBy("s_nationkey").agg(genes.alias("genes"))
    made = docs.select("s_nationkey", F.lit(1).alias("schema_version"), F.concat(F.lit("tree"), "s_nationkey").alias("tree_path"), "genes")
    made.write.partitionBy("s_nationkey").json(path := scratch(spark, "manifests"))
    return S.read_manifest(spark, path)


@query(_CORE + "SELECT unit_id, n_sites, round(mean_energy, 6) AS mean_energy, round(D, 6) AS D FROM units")
def a8_saved_model(spark: SparkSession, d: str) -> DataFrame:
    """Units scored by a model that was saved and loaded again."""
    sites = view(spark, d, "sites")
    energy.save(energy.fit(sites, FEATURES), spark, path := scratch(spark, "model"))
    model = energy.load(spark, path)
    units = energy.dispersion(sites.select("unit_id", energy.energy(model).alias("energy")), "unit_id")
    return units.select("unit_id", "n_sites", F.round("mean_energy", 6).alias("mean_energy"), F.round("D", 6).alias("D"))


@query("SELECT sha256, count(*) AS n_files FROM (SELECT sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY c_nationkey) GROUP BY sha256")
def a11_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Of a file for each nation with its customers' names."""
    rows = table(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(path := scratch(spark, "files"))
    return S.checksums(spark, path, "*.txt").groupBy("sha256").agg(F.count("*").alias("n_files"))


_SUMMARIES = """SELECT 'size' AS summary, (SELECT count(*) FROM (SELECT DISTINCT taxa, L FROM grid)) * 4 AS n_rows
UNION ALL SELECT 'power', count(*) FROM (SELECT DISTINCT family, method, taxa, L FROM grid)
UNION ALL SELECT 'failures', count(*) FROM (SELECT DISTINCT family, method FROM grid)
UNION ALL SELECT 'runtimes', count(*) FROM (SELECT DISTINCT method, L FROM grid)
UNION ALL SELECT 'discreteness', count(*) FROM (SELECT DISTINCT N FROM grid)
UNION ALL SELECT 'null_validation', 1
UNION ALL SELECT 'grid_floor', count(*) FROM (SELECT DISTINCT family FROM grid)
UNION ALL SELECT 'failure_audit', count(*) FROM (SELECT DISTINCT method, status, reason FROM methods WHERE status <> 'OK')"""


@query(_SUMMARIES, "grid", "methods")
def a14_rebuilt_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every summary, rebuilt from stored raw tables alone, with its number of rows."""
    raw = {}
    for name in ("grid", "methods"):
        view(spark, d, name).write.parquet(path := scratch(spark, name))
        raw[name] = spark.read.parquet(path)
    out = None
    for name, rows in S.summaries(raw).items():
        one = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("summary"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    _CORE
    + """SELECT u.unit_id, u.n_sites, round(u.mean_energy, 6) AS mean_energy, round(u.D, 6) AS D, (SELECT count(*) FROM units) AS null_size,
round((1 + (SELECT count(*) FROM units o WHERE o.D * 0.999 >= u.D)) / ((SELECT count(*) FROM units) + 1), 6) AS p_value, 'OK' AS status, CASE WHEN u.unit_id % 7 = 0 THEN u.n_sites ELSE 0 END AS n_late FROM units u"""
)
def k1_scored_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every unit arrive in two loads of files, each read by a new start of the stream; the second has the units' end markers. Units are scored against a null of all units' own
    statistics less a thousandth. A third load repeats the rows of every seventh unit, too late."""
    sites = view(spark, d, "sites").select("unit_id", "l_orderkey", *FEATURES)
    model = energy.fit(sites, FEATURES)
    source, store, checkpoint, null = (scratch(spark, name) for name in ("arrivals", "store", "stream", "null"))
    energy.dispersion(sites.withColumn("energy", energy.energy(model)), "unit_id").select((F.col("D") * 0.999).alias("D")).write.parquet(null)
    timed = lambda rows, minute, last: rows.select("unit_id", *FEATURES, F.lit(f"2024-01-01 00:0{minute}:00").cast("timestamp").alias("event_time"), F.lit(last).alias("last"))
    markers = sites.select("unit_id").distinct().withColumns({f: F.lit(None).cast("double") for f in FEATURES})
    loads = [timed(sites.filter(F.col("l_orderkey") % 2 == part), part, False) for part in range(2)] + [timed(sites.filter(F.col("unit_id") % 7 == 0), 2, False)]
    loads[1] = loads[1].unionByName(timed(markers, 1, True))
    for rows in loads:
        rows.write.mode("append").parquet(source)
        scoring.score_files(spark, source, "unit_id long, f1 double, f2 double, event_time timestamp, last boolean", store, checkpoint, model, spark.read.parquet(null)).awaitTermination()
    rounded = [F.round(c, 6).alias(c) if c in ("mean_energy", "D", "p_value") else F.col(c) for c in (f.split(" ")[0] for f in scoring.RESULTS.split(", "))]
    return scoring.stored(spark, store).join(scoring.late_rows(spark, store), "unit_id", "left").select(*rounded, F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"))


@query("SELECT method, status, count(*) AS n, sum(runtime_sec) AS seconds FROM methods GROUP BY ALL", "methods")
def k2_progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """Progress of results that arrive as files, as a stream leaves it."""
    schema = "method string, status string, runtime_sec double"
    view(spark, d, "methods").select("method", "status", "runtime_sec").write.parquet(source := scratch(spark, "results"))
    name = "progress_" + source.rsplit("-", 1)[1]
    scoring.progress_stream(spark, source, schema, name, scratch(spark, "stream")).awaitTermination()
    return spark.table(name)
