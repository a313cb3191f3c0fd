"""Readers and writers: sequences, tab-separated tables, manifests, hyperlinks, checksums and resumable stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.functions.sequences import field_text, normalised, record_hash
from unitscope.functions.statistics import canonical_number

FASTA_GLOB = "*.{fa,fasta,fas,fna,aln}"


def read_fasta(spark: SparkSession, path: str, glob: str = FASTA_GLOB, required: bool = False) -> DataFrame:
    """(unit_id, taxon, seq, status) of all FASTA files below a folder; unit is the file's stem, or the value in the name of a folder "key=value" that it lies in. With required, no files are an error.

    Files are split at headers. A header without a sequence, or text before the first header, is a row with a status instead of an error."""
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    if required and raw.isEmpty():
        raise ValueError(f"no sequence files below {path}")
    of_path = lambda pattern: F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit(""))
    named = raw.select(F.coalesce(of_path(r"/[^/=]+=([^/]+)/[^/]+$"), of_path(r"([^/]+)\.[^./]+$")).alias("unit_id"), F.col("value"))
    first = F.col("value").startswith(">")
    split = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    rows = named.select("unit_id", F.trim(split[0]).alias("taxon"), normalised(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit(""))).alias("seq"), first.alias("_first"))
    # Only a file's first record keeps its ">"; a record that has none and no sequence either is text without a header.
    status = F.when((F.col("taxon") == "") & (F.col("seq") == ""), "EMPTY").when(F.col("taxon") == "", "MISSING_HEADER").when(F.col("seq") == "", "MISSING_SEQUENCE").otherwise("OK")
    return rows.select("unit_id", "taxon", "seq", status.alias("status")).filter("status <> 'EMPTY'")


def write_fasta(rows: DataFrame, path: str, unit: str = "unit_id", taxon: str = "taxon", seq: str = "seq") -> None:
    """A folder of text files per unit."""
    rows.select(unit, F.concat(F.lit(">"), F.col(taxon).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.partitionBy(unit).text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed tab-separated table; an absent path is an empty table of the schema. Columns are found by place; a header with other names is an error."""
    return _unless_absent(lambda: spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).csv(path), spark, schema)


def _unless_absent(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_tsv(rows: DataFrame, path: str) -> None:
    clean = rows.select(*(field_text(F.col(f"`{c}`")).alias(c) for c in rows.columns))
    clean.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def json_first(column: str, *paths: str) -> Column:
    """The first of several spellings of a key that has a value; null for text that is no JSON."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(column, p)), F.lit("")) for p in paths))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(tree_path, pos, gene_id, alignment_path) of a dataset manifest; a missing id is gene_<ordinal>. Raises without required keys."""
    schema = "schema_version int, tree_path string, neutral_model_json string, genes array<struct<gene_id: string, alignment_path: string>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    if whole.filter("schema_version IS NULL OR genes IS NULL").take(1) or not whole.take(1):
        raise ValueError(f"{path} lacks schema_version or genes")
    each = whole.select("tree_path", F.posexplode_outer("genes").alias("pos", "gene"))
    return each.select("tree_path", "pos", F.coalesce(F.nullif(F.trim("gene.gene_id"), F.lit("")), F.concat(F.lit("gene_"), (F.col("pos") + 1).cast("string"))).alias("gene_id"), "gene.alignment_path")


def hrefs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href): distinct links of a page in order of first appearance, without ./ and ../."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1), lambda x: F.trim(x)))
    kept = F.filter(found, lambda u: ~u.isin("./", "../"))
    return pages.select(key, F.posexplode(kept).alias("pos", "href"))


def checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(sha256, path) of every file below a folder; files must fit a task, as result tables of a run do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", "([^/]+)$", 1).alias("path")).orderBy("path")


def unfinished(tasks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return tasks.join(done, key, "left_anti")


_COMMIT = "number long, folder string"


def committed(spark: SparkSession, store: str) -> DataFrame:
    """(number, folder) of the store's finished batches; what a broken append has written is in none."""
    return _unless_absent(lambda: spark.read.schema(_COMMIT).json(f"{store}/commits"), spark, _COMMIT)


def append_results(results: DataFrame, store: str, number: int | None = None) -> bool:
    """Appends a batch to the store unless one of its number is there already; whether it did.

    The batch goes to a folder of its own, and is part of the store once one small file names that folder, which is written last; so
    readers see all of a batch or nothing, and no append reads what the store holds. Without a number a batch is the next one
    (of one writer at a time). What a broken append leaves behind is never read."""
    spark = results.sparkSession
    # A row to each batch.
    done = [r["number"] for r in committed(spark, store).select("number").collect()]
    number = max(done, default=-1) + 1 if number is None else number
    if number in done:
        return False
    folder = f"batch-{number}-{uuid.uuid4().hex}"
    results.write.parquet(f"{store}/{folder}")
    spark.createDataFrame([(number, folder)], _COMMIT).coalesce(1).write.mode("append").json(f"{store}/commits")
    return True


def read_results(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The results of the store's finished batches, none where it does not exist yet."""
    folders = [f"{store}/{r['folder']}" for r in committed(spark, store).collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def resume(tasks: DataFrame, score, store: str, key: list[str], schema: str) -> DataFrame:
    """All results after scoring only the tasks that the store does not have yet."""
    spark = tasks.sparkSession
    done = read_results(spark, store, schema)
    append_results(score(unfinished(tasks, done, key)).select(*done.columns), store)
    return read_results(spark, store, schema)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, content_hash): row counts and hashes that do not depend on row order, from sums of row hashes. Floating-point numbers count by their mantissa and exponent, not by an engine's text."""
    rows = None
    for name, df in sorted(tables.items()):
        exact = df.select(*(canonical_number(F.col(f"`{c}`").cast("double")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))
        hashed = exact.select(record_hash(*df.columns).alias("h"))
        halves = [F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("decimal(20,0)")) for k in (1, 9, 17, 25)]
        one = hashed.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(h.cast("string") for h in halves)), 256).alias("content_hash")).select(F.lit(name).alias("table"), "n_rows", "content_hash")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def summaries(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every summary table as a function of the raw tables alone, so that a rebuild from stored tables gives them again."""
    from unitscope.operators import diagnostics, summary

    out: dict[str, DataFrame] = {}
    if (grid := raw.get("grid")) is not None:
        out["size"] = summary.empirical_size(grid, ["taxa", "L"])
        out["power"] = summary.power_table(grid, ["family", "method", "taxa", "L"])
        out["failures"] = summary.failure_rates(grid, ["family", "method"])
        out["runtimes"] = summary.runtimes(grid, ["method", "L"])
        out["discreteness"] = summary.discreteness(grid, "N", "p")
        out["null_validation"] = diagnostics.null_validation(grid, "p", 999)
        out["grid_floor"] = diagnostics.grid_floor(grid, "family", "p", 999)
    if (methods := raw.get("methods")) is not None:
        out["failure_audit"] = summary.failure_audit(methods)
    return out
